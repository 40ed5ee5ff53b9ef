"""Removal of repeated passages of words: a count-min prefilter, then exact grouping of what it cannot rule out.

Every window of ``WINDOW`` words has an anchor, the least hash of the ``GRAM``-word
strings in it.  Equal windows have equal anchors at different places, so an anchor
occurs at least as often as each window that has it, and one anchor serves some
seven windows.  Each partition counts the anchors of its texts in a count-min
sketch; the sketches are merged cell by cell, saturating at two, and an estimate
never falls below the truth.  A second pass takes the windows whose anchor is
estimated to occur twice or more, groups them by a 128-bit hash of their words and
keeps the first place of each; so a window that the sketch lets through by mistake
stays, and none that repeats is missed.  A third pass cuts the others out.

The sketch is broadcast and bounded: ``MOST_CELLS`` bits a row, whatever the size
of the corpus.  With more anchors than that it rules out fewer windows; the results
are the same.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.llm.scratch import Scratch

WINDOW = 20
GRAM = 8
#: Rows of the sketch.
DEPTH = 2
#: Cells of a row: so many for each byte of text, a power of two within these bounds; one bit of each cell is broadcast.
CELLS_PER_BYTE, LEAST_CELLS, MOST_CELLS = 0.25, 1 << 16, 1 << 27
#: Cells of a row that are merged as one block.
BLOCK = 1 << 20
#: Anchors that a partition holds before it hands on what it has counted.
HELD = 2 << 20
#: Bytes of text that are looked at together, and the ids of null.
CHUNK, LAST = 1 << 20, np.iinfo(np.int64).max

_rng = np.random.default_rng(11)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _sliding(x: np.ndarray, size: int, least) -> np.ndarray:
    """The least (or greatest) of each ``size`` neighbours."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = least(x[:-step], x[step:])
        have += step
    return x


class Words:
    """The words of some texts: ``text`` has them with one space between, ``start`` and ``end`` their places, ``doc`` the number of their text.

    ``window`` names the first words of the windows (none crosses texts), ``anchor``
    has the least gram hash of each.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self._size = window
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[raw]
        kept = ~space
        kept[1:] |= space[1:] & ~space[:-1]
        kept[0] = not space[0]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text = np.where(space, np.uint8(32), raw)[kept]
        self.end = np.flatnonzero(self.text == 32)
        self.start = np.append(0, self.end[:-1] + 1)[: len(self.end)]
        at = np.flatnonzero(kept)[self.start] if len(self.end) else np.array([], np.int64)
        self.doc = np.searchsorted(np.cumsum(sizes), at, side="right")
        self.count = np.bincount(self.doc, minlength=len(texts))
        n = len(self.end)
        if n < window:
            self.window, self.anchor, self.grams = np.array([], np.int64), np.array([], np.uint64), np.array([], np.uint64)
            return
        forth, back = _powers(1 << int(len(self.text) + 1).bit_length())
        sums = np.zeros(len(self.text) + 1, np.uint64)
        np.cumsum(_LETTER[self.text] * forth[: len(self.text)], out=sums[1:])
        word = _mixed((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))
        grams = np.zeros(n - gram + 1, np.uint64)
        for j in range(gram):
            grams += word[j : j + len(grams)] * _PLACE[j]
        self.grams = _mixed(grams)
        self._span = window - gram + 1
        anchor = _sliding(self.grams, self._span, np.minimum)
        first = np.arange(n - window + 1)
        inside = self.doc[first] == self.doc[first + window - 1]
        self.window, self.anchor = first[inside], anchor[inside]
        self._all = np.where(inside, anchor, np.uint64(0))

    def anchors(self) -> np.ndarray:
        """The hash of every gram that is the least of some window, once for each place; equals in one window all count."""
        if not len(self.window):
            return self.grams[:0]
        pad = np.zeros(self._span - 1, np.uint64)
        covered = _sliding(np.concatenate([pad, self._all, pad]), self._span, np.maximum)
        return self.grams[covered == self.grams]

    def places(self, windows: np.ndarray) -> np.ndarray:
        """The number of each window's first word in its text."""
        return windows - np.append(0, np.cumsum(self.count))[self.doc[windows]]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows' words, as two integers each."""
        text, digest = self.text.tobytes(), xxhash.xxh3_128_digest
        pairs = zip(self.start[windows].tolist(), self.end[windows + self._size - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([digest(text[a:b]) for a, b in pairs]), "<i8").reshape(-1, 2)


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    return [(_mixed(h + np.uint64((k + 1) * _BASE % 2**64)) & np.uint64(cells - 1)).astype(np.int64) for k in range(DEPTH)]


def _bits(at: np.ndarray, size: int) -> np.ndarray:
    """A bitmap in bytes of the places ``at``, ascending."""
    flags = np.zeros(size, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little")


class Sketch:
    """A merged count-min sketch: of every cell whether two or more fell into it."""

    def __init__(self, cells: int, twice: list[np.ndarray]):
        self.cells, self.twice = cells, twice

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash is estimated to have occurred twice or more."""
        out = np.ones(len(h), bool)
        for cell, twice in zip(_cells(h, self.cells), self.twice, strict=True):
            out &= (twice[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def _chunks(batches, at: int):
    """(batch, texts) in pieces of about CHUNK bytes; a null is empty."""
    for batch in batches:
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)]
        first = held = 0
        for k, size in enumerate(sizes):
            held += size + 1
            if held >= CHUNK or k == len(sizes) - 1:
                piece = batch.slice(first, k + 1 - first)
                yield piece, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in piece.column(at)]
                first, held = k + 1, 0


def _partial(cells: int, window: int, gram: int):
    """The partition's sketch in sparse form: per row and block the cells that were met, and which of them twice or more."""
    size = min(BLOCK, cells)

    def flush(held: list[np.ndarray]):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        for row, cell in enumerate(_cells(h, cells)):
            by = np.argsort(cell, kind="stable")
            cell, twice = cell[by], n[by] > 1
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            more = np.logical_or.reduceat(twice, first) | (np.diff(np.append(first, len(cell))) > 1)
            cell = cell[first]
            cut = np.searchsorted(cell, np.arange(0, cells + 1, size))
            blocks = [b for b in range(len(cut) - 1) if cut[b] < cut[b + 1]]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([row * (cells // size) + b for b in blocks], pa.int32()),
                "cell": pa.array([(cell[cut[b] : cut[b + 1]] % size).astype("<u4").tobytes() for b in blocks], pa.binary()),
                "twice": pa.array([np.packbits(more[cut[b] : cut[b + 1]]).tobytes() for b in blocks], pa.binary()),
            })

    def run(batches):
        held, n = [], 0
        for _, texts in _chunks(batches, 0):
            held.append(Words(texts, window, gram).anchors())
            n += len(held[-1])
            if n >= HELD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _merged(size: int):
    """Blocks of the merged sketch; a task holds no more than two bitmaps of each of its blocks."""

    def run(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                cell = np.frombuffer(cell.as_buffer(), "<u4")
                more = np.unpackbits(np.frombuffer(more.as_buffer(), np.uint8), count=len(cell)) == 1
                met, often = _bits(cell, size), _bits(cell[more], size)
                if block in once:
                    twice[block] |= often | (once[block] & met)
                    once[block] |= met
                else:
                    once[block], twice[block] = met, often
        if twice:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(twice), pa.int32()), "twice": pa.array([b.tobytes() for b in twice.values()], pa.binary())})

    return run


def sketch(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, most_cells: int = MOST_CELLS) -> Sketch:
    """The count-min sketch of the anchors of a column of texts; what reaches the driver is bounded by ``most_cells``."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    cells = LEAST_CELLS
    while cells < min(size * CELLS_PER_BYTE, most_cells):
        cells *= 2
    block = min(BLOCK, cells)
    parts = texts.mapInArrow(_partial(cells, window, gram), "block int, cell binary, twice binary")
    blocks = parts.repartition("block").mapInArrow(_merged(block), "block int, twice binary").collect()  # two bitmaps of most_cells bits at most
    twice = [np.zeros(cells // 8, np.uint8) for _ in range(DEPTH)]
    for r in blocks:
        row, at = divmod(r["block"], cells // block)
        twice[row][at * block // 8 : (at + 1) * block // 8] = np.frombuffer(r["twice"], np.uint8)
    return Sketch(cells, twice)


def _candidates(known, window: int, gram: int):
    """Of every text the first window of each word sequence that is estimated to repeat: its 128-bit hash and its place."""
    names = ["k1", "k2", "doc", "start"]

    def run(batches):
        found = known.value
        for batch, texts in _chunks(batches, 1):
            w = Words(texts, window, gram)
            s = w.window[found.repeated(w.anchor)]
            if not len(s):
                continue
            keys, start = w.keys(s), w.places(s)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[w.doc[s]]
            by = np.lexsort((start, doc, keys[:, 1], keys[:, 0]))  # later copies in this piece come after an earlier one
            by = by[np.append(True, (keys[by[1:]] != keys[by[:-1]]).any(axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(keys[by, 0]), pa.array(keys[by, 1]), pa.array(doc[by]), pa.array(start[by].astype(np.int32))], names=names)

    return run


def _cut(known, others: int, at: int, window: int, gram: int):
    """The texts without the repeated windows: all that are estimated to repeat, but those that came first."""
    names = ["_n_words", "_n_removed", "_spans", "_kept_text"]
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        found = known.value
        for batch, texts in _chunks(batches, at):
            w = Words(texts, window, gram)
            s = w.window[found.repeated(w.anchor)]
            tags, doc = (w.keys(s)[:, 0] ^ (w.places(s) << 40)) if len(s) else s, w.doc[s]
            goes = np.ones(len(s), bool)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            for k, stay in enumerate(batch.column(batch.num_columns - 1)):
                if stay.is_valid and cut[k] < cut[k + 1]:
                    goes[cut[k] : cut[k + 1]] = ~np.isin(tags[cut[k] : cut[k + 1]], stay.values.to_numpy(zero_copy_only=False))
            depth = np.bincount(s[goes], minlength=len(w.end) + 1) - np.bincount(s[goes] + window, minlength=len(w.end) + 1)
            gone = np.cumsum(depth)[:-1] > 0
            first = np.append(0, np.cumsum(w.count))
            text = w.text.tobytes()
            stays = w.text[np.repeat(~gone, w.end - w.start + 1)].tobytes() if gone.any() else text
            sizes = np.append(0, np.cumsum(np.where(gone, 0, w.end - w.start + 1)))
            rows = [[], [], [], []]
            for k in range(len(texts)):
                a, b = first[k], first[k + 1]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                rows[0].append(b - a)
                rows[1].append(int(gone[a:b].sum()))
                rows[2].append([{"first": x, "last": y - 1} for x, y in edge.reshape(-1, 2).tolist()])
                rows[3].append(stays[sizes[a] : max(sizes[b] - 1, sizes[a])].decode("utf-8", "replace"))
            new = [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), spans, pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:others], *new], names=[*batch.schema.names[:others], *names])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most_cells: int = MOST_CELLS) -> DataFrame:
    """``docs`` with columns n_words, n_removed, spans (removed runs of words, first and last from 0) and kept_text (kept words, one space between).

    A word goes if it is covered by a window of ``window`` words whose sequence also
    starts earlier: in a row with a smaller id, or with the same id at an earlier
    word.  Windows are judged on the input.  A null text has no words; texts with
    fewer words than a window keep all; a null id counts as the largest.  Rows that
    share an id count as one document, so repeated rows keep the same words.  Other
    columns pass through; one with the name of a new one is replaced.  ``most_cells``
    bounds the broadcast and changes no result.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))
    rows = docs.select(doc.alias("doc"), F.col(text_col).alias("text"))
    known = spark.sparkContext.broadcast(sketch(rows.select("text"), window, gram, most_cells))
    stay = _first_places(rows, known, window, gram)
    new = "_n_words long, _n_removed long, _spans array<struct<first:int,last:int>>, _kept_text string"
    fields = T._parse_datatype_string(new).fields
    keep = [c for c in docs.columns if c not in {f.name[1:] for f in fields}]
    # a text travels once, unless its column is replaced
    own = text_col if text_col in keep else "_raw"
    joined = docs.withColumns({"_doc": doc, **({} if own == text_col else {own: F.col(text_col)})}).join(stay, "_doc", "left")
    joined = joined.select(*keep, *[own] * (own not in keep), "_stay")
    at = joined.columns.index(own)
    out = joined.mapInArrow(_cut(known, len(keep), at, window, gram), T.StructType([*joined.select(*keep).schema.fields, *fields]))
    return out.select(*keep, *[F.col(f.name).alias(f.name[1:]) for f in fields])


def _first_places(rows: DataFrame, known, window: int, gram: int) -> DataFrame:
    """(_doc, _stay): of each document the windows that are estimated to repeat and are the first of their words, each named by its words and its place."""
    scratch = Scratch(rows.sparkSession, "windows")
    scratch.release()
    places = rows.mapInArrow(_candidates(known, window, gram), "k1 long, k2 long, doc long, start int")
    first = places.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start")).alias("f"))
    tag = F.col("k1").bitwiseXOR(F.shiftleft(F.col("f.start").cast("long"), 40))  # tells windows apart whatever rows share the id
    stay = scratch.save(first.groupBy(F.col("f.doc").alias("_doc")).agg(F.collect_list(tag).alias("_stay")), "stay")
    del places, first
    scratch.release()
    return stay
