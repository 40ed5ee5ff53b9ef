"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, one scan of each text.

Texts are normalised byte by byte (ASCII letters to lower case, every other ASCII
character that is not a digit to a space; runs of spaces to one), and the windows
of the benchmark, bounded by spaces, are the automaton's patterns.  A hit gives the
last word of a window; words of documents that are hit are mapped back to the
places of the original text.

The automaton is broadcast, so its patterns are measured first.  Above
``PATTERN_BYTES`` the benchmark is cut into parts that fit, long items between words
with as many words in common as a window needs.  A task then reads its texts once,
some megabytes at a time, takes them through one part after the other, and puts the
hits together before it goes on: nothing is shuffled, and no more than one part's
automaton is in memory.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 10
#: Bytes of normalised benchmark text in one automaton.
PATTERN_BYTES = 4 << 20
#: Bytes of documents that go through all parts together where there are several.
CHUNK_BYTES = 64 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Automaton:
    """The windows of some benchmark items, each with the items that hold it."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        holders: dict[bytes, tuple[int, set]] = {}
        for item, raw in items:
            words = words_of(raw)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                holders.setdefault(b" ".join(words[i : i + size]), (size, set()))[1].add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, (size, items_) in holders.items():
            self.machine.add_word(f" {pattern.decode('latin-1')} ", (size, frozenset(items_)))
        self.empty = not holders
        if holders:
            self.machine.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray, dict]:
        """(number of words, first and last word of each hit window in order, {item: hit windows})."""
        words = words_of(raw)
        if self.empty or not words:
            return len(words), np.array([], int), np.array([], int), {}
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, sizes, items = [], [], {}
        for end, (size, held) in self.machine.iter(line):
            ends.append(end)
            sizes.append(size)
            for item in held:
                items[item] = items.get(item, 0) + 1
        if not ends:
            return len(words), np.array([], int), np.array([], int), {}
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # of the space behind each word
        last = np.searchsorted(stops, np.array(ends))
        return len(words), last - np.array(sizes) + 1, last, items


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words, as (first, last)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _places(raw: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_TABLE))]
    return [{"start": len(raw[: at[a][0]].decode("utf-8", "replace")), "end": len(raw[: at[b][1]].decode("utf-8", "replace"))} for a, b in runs]


_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SCAN_DDL = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"

#: The automaton that this Python worker built last.
_built: dict[tuple, Automaton] = {}


class Parts:
    """The parts of a benchmark, each a broadcast of (item, text)."""

    def __init__(self, broadcasts: list, name: str, window: int):
        self.broadcasts, self.name, self.window = broadcasts, name, window

    def automata(self):
        """The automata one after the other; only the last one is kept."""
        for k, items in enumerate(self.broadcasts):
            key = (self.name, k, self.window)
            if key not in _built:
                _built.clear()
                _built[key] = Automaton(items.value, self.window)
            yield _built[key]

    def chunks(self, batches, column: int):
        """Batches in groups: of one part each by itself, of several as many as CHUNK_BYTES hold."""
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.column(column).nbytes
            if len(self.broadcasts) == 1 or size > CHUNK_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Of each text its number of words, its runs of hit words, and the items that hit it."""
        first: list[list] = [[] for _ in texts]
        last: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        count = [0] * len(texts)
        for machine in self.automata():
            for i, raw in enumerate(texts):
                count[i], a, b, held = machine.scan(raw)
                if len(a):
                    first[i].append(a)
                    last[i].append(b)
                    items[i].update(held)
        return [(n, _merged(np.concatenate(a), np.concatenate(b)) if a else [], x) for n, a, b, x in zip(count, first, last, items, strict=True)]


def _raw(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _scanner(parts: Parts, others: int, places: bool):
    def run(batches):
        for group in parts.chunks(batches, others):
            texts = [t for batch in group for t in _raw(batch.column(others))]
            found = iter(zip(texts, parts.scan(texts), strict=True))
            for batch in group:
                rows = [[], [], [], []]
                for _ in range(batch.num_rows):
                    raw, (n, runs, held) = next(found)
                    for column, value in zip(rows, (n, sum(b - a + 1 for a, b in runs), sorted(map(str, held)), _places(raw, runs) if places else None), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), _PLACES)
                yield pa.RecordBatch.from_arrays([*batch.columns[:others], *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=[*batch.schema.names[:others], "n_words", "n_hit", "items", "spans"])

    return run


def cut_item(raw: bytes, size: int, window: int) -> list[bytes]:
    """A text in pieces of about ``size`` bytes at most whose windows together are the text's own."""
    if len(raw) <= size:
        return [raw]
    words = words_of(raw)
    out, start, held = [], 0, 0
    for k, w in enumerate(words):
        held += len(w) + 1
        if held > size and k - start >= 2 * window:
            out.append(b" ".join(words[start : k + 1]))
            start = k + 2 - window
            held = sum(map(len, words[start : k + 1])) + window
    if len(words) - start >= window or not out:
        out.append(b" ".join(words[start:]))
    return out


def benchmark_parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, limit: int = PATTERN_BYTES) -> Parts:
    """The benchmark, brought over item by item and broadcast in parts of about ``limit`` bytes at most."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    context = benchmark.sparkSession.sparkContext
    broadcasts, part, size, name = [], [], 0, hashlib.sha256()
    for r in items.toLocalIterator():
        for piece in cut_item(r["text"].encode(), limit, window):
            if part and size + len(piece) > limit:
                broadcasts.append(context.broadcast(part))
                part, size = [], 0
            part.append((r["item"], piece))
            size += len(piece) + 16
            name.update(json.dumps([r["item"], piece.decode(errors="replace")]).encode())
    broadcasts.append(context.broadcast(part))
    return Parts(broadcasts, name.hexdigest(), window)


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, limit: int = PATTERN_BYTES, places: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (as strings, sorted), spans (character offsets in the text).

    A window is ``window`` consecutive words of an item, or all words of a shorter
    one; a document word inside any occurrence of a window is hit, and a span is a
    run of hit words.  Null texts have no words; items without words have no window;
    repeated items count once.  Repeated rows each come back with the same values.
    ``limit`` bounds memory and changes no result.  Without ``places`` no spans are
    looked for, and theirs are null.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanner(benchmark_parts(benchmark, item_col, item_text_col, window, limit), 1, places), f"doc_id {kind}, {SCAN_DDL}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int = PATTERN_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; columns stay as they are.

    One scan of the text in which every row is judged by itself.
    """
    return docs.mapInArrow(_cleaner(benchmark_parts(benchmark, "item_id", "text", window, limit), docs.columns.index(text_col)), docs.schema)


def _cleaner(parts: Parts, at: int):
    def run(batches):
        for group in parts.chunks(batches, at):
            texts = [t for batch in group for t in _raw(batch.column(at))]
            clean = iter([not runs for _, runs, _ in parts.scan(texts)])
            for batch in group:
                yield batch.filter(pa.array([next(clean) for _ in range(batch.num_rows)], pa.bool_()))

    return run
