"""All pairs of texts within a threshold, block by block: every two blocks of like lengths meet in one group of rows.

Where the threshold is low or the texts share a small alphabet, grams and characters
say little one by one, and pairs that share any are nearly all pairs.  Here nothing
is written for a pair that is out of the question: a group counts, for all pairs of
its two blocks at once, how many grams (or characters) both have, and hands on only
those pairs that have enough.  A block has so few rows that a group fits in memory
and its work is bounded, so more rows make more groups, not longer ones.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.edits import Edits

#: Rows of a block of characters and of one of texts, and the characters that all texts of a block have.
ROWS, FEW_ROWS, LENGTH = 16000, 32000, 2500000
#: Blocks are so small that there are so many groups for each core, if a group has as many rows and as much work (ns).
GROUPS, LEAST_ROWS, LEAST_WORK = 16, 32, 10**8
#: Pairs that are counted at once, numbers of a table of grams that are kept at once, and pairs gathered before they are compared.
AT_ONCE, NUMBERS, GATHERED = 1 << 20, 1 << 23, 1 << 18
#: Texts of either side that a choice of grams is tried with, and the pairs of a group from which that pays.
TRIED, MANY = 64, 1000000


def band(length: Column, threshold: float) -> Column:
    """A band of lengths: two in reach of one another are in the same or in neighbouring bands."""
    return length.cast("long") if threshold >= 1 else F.floor(F.log(length) / (-math.log(threshold) * 1.000001 + 1e-9))


def _codes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of all grams, where the second of equal grams of a text is another gram."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = at <= sizes[owner] - q
    code = np.zeros(len(flat), dtype=np.uint64)
    for d in range(q):
        code[: max(len(flat) - d, 0)] += flat[d:] * np.uint64(pow(0x9E3779B97F4A7C15, d + 1, 1 << 64))
    # 44 bits of a code tell grams apart, or hold some for one, behind the number of the text
    both = np.sort((owner[whole].astype(np.uint64) << np.uint64(44)) | ((code[whole] ^ (code[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)))
    places = np.arange(len(both))
    again = places - np.maximum.accumulate(np.where(np.append(True, both[1:] != both[:-1])[: len(both)], places, 0))
    mixed = (both & np.uint64((1 << 44) - 1)) + again.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return (both >> np.uint64(44)).astype(np.int64), (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class _Grams:
    """The cells of the grams of two sides' texts.

    The most frequent grams have a cell each and the rest share as many: where two
    fall together, a pair seems to have more in common than it has, never less.
    """

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray]], sizes: tuple[int, int], cells: int):
        codes = [(own >> np.uint64(44)).astype(np.int64) for _, own in sides]
        times = sum(np.bincount(own, minlength=1 << 20) for own in codes)
        cell = cells + np.arange(1 << 20) % cells
        often = np.argpartition(-times, cells)[:cells]
        cell[often] = np.arange(cells)
        self.width = 2 * cells
        self.sides = [(owner * self.width + cell[own], np.searchsorted(owner, np.arange(size + 1))) for (owner, _), own, size in zip(sides, codes, sizes, strict=True)]

    def rows(self, side: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of 0 and 1, the cells of the texts from ``begin`` to ``end``, and how many each has."""
        key, starts = self.sides[side]
        out = np.zeros((end - begin) * self.width, dtype=np.float32)
        out[key[starts[begin] : starts[end]] - begin * self.width] = 1
        out = out.reshape(-1, self.width)
        return out, out.sum(1)


class _Characters:
    """Rows of 0 and 1: which characters of all that occur each text has."""

    def __init__(self, texts: list[str]):
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters, self.cell = np.unique(flat, return_inverse=True)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.owner, self.starts, self.width = np.repeat(np.arange(len(texts)), sizes), np.append(0, np.cumsum(sizes)), max(len(letters), 1)

    def rows(self, begin: int, end: int) -> np.ndarray:
        here = slice(self.starts[begin], self.starts[end])
        out = np.zeros((end - begin, self.width), dtype=np.float32)
        out[self.owner[here] - begin, self.cell[here]] = 1
        return out


def _best(left: list[str], right: list[str], threshold: float) -> tuple[int, int]:
    """(q, cells) by which the texts are compared with the least work, as some of them tell: time to count, and to compare what is left."""
    least = 1 << min(max(math.ceil(math.log2(sum(map(len, right)) / len(right))), 7), 14)
    widths = (3, 4, 5) if threshold >= 0.75 else (2, 3, 4)
    if len(left) * len(right) < MANY:
        return widths[least > 512], 4 * least
    left, right = ([side[k] for k in np.unique(np.linspace(0, len(side) - 1, TRIED).astype(int))] for side in (left, right))
    n, m = (np.array([len(t) for t in side], dtype=np.float64) for side in (left, right))
    longer = np.maximum(n[:, None], m[None])
    most = np.floor(longer * (1 - threshold) + 1e-9)
    near = (np.abs(n[:, None] - m[None]) <= most) & (np.array(left, dtype=object)[:, None] != np.array(right, dtype=object)[None])
    found = []
    for q in widths:
        sides = [_codes(left, q), _codes(right, q)]
        for cells in (least, 4 * least, min(16 * least, 1 << 16)):
            grams = _Grams(sides, (len(left), len(right)), cells)
            (a, of_a), (b, of_b) = grams.rows(0, 0, len(left)), grams.rows(1, 0, len(right))
            lacks = np.maximum(of_a[:, None], of_b[None]) - a @ b.T
            columns = np.minimum(most / 0.66, np.maximum(most - lacks / q, 0) / (0.66 - 1 / q)) + 8
            work = np.where(near & (lacks <= q * most), 0.5 + columns * (most / 50 + 1.5) * 0.02, 0)
            found.append((float(work.mean()) + grams.width * 4e-5, q, cells))
    return min(found)[1:]


def _edit_pairs(left: list[str], right: list[str], threshold: float, alone: bool):
    """(rows, columns, edits) of the pairs within the threshold: k edits spoil at most q * k grams of either text.

    Texts stand in the order of their length.  The grams of a square of pairs are counted
    at once; what is left goes through the first columns of ``Edits``, and only what is
    near there is compared as a whole.
    """
    n, m = (np.array([len(t) for t in side], dtype=np.int64) for side in (left, right))
    allowed = lambda size: np.floor(size * (1 - threshold) + 1e-9)
    of_n, of_m = allowed(n), allowed(m)
    q, cells = _best(left, right, threshold)
    codes = _codes(left, q)
    grams = _Grams([codes, codes if alone else _codes(right, q)], (len(left), len(right)), cells)
    edits = Edits(left, right)
    step = max(min(math.isqrt(AT_ONCE), NUMBERS // grams.width), 1)
    held, size = [], 0

    def compared():
        u, v, most, lacks = (np.concatenate(c) for c in zip(*held, strict=True))
        for at in range(0, len(u), GATHERED):
            here = slice(at, at + GATHERED)
            good = edits.within(u[here], v[here], most[here], lacks[here], q)
            x, y = u[here][good], v[here][good]
            apart = edits.apart(x, y)
            good = apart <= most[here][good]
            yield x[good], y[good], apart[good]

    for r in range(0, len(left), step):
        rows = slice(r, r + step)
        a, of_a = grams.rows(0, r, min(r + step, len(left)))
        for c in range(r if alone else 0, len(right), step):
            columns = slice(c, c + step)
            if n[rows][0] - m[columns][-1] > of_n[rows].max() or m[columns][0] - n[rows][-1] > of_m[columns].max():
                continue
            b, of_b = (a, of_a) if alone and c == r else grams.rows(1, c, min(c + step, len(right)))
            common = a @ b.T
            good = common >= (of_a - q * np.maximum(of_n[rows], of_m[columns].max()) - 0.5).astype(np.float32)[:, None]
            good &= common >= (of_b - q * np.maximum(of_m[columns], of_n[rows].max()) - 0.5).astype(np.float32)[None]
            u, v = np.nonzero(good)
            both, x, y = common[u, v], of_a[u], of_b[v]
            u, v = u + r, v + c
            most = np.maximum(of_n[u], of_m[v])
            kept = (np.abs(n[u] - m[v]) <= most) & (both >= np.maximum(x, y) - q * most - 0.5)
            if alone:
                kept &= v > u
            u, v, most = u[kept], v[kept], most[kept].astype(np.int64)
            held.append((u, v, most, (y - both)[kept].astype(np.int64)))
            size += len(u)
            if size >= GATHERED:
                yield from compared()
                held, size = [], 0
    if held:
        yield from compared()


def _jaccard_pairs(left: list[str], right: list[str], threshold: float, alone: bool):
    """(rows, columns, common) of the pairs within the threshold or next to it, and how many characters they have in common."""
    sets = _Characters(left + right)
    step = max(min(math.isqrt(AT_ONCE), NUMBERS // sets.width), 1)
    for r in range(0, len(left), step):
        a = sets.rows(r, min(r + step, len(left)))
        of_a = a.sum(1)
        for c in range(r if alone else 0, len(right), step):
            b = sets.rows(len(left) + c, len(left) + min(c + step, len(right)))
            common = a @ b.T
            x, y = np.nonzero(common >= (of_a[:, None] + b.sum(1)[None]) * np.float32(threshold / (1 + threshold)) - np.float32(1e-3))
            both = common[x, y]
            if alone and c == r:
                x, y, both = x[y > x], y[y > x], both[y > x]
            yield x + r, y + c, both


def _meeting(kind: str, threshold: float):
    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        get = lambda c: table[c].to_numpy()
        sides = [np.flatnonzero((get("side") == s) & (get("band") == get(f"b{s}")) & (get("part") == get(f"p{s}"))) for s in (0, 1)]
        alone = not len(sides[1]) and (get("b0") == get("b1")).all() and (get("p0") == get("p1")).all() and not table["two"][0].as_py()
        if not table["two"][0].as_py():
            sides[1] = sides[0] if alone else np.flatnonzero((get("band") == get("b1")) & (get("part") == get("p1")))
        if not len(sides[0]) or not len(sides[1]):
            return
        length = get("length")
        sides = [side[np.argsort(length[side], kind="stable")] for side in sides]
        keys, ids = table["k"].combine_chunks(), table["i"].combine_chunks()
        left, right = ([t.decode("utf-8", "surrogateescape") for t in keys.take(pa.array(side)).cast(pa.binary()).to_pylist()] for side in sides)
        if kind == "edit":
            for x, y, edits in _edit_pairs(left, right, threshold, alone):
                a, b = sides[0][x], sides[1][y]
                rest = [pa.array(edits.astype(np.int32)), pa.array(np.maximum(length[a], length[b]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), *rest], names=["i", "j", "edits", "longer"])
        else:
            for x, y, common in _jaccard_pairs(left, right, threshold, alone):
                a, b = sides[0][x], sides[1][y]
                rest = [pa.array(common.astype(np.int32)), pa.array((length[a] + length[b]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), *rest], names=["i", "j", "common", "all"])

    return of_group


def _parts(rows: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(side, band, parts): how many blocks the texts of a band are dealt to.

    A row goes to all groups of its block, so blocks are as large as memory and the
    number of groups for all cores allow: what moves grows like the rows.
    """
    spark = rows.sparkSession
    bands = rows.groupBy("side", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length")).collect()
    lost = 1 - threshold

    def work(b) -> float:
        """Of all pairs of the band's texts."""
        each = 20 + b["length"] / 4 + (b["length"] * lost) ** 2 / 20 + b["length"] * lost * 2 if kind == "edit" else 1
        return each * b["n"] ** 2

    group = max(sum(map(work, bands)) / max(GROUPS * spark.sparkContext.defaultParallelism, 64), LEAST_WORK)
    found = []
    for b in bands:
        most = max(min(FEW_ROWS, int(LENGTH / b["length"])) if kind == "edit" else ROWS, LEAST_ROWS)
        parts = max(-(-b["n"] // most), min(math.ceil(math.sqrt(work(b) / group)), -(-b["n"] // LEAST_ROWS)))
        found.append((b["side"], b["band"], parts))
    return spark.createDataFrame(found, "side int, band long, parts int")


def candidates(rows: DataFrame, kind: str, threshold: float, two: bool = False) -> DataFrame:
    """Pairs of ``rows`` (i, k, length, side) within the threshold or next to it, each once: (i, j, edits, longer), or for characters (i, j, common, all).

    ``rows`` are read several times, so they should be written.  With ``two`` the rows of
    side 0 meet those of side 1, which are ``j``; without it all are of side 0 and
    meet one another, in no order of ``i`` and ``j``.
    """
    spark = rows.sparkSession
    rows = rows.where("length > 0").withColumn("band", band(F.col("length"), threshold))
    parts = _parts(rows, kind, threshold)
    near = rows.withColumn("other", 1 - F.col("side") if two else F.col("side"))
    of = lambda d: F.broadcast(parts.select(F.col("side").alias("other" if d is not None else "side"), (F.col("band") - (d or 0)).alias("band"), F.col("parts").alias("own" if d is None else f"near{d + 1}")))
    near = near.join(of(None), ["side", "band"]).withColumn("part", F.pmod(F.xxhash64("k"), F.col("own")).cast("int"))
    for d in (-1, 0, 1):
        near = near.join(of(d), ["other", "band"], "left")

    def group(b0, p0, b1, p1):
        return F.struct(b0.cast("long").alias("b0"), p0.cast("int").alias("p0"), b1.cast("long").alias("b1"), p1.cast("int").alias("p1"))

    def met(d: int) -> Column:
        me, part, there = F.col("band"), F.col("part"), F.col("band") + d
        if two:
            of_two = lambda p: F.when(F.col("side") == 0, group(me, part, there, p)).otherwise(group(there, p, me, part))
            one = of_two
        elif d == 0:
            one = lambda p: group(me, F.least(part, p), me, F.greatest(part, p))
        else:
            one = lambda p: group(me, part, there, p) if d > 0 else group(there, p, me, part)
        n = F.coalesce(F.col(f"near{d + 1}"), F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda p: p < n), one)

    dealt = near.select("i", "k", "length", "side", "band", "part", F.lit(two).alias("two"), F.inline(F.concat(met(-1), met(0), met(1))))
    keys = ["b0", "p0", "b1", "p1"]
    tasks = max(GROUPS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = rows.schema["i"].dataType.simpleString()
    schema = f"i {number}, j {number}, " + ("edits int, longer int" if kind == "edit" else "common int, all int")
    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_meeting(kind, threshold), schema)
