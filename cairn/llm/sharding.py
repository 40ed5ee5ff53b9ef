"""Minimax contiguous partition of atomic groups into shards, in DataFrame operations only.

Rows with equal text are one atomic group.  Groups stand in the order of the SHA-256
of their text, with running sums of their sizes.  The least feasible shard capacity
is found by binary search, each capacity checked greedily: a shard takes groups
while they fit.  The running sums stay distributed: the search sees a bounded
summary of them, (least, greatest) per interval, and is refined only around the
places where the tried capacities cut, so a round brings at most a few thousand
rows to the driver whatever the size of the table.  Because groups are contiguous in the
order of their keys, a row's shard follows from its own key and the few keys where
the cuts are: no join, and no skew from a group however large.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.llm.scratch import Scratch

#: Intervals of one summary.
INTERVALS = 4096
#: Capacities for which one round settles the places of the cuts.
TRIED = 48
#: Groups in one file of running sums.
ROWS = 500_000
#: The last shard may be this much smaller than the capacity before the cuts are evened out.
SLACK = 0.02


class _Summary:
    """What is known of a distributed ascending list: cells (low, high, number) with values at both ends."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.low = [c[0] for c in self.cells]

    def cell(self, x: int) -> tuple[int, int, int] | None:
        i = bisect_right(self.low, x) - 1
        return self.cells[i] if i >= 0 else None

    def last_up_to(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest value not above x (0 counts as a value)."""
        c = self.cell(x)
        if c is None:
            return 0, 0
        return (c[1], c[1]) if c[1] <= x else (c[0], min(c[1] - 1, x))


def _greedy(summary: _Summary, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Bounds of the place that greedy filling reaches after each shard."""
    low = high = 0
    out = []
    for _ in range(shards):
        low, high = summary.last_up_to(low + capacity)[0], summary.last_up_to(high + capacity)[1]
        out.append((low, high))
    return out


def _unclear(summary: _Summary, capacity: int, shards: int) -> set[tuple[int, int, int]]:
    """The cells inside which greedy filling looks for a place, and finds only bounds."""
    starts = [(0, 0), *_greedy(summary, capacity, shards)[:-1]]
    seen = {summary.cell(x + capacity) for pair in starts for x in pair} - {None}
    return {c for c in seen if c[0] < c[1]}


def _first(lo: int, hi: int, holds) -> int:
    """The least x in (lo, hi] for which a monotone condition holds; it holds for hi."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(mid) else (mid, hi)
    return hi


class _Cells:
    """The distributed list with the number of each value's cell, refined round by round.

    A refinement is a hash join with the few cells that are divided.
    """

    def __init__(self, ends: DataFrame, total: int):
        step = -(-(total + 1) // INTERVALS)
        self.rows = ends.select("end", F.floor(F.col("end") / F.lit(step)).cast("long").alias("cell"))
        self.next = INTERVALS
        self.summary = _Summary(self._bounds(self.rows))

    def _bounds(self, rows: DataFrame) -> list[tuple[int, int, int]]:
        return [(r["a"], r["b"], r["cell"]) for r in rows.groupBy("cell").agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()]

    def divide(self, cells: set[tuple[int, int, int]]) -> None:
        parts = max(4, INTERVALS // len(cells))
        plan, new = [], self.next
        for low, high, number in cells:
            step = -(-(high - low + 1) // parts)
            plan.append((number, low, step, self.next))
            self.next += (high - low) // step + 1
        known = self.rows.sparkSession.createDataFrame(plan, "cell long, low long, step long, first long")
        finer = F.col("first") + F.floor((F.col("end") - F.col("low")) / F.col("step")).cast("long")
        self.rows = self.rows.join(F.broadcast(known), "cell", "left").select("end", F.coalesce(finer, "cell").alias("cell"))
        self.summary = _Summary([c for c in self.summary.cells if c not in cells] + self._bounds(self.rows.where(F.col("cell") >= new)))


def least_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity at which greedy filling needs no more than ``shards`` shards, and where it cuts.

    ``ends`` has one long column, end: the running sums of the group sizes.
    """
    cells = _Cells(ends, total)
    while True:
        s = cells.summary
        floor = max(-(-total // shards), largest) - 1
        sure = _first(floor, total, lambda c: _greedy(s, c, shards)[-1][0] >= total)
        maybe = _first(floor, total, lambda c: _greedy(s, c, shards)[-1][1] >= total)
        if sure == maybe:
            return sure, [low for low, _ in _greedy(s, sure, shards)]
        tried = {maybe + (sure - maybe) * i // TRIED for i in range(TRIED)} | {sure}
        cells.divide(set().union(*(_unclear(s, c, shards) for c in tried)))


def _around(ends: DataFrame, x: int) -> tuple[int, int | None]:
    """The greatest running sum up to x (or 0) and the least from x on (or None)."""
    r = ends.agg(F.max(F.when(F.col("end") <= x, F.col("end"))).alias("a"), F.min(F.when(F.col("end") >= x, F.col("end"))).alias("b")).first()
    return r["a"] or 0, r["b"]


def even_cuts(ends: DataFrame, total: int, capacity: int, shards: int) -> list[int]:
    """Where the shards end: no shard above ``capacity``, each as near as can be to an equal part of the rest."""
    behind = [total] * shards  # the least place from which the later shards can still take the rest
    for j in range(shards - 2, -1, -1):
        want = behind[j + 1] - capacity
        behind[j] = 0 if want <= 0 else _around(ends, want)[1]
    cuts, start = [], 0
    for j in range(shards - 1):
        ideal = start + (total - start) // (shards - j)
        a, b = _around(ends, ideal)
        place = b if b is not None and b <= start + capacity and b - ideal < ideal - a else a
        start = max(place, behind[j], start)
        cuts.append(start)
    return [*cuts, total]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key.

    The law is ``bytes``: the largest shard is as small as contiguous whole groups
    allow.  Size: UTF-8 bytes of the text plus 1; a null text counts as none and is
    of one group with empty texts.  Slots count the rows of a shard from 0 without
    gaps.  Repeated rows and null ids each keep their own slot.  An empty table
    gives an empty result; ``grown_shard`` is null under this law.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("bucket", (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    groups = scratch.save(groups, "groups")
    whole = groups.groupBy("bucket").agg(F.sum("bytes").alias("in_bucket"), F.max("bytes").alias("largest"))
    before = whole.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"))  # at most ``buckets`` rows
    within = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
    ends = groups.join(F.broadcast(before), "bucket").select("key", (F.col("before") + within).alias("end"))
    # the search scans this table some tens of times: no more files than its rows need
    ends = scratch.save(ends.repartition(-(-groups.count() // ROWS) or 1), "ends")
    known = whole.agg(F.sum("in_bucket").alias("total"), F.max("largest").alias("largest")).first()
    shard = F.lit(0)
    if known["total"]:
        capacity, cuts = least_capacity(ends.select("end"), known["total"], known["largest"], shards)
        if len(cuts) > 1 and cuts[-1] - cuts[-2] < (1 - SLACK) * capacity:
            cuts = even_cuts(ends.select("end"), known["total"], capacity, shards)
        last = {r["end"]: r["key"] for r in ends.where(F.col("end").isin(cuts)).collect()}
        for cut in cuts[:-1]:
            shard = shard + (F.col("key") > F.lit(bytes(last[cut])) if cut else F.lit(True)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets // 2)).cast("int"))
    parts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # at most shards * buckets / 2 rows
    running = F.sum("n").over(Window.orderBy("shard", "part")) - F.col("n")
    parts = parts.select("shard", "part", running.alias("first"))
    parts = parts.withColumn("first", F.col("first") - F.min("first").over(Window.partitionBy("shard")))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    return placed.join(F.broadcast(parts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lower(F.hex("key")).alias("group_key")
    )
