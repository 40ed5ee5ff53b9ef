"""Order, numbering, quotas, caps, pages and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cairn.functions.dates import format_date
from cairn.scratch import Scratch


#: Rows and bytes of a range that is sorted in one task.
RANGE_ROWS, RANGE_BYTES = 1 << 20, 64 << 20


def _bytes(rows: DataFrame) -> Column:
    """About what a row takes: its texts, and eight bytes for every other value."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    size = lambda f: F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(f.name)) if isinstance(f.dataType, nested) else F.lit(None)
    return reduce(lambda a, b: a + b, [8 + F.coalesce(size(f), F.lit(0)) for f in rows.schema], F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str = "id", parts: int | None = None) -> DataFrame:
    """Dense numbers from 1 in an order, without bringing the rows into one task.

    Rows are dealt to ranges of the order, as many as ``RANGE_ROWS`` or ``RANGE_BYTES`` ask for; the
    ranges' sizes, one row each, give each range its first number.  The dealt rows are
    written, as ranges come from a sample and must not be drawn twice.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    rows = scratch.save(rows, "rows")  # counted, drawn from and dealt, but computed once
    if parts is None:
        n, size = rows.agg(F.count(F.lit(1)), F.sum(_bytes(rows))).first()
        parts = max(1, -(-n // RANGE_ROWS), -(-(size or 0) // RANGE_BYTES))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    within = scratch.save(ranged.withColumn("_n", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranged")
    sizes = within.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    first = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_first"))
    return within.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_n") + 1).drop("_part", "_n", "_first")


def first_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "_rn") -> DataFrame:
    """The first ``n`` rows of each group with their rank; ranked tops are cut before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def quota(rows: DataFrame, by: str, score: str, seq: str, least: int = 3, most: int = 15, target: int = 30) -> DataFrame:
    """``least`` of every group, then by score up to ``target`` in all with ``most`` of a group at most.

    The first round is not cut at the target.  At most ``most`` rows of each group go
    on from the ranking, and of the fill no more than ``target``.
    """
    order = [F.desc(score), F.col(seq)]
    ranked = first_per_group(rows, [by], order, most)
    sure = ranked.where(F.col("_rn") <= least)
    fill = ranked.where(F.col("_rn") > least).orderBy(*order).limit(target)
    fill = fill.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    n = sure.limit(target).agg(F.count(F.lit(1)).alias("_sure"))
    fill = fill.join(F.broadcast(n)).where(F.col("_place") <= F.lit(target) - F.col("_sure"))
    return sure.drop("_rn").unionByName(fill.drop("_rn", "_place", "_sure"))


def capped(rows: DataFrame, caps: list[tuple[Column, int]], order: list[Column]) -> DataFrame:
    """Of each section (condition, cap) the first rows in order, sections one after the other: column section."""
    out = None
    for k, (condition, cap) in enumerate(caps):
        part = rows.where(condition).orderBy(*order).limit(cap).withColumn("section", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def newest(rows: DataFrame, published: str = "published_at", seq: str = "seq") -> DataFrame:
    """By time as text, latest first, else as they came."""
    return rows.orderBy(F.desc_nulls_last(published), F.col(seq))


def featured(rows: DataFrame, ts: str, score: str, seq: str, least: float = 60) -> DataFrame:
    return rows.where(F.col(score) >= least).orderBy(F.desc(ts), F.desc(score), F.col(seq))


def hot_topics(rows: DataFrame, ts: str, score: str, seq: str, n: int = 5) -> DataFrame:
    """The first of the featured order."""
    return featured(rows, ts, score, seq).limit(n)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """Rows of a page; a page beyond the last is the last."""
    total = rows.count()
    last = max(1, -(-total // size))
    return rows.orderBy(*order).offset((min(number, last) - 1) * size).limit(size)


def display_rank(rows: DataFrame, category_order: list[str], category: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Running numbers across categories in a fixed order of theirs."""
    place = F.array_position(F.array(*[F.lit(c) for c in category_order]), F.col(category))
    return numbered(rows.withColumn("_cat", F.when(place > 0, place).otherwise(len(category_order) + 1)), [F.col("_cat"), *order], name).drop("_cat")


def grouped(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Values of each group as a list in order; a group is one output row."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_l")).select(by, F.transform("_l", lambda x: x[value]).alias("items"))


def by_date_label(rows: DataFrame, ts: str, as_of: Column, order: list[Column]) -> DataFrame:
    """``rows`` with label (the day's, as a reader sees it), group (the label's place by its first row) and place (in the whole order).

    Rows of one label stand together where the first of them stands, so those of the
    same day of another year join its group.
    """
    placed = numbered(rows.withColumn("label", format_date(F.col(ts), as_of)), order, "_at")
    first = placed.groupBy("label").agg(F.min("_at").alias("_lead"))  # as many rows as a year has days
    first = first.withColumn("group", F.row_number().over(Window.orderBy("_lead")))
    placed = placed.join(F.broadcast(first), placed["label"].eqNullSafe(first["label"])).drop(first["label"])
    return numbered(placed, [F.col("group"), F.col("_at")], "place").drop("_at", "_lead")


def reports_by_layer(reports: DataFrame, topic: str = "all", layers: tuple[str, ...] = ("reinsurance", "consulting", "domestic"), seq: str = "seq", name: str | None = None) -> DataFrame:
    """Reports of a topic, layers in their order, others last; with ``name``, a column of their numbers in it."""
    place = F.array_position(F.array(*[F.lit(x) for x in layers]), F.coalesce("layer", F.lit("")))
    rows = reports if topic == "all" else reports.where(F.col("topic") == topic)
    order = [F.when(place > 0, place).otherwise(len(layers) + 1), F.col(seq)]
    return numbered(rows, order, name) if name else rows.orderBy(*order)
