"""Micro-batches: items against a growing collection, and rollups over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import dedup


def ingest(stream: DataFrame, table: str, checkpoint: str, schema: str, text_col: str = "title", seq: str = "seq", threshold: float = 0.82, available_now: bool = True, index: str | None = None) -> StreamingQuery:
    """Append to a Parquet table the items that resemble none of it and none before them in their batch.

    The table's texts stand in a gram index beside it (``index``, by default the
    table's path with ``.grams`` behind), so a batch meets what resembles it and the
    table's own rows are not compared again.  A batch goes to a folder of its own
    number, in the table and in the index, which a batch that is run again replaces:
    a restart neither loses nor doubles items.  Where the index is missing, or behind
    the table, it is made anew from the table.
    """
    where = index or f"{table.rstrip('/')}.grams"

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = f"{schema}, batch long"
        known = _index(spark, where, table, rows, text_col, threshold, number)
        kept = dedup.greedy(batch, text_col, seq, "edit", threshold, existing=known, below=number + 1)
        kept.write.mode("overwrite").parquet(f"{table}/batch={number}")
        mine = spark.read.schema(rows).parquet(table).where(F.col("batch") == number)
        if known is None:
            dedup.GramIndex.create(mine, text_col, where, "edit", threshold, number + 1)
        else:
            known.add(mine, text_col, number + 1)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _index(spark: SparkSession, where: str, table: str, rows: str, text_col: str, threshold: float, number: int) -> dedup.GramIndex | None:
    """The index of the batches before ``number`` (addition k + 1 is batch k), none where there are none."""
    if not _has_rows(spark, table):
        return None
    before = spark.read.schema(rows).parquet(table).where(F.col("batch") < number)
    if before.isEmpty():
        return None
    if _has_rows(spark, f"{where}/about"):
        known = dedup.GramIndex(spark, where)
        newest = before.where(F.coalesce(F.col(text_col), F.lit("")) != "").agg(F.max("batch").alias("b")).first()["b"]
        if newest is None or not known.texts().where(F.col("part") >= newest + 1).isEmpty():
            return known
    return dedup.GramIndex.create(before, text_col, where, "edit", threshold, number)


def _has_rows(spark: SparkSession, table: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.parquet(table).isEmpty()
    except AnalysisException:
        return False


def daily_counts(stream: DataFrame, ts: str = "ts", by: str = "event_type", late: str = "21 days") -> DataFrame:
    """Rows and values per day and kind, for rows no later than the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("day.start").alias("day"), by, "n", "value")


def distinct_within(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "3 days") -> DataFrame:
    """First rows of each key; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
