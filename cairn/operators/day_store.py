"""Daily records kept up to date: mergeable counts per day, of which a batch rewrites only the days it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn import lexicon as L
from cairn.operators.rollup import by_day
from cairn.scratch import Scratch

#: kind is ``category`` or ``source``; batch is the newest batch that a row counts.
SCHEMA = "kind string, name string, batch long, n long, curated long, highlights long, score_sum decimal(20,4), day string"
_SUMS = ("n", "curated", "highlights", "score_sum")


class DayStore:
    """Counts by day and category, and by day and source, in a Parquet table partitioned by day.

    Counts add up, so records are the same whatever batches the items came in and in
    whatever order.  Of each day the store has the sums of all batches, and those of
    the newest apart; a batch that is applied again, as after a failure, replaces its
    own part and counts once.  A day's partition is replaced as a whole, and the
    partitions of other days are neither read nor written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def add(self, items: DataFrame, batch: int, published: str = "published_at", score: str = "ai_score", curated: Column | None = None, highlight: float = 80, default: str = L.DEFAULT_CATEGORY) -> None:
        """Count ``items`` as batch ``batch``; batches have numbers of their own, and only the newest of a day may be applied again."""
        scratch = Scratch(self.spark, "days")
        source = F.struct(F.lit("source").alias("kind"), F.coalesce("source_name", F.lit("")).alias("name"))
        category = F.struct(F.lit("category").alias("kind"), F.coalesce("category", F.lit(default)).alias("name"))
        counted = items.withColumn("_is", F.explode(F.array(category, source)))
        counted = counted.where("_is.kind = 'category' OR _is.name != ''")
        # one pass over the items: the key of the rollup is what each is counted under
        keyed = counted.withColumn("category", F.concat_ws("\x00", "_is.kind", "_is.name"))
        parts = by_day(keyed, published, score, curated, highlight, default)
        cut = F.split("category", "\x00", 2)
        new = parts.select(cut[0].alias("kind"), cut[1].alias("name"), F.lit(batch).cast("long").alias("batch"), *[F.col(c).cast("decimal(20,4)" if c == "score_sum" else "long") for c in _SUMS], "day")
        new = scratch.save(new, "new")
        touched = [r["day"] for r in new.select("day").distinct().collect()]  # the days of one batch; they name the partitions to read
        if not touched:
            return
        was = self.rows().where(F.col("day").isin(touched) & (F.col("batch") != batch))
        both = was.unionByName(new).withColumn("batch", F.when(F.col("batch") >= batch, F.col("batch")).otherwise(F.lit(-1)))
        summed = both.groupBy("kind", "name", "batch", "day").agg(*[F.sum(c).alias(c) for c in _SUMS])
        out = scratch.save(summed.select("kind", "name", "batch", "n", "curated", "highlights", F.col("score_sum").cast("decimal(20,4)").alias("score_sum"), "day"), "out")
        out.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def days(self) -> DataFrame:
        """The records of all days, as ``rollup.days`` has them: a few rows a day are read."""
        rows = self.rows()
        names = rows.groupBy("day", "kind", "name").agg(*[F.sum(c).alias(c) for c in _SUMS])
        category, source = F.col("kind") == "category", F.when(F.col("kind") == "source", F.col("name"))
        total = lambda c: F.sum(F.when(category, F.col(c)))
        return names.groupBy("day").agg(
            total("n").alias("total"), total("curated").alias("curated"), total("highlights").alias("highlights"), F.round(total("score_sum").cast("decimal(20,4)") / total("n"), 1).cast("decimal(6,1)").alias("avg_score"),
            F.map_from_entries(F.sort_array(F.collect_list(F.when(category, F.struct("name", "n"))))).alias("categories"), F.sort_array(F.collect_list(source)).alias("sources"),
        )


def keep_days(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, **how) -> StreamingQuery:
    """Apply each micro-batch of items to the store at ``path``; one that is run again counts once."""
    def apply(batch: DataFrame, number: int) -> None:
        DayStore(batch.sparkSession, path).add(batch, number, **how)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
