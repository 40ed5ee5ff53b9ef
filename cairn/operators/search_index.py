"""Substring search by posting lists of three-letter strings: candidates from the lists, verified in their texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cairn.operators.predicates import search

GRAM = 3
#: Folders that the lists are dealt to; a search reads those of its own grams only.
BUCKETS = 64
COLUMNS = ("title", "summary", "tags", "source_name")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, keys) of each batch of (key, texts): a list of the batch's rows for every string of three letters in them."""
    for batch in batches:
        rows: dict[str, list[int]] = {}
        for i, texts in enumerate(zip(*batch.columns[1:], strict=True)):
            grams: set[str] = set()
            for text in texts:
                t = text.as_py() or ""
                grams.update([t[k : k + GRAM] for k in range(len(t) - GRAM + 1)])
            for gram in grams:
                rows.setdefault(gram, []).append(i)
        offsets = np.cumsum([0, *map(len, rows.values())], dtype=np.int32)
        numbers = np.fromiter(chain.from_iterable(rows.values()), np.int64, int(offsets[-1]))
        keys = pa.ListArray.from_arrays(pa.array(offsets), batch.column(0).take(pa.array(numbers)))
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), keys], ["gram", "keys"])


class SearchIndex:
    """Posting lists of the lower-case texts of some columns, below ``path``.

    A text that holds a keyword holds each of its grams, so the items that are in all
    of their lists are the only candidates, and a look at their texts decides.  A list
    is made for each batch of rows before anything is shuffled.  Lists are dealt by gram to folders and sorted in their files, so a search reads a few
    row groups, whatever the size of the collection.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.key, self.columns, self.buckets = about["key"], tuple(about["columns"]), about["buckets"]

    @classmethod
    def create(cls, items: DataFrame, path: str, key: str = "id", columns: tuple[str, ...] = COLUMNS, buckets: int = BUCKETS) -> SearchIndex:
        """The index of the columns that ``items`` has, in place of one that is there; ``key`` tells its rows apart."""
        spark = items.sparkSession
        own = [c for c in columns if c in items.columns]
        spark.createDataFrame([(key, own, buckets)], "key string, columns array<string>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        texts = items.select(F.col(key).alias("key"), *[F.lower(F.col(c).cast("string")).alias(f"t{k}") for k, c in enumerate(own)])
        lists = texts.mapInArrow(_posted, T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(texts.schema["key"].dataType))]))
        dealt = lists.withColumn("bucket", _bucket(F.col("gram"), buckets)).repartition("bucket", "gram").sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
        return cls(spark, path)

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def candidates(self, keyword: str) -> DataFrame | None:
        """(key) of the items that are in the lists of all grams of a keyword; none where it is too short to have any."""
        k = keyword.strip().lower()
        grams = sorted({k[i : i + GRAM] for i in range(len(k) - GRAM + 1)})
        if not grams:
            return None
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram"), self.buckets).alias("bucket"))
        buckets = sorted({r["bucket"] for r in asked.collect()})  # of one keyword's grams
        lists = self._lists().where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        listed = lists.select("gram", F.explode("keys").alias(self.key))
        return listed.groupBy(self.key).agg(F.size(F.collect_set("gram")).alias("n")).where(F.col("n") == len(grams)).select(self.key)

    def search(self, items: DataFrame, keyword: str = "", category: str = "all") -> DataFrame:
        """What ``predicates.search`` finds in the indexed columns of ``items``; keywords of fewer than three letters scan them."""
        found = self.candidates(keyword)
        near = items if found is None else items.join(found, self.key, "left_semi")
        return search(near, keyword, category, self.columns)
