"""Written tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where none is set, a local session, as in tests, gets a temporary one; on a
    cluster that raises, as executors could not read what others wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="cairn-")
        _own[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


class Scratch:
    """Parquet tables of one job below the shared folder; the file system deletes them when the application ends."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/cairn/{job}-{uuid.uuid4().hex}"
        self.marked = False

    def save(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        """Write ``df`` once and read it back, so later steps never recompute it."""
        self.append(df, name, mode)
        return self.load(name, df.schema)

    def append(self, df: DataFrame, name: str, mode: str = "append") -> None:
        df.write.mode(mode).option("compression", "zstd").parquet(f"{self.root}/{name}")
        self._mark()

    def kept(self) -> str:
        """The folder of this job, for what writes its own tables; it goes like theirs."""
        self._mark()
        return self.root

    def _mark(self) -> None:
        if not self.marked:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            self.marked = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of what this job no longer refers to.

        A job of several written steps would otherwise hold the shuffles of all of
        them until the driver happens to collect its garbage.  What a plan that ran
        adaptively refers to is only let go by a second collection.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
