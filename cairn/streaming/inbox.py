"""A queue of addresses drained into a collection, the entries and what became of them in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.sources import readers


def drain(entries: DataFrame, pages: DataFrame, table: str, left: str, checkpoint: str, available_now: bool = True, before_commit=None) -> StreamingQuery:
    """Entries of a stream (``schemas.INBOX``) whose page is in ``pages`` (url, html) to ``table``, the others to ``left``.

    Each micro-batch writes its part of both, under its number, before the checkpoint
    takes its entries off the queue.  A failure between leaves them on it; the batch
    comes again with the same entries and replaces what it had written, so none is
    lost and none is there twice.  Those in ``left`` can be put on the queue again.
    ``before_commit`` (batch number) is called after the writes, as a test needs it.
    """
    def apply(batch: DataFrame, number: int) -> None:
        rows = readers.inbox_rows(batch)
        known = pages.select("url", "html").dropDuplicates(["url"])
        met = rows.join(known, "url", "left")
        good = readers.page_head(met.where("html IS NOT NULL"))
        kept = good.where(F.coalesce("title", F.lit("")) != "").select("url", "title", F.col("description").alias("summary"), "source_name", "source_type", "authority", "published_at", "reason")
        lost = rows.join(kept.select("url").distinct(), "url", "left_anti")
        kept.write.mode("overwrite").parquet(f"{table}/batch={number}")
        lost.write.mode("overwrite").parquet(f"{left}/batch={number}")
        if before_commit is not None:
            before_commit(number)

    writer = entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
