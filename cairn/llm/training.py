"""What the learned operators share: which labelled rows they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The greatest number of labelled documents that a model is fitted on; the least hashes are taken.
TRAINING_ROWS = 20000
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for judging: CRC32 of the id as text, modulo 5, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled texts outside the held-out fold.

    ``labels`` has the ids as doc_id; labels other than 0 and 1, and ids that are not
    in ``docs``, count as none, and of contradicting labels of one id the greater
    counts.  Of copies and near copies, told by the least hash of their three-word
    shingles, one counts, that of the least id with its own label, so that a
    group of them teaches no more than a text of its own.  Which rows are taken
    depends on hashes only.
    """
    own = labels.where(~held_out() & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    own = own.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "_id")
    texts = texts.withColumn("_w", F.transform(F.split("text", r"\s+"), lambda w: F.xxhash64(w)))
    for _ in range(2):
        n = F.greatest(F.size("_w") - 1, F.lit(0))
        texts = texts.withColumn("_w", F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.xxhash64(a, b)))
    least = F.coalesce(F.array_min("_w"), F.xxhash64("text")).alias("_h")
    return texts.groupBy(least).agg(F.min_by(F.struct("text", "label"), F.struct("_id", "text")).alias("_r")).select("_r.text", "_r.label")
