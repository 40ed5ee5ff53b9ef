"""SimHash fingerprints and their near-duplicate classes by covering locality-sensitive hashing.

For radius r, 2**(r+1) - 1 bit masks are built from one map of the 64 bits to vectors
of r+1 bits: mask v keeps the bits whose vector has an odd product with v.  Any r
differing bits leave some mask untouched, so every pair within the radius agrees
under some mask: no pair is missed.  A bucket (mask, kept bits) is never expanded
into pairs: its members are compared in blocks where they are, and only a spanning
forest of its links leaves the task.  A bucket above ``LIMIT`` members is dealt out
again, with all its pairs still covered, by masks over the bits that are not kept yet,
and so on: each deal keeps half of the free bits, and a bucket with ``FEW`` free bits
has 2 ** FEW members at most, as exact copies collapse before any of this.  So no
bucket that a task compares is above the greater of LIMIT and 2 ** FEW.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cairn.llm.components import connected
from cairn.llm.scratch import Scratch

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a bucket above which it is dealt out again, unless it has no more than FEW free bits.
LIMIT, FEW = 4096, 12


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; ASCII letters count as lower case; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    view = memoryview(line)
    digest = xxhash.xxh64_intdigest
    pairs = zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(view[a:b], SEED) for a, b in pairs), np.uint64, len(words) - shingle + 1)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(others: int):
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(others)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:others], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:others], "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long; null and wordless texts have 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(2), "doc_id long, text_hash long, fp long")


def covering_masks(radius: int, bits: list[int]) -> np.ndarray:
    """Masks over ``bits`` under one of which any two values agree that differ in ``radius`` of them or fewer.

    The vectors are taken from the last one down: of few bits they are an affine part
    of the space, so every mask keeps about half of them or more.
    """
    vector = {b: (2 << radius) - 1 - i % (2 << radius) for i, b in enumerate(bits)}
    masks = [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, 2 << radius)]
    return np.array(masks, np.uint64)


def _deal(radius: int):
    """(kept, fp) to (kept, key, fp): a fingerprint under every mask over the bits that are not kept yet."""
    known: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            kept = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in np.unique(kept).tolist():
                if k not in known:
                    known[k] = covering_masks(radius, [b for b in range(64) if not k >> b & 1])
                own = fp[kept == k]
                for mask in known[k] | np.uint64(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mask).view(np.int64)), pa.array((own & mask).view(np.int64)), pa.array(own.view(np.int64))], names=["kept", "key", "fp"])

    return run


def forest(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within ``radius`` bits among distinct fingerprints, as (from, to) arrays."""
    out = []
    rest = fp
    while len(rest) > 1:
        queue, rest = rest[:1], rest[1:]
        while len(queue) and len(rest):
            block, queue = queue[:64], queue[64:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                found = rest[hit]
                out.append((block[near.argmax(axis=0)[hit]], found))
                queue, rest = np.concatenate([queue, found]), rest[~hit]
    return out


def _links(radius: int):
    """Buckets, sorted by kept bits and key, to the links of their spanning forests."""
    def emit(kept, key, fp):
        same = np.zeros(len(fp), bool)
        same[1:] = (kept[1:] == kept[:-1]) & (key[1:] == key[:-1])
        first = np.flatnonzero(~same)
        n = np.diff(np.append(first, len(fp)))
        pairs = first[n == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius
        out = [(fp[pairs[near]], fp[pairs[near] + 1])]
        for i, k in zip(first[n > 2].tolist(), n[n > 2].tolist(), strict=True):
            out += forest(fp[i : i + k], radius)
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield emit(*[x[:cut] for x in now])
        if rest is not None and len(rest[0]):
            yield emit(*rest)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join exactly the classes that all links within ``radius`` join; ``fps`` holds distinct fingerprints.

    Only buckets of two or more members go on from the grouping.  A deal of 31 masks
    halves the free bits, so from 64 bits three deals reach FEW of them at the latest.
    """
    schema = "kept long, key long, fp long"
    scratch = Scratch(fps.sparkSession, "simhash-large")
    rest, out = fps.select(F.lit(0).cast("long").alias("kept"), "fp"), None
    for round_ in range(64):
        dealt = rest.mapInArrow(_deal(radius), schema)
        if round_:  # two ways to the same bits are one bucket
            dealt = dealt.distinct()
        large = dealt.groupBy("kept", "key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > LIMIT) & (64 - F.bit_count("kept") > FEW)).select("kept", "key")
        large = scratch.save(large, f"large-{round_}")
        more = not large.isEmpty()
        part = dealt.join(large, ["kept", "key"], "left_anti") if more else dealt
        found = part.repartition("kept", "key").sortWithinPartitions("kept", "key").mapInArrow(_links(radius), "u long, v long")
        out = found if out is None else out.union(found)
        if not more:
            return out.distinct()
        rest = scratch.save(dealt.join(large, ["kept", "key"], "left_semi").select("kept", "fp"), f"rest-{round_}")
    raise AssertionError("a deal of masks kept no further bit")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id, text_hash.

    Fingerprints within ``radius`` bits link; component_id is the least doc_id that
    can be reached over links, itself included.  Texts without words have
    fingerprint zero and link like any other.  Repeated rows each come back; a null
    doc_id is never the least unless its class has no other.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col), "rows")
    kinds = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    links = scratch.save(near_links(kinds, radius), "links")
    scratch.release()
    labels = connected(links, scratch)  # fp, label: only of fingerprints with a link
    known = kinds.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = known.select("fp", "label").join(least, "label").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the least id; columns stay as they are.

    Of equal rows with the least id one stays.  Rows of one id with different texts
    are told apart by a hash of the text.  Rows without an id cannot be told apart
    and stay.
    """
    classes = Scratch(docs.sparkSession, "classes").save(near_duplicates(docs, id_col, text_col, radius).select("doc_id", "text_hash", "component_id"), "rows")
    gone = classes.where("doc_id != component_id").select("doc_id", "text_hash").distinct()
    kept = docs.join(gone, (docs[id_col] == gone["doc_id"]) & (F.xxhash64(docs[text_col]) == gone["text_hash"]), "left_anti").select(*docs.columns)
    if classes.where("doc_id = component_id").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(kept.where(F.col(id_col).isNull()))
