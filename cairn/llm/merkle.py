"""Merkle manifest of a data set: a root over all rows, and a proof of each.

Every row is a leaf, the leaves of a group ascend by id.  Exact ranks come without
a sort of the whole: ids are read as digits, rows are counted by the id without its
lowest digit, these counts are added up digit by digit to the top, and running sums
among the children of one prefix, carried down again, give the rank at which each
lowest prefix begins; only rows of one such prefix are ordered together.

The rank's own digits, in the base of the tree's fan-out, are the path in a trie: rows
whose ranks share all but the lowest ``BLOCK_DIGITS`` digits are one block, which is
reduced by its longest prefixes first; the tops of blocks are the leaves of the next
level of blocks, and so on to the group's root.  Group roots, ordered by their key,
are reduced in the same way.  On the way back each block hands its members the
digests beside their path, so a row's proof meets its leaf with one join a level of
blocks.  Nothing but a group's key, number of rows and digest ever stands in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm.scratch import Scratch

FANOUT = 8
#: Digits of a rank inside one block: a block has FANOUT ** BLOCK_DIGITS members at most.
BLOCK_DIGITS = 3
#: Bits of an id's lowest digit and of the others; rows of one lowest prefix have as many different ids at most as the lowest digit has values.
LOWEST_BITS, DIGIT_BITS = 8, 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-``."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_ranks(rows: DataFrame, group: str, id_col: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by id, null first, then ``order``) within each group, and ``size``, the group's rows."""
    # an order-preserving number: the sign bit turned
    prefix = lambda bits: F.coalesce(F.shiftright(F.col(id_col).cast("long"), bits), F.lit(-1 << 63))
    keyed = rows.withColumn("_p0", prefix(LOWEST_BITS))
    counts = [scratch.save(keyed.groupBy(group, F.col("_p0").alias("p")).agg(F.count(F.lit(1)).alias("n")), "counts-0")]
    null = F.col("p") == -1 << 63
    for level in range((64 - LOWEST_BITS) // DIGIT_BITS):
        up = counts[-1].groupBy(group, F.when(null, F.col("p")).otherwise(F.shiftright("p", DIGIT_BITS)).alias("p")).agg(F.sum("n").alias("n"))
        counts.append(scratch.save(up, f"counts-{level + 1}"))
    # the top: the signs and null are at most three prefixes of each group
    first = counts[-1].select(group, "p", (F.sum("n").over(Window.partitionBy(group).orderBy("p")) - F.col("n")).alias("first"))
    for below in counts[-2::-1]:
        parent = F.when(null, F.col("p")).otherwise(F.shiftright("p", DIGIT_BITS))
        inside = below.withColumn("_up", parent)
        inside = inside.withColumn("_before", F.sum("n").over(Window.partitionBy(group, "_up").orderBy("p")) - F.col("n"))
        up = first.select(F.col(group).alias("_group"), F.col("p").alias("_up"), "first")
        same = inside[group].eqNullSafe(up["_group"]) & (inside["_up"] == up["_up"])
        first = inside.join(up, same).select(inside[group], inside["p"], (F.col("first") + F.col("_before")).alias("first"))
    sizes = counts[-1].groupBy(F.col(group).alias("_group")).agg(F.sum("n").alias("size"))
    first = first.join(F.broadcast(sizes), first[group].eqNullSafe(sizes["_group"])).select(F.col(group).alias("_group"), F.col("p").alias("_p0"), "first", "size")
    first = scratch.save(first, "first")
    at = keyed.join(first, keyed[group].eqNullSafe(first["_group"]) & (keyed["_p0"] == first["_p0"])).drop(first["_p0"]).drop("_group")
    rank = F.col("first") + F.row_number().over(Window.partitionBy(group, "_p0").orderBy(F.col(id_col).asc_nulls_first(), *order)) - 1
    return at.withColumn("rank", rank.cast("long")).drop("first", "_p0")


def _run_digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], fanout: int, most: int) -> list[list[str]]:
    """The nodes of a block level by level: until one is left, and no more than ``most`` times."""
    out = [nodes]
    while len(out) <= most:
        out.append([_run_digest(out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def _height(size: int, fanout: int) -> int:
    """How often ``size`` nodes are reduced until one is left."""
    height = 0
    while size > 1:
        size, height = -(-size // fanout), height + 1
    return height


def _tops(fanout: int, digits: int):
    """(group, block, size, nodes) to the digest that a block's members come to."""

    def run(batches):
        for batch in batches:
            tops = [_levels(nodes, fanout, min(digits, _height(size, fanout)))[-1][0] for size, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops)], names=["group", "block", "size", "node"])

    return run


def _paths(levels: list[list[str]], fanout: int) -> list[list[tuple[str, str]]]:
    """Of every member the siblings to its left and right, level by level, each joined to one string."""
    out = []
    for k in range(len(levels[0])):
        path, at = [], k
        for level in levels[:-1]:
            first = at - at % fanout
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
            at //= fanout
        out.append(path)
    return out


def _beside(fanout: int, digits: int):
    """Blocks to one row per member: (group, rank, path), the path ending in that of the block."""

    def run(batches):
        for batch in batches:
            for group, block, size, nodes, upper in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                paths = _paths(_levels(nodes, fanout, min(digits, _height(size, fanout))), fanout)
                path = [[{"left": a, "right": b} for a, b in p] + (upper or []) for p in paths]
                first = block * fanout**digits
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(path), pa.string()), pa.array(range(first, first + len(path)), pa.int64()), pa.array(path, _PATH)], names=["group", "rank", "path"])

    return run


def _verified(fanout: int, digits: int, kind: pa.DataType, with_path: bool):
    """Lowest blocks to one row per leaf: what its changed digest and its siblings lead to, and the digest of the siblings."""
    names = ["doc_id", "group", "rank", "leaf", "subroot", "root", "folded_root", "proof_sha256", *["path"] * with_path]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                group, block, size, subroot, root, upper = (batch.column(c)[k].as_py() for c in ("group", "block", "size", "subroot", "root", "upper"))
                members = batch.column("members").slice(k, 1).flatten()
                nodes, given = members.field("node").to_pylist(), members.field("given").to_pylist()
                upper = [(x["left"], x["right"]) for x in upper]
                roots, proofs, paths = [], [], []
                for node, path in zip(given, _paths(_levels(nodes, fanout, min(digits, _height(size, fanout))), fanout), strict=True):
                    proof = hashlib.sha256()
                    for left, right in path + upper:
                        node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
                        proof.update(f"{left}{right}".encode())
                    roots.append(node)
                    proofs.append(proof.hexdigest())
                    if with_path:
                        paths.append([{"left": a, "right": b} for a, b in path + upper])
                n, first = len(nodes), block * fanout**digits
                columns = [members.field("doc_id").cast(kind), pa.array([group] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), members.field("node"), pa.array([subroot] * n), pa.array([root] * n), pa.array(roots), pa.array(proofs)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(paths, _PATH)] * with_path], names=names)

    return run


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
PATH_DDL = "array<struct<left:string,right:string>>"


def _blocks(members: DataFrame, columns: list[str], fanout: int, digits: int) -> DataFrame:
    """(group, block, size, nodes or members in the order of their ranks): fanout ** digits of them at most."""
    block = F.floor(F.col("rank") / fanout**digits).cast("long").alias("block")
    listed = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    return members.groupBy("group", block, "size").agg(listed.alias("members"))


def _upward(tops: DataFrame, scratch: Scratch, name: str, fanout: int, digits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(group, node) of what is left in the end, and the blocks of every level of blocks, of (group, rank, size, node)."""
    steps = []
    while not tops.where("size > 1").isEmpty():
        blocks = _blocks(tops, ["node"], fanout, digits)
        blocks = scratch.save(blocks.select("group", "block", "size", F.col("members.node").alias("nodes")), f"{name}-blocks-{len(steps)}")
        steps.append(blocks)
        tops = scratch.save(_reduced(blocks, fanout, digits), f"{name}-tops-{len(steps)}")
    return tops.select("group", "node"), steps


def _reduced(blocks: DataFrame, fanout: int, digits: int) -> DataFrame:
    """Blocks (group, block, size, nodes) to the leaves of the next level: a group has as many as it has blocks."""
    tops = blocks.select("group", "block", "size", "nodes").mapInArrow(_tops(fanout, digits), "group string, block long, size long, node string")
    return tops.select("group", F.col("block").alias("rank"), F.ceil(F.col("size") / fanout**digits).cast("long").alias("size"), "node")


def _with_upper(blocks: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``blocks`` with the path of each in the blocks above, empty where there are none."""
    if paths is None:
        return blocks.withColumn("upper", F.array().cast(PATH_DDL))
    above = paths.select(F.col("group").alias("_group"), F.col("rank").alias("_block"), F.col("path").alias("upper"))
    joined = blocks.join(above, blocks["group"].eqNullSafe(above["_group"]) & (blocks["block"] == above["_block"]), "left")
    return joined.drop("_group", "_block").withColumn("upper", F.coalesce("upper", F.array().cast(PATH_DDL)))


def _downward(steps: list[DataFrame], scratch: Scratch, name: str, fanout: int, digits: int) -> DataFrame | None:
    """(group, rank, path) of the leaves of the lowest blocks in ``steps``; none without blocks."""
    paths = None
    for k in range(len(steps) - 1, -1, -1):
        blocks = _with_upper(steps[k], paths)
        paths = scratch.save(blocks.mapInArrow(_beside(fanout, digits), f"group string, rank long, path {PATH_DDL}"), f"{name}-paths-{k}")
    return paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None, fanout: int = FANOUT, digits: int = BLOCK_DIGITS, with_path: bool = False) -> DataFrame:
    """One row per input row: doc_id, group, rank, leaf, subroot, root, folded_root, proof_sha256, verified, and path on demand.

    Leaves of a group ascend by ``id_col`` (an integer; null first; rows of one id by
    their digests).  While several nodes remain, every ``fanout`` consecutive ones
    become the digest of their digests; what remains is the group's ``subroot``, and
    subroots by ``group_col`` (null first, bytewise) lead to ``root`` in the same way.
    ``path`` has the siblings of each level up to the root, to the left and to the right,
    ``proof_sha256`` the digest of them all.  ``changed`` replaces columns of the rows that are verified, as
    tampering would: ``folded_root`` is what the changed leaf and the untouched siblings
    lead to, and ``verified`` tells whether that is ``root``.  Missing values are a
    field of their own kind; repeated rows are leaves of their own; an empty table
    gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    now = changed or {}
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("group"), leaf([F.col(c) for c in fields]).alias("leaf"),
        leaf([now.get(c, F.col(c)) for c in fields]).alias("given"),
    )
    rows = scratch.save(rows, "leaves")
    ranked = with_ranks(rows, "group", "doc_id", ["leaf", "given"], scratch)
    members = _blocks(ranked.withColumnRenamed("leaf", "node"), ["node", "given", "doc_id"], fanout, digits)
    members = scratch.save(members, "blocks")
    scratch.release()
    tops = scratch.save(_reduced(members.withColumn("nodes", F.col("members.node")), fanout, digits), "tops")
    subroots, steps = _upward(tops, scratch, "rows", fanout, digits)
    paths = _downward(steps, scratch, "rows", fanout, digits)
    # one row for each group, in the order of bytes
    place = F.row_number().over(Window.orderBy(F.col("group").cast("binary").asc_nulls_first())) - 1
    groups = scratch.save(subroots.select("group", "node", place.cast("long").alias("rank")), "groups")
    root, steps = _upward(groups.select(F.lit("").alias("group"), "rank", F.lit(groups.count()).cast("long").alias("size"), "node"), scratch, "groups", fanout, digits)
    above = _downward(steps, scratch, "groups", fanout, digits)
    found = root.agg(F.min("node").alias("root"))
    ends = groups.join(above.select("rank", F.col("path").alias("_above")), "rank") if above is not None else groups.withColumn("_above", F.array().cast(PATH_DDL))
    ends = ends.crossJoin(found).select(F.col("group").alias("_end"), F.col("node").alias("subroot"), "root", "_above")  # with a single row
    blocks = _with_upper(members, paths)
    blocks = blocks.join(ends, blocks["group"].eqNullSafe(ends["_end"])).withColumn("upper", F.concat("upper", "_above")).drop("_end", "_above")
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, group string, rank long, leaf string, subroot string, root string, folded_root string, proof_sha256 string" + f", path {PATH_DDL}" * with_path
    done = blocks.mapInArrow(_verified(fanout, digits, to_arrow_type(T._parse_datatype_string(kind)), with_path), schema)
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
