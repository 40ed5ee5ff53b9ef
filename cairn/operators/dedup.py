"""Exact and fuzzy deduplication that respects the order of rows.

A fuzzy pass keeps a row unless it resembles a kept row before it: the first
maximal independent set of the similarity graph in row order, not its components.
Pairs are found without comparing all rows: equal keys collapse first, then two
texts can only be within the threshold if they share one of the rarest grams of
each (prefix filter), and the pair is verified.  The order-dependent choice is a
fixpoint of joins: a row whose earlier neighbours are all dropped is kept, a row
with a kept earlier neighbour is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.text import characters
from cairn.operators import blocks
from cairn.scratch import Scratch


def first_of_each(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a grouped minimum, which combines before the shuffle."""
    rest = [c for c in items.columns if c not in by and c not in order]
    first = items.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*by, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)]).select(*items.columns)


def _loss(threshold: float) -> float:
    """Edits that a pair within the threshold may have, per character of its shorter text."""
    if not 0.5 < threshold <= 1:
        raise ValueError("edit ratios are searched above 0.5 only: below, texts need not share anything")
    return (1 - threshold) / threshold


def _width(n: Column, loss: float) -> Column:
    """The widest grams, of 3 characters at most, of which a text of this length keeps some whatever its edits."""
    widths = F.lit(1)
    for q in (2, 3):
        if q * loss < 1:
            widths = F.when(n > (q - 1) / (1 - q * loss), q).otherwise(widths)
    return widths


def _grams(q: int) -> Column:
    """Hashes of the distinct strings of ``q`` characters, from the array ``c`` of characters."""
    starts = F.slice(F.sequence(F.lit(1), F.size("c")), F.lit(1), F.greatest(F.size("c") - (q - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda s: F.xxhash64(F.lit(q), *[F.element_at("c", s + d) for d in range(q)])))


def gram_arrays(threshold: float) -> Column:
    """(q, g) for each width: the distinct grams of the text by which it may meet another, null for widths that none needs; reads ``c``, its characters, and ``n``, their number.

    A pair is looked for by the width that suits its shorter text, so a text has the
    grams of each width that a partner of its length down to the shortest may need.
    """
    loss = _loss(threshold)
    least, most = _width(F.ceil(F.col("n") * threshold - 1e-9), loss), _width(F.col("n"), loss)
    return F.array(*[F.struct(F.lit(q).alias("q"), F.when((least <= q) & (most >= q), _grams(q)).alias("g")) for q in (1, 2, 3)])


def enough(q: Column, n: Column, threshold: float) -> Column:
    """How many grams of width ``q``, the first in any one order, meet every partner: k edits spoil at most q * k."""
    return q * F.floor(n * _loss(threshold) + 1e-9) + 1


def _gram_sets(base: DataFrame, threshold: float) -> DataFrame:
    """(i, n, m, q, gram, size): the grams of each text by which pairs meet, ``size`` of the rarest of width ``q`` suffice."""
    rows = base.withColumn("c", F.filter(F.split("k", ""), lambda c: c != "")).select("i", "n", F.lit(0).alias("m"), F.inline(gram_arrays(threshold)))
    return rows.select("i", "n", "m", "q", F.explode("g").alias("gram"), enough(F.col("q"), F.col("n"), threshold).alias("size"))


def _character_sets(base: DataFrame, threshold: float) -> DataFrame:
    m = F.size("c")
    return base.withColumn("c", characters(F.col("k"))).select("i", "n", m.alias("m"), F.lit(1).alias("q"), F.explode(F.transform("c", lambda c: F.xxhash64(c))).alias("gram"), (m - F.ceil(m * threshold - 1e-9) + 1).alias("size"))


def _text_of(kind: str, text: Column) -> Column:
    """What is compared: lower case for edits, the text itself for characters."""
    return F.lower(text) if kind == "edit" else text


def _sets(base: DataFrame, kind: str, threshold: float) -> DataFrame:
    return _gram_sets(base, threshold) if kind == "edit" else _character_sets(base, threshold)


def _probes(sets: DataFrame, rare: DataFrame, frequent: Column) -> DataFrame:
    """(i, n, m, q, gram): of each set the first ``size`` grams in one order of all grams: by ``df``, those that ``rare`` lacks first.

    ``frequent`` tells of a joined row whether its gram can meet another text; those
    that cannot count among the first, and only shorten the rest.
    """
    joined = sets.join(rare, ["q", "gram"], "left").groupBy("i", "n", "m", "q", "size").agg(F.array_sort(F.collect_list(F.when(frequent, F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")))).alias("o"), F.count_if(~frequent).alias("single"))
    taken = F.slice("o", F.lit(1), F.greatest(F.least(F.col("size") - F.col("single"), F.size("o")), F.lit(0)).cast("int"))
    return joined.select("i", "n", "m", "q", F.explode(F.transform(taken, lambda x: x["gram"])).alias("gram"))


def _in_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether two lengths (of texts or sets) are near enough for the threshold."""
    return F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that are small but lead to much work."""
    spark = rows.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Up to so many texts of a batch their grams are sent to the stored ones.
FEW_TEXTS = 1000


def _meeting(mine: DataFrame, theirs: DataFrame, length: str, threshold: float, also: Column | None = None, few: bool = False) -> DataFrame:
    """The joined rows ``a`` of ``mine`` and ``b`` of ``theirs`` that share a gram and are in reach.

    A gram that many texts have is no single key: it meets in bands of like lengths.
    Where there are ``few`` of ``mine`` they go to all of ``theirs``; else both are dealt
    to many tasks, as grams are small in files but large in a table that each task has.
    """
    around = F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1))
    a = mine.withColumn("_b", blocks.band(F.col(length), threshold)).withColumn("band", around).drop("_b")
    b = theirs.withColumn("band", blocks.band(F.col(length), threshold))
    a, b = (F.broadcast(a).alias("a"), b.alias("b")) if few else (a.repartition(_tasks(a), "q", "gram", "band").hint("merge").alias("a"), b.hint("merge").alias("b"))
    same = (F.col("a.q") == F.col("b.q")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.band") == F.col("b.band"))
    same = same & _in_reach(F.col(f"a.{length}"), F.col(f"b.{length}"), threshold)
    return a.join(b, same if also is None else same & also)


def _measured(both: DataFrame, kind: str, threshold: float, strict: bool) -> DataFrame:
    """(i, j, similarity) of candidates (i, j, edits, longer), where edits are -1 beyond the threshold, or of (i, j, common, all) for characters."""
    if kind == "edit":
        both = both.where("edits >= 0").select("i", "j", (1 - F.col("edits") / F.col("longer")).alias("similarity"))
    else:
        both = both.select("i", "j", (F.col("common") / (F.col("all") - F.col("common"))).alias("similarity"))
    return both.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def _compared(both: DataFrame, kind: str, threshold: float, strict: bool) -> DataFrame:
    """(i, j, similarity) of candidates (i, j, x, y) within the threshold, dealt evenly before they are compared."""
    both = both.repartition(_tasks(both), "i", "j")
    if kind == "edit":
        longer = F.greatest(F.length("x"), F.length("y"))
        edits = F.call_function("levenshtein", "x", "y", F.floor(longer * (1 - threshold) + 1e-9).cast("int"))
        both = both.select("i", "j", edits.alias("edits"), longer.alias("longer"))
    else:
        both = both.withColumns({"x": characters(F.col("x")), "y": characters(F.col("y"))})
        both = both.select("i", "j", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
    return _measured(both, kind, threshold, strict)


#: From this threshold on few grams must be looked up, and rare ones find few candidates; below it blocks meet as a whole.
BY_GRAMS = 0.9


def _for_blocks(base: DataFrame, kind: str, side: int = 0) -> DataFrame:
    """(i, k, length, side) as ``blocks`` reads them: of characters the different ones are enough."""
    if kind == "edit":
        return base.select("i", "k", F.col("n").alias("length"), F.lit(side).alias("side"))
    return base.select("i", characters(F.col("k")).alias("c")).select("i", F.array_join("c", "").alias("k"), F.size("c").alias("length"), F.lit(side).alias("side"))


def similar_pairs(rows: DataFrame, key: str, seq: str, kind: str, threshold: float, strict: bool = False) -> DataFrame:
    """(i, j, similarity) with i before j for all pairs of texts within the threshold.

    ``kind`` is ``edit`` (1 - edits / longer length, in lower case, threshold above 0.5)
    or ``jaccard`` (sets of characters).  Texts must be distinct in ``key``; ``strict``
    leaves out similarities equal to the threshold.  Edits from ``BY_GRAMS`` on are
    looked for by the rarest grams; everything else meets in blocks of like lengths,
    where grams of all pairs of two blocks are counted at once, and the columns of the
    table of edits end where the threshold is out of reach.
    """
    text = _text_of(kind, F.col(key))
    base = rows.select(F.col(seq).alias("i"), text.alias("k"), F.length(text).alias("n")).where("n > 0")
    if kind == "edit":
        _loss(threshold)
    if kind != "edit" or threshold < BY_GRAMS:
        written = Scratch(rows.sparkSession, "pairs").save(_for_blocks(base, kind), "rows")
        found = _measured(blocks.candidates(written, kind, threshold), kind, threshold, strict)
        return found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "similarity")
    sets = _sets(base, kind, threshold)
    # a gram of one text alone meets nothing, but counts among the rarest
    rare = sets.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    probe = _probes(sets, rare, F.col("df").isNotNull())
    pairs = _meeting(probe, probe, "n", threshold, F.col("a.i") < F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j")).distinct()
    texts = base.select("i", F.col("k").alias("x"))
    both = pairs.join(texts, "i").join(texts.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    return _compared(both, kind, threshold, strict)


def resembling(rows: DataFrame, key: str, seq: str, existing: DataFrame, text_col: str, kind: str, threshold: float, strict: bool = False) -> DataFrame:
    """(i) of the rows that resemble any text of ``existing``, block by block, for one use; a ``GramIndex`` is for many."""
    scratch = Scratch(rows.sparkSession, "existing")
    old = existing.select(_text_of(kind, F.col(text_col)).alias("k")).where("k IS NOT NULL AND k != ''").distinct().select(F.lit(None).cast(rows.schema[seq].dataType).alias("i"), "k", F.length("k").alias("n"))
    text = _text_of(kind, F.col(key))
    new = rows.select(F.col(seq).alias("i"), text.alias("k"), F.length(text).alias("n")).where("n > 0")
    both = scratch.save(_for_blocks(new, kind).unionByName(_for_blocks(old, kind, 1)), "rows")
    return _measured(blocks.candidates(both, kind, threshold, two=True), kind, threshold, strict).select("i").distinct()


class GramIndex:
    """Texts that are there already, stored so that a batch finds those it resembles without comparing them among themselves.

    Below ``path`` are three tables: ``order``, the number of texts that had each gram
    when the index was made, which is kept as it was; ``texts``, the distinct texts with
    ids of their own; and ``grams``, the grams by which each of them is found, the
    rarest in that order.  Grams that are new since then count as rarest of all, on
    both sides, so every pair within the threshold still shares a gram.  What is added
    goes to folders of the addition's number, which an addition that is made again
    replaces: a restart neither loses nor doubles texts.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.kind, self.threshold = about["kind"], about["threshold"]

    @classmethod
    def create(cls, texts: DataFrame, text_col: str, path: str, kind: str = "edit", threshold: float = 0.82, number: int = 0) -> GramIndex:
        """A new index of the texts, which also fix the order of grams; an index that is there is replaced."""
        spark = texts.sparkSession
        if kind == "edit":
            _loss(threshold)
        spark.createDataFrame([(kind, float(threshold))], "kind string, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        distinct = texts.select(_text_of(kind, F.col(text_col)).alias("t")).where("t IS NOT NULL AND t != ''").distinct()
        distinct.write.mode("overwrite").parquet(f"{path}/first")
        base = spark.read.parquet(f"{path}/first").select(F.lit(0).alias("i"), F.col("t").alias("k"), F.length("t").alias("n"))
        _sets(base, kind, threshold).groupBy("q", "gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1").write.mode("overwrite").parquet(f"{path}/order")
        for table, schema in cls._SCHEMA.items():
            spark.createDataFrame([], f"{schema}, part long").write.partitionBy("part").mode("overwrite").parquet(f"{path}/{table}")
        index = cls(spark, path)
        index._put(spark.read.parquet(f"{path}/first"), number)
        return index

    @classmethod
    def of(cls, texts: DataFrame, text_col: str, kind: str, threshold: float) -> GramIndex:
        """An index for one use, below the shared folder."""
        return cls.create(texts, text_col, f"{Scratch(texts.sparkSession, 'index').kept()}/index", kind, threshold)

    #: Of the tables, besides the addition's number as ``part``.
    _SCHEMA = {"texts": "id long, t string", "grams": "q int, gram long, id long, n int, m int"}

    def _read(self, table: str, below: int | None) -> DataFrame:
        rows = self.spark.read.schema(f"{self._SCHEMA[table]}, part long").parquet(f"{self.path}/{table}")
        return rows if below is None else rows.where(F.col("part") < below)

    def texts(self, below: int | None = None) -> DataFrame:
        """(id, t, part) of the texts, of those in additions before ``below``."""
        return self._read("texts", below)

    def _prefix(self, base: DataFrame) -> DataFrame:
        order = self.spark.read.schema("q int, gram long, df long").parquet(f"{self.path}/order")
        return _probes(_sets(base, self.kind, self.threshold), order, F.lit(True))

    def _put(self, distinct: DataFrame, number: int) -> None:
        # ids are of an addition, and fixed once they are written
        distinct.select(F.monotonically_increasing_id().alias("id"), "t").write.mode("overwrite").parquet(f"{self.path}/texts/part={number}")
        base = self.texts().where(F.col("part") == number).select(F.col("id").alias("i"), F.col("t").alias("k"), F.length("t").alias("n"))
        self._prefix(base).select("q", "gram", F.col("i").alias("id"), "n", "m").write.mode("overwrite").parquet(f"{self.path}/grams/part={number}")

    def add(self, texts: DataFrame, text_col: str, number: int) -> None:
        """Add the texts as addition ``number`` (from 1), in place of what that addition had."""
        mine = texts.select(_text_of(self.kind, F.col(text_col)).alias("t")).where("t IS NOT NULL AND t != ''").distinct()
        self._put(mine.join(self.texts(number).select("t"), "t", "left_anti"), number)

    def matches(self, rows: DataFrame, key: str, seq: str, threshold: float, strict: bool = False, below: int | None = None) -> DataFrame:
        """(i, j, similarity): every row and stored text (part, id) within the threshold; ``below`` leaves out additions from that number on.

        Equal texts of the rows are looked for once, so copies cost a join and no more
        grams or comparisons.  The texts' grams meet the stored ones, and only the texts
        of candidates are compared; a row whose text is stored itself has the similarity
        1, one without a text has none.  Up to ``FEW_TEXTS`` texts are sent to the stored
        grams, which then need no shuffle.  ``threshold`` is the index's or a higher
        one.
        """
        if threshold < self.threshold:
            raise ValueError(f"the index is made for thresholds from {self.threshold} on")
        scratch = Scratch(self.spark, "matches")
        rows = scratch.save(rows.select(F.col(seq).alias("i"), _text_of(self.kind, F.col(key)).alias("k")).where("k != ''"), "rows")
        base = scratch.save(rows.groupBy("k").agg(F.min("i").alias("i")).select("i", "k", F.length("k").alias("n")), "texts")
        pairs = _meeting(self._prefix(base), self._read("grams", below), "n" if self.kind == "edit" else "m", self.threshold, few=base.count() <= FEW_TEXTS).select("a.i", "b.part", "b.id").distinct()
        both = pairs.join(self.texts(below), ["part", "id"]).join(base.select("i", F.col("k").alias("x")), "i")
        found = _compared(both.select("i", F.struct("part", "id").alias("j"), "x", F.col("t").alias("y")), self.kind, threshold, strict)
        first = rows.join(base.select("k", F.col("i").alias("_first")), "k").select("i", "_first")
        return found.withColumnRenamed("i", "_first").join(first, "_first").select("i", "j", "similarity")


def first_independent(nodes: DataFrame, pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(i) of the rows that a pass in order keeps, of ``nodes`` (i) and ``pairs`` (i before j).

    Rows without a pair are kept at once; each round decides every row whose earlier
    neighbours are decided, and at least the first of those that are open, so it
    ends for chains of any length.  States are written once a round.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "greedy")
    pairs = scratch.save(pairs.select("i", "j").distinct(), "pairs")
    state = scratch.save(pairs.select("j").distinct().select(F.col("j").alias("i"), F.lit(None).cast("boolean").alias("kept")), "state-0")
    heads = pairs.select("i").distinct().join(state, "i", "left_anti").select("i", F.lit(True).alias("kept"))
    state = scratch.save(state.union(heads), "state-1")
    k = 1
    while not state.where("kept IS NULL").isEmpty():
        k += 1
        before = pairs.join(state, "i").groupBy("j").agg(F.coalesce(F.max("kept"), F.lit(False)).alias("beside"), F.count_if(F.col("kept").isNull()).alias("open"))
        decided = state.join(before.withColumnRenamed("j", "i"), "i", "left")
        value = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("beside"), False).when(F.col("open") == 0, True)
        state = scratch.save(decided.select("i", value.alias("kept")), f"state-{k}")
        scratch.release()
    return nodes.join(state.where("NOT kept").select("i"), "i", "left_anti")


def first_of_keys_and_titles(items: DataFrame, seq: str, key: str, text_col: str, kind: str = "edit", threshold: float = 0.82) -> DataFrame:
    """``items`` without those that have the key of an earlier kept row, or a title like one's.

    A key or a title counts as seen only when its row is kept, so equal ones cannot
    stand for one another.  Rows are never paired within a key or a title: each round
    takes the least kept and the least open row of every key and of every title, which
    combine before the shuffle, and a title's from the titles near it.  A null key or
    title is like no other.
    """
    scratch = Scratch(items.sparkSession, "keyed")
    low = F.lower(F.col(text_col)) if kind == "edit" else F.col(text_col)
    rows = scratch.save(items.select(F.col(seq).cast("long").alias("i"), F.col(key).alias("u"), F.nullif(low, F.lit("")).alias("t")), "rows")
    titles = scratch.save(rows.where("t IS NOT NULL").groupBy("t").agg(F.min("i").alias("i")), "titles")
    near = similar_pairs(titles, "t", "i", kind, threshold).select("i", "j")
    near = near.union(near.select("j", "i")).union(titles.select("i", F.col("i").alias("j")))
    near = near.join(titles, "i").select("t", "j").join(titles.select(F.col("i").alias("j"), F.col("t").alias("other")), "j").select("t", "other")
    near = scratch.save(near, "near")
    state = rows.withColumn("kept", F.lit(None).cast("boolean"))
    k = 0
    while True:
        least = lambda c: [F.min(F.when(F.col("kept"), F.col("i"))).alias(f"{c}_kept"), F.min(F.when(F.col("kept").isNull(), F.col("i"))).alias(f"{c}_open")]
        by_title = state.where("t IS NOT NULL").groupBy(F.col("t").alias("other")).agg(*least("t"))
        by_title = near.join(by_title, "other").groupBy("t").agg(F.min("t_kept").alias("t_kept"), F.min("t_open").alias("t_open"))
        by_key = state.where("u IS NOT NULL").groupBy("u").agg(*least("u"))
        seen = state.join(by_title, "t", "left").join(by_key, "u", "left")
        before = lambda what: F.least(F.col(f"t_{what}"), F.col(f"u_{what}")) < F.col("i")
        value = F.when(F.col("kept").isNotNull(), F.col("kept")).when(before("kept"), False).when(F.coalesce(before("open"), F.lit(False)), None).otherwise(True)
        state = scratch.save(seen.select("i", "u", "t", value.alias("kept")), f"state-{k}")
        scratch.release()
        if state.where("kept IS NULL").isEmpty():
            break
        k += 1
    return items.join(state.where("kept").select(F.col("i").alias(seq)), seq, "left_semi").select(*items.columns)


def greedy(items: DataFrame, text_col: str, seq: str, kind: str = "edit", threshold: float = 0.82, strict: bool = False, existing: DataFrame | GramIndex | None = None, gate: Column | None = None, empty: str = "drop", below: int | None = None) -> DataFrame:
    """``items`` without those that resemble an earlier kept row or any text of ``existing``.

    ``existing`` has the column ``text_col``, or is a stored index of such texts; texts
    of it are never compared with one another, and ``below`` leaves out its additions
    from that number on.  ``seq`` orders the rows, any integer
    is one, and no two rows share it.  ``gate`` drops rows after the comparison
    with existing ones; a row that it drops stands in no other's way.  Empty and null
    texts resemble no other: ``empty`` says whether they are dropped (``drop``), kept
    (``keep``), or only the first is kept (``first``).
    """
    if empty != "drop":
        blank = items.where(F.coalesce(F.col(text_col), F.lit("")) == "")
        if gate is not None:
            blank = blank.where(gate)
        if empty == "first":
            blank = blank.orderBy(seq).limit(1)
        return greedy(items, text_col, seq, kind, threshold, strict, existing, gate, below=below).unionByName(blank)
    spark = items.sparkSession
    scratch = Scratch(spark, "greedy")
    low = (lambda c: F.lower(c)) if kind == "edit" else (lambda c: c)
    rows = items.where(F.coalesce(F.col(text_col), F.lit("")) != "")
    if gate is not None:
        rows = rows.where(gate)
    # equal texts: the first stands for all
    heads = rows.groupBy(low(F.col(text_col)).alias("t")).agg(F.min(seq).alias("i"))
    heads = scratch.save(heads, "heads")
    if existing is not None:
        if not isinstance(existing, GramIndex) and kind == "edit" and threshold >= BY_GRAMS:
            existing = GramIndex.of(existing, text_col, kind, threshold)
        if isinstance(existing, GramIndex):
            if existing.kind != kind:
                raise ValueError(f"the index is of kind {existing.kind}")
            like = existing.matches(heads, "t", "i", threshold, strict, below).select("i").distinct()
        else:
            like = resembling(heads, "t", "i", existing, text_col, kind, threshold, strict)
        heads = scratch.save(heads.join(like, "i", "left_anti"), "left")
    pairs = similar_pairs(heads, "t", "i", kind, threshold, strict)
    kept = first_independent(heads.select("i"), pairs, scratch)
    return items.join(kept.withColumnRenamed("i", seq), seq, "left_semi").select(*items.columns)
