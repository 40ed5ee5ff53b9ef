"""Daily records, source counts, diversity metrics and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn import lexicon as L
from cairn.functions.dates import day_key
from cairn.operators.predicates import has_any


def by_day(items: DataFrame, published: str = "published_at", score: str = "ai_score", curated: Column | None = None, highlight: float = 80, default: str = L.DEFAULT_CATEGORY) -> DataFrame:
    """(day, category) counts and day totals in one pass: day, category, n, curated, highlights, score_sum."""
    curated = F.coalesce(F.col("source_url"), F.lit("")) != "" if curated is None else curated
    rows = items.withColumn("day", day_key(F.col(published))).where("day IS NOT NULL AND day != ''")
    return rows.groupBy("day", F.coalesce("category", F.lit(default)).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(curated).alias("curated"), F.count_if(F.col(score) >= highlight).alias("highlights"), F.sum(F.coalesce(score, F.lit(0))).alias("score_sum"))


def days(items: DataFrame, **how) -> DataFrame:
    """day, total, curated, highlights, avg_score (one decimal), categories (map), sources (sorted).

    Categories are counted first, so a day's record is made of a few rows; a day has
    as many sources as it names.
    """
    parts = by_day(items, **how)
    total = parts.groupBy("day").agg(
        F.sum("n").alias("total"), F.sum("curated").alias("curated"), F.sum("highlights").alias("highlights"), F.round(F.sum("score_sum").cast("decimal(20,4)") / F.sum("n"), 1).cast("decimal(6,1)").alias("avg_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"),
    )
    named = items.withColumn("day", day_key(F.col(how.get("published", "published_at")))).where("day != '' AND source_name != ''").select("day", "source_name").distinct()
    return total.join(named.groupBy("day").agg(F.sort_array(F.collect_list("source_name")).alias("sources")), "day", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def counts(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def most_common(items: DataFrame, by: str, k: int) -> DataFrame:
    return counts(items, by).orderBy(F.desc("count"), by).limit(k)


def metrics(items: DataFrame, noise: list[str] = L.STOCK_NOISE_METRICS, categories: list[str] = L.CATEGORIES) -> DataFrame:
    """One row of diversity metrics; zeros for an empty table.

    Rows are counted by category and source first; what comes together in one task
    is a row per source and per category.
    """
    rows = items.select(F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("source_name", F.lit("unknown")).alias("source"), F.coalesce("ai_score", F.lit(0)).alias("score"), has_any(F.coalesce("title", F.lit("")), noise).alias("noise"))
    cell = rows.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.count_if("noise").alias("noise"))
    category = cell.groupBy("category").agg(F.sum("n").alias("n"), F.sum("score").alias("score"), F.sum("noise").alias("noise"))
    source = cell.groupBy("source").agg(F.sum("n").alias("n"))
    expected = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)) for c in categories]
    a = category.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"), F.count(F.lit(1)).alias("category_diversity"), F.least(*expected).cast("long").alias("min_category_count"), F.coalesce(F.max("n"), F.lit(0)).alias("_most"),
        F.coalesce(F.sum("score"), F.lit(0)).alias("_score"), F.coalesce(F.sum("noise"), F.lit(0)).alias("stock_noise_count"), sum(((e > 0).cast("long") for e in expected), F.lit(0)).alias("present_expected_categories"),
    )
    b = source.agg(F.count(F.lit(1)).alias("source_diversity"), F.coalesce(F.max("n"), F.lit(0)).alias("_source"))
    share = lambda c: F.coalesce(F.round(F.col(c) * F.lit(100).cast("decimal(10,0)") / F.nullif("total_items", F.lit(0)), 1), F.lit(0)).cast("double")
    mean = F.coalesce(F.round(F.col("_score").cast("decimal(20,4)") / F.nullif("total_items", F.lit(0)), 1), F.lit(0)).cast("double")
    return a.join(b).select(
        "total_items", "category_diversity", "min_category_count", share("_most").alias("max_category_pct"), share("_source").alias("max_single_source_pct"), "source_diversity", mean.alias("avg_score"), "stock_noise_count", "present_expected_categories"
    )


def gate(m: DataFrame) -> DataFrame:
    """Metrics with pass: 4 categories, 8 sources, no source above 40 percent, no noise; a missing metric fails."""
    passed = (F.col("category_diversity") >= 4) & (F.col("source_diversity") >= 8) & (F.col("max_single_source_pct") <= 40) & (F.col("stock_noise_count") == 0)
    return m.withColumn("pass", F.coalesce(passed, F.lit(False)))


def snapshot(gated: DataFrame, by_source: DataFrame, by_category: DataFrame, date: str, top: int = 10) -> DataFrame:
    """The quality record of a date: metrics with the counts of the ``top`` sources and of all categories as maps."""
    as_map = lambda d, name: d.agg(F.map_from_entries(F.collect_list(F.struct("key", "count"))).alias(name))
    s, c = by_source.toDF("key", "count").orderBy(F.desc("count"), "key").limit(top), by_category.toDF("key", "count")
    return gated.withColumn("date", F.lit(date)).join(as_map(s, "source_distribution")).join(as_map(c, "category_distribution"))


def archive_day(items: DataFrame, research: int = 0, curated: float = 6.0, highlight: float = 7.0) -> DataFrame:
    """The archive profile's record of a day's balanced items: the mean is that of curated ones, 0 without any; research counts as registered."""
    cell = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ai_score") >= curated).alias("curated"), F.count_if(F.col("ai_score") >= highlight).alias("highlights"), F.sum(F.when(F.col("ai_score") >= curated, F.col("ai_score"))).alias("score"))
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n"))))
    if research:
        listed = F.map_concat(F.map_filter(listed, lambda k, _: k != "research"), F.create_map(F.lit("research"), F.lit(research).cast("long")))
    mean = F.round(F.coalesce(F.sum("score"), F.lit(0)).cast("decimal(20,4)") / F.greatest(F.sum("curated"), F.lit(1)), 1)
    return cell.agg(F.sum("n").alias("total"), F.sum("curated").alias("curated"), F.sum("highlights").alias("highlights"), mean.cast("double").alias("avg_score"), listed.alias("categories"))


def first_sources(items: DataFrame, authorities: list[str] = L.AUTHORITY_MEDIA, n: int = 10, seq: str = "seq") -> DataFrame:
    """The first ``n`` sources in the order they occur, with the score of an authority or not."""
    first = items.where(F.coalesce("source_name", F.lit("")) != "").groupBy(F.col("source_name").alias("name")).agg(F.min(seq).alias("seq"), F.min_by("source_type", seq).alias("type"))
    return first.orderBy("seq").limit(n).select("name", "type", F.when(F.col("name").isin(authorities), 85).otherwise(75).alias("score"))


def verification(items: DataFrame, reasons: dict[str, Column] | None = None) -> DataFrame:
    """How many items there are, with a verified date and without, and how many each rule of ``reasons`` drops.

    Rules apply in their order: an item counts for the first that holds.
    """
    ok = F.coalesce(F.col("date_verified"), F.lit(False))
    dropped, before = [], F.lit(False)
    for name, rule in (reasons or {}).items():
        holds = F.coalesce(rule, F.lit(False))
        dropped.append(F.count_if(holds & ~before).alias(name))
        before = before | holds
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("unverified"), *dropped)


def reader_stats(items: DataFrame, least: float = 60, categories: int = 5) -> DataFrame:
    """The counts above a day's list: all, selected, categories (fixed), sources."""
    sources = items.select("source_name").distinct().agg(F.count("source_name").alias("sources"))
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ai_score") >= least).alias("selected"), F.lit(categories).alias("categories")).join(sources)
