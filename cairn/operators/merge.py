"""Merging a batch into a collection: anti-joins, retention, health, registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn import lexicon as L
from cairn.functions.text import safe_url
from cairn.operators.classify import label_of
from cairn.operators.dedup import GramIndex, first_of_each, first_of_keys_and_titles, greedy
from cairn.scratch import Scratch


def unseen(batch: DataFrame, existing: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key of ``batch`` that ``existing`` does not have; null keys are no keys and stay."""
    keyed = batch.where(F.col(key).isNotNull())
    fresh = first_of_each(keyed.join(existing.select(key).distinct(), key, "left_anti").select(*batch.columns), [key], [seq])
    return fresh.unionByName(batch.where(F.col(key).isNull()))


def merge_reports(batch: DataFrame, existing: DataFrame, seq: str = "seq", url: str = "url", title: str = "title", threshold: float = 0.82) -> DataFrame:
    """New reports: address unseen, title like no other's; existing rows are never overwritten.

    Of the batch, an address is seen when a row with it is kept, so a later row of
    the address stays where the first falls for its title.  Rows without an address
    or a title are dropped; so are those whose address or title ``existing`` has.
    """
    rows = batch.where((F.coalesce(F.col(url), F.lit("")) != "") & (F.coalesce(F.col(title), F.lit("")) != ""))
    rows = rows.join(existing.select(url).distinct(), url, "left_anti").select(*batch.columns)
    rows = unlike(rows, existing, title, threshold)
    return first_of_keys_and_titles(rows, seq, url, title, "edit", threshold)


def unlike(texts: DataFrame, existing: DataFrame | GramIndex, title: str, threshold: float, strict: bool = False) -> DataFrame:
    """``texts`` without the rows whose ``title`` resembles one of ``existing``, an index or rows with that column.

    Rows without a title resemble none.  Each different title is compared once; those
    of ``existing`` are never compared with one another.
    """
    index = existing if isinstance(existing, GramIndex) else GramIndex.of(existing, title, "edit", threshold)
    low = F.lower(F.col(title))
    heads = texts.where(low != "").select(low.alias("_t")).distinct().withColumn("_i", F.monotonically_increasing_id())
    heads = Scratch(texts.sparkSession, "unlike").save(heads, "heads")
    found = index.matches(heads, "_t", "_i", threshold, strict).select(F.col("i").alias("_i")).distinct()
    return texts.join(heads.join(found, "_i", "left_semi").select("_t"), low == F.col("_t"), "left_anti").select(*texts.columns)


def protect_curated(reports: DataFrame) -> DataFrame:
    """Rows that were not collected automatically count as curated."""
    return reports.withColumn("curated", F.coalesce(F.col("curated"), F.lit(False)) | ~F.coalesce(F.col("auto"), F.lit(False)))


def unique_items(items: DataFrame, seq: str = "seq", threshold: float = 0.5) -> DataFrame:
    """The archive pass after the noise filters: first of each address (of each title where there is none), then character Jaccard.

    A row that the title comparison drops still keeps its address from later rows.
    Rows without a title resemble none; those without an address as well all stay.
    """
    url, title = F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("title"), F.lit(""))
    keyed = items.withColumn("_key", F.coalesce(F.concat(F.lit("u"), url), F.concat(F.lit("t"), title)))
    first = first_of_each(keyed.where("_key IS NOT NULL"), ["_key"], [seq]).unionByName(keyed.where("_key IS NULL")).drop("_key")
    first = Scratch(items.sparkSession, "unique").save(first, "first")  # read several times from here on
    return greedy(first, "title", seq, "jaccard", threshold, strict=True, empty="keep")


def retain(today: DataFrame, old: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Today's rows and those old ones, not seen today, that are verified and recent or unverified with a date.

    Old research that is no report becomes ``industry``, the type of an old source is
    named as today's are; the first of equal addresses stays.
    """
    day = F.substring(F.coalesce("published_at", F.lit("")), 1, 10)
    verified = F.coalesce(F.col("date_verified"), F.lit(False))
    kept = old.where((F.coalesce("source_url", F.lit("")) != "") & ((verified & (day >= F.date_sub(as_of, days).cast("string"))) | (~verified & (day != ""))))
    demoted = F.when((F.col("category") == "research") & ~F.coalesce(F.col("is_research_report"), F.lit(False)), "industry").otherwise(F.col("category"))
    kept = kept.withColumn("category", demoted)
    if "source_type" in old.columns:
        kept = kept.withColumn("source_type", label_of(F.col("source_type"), L.SOURCE_TYPE_LABELS, F.coalesce("source_type", F.lit("财经媒体"))))
    kept = first_of_each(kept, ["source_url"], ["seq"])
    return today.unionByName(kept.join(today.select("source_url").distinct(), "source_url", "left_anti").select(*today.columns))


def inject_registry(items: DataFrame, reports: DataFrame, topics: dict[str, str] = L.TOPIC_LABELS, seq: str = "seq", reason: str = "权威研究报告：{institution}，{layer}") -> DataFrame:
    """Curated reports as rows of the category research, for addresses that are not there yet; a missing address is ``#``.

    ``reason`` is the sentence on them, with the places {institution} and {layer}.
    """
    why = F.replace(F.replace(F.lit(reason), F.lit("{institution}"), F.coalesce("institution_cn", F.lit(""))), F.lit("{layer}"), label_of(F.col("layer"), L.LAYER_LABELS, F.lit("行业")))
    url = F.when(safe_url(F.col("url")) != "", safe_url(F.col("url"))).otherwise("#")
    facts = F.array_join(F.slice(F.coalesce("key_data", F.array().cast("array<string>")), 1, 3), "；")
    summary = F.concat_ws(" ", F.nullif("key_insight", F.lit("")), F.when(facts != "", F.concat(F.lit("关键数据："), facts)))
    rows = reports.select(
        seq, "title", F.substring(summary, 1, 300).alias("summary"), F.coalesce("institution_cn", "institution").alias("source_name"), label_of(F.col("layer"), L.LAYER_LABELS, F.lit("研究机构")).alias("source_type"), url.alias("source_url"),
        F.lit(95).alias("ai_score"), label_of(F.col("topic"), topics, F.lit("")).alias("tags"), F.lit("research").alias("category"), F.col("publish_date").alias("published_at"), F.lit(True).alias("date_verified"), F.col("topic").alias("research_topic"), F.lit(True).alias("is_research_report"), why.alias("reason"),
    )
    return items.unionByName(unseen(rows, items, "source_url", seq), allowMissingColumns=True)


def sync_sources(known: DataFrame, items: DataFrame, as_of: Column, score: int = 80, seq: str = "seq", freq: str = "不定期", status: str = "active", kind: str = "媒体") -> DataFrame:
    """Known sources and the new ones of ``items``, each with the type it first came with, its frequency, day and state."""
    new = items.where(F.coalesce("source_name", F.lit("")) != "").groupBy(F.col("source_name").alias("name")).agg(F.min_by(F.coalesce("source_type", F.lit(kind)), seq).alias("type"))
    new = new.join(known.select("name"), "name", "left_anti").select("name", "type", F.lit(score).alias("score"), F.lit(freq).alias("update_freq"), as_of.cast("date").cast("string").alias("last_update"), F.lit(status).alias("status"))
    return known.unionByName(new, allowMissingColumns=True)


def fetch_health(attempts: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, count, ok) of every source that was tried: how many rows it gave, and whether it gave any without an error.

    ``attempts`` has name and error (null: none); ``rows`` has source_name.  Rows of a
    source that failed do not count, and no source stands in another's way.
    """
    got = rows.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tried = attempts.groupBy("name").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    count = F.when(F.col("failed"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return tried.join(got, "name", "left").select("name", count.alias("count"), (count > 0).alias("ok"))


def of_sound_sources(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """``rows`` without those of sources whose fetching failed."""
    failed = attempts.where("error IS NOT NULL").select(F.col("name").alias("source_name")).distinct()
    return rows.join(failed, "source_name", "left_anti").select(*rows.columns)


def with_user_state(items: DataFrame, state: DataFrame, key: str = "id", flags: tuple[str, ...] = ("is_read", "is_favourite")) -> DataFrame:
    """``items`` with a user's flags, false where there are none; of several rows of a key any true one counts."""
    own = state.groupBy(key).agg(*[F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags])
    joined = items.join(own, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})


def merge_health(existing: DataFrame, fetched: DataFrame, counts: DataFrame, strict: bool = False) -> DataFrame:
    """(name, count, ok): fetched sources by what is stored of them, else what was known, else the stored count.

    ``strict`` renews the counts of sources that were not fetched, which are otherwise
    left as they were.
    """
    e, f, c = existing.select("name", F.col("count").alias("ec"), F.col("ok").alias("eo")), fetched.select("name", F.col("count").alias("fc"), F.col("ok").alias("fo")), counts.select("name", F.col("count").alias("cc"))
    both = e.join(f, "name", "full_outer").join(c, "name", "full_outer")
    was = F.coalesce("cc", "ec") if strict else F.col("ec")
    count = F.when(F.col("fo").isNotNull(), F.coalesce("cc", "fc")).when(F.col("eo").isNotNull(), was).otherwise(F.col("cc"))
    return both.select("name", count.alias("count"), F.coalesce("fo", "eo", F.lit(True)).alias("ok"))


def drain(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without what is done, rows compared in all columns."""
    match = None
    for c in queue.columns:
        same = queue[c].eqNullSafe(done[c])
        match = same if match is None else match & same
    return queue.join(done, match, "left_anti")


def zipped(rows: DataFrame, arrays: dict[str, str], pos: str = "pos") -> DataFrame:
    """One row per place of the first array, the others by place, null where they are shorter."""
    first = next(iter(arrays))
    n = F.size(first)
    cut = F.arrays_zip(*[F.slice(c, F.lit(1), F.greatest(n, F.lit(0))) for c in arrays])
    return rows.select("*", F.posexplode(cut)).select(*rows.columns, F.col("pos").alias(pos), *[F.col("col").getField(str(i)).alias(name) for i, name in enumerate(arrays.values())])


def weighted(keywords: DataFrame, keyword: str, weights: dict[str, int], default: int = 3, name: str = "page_size") -> DataFrame:
    """``keywords`` with the page size of each, a default for those without their own."""
    return keywords.withColumn(name, F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(keyword)], F.lit(default)))


def source_of_domain(domain: Column, names: dict[str, str] = L.DOMAIN_NAMES, prefixes: list[str] = L.DOMAIN_PREFIXES, default: str = "") -> Column:
    """The name of a known domain, else its last label of three letters or more that is no common prefix."""
    plain = domain
    for ending in (".com.cn", ".cn", ".com"):
        plain = F.replace(plain, F.lit(ending), F.lit(""))
    labels = F.filter(F.split(plain, r"\."), lambda p: ~p.isin(prefixes) & (F.length(p) > 2))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[domain], F.try_element_at(labels, F.lit(-1)), F.lit(default))


def renamed_keys(state: DataFrame, old: str, new: str) -> DataFrame:
    """A column under its new name; a value that is there already stays."""
    value = F.coalesce(F.col(new), F.col(old)) if new in state.columns else F.col(old)
    return state.withColumn(new, value).drop(old)
