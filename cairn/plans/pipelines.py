"""The pipelines put together: daily, research, archive, and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn import lexicon as L
from cairn.functions.text import bump_version, clean_references_first, safe_url
from cairn.operators import classify as C, dedup, merge, predicates as P, rollup, select
from cairn.scratch import Scratch


def daily(
    batch: DataFrame, existing: DataFrame, terms=L.STRONG_TERMS, topics=L.TOPICS_DAILY, cascade=L.CATEGORY_CASCADE, boosts=L.SCORE_BOOSTS, threshold: float = 0.82, *,
    index: dedup.GramIndex | None = None, wording: dict | None = None, sources: DataFrame | None = None, health: DataFrame | None = None, fetched: DataFrame | None = None, version: str | None = None, as_of: Column | None = None,
) -> dict[str, DataFrame]:
    """A day's run: new items against a collection by fuzzy deduplication and gate, their classes, scores and reasons, then the merged collection and its records.

    ``batch`` has seq, title, summary, source_name, source_type, source_url,
    published_at, authority, gated (false: no relevance gate), and reason where one is
    given; ``existing`` has seq and the columns of items.  Every row, old or new, gets
    its category anew; ids count by time, latest first, old rows before new ones of
    the same time.  ``index`` is a stored index of the collection's titles, else one
    is made.  ``wording`` are the arguments of the reason generator (themes, hints,
    names, openers, tails, values); without it only given reasons stand.

    The result has new, news and days; sources (the known ones and the new of the
    items, or without ``sources`` their counts); health, with ``fetched`` (name, count,
    ok) and what was known of it in ``health``; and version, raised by one, with
    ``version``.
    """
    ok = ~F.coalesce(F.col("gated"), F.lit(True)) | P.relevant(F.col("title"), F.col("summary"), terms)
    scratch = Scratch(batch.sparkSession, "daily")
    new = dedup.greedy(batch, "title", "seq", "edit", threshold, existing=index or existing.select("title"), gate=ok)
    title, said = F.col("title"), F.coalesce("summary", F.lit(""))
    summary, topic = F.coalesce(F.nullif("summary", F.lit("")), "title"), C.most_hits(title, said, topics)
    new = new.withColumns({"_score": C.boosted_score(title, said, F.col("authority"), boosts), "_category": C.category_cascade(title, said, cascade)})
    given = F.nullif(F.col("reason"), F.lit("")) if "reason" in batch.columns else F.lit(None).cast("string")
    worded = C.reason(title, said, F.col("source_name"), F.col("source_type"), F.col("_category"), F.col("_score"), **wording) if wording else F.lit(None).cast("string")
    new = new.select(
        "seq", "title", summary.alias("summary"), "source_name", "source_type", "source_url", F.lit(4).alias("importance"), F.col("_score").alias("ai_score"), F.lit("").alias("tags"), "published_at", F.coalesce(given, worded).alias("reason"),
        F.lit(False).alias("date_verified"), F.coalesce(topic, F.lit("product_innovation")).alias("research_topic"), F.col("source_type").isin("研究机构", "咨询").alias("is_research_report"),
    )
    new = scratch.save(new, "new")  # the collection is read several times from here on
    merged = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    merged = merged.withColumn("category", C.category_cascade(title, F.coalesce("summary", F.lit("")), cascade))
    merged = select.numbered(merged.drop("id"), [F.desc(F.coalesce("published_at", F.lit(""))), F.col("_new"), F.col("seq")]).drop("_new")
    merged = scratch.save(merged, "news")
    by_source = rollup.counts(merged, "source_name")
    out = {"new": new, "news": merged, "days": rollup.days(merged), "sources": by_source}
    if sources is not None:
        out["sources"] = merge.sync_sources(sources, merged, as_of if as_of is not None else F.current_date(), seq="id")
    if fetched is not None:
        known = health if health is not None else fetched.limit(0)
        named = by_source.select(F.coalesce("source_name", F.lit("")).alias("name"), "count").groupBy("name").agg(F.sum("count").alias("count"))
        out["health"] = merge.merge_health(known, fetched, named)
    if version is not None:
        out["version"] = batch.sparkSession.range(1).select(bump_version(F.lit(version)).alias("version"))
    return out


def archive(items: DataFrame, as_of: Column) -> DataFrame:
    """Raw items through noise filters, deduplication, freshness, classes, scores and the bonus of weak classes."""
    kept = items.where(~P.is_stock_noise(F.col("title")) & ~P.is_blocked(F.col("url"), F.col("source_name")) & ~(F.col("source_type").isin(L.SEARCH_CHANNELS) & P.is_search_noise(F.col("title"))))
    kept = Scratch(items.sparkSession, "archive").save(P.fresh(merge.unique_items(kept), as_of), "fresh")
    kept = kept.withColumns({"title": clean_references_first(F.col("title")), "content": clean_references_first(F.col("content"))})
    title, content = F.col("title"), F.col("content")
    kept = kept.withColumns({"category": C.category_by_hits(title, content, F.col("category_hint")), "research_topic": C.most_hits(title, content, L.TOPICS_ARCHIVE, ""), "is_research_report": P.is_report(F.col("source_name"), title, content)})
    score, relevance = C.additive_score(title, content, F.col("source_name"), F.col("published_at"), F.col("date_verified"), F.col("is_research_report"), as_of)
    kept = kept.withColumns({"ai_score": score, "insurance_relevance": relevance, "ai_tags": C.first_tags(F.col("category"), title, content)})
    return C.weak_class_bonus(kept)


def archive_output(scored: DataFrame, old: DataFrame, reports: DataFrame, as_of: Column, curated: float = 6.0) -> DataFrame:
    """A balanced choice of the scored items, those from ``curated`` on merged with what is retained and with the report register, capped and numbered.

    Today's items stand by score, then as they were chosen; the old ones and the
    reports follow in their order.  Items without a safe address have ``#``, those
    without a date today's, and ``ai_reason``, where there is one, is their reason.
    """
    scratch = Scratch(scored.sparkSession, "output")
    scored = scratch.save(scored, "scored")  # the choice reads it several times
    chosen = scratch.save(_in_order_of_choice(select.quota(scored, "source_type", "ai_score", "seq")), "chosen")
    today = chosen.where(F.col("ai_score") >= curated)
    url, reason = safe_url(F.col("url")), F.col("ai_reason") if "ai_reason" in scored.columns else F.lit("")
    today = today.select(
        F.struct(F.lit(0).alias("part"), F.col("_place").cast("long").alias("at")).alias("seq"), "title", F.substring("content", 1, 300).alias("summary"), "source_name", C.label_of(F.col("source_type"), L.SOURCE_TYPE_LABELS, F.coalesce("source_type", F.lit("web"))).alias("source_type"), F.when(url != "", url).otherwise("#").alias("source_url"),
        F.bround(F.col("ai_score") * 10).cast("int").alias("ai_score"), F.array_join("ai_tags", ",").alias("tags"), "category", F.coalesce("published_at", as_of.cast("date").cast("string")).alias("published_at"), "date_verified", "research_topic", "is_research_report", reason.alias("reason"),
    )
    behind = lambda part: F.struct(F.lit(part).alias("part"), F.col("seq").cast("long").alias("at"))
    for c in set(today.columns) - set(old.columns):
        old = old.withColumn(c, F.lit(None).cast(today.schema[c].dataType))
    merged = merge.retain(today, old.withColumn("seq", behind(1)), as_of)
    merged = merge.inject_registry(merged, reports.withColumn("seq", behind(2)))
    research = F.col("category") == "research"
    capped = select.capped(merged, [(~F.coalesce(research, F.lit(False)), 81), (research, 19)], [F.col("seq")])
    return select.numbered(capped, [F.col("section"), F.col("seq")]).drop("section")


def _in_order_of_choice(chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``_place``: by score; of equals those that their channel was sure of first, channel by channel, then the others.

    A choice has some tens of rows, or three of each channel.
    """
    best = [F.desc("ai_score"), F.col("seq")]
    channel = Window.partitionBy("source_type")
    rows = chosen.withColumn("_rank", F.row_number().over(channel.orderBy(*best)))
    rows = rows.withColumns({"_top": F.max(F.struct("ai_score", (-F.col("seq")).alias("s"))).over(channel), "_sure": F.col("_rank") <= 3})
    order = [F.desc("ai_score"), F.desc("_sure"), F.when(F.col("_sure"), F.col("_top")).desc(), F.when(F.col("_sure"), F.col("_rank")), F.col("seq")]
    return rows.withColumn("_place", F.row_number().over(Window.orderBy(*order))).drop("_rank", "_top", "_sure")


def distinct_titles(news: DataFrame, seq: str) -> DataFrame:
    """``news`` without titles like an earlier one's, letters apart from case, space, punctuation and digits compared.

    Of titles of which nothing is left for comparing, the first stays.
    """
    from cairn.functions.text import plain_title

    return dedup.greedy(news.withColumn("_plain", plain_title(F.col("title"))), "_plain", seq, "edit", 0.7, strict=True, empty="first").drop("_plain")


def serve(news: DataFrame, reports: DataFrame, keyword: str = "", category: str = "all", number: int = 1, seq: str | None = None, topic: str = "all", as_of: Column | None = None) -> dict[str, DataFrame]:
    """What a reader sees: hot topics, featured items by day, a page of all, the day's paper, and the reports of a topic by layer; near-equal titles once.

    ``seq`` is the rows' place in the collection, without it the column seq, else id.
    """
    now = F.current_timestamp() if as_of is None else as_of
    place = seq or ("seq" if "seq" in news.columns else "id")
    shown = Scratch(news.sparkSession, "serve").save(distinct_titles(news, place).withColumn("ts", F.try_to_timestamp("published_at")), "shown")
    found = P.search(shown, keyword, category)
    return {
        "hot": select.hot_topics(found, "ts", "ai_score", place), "featured": select.by_date_label(found.where("ai_score >= 60"), "ts", now, [F.desc("ts"), F.desc("ai_score"), F.col(place)]),
        "page": select.page(found, [F.desc("ts"), F.col(place)], number), "daily": select.display_rank(shown.where(F.col("category").isin(L.CATEGORIES)), L.CATEGORIES, "category", [F.col(place)]),
        "reports": select.reports_by_layer(reports, topic),
    }
