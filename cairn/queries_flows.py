"""Registered queries of readers, order-aware deduplication, merges and published forms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn import schemas
from cairn.operators import dedup, merge, predicates as P, rollup, select
from cairn.plans import pipelines, publish
from cairn.queries import CLASSED, NEWS, SITE, _ESC, _t, classed, news, query
from cairn.scratch import Scratch
from cairn.sources import readers
from cairn.streaming import incremental

def _day() -> Column:
    return F.lit("2024-01-31").cast("timestamp")


# ---- order-aware deduplication: the sequential pass as a recursion over the rows of part


def _pass(rows: str, keep: str, remember: str) -> str:
    """The SQL of a pass over ``rows`` (n from 1, seq, t, u); ``keep`` and ``remember`` see r.kept, r.seen and the row i."""
    return f"""WITH RECURSIVE rows AS ({rows}), r AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS kept, []::VARCHAR[] AS seen, NULL::BIGINT AS out
      UNION ALL SELECT i.n, CASE WHEN {keep} THEN list_append(r.kept, i.t) ELSE r.kept END, {remember}, CASE WHEN {keep} THEN i.seq END FROM r JOIN rows i ON i.n = r.n + 1)
      SELECT out AS seq FROM r WHERE out IS NOT NULL"""


_RATIO = "CASE WHEN lower(x) = lower(i.t) THEN 1.0 WHEN x = '' OR i.t = '' THEN 0.0 ELSE 1 - levenshtein(lower(x), lower(i.t)) / greatest(length(x), length(i.t))::DOUBLE END"
_JACCARD = "CASE WHEN x = '' OR i.t = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(i.t, '')))) / (len(list_distinct(string_split(x, ''))) + len(list_distinct(string_split(i.t, ''))) - len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(i.t, '')))))::DOUBLE END"
_NUMBERED = "row_number() OVER (ORDER BY p_partkey) AS n, p_partkey AS seq"


def _none(measure: str, relation: str, kept: str = "r.kept") -> str:
    return f"len(list_filter({kept}, lambda x: {measure} {relation})) = 0"


@query(_pass(f"SELECT {_NUMBERED}, p_name AS t, '' AS u FROM part", _none(_RATIO, ">= 0.7"), "r.seen"))
def greedy_edit_sequential(spark, d):
    """The pass by edit ratio over the names of part; ``greedy_edit_dedup`` is that over all first lines, which SQL cannot do in time."""
    return dedup.greedy(_t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("title")), "title", "seq", "edit", 0.7).select("seq")


@query(_pass(f"SELECT {_NUMBERED}, p_name || p_type AS t, '' AS u FROM part", _none(_JACCARD, "> 0.8"), "r.seen"))
def greedy_jaccard_sequential(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_name", "p_type").alias("title"))
    return dedup.greedy(rows, "title", "seq", "jaccard", 0.8, strict=True).select("seq")


_OLD_TITLES = "(SELECT list(DISTINCT lower(n_name) || ' ring') || ['small rinG', 'red bolt'] FROM nation)"


@query(_pass(f"SELECT {_NUMBERED}, p_name AS t, '' AS u FROM part", f"contains(i.t, 'r') AND {_none(_RATIO, '>= 0.75', _OLD_TITLES)} AND {_none(_RATIO, '>= 0.75')}", "r.seen"))
def greedy_existing_sequential(spark, d):
    """The pass with titles that are there already and a gate."""
    old = _t(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(" ring")).alias("title"))
    old = old.unionAll(spark.createDataFrame([("small rinG",), ("red bolt",)], "title string"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"))
    return dedup.greedy(rows, "title", "seq", "edit", 0.75, existing=old, gate=F.col("title").contains("r")).select("seq")


_REPORTS = f"SELECT {_NUMBERED}, p_name || ' ' || lower(p_type) AS t, p_brand || p_size AS u FROM part"


@query(_pass(_REPORTS, f"NOT list_contains(r.seen, i.u) AND i.u != 'Brand#1750' AND {_none(_RATIO, '>= 0.82')}", f"CASE WHEN NOT list_contains(r.seen, i.u) AND i.u != 'Brand#1750' AND {_none(_RATIO, '>= 0.82')} THEN list_append(r.seen, i.u) ELSE r.seen END"))
def report_merge(spark, d):
    """New reports: an address counts as seen only when its row is kept."""
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"), F.concat("p_brand", F.col("p_size").cast("string")).alias("url"))
    old = spark.createDataFrame([("Brand#1750", "nothing like the others, by far")], "url string, title string")
    return merge.merge_reports(rows, old).select("seq")


_ITEMS = f"SELECT {_NUMBERED}, CASE WHEN p_size IN (3, 10) THEN '' ELSE p_name || p_type END AS t, CASE WHEN p_size < 5 THEN '' ELSE p_brand || p_type END AS u FROM part"
_KEY = "CASE WHEN i.u != '' THEN 'u' || i.u WHEN i.t != '' THEN 't' || i.t END"
_FRESH = f"({_KEY} IS NULL OR NOT list_contains(r.seen, {_KEY}))"


@query(_pass(_ITEMS, f"{_FRESH} AND {_none(_JACCARD, '> 0.8')}", f"CASE WHEN {_KEY} IS NULL THEN r.seen ELSE list_append(r.seen, {_KEY}) END"))
def unique_archive_items(spark, d):
    """The archive pass: a row that falls for its title still keeps its address; rows without titles stay."""
    p = _t(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size").isin(3, 10), "").otherwise(F.concat("p_name", "p_type")).alias("title"), F.when(F.col("p_size") < 5, "").otherwise(F.concat("p_brand", "p_type")).alias("url"))
    return merge.unique_items(rows, threshold=0.8).select("seq")


_SHOWN = f"SELECT {_NUMBERED}, regexp_replace(lower(CASE WHEN p_size IN (7, 9) THEN '2026, 7!' ELSE p_name || ' ' || p_size END), '[\\s[:punct:]0-9]', '', 'g') AS t, '' AS u FROM part"


@query(_pass(_SHOWN, _none(_RATIO, "> 0.7"), "r.seen"))
def reader_titles(spark, d):
    """The reader's pass: titles without case, space, punctuation and digits; of those with nothing left the first stays."""
    title = F.when(F.col("p_size").isin(7, 9), "2026, 7!").otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")))
    return pipelines.distinct_titles(_t(spark, d, "part").select(F.col("p_partkey").alias("seq"), title.alias("title")), "seq").select("seq")


# ---- merges


@query("SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN '财经媒体' WHEN 'STANDARD' THEN '搜索引擎' ELSE p_type END AS source_type, CASE WHEN p_size > 10 AND p_size < 20 THEN 'industry' WHEN p_size >= 20 THEN 'claims' ELSE 'research' END AS category FROM part")
def retained_types(spark, d):
    """Old rows get today's names of types, and old research that is no report becomes industry."""
    kind = F.when(F.col("p_type") == "ECONOMY", "api").when(F.col("p_type") == "STANDARD", "baidu").otherwise(F.col("p_type"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("source_url"), kind.alias("source_type"), F.when(F.col("p_size") < 20, "research").otherwise("claims").alias("category"), F.lit("2024-01-30").alias("published_at"), F.lit(True).alias("date_verified"), (F.col("p_size") <= 10).alias("is_research_report"))
    return merge.retain(rows.where("false"), rows, F.lit("2024-01-31").cast("date")).select(F.col("seq").alias("id"), "source_type", "category")


@query(f"""SELECT item_id AS seq, substr(CASE WHEN item_id % 3 = 0 THEN '' ELSE split_part(text, chr(10), 1) || ' ' END || '关键数据：a' || item_id || '；b；c', 1, 300) AS summary, 'https://r.example/' || item_id AS source_url,
  CASE item_id % 3 WHEN 0 THEN '国际再保险巨头' WHEN 1 THEN '研究机构' ELSE '国内研究机构' END AS source_type, '养老金融' AS tags, 'I: ' || CASE item_id % 3 WHEN 0 THEN '国际再保险巨头' WHEN 1 THEN '行业' ELSE '国内研究机构' END AS reason FROM benchmark
  UNION ALL SELECT doc_id, 'kept', 'https://d.example/' || doc_id, NULL, NULL, NULL FROM documents""")
def registry_rows(spark, d):
    b = _t(spark, d, "benchmark")
    reports = b.select(
        F.col("item_id").alias("seq"), F.lit("t").alias("title"), F.lit("i").alias("institution"), F.lit("I").alias("institution_cn"), F.when(F.col("item_id") % 3 == 0, "reinsurance").when(F.col("item_id") % 3 == 1, "x").otherwise("domestic").alias("layer"), F.lit("pension_finance").alias("topic"),
        F.array(F.concat(F.lit("a"), F.col("item_id").cast("string")), F.lit("b"), F.lit("c"), F.lit("d")).alias("key_data"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.split("text", "\n")[0]).alias("key_insight"), F.concat(F.lit(" https://r.example/"), F.col("item_id").cast("string")).alias("url"), F.lit("2024").alias("publish_date"),
    )
    items = _t(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.lit("kept").alias("summary"), F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")).alias("source_url"))
    return merge.inject_registry(items, reports, reason="{institution}: {layer}").select("seq", "summary", "source_url", "source_type", "tags", "reason")


@query("SELECT c_custkey, c_acctbal > 0 OR c_nationkey < 10 AS curated FROM customer")
def curated_protection(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") >= 10, True).alias("auto"), F.when(F.col("c_acctbal") > 0, True).alias("curated"))
    return merge.protect_curated(rows).select("c_custkey", "curated")


@query("""WITH a AS (SELECT n_nationkey, n_name AS name, n_regionkey = 1 AS failed FROM nation), n AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
  SELECT name, CASE WHEN failed THEN 0 ELSE coalesce(n, 0) END AS count, NOT failed AND coalesce(n, 0) > 0 AS ok FROM a LEFT JOIN n ON n_nationkey = c_nationkey""")
def fetch_health(spark, d):
    """Sources that failed or gave nothing, told from those that gave rows."""
    n = _t(spark, d, "nation")
    attempts = n.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, "timeout").alias("error"))
    rows = _t(spark, d, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source_name"))
    return merge.fetch_health(attempts, rows)


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey != 1")
def sound_sources(spark, d):
    n = _t(spark, d, "nation")
    attempts = n.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, "timeout").alias("error"))
    rows = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("source_name"))
    return merge.of_sound_sources(rows, attempts).select("c_custkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_nationkey < 10 AND s_acctbal > 0)")
def queue_drain(spark, d):
    s = _t(spark, d, "supplier")
    return merge.drain(s, s.where("s_nationkey < 10 AND s_acctbal > 0")).select("s_suppkey", "s_name")


@query("SELECT doc_id, coalesce(quality, toxic) AS state FROM labels")
def renamed_state(spark, d):
    rows = _t(spark, d, "labels").select("doc_id", F.col("toxic").alias("old_key"), F.col("quality").alias("state"))
    return merge.renamed_keys(rows, "old_key", "state").select("doc_id", "state")


@query("SELECT doc_id AS id, source AS source_name FROM documents WHERE doc_id = 7")
def point_lookup(spark, d):
    return P.by_id(news(spark, d), 7).select("id", "source_name")


# ---- counts, orders, caps


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 3 > 0) AS verified, count(*) FILTER (event_id % 3 = 0) AS unverified, count(*) FILTER (value < 20) AS poor, count(*) FILTER (value >= 20 AND event_type = 'error') AS errors FROM events")
def verification_reasons(spark, d):
    rows = _t(spark, d, "events").select((F.col("event_id") % 3 > 0).alias("date_verified"), "value", "event_type")
    return rollup.verification(rows, {"poor": F.col("value") < 20, "errors": F.col("event_type") == "error"})


@query(f"""WITH {CLASSED}, s AS (SELECT source_name, count(*) AS n FROM classed GROUP BY 1 ORDER BY n DESC, source_name LIMIT 10), c AS (SELECT category, count(*) AS n FROM classed GROUP BY 1)
  SELECT '2024-01-31' AS date, (SELECT count(*) FROM classed) AS total_items, (SELECT string_agg(source_name || '=' || n, ',' ORDER BY source_name) FROM s) AS sources, (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM c) AS categories""")
def quality_snapshot(spark, d):
    """The record of a day: metrics beside the counts by source and by category."""
    rows = classed(spark, d)
    out = rollup.snapshot(rollup.gate(rollup.metrics(rows, ["ouea"])), rollup.counts(rows, "source_name"), rollup.counts(rows, "category"), "2024-01-31")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("date", "total_items", listed("source_distribution").alias("sources"), listed("category_distribution").alias("categories"))


@query(f"WITH {NEWS} SELECT id FROM news ORDER BY published_at DESC, seq LIMIT 50")
def newest_first(spark, d):
    return select.newest(news(spark, d)).limit(50).select("id")


@query(f"WITH {NEWS} SELECT id FROM news WHERE ai_score >= 75")
def featured_items(spark, d):
    return select.featured(news(spark, d), "published_at", "ai_score", "seq", 75).select("id")


@query(f"WITH {NEWS} SELECT id FROM news QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY seq) <= 10")
def first_ten_of_feed(spark, d):
    return readers.first_of_feed(news(spark, d), "source_name", "seq").select("id")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def event_time_counts(spark, d):
    """The event-time rollup, over a table as over a stream."""
    rows = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.daily_counts(rows).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


# ---- readers


def _saved(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Text lines written below the shared folder; their path."""
    path = f"{Scratch(spark, name).root}/text"
    rows.write.text(path)
    return path


@query(f"WITH {NEWS} SELECT trim(title, ' \t\n\r') AS title, source_url AS link, trim(summary, ' \t\n\r') AS summary FROM news")
def feed_files(spark, d):
    """Documents written as feed items and read back."""
    rows = publish.rss_rows(news(spark, d).withColumn("ts", F.col("published_at").cast("timestamp")), SITE)
    path = f"{Scratch(spark, 'feed').root}/rss"
    publish.write_feeds(rows.withColumn("xml", F.regexp_replace("xml", "\n", "&#10;")), "id", path, '<rss version="2.0"><channel>', "</channel></rss>")
    return readers.rss_items(spark, path).select("title", "link", "summary")


@query("SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'own' ELSE coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), url) END AS source_name, CASE WHEN page_id % 4 = 0 THEN 't' ELSE '媒体' END AS source_type, CASE WHEN page_id % 5 = 0 THEN 70 ELSE 85 END AS authority FROM pages WHERE url != ''")
def inbox_defaults(spark, d):
    k = F.col("page_id")
    raw = _t(spark, d, "pages").select(k, "url", F.when(k % 3 == 0, "own").when(k % 3 == 1, "").alias("source_name"), F.when(k % 4 == 0, "t").alias("source_type"), F.when(k % 5 == 0, 70).alias("authority"))
    return readers.inbox_rows(raw).select("page_id", "url", "source_name", "source_type", "authority")


_CAND = "[' Insurance outlook & trends ', 'short', 'Reinsurance report 2026']"


@query(f"""SELECT page_id, i - 1 AS pos, trim(({_CAND})[i]) AS title, CASE WHEN i = 1 THEN 'https://a.example/x' WHEN i = 2 THEN 'https://b.example/p/q' ELSE 'https://b.example/p/r' END AS link
  FROM (SELECT page_id, unnest([1, 2, 3]) AS i FROM pages) WHERE page_id % 3 < 2 OR i != 1""")
def source_candidates(spark, d):
    """Feeds by kind, feeds by their head, and pages, whose link to themselves is none."""
    k = F.col("page_id") % 3
    items = "".join(f"<item><title>{t}</title><link>{u}</link></item>" for t, u in ((" Insurance outlook &amp; trends ", "https://a.example/x"), ("short", "https://b.example/p/q"), ("Reinsurance report 2026", "https://b.example/p/r")))
    page = "<a href='https://b.example/p/'>To this page</a><a href=\"q\">short</a> <a href='/p/r'>Reinsurance report 2026</a><a href='x'>abc</a>"
    body = F.when(k == 0, F.lit("<rdf>" + items + "</rdf>")).when(k == 1, F.lit("<?xml?><rss>" + items + "</rss>")).otherwise(F.lit(page))
    raw = _t(spark, d, "pages").select("page_id", F.lit("https://b.example/p").alias("url"), body.alias("body"), F.when(k == 0, "rss").otherwise("html").alias("kind"))
    return readers.source_candidates(raw).select("page_id", F.col("pos").cast("long").alias("pos"), "title", "link")


_TITLES = ["Insurance outlook 2026", "Weather report 2026", "保险白皮书", "Reinsurance annual report", ""]


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Insurance outlook 2026' WHEN 2 THEN '保险白皮书' ELSE 'Reinsurance annual report' END AS title, CASE event_type WHEN 'error' THEN 'domestic' ELSE 'consulting' END AS layer,
  CASE event_type WHEN 'error' THEN '国内研究' ELSE '全球咨询' END AS source_type, CASE event_id % 5 WHEN 3 THEN 'capital_reinsurance' ELSE 'product_innovation' END AS topic, '2024-01-31T00:00:00Z' AS publish_date, true AS auto FROM events WHERE event_id % 5 IN (0, 2, 3)""")
def report_rows(spark, d):
    k = F.col("event_id")
    rows = _t(spark, d, "events").select(
        F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (k % 5 + 1).cast("int")).alias("title"), F.concat(F.lit("https://x/"), k.cast("string")).alias("url"), F.lit("").alias("summary"), F.lit("").alias("published"), F.lit("I").alias("institution"), F.lit("机构").alias("institution_cn"),
        F.when(F.col("event_type") == "error", "domestic").otherwise(F.col("event_type")).alias("layer"),
    )
    return readers.report_rows(rows, _day()).select(F.substring_index("url", "/", -1).cast("long").alias("event_id"), "title", "layer", "source_type", "topic", "publish_date", "auto")


@query("""SELECT page_id, i AS pos, 'Insurance news of ' || page_id || ' and ' || i AS title, 'https://www.a.example/art/2024/1/' || i || '/x' || i || '.html' AS url, '2024-01-' || lpad(i::VARCHAR, 2, '0') AS published_at
  FROM (SELECT page_id, unnest(range(1, 13)) AS i FROM pages) WHERE i <= 10""")
def association_links(spark, d):
    """The first ten articles of a home page, each path once, dated by the path."""
    one = lambda i: F.concat(F.lit(f'<a class=k href="{"https://www.a.example" if i % 2 else ""}/art/2024/1/{i}/x{i}.html"> <b>Insurance</b> news of '), F.col("page_id").cast("string"), F.lit(f" and {i}</a>"))
    noise = F.lit('<a href="/art/2024/1/1/y.html">Insurance</a><a href="/other">Insurance of something</a><a href="/art/2024/1/1/z.html">Some other long title</a>')
    html = F.concat(F.lit('<a href="/art/2024/1/9/short.html">Insurance</a>'), *[one(i) for i in range(1, 13)], one(1), noise)
    rows = readers.association_links(_t(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "https://www.a.example", None, gate=lambda t: P.relevant(t, F.lit("")))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "url", "published_at")


@query("SELECT event_id, 'abcde' || json_extract_string(props, '$.k') AS title, repeat('c', 500) AS content, event_id % 2 = 0 AS date_verified FROM events")
def search_response_archive(spark, d):
    """The archive profile: titles of 5 characters, 500 of the content, a date or none."""
    item = F.concat(F.lit('{"result":{"cmsArticleWebOld":[{"title":"<em>abcde</em>'), F.get_json_object("props", "$.k"), F.lit('","content":"' + "c" * 600 + '","date":"'), F.when(F.col("event_id") % 2 == 0, "2024-01-01 00:00:00").otherwise(""), F.lit('","url":"u","mediaName":"m"},{"title":"abcd","content":"","date":"","url":"u","mediaName":"m"}]}}'))
    rows = _t(spark, d, "events").select("event_id", F.concat(F.lit("jQuery("), item, F.lit(")")).alias("body"))
    return readers.search_response(rows, least=5, size=500).select("event_id", F.regexp_replace("title", " ", "").alias("title"), "content", "date_verified")


@query("SELECT doc_id, substr(trim(text, ' \t\n\r'), 1, 500) AS content, '2024-01-31' AS published_at FROM documents WHERE contains(text, 'that') OR contains(text, 'heit')")
def broadcast_news(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("content"), F.lit("2024-01-31").alias("day"))
    return readers.broadcast_news(rows, keywords=["that", "heit"]).select("doc_id", "content", "published_at")


_HITS = [("https://x.example/1", "<em>Insurance</em> one title", "snippet <b>one</b>", "甲 3天前"), ("https://www.baidu.com/x", "own title of theirs", None, None), ("https://x.example/2", "tiny", None, None), ("https://x.example/3", "Second long title", "", "乙 2024-01-05 10:00")]


@query("""SELECT page_id, pos, CASE pos WHEN 0 THEN 'Insurance one title' WHEN 1 THEN 'Second long title' ELSE 'Third long title' END AS title, CASE pos WHEN 0 THEN 'snippet one' WHEN 1 THEN 'Second long title' ELSE 'Third long title' END AS content,
  CASE pos WHEN 0 THEN '甲' WHEN 1 THEN '乙' ELSE '百度新闻' END AS source_name, CASE pos WHEN 0 THEN '2024-01-28' WHEN 1 THEN '2024-01-05' ELSE '' END AS published_at, pos < 2 AS date_verified FROM (SELECT page_id, unnest([0, 1, 2]) AS pos FROM pages)""")
def search_page(spark, d):
    """The page of the first way shows a bar to robots on every second row, so the second way's counts."""
    html = "".join(f'<a class=r href="{u}">{t}</a>' + (f'<span class="c-color-text" id=x>{s}</span>' if s is not None else "") + (f'<span class="c-color-gray" id=y>{i}</span>' if i else "") for u, t, s, i in _HITS) + '<a href="https://x.example/4">Third long title</a>'
    ways = [F.when(F.col("page_id") % 2 == 0, F.lit("安全验证 " + html)).otherwise(F.lit(html)), F.lit(html)]
    rows = _t(spark, d, "pages").select("page_id", readers.first_open_page(ways, ["安全验证"]).alias("html"))
    return readers.search_page(rows, "page_id", _day()).select("page_id", F.col("pos").cast("long").alias("pos"), "title", "content", "source_name", "published_at", "date_verified")


@query("""SELECT page_id, pos, CASE pos WHEN 0 THEN '短短的题目' ELSE '保险业务一二三四五六七' END AS title, CASE pos WHEN 0 THEN '360快资讯' ELSE '360搜索' END AS source_name, CASE pos WHEN 0 THEN '2024-01-30' ELSE '' END AS published_at FROM (SELECT page_id, unnest([0, 1]) AS pos FROM pages)""")
def titled_links(spark, d):
    link = lambda u, t: f'<a href="{u}" target="_blank" class=x title="{t}">t</a>'
    html = link("https://www.360kuai.com/1", "短短的题目") + '<span class="a time b"><i>昨天</i></span>' + link("https://so.com/2", "保险业务一二三四五六七") + link("https://b.example/3", "保险业务一二三四五六七") + link("https://b.example/4", "别的什么一二三四五六七")
    rows = readers.titled_links(_t(spark, d, "pages").select("page_id", F.lit(html).alias("html")), "page_id", F.lit("理赔"), _day())
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "source_name", "published_at")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '公众号·财险观察' ELSE '微信公众号' END AS source_name, CASE event_id % 4 WHEN 0 THEN '2025-07-02' WHEN 2 THEN '2024-01-29' ELSE '' END AS published_at FROM events WHERE event_id % 4 != 1""")
def account_articles(spark, d):
    k = F.col("event_id") % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k + 1).cast("int"))
    rows = _t(spark, d, "events").select("event_id", F.lit("保险公司年报").alias("title"), pick("财险观察", "同城生活", None, "甲").alias("account"), pick("1751385600", "1751385600", None, "x").alias("epoch"), pick("昨天", "昨天", "2天前", "").alias("said"))
    return readers.account_articles(rows, _day()).select("event_id", "source_name", "published_at")


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id % 3 AS k FROM events WHERE event_id % 3 != 2) SELECT event_id, CASE k WHEN 0 THEN 'long title' ELSE 'title - with dash' END AS title, CASE k WHEN 0 THEN 'source' ELSE 'named' END AS source_name,
  CASE k WHEN 0 THEN '2026-07-02' ELSE '2026-07-03' END AS published_at FROM e WHERE rn <= 8""")
def feed_search(spark, d):
    k = F.col("event_id") % 3
    title = F.when(k == 0, "long title - source").when(k == 1, "title - with dash - other").otherwise("abcd")
    rows = _t(spark, d, "events").select("event_id", "user_id", title.alias("title"), F.lit("u").alias("link"), F.lit("").alias("description"), F.when(k == 0, "Thu, 02 Jul 2026 20:00:00 GMT").otherwise("Thu, 02 Jul 2026 20:00:00 +0000").alias("pubDate"), F.when(k == 1, "named").alias("source"))
    return readers.feed_search(rows, "user_id", "event_id", "Google新闻").select("event_id", "title", "source_name", "published_at")


# ---- stores and published forms


@query(f"WITH {NEWS} SELECT row_number() OVER (ORDER BY id) - 1 AS seq, id, title, source_url, ai_score FROM news")
def store_files(spark, d):
    """A collection written as one JSON document, over several files, and read back."""
    scratch = Scratch(spark, "store")
    rows = news(spark, d).select("seq", "id", "title", "source_url", "ai_score", "published_at")
    sources = _t(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.lit(80).alias("score"))
    publish.write_lines(publish.json_document({"news": (rows, "seq"), "sources": (sources, "seq")}, {"version": "2.2.14"}), f"{scratch.root}/lines", 3)
    return readers.section(readers.document_lines(spark, f"{scratch.root}/lines"), "news", schemas.NEWS).select("seq", "id", "title", "source_url", "ai_score")


@query(f"WITH {NEWS} SELECT id, 0::BIGINT AS stored, true AS known FROM news")
def store_default(spark, d):
    """Where no file is, the document without items: every item is new to it."""
    document = readers.store(spark, f"{Scratch(spark, 'none').root}/nothing.json")
    stored = readers.store_news(document).select(F.col("id").alias("old"))
    items = news(spark, d).select("id")
    new = items.join(stored, F.col("id") == F.col("old"), "left_anti").select("id")
    return new.join(document.select(F.size("news").cast("long").alias("stored"), F.col("source_health").isNotNull().alias("known")))  # with its single row


@query("SELECT item_id AS seq, split_part(text, chr(10), 1) AS title, CASE item_id % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision, CASE item_id % 3 WHEN 0 THEN DATE '2025-01-01' WHEN 1 THEN DATE '2025-03-01' ELSE DATE '2025-03-04' END AS publish_day FROM benchmark")
def registry_files(spark, d):
    """A registry written as JSON and read back, with the precision of its dates."""
    k = F.col("item_id") % 3
    row = F.struct(F.col("item_id").alias("n"), F.to_json(F.struct(F.split("text", "\n")[0].alias("title"), F.when(k == 0, "2025").when(k == 1, "2025-03").otherwise("2025-03-04").alias("publish_date"))).alias("v"))
    listed = _t(spark, d, "benchmark").agg(F.concat(F.lit('{"reports":['), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]), ","), F.lit("]}")).alias("value"))
    return readers.registry_reports(spark, _saved(spark, listed, "registry")).select("seq", "title", "precision", "publish_day")


@query(f"""WITH {NEWS}, t AS (SELECT *, row_number() OVER (ORDER BY id) AS position FROM news ORDER BY id LIMIT 12) SELECT position, title AS name, '{SITE}/#/news/' || id AS url, 'ListItem' AS type FROM t""")
def json_ld_items(spark, d):
    """The list that the page's structured data holds, read back from its text."""
    text = publish.json_ld(news(spark, d), SITE)
    graph = F.from_json("json_ld", "struct<`@graph`:array<string>>")["@graph"]
    listed = F.from_json(F.element_at(graph, 2), "struct<itemListElement:array<struct<`@type`:string,position:int,name:string,url:string>>>")["itemListElement"]
    return text.select(F.explode(listed).alias("e")).select(F.col("e.position").cast("long").alias("position"), F.col("e.name").alias("name"), F.col("e.url").alias("url"), F.col("e.@type").alias("type"))


@query(f"WITH {NEWS} SELECT '<url><loc>' || {_ESC.format('loc')} || '</loc>' || CASE WHEN lastmod IS NULL THEN '' ELSE '<lastmod>' || lastmod || '</lastmod>' END || '</url>' AS xml FROM (SELECT '{SITE}/' || p AS loc, NULL AS lastmod FROM (SELECT unnest({list(publish.PAGES)}) AS p) UNION ALL SELECT '{SITE}/#/news/' || id, published_at FROM news)")
def sitemap_xml(spark, d):
    return publish.sitemap_xml(publish.sitemap_rows(news(spark, d), SITE))


_ONE = "printf('%.1f', CAST(ai_score AS DOUBLE) / 10)"


@query(f"""WITH {CLASSED}, i AS (SELECT *, CASE category WHEN 'claims' THEN 'K' ELSE category END AS label FROM classed), c AS (SELECT *, min(seq) OVER (PARTITION BY category) AS first FROM i WHERE ai_score >= 70)
  SELECT 0 AS part, 0::BIGINT AS at, 0 AS line, '---' || chr(10) || 'layout: daily' || chr(10) || 'title: "Daily - 2024-01-31"' || chr(10) || 'date: 2024-01-31' || chr(10) || '---' || chr(10) || '# Daily' || chr(10) || chr(10) || '**2024-01-31** · ' || (SELECT count(*) FROM c) || ' / ' || (SELECT count(*) FROM i) || chr(10) AS text
  UNION ALL SELECT 1, 0, 0, '## ⭐ (' || count(*) || ')' || chr(10) FROM i WHERE ai_score >= 90
  UNION ALL SELECT 2, seq, 0, '### [' || title || '](' || source_url || ')' || chr(10) || '**' || {_ONE} || '** | ' || source_name || ' | ' || label || chr(10) || chr(10) || substr(summary, 1, 200) || chr(10) || chr(10) || '> ' || chr(10) || chr(10) || '---' || chr(10) FROM c WHERE ai_score >= 90
  UNION ALL SELECT 3, min(seq), -1, '## ' || label || chr(10) FROM c GROUP BY label
  UNION ALL SELECT 3, first, CAST(seq AS INT), '### [' || title || '](' || source_url || ')' || chr(10) || '**' || {_ONE} || '** | ' || source_name || ' | ' || published_at || chr(10) || chr(10) || substr(summary, 1, 150) || chr(10) || chr(10) || '---' || chr(10) FROM c""")
def daily_document(spark, d):
    items = classed(spark, d).select("seq", "title", F.col("source_url").alias("url"), F.col("summary").alias("content"), "source_name", "category", "published_at", (F.col("ai_score") / 10).alias("ai_score"), F.lit(None).cast("string").alias("ai_reason"))
    out = publish.daily_document(items, "2024-01-31", {"claims": "K"}, 7.0, 9.0)
    return out.select("place.part", "place.at", "place.line", F.col("line").alias("text"))


@query("SELECT n_nationkey, n_name FROM nation")
def table_snapshot(spark, d):
    """A table copied and restored."""
    root = Scratch(spark, "copy").root
    _t(spark, d, "nation").write.parquet(f"{root}/a")
    publish.copy_table(spark, f"{root}/a", f"{root}/b")
    return spark.read.parquet(f"{root}/b").select("n_nationkey", "n_name")


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1")
def date_partitions(spark, d):
    """Records written by date, a date that is written again replaced as a whole."""
    root = f"{Scratch(spark, 'dates').root}/t"
    rows = rollup.counts(_t(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date")), "date").withColumnRenamed("count", "n")
    publish.write_by_date(rows.withColumn("n", F.col("n") + 1), root)
    publish.write_by_date(rows, root)
    return spark.read.schema("n long, date string").parquet(root).select("date", "n")
