"""Registered queries of the pipelines put together: the daily run, the archive's output and what a reader sees, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import pipelines
from cairn.queries import _any, _hits, _t, query
from cairn.queries_flows import _NUMBERED, _RATIO, _SHOWN, _none, _pass

# ---- the daily run: part as a day's batch, suppliers and some earlier titles as the collection

_TERMS = ["ring", "bolt", "gear"]
_TOPICS = {"first": ["ring", "economy"], "second": ["bolt", "small", "gear"]}
_CASCADE = [("claims", ["ring"]), ("product", ["bolt"]), ("research", ["supplier"])]
_BOOSTS = [(["ring"], 6), (["standard"], 9), (["promo", "economy"], 15)]
_WORDING = dict(themes=[(["gear"], "G", ["one", "two", "three"])], hints={}, category_names={"claims": "K"}, theme_openers=["A: {clause}", "B {label}: {clause}"], category_openers=["C {ccat} {clause}"], tails=["!"], values={"industry": "v", "claims": "w"})

_BATCH = """SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey AS seq, p_name || ' ' || p_type || ' ' || p_brand AS t, '' AS u FROM part"""
_OLD = "(SELECT list(DISTINCT upper(p_name || ' ' || p_type || ' ' || p_brand) || '!') FROM part WHERE p_partkey % 50 = 7)"
_OPEN = f"(i.seq % 5 = 0 OR {_any('lower(i.t)', _TERMS)} OR i.seq % 3 != 0 AND {_any('lower((SELECT p_type FROM part WHERE p_partkey = i.seq))', _TERMS)})"
_KEPT = _pass(_BATCH, f"{_OPEN} AND {_none(_RATIO, '>= 0.9', _OLD)} AND {_none(_RATIO, '>= 0.9')}", "r.seen").replace("WITH RECURSIVE ", "", 1).rsplit("SELECT out AS seq", 1)[0]
_TEXT = "lower(title || ' ' || said)"
_CAT = lambda text: f"CASE WHEN {_any(text, ['ring'])} THEN 'claims' WHEN {_any(text, ['bolt'])} THEN 'product' WHEN {_any(text, ['supplier'])} THEN 'research' ELSE 'industry' END"
_CHECKSUM = "coalesce(list_sum(list_transform(string_split(title, ''), lambda c: unicode(c))), 0)"
_REASON = (
    "CASE WHEN own != '' THEN own ELSE trim(CASE WHEN kind = '协会' THEN '据' || source_name || '披露，' ELSE '' END || CASE WHEN " + _any(_TEXT, ["gear"]) + f" THEN list_extract(['A: ', 'B G: '], CAST({_CHECKSUM} % 2 AS INT) + 1) || list_extract(['one', 'two', 'three'], CAST({_CHECKSUM} % 3 AS INT) + 1) "
    "ELSE 'C ' || CASE cat WHEN 'claims' THEN 'K w' ELSE '行业动态 v' END END || CASE WHEN score >= 92 THEN '!' ELSE '' END) END"
)
_DAILY = f"""WITH RECURSIVE {_KEPT}, b AS (SELECT p.*, p_name || ' ' || p_type || ' ' || p_brand AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS said, CASE p_size % 4 WHEN 0 THEN '协会' ELSE '媒体' END AS kind, p_brand AS source_name, CASE WHEN p_size = 7 THEN 'own' ELSE '' END AS own
    FROM part p JOIN r ON r.out = p.p_partkey),
  s AS (SELECT *, {_CAT(_TEXT)} AS cat, CAST(least(95, greatest(60, 70 + CASE WHEN {_any(_TEXT, ['ring'])} THEN 6 ELSE 0 END + CASE WHEN {_any(_TEXT, ['standard'])} THEN 9 ELSE 0 END + CASE WHEN {_any(_TEXT, ['promo', 'economy'])} THEN 15 ELSE 0 END)) AS INT) AS score,
    {_hits(_TEXT, _TOPICS['first'])} AS t1, {_hits(_TEXT, _TOPICS['second'])} AS t2 FROM b),
  fresh AS (SELECT p_partkey AS seq, 1 AS new, title, CASE WHEN said = '' THEN title ELSE said END AS summary, source_name, kind AS source_type, 'http://x/' || p_partkey AS source_url, score AS ai_score, CAST(DATE '2024-01-01' + p_size AS VARCHAR) AS published_at, {_REASON} AS reason,
    CASE WHEN greatest(t1, t2) = 0 THEN 'product_innovation' WHEN t1 >= t2 THEN 'first' ELSE 'second' END AS research_topic FROM s),
  old AS (SELECT s_suppkey AS seq, 0 AS new, s_name AS title, 'known' AS summary, 'Brand#' || s_suppkey % 30 AS source_name, 'old' AS source_type, CASE WHEN s_suppkey % 2 = 0 THEN 'http://s/' || s_suppkey ELSE '' END AS source_url, 75 AS ai_score, CAST(DATE '2024-01-01' + CAST(s_suppkey % 40 AS INT) AS VARCHAR) AS published_at, NULL::VARCHAR AS reason, NULL::VARCHAR AS research_topic FROM supplier
    UNION ALL SELECT 1000000 + p_partkey, 0, upper(p_name || ' ' || p_type || ' ' || p_brand) || '!', 'known', 'Brand#1', 'old', 'http://o/' || p_partkey, 75, '2024-01-05', NULL::VARCHAR, NULL::VARCHAR FROM part WHERE p_partkey % 50 = 7),
  every AS (SELECT * FROM old UNION ALL SELECT * FROM fresh), news AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, new, seq) AS id, {_CAT("lower(title || ' ' || summary)")} AS category FROM every)"""


def _run(spark, d) -> dict:
    p, s = _t(spark, d, "part"), _t(spark, d, "supplier")
    key, title = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    batch = p.select(
        key.alias("seq"), title.alias("title"), F.when(key % 3 == 0, "").otherwise(F.col("p_type")).alias("summary"), F.col("p_brand").alias("source_name"), F.when(F.col("p_size") % 4 == 0, "协会").otherwise("媒体").alias("source_type"), F.concat(F.lit("http://x/"), key.cast("string")).alias("source_url"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string").alias("published_at"), F.lit(70).alias("authority"), (key % 5 != 0).alias("gated"), F.when(F.col("p_size") == 7, "own").otherwise("").alias("reason"),
    )
    n = F.col("s_suppkey")
    old = s.select(
        n.alias("seq"), F.col("s_name").alias("title"), F.lit("known").alias("summary"), F.concat(F.lit("Brand#"), (n % 30).cast("string")).alias("source_name"), F.lit("old").alias("source_type"), F.when(n % 2 == 0, F.concat(F.lit("http://s/"), n.cast("string"))).otherwise("").alias("source_url"),
        F.lit(75).alias("ai_score"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 40).cast("int")).cast("string").alias("published_at"),
    )
    said = p.where("p_partkey % 50 = 7").select(
        (key + 1000000).alias("seq"), F.concat(F.upper(title), F.lit("!")).alias("title"), F.lit("known").alias("summary"), F.lit("Brand#1").alias("source_name"), F.lit("old").alias("source_type"), F.concat(F.lit("http://o/"), key.cast("string")).alias("source_url"), F.lit(75).alias("ai_score"), F.lit("2024-01-05").alias("published_at"),
    )
    known = spark.createDataFrame([("Brand#1", "known", 90), ("Gone", "x", 70)], "name string, type string, score int")
    health = spark.createDataFrame([("Brand#2", 1, True), ("Gone", 5, False)], "name string, count long, ok boolean")
    fetched = spark.createDataFrame([("Brand#3", 9, True), ("Silent", 0, False)], "name string, count long, ok boolean")
    return pipelines.daily(batch, old.unionByName(said), _TERMS, _TOPICS, _CASCADE, _BOOSTS, 0.9, wording=_WORDING, sources=known, health=health, fetched=fetched, version="2.2.9", as_of=F.lit("2024-02-20").cast("date"))


@query(f"{_DAILY} SELECT id, seq, title, summary, source_url, ai_score, category, reason, research_topic FROM news")
def daily_run(spark, d):
    return _run(spark, d)["news"].select("id", "seq", "title", "summary", "source_url", "ai_score", "category", "reason", "research_topic")


@query(f"{_DAILY} SELECT published_at[1:10] AS day, count(*) AS total, count(*) FILTER (source_url != '') AS curated, count(*) FILTER (ai_score >= 80) AS highlights, CAST(round(avg(ai_score), 1) AS DOUBLE) AS avg_score, count(*) FILTER (category = 'claims') AS claims, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources FROM news GROUP BY 1")
def daily_run_days(spark, d):
    out = _run(spark, d)["days"]
    return out.select("day", "total", "curated", "highlights", F.col("avg_score").cast("double").alias("avg_score"), F.coalesce(F.col("categories")["claims"], F.lit(0)).alias("claims"), F.array_join("sources", ",").alias("sources"))


@query(f"""{_DAILY} SELECT 'Brand#1' AS name, 'known' AS type, 90 AS score, NULL AS last_update UNION ALL SELECT 'Gone', 'x', 70, NULL UNION ALL SELECT source_name, arg_min(source_type, id), 80, '2024-02-20' FROM news WHERE source_name != 'Brand#1' GROUP BY 1""")
def daily_run_sources(spark, d):
    return _run(spark, d)["sources"].select("name", "type", "score", "last_update")


@query(f"""{_DAILY}, c AS (SELECT source_name AS name, count(*) AS n FROM news GROUP BY 1) SELECT name, CASE WHEN name = 'Silent' THEN 0 WHEN name = 'Gone' THEN 5 WHEN name = 'Brand#2' THEN 1 WHEN name = 'Brand#3' THEN coalesce(n, 9) ELSE n END AS count, name NOT IN ('Silent', 'Gone') AS ok, '2.2.10' AS version
  FROM (SELECT name FROM c UNION SELECT unnest(['Silent', 'Gone', 'Brand#2', 'Brand#3'])) LEFT JOIN c USING (name)""")
def daily_run_health(spark, d):
    out = _run(spark, d)
    return out["health"].crossJoin(out["version"])  # with its single row


# ---- the archive's output: orders as scored items, customers as the collection, suppliers as the register

_SCORED = """i AS (SELECT o_orderkey AS seq, 'o' || o_orderkey AS title, o_orderpriority AS source_type, (o_orderkey * 7 % 51 + 50) AS tenths, CASE WHEN o_orderkey % 9 = 0 THEN 'ftp://x' ELSE 'https://o.example/' || o_orderkey END AS url, o_orderstatus AS category FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY tenths DESC, seq) AS rn, first_value(tenths) OVER (PARTITION BY source_type ORDER BY tenths DESC, seq) AS top_tenths, first_value(seq) OVER (PARTITION BY source_type ORDER BY tenths DESC, seq) AS top_seq FROM i),
  n AS (SELECT count(*) AS n FROM r WHERE rn <= 3), f AS (SELECT *, row_number() OVER (ORDER BY tenths DESC, seq) AS p FROM r WHERE rn BETWEEN 4 AND 15),
  c AS (SELECT *, 0 AS p FROM r WHERE rn <= 3 UNION ALL SELECT f.* FROM f, n WHERE p <= 30 - n),
  t AS (SELECT 0 AS part, row_number() OVER (ORDER BY tenths DESC, rn <= 3 DESC, CASE WHEN rn <= 3 THEN top_tenths END DESC, CASE WHEN rn <= 3 THEN -top_seq END DESC, CASE WHEN rn <= 3 THEN rn END, seq) AS at_, title, CASE WHEN url LIKE 'https%' THEN url ELSE '#' END AS source_url, CAST(tenths AS INT) AS ai_score, category, 'why ' || title AS reason FROM c WHERE tenths >= 60)"""
_RETAINED = """o AS (SELECT 1 AS part, c_custkey AS at_, c_name AS title, CASE WHEN c_custkey % 11 = 0 THEN '#' ELSE 'https://c.example/' || c_custkey % 1000 END AS source_url, 70 AS ai_score, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 != 0 THEN 'industry' WHEN c_custkey % 4 = 0 THEN 'research' ELSE 'claims' END AS category, NULL AS reason FROM customer
    WHERE c_custkey % 3 = 0 AND CAST(DATE '2024-01-31' - CAST(c_custkey % 9 AS INT) AS VARCHAR)[1:10] >= '2024-01-28' OR c_custkey % 3 = 1),
  k AS (SELECT part, min(at_) AS at_, arg_min(title, at_) AS title, source_url, arg_min(ai_score, at_) AS ai_score, arg_min(category, at_) AS category, NULL AS reason FROM o WHERE source_url NOT IN (SELECT source_url FROM t) GROUP BY part, source_url),
  g AS (SELECT 2 AS part, s_suppkey AS at_, s_name AS title, 'https://r.example/' || s_suppkey AS source_url, 95 AS ai_score, 'research' AS category, 'I/' || CASE s_suppkey % 2 WHEN 0 THEN '国内研究机构' ELSE '行业' END AS reason FROM supplier),
  m AS (SELECT * FROM t UNION ALL SELECT * FROM k UNION ALL SELECT * FROM g), q AS (SELECT *, category = 'research' AS late, row_number() OVER (PARTITION BY category = 'research' ORDER BY part, at_) AS rank FROM m)"""


@query(f"WITH {_SCORED}, {_RETAINED} SELECT row_number() OVER (ORDER BY late, part, at_) AS id, title, source_url, ai_score, category, replace(reason, 'I/', '权威研究报告：I，') AS reason FROM q WHERE rank <= CASE WHEN late THEN 19 ELSE 81 END")
def archive_run_output(spark, d):
    """The day's balanced choice in its order, what is retained, and the register, capped and numbered."""
    key = F.col("o_orderkey")
    scored = _t(spark, d, "orders").select(
        key.alias("seq"), F.concat(F.lit("o"), key.cast("string")).alias("title"), F.when(key % 9 == 0, "ftp://x").otherwise(F.concat(F.lit("https://o.example/"), key.cast("string"))).alias("url"), F.lit("text").alias("content"), F.lit("S").alias("source_name"), F.col("o_orderpriority").alias("source_type"),
        ((key * 7 % 51 + 50).cast("decimal(6,1)") / 10).cast("decimal(4,1)").alias("ai_score"), F.array().cast("array<string>").alias("ai_tags"), F.col("o_orderstatus").alias("category"), F.lit("2024-01-31").alias("published_at"), F.lit(True).alias("date_verified"), F.lit("").alias("research_topic"), F.lit(False).alias("is_research_report"),
        F.concat(F.lit("why o"), key.cast("string")).alias("ai_reason"),
    )
    c = F.col("c_custkey")
    day = F.when(c % 3 == 2, "").otherwise(F.date_sub(F.lit("2024-01-31").cast("date"), (c % 9).cast("int")).cast("string"))
    old = _t(spark, d, "customer").select(
        c.alias("seq"), F.col("c_name").alias("title"), F.lit("S").alias("source_name"), F.lit("api").alias("source_type"), F.when(c % 11 == 0, "#").otherwise(F.concat(F.lit("https://c.example/"), (c % 1000).cast("string"))).alias("source_url"), F.lit(70).alias("ai_score"),
        F.when(c % 4 == 0, "research").otherwise("claims").alias("category"), day.alias("published_at"), (c % 3 == 0).alias("date_verified"), (c % 8 == 0).alias("is_research_report"),
    )
    s = F.col("s_suppkey")
    reports = _t(spark, d, "supplier").select(
        s.alias("seq"), F.col("s_name").alias("title"), F.lit("i").alias("institution"), F.lit("I").alias("institution_cn"), F.when(s % 2 == 0, "domestic").otherwise("x").alias("layer"), F.lit("t").alias("topic"), F.array(F.lit("a")).alias("key_data"), F.lit("k").alias("key_insight"), F.concat(F.lit("https://r.example/"), s.cast("string")).alias("url"), F.lit("2024").alias("publish_date"),
    )
    return pipelines.archive_output(scored, old, reports, F.lit("2024-01-31").cast("date")).select("id", "title", "source_url", "ai_score", "category", "reason")


# ---- what a reader sees of part: near-equal titles once, then searched, labelled and grouped

_SEEN = _pass(_SHOWN, _none(_RATIO, "> 0.7"), "r.seen").replace("WITH RECURSIVE ", "", 1).rsplit("SELECT out AS seq", 1)[0]
_ITEMS = f"""WITH RECURSIVE {_SEEN}, v AS (SELECT p_partkey AS id, p_brand AS source_name, p_type AS summary, CASE p_size % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'claims' ELSE 'other' END AS category, CAST(40 + p_partkey % 60 AS INT) AS ai_score, CAST(TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 1 DAY * (p_partkey % 400) AS TIMESTAMP) AS ts,
    CASE WHEN p_size IN (7, 9) THEN '2026, 7!' ELSE p_name || ' ' || p_size END AS title FROM part WHERE p_partkey IN (SELECT out FROM r)),
  found AS (SELECT * FROM v WHERE contains(lower(title), 'r') OR contains(lower(summary), 'r') OR contains(lower(source_name), 'r'))"""


def _served(spark, d, keyword: str = "r") -> dict:
    p, key = _t(spark, d, "part"), F.col("p_partkey")
    title = F.when(F.col("p_size").isin(7, 9), "2026, 7!").otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")))
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-31 06:00:00").cast("timestamp")) - (key % 400) * 86400)
    news = p.select(
        key.alias("id"), title.alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("source_name"), F.when(F.col("p_size") % 3 == 0, "product").when(F.col("p_size") % 3 == 1, "claims").otherwise("other").alias("category"),
        (F.lit(40) + key % 60).cast("int").alias("ai_score"), F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.lit("").alias("tags"),
    )
    reports = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 2 == 0, "t").otherwise("u").alias("topic"), F.when(F.col("s_suppkey") % 3 == 0, "domestic").when(F.col("s_suppkey") % 3 == 1, "consulting").otherwise("x").alias("layer"))
    return pipelines.serve(news, reports, keyword, topic="t", as_of=F.lit("2024-01-31 12:00:00").cast("timestamp"))


@query(f"""{_ITEMS}, l AS (SELECT *, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-31' THEN '今天' ELSE month(ts) || '/' || day(ts) || '日' END AS label, row_number() OVER (ORDER BY ts DESC, ai_score DESC, id) AS n FROM found WHERE ai_score >= 60),
  g AS (SELECT label, dense_rank() OVER (ORDER BY min(n)) AS "group" FROM l GROUP BY label) SELECT id, label, "group", row_number() OVER (ORDER BY "group", n) AS place FROM l JOIN g USING (label)""")
def served_featured(spark, d):
    return _served(spark, d)["featured"].select("id", "label", F.col("group").cast("long").alias("group"), F.col("place").cast("long").alias("place"))


@query(f"{_ITEMS} SELECT id, category, row_number() OVER (ORDER BY CASE category WHEN 'product' THEN 1 ELSE 2 END, id) AS rank FROM v WHERE category != 'other'")
def served_daily(spark, d):
    """The day's paper: all shown items of the known categories, numbered through."""
    return _served(spark, d)["daily"].select("id", "category", "rank")


@query("SELECT s_suppkey AS seq FROM supplier WHERE s_suppkey % 2 = 0")
def served_reports(spark, d):
    return _served(spark, d)["reports"].select("seq")
