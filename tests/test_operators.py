import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn import lexicon as L, queries, schemas
from cairn.functions import dates, text as X
from cairn.operators import classify as C, dedup, merge, predicates as P, rollup, select
from cairn.plans import pipelines, publish
from cairn.scratch import Scratch
from cairn.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def of(spark, f, *values):
    """f of each text, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "a, b, ratio",
    [
        ("太保寿险发布智能核保引擎时效缩至30秒", "太保寿险推出智能核保引擎时效缩至30秒", 0.8947), ("Global insurance M&A hits record in 2026", "Global insurance M&A hit record in 2026", 0.9750),
        ("保险日报：2026上半年行业回顾", "保险日报：2026上半年行业回顾与展望", 0.8421), ("国家金融监管总局发布AI大模型合规应用指引", "金融监管总局发布保险AI大模型合规指引", 0.7143), ("insurance market update 2026", "insurance market report 2026", 0.8214), ("", "非空", 0.0), ("", "", 1.0),
    ],
)
def test_edit_ratio(spark, a, b, ratio):
    assert one(spark, F.round(X.edit_ratio(F.lit(a), F.lit(b)), 4))[0] == ratio


def test_relevance(spark):
    yes = ["Reinsurance News: Treaty renewals slow in 2026", "AI transforms underwriting at insurers", "个人养老金制度扩围"]
    no = ["Fatal Boat Capsizing Claims Three Lives", "Trump Ramps Up War on Regulations With 702 Cuts in Pipeline", "Local Council Approves New Parking Policy"]
    assert of(spark, lambda c: P.relevant(c, F.lit("")), *yes, *no, None) == [True] * 3 + [False] * 4


def test_topics(spark):
    cases = {"AI 大模型重塑智能核保": "ai_intelligent", "个人养老金第三支柱提速": "pension_finance", "UBI 车险产品创新上线": "product_innovation", "银保渠道转型加速": "channel_transformation", "巨灾债券 ILS 扩容": "capital_reinsurance", "气候巨灾保险指数化": "climate_catastrophe", "保险科技核心系统升级": "digital_transformation", "监管办法落地合规收紧": "regulatory_change", "一条无关新闻标题": None}
    assert of(spark, lambda c: C.most_hits(c, F.lit(""), L.TOPICS_DAILY), *cases) == list(cases.values())


def test_cascade(spark):
    cases = {"监管办法出台 合规处罚": "regulation", "新品上线 产品发布": "product", "理赔案例 纠纷判决": "claims", "行业会议如期举行": "industry", "we define finance": "industry", "a fine of ten": "regulation", "Lawsuit settled": "claims"}
    assert of(spark, lambda c: C.category_cascade(c, F.lit("")), *cases) == list(cases.values())


def test_scores(spark):
    assert one(spark, C.boosted_score(F.lit("AI"), F.lit("pension"), F.lit(99)), C.boosted_score(F.lit("x"), F.lit(""), F.lit(10)), C.boosted_score(F.lit("solvency product"), F.lit(""), F.lit(70))) == (95, 60, 77)
    today = F.lit("2026-07-02").cast("date")
    score = lambda day, verified, report=False: one(spark, C.additive_score(F.lit("监管"), F.lit("x" * 250), F.lit("甲"), F.lit(day), F.lit(verified), F.lit(report), today)[0].cast("double"))[0]
    assert score("2026-07-02", True) == 7.2 and score("2026-07-02", False) == 3.7 and score("2099-12-31", True) < 7 and score("2020-01-01", True) < 7
    assert score("2026-07-02", False, True) - score("2026-07-02", False) == 1.5


def test_weak_classes(spark):
    rows = spark.createDataFrame([(i, "x" if i < 2 else "y", 9.5) for i in range(5)], "i int, category string, ai_score double")
    assert [r["ai_score"] for r in C.weak_class_bonus(rows).orderBy("i").collect()] == [10.0, 10.0, 9.5, 9.5, 9.5]


def test_clean(spark):
    assert of(spark, X.clean_markup_first, "<em>保险</em> 新闻", "保险   新闻\n\t测试", "a<b>c", "&lt;x&gt;") == ["保险 新闻", "保险 新闻 测试", "a c", "<x>"]
    assert of(spark, X.clean_references_first, "a<b>c", "&lt;x&gt;y") == ["ac", "y"]
    assert of(spark, X.unescape, "&eacute;&#x4e2d;&amp;") == ["é中&"]


def test_dates(spark):
    ok = {"2026-07-02": "2026-07-02", "2026-07-02T10:30:00+08:00": "2026-07-02", "2026-7-2": "2026-07-02", "  2026-07-02  ": "2026-07-02", "2026/7/2": "2026-07-02", "2024年3月2日": "2024-03-02", "2024年3月2": "2024-03-02"}
    bad = ["2026-13-45", "2026-02-30", "2026-00-01", "2026-12-00", "", "not a date", "10:30:00"]
    assert of(spark, dates.parse_date, *ok, *bad) == [*ok.values(), *[None] * 7]
    as_of = F.lit("2026-07-10").cast("date")
    said = {"3小时前": "2026-07-10", "23小时前": "2026-07-10", "今天": "2026-07-10", "今日": "2026-07-10", "25小时前": None, "9999小时前": None, "3天前": "2026-07-07", "昨天": "2026-07-09", "前天": "2026-07-08", "发布于 2026-07-02 15:30": "2026-07-02", "3月15日": "2026-03-15", "13月45日": None, "0月15日": None}
    assert of(spark, lambda c: dates.date_in_text(c, as_of), *said) == list(said.values())
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert of(spark, lambda c: dates.iso_from_rfc822(c, now), "Thu, 02 Jul 2026 10:00:00 +0800", "Thu, 02 Jul 2026 10:00:00 GMT", "", "bad") == ["2026-07-02T02:00:00Z", "2026-07-02T10:00:00Z", "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z"]
    page = '<head><meta property="article:published_time" content="2026-07-02T10:30:00"></head>'
    assert one(spark, dates.page_date(F.lit(page), F.lit("")), dates.page_date(F.lit("x"), F.lit("http://a/20260703/b")), dates.page_date(F.lit("2026年7月4日"), F.lit(""))) == ("2026-07-02", "2026-07-03", "2026-07-04")


def test_addresses(spark):
    assert of(spark, X.safe_url, " https://a.b ", "HTTP://x", "ftp://a", "javascript:x", "", None) == ["https://a.b", "HTTP://x", "", "", "", ""]
    assert of(spark, lambda c: P.is_blocked(c, F.lit("")), "https://www.zhihu.com/x", "https://baike.baidu.com/", "https://finance.sina.com.cn", None) == [True, True, False, False]
    assert of(spark, lambda c: P.is_blocked(F.lit(""), c), "知乎", "百度百科", "新浪") == [True, True, False]
    assert of(spark, X.literal_host_is_public, "http://127.0.0.1/", "http://10.1.1.1", "http://169.254.1.1/x", "http://0.0.0.0", "http://8.8.8.8/", "http://a.b") == [False, False, False, False, True, None]
    assert one(spark, X.absolute_url(F.lit("https://a.b/c"), F.lit("/d")), X.absolute_url(F.lit("https://a.b/c/"), F.lit("e")), X.absolute_url(F.lit("https://a.b"), F.lit("http://f"))) == ("https://a.b/d", "https://a.b/c/e", "http://f")
    assert of(spark, X.bump_version, "2.2.13", "2.2", "a.b.c") == ["2.2.14", "2.3.0", "2.3.0"]


def test_noise(spark):
    assert of(spark, P.is_stock_noise, "保险板块拉升", "中国平安涨停", "保险科技板块拉升", "", None) == [True, True, False, False, False]
    assert of(spark, P.is_search_noise, "中国平安官方网站", "保险计算器", "保险新闻", None) == [True, True, False, False]


def test_jaccard(spark):
    j = lambda a, b: one(spark, X.character_jaccard(F.lit(a), F.lit(b)))[0]
    assert j("保险", "保险") == 1 and j("保险监管新规发布", "保险监管新规出台") > 0.5 and j("保险", "天气") == 0 and j("", "a") == 0


def test_reports(spark):
    assert of(spark, lambda c: P.is_report(c, F.lit("报告"), F.lit("")), "瑞士再保险", "麦肯锡", "Swiss Re Institute", "某博客") == [True, True, True, False]
    assert of(spark, C.report_layer, "劳合社", "Accenture", "头豹研究院", "新浪财经") == ["reinsurance", "consulting", "domestic", ""]


def test_checksum(spark):
    assert one(spark, X.checksum(F.lit("保险")), X.pick(F.lit("保险"), ["a", "b", "c", "d"])) == (58950, "c")


def test_reason(spark):
    themes = [(["solvency"], "S", ["c1", "c2"]), (["ai"], "A", ["c3"])]
    said = C.reason(F.col("v"), F.lit(""), F.lit("某协会"), F.lit(""), F.lit("claims"), F.lit(93), themes, {}, {"claims": "K"}, ["{label}: {clause}"], ["[{ccat}] {clause}"], ["!"], {"industry": "v", "claims": "w"})
    assert of(spark, lambda c: said, "AI b") == ["据某协会披露，A: c3!"]
    assert of(spark, lambda c: said, "zz")[0].startswith("据某协会披露，[K] w")


def greedy(titles, ratio):
    kept = []
    for i, t in enumerate(titles):
        if t and not any(ratio(t, titles[k]) for k in kept):
            kept.append(i)
    return kept


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_greedy(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdé保险", k=r.randint(1, 22))) for _ in range(25)]
    titles = []
    for _ in range(90):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abcdeé")
        titles.append("".join(t))
    titles += ["", titles[0], titles[3].upper()]
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    edit = lambda a, b: 1 - lev(a.lower(), b.lower()) / max(len(a), len(b)) >= 0.7
    assert sorted(r["seq"] for r in dedup.greedy(rows, "title", "seq", "edit", 0.7).collect()) == greedy(titles, edit)
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > 0.5
    assert sorted(r["seq"] for r in dedup.greedy(rows, "title", "seq", "jaccard", 0.5, strict=True).collect()) == greedy(titles, jac)


@pytest.mark.parametrize("threshold,kind", [(0.82, "edit"), (0.7, "edit"), (0.55, "edit"), (0.9, "jaccard")])
def test_similar_pairs(spark, threshold, kind):
    """Against all pairs, with lengths at which the width of the grams changes."""
    r = random.Random(7)
    texts = set()
    for _ in range(25):
        base = r.choices("abcdé日", k=r.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 30]))
        for _ in range(5):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 4)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 1)] = r.choices("abcdé日", k=r.randint(0, 1)) if len(t) > 1 else ["a"]
            texts.add("".join(t))
    texts = sorted(texts - {""}, key=lambda t: r.random())
    ratio = (lambda a, b: 1 - lev(a, b) / max(len(a), len(b))) if kind == "edit" else (lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)))
    want = {(i, j): ratio(a, b) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if ratio(a, b) >= threshold}
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {(p["i"], p["j"]): p["similarity"] for p in dedup.similar_pairs(rows, "t", "i", kind, threshold).collect()}
    assert len(want) > 5 and got == pytest.approx(want)
    assert dedup.similar_pairs(rows.where("false"), "t", "i", kind, threshold).isEmpty()


def test_edit_threshold(spark):
    with pytest.raises(ValueError):
        dedup.similar_pairs(spark.createDataFrame([(0, "a")], "i long, t string"), "t", "i", "edit", 0.5)


def test_greedy_is_no_component(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "i long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "i long, j long")
    assert sorted(r["i"] for r in dedup.first_independent(nodes, pairs).collect()) == [1, 3, 4]


def test_greedy_of_long_chains(spark):
    nodes = spark.range(12).withColumnRenamed("id", "i")
    pairs = spark.range(11).selectExpr("id AS i", "id + 1 AS j")
    assert sorted(r["i"] for r in dedup.first_independent(nodes, pairs).collect()) == list(range(0, 12, 2))


@pytest.mark.parametrize("seed", range(1))
def test_merge_reports(spark, seed):
    """Against the pass that counts an address as seen only when its row is kept."""
    r = random.Random(seed)
    names = ["".join(r.choices("abcdef ", k=14)).strip() + "x" for _ in range(12)]
    rows = []
    for i in range(70):
        t = list(r.choice(names))
        if r.random() < 0.5:
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((i, f"u{r.randint(0, 25)}" if r.random() < 0.95 else "", "".join(t) if r.random() < 0.95 else ""))
    old = [("u3", "zzzz"), ("v", names[0])]
    urls, titles, kept = {u for u, _ in old}, [t for _, t in old], []
    for i, u, t in rows:
        if u and t and u not in urls and not any(1 - lev(t.lower(), x.lower()) / max(len(t), len(x)) >= 0.82 for x in titles):
            kept.append(i)
            urls.add(u)
            titles.append(t)
    batch = spark.createDataFrame(rows, "seq long, url string, title string")
    assert sorted(x["seq"] for x in merge.merge_reports(batch, spark.createDataFrame(old, "url string, title string")).collect()) == kept
    assert merge.merge_reports(batch.where("false"), batch).count() == 0


def test_rows_without_titles(spark):
    rows = [(0, "", ""), (1, None, None), (2, "u", ""), (3, "u", "title one"), (4, "", "title one"), (5, "v", "title one!"), (6, "w", None), (7, "", "title one")]
    items = spark.createDataFrame(rows, "seq long, url string, title string")
    assert sorted(r["seq"] for r in merge.unique_items(items).collect()) == [0, 1, 2, 4, 6]
    shown = spark.createDataFrame([(0, "2026"), (1, "!!"), (2, "A b"), (3, "a-B 7")], "seq long, title string")
    assert sorted(r["seq"] for r in pipelines.distinct_titles(shown, "seq").collect()) == [0, 2]


def test_greedy_gate_and_existing(spark):
    rows = spark.createDataFrame([(0, "insurance market report one"), (1, "weather forecast for today"), (2, "insurance market report two")], "seq long, title string")
    old = spark.createDataFrame([("insurance market report twO",)], "title string")
    keep = lambda **k: sorted(r["seq"] for r in dedup.greedy(rows, "title", "seq", "edit", 0.82, **k).collect())
    assert keep() == [0, 1] and keep(gate=~F.col("title").contains("weather")) == [0] and keep(existing=old) == [1]


def test_whole_titles(spark, tmp_path):
    r = random.Random(5)
    start = "".join(r.choices("abcdefgé保 ", k=90))
    base = [start + "".join(r.choices("abcdéñß ", k=r.randint(0, 60))) for _ in range(6)] + ["保险市场报告", "Les marchés à terme", "la señal", "Größe"]
    titles = []
    for _ in range(60):
        t = list(r.choice(base))
        for _ in range(r.randint(0, len(t) // 8)):
            t[r.randrange(len(t))] = r.choice("xyzé")
        titles.append("".join(t))
    spark.createDataFrame([(k, f"{t}\nmore that", "en", "s", len(t)) for k, t in enumerate(titles)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, f"{titles[7]}\nx"), (1, base[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: [tuple(x) for x in queries.queries()[name](spark, str(tmp_path)).collect()]
    edit = lambda a, b: 1 - lev(a.lower(), b.lower()) / max(len(a), len(b))
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for name, ratio, low, least in (("edit_pairs_whole", edit, str.lower, 0.82), ("jaccard_pairs_whole", jac, str, 0.9)):
        first = {}
        for k, t in enumerate(titles):
            first.setdefault(low(t), k)
        rows = sorted((k, t) for t, k in first.items())
        assert sorted(run(name)) == [(i, j, round(ratio(a, b), 6)) for i, a in rows for j, b in rows if i < j and ratio(a, b) >= least]
    assert sorted(x for (x,) in run("greedy_edit_dedup")) == greedy(titles, lambda a, b: edit(a, b) >= 0.82)
    old = [titles[7], base[3]]
    free = [k for k, t in enumerate(titles) if any(w.lower() in f"{t}\nmore that".lower() for w in L.SAMPLE_TERMS) and not any(edit(t, o) > 0.7 for o in old)]
    assert sorted(x for (x,) in run("greedy_against_existing")) == [free[k] for k in greedy([titles[k] for k in free], lambda a, b: edit(a, b) > 0.7)]


def test_quota(spark):
    q = lambda rows: select.quota(spark.createDataFrame(rows, "t string, score double, seq long"), "t", "score", "seq").count()
    assert q([("a", float(i), i) for i in range(40)]) == 15
    assert q([(f"t{i % 12}", float(i), i) for i in range(36)]) == 36
    assert q([(f"t{i % 3}", float(i), i) for i in range(60)]) == 30


def test_days(spark):
    rows = spark.createDataFrame([("2026-07-01T1", "a", "s", "u", 79), ("2026-07-01", "b", "r", "", 80), ("2026-07-01", "a", "s", "u", 81), (None, "a", "s", "u", 1), ("", "a", "s", "u", 1)], "published_at string, category string, source_name string, source_url string, ai_score int")
    (r,) = rollup.days(rows).collect()
    assert (r["total"], r["curated"], r["highlights"], float(r["avg_score"]), r["categories"], r["sources"]) == (3, 2, 2, 80.0, {"a": 2, "b": 1}, ["r", "s"])


def test_gate(spark):
    m = "category_diversity long, source_diversity long, max_single_source_pct double, stock_noise_count long"
    rows = spark.createDataFrame([(5, 63, 25.5, 3), (5, 44, 16.3, 0), (None, 44, 16.3, 0)], m)
    assert [r["pass"] for r in rollup.gate(rows).collect()] == [False, True, False]
    empty = rollup.metrics(spark.createDataFrame([], "category string, source_name string, ai_score int, title string")).first().asDict()
    assert empty["total_items"] == 0 and empty["avg_score"] == 0 and empty["min_category_count"] == 0


def test_fallbacks(spark):
    rows = spark.createDataFrame([(1, "2020-01-01", True), (2, "2020-01-02", True)], "i long, published_at string, date_verified boolean")
    assert P.fresh(rows, F.lit("2026-07-01").cast("date")).count() == 2
    more = rows.union(spark.createDataFrame([(3, "2026-06-30", True), (4, "", True), (5, "2020-01-01", None)], rows.schema))
    assert sorted(r["i"] for r in P.fresh(more, F.lit("2026-07-01").cast("date")).collect()) == [3, 4, 5]


def test_reports_by_layer_is_whole(spark):
    rows = spark.createDataFrame([(k, ["domestic", "consulting", "reinsurance", None, "x"][k % 5], "t" if k % 7 else "u") for k in range(300)], "seq long, layer string, topic string")
    got = select.reports_by_layer(rows, "t", name="place").orderBy("place").collect()
    order = {"reinsurance": 0, "consulting": 1, "domestic": 2}
    want = sorted((order.get(r["layer"], 3), r["seq"]) for r in rows.collect() if r["topic"] == "t")
    assert [r["seq"] for r in got] == [seq for _, seq in want] and [r["place"] for r in got] == list(range(1, len(want) + 1))


def test_pages_and_numbers(spark):
    rows = spark.range(45)
    assert [r["id"] for r in select.page(rows, [F.col("id")], 9).collect()] == list(range(40, 45))
    assert select.page(rows.limit(0), [F.col("id")], 3).count() == 0
    assert [(r["id"], r["n"]) for r in select.numbered(rows, [F.desc("id")], "n").orderBy("n").collect()] == [(44 - i, i + 1) for i in range(45)]


def test_health(spark):
    mk = lambda rows: spark.createDataFrame(rows, "name string, count long, ok boolean")
    out = merge.merge_health(mk([("a", 1, False), ("b", 2, True)]), mk([("a", 9, True), ("d", 0, False)]), mk([("a", 5, None), ("c", 7, None)]).select("name", "count"))
    assert {r["name"]: (r["count"], r["ok"]) for r in out.collect()} == {"a": (5, True), "b": (2, True), "c": (7, True), "d": (0, False)}


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"reports": [{"id": "1", "title": "t", "institution": "i", "layer": "domestic", "topic": "ai_intelligent", "key_data": ["a", "b", "c", "d"], "key_insight": "k", "url": "https://x", "publish_date": "2025-01"}, {"id": "2", "title": "u", "key_data": "", "url": "", "publish_date": "2025"}, {"id": "3", "title": "v", "url": "#"}]}', "utf-8")
    reports = readers.registry_reports(spark, str(tmp_path))
    assert [(r["key_data"], r["precision"], str(r["publish_day"])) for r in reports.orderBy("seq").collect()][:2] == [(["a", "b", "c", "d"], "month", "2025-01-01"), (None, "year", "2025-01-01")]
    items = spark.createDataFrame([(0, "t0", "https://y", "claims")], "seq long, title string, source_url string, category string")
    out = merge.inject_registry(items, reports)
    assert sorted((r["source_url"], r["summary"]) for r in out.where("category = 'research'").collect()) == [("#", ""), ("https://x", "k 关键数据：a；b；c")]


def test_health_of_fetches(spark):
    attempts = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "name string, error string")
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "source_name string")
    assert {r["name"]: (r["count"], r["ok"]) for r in merge.fetch_health(attempts, rows).collect()} == {"a": (2, True), "b": (0, False), "c": (0, False)}
    assert sorted(r["source_name"] for r in merge.of_sound_sources(rows, attempts).collect()) == ["a", "a", "z"]


def test_drain(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1)], "url string, authority int")
    assert [r["url"] for r in merge.drain(rows, rows.where("url = 'a'")).collect()] == ["b"]


def test_feeds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link>http://a</link><description>d</description><pubDate>x</pubDate></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="http://b"/><link href="http://c"/><updated>2026</updated></entry></feed>')
    assert [tuple(r) for r in readers.feed(spark, str(tmp_path / "rss.xml")).collect()] == [("A & B", "http://a", "d", "x")]
    assert [tuple(r) for r in readers.feed(spark, str(tmp_path / "atom.xml")).collect()] == [("T", "http://b", "", "2026")]


def test_page_head(spark):
    html = '<meta property="og:title" content="O"><title>T</title><meta name="description" content="D">'
    rows = spark.createDataFrame([(html,), ("<title>only</title>",)], "html string")
    assert [(r["title"], r["description"]) for r in readers.page_head(rows).collect()] == [("O", "D"), ("only", "only")]


def test_publish(spark):
    assert publish.inject("a<!--s-->x<!--e-->b", "<!--s-->", "<!--e-->", r"\1 \n") == r"a<!--s-->\1 \n<!--e-->b"
    with pytest.raises(ValueError):
        publish.inject("a", "s", "e", "c")
    rows = spark.createDataFrame([(i, f"t{i}", "s", "2026-07-01") for i in range(20)], "id long, title string, summary string, published_at string")
    assert publish.json_ld(rows, "https://x").first()[0].count("position") == 12
    assert publish.sitemap_rows(rows, "https://x").count() == 28


def test_daily(spark):
    batch = spark.createDataFrame([(i, t, "", "S", "媒体", f"http://x/{i}", f"2026-07-0{i % 3 + 1}", 80, True) for i, t in enumerate(["Reinsurance treaty renewals slow", "Reinsurance treaty renewal slows", "Parking policy", "个人养老金制度扩围"])], "seq long, title string, summary string, source_name string, source_type string, source_url string, published_at string, authority int, gated boolean")
    old = spark.createDataFrame([(100, "Old item of insurance", "s", "S", "u", "2026-06-01", 70)], "seq long, title string, summary string, source_name string, source_url string, published_at string, ai_score int")
    out = pipelines.daily(batch, old)
    assert sorted(r["seq"] for r in out["news"].collect()) == [0, 3, 100] and sorted(r["id"] for r in out["news"].collect()) == [1, 2, 3]
    assert out["days"].agg(F.sum("total")).first()[0] == 3


def test_archive(spark):
    rows = [(i, t, f"http://u/{i}", "内容" * 20, s, "api", "2026-07-01", True, "", "zh") for i, (t, s) in enumerate([("保险监管新规发布", "甲"), ("保险监管新规发布了", "乙"), ("中国平安涨停", "丙"), ("理赔服务调解", "知乎"), ("人工智能算法模型", "丁")])]
    raw = spark.createDataFrame(rows, "seq long, " + schemas.RAW_ITEM)
    raw = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9]) for r in rows], "seq long, title string, url string, content string, source_name string, source_type string, published_at string, date_verified boolean, category_hint string, language string")
    day = F.lit("2026-07-02").cast("date")
    scored = pipelines.archive(raw, day)
    assert sorted((r["seq"], r["category"]) for r in scored.collect()) == [(0, "regulation"), (4, "industry")]
    old = spark.createDataFrame([(900, "o", "s", "S", "t", "http://old", 70, "", "research", "2026-07-01", True, "", False), (901, "p", "s", "S", "t", "http://older", 70, "", "claims", "2026-01-01", True, "", False)], "seq long, title string, summary string, source_name string, source_type string, source_url string, ai_score int, tags string, category string, published_at string, date_verified boolean, research_topic string, is_research_report boolean")
    reports = spark.createDataFrame([(5000, "R", "i", "国", "domestic", "ai_intelligent", ["a"], "k", "https://r", "2025")], "seq long, title string, institution string, institution_cn string, layer string, topic string, key_data array<string>, key_insight string, url string, publish_date string")
    out = pipelines.archive_output(scored, old, reports, day).orderBy("id").collect()
    # today's items stand by score, as the day's choice is sorted before it is stored
    by_score = [(r["url"], r["category"]) for r in sorted(scored.collect(), key=lambda r: (-r["ai_score"], r["seq"]))]
    assert sorted(by_score) == [("http://u/0", "regulation"), ("http://u/4", "industry")]
    assert [(r["id"], r["source_url"], r["category"]) for r in out] == [(1, *by_score[0]), (2, *by_score[1]), (3, "http://old", "industry"), (4, "https://r", "research")]


def test_lexicon(spark):
    t = L.table(spark)
    assert t.where("rule_set = 'gate'").count() == 93 and t.where("match_mode = 'word'").count() == 1 and t.where("rule_set = 'search_noise' AND match_mode = 'regex'").count() == 28


def test_incremental(spark, tmp_path):
    from cairn.streaming import incremental

    src = tmp_path / "in"
    for k, titles in enumerate([["insurance market report", "insurance market reports"], ["insurance market report!", "weather"]]):
        spark.createDataFrame([(k * 10 + i, t) for i, t in enumerate(titles)], "seq long, title string").coalesce(1).write.mode("append").json(str(src))
        stream = spark.readStream.schema("seq long, title string").json(str(src))
        incremental.ingest(stream, str(tmp_path / "table"), str(tmp_path / "cp"), "seq long, title string").awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [0, 11]


def test_scratch(spark):
    s = Scratch(spark, "t")
    assert s.save(spark.range(3), "x").count() == 3


def test_shared_folder(spark, monkeypatch):
    from cairn import scratch

    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"applicationId": "none", "master": "local[2]"})

    assert scratch.shared_folder(Unset) == scratch.shared_folder(Unset)

    class Cluster(Unset):
        sparkContext = type("S", (), {"applicationId": "none", "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.shared_folder(Cluster)
