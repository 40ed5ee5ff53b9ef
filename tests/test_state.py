"""Kept days, keyword automata, address ranges and redirects against plain versions."""

import ipaddress
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from cairn import lexicon as L
from cairn.operators import addresses as A, classify as C, predicates as P, rollup
from cairn.operators.day_store import DayStore, keep_days
from cairn.operators.keywords import Keywords, classified
from cairn.plans import pipelines
from cairn.functions import dates

ITEM = "seq long, published_at string, category string, source_name string, source_url string, ai_score int"


def items(seed, n):
    r = random.Random(seed)
    day = lambda: r.choice(["2026-07-01", "2026-07-02T08:00:00Z", "2026-07-03", "", None])
    return [(i, day(), r.choice(["claims", "product", None]), r.choice(["a", "b", "é", "", None]), r.choice(["u", "", None]), r.choice([60, 79, 80, 95, None])) for i in range(n)]


def plain(rows):
    return sorted((r["day"], r["total"], r["curated"], r["highlights"], str(r["avg_score"]), tuple(sorted(r["categories"].items())), tuple(r["sources"])) for r in rows.collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1, 1)])
def test_days_in_any_order(spark, tmp_path, order):
    rows = spark.createDataFrame(items(1, 90), ITEM)
    store = DayStore(spark, str(tmp_path / "days"))
    assert store.days().count() == 0
    for k in order:
        store.add(rows.where(F.col("seq") % 3 == k), k)
    assert plain(store.days()) == plain(rollup.days(rows))


def test_days_of_other_days_stay(spark, tmp_path):
    """A batch rewrites the days that it has, and a repeated one counts once."""
    store = DayStore(spark, str(tmp_path / "days"))
    rows = spark.createDataFrame([(0, "2026-07-01", "claims", "a", "u", 90), (1, "2026-07-02", "claims", "a", "u", 90)], ITEM)
    store.add(rows, 1)
    files = lambda day: sorted(p.name for p in (tmp_path / "days" / f"day={day}").iterdir() if p.suffix == ".parquet")
    was = files("2026-07-01"), files("2026-07-02")
    late = spark.createDataFrame([(2, "2026-07-02", "product", "b", "", 70)], ITEM)
    for _ in range(2):
        store.add(late, 2)
    assert files("2026-07-01") == was[0] and files("2026-07-02") != was[1]
    assert plain(store.days()) == plain(rollup.days(rows.unionByName(late)))
    store.add(late.where("false"), 3)
    assert plain(store.days()) == plain(rollup.days(rows.unionByName(late)))


def test_days_of_a_stream(spark, tmp_path):
    source, every = str(tmp_path / "in"), []
    for k in range(3):
        every.append(spark.createDataFrame(items(10 + k, 20), ITEM))
        every[-1].coalesce(1).write.mode("append").parquet(source)
        keep_days(spark.readStream.schema(ITEM).parquet(source), str(tmp_path / "days"), str(tmp_path / "cp")).awaitTermination()
    assert plain(DayStore(spark, str(tmp_path / "days")).days()) == plain(rollup.days(every[0].unionAll(every[1]).unionAll(every[2])))


TEXTS = ["AI 大模型重塑智能核保", "个人养老金第三支柱提速", "监管办法出台 合规处罚", "we define finance", "a fine was paid. LAW", "lawful motorway", "fine", "İSTANBUL claims", "nothing", "", None, "motor_law green-house green", "理赔欺诈案例 claim"]


def test_keywords_are_the_rules_one_by_one(spark):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choices([w for t in TEXTS if t for w in t.split()] + L.STRONG_TERMS, k=6)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "i int, title string, summary string")
    words = Keywords(L.table(spark), "daily")
    got = classified(rows, words, authority=F.lit(70))
    t, s = F.col("title"), F.col("summary")
    want = got.select("i", P.relevant(t, s).alias("relevant"), C.most_hits(t, s, L.TOPICS_DAILY).alias("topic"), C.category_cascade(t, s).alias("category"), C.boosted_score(t, s, F.lit(70)).alias("score"))
    assert sorted(map(tuple, got.select("i", "relevant", "topic", "category", "score").collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") + plan.count("ArrowEvalPython(") <= 1 or plan.count("ArrowEvalPython") == 1


def test_keyword_rows(spark):
    words = Keywords(L.table(spark).where("rule_set IN ('topic', 'category')"), "daily")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = words.rows(rows.select("i", words.found(F.lower("t")).alias("found")), "i", "found").collect()
    want = {(i, r["rule_set"], r["label"], r["ord"]) for i, t in enumerate(TEXTS) for r in words.rules if t and r["match_mode"] == "substring" and r["keyword"].lower() in t.lower()}
    whole = {(r["rule_set"], r["label"], r["ord"]) for r in words.rules if r["match_mode"] == "word"}
    assert {(r["i"], r["rule_set"], r["label"], r["ord"]) for r in got if (r["rule_set"], r["label"], r["ord"]) not in whole} == want and len(got) == len(set(map(tuple, got)))
    assert {r["i"] for r in got if r["keyword"] == "fine" and r["rule_set"] == "category"} == {4, 6}
    with pytest.raises(ValueError):
        Keywords(L.table(spark), "daily", most_bytes=10)
    none = Keywords(L.table(spark).where("false"))
    assert [tuple(r) for r in rows.limit(1).select(none.any(none.found(F.col("t")), "gate"), none.most(none.found(F.col("t")), "topic"), none.first(none.found(F.col("t")), "x", "d")).collect()] == [(False, None, "d")]


def is_public(text):
    try:
        a = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast)


def test_addresses(spark):
    """Against the standard library, at both ends of every range and beside them."""
    r = random.Random(6)
    texts = ["", "x", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::ffff:10.0.0.1", "::FFFF:8.8.8.8", "::ffff:0808:0808", "64:ff9b::1.2.3.4", "2001:db8::1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "8.8.8.8 ", "100.64.0.1"]
    for net in map(ipaddress.ip_network, L.CLOSED_RANGES + L.OPEN_RANGES):
        for n in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1):
            if 0 <= n < 2**net.max_prefixlen:
                texts.append(str(ipaddress.ip_address(n) if net.version == 4 and n < 2**32 else ipaddress.IPv6Address(n)))
    texts += [str(ipaddress.IPv4Address(r.randrange(2**32))) for _ in range(200)] + [ipaddress.IPv6Address(r.randrange(2**128)).exploded for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, address string")
    got = {r["i"]: r["public"] for r in A.with_public(rows, A.ranges(spark)).collect()}
    assert {t: got[i] for i, t in enumerate(texts) if got[i] != is_public(t)} == {} and got[len(texts)] is False
    hosts = spark.createDataFrame([("a", "8.8.8.8"), ("a", "2606:4700::1"), ("b", "8.8.8.8"), ("b", "10.0.0.1"), ("c", None), ("d", "1.1.1.1")], "host string, address string")
    assert {r["host"]: r["public"] for r in A.public_hosts(hosts, A.ranges(spark)).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_redirects(spark):
    r = random.Random(8)
    url = lambda i: f"https://{'in.example' if i % 13 == 5 else 'S.example:80'}/a/{i}"
    answers = {}
    for i in range(80):
        if i % 11 != 7:
            status = r.choice([200, 301, 302, 303, 307, 308, 404, 302, 302, 301])
            answers[url(i)] = (status, r.choice(["", None, "ftp://x", "http://[::1]/", "?q=1"] if i % 6 == 0 else [url(r.randrange(80)), f"/a/{r.randrange(80)}", f"{r.randrange(80)}", f"../a/./{r.randrange(80)}"]) if status in A.REDIRECTS else None)
    hosts = {"s.example": True, "in.example": False}

    def follow(u):
        def good(x):
            x = (x or "").strip()
            return x.lower().startswith(("http://", "https://")) and hosts.get((x.split("/")[2].split(":")[0] if "[" not in x else "::1").lower(), False)

        if not good(u):
            return None, 0, "unsafe"
        at, hops = u, 0
        for k in range(5):
            if at not in answers:
                return None, hops, "missing"
            status, location = answers[at]
            if status == 200:
                return at, hops, "page"
            if status not in A.REDIRECTS or not location:
                return None, hops, "failed"
            at, hops = urljoin(at, location), hops + 1
            if k == 4:
                return None, hops, "too many"
            if not good(at):
                return None, hops, "unsafe"

    urls = [url(i) for i in range(82)] + ["", "ftp://s.example/", None]
    got = A.followed(
        spark.createDataFrame([(u,) for u in urls + urls[:3]], "url string"), spark.createDataFrame([(u, s, x) for u, (s, x) in answers.items()], "url string, status int, location string"),
        spark.createDataFrame(list(hosts.items()), "host string, public boolean"),
    ).collect()
    assert sorted(((r["url"], r["final_url"], r["hops"], r["outcome"]) for r in got), key=repr) == sorted(((u, *follow(u)) for u in urls), key=repr)
    assert {r["outcome"] for r in got} >= {"page", "unsafe", "missing", "failed", "too many"}


def test_article_dates(spark):
    body = '<meta property="article:published_time" content="2026-07-02">'
    long = "保" * 30000 + body
    urls = spark.createDataFrame([(u,) for u in ("https://a/1", "https://a/2/20260705/x", "https://a/3", "https://a/4", "https://b/5")], "url string")
    rows = [("https://a/1", 302, "/9", None), ("https://a/9", 200, None, body.encode()), ("https://a/2/20260705/x", 200, None, b"\xe4\xbf"), ("https://a/3", 200, None, long.encode()), ("https://a/4", 404, None, body.encode()), ("https://b/5", 200, None, body.encode())]
    responses = spark.createDataFrame(rows, "url string, status int, location string, body binary")
    hosts = spark.createDataFrame([("a", True), ("b", False)], "host string, public boolean")
    got = {r["url"]: r["published_at"] for r in A.article_dates(urls, responses, hosts).collect()}
    assert got == {"https://a/1": "2026-07-02", "https://a/2/20260705/x": "2026-07-05", "https://a/3": None, "https://a/4": None, "https://b/5": None}


def test_labels(spark):
    now = F.lit("2026-07-10 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([(1, "2026-07-10 08:00:00"), (2, "2026-07-03 08:00:00"), (3, "2025-07-03 08:00:00"), (4, "2026-07-09 00:00:00"), (5, None)], "id int, t string").withColumn("ts", F.to_timestamp("t"))
    from cairn.operators import select

    got = select.by_date_label(rows, "ts", now, [F.desc("ts"), F.col("id")]).orderBy("place").collect()
    assert [(r["id"], r["label"], r["group"]) for r in got] == [(1, "今天", 1), (4, "7/9日", 2), (2, "7/3日", 3), (3, "7/3日", 3), (5, None, 4)]
    assert rows.where("id = 2").select(dates.relative_time(F.col("ts"), now), dates.format_time(F.col("ts"))).first() == ("7/3日", "08:00")


def test_daily_records(spark):
    columns = "seq long, title string, summary string, source_name string, source_type string, source_url string, published_at string, authority int, gated boolean, reason string"
    batch = spark.createDataFrame([(1, "Reinsurance treaty renewals slow", "", "S", "协会", "http://x/1", "2026-07-01", 80, True, None), (2, "Parking policy", "", "T", "媒体", "http://x/2", "2026-07-02", 80, False, "given"), (3, "Parking policy!", "", "U", "媒体", "http://x/3", "2026-07-02", 80, False, "")], columns)
    old = spark.createDataFrame([(100, "Old item of insurance", "s", "S", "u", "2026-07-01", 70)], "seq long, title string, summary string, source_name string, source_url string, published_at string, ai_score int")
    wording = dict(themes=[(["treaty"], "T", ["clause"])], hints={}, category_names={"industry": "I"}, theme_openers=["{label}: {clause}"], category_openers=["{ccat}"], tails=["!"], values={"industry": "v"})
    known = spark.createDataFrame([("S", "known", 90)], "name string, type string, score int")
    fetched = spark.createDataFrame([("S", 7, True), ("V", 0, False)], "name string, count long, ok boolean")
    out = pipelines.daily(batch, old, wording=wording, sources=known, fetched=fetched, version="2.2.9", as_of=F.lit("2026-07-03").cast("date"))
    news = {r["seq"]: r for r in out["news"].collect()}
    assert sorted(news) == [1, 2, 100] and {s: r["id"] for s, r in news.items()} == {2: 1, 100: 2, 1: 3}
    assert news[1]["reason"] == "据S披露，T: clause" and news[2]["reason"] == "given"
    assert sorted((r["name"], r["type"], r["score"]) for r in out["sources"].collect()) == [("S", "known", 90), ("T", "媒体", 80)]
    assert sorted(map(tuple, out["health"].collect())) == [("S", 2, True), ("T", 1, True), ("V", 0, False)]
    assert out["version"].first()[0] == "2.2.10"
