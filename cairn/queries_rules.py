"""Registered queries of row rules: every event is given one of a list of stated inputs, and its SQL the stated result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from cairn import lexicon as L
from cairn.functions import dates, text as X
from cairn.operators import classify as C, predicates as P
from cairn.queries import Q, SQL, _t
from cairn.sources import readers


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def stated(name: str, rule: Callable[..., Column], cases: list[tuple]) -> None:
    """Register a rule over the inputs of each case, whose last value is the result."""
    n = len(cases)

    def run(spark, d):
        rows = _t(spark, d, "events").select("event_id", (F.col("event_id") % n + 1).cast("int").alias("k"))
        inputs = [F.element_at(F.array(*[F.lit(c[i]).cast("string") for c in cases]), F.col("k")) for i in range(len(cases[0]) - 1)]
        rows = rows.select("event_id", *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
        return rows.select("event_id", rule(*[F.col(f"in{i}") for i in range(len(inputs))]).alias("out"))

    Q[name] = run
    SQL[name] = f"SELECT event_id, CASE event_id % {n} " + " ".join(f"WHEN {i} THEN {_literal(c[-1])}" for i, c in enumerate(cases)) + " END AS out FROM events"


stated("report_title", P.is_report_title, [
    ("Annual insurance Outlook 2026", True), ("sigma 3/2026", True), ("保险行业年度报告", True), ("蓝皮书发布", True), ("Weather today", False), ("", False), (None, False), ("Market SURVEY", True), ("车险测算", True),
])
stated("stock_noise", P.is_stock_noise, [
    ("保险板块拉升", True), ("中国平安涨停", True), ("保险科技板块拉升", False), ("", False), (None, False), ("保险板块午后上行", True), ("保险板块平稳", False), ("融资客加仓", True), ("偿付能力达标 股价涨停", False), ("保险监管新规", False),
])
stated("search_noise", P.is_search_noise, [("中国平安官方网站", True), ("保险计算器", True), ("第12页", True), ("第页", False), ("理赔服务", True), ("理赔服务升级", False), ("保险测评第3期", True), ("保险新闻", False), (None, False), ("", False)])
stated("search_noise_by_channel", lambda t, c: c.isin(L.SEARCH_CHANNELS) & P.is_search_noise(t), [("保险官网", c, c in ("baidu", "google", "360", "sogou", "bing")) for c in ("baidu", "google", "360", "sogou", "bing", "wechat", "api", "web")])
stated("search_hit_precedence", lambda u, t: P.is_search_hit(u, t, F.lit("理赔")), [
    ("https://www.360kuai.com/a", "短", True), ("https://news.so.com/a", "保险业务一二三四五六七", False), ("https://a.cn/x", "保险业务一二三四五六七", True), ("https://a.cn/x", "保险业务", False), ("https://a.cn/x", "车险理赔一二三四五六七", True), ("https://a.cn/x", "别的什么一二三四五六七", False),
])
stated("public_literal_host", X.literal_host_is_public, [
    ("http://127.0.0.1/", False), ("http://10.1.1.1", False), ("http://169.254.1.1/x", False), ("http://0.0.0.0", False), ("http://8.8.8.8/", True), ("http://a.b", None), ("http://172.16.0.1/", False), ("http://172.32.0.1:80/", True), ("http://192.168.1.1", False), ("http://100.64.0.1", True), ("http://192.0.2.1", False), ("http://192.0.0.9/", True), ("http://192.0.0.8/", False), ("http://198.19.255.255", False), ("http://198.20.0.0", True), ("http://255.255.255.255/", False), ("http://224.0.0.1", False),
])
stated("safe_address", X.safe_url, [(" https://a.b ", "https://a.b"), ("\nhttps://a.b/c\t", "https://a.b/c"), ("HTTP://x", "HTTP://x"), ("ftp://a", ""), ("javascript:x", ""), ("", ""), (None, ""), ("　http://x　", "http://x")])
stated("authoritative_report", lambda s, t: P.is_report(s, t, F.lit("")), [("瑞士再保险", "报告", True), ("麦肯锡", "x", True), ("SWISS RE Institute", "x", True), ("某博客", "报告", False), ("某博客", "引用德勤数据", True), (None, "aon 展望", True), (None, None, False)])
stated("report_layer", C.report_layer, [("劳合社", "reinsurance"), ("Accenture", "consulting"), ("头豹研究院", "domestic"), ("新浪财经", ""), ("swiss re", "reinsurance"), ("", "")])
stated("notable_source", P.is_notable_source, [("某协会", "媒体", True), ("新浪", "监管机构", True), ("新浪", "媒体", False), ("", "监管", False), (None, "监管", False), ("瑞士再保险", None, True), ("北大研究院", "媒体", True), ("新浪", None, False)])
stated("category_with_hint", C.category_by_hits, [
    ("监管处罚", "理赔", "claims", "claims"), ("监管处罚 新规", "理赔", "", "regulation"), ("监管处罚 新规", "理赔", "research", "regulation"), ("监管", "理赔", None, "regulation"), ("天气", "晴", "", "industry"), ("理赔拒赔", "监管", "", "claims"), ("产品", "市场", "research", "product"), (None, None, None, "industry"),
])
_SHORT = {"claims": ["k0 {title}", "k1 {title}"], "industry": ["i0 {title}", "i1 {title}"]}
stated("short_reason", lambda t, c: C.short_reason(t, c, _SHORT), [("保险", "claims", "k0 保险"), ("ab", "claims", "k1 ab"), ("ab", "none", "i1 ab"), ("", "industry", "i0 "), ("a" * 40, "claims", "k0 " + "a" * 30), ("b" * 29 + "ccc", "industry", "i1 " + "b" * 29 + "c")])
stated("layer_default", C.layer_of, [("reinsurance", "reinsurance"), ("domestic", "domestic"), ("other", "consulting"), ("", "consulting"), (None, "consulting"), ("regulator", "regulator")])
stated("layer_type", C.layer_type, [("reinsurance", "国际再保险"), ("domestic", "国内研究"), ("other", "全球咨询"), (None, "全球咨询"), ("regulator", "监管机构"), ("consulting", "全球咨询")])
stated("rescaled_score", lambda s: F.round(s.cast("decimal(4,1)") * 10).cast("int"), [("7.2", 72), ("10.0", 100), ("0.0", 0), ("6.9", 69), (None, None)])
stated("references_decoded", X.unescape, [
    ("a&#20013;b", "a中b"), ("&#x4E2D;&#x6587;", "中文"), ("&lt;x&gt; &amp;lt;", "<x> &lt;"), ("&#38;lt;", "&lt;"), ("&amp;#39;", "&#39;"), ("&#39;&#x27;", "''"), ("&#;", "&#;"), ("&#128512;", "😀"), ("plain", "plain"), (None, None), ("&nbsp;|&hellip;", "\xa0|…"), ("&#0;", "\ufffd"), ("&eacute;&notit;&amp&ampamp;", "é¬it;&&amp;"), ("&NotEqualTilde;|&nosuch;|&#128;|&#xD800;", "≂̸|&nosuch;|€|\ufffd"), ("a & b &", "a & b &"),
])
stated("stripped_text", X.stripped, [("<p> a&amp;b </p>", "a&b"), ("x" * 400, "x" * 300), ("a<b>c", "a c"), ("", "")])
stated("relative_time", lambda t: dates.relative_time(t.cast("timestamp"), F.lit("2026-07-10 12:00:00").cast("timestamp")), [
    ("2026-07-10 11:59:30", "刚刚"), ("2026-07-10 11:58:00", "2分钟前"), ("2026-07-10 09:00:00", "3小时前"), ("2026-07-08 11:00:00", "2天前"), ("2026-07-03 13:00:00", "6天前"), ("2026-07-03 12:00:00", "7/3日"), ("2025-12-31 00:00:00", "12/31日"), ("2026-07-11 00:00:00", "刚刚"), ("2026-07-10 11:01:00", "59分钟前"), ("2026-07-09 12:00:00", "1天前"),
])
stated("date_label", lambda t: dates.format_date(t.cast("timestamp"), F.lit("2026-07-10 12:00:00").cast("timestamp")), [
    ("2026-07-10 00:00:00", "今天"), ("2026-07-10 23:59:59", "今天"), ("2026-07-09 23:59:59", "7/9日"), ("2025-07-10 12:00:00", "7/10日"), ("2026-12-01 00:00:00", "12/1日"), (None, None),
])
stated("clock_label", lambda t: dates.format_time(t.cast("timestamp")), [("2026-07-10 09:05:59", "09:05"), ("2026-07-10 00:00:00", "00:00"), ("2026-07-10 23:59:00", "23:59"), (None, None)])
stated("tag_list", lambda t: F.array_join(X.tags(t), "|"), [("a, b ,c", "a|b|c"), (" a ", "a"), ("", ""), (",,", ""), ("保险,　理赔\t", "保险|理赔"), (None, None)])
stated("issue_number", lambda t: dates.issue_number(t.cast("date")), [("2024-05-15", 0), ("2024-05-16", 1), ("2026-07-10", 786), ("2024-05-01", -14)])
stated("shanghai_day", dates.shanghai_day, [("0", "1970-01-01"), ("1751385600", "2025-07-02"), ("1751385599", "2025-07-01"), ("x", None), ("", None), (None, None), ("1751414400", "2025-07-02")])
stated("feed_day", dates.feed_day, [("Thu, 02 Jul 2026 20:00:00 GMT", "2026-07-02"), ("Thu, 02 Jul 2026 20:00:00 +0000", "2026-07-03"), ("Thu, 02 Jul 2026 10:00:00 +0800", "2026-07-02"), ("02 Jul 2026", None), ("", None), (None, None)])
stated("title_and_source", lambda t: F.concat_ws("|", *readers.split_source(t)), [("a - b", "a|b"), ("a - b - c", "a - b|c"), ("plain", "plain|"), ("", "|"), ("a-b", "a-b|")])
_PAGES = [
    ('<meta property="article:published_time" content="2026-07-02T10:30:00">', "http://a/2020/01/01/b", "2026-07-02"), ('<meta name="publishdate" content="2026/7/3">', "", "2026-07-03"), ('{"datePublished": "2026-07-04"}', "", "2026-07-04"), ('<time class="x" datetime="2026-07-05">', "", "2026-07-05"), ("发布 2026年7月6日", "", "2026-07-06"),
    ("x", "http://a/20260707/b", "2026-07-07"), ("x", "http://a/2026/7/8/b", "2026-07-08"), ("x", "http://a/b", None), ("2026-13-45", "http://a/20269999/b", None),
]
stated("page_date", dates.page_date, _PAGES)
stated("page_summary", readers.page_summary, [('<meta name="description" content="A summary of ten or more">', "t", "A summary of ten or more"), ('<meta name="description" content="short">', "t", "t"), ("<p>none", "t", "t"), (f'<meta name="description" content="{"x" * 300}">', "t", "x" * 220)])
