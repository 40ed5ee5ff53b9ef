"""Feeds, pages, search responses and stores as rows.

Fetching is not part of any plan: readers take files that a collector has put down,
or columns that hold what was fetched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cairn import schemas
from cairn.functions.dates import date_in_text, feed_day, shanghai_day
from cairn.functions.text import absolute_url, clean_markup_first, host, stripped_ends, unescape, unwrap_jsonp
from cairn.operators.merge import zipped
from cairn.operators.classify import layer_of, layer_type, most_hits
from cairn.operators.select import numbered
from cairn.operators.predicates import has_any, is_report_title, is_search_hit, relevant
from cairn.scratch import Scratch


# What the pages that are read look like.
_RESULT_LINK = r"""(?s)<a[^>]*href="(https?://[^"]*)"[^>]*>(.*?)</a>"""
_TITLED_LINK = r"""(?s)<a[^>]*href="(https?://[^"]+)"[^>]*target="_blank"[^>]*title="([^"]+)\""""
_RESULT_TIME = r"""(?s)<span[^>]*class="[^"]*time[^"]*"[^>]*>(.*?)</span>"""
_RESULT_SPAN = r"""(?s)<span class="{kind}"[^>]*>(.*?)</span>"""
_ARTICLE = r"""(?s)<a[^>]+href="(?:https?://{own})?(/art/[^"]+\.html)"[^>]*>(.*?)</a>"""
_ARTICLE_DAY = r"/art/(\d{4})/(\d{1,2})/(\d{1,2})/"
_DESCRIPTION = r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']"""
# End of the fixed values.


def _text(c: Column) -> Column:
    return F.coalesce(unescape(stripped_ends(c)), F.lit(""))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, summary, published) of RSS files; broken ones have no rows."""
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(schemas.RSS).load(path)
    return raw.select(_text(F.col("title")).alias("title"), _text(F.col("link")).alias("link"), _text(F.coalesce("description", "summary")).alias("summary"), _text(F.col("pubDate")).alias("published"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, summary, published) of Atom files; the link is the first with an address."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(schemas.ATOM).load(path)
    first = F.try_element_at(F.filter(F.col("link._href"), lambda h: h.isNotNull()), F.lit(1))
    return raw.select(_text(F.col("title")).alias("title"), _text(first).alias("link"), _text(F.col("summary")).alias("summary"), _text(F.col("updated")).alias("published"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items, or Atom entries where there are none."""
    from cairn.operators.predicates import or_fallback

    items = Scratch(spark, "feed").save(rss_items(spark, path), "items")  # asked twice, parsed once
    return or_fallback(items, atom_entries(spark, path))


def page_head(pages: DataFrame, html: str = "html", decode=unescape) -> DataFrame:
    """``pages`` with title and description; the description falls back on the title's first 120 characters."""
    h = F.col(html)
    get = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    meta = lambda k, v: get(rf"""(?is)<meta[^>]+{k}=["']{v}["'][^>]+content=["']([^"']+)["']""")
    title = clean_markup_first(F.coalesce(meta("property", "og:title"), get(r"(?is)<title[^>]*>(.*?)</title>"), F.lit("")), decode)
    said = clean_markup_first(F.coalesce(meta("property", "og:description"), meta("name", "description"), F.lit("")), decode)
    return pages.withColumn("title", title).withColumn("description", F.when(said != "", said).otherwise(F.substring("title", 1, 120)))


def links(pages: DataFrame, html: str = "html", least: int = 4, most: int = 120) -> DataFrame:
    """(…, pos, href, label) of anchors without tags in their text of the given length."""
    pattern = rf"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>([^<]{{{least},{most}}})</a>"""
    both = pages.withColumn("_h", F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).withColumn("_l", F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2)))
    return zipped(both, {"_h": "href", "_l": "label"}).drop("_h", "_l")


def first_links(found: DataFrame, page_key: str, n: int = 10, title_least: int = 10) -> DataFrame:
    """The first ``n`` distinct addresses of each page whose label is long enough."""
    from cairn.operators.dedup import first_of_each
    from cairn.operators.select import first_per_group

    long_enough = found.where(F.length(F.trim("label")) >= title_least)
    return first_per_group(first_of_each(long_enough, [page_key, "href"], ["pos"]), [page_key], [F.col("pos")], n).drop("_rn")


def search_response(rows: DataFrame, raw: str = "body", least: int = 6, size: int = 200) -> DataFrame:
    """Articles of JSONP search responses: title, content, url, source_name, date, date_verified."""
    parsed = rows.withColumn("_p", F.from_json(unwrap_jsonp(F.col(raw)), T.DataType.fromDDL(schemas.SEARCH)))
    one = parsed.select(*rows.columns, F.explode("_p.result.cmsArticleWebOld").alias("a"))
    title = clean_markup_first(F.coalesce("a.title", F.lit("")))
    content = clean_markup_first(F.coalesce("a.content", F.lit("")))
    out = one.select(*[c for c in rows.columns if c != raw], title.alias("title"), F.substring(F.when(content != "", content).otherwise(title), 1, size).alias("content"), F.col("a.url").alias("url"), F.col("a.mediaName").alias("source_name"), F.substring("a.date", 1, 10).alias("date"))
    return out.where(F.length("title") >= least).withColumn("date_verified", F.coalesce(F.col("date"), F.lit("")) != "")


def split_source(title: Column) -> tuple[Column, Column]:
    """A title and the source behind its last " - "."""
    return F.coalesce(F.nullif(F.regexp_extract(title, r"^(.*) - (.*)$", 1), F.lit("")), title), F.regexp_extract(title, r"^(.*) - (.*)$", 2)


def feed_search(rows: DataFrame, by: str, order: str, default: str, n: int = 8, least: int = 5, size: int = 500) -> DataFrame:
    """Items of search feeds: the source from its element or from behind the last " - " of the title, the day, the first ``n`` of each search.

    ``rows`` has title, link, description, pubDate, source besides the columns ``by`` and ``order``.
    """
    from cairn.operators.select import first_per_group

    whole = stripped_ends(F.coalesce("title", F.lit("")))
    said = F.nullif(stripped_ends(F.coalesce("source", F.lit(""))), F.lit(""))
    title, behind = split_source(whole)
    day = feed_day(F.col("pubDate"))
    text = stripped_ends(F.coalesce("description", F.lit("")))
    out = rows.where(F.length(whole) >= least).select(
        by, order, stripped_ends(title).alias("title"), stripped_ends(F.coalesce("link", F.lit(""))).alias("url"), F.substring(F.when(text != "", clean_markup_first(text)).otherwise(stripped_ends(title)), 1, size).alias("content"),
        F.coalesce(said, F.nullif(stripped_ends(behind), F.lit("")), F.lit(default)).alias("source_name"), F.coalesce(day, F.lit("")).alias("published_at"), day.isNotNull().alias("date_verified"),
    )
    return first_per_group(out, [by], [F.col(order)], n).drop("_rn")


def association_links(pages: DataFrame, page_key: str, root: str, as_of: Column | None, html: str = "html", n: int = 10, least: int = 10, gate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(page key, pos, title, url, published_at): the first ``n`` articles that a site's home page links to.

    Articles are paths ``/art/….html`` of the site ``root``, each path once; the title
    must be long enough and pass the gate; the day is the path's ``/Y/M/D/``.  Without
    one it is ``as_of``; where that is None the row goes.
    """
    from cairn.operators.dedup import first_of_each
    from cairn.operators.select import first_per_group

    own = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", root.split("://")[1])
    pattern = _ARTICLE.replace("{own}", own)
    both = pages.select(page_key, F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("_p"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("_t"))
    found = first_of_each(zipped(both, {"_p": "path", "_t": "raw"}).drop("_p", "_t"), [page_key, "path"], ["pos"])
    title = clean_markup_first(F.col("raw"))
    found = found.withColumn("title", title).where(F.length("title") >= least)
    if gate is not None:
        found = found.where(gate(F.col("title")))
    parts = [F.regexp_extract("path", _ARTICLE_DAY, k) for k in (1, 2, 3)]
    day = F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))
    found = found.withColumn("published_at", F.coalesce(day, as_of.cast("date").cast("string")) if as_of is not None else day).where("published_at IS NOT NULL")
    found = first_per_group(found, [page_key], [F.col("pos")], n).drop("_rn")
    return found.select(page_key, F.col("pos"), "title", F.concat(F.lit(root), F.col("path")).alias("url"), "published_at")


def page_summary(html: Column, title: Column, least: int = 10, size: int = 220) -> Column:
    """A page's description if it is long enough, else the title."""
    said = stripped_ends(unescape(F.regexp_extract(html, _DESCRIPTION, 1)))
    return F.when(F.length(said) >= least, F.substring(said, 1, size)).otherwise(title)


def broadcast_news(rows: DataFrame, day: str = "day", keywords: list[str] | None = None, size: int = 500) -> DataFrame:
    """Rows of a news programme that name a keyword of the field, dated by the programme's day."""
    from cairn import lexicon as L

    title, content = stripped_ends(F.coalesce("title", F.lit(""))), stripped_ends(F.coalesce("content", F.lit("")))
    kept = rows.where(has_any(F.concat(title, content), keywords or L.BROADCAST_KEYWORDS))
    return kept.withColumns({"title": title, "content": F.substring(content, 1, size), "published_at": F.col(day).cast("string"), "date_verified": F.lit(True), "category_hint": F.lit("regulation")})


def first_open_page(variants: list[Column], blocked: list[str]) -> Column:
    """Of the pages fetched by several ways, the first that is there and shows no bar to robots."""
    return F.coalesce(*[F.when(~has_any(v, blocked), v) for v in variants])


def _plain(html: Column) -> Column:
    return clean_markup_first(F.regexp_replace(html, "<[^>]+>", ""))


def search_page(pages: DataFrame, page_key: str, as_of: Column, html: str = "html", own: str = "baidu.com", default: str = "百度新闻", n: int = 8, size: int = 500) -> DataFrame:
    """Results of a search page: links, snippets and infos put together by place; the info's first word is the source, its date the day.

    Of the links to other hosts with a title of more than 5 characters the first
    ``n`` count, whose places in that list are those of snippets and infos.
    """
    link = _RESULT_LINK
    span = lambda kind: F.transform(F.regexp_extract_all(html, F.lit(_RESULT_SPAN.replace("{kind}", kind)), F.lit(1)), _plain)
    hits = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("url"), F.transform(F.regexp_extract_all(html, F.lit(link), F.lit(2)), _plain).alias("title"))
    hits = F.slice(F.filter(hits, lambda x: ~x["url"].contains(own) & (F.length(x["title"]) > 5)), 1, n)
    rows = pages.select(page_key, hits.alias("_h"), span("c-color-text").alias("_s"), span("c-color-gray").alias("_i"))
    rows = rows.select(page_key, F.posexplode("_h").alias("pos", "h"), "_s", "_i")
    at = lambda c: F.coalesce(F.get(c, F.col("pos")), F.lit(""))
    info, snippet = at("_i"), at("_s")
    day = date_in_text(info, as_of)
    return rows.select(
        page_key, "pos", F.col("h.title").alias("title"), F.col("h.url").alias("url"), F.when(snippet != "", F.substring(snippet, 1, size)).otherwise(F.col("h.title")).alias("content"),
        F.coalesce(F.nullif(F.split(info, r"\s")[0], F.lit("")), F.lit(default)).alias("source_name"), F.coalesce(day, F.lit("")).alias("published_at"), day.isNotNull().alias("date_verified"),
    )


def titled_links(pages: DataFrame, page_key: str, keyword: Column, as_of: Column, html: str = "html", n: int = 8) -> DataFrame:
    """Results of a search page whose links carry their titles: those that ``is_search_hit`` lets through, with the times by place."""
    link = _TITLED_LINK
    hits = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("title"))
    times = F.transform(F.regexp_extract_all(html, F.lit(_RESULT_TIME), F.lit(1)), _plain)
    rows = pages.withColumns({"_h": hits, "_t": times, "_k": keyword})
    rows = rows.withColumn("_h", F.slice(F.filter("_h", lambda x: is_search_hit(x["url"], x["title"], F.col("_k"))), 1, n))
    rows = rows.select(page_key, F.posexplode("_h").alias("pos", "h"), "_t")
    day = date_in_text(F.coalesce(F.get("_t", F.col("pos")), F.lit("")), as_of)
    out = rows.select(page_key, "pos", clean_markup_first(F.col("h.title")).alias("title"), F.col("h.url").alias("url"), F.when(F.col("h.url").contains("360kuai.com"), "360快资讯").otherwise("360搜索").alias("source_name"), F.coalesce(day, F.lit("")).alias("published_at"), day.isNotNull().alias("date_verified"))
    return out.where(F.length("title") >= 5)


def account_articles(rows: DataFrame, as_of: Column, marks: list[str] | None = None, default: str = "微信公众号", least: int = 5) -> DataFrame:
    """Articles of accounts (title, account, epoch, said): those of poor accounts go, the day is the epoch's in Shanghai, else that of the text."""
    from cairn import lexicon as L

    account = F.coalesce(F.col("account"), F.lit(""))
    poor = (F.length(account) > 1) & has_any(account, marks or L.LOW_QUALITY_ACCOUNTS)
    day = F.coalesce(shanghai_day(F.col("epoch")), date_in_text(F.coalesce("said", F.lit("")), as_of))
    kept = rows.where((F.length("title") >= least) & ~poor)
    return kept.withColumns({"source_name": F.when(F.length(account) > 1, F.concat(F.lit("公众号·"), account)).otherwise(default), "published_at": F.coalesce(day, F.lit("")), "date_verified": day.isNotNull()})


def inbox(spark: SparkSession, path: str) -> DataFrame:
    return inbox_rows(spark.read.schema(schemas.INBOX).option("multiLine", True).json(path))


def inbox_rows(raw: DataFrame) -> DataFrame:
    """Entries of the queue with an address, defaults filled in."""
    raw = raw.where(F.coalesce("url", F.lit("")) != "")
    return raw.withColumns({"source_name": F.coalesce(F.nullif("source_name", F.lit("")), host(F.col("url"))), "source_type": F.coalesce(F.nullif("source_type", F.lit("")), F.lit("媒体")), "authority": F.coalesce("authority", F.lit(85))})


def store(spark: SparkSession, path: str) -> DataFrame:
    """A collection's document; where there is no file, the document without items."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.STORE).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.range(1).select(F.from_json(F.lit('{"news": [], "sources": [], "days": {}, "source_health": {}}'), T._parse_datatype_string(schemas.STORE)).alias("d")).select("d.*")


def feed_entries(raw: DataFrame, body: str = "body") -> DataFrame:
    """(…, pos, title, link, summary, published) of feeds held in a column: RSS items, or Atom entries where a feed has none.

    Parsed as XML, so CDATA, references and prefixes are the parser's; elements of other
    namespaces are no titles.  A feed that is no well-formed XML has no entries.
    """
    keep = [c for c in raw.columns if c != body]
    plain = F.regexp_replace(stripped_ends(body), r"^<\?xml[^>]*\?>", "")  # a column has no encoding of its own
    doc = raw.select(*keep, F.from_xml(plain, schemas.FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "attributePrefix": "_", "ignoreSurroundingSpaces": "true"}).alias("_d")).where("_d._broken IS NULL")
    strip = lambda c: F.substring(clean_markup_first(F.coalesce(c, F.lit(""))), 1, 300)
    item = lambda x: F.struct(_text(x["title"]).alias("title"), _text(x["link"]).alias("link"), strip(_text(F.coalesce(F.nullif(x["description"], F.lit("")), x["summary"]))).alias("summary"), _text(x["pubDate"]).alias("published"))
    href = lambda x: F.try_element_at(F.filter(F.transform(x["link"], lambda h: h["_href"]), lambda h: F.coalesce(h, F.lit("")) != ""), F.lit(1))
    entry = lambda x: F.struct(_text(x["title"]).alias("title"), F.coalesce(href(x), F.lit("")).alias("link"), strip(_text(x["summary"])).alias("summary"), _text(x["updated"]).alias("published"))
    items = F.coalesce("_d.channel.item", "_d.item")
    listed = F.when(F.size(F.coalesce(items, F.array().cast(items_type()))) > 0, F.transform(items, item)).otherwise(F.transform("_d.entry", entry))
    return doc.select(*keep, F.posexplode(listed).alias("pos", "_e")).select(*keep, "pos", "_e.*")


def items_type() -> str:
    """The type of a feed's items."""
    return schemas._ITEM


def source_candidates(raw: DataFrame, url: str = "url", body: str = "body", kind: str = "kind") -> DataFrame:
    """(…, pos, title, link): entries of feeds, told by kind or by the head of the text, else the page's links.

    A link to the page itself is none; a feed's titles and links are its entries'.
    """
    head = F.substring(body, 1, 2000)
    feeds = (F.col(kind) == "rss") | head.contains("<rss") | head.contains("<feed")
    keep = [c for c in raw.columns if c not in (body, kind)]
    entries = feed_entries(raw.where(F.coalesce(feeds, F.lit(False))).select(*keep, body), body)
    of_feeds = entries.select(*keep, "pos", clean_markup_first(F.col("title")).alias("title"), "link")
    pages = links(raw.where(~F.coalesce(feeds, F.lit(False))), body)
    target = absolute_url(F.col(url), F.col("href"))
    of_pages = pages.select(*keep, "pos", clean_markup_first(F.col("label")).alias("title"), target.alias("link"))
    of_pages = of_pages.where((F.col("link") != "") & (F.rtrim(F.col("link"), F.lit("/")) != F.rtrim(F.col(url), F.lit("/"))))
    return of_feeds.unionByName(of_pages)


def report_rows(candidates: DataFrame, as_of: Column) -> DataFrame:
    """Candidates (title, url, summary, published, institution, institution_cn, layer) that pass ``report_candidates`` as report rows.

    The id follows from the address; facts and insight are left to an editor.
    """
    rows = report_candidates(candidates.withColumn("title", clean_markup_first(F.coalesce("title", F.lit("")))))
    from cairn import lexicon as L
    from cairn.functions.dates import iso_from_rfc822

    topic = most_hits(F.col("title"), F.col("summary"), L.TOPICS_DAILY, "product_innovation")
    day = iso_from_rfc822(F.coalesce("published", F.lit("")), as_of)
    return rows.select(
        F.concat(F.lit("auto-"), F.pmod(F.xxhash64("url"), F.lit(10**12)).cast("string")).alias("id"), "institution", "institution_cn", layer_of(F.col("layer")).alias("layer"), "title", day.alias("publish_date"), topic.alias("topic"),
        F.lit("").alias("key_data"), F.lit("").alias("key_insight"), "url", layer_type(F.col("layer")).alias("source_type"), F.lit(True).alias("auto"), F.lit(False).alias("curated"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
    )


def store_news(document: DataFrame) -> DataFrame:
    """The items of a store, with their place as seq."""
    return document.select(F.posexplode("news")).select(F.col("pos").cast("long").alias("seq"), "col.*")


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value) of a document that ``publish.write_lines`` wrote as JSON: its lines, whose places order them over all files.

    The lines are kept, as a place counts within the task that reads its part of a file.
    """
    m = F.col("_metadata")
    place = F.struct(m["file_name"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(place.alias("place"), "value")
    return Scratch(spark, "lines").save(lines, "lines")


def section(lines: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of one array of such a document, with their place in it as seq; the document is never one value."""
    edge = lines.where(~F.col("value").rlike(r"^,?\{.*\}$"))  # two of each section, and the head and end of the document
    first = edge.where(F.col("value").isin(f'"{name}":[', f',"{name}":[')).agg(F.min("place").alias("_from"))
    last = edge.where("value = ']'").join(F.broadcast(first)).where("place > _from").agg(F.min("place").alias("_to"))
    own = lines.join(F.broadcast(first)).join(F.broadcast(last)).where("place > _from AND place < _to").select("place", "value")
    own = numbered(own, [F.col("place")], "_seq")
    return own.select((F.col("_seq") - 1).alias("seq"), F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r")).select("seq", "r.*")


def head(lines: DataFrame, schema: str) -> DataFrame:
    """What stands before the arrays of such a document, as one row."""
    first = lines.agg(F.min_by("value", "place").alias("value"))
    return first.select(F.from_json(F.concat("value", F.lit("}")), schema).alias("r")).select("r.*")


def registry_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a registry, or of a bare array of them; key_data that is a text becomes null."""
    raw = spark.read.schema(schemas.REGISTRY).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("reports")).select(F.col("pos").cast("long").alias("seq"), "col.*")
    digits = F.length(F.regexp_extract("publish_date", r"^\d{4}(-\d{2})?(-\d{2})?", 0))
    day = F.when(digits == 4, F.concat("publish_date", F.lit("-01-01"))).when(digits == 7, F.concat("publish_date", F.lit("-01"))).otherwise(F.substring("publish_date", 1, 10))
    return rows.withColumns({"precision": F.when(digits == 4, "year").when(digits == 7, "month").when(digits >= 10, "day"), "publish_day": F.try_to_date(day, "yyyy-MM-dd")})


def report_candidates(rows: DataFrame) -> DataFrame:
    """Rows with a title and an address that read like reports of the field."""
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "") & ~F.col("url").startswith("#") & is_report_title(F.col("title")) & relevant(F.col("title"), F.col("summary")))


def channels(parts: list[tuple[str, DataFrame]], order: str = "row") -> DataFrame:
    """The channels one after the other, with channel, channel_ord and seq (order within all)."""
    tagged = [df.withColumns({"channel": F.lit(name), "channel_ord": F.lit(i)}) for i, (name, df) in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return union.withColumn("seq", F.col("channel_ord").cast("long") * F.lit(1 << 40) + F.col(order))


def first_of_feed(rows: DataFrame, by: str, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each source, before any gate."""
    from cairn.operators.select import first_per_group

    return first_per_group(rows, [by], [F.col(order)], n).drop("_rn")
