"""Published forms of a collection: JSON, JSON-LD, HTML, sitemap, RSS, Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.dates import rfc822
from cairn.functions.text import escape

PAGES = ("", "#/daily", "#/all", "#/research", "#/sources", "#/about", "#/submit", "#/search")


def _joined(rows: DataFrame, order: str, value: Column, name: str, between: str = "") -> DataFrame:
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), between).alias(name))


def json_ld(items: DataFrame, site: str, order: str = "id", n: int = 12) -> DataFrame:
    """One text: the site and the list of its first items."""
    top = items.orderBy(order).limit(n)
    entry = F.struct(F.lit("ListItem").alias("@type"), F.row_number().over(Window.orderBy(order)).alias("position"), F.col("title").alias("name"), F.concat(F.lit(f"{site}/#/news/"), F.col(order).cast("string")).alias("url"))
    listed = top.select(entry.alias("e")).agg(F.sort_array(F.collect_list(F.struct(F.col("e.position").alias("p"), "e"))).alias("l"))
    site_ = F.struct(F.lit("WebSite").alias("@type"), F.lit(site).alias("url"))
    return listed.select(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(F.to_json(site_), F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.transform("l", lambda x: x["e"]).alias("itemListElement")))).alias("@graph"))).alias("json_ld"))


def item_html(items: DataFrame) -> Column:
    return F.concat(F.lit("<li><strong>"), escape(F.col("title")), F.lit("</strong><p>"), escape(F.substring(F.coalesce("summary", F.lit("")), 1, 120)), F.lit("</p></li>"))


def fallback_html(items: DataFrame, order: str = "id", n: int = 12) -> DataFrame:
    top = items.orderBy(order).limit(n)
    return _joined(top, order, item_html(top), "html")


def sitemap_rows(items: DataFrame, site: str, key: str = "id") -> DataFrame:
    """(loc, lastmod) of the fixed pages and of every item."""
    fixed = items.sparkSession.createDataFrame([(f"{site}/{p}", None) for p in PAGES], "loc string, lastmod string")
    return fixed.unionAll(items.select(F.concat(F.lit(f"{site}/#/news/"), F.col(key).cast("string")), F.substring("published_at", 1, 10)))


def sitemap_xml(rows: DataFrame) -> DataFrame:
    mod = F.when(F.coalesce("lastmod", F.lit("")) != "", F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise("")
    return rows.select(F.concat(F.lit("<url><loc>"), escape(F.col("loc")), F.lit("</loc>"), mod, F.lit("</url>")).alias("xml"))


def rss_rows(items: DataFrame, site: str, key: str = "id", ts: str = "ts") -> DataFrame:
    """(id, xml) of every item; an item without an address links to its page on the site."""
    own = F.concat(F.lit(f"{site}/#/news/"), F.col(key).cast("string"))
    link = F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")).otherwise(own)
    date = F.when(F.col(ts).isNotNull(), F.concat(F.lit("<pubDate>"), rfc822(F.col(ts)), F.lit("</pubDate>"))).otherwise("")
    return items.select(key, F.concat(F.lit("<item><title>"), escape(F.col("title")), F.lit("</title><link>"), escape(link), F.lit("</link><description>"), escape(F.coalesce("summary", F.lit(""))), F.lit("</description>"), date, F.lit("</item>")).alias("xml"))


def inject(page: str, start: str, end: str, content: str) -> str:
    """The page with what stands between two markers replaced, the content taken literally."""
    pattern = re.compile(re.escape(start) + ".*?" + re.escape(end), re.S)
    if not pattern.search(page):
        raise ValueError(f"no markers {start} … {end}")
    return pattern.sub(lambda _: f"{start}{content}{end}", page, count=1)


def daily_markdown(items: DataFrame, date: str, labels: dict[str, str], highlight: float = 7.0, order: str = "seq") -> DataFrame:
    """One text per category of the day's items: heading and lines, highlights marked."""
    line = F.concat(F.lit("- "), F.when(F.col("ai_score") >= highlight, "**").otherwise(""), F.col("title"), F.when(F.col("ai_score") >= highlight, "**").otherwise(""), F.lit(" ("), F.col("source_name"), F.lit(")"))
    grouped = items.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("v")))), lambda x: x["v"]), "\n").alias("lines"))
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("category")], F.col("category"))
    return grouped.select("category", F.concat(F.lit(f"## {date} "), name, F.lit("\n\n"), F.col("lines"), F.lit("\n")).alias("markdown"))


def daily_document(items: DataFrame, date: str, labels: dict[str, str], curated: float = 6.0, highlight: float = 7.0, order: str = "seq", name: str = "Daily") -> DataFrame:
    """(place, line) of a day's Markdown: head, highlights, then the curated items of each category in the order of the first.

    Only a day's curated items are in it; lines are rows, so a long day is no one text.
    """
    total = items.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ai_score") >= curated).alias("curated"), F.count_if(F.col("ai_score") >= highlight).alias("highlights"))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("category")], F.col("category"))
    # what a line shows of a text is cut out before rows move; the categories, one row each, go to the rows
    chosen = items.where(F.col("ai_score") >= curated).withColumn("content", F.substring("content", 1, 200))
    score = F.format_string("%.1f", F.col("ai_score").cast("double"))
    heading = F.concat(F.lit("### ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    place = lambda part, at, line: F.struct(F.lit(part).alias("part"), at.cast("long").alias("at"), F.lit(line).alias("line"))
    zero = F.lit(0)
    head = total.select(place(0, zero, 0).alias("place"), F.concat(F.lit(f"---\nlayout: daily\ntitle: \"{name} - {date}\"\ndate: {date}\n---\n# {name}\n\n**{date}** · "), F.col("curated").cast("string"), F.lit(" / "), F.col("total").cast("string"), F.lit("\n")).alias("line"))
    head = head.unionAll(total.select(place(1, zero, 0), F.concat(F.lit("## ⭐ ("), F.col("highlights").cast("string"), F.lit(")\n"))))
    top = chosen.where(F.col("ai_score") >= highlight).select(
        place(2, F.col(order), 0), F.concat(heading, F.lit("\n**"), score, F.lit("** | "), F.col("source_name"), F.lit(" | "), label, F.lit("\n\n"), F.substring("content", 1, 200), F.lit("\n\n> "), F.coalesce("ai_reason", F.lit("")), F.lit("\n\n---\n"))
    )
    first = chosen.groupBy("category").agg(F.min(order).alias("_first"))
    titles = first.select(F.struct(F.lit(3).alias("part"), F.col("_first").cast("long").alias("at"), F.lit(-1).cast("int").alias("line")), F.concat(F.lit("## "), label, F.lit("\n")))
    rows = chosen.join(F.broadcast(first), chosen["category"].eqNullSafe(first["category"])).drop(first["category"])
    lines = rows.select(
        F.struct(F.lit(3).alias("part"), F.col("_first").cast("long").alias("at"), F.col(order).cast("int").alias("line")), F.concat(heading, F.lit("\n**"), score, F.lit("** | "), F.col("source_name"), F.lit(" | "), F.coalesce("published_at", F.lit("")), F.lit("\n\n"), F.substring("content", 1, 150), F.lit("\n\n---\n"))
    )
    return head.unionAll(top).unionAll(titles).unionAll(lines).select("place", "line")


def json_document(sections: dict[str, tuple[DataFrame, str]], scalars: dict[str, str]) -> DataFrame:
    """(place, line) of one JSON document: texts, then each section's rows as an array in the order of a column.

    Every row is a line of its own, so the document is written and read without
    being one value; ``write_lines`` keeps their order over its files.
    """
    spark = next(iter(sections.values()))[0].sparkSession
    text = F.struct(*[F.struct(F.lit(v).alias("v"))["v"].alias(k) for k, v in scalars.items()])
    least = -(1 << 63)  # below any order, of which null counts as the next
    opening = spark.range(1).select(F.lit(0).alias("part"), F.lit(least).cast("long").alias("at"), F.regexp_replace(F.to_json(text), r"\}$", "").alias("line"))
    out = opening
    for k, (name, (rows, order)) in enumerate(sections.items(), 1):
        lead = "," if scalars or k > 1 else ""
        out = out.unionAll(spark.range(1).select(F.lit(k), F.lit(least).cast("long"), F.lit(f'{lead}"{name}":[')))
        at = F.coalesce(F.col(order).cast("long"), F.lit(least + 1).cast("long"))
        first = rows.agg(F.min(at).alias("_first"))
        comma = F.when(at > F.col("_first"), ",").otherwise("")
        value = F.to_json(F.struct(*[c for c in rows.columns if c != order]), {"ignoreNullFields": "false"})
        out = out.unionAll(rows.join(F.broadcast(first)).select(F.lit(k), at, F.concat(comma, value)))
        out = out.unionAll(spark.range(1).select(F.lit(k), F.lit((1 << 63) - 1), F.lit("]")))
    out = out.unionAll(spark.range(1).select(F.lit(len(sections) + 1), F.lit(0).cast("long"), F.lit("}")))
    return out.select(F.struct("part", "at").alias("place"), "line")


def xml_document(rows: DataFrame, order: str, head: str, end: str) -> DataFrame:
    """(place, line) of one XML document: the head, each row's ``xml`` in the order of a column, the end."""
    spark = rows.sparkSession
    edge = lambda part, text: spark.range(1).select(F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at")).alias("place"), F.lit(text).alias("line"))
    return edge(0, head).unionAll(rows.select(F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("at")), "xml")).unionAll(edge(2, end))


#: Bytes of lines that one file of a document has, about.
FILE_BYTES = 64 << 20


def _in_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """The lines in the order of ``place``, in ``parts`` ranges at least and as many as ``FILE_BYTES`` asks for."""
    parts = max(parts, -(-(rows.agg(F.sum((F.octet_length("line") + 1).cast("long"))).first()[0] or 0) // FILE_BYTES))
    return rows.repartitionByRange(parts, "place").sortWithinPartitions("place").select("line")


def write_lines(rows: DataFrame, path: str, parts: int = 1) -> None:
    """Lines into text files whose names' order is that of ``place``: put behind one another they are the document.

    There are ``parts`` files, or more of a longer document, so that no task has more of it.
    """
    _in_ranges(rows, parts).write.mode("overwrite").text(path)


def write_feeds(rows: DataFrame, order: str, path: str, head: str, end: str, parts: int = 1) -> None:
    """Each row's ``xml`` in the order of a column, into files that each are a whole feed by themselves, head and end included.

    A long feed is as many files as its bytes ask for, in the order of their names.
    """

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("line", pa.string())])
        yield pa.RecordBatch.from_pylist([{"line": head}], schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"line": end}], schema)

    lines = _in_ranges(rows.select(F.col(order).alias("place"), F.col("xml").alias("line")), parts)
    lines.mapInArrow(framed, "line string").write.mode("overwrite").text(path)


def write_json(items: DataFrame, path: str) -> None:
    """The rows as JSON lines, in as many files as there are partitions."""
    items.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_date(rows: DataFrame, path: str, date: str = "date") -> None:
    """Rows into the partitions of their dates, each replaced as a whole."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def copy_table(spark, source: str, target: str) -> None:
    """A snapshot of a Parquet table, or its restoration the other way round."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)


def injected(page: Column, start: str, end: str, content: Column) -> Column:
    """A page's text with what stands between the first pair of markers replaced, the content taken literally; null without the markers."""
    head = F.substring_index(page, start, 1)
    behind = F.substr(page, F.length(head) + len(start) + 1)
    tail = F.substr(behind, F.length(F.substring_index(behind, end, 1)) + 1)
    return F.when(page.contains(start) & behind.contains(end), F.concat(head, F.lit(start), content, tail))
