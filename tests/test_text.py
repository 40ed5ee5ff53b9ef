"""Character references and feeds held in a column against the standard library."""

import html
import html.entities
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.sources import readers


def test_every_reference(spark):
    """All names, with and without semicolon, at ends and inside, all numbers of interest, and what only looks like one."""
    texts = ["&", "&&amp;amp;", "&;", "&#;", "&#x;", "&#xg;", "a & b", "&amp", "&ampamp;", "&notit;", "&noti", "&notin;", "&" + "a" * 40 + ";", "&lt;&#60;&#x3C;", "&amp;lt;", "&#38;lt;", "x&\ny", "&#00038;", "&#X41;", "", "plain"]
    for name in html.entities.html5:
        bare = name.rstrip(";")
        texts += [f"a&{name}b", f"&{bare}", f"&{bare}x;", f"&{bare} &{name}"]
    texts += [f"&#{n};" for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000, 128512, 99999999999]]
    texts += [f"&#x{n:x}" for n in [*range(300), 0xD800, 0xFFFE, 0x10FFFF, 0x110000, 128512]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["u"] for r in rows.select("i", X.unescape(F.col("t")).alias("u")).collect()}
    assert {t: got[i] for i, t in enumerate(texts) if got[i] != html.unescape(t)} == {}


FEEDS = {
    "cdata": "<?xml version='1.0' encoding='utf-8'?><rss><channel><title>C</title><item><title><![CDATA[A & B &amp;lt; c]]></title><link> http://a/1 </link><description><![CDATA[<p>some <b>text</b></p>]]></description><pubDate>Thu, 02 Jul 2026 10:00:00 GMT</pubDate></item></channel></rss>",
    "prefix": "<rss xmlns:m='u'><channel><item><m:title>other</m:title><title>own &lt;i&gt;</title><link>http://a/2</link><summary>said</summary></item><item><link>http://a/3</link></item></channel></rss>",
    "atom": "<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title type='html'>T &amp;amp; U</title><link rel='self'/><link href='http://b/1'/><link href='http://b/2'/><summary>x &lt;em&gt;y&lt;/em&gt;</summary><updated>2026-07-02</updated></entry><entry><title>none</title></entry></feed>",
    "rdf": "<rdf><channel/><item><title>r</title><link>http://c/1</link></item></rdf>",
    "broken": "<rss><channel><item><title>a</title></item>",
    "empty": "<rss><channel/></rss>",
    "text": "no feed at all",
}


def plain(content):
    """The entries by an XML parser."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    text = lambda e: "" if e is None or e.text is None else html.unescape(e.text.strip())
    strip = lambda t: " ".join(html.unescape("".join(" " if k % 2 else x for k, x in enumerate(__import__("re").split(r"(<[^>]+>)", t)))).split())[:300]
    out = [(text(i.find("title")), text(i.find("link")), strip(text(i.find("description")) or text(i.find("summary"))), text(i.find("pubDate"))) for i in root.iter("item")]
    a = "{http://www.w3.org/2005/Atom}"
    return out or [(text(e.find(a + "title")), next((x.get("href") for x in e.findall(a + "link") if x.get("href")), ""), strip(text(e.find(a + "summary"))), text(e.find(a + "updated"))) for e in root.iter(a + "entry")]


def test_feeds_in_a_column(spark):
    rows = spark.createDataFrame([*FEEDS.items(), ("null", None)], "name string, body string")
    got = {}
    for r in readers.feed_entries(rows).orderBy("name", "pos").collect():
        got.setdefault(r["name"], []).append((r["title"], r["link"], r["summary"], r["published"]))
    assert got == {name: plain(body) for name, body in FEEDS.items() if plain(body)}
