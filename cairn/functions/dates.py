"""Dates from text, with one explicit ``as_of`` for everything that depends on today."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cairn.functions.text import stripped_ends


def _date(y: Column, m: Column, d: Column) -> Column:
    """ISO date of three number texts, null if there is no such day."""
    padded = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((y != "") & (m != "") & (d != ""), F.try_to_date(padded, "yyyy-MM-dd").cast("string"))


def _found(text: Column, pattern: str) -> Column:
    return _date(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def parse_date(text: Column) -> Column:
    """YYYY-MM-DD of a text that begins with Y-M-D, Y年M月D or Y/M/D."""
    t = stripped_ends(text)
    return F.coalesce(*[_found(t, rf"^(\d{{4}}){a}(\d{{1,2}}){b}(\d{{1,2}})") for a, b in (("-", "-"), ("年", "月"), ("/", "/"))])


def date_in_text(text: Column, as_of: Column) -> Column:
    """The first that applies: hours or days ago, yesterday, the day before, today, a full date, a month and day."""
    hours, days = F.regexp_extract(text, r"(\d+)小时前", 1).try_cast("int"), F.regexp_extract(text, r"(\d+)天前", 1).try_cast("int")
    iso = lambda c: c.cast("date").cast("string")
    full = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    short = r"(\d{1,2})月(\d{1,2})日"
    return (
        F.when(hours < 24, iso(as_of)).when(days.isNotNull(), iso(F.date_sub(as_of, days))).when(text.contains("昨天"), iso(F.date_sub(as_of, 1))).when(text.contains("前天"), iso(F.date_sub(as_of, 2)))
        .when(text.contains("今天") | text.contains("今日"), iso(as_of)).when(text.rlike(full), _found(text, full))
        .when(text.rlike(short), _date(F.year(as_of).cast("string"), F.regexp_extract(text, short, 1), F.regexp_extract(text, short, 2)))
    )


# Where a page states its date, in the order in which they count.
_PAGE_DATES = [
    r"""(?i)<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["']publishdate["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["']publication_date["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["']weibo:article:create_at["'][^>]+content=["']([^"']+)["']""",
    r'(?i)"datePublished"[:\s]*"([^"]+)"',
    r"""(?i)<time[^>]+datetime=["']([^"']+)["']""",
]
# End of the fixed values.


def page_date(html: Column, url: Column) -> Column:
    """The date that a page states: metadata, structured data, time elements, its first 2000 characters, its address."""
    stated = [parse_date(F.regexp_extract(F.substring(html, 1, 50000), p, 1)) for p in _PAGE_DATES]
    head = parse_date(F.regexp_extract(F.substring(html, 1, 2000), r"(\d{4}[-/年]\d{1,2}[-/月]\d{1,2})", 1))
    flat, deep = r"/(\d{4})(\d{2})(\d{2})/", r"/(\d{4})/(\d{1,2})/(\d{1,2})/"
    return F.coalesce(*stated, head, F.when(url.rlike(flat), _found(url, flat)).otherwise(_found(url, deep)))


def iso_from_rfc822(text: Column, as_of: Column) -> Column:
    """UTC time of an RFC 2822 date; a missing or broken one is ``as_of``."""
    plain = F.regexp_replace(stripped_ends(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.try_to_timestamp(F.regexp_replace(plain, r"(?:GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.date_format(F.coalesce(zoned, F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")), as_of), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc822(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit(""))


def format_date(ts: Column, as_of: Column) -> Column:
    """今天 for a time of today, else month/day with 日 behind, without leading zeros."""
    return F.when(F.to_date(ts) == F.to_date(as_of), "今天").otherwise(F.concat(F.month(ts).cast("string"), F.lit("/"), F.dayofmonth(ts).cast("string"), F.lit("日")))


def format_time(ts: Column) -> Column:
    """Hour and minute of the 24-hour clock, two digits each."""
    return F.date_format(ts, "HH:mm")


def relative_time(ts: Column, as_of: Column) -> Column:
    """刚刚, minutes, hours or days ago; the date's label from a week on.  What lies ahead is 刚刚."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    n = lambda k: F.floor(s / k).cast("string")
    return F.when(s < 60, "刚刚").when(s < 3600, F.concat(n(60), F.lit("分钟前"))).when(s < 86400, F.concat(n(3600), F.lit("小时前"))).when(s < 7 * 86400, F.concat(n(86400), F.lit("天前"))).otherwise(format_date(ts, as_of))


def day_key(published: Column) -> Column:
    """The first ten characters of a time as text; no zone is applied."""
    return F.substring(published, 1, 10)


def shanghai_day(seconds: Column) -> Column:
    """The day in Shanghai, which keeps UTC+8, of a time in seconds as text or number; null for what is none."""
    n = F.regexp_extract(seconds.cast("string"), r"^\s*(\d{1,11})\s*$", 1).try_cast("long")
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((n + 8 * 3600) / 86400).cast("int")).cast("string")


def feed_day(published: Column) -> Column:
    """The day of an RFC 2822 date: as it stands for GMT, that in Shanghai for a numeric zone, null otherwise."""
    plain = F.regexp_replace(stripped_ends(F.coalesce(published, F.lit(""))), r"^[A-Za-z]{3},\s*", "")
    gmt = F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    zoned = F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.date_format(gmt, "yyyy-MM-dd"), shanghai_day(F.unix_timestamp(zoned)))


def issue_number(as_of: Column) -> Column:
    return F.datediff(as_of, F.lit("2024-05-15").cast("date"))
