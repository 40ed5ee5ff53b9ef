"""Row predicates: gates, noise, block lists, freshness, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairn import lexicon as L
from cairn.functions.text import quoted


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any word is in the text as it stands; one scan for all words."""
    return text.rlike(quoted(words)) if words else F.lit(False)


def searchable(*parts: Column) -> Column:
    """The parts, null as empty, put together in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _low(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def relevant(title: Column, summary: Column, terms: list[str] = L.STRONG_TERMS) -> Column:
    return has_any(searchable(title, summary), _low(terms))


def is_report_title(title: Column, signals: list[str] = L.REPORT_SIGNALS) -> Column:
    return has_any(F.lower(F.coalesce(title, F.lit(""))), _low(signals))


def keyword_in(keyword: str, text: Column, whole_words: list[str] = L.WHOLE_WORDS) -> Column:
    """The keyword in lower-case text: as a whole word if it is one of the ambiguous ones."""
    k = keyword.lower()
    return text.rlike(rf"(?U)\b{quoted([k])}\b") if k in whole_words else text.contains(k)


def any_keyword(keywords: list[str], text: Column, whole_words: list[str] = L.WHOLE_WORDS) -> Column:
    plain = [k for k in _low(keywords) if k not in whole_words]
    return reduce(lambda a, b: a | b, [keyword_in(k, text, whole_words) for k in _low(keywords) if k in whole_words], has_any(text, plain))


def is_stock_noise(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return (t != "") & ~has_any(t, L.STOCK_EXEMPT) & (has_any(t, L.STOCK_NOISE) | (t.contains(L.STOCK_SECTOR) & has_any(t, L.STOCK_VERBS)))


def is_blocked(url: Column, source: Column, domains: list[str] = L.BLOCKED_DOMAINS, names: list[str] = L.BLOCKED_SOURCES) -> Column:
    return has_any(F.lower(F.coalesce(url, F.lit(""))), domains) | has_any(F.coalesce(source, F.lit("")), names)


def is_search_noise(title: Column, patterns: list[str] = L.SEARCH_NOISE) -> Column:
    return F.coalesce(title, F.lit("")).rlike("|".join(patterns))


def is_search_hit(url: Column, title: Column, keyword: Column, own: str = "so.com", own_articles: str = "360kuai.com", subject: str = "保险") -> Column:
    """An article of the search engine's own, or a long title of another host that has the subject or the keyword.

    The second half holds together: an own article needs no title.
    """
    return url.contains(own_articles) | (~url.contains(own) & (F.length(title) > 8) & (title.contains(subject) | F.contains(title, keyword)))


def is_report(source: Column, title: Column, content: Column, institutions: dict[str, list[str]] = L.INSTITUTIONS) -> Column:
    return has_any(searchable(source, title, content), _low([w for words in institutions.values() for w in words]))


def is_notable_source(name: Column, kind: Column) -> Column:
    return (F.coalesce(name, F.lit("")) != "") & (F.coalesce(kind.isin(L.NOTABLE_TYPES), F.lit(False)) | has_any(name, L.NOTABLE_NAMES))


def fresh(items: DataFrame, as_of: Column, days: int = 21, date_col: str = "published_at", verified_col: str = "date_verified") -> DataFrame:
    """Rows that are not verified, have no readable date, or are at most ``days`` old; all rows if none is.

    Whether any row is fresh is part of the plan (a limit of one row), not a count on
    the driver.
    """
    day = F.try_to_date(F.substring(date_col, 1, 10), "yyyy-MM-dd")
    keep = ~F.coalesce(F.col(verified_col), F.lit(False)) | day.isNull() | (day >= F.date_sub(as_of, days))
    return or_all(items, keep)


def or_all(items: DataFrame, keep: Column) -> DataFrame:
    """Rows where ``keep`` holds; all rows if it holds for none."""
    any_kept = items.where(keep).limit(1).select(F.lit(True).alias("_any"))
    rest = items.where(~F.coalesce(keep, F.lit(False))).join(F.broadcast(any_kept), how="left_anti")
    return items.where(keep).unionByName(rest)


def or_fallback(items: DataFrame, fallback: DataFrame) -> DataFrame:
    """``items``, or ``fallback`` if there is none."""
    return items.unionByName(fallback.join(F.broadcast(items.limit(1).select(F.lit(True).alias("_any"))), how="left_anti"))


def by_id(items: DataFrame, key, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """The first row with an id, or none."""
    found = items.where(F.col(id_col) == F.lit(key))
    return (found.orderBy(seq) if seq in items.columns else found).limit(1)


def search(items: DataFrame, keyword: str = "", category: str = "all", columns: tuple[str, ...] = ("title", "summary", "tags", "source_name")) -> DataFrame:
    """Rows of a category whose columns, any of them, hold the keyword in any case."""
    out = items if category == "all" else items.where(F.col("category") == category)
    k = keyword.strip().lower()
    if not k:
        return out
    return out.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(k) for c in columns]))
