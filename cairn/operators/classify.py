"""Row classifiers: categories, topics, scores, tags and reasons as projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cairn import lexicon as L
from cairn.functions.text import checksum, clamp, pick
from cairn.operators.predicates import any_keyword, has_any, is_notable_source, searchable


def category_cascade(title: Column, summary: Column, cascade=L.CATEGORY_CASCADE, default: str = L.DEFAULT_CATEGORY, whole_words=L.WHOLE_WORDS) -> Column:
    """The first category with a keyword in the text."""
    text = searchable(title, summary)
    out = F.lit(default)
    for label, words in reversed(cascade):
        out = F.when(any_keyword(words, text, whole_words), label).otherwise(out)
    return out


def hits(text: Column, words: list[str]) -> Column:
    """How many entries of the list are in the text."""
    return reduce(lambda a, b: a + b, [text.contains(w.lower()).cast("int") for w in words], F.lit(0))


def most_hits(title: Column, content: Column, lists: dict[str, list[str]], default: str | None = None) -> Column:
    """The label with most entries in the text; of equals the one declared first; none: ``default``."""
    text = searchable(title, content)
    best = F.array_max(F.array(*[F.struct(hits(text, words).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, words) in enumerate(lists.items())]))
    return F.when(best["n"] > 0, best["label"]).otherwise(F.lit(default))


def category_by_hits(title: Column, content: Column, hint: Column, lists=L.CATEGORY_KEYWORDS_ARCHIVE) -> Column:
    """A hint, unless it is missing or ``research``, else the category with most hits."""
    return F.when((F.coalesce(hint, F.lit("")) != "") & (hint != "research"), hint).otherwise(most_hits(title, content, lists, L.DEFAULT_CATEGORY))


def boosted_score(title: Column, summary: Column, authority: Column, boosts=L.SCORE_BOOSTS, low: int = 60, high: int = 95) -> Column:
    text = searchable(title, summary)
    total = reduce(lambda a, b: a + b, [F.when(has_any(text, [w.lower() for w in words]), weight).otherwise(0) for words, weight in boosts], authority)
    return clamp(total, low, high).cast("int")


def additive_score(title: Column, content: Column, source: Column, published: Column, verified: Column, report: Column, as_of: Column, lists=L.CATEGORY_KEYWORDS_ARCHIVE, media=L.AUTHORITY_MEDIA) -> tuple[Column, Column]:
    """(score to 10.0, relevance to 1.00) as decimals: keywords, authority, report, length, freshness."""
    d = lambda x: F.lit(x).cast("decimal(6,2)")
    n = hits(searchable(title, content), [w for words in lists.values() for w in words])
    old = F.datediff(as_of, F.try_to_date(F.substring(published, 1, 10), "yyyy-MM-dd"))
    new = F.when(~F.coalesce(verified, F.lit(False)) | old.isNull() | (old < 0), d("0")).when(old == 0, d("3.5")).when(old <= 1, d("2")).when(old <= 3, d("1")).when(old <= 7, d("0.5")).when(old <= 14, d("0.3")).otherwise(d("0"))
    length = F.least(F.length(content).cast("decimal(12,4)") / F.lit(500), F.lit(1).cast("decimal(12,4)"))
    total = d("3") + F.least(n * d("0.2"), d("1.5")) + F.when(has_any(source, media), d("1")).otherwise(d("0")) + F.when(report, d("1.5")).otherwise(d("0")) + length + new
    score = F.least(F.round(total, 1), F.lit(10)).cast("decimal(4,1)")
    return score, F.least(d("0.3") + n * d("0.05"), d("1")).cast("decimal(3,2)")


def weak_class_bonus(items: DataFrame, score_col: str = "ai_score", by: str = "category", fewer: int = 3) -> DataFrame:
    """+1.0 to the scores of categories with fewer rows than that, up to 10.

    Counts are aggregated before they meet the rows, so a large category is not one
    task's; their table has a row per category.
    """
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    raised = F.when(F.col("_n") < fewer, F.least(F.col(score_col) + 1, F.lit(10))).otherwise(F.col(score_col))
    return items.join(counts, items[by].eqNullSafe(counts[by]), "left").drop(counts[by]).withColumn(score_col, raised.cast(items.schema[score_col].dataType)).select(*items.columns)


def report_layer(source: Column, institutions=L.INSTITUTIONS) -> Column:
    out = F.lit("")
    for layer, names in reversed(institutions.items()):
        out = F.when(has_any(F.lower(source), [n.lower() for n in names]), layer).otherwise(out)
    return out


def first_tags(category: Column, title: Column, content: Column, lists=L.CATEGORY_KEYWORDS_ARCHIVE, size: int = 3) -> Column:
    """Of the category's first keywords, those in the text."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    out = F.array().cast("array<string>")
    for label, words in lists.items():
        out = F.when(category == label, F.filter(F.array(*[F.lit(w) for w in words[:size]]), lambda k: text.contains(F.lower(k)))).otherwise(out)
    return out


def label_of(key: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[key]
    return F.coalesce(found, default if default is not None else key)


def layer_of(layer: Column, types: dict[str, str] = L.LAYER_TYPES, default: str = "consulting") -> Column:
    """A known layer as it is, any other as the default."""
    return F.when(layer.isin(*types), layer).otherwise(F.lit(default))


def layer_type(layer: Column, types: dict[str, str] = L.LAYER_TYPES) -> Column:
    """The source type of a layer."""
    return label_of(layer_of(layer, types), types)


def rank_bucket(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 80, "medium").otherwise("low")


def reason(title: Column, summary: Column, source: Column, kind: Column, category: Column, score: Column, themes: list[tuple[list[str], str, list[str]]], hints: dict[str, tuple[str, str]], category_names: dict[str, str], theme_openers: list[str], category_openers: list[str], tails: list[str], values: dict[str, str]) -> Column:
    """A sentence on why a row is worth reading: theme, else source, else category; the wording follows the title's checksum.

    ``themes`` are (keywords, label, clauses) in order of precedence; openers have the
    places {label}, {ccat} and {clause}; ``values`` has a clause per category.
    """
    text = searchable(title, summary)
    label, clause = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (its_label, its_clause) in hints.items():
        label, clause = F.when(source == name, its_label).otherwise(label), F.when(source == name, its_clause).otherwise(clause)
    for words, its_label, clauses in reversed(themes):
        found = any_keyword(words, text)
        label, clause = F.when(found, its_label).otherwise(label), F.when(found, pick(title, clauses)).otherwise(clause)
    def fill(opener: Column, places: dict[str, Column]) -> Column:
        for place, value in places.items():
            opener = F.replace(opener, F.lit("{" + place + "}"), value)
        return opener

    by_theme = fill(pick(title, theme_openers), {"label": label, "clause": clause})
    value = label_of(category, values, F.lit(values[L.DEFAULT_CATEGORY]))
    by_category = fill(pick(title, category_openers), {"ccat": label_of(category, category_names, F.lit("行业动态")), "clause": value})
    prefix = F.when(is_notable_source(source, kind), F.concat(F.lit("据"), source, F.lit("披露，"))).otherwise("")
    tail = F.when(score >= 92, pick(title, tails)).otherwise("")
    return F.trim(F.concat(prefix, F.when(label.isNotNull(), by_theme).otherwise(by_category), tail))


def short_reason(title: Column, category: Column, templates: dict[str, list[str]]) -> Column:
    """One of a category's templates, by the checksum of the title's first 30 characters."""
    t = F.substring(title, 1, 30)
    out = F.element_at(F.array(*[F.lit(x) for x in templates[L.DEFAULT_CATEGORY]]), (checksum(t) % len(templates[L.DEFAULT_CATEGORY]) + 1).cast("int"))
    for label, choices in templates.items():
        out = F.when(category == label, pick(t, choices)).otherwise(out)
    return F.replace(out, F.lit("{title}"), t)
