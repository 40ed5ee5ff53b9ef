"""Keywords of all rule sets in a text at once: one automaton, one pass, and every rule reads what it found.

The lexicon is a table of rules; its substrings and whole words become one
automaton, which is broadcast (a lexicon is a list of words that people write, and
its size is checked).  Each text is scanned once whatever the number of rule sets,
and the numbers of the rules that it fulfils become one array column; the gate, the
topics, the cascade and the boosts are built-in expressions over that array.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn import lexicon as L

#: Bytes of keywords that one automaton may hold.
MOST_BYTES = 4 << 20


class Keywords:
    """The rules of a lexicon table (rule_set, label, ord, keyword, match_mode, weight and place, the row's number).

    ``profile`` chooses its rows, where it has such a column; rules with patterns are
    not words and stay out.  Labels stand in the order of their first place.
    """

    def __init__(self, table: DataFrame, profile: str | None = None, most_bytes: int = MOST_BYTES):
        rules = table.where("match_mode IN ('substring', 'word')")
        if profile is not None:
            rules = rules.where(F.col("profile") == profile)
        size = rules.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
        if size > most_bytes:
            raise ValueError(f"{size} bytes of keywords: more than {most_bytes} are not sent to every task")
        self.rules = sorted((r.asDict() for r in rules.collect()), key=lambda r: r["place"])
        self.labels: dict[str, dict[str, list[int]]] = {}
        self.weights: dict[tuple[str, str], int | None] = {}
        for k, r in enumerate(self.rules):
            self.labels.setdefault(r["rule_set"], {}).setdefault(r["label"], []).append(k)
            self.weights[r["rule_set"], r["label"]] = r["weight"]
        self.spark = table.sparkSession

    def found(self, text: Column) -> Column:
        """The numbers of the rules whose keyword is in a lower-case text, ascending; a null text has those of the empty keyword."""
        known = self.spark.sparkContext.broadcast([(r["keyword"].lower(), r["match_mode"] == "word") for r in self.rules])

        @F.arrow_udf("array<int>")
        def scan(texts: pa.Array) -> pa.Array:
            find = _automaton(known.value)
            # one text at a time becomes Python's own, so a batch is held once
            return pa.array((find(t.as_py() or "") for t in texts), pa.list_(pa.int32()), size=len(texts))

        return scan(text)

    def any(self, found: Column, rule_set: str, label: str | None = None) -> Column:
        """Whether a rule of the set, or of one label of it, is among those found."""
        own = self.labels.get(rule_set, {})
        numbers = [k for name, ks in own.items() if label in (None, name) for k in ks]
        return F.arrays_overlap(found, F.array(*map(F.lit, numbers))) if numbers else F.lit(False)

    def count(self, found: Column, rule_set: str, label: str) -> Column:
        """How many rules of a label are among those found."""
        numbers = self.labels.get(rule_set, {}).get(label, [])
        return F.size(F.array_intersect(found, F.array(*map(F.lit, numbers)))) if numbers else F.lit(0)

    def first(self, found: Column, rule_set: str, default: str | None = None) -> Column:
        """The first label with a rule among those found."""
        return F.coalesce(*[F.when(self.any(found, rule_set, name), name) for name in self.labels.get(rule_set, {})], F.lit(default))

    def most(self, found: Column, rule_set: str, default: str | None = None) -> Column:
        """The label with most rules among those found; of equals the first; none: ``default``."""
        own = self.labels.get(rule_set, {})
        if not own:
            return F.lit(default)
        best = F.array_max(F.array(*[F.struct(self.count(found, rule_set, name).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("label")) for i, name in enumerate(own)]))
        return F.when(best["n"] > 0, best["label"]).otherwise(F.lit(default))

    def boost(self, found: Column, rule_set: str) -> Column:
        """The sum of the weights of the labels with a rule among those found."""
        out = F.lit(0)
        for name in self.labels.get(rule_set, {}):
            out = out + F.when(self.any(found, rule_set, name), self.weights[rule_set, name]).otherwise(0)
        return out

    def rows(self, texts: DataFrame, key: str, found: str) -> DataFrame:
        """(key, rule_set, label, ord, keyword): one row for each text and rule found in it."""
        named = self.spark.createDataFrame([(k, r["rule_set"], r["label"], r["ord"], r["keyword"]) for k, r in enumerate(self.rules)], "rule int, rule_set string, label string, ord int, keyword string")
        return texts.select(key, F.explode(found).alias("rule")).join(F.broadcast(named), "rule").drop("rule")


#: The machine that this Python worker built last, with the rules that it is of.
_last: tuple = (None, None)


def _automaton(rules: list[tuple[str, bool]]):
    """A function from a text to the numbers of its rules, as sorted list."""
    global _last
    if _last[0] == rules:
        return _last[1]
    of: dict[str, list[tuple[int, bool]]] = {}
    for k, (word, whole) in enumerate(rules):
        of.setdefault(word, []).append((k, whole))
    always = [k for k, _ in of.pop("", [])]
    machine = ahocorasick.Automaton()
    for word, ks in of.items():
        machine.add_word(word, (len(word), ks))
    if of:
        machine.make_automaton()

    def within_word(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")

    def find(text: str) -> list[int]:
        hits = set(always)
        for end, (size, ks) in machine.iter(text) if of else ():
            for k, whole in ks:
                if not whole or not (within_word(text, end - size) or within_word(text, end + 1)):
                    hits.add(k)
        return sorted(hits)

    _last = (rules, find)
    return find


def classified(items: DataFrame, keywords: Keywords, title: str = "title", summary: str = "summary", authority: Column | None = None, low: int = 60, high: int = 95) -> DataFrame:
    """``items`` with relevant, topic, category and score by the rule sets gate, topic, category and boost, and found, the rules themselves.

    The same as the rules one by one, for one scan of title and summary.
    """
    from cairn.operators.predicates import searchable

    rows = items.withColumn("found", keywords.found(searchable(F.col(title), F.col(summary))))
    found = F.col("found")
    score = (F.lit(0) if authority is None else authority) + keywords.boost(found, "boost")
    return rows.withColumns({
        "relevant": keywords.any(found, "gate"), "topic": keywords.most(found, "topic"), "category": keywords.first(found, "category", L.DEFAULT_CATEGORY),
        "score": F.greatest(F.lit(low), F.least(F.lit(high), score)).cast("int"),
    })
