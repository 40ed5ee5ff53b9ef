"""Quality rules: one table of thresholds compiled into one Spark projection, without user functions.

Words are runs of anything but ASCII white space.  The measures are array
expressions of one row, so a document never leaves its partition.  Repeated
windows of words are found by hashing each window, sorting the hashes with their
places and looking at neighbours, which is n log n for a text of n words; texts
whose window hashes are all distinct skip the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Base rules: least number of words, and the greatest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Frequent function words of the four languages, for the stop-word ratio.
STOP_WORDS = (
    "the of and to in is that for it with as was on be at by this from or are an a "
    "de la le et les des en un une du dans que pour qui sur pas par avec "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine "
    "el los las del se y no es al lo su para con una por"
).split()

#: (measure, relation, threshold): a document that breaks one of these is not kept.
#: Thresholds are ratios to words, lines or characters, and hold for texts of any length; see the measures below.
RULES = (
    ("symbol_ratio", "<=", 0.10),
    ("upper_ratio", "<=", 0.30),
    ("digit_ratio", "<=", 0.50),
    ("dup_line_ratio", "<=", 0.45),
    ("variety", ">=", 2.5),
    ("mean_word", "<=", 15.0),
    ("mean_word", ">=", 2.0),
    ("stop_ratio", ">=", 0.01),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shifted(a: str, by: int, then) -> Column:
    """``then(x[i], x[i + by])`` for each place of array column ``a`` where both exist."""
    n = F.greatest(F.size(a) - F.lit(by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), then)


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios that RULES use; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    # hashes of windows by doubling: 1, 2, 4, 8 words
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    for by in (1, 2, 4):
        d = d.withColumn("_h", _shifted("_h", by, lambda a, b: F.xxhash64(a, b)))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    d = d.withColumns({"_lines": lines, "_distinct": F.size(F.array_distinct("_h")), "_kinds": F.size(F.array_distinct("_words"))})
    d = d.withColumn("_sorted", F.when(F.col("_distinct") < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_next", _shifted("_sorted", 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    d = d.withColumn("_places", F.array_sort(F.array_distinct(F.flatten(F.filter("_next", lambda p: p.isNotNull())))))
    gaps = F.aggregate(_shifted("_places", 1, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0).cast("long"), lambda s, x: s + x)
    n_words = F.size("_words").cast("long")
    d = d.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count(text, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_places") > 0, gaps + WINDOW).otherwise(F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines"),
            "_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
            "_upper": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_digit": _count(text, "0123456789"),
        }
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return d.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / words,
            "upper_ratio": F.col("_upper") / chars,
            "digit_ratio": F.col("_digit") / chars,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "variety": F.col("_kinds") / F.sqrt(words),  # distinct words grow about with the root of all
            "mean_word": F.col("word_chars") / words,
            "stop_ratio": F.col("_stop") / words,
        }
    )


def verdict(rules=RULES) -> Column:
    """True if no rule is broken; the conjunction of the table's rows."""
    ops = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    out = F.lit(True)
    for name, op, bound in rules:
        out = out & ops[op](F.col(name), F.lit(bound))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _in_place(c: Column) -> Column:
    """``c``, evaluated where it stands: a filter on it that the optimizer moved below the measures would repeat them inside itself.

    Spark moves no filter through a projection with a nondeterministic column; the
    result does not depend on it, as the value is the same wherever it is computed.
    """
    return F.coalesce(F.when(F.monotonically_increasing_id() >= 0, c), F.lit(False))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Each row is judged by itself: repeated rows get equal verdicts, null and empty
    texts fail the base rules.  Input columns with the names of new ones are replaced.
    """
    new = [*BASE, "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in new]
    d = measure(docs.select(*keep), text_col).withColumn("base_failed", _in_place(base_failed()))
    return d.withColumn("kept", _in_place(~F.col("base_failed") & verdict(rules))).select(*keep, *new)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    judged = measure(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), "_text")
    return judged.select("_row", _in_place(~base_failed() & verdict()).alias("_kept")).where("_kept").select("_row.*")
