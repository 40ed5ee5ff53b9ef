"""Queries against their SQL on small tables with what the given ones lack."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn import queries as curation
from cairn.functions import text as X
from cairn.operators import dedup


def agree(spark, folder, name, **tables):
    """Both sides' rows over the tables (schema, rows), which must be the same; returns them."""
    duck = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = curation.queries()[name](spark, str(folder))
    found = duck.execute(curation.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want)
    return want


PAGES = ("page_id long, url string, html string", [(1, "u", "<title>a&&&amp</title><p>b &quot;c&quot &copy;2 &copy &middot; &amp;amp; &amp;quot;</p>"), (2, "u", "<title>&am</title>&amp&amp;amp &lt;p>")])


@pytest.mark.parametrize("name", ["clean_text_daily", "clean_text_archive", "page_title"])
def test_names_without_a_semicolon(spark, tmp_path, name):
    assert "a&&&amp" in agree(spark, tmp_path, name, pages=PAGES)[0][1]


@pytest.mark.parametrize("name", ["public_addresses", "public_hosts"])
def test_closed_addresses_of_six_groups(spark, tmp_path, name):
    # 2001:20:: and 2001:3::, which later registers opened within 2001::/23
    found = agree(spark, tmp_path, name, customer=("c_custkey long", [(k,) for k in (402418, 448786, 495154, 541522, 4, 7)]))
    assert (402418 if name == "public_addresses" else 40241, False) in found


@pytest.mark.parametrize("ids", [range(5), [3, -7, 1000000, -2, 0, -1]])
def test_a_written_document_keeps_its_rows_and_columns(spark, tmp_path, ids):
    schema = "item_id long, text string"
    rows = [(k, t) for k, t in zip(ids, ['a "b"\nc', "]", None, "", '"reports":[', "\u2028x\ty\rz"])]
    assert len(agree(spark, tmp_path, "research_document", benchmark=(schema, rows))) == len(rows)
    assert sorted(curation.queries()["research_document"](spark, str(tmp_path)).columns) == ["description", "id", "seq", "title", "topic"]


@pytest.mark.parametrize("kind, threshold", [("edit", 0.82), ("edit", 0.7), ("jaccard", 0.9)])
def test_blocks_hand_on_few_pairs_and_lose_none(spark, monkeypatch, kind, threshold):
    """Texts of few words, which nearly all share grams and characters, in blocks of a few rows."""
    from cairn.operators import blocks

    monkeypatch.setattr(blocks, "FEW_ROWS", 40)
    monkeypatch.setattr(blocks, "ROWS", 40)
    rng = random.Random(4)
    words = ["the", "ther", "an", "tion", "ing", "ñ", "保险", "𝒳y"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(260)})
    texts = sorted({*texts, *[t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts[::4]], *[t[1:] for t in texts[::5]]} - {""})
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    measure = X.edit_ratio if kind == "edit" else X.character_jaccard
    pairs = rows.alias("a").crossJoin(rows.alias("b")).where("a.i < b.i").select("a.i", F.col("b.i").alias("j"), measure(F.col("a.t"), F.col("b.t")).alias("s")).where(F.col("s") >= threshold)
    want = {(r["i"], r["j"]) for r in pairs.collect()}
    assert {(r["i"], r["j"]) for r in dedup.similar_pairs(rows, "t", "i", kind, threshold).collect()} == want and want
    if (kind, threshold) == ("edit", 0.82):
        base = dedup._for_blocks(rows.select("i", F.col("t").alias("k"), F.length("t").alias("n")), kind)
        assert blocks.candidates(base, kind, threshold).count() < len(texts) ** 2 / 20  # of half the square


@pytest.mark.parametrize("batch, alone", [(300, 0), (300, 1000)])
def test_edits_lose_no_pair(monkeypatch, batch, alone):
    """Pairs that go through their columns together and one by one, of like and unlike texts, with more letters than there are numbers."""
    import numpy as np

    from cairn.operators import blocks, edits

    monkeypatch.setattr(edits, "BATCH", batch)
    monkeypatch.setattr(edits, "ALONE", alone)
    rng = random.Random(5)
    for letters in ("abc", "".join(chr(0x4E00 + k) for k in range(300)) + "𝒳"):
        first = ["".join(rng.choice(letters) for _ in range(rng.randint(50, 75))) for _ in range(12)]
        near = ["".join(c if rng.random() > 0.15 else rng.choice(["", c + rng.choice(letters), rng.choice(letters)]) for c in rng.choice(first)) for _ in range(18)]
        duck = duckdb.connect()
        number = {c: chr(33 + k % 90) if len(letters) < 90 else None for k, c in enumerate(letters)}
        u, v = np.divmod(np.arange(len(first) * len(near)), len(near))
        both = edits.Edits(first, near)
        apart = both.apart(u, v)
        if letters == "abc":
            plain = lambda t: "".join(number[c] for c in t)
            assert apart.tolist() == [duck.execute("SELECT levenshtein(?, ?)", [plain(first[a]), plain(near[b])]).fetchone()[0] for a, b in zip(u, v, strict=True)]
        for q in (2, 3, 4):
            grams = blocks._Grams([blocks._codes(first, q), blocks._codes(near, q)], (len(first), len(near)), 256)
            (a, _), (b, of_b) = grams.rows(0, 0, len(first)), grams.rows(1, 0, len(near))
            most = np.floor(np.maximum(both.n[u], both.m[v]) * 0.2 + 1e-9).astype(int)
            kept = both.within(u, v, most, (of_b[v] - (a @ b.T)[u, v]).astype(int), q)
            assert kept[apart <= most].all() and kept.sum() < len(u) / 2


def test_blocks_compare_texts_of_one_language_by_themselves(spark):
    """Long texts that share most of their grams: none but near ones leaves its group, and a row goes to few groups."""
    from cairn.operators import blocks

    rng = random.Random(6)
    words = [rng.choice("btdmn") + rng.choice("aeiou") for _ in range(12)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(200, 240))) for _ in range(120)]
    texts += [t[:100] + "x" + t[101:] for t in texts[::10]]
    rows = spark.createDataFrame([(k, t, len(t), 0) for k, t in enumerate(texts)], "i long, k string, length int, side int")
    assert {(min(r["i"], r["j"]), max(r["i"], r["j"]), r["edits"]) for r in blocks.candidates(rows, "edit", 0.75).collect()} == {(10 * k, 120 + k, 1) for k in range(12)}


def test_blocks_of_characters_grow_with_their_bands(spark):
    """Short sets are few bytes, so they stand in few blocks: a row goes to few groups, whatever their number."""
    from cairn.operators import blocks

    rows = spark.range(15000).select(F.col("id").alias("i"), F.format_string("%010d", "id").alias("k"), F.lit(10).alias("length"), F.lit(0).alias("side"))
    bands = rows.withColumn("band", blocks.band(F.col("length"), 0.9))
    tight = blocks._parts(bands.limit(10000), "jaccard", 0.9).first()["parts"], blocks._parts(bands, "jaccard", 0.9).first()["parts"]
    assert tight == (1, 2)


def test_lines_of_any_length_are_compared():
    from cairn.operators import blocks

    long = ["ab " * 100000, "cd " * 100000]
    assert [len(x) for x, _, _ in blocks._edit_pairs(long, long, 0.82, True)] in ([], [0])
