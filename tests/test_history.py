"""A batch against stored texts: the gram index, fuzzy anti-joins on it, and streams that keep it."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import dedup, merge
from cairn.operators.dedup import GramIndex
from cairn.streaming import incremental


def ratio(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def titles(seed, n, words=14):
    r = random.Random(seed)
    pool = ["".join(r.choices("abcdé保险新", k=r.randint(1, 6))) for _ in range(words)]
    out = []
    for _ in range(n):
        t = " ".join(r.choices(pool, k=r.randint(1, 7)))
        if out and r.random() < 0.4:
            t = list(r.choice(out))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice("XYz保")
            t = "".join(t)
        out.append(t)
    return out


@pytest.mark.parametrize("kind, threshold, strict", [("edit", 0.82, False), ("edit", 0.6, True), ("jaccard", 0.7, False), ("jaccard", 0.5, True)])
def test_matches_are_those_of_all_pairs(spark, kind, threshold, strict):
    old, new = titles(1, 150), titles(2, 40) + titles(1, 30)[10:] + [""]
    measure = ratio if kind == "edit" else jaccard
    index = GramIndex.of(spark.createDataFrame([(t,) for t in old], "t string"), "t", kind, threshold)
    rows = spark.createDataFrame([(-i, t) for i, t in enumerate(new)], "i long, t string")
    got = index.matches(rows, "t", "i", threshold, strict)
    texts = {(r["part"], r["id"]): r["t"] for r in index.texts().collect()}
    assert sorted(texts.values()) == sorted({t.lower() if kind == "edit" else t for t in old})
    found = sorted((r["i"], texts[tuple(r["j"])], round(r["similarity"], 6)) for r in got.collect())
    pairs = [(-i, o, round(measure(t, o), 6)) for i, t in enumerate(new) for o in texts.values() if t]
    assert found == sorted(p for p in pairs if (p[2] > threshold + 1e-6 if strict else p[2] >= threshold - 1e-9))


@pytest.mark.parametrize("seed", [3, 4])
def test_greedy_with_history(spark, seed):
    """Any integers order the rows, below zero too; the stored texts may be duplicates of one another."""
    old, new = titles(seed, 60), titles(seed + 10, 50) + titles(seed, 20)
    seqs = random.Random(seed).sample(range(-100, 100), len(new))
    rows = sorted(zip(seqs, new, strict=True))
    kept = []
    for _, t in rows:
        if t and all(ratio(t, o) < 0.7 for o in old + [k for k in kept if k]):
            kept.append(t)
        else:
            kept.append(None)
    want = [s for (s, _), k in zip(rows, kept, strict=True) if k]
    batch = spark.createDataFrame(rows, "seq long, title string")
    history = spark.createDataFrame([(t,) for t in old + old[:5] + [None, ""]], "title string")
    assert sorted(r["seq"] for r in dedup.greedy(batch, "title", "seq", "edit", 0.7, existing=history).collect()) == want
    index = GramIndex.of(history.limit(20), "title", "edit", 0.7)
    index.add(history, "title", 1)
    assert sorted(r["seq"] for r in dedup.greedy(batch, "title", "seq", "edit", 0.7, existing=index).collect()) == want
    left = merge.unlike(batch, index, "title", 0.7).collect()
    assert sorted(r["seq"] for r in left) == [s for s, t in rows if all(ratio(t, o) < 0.7 for o in old)]


def test_additions(spark, tmp_path):
    """An addition that is made again replaces itself; a number leaves out later ones; grams new since the order was fixed still meet."""
    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    index = GramIndex.create(frame("first of all the titles"), "t", str(tmp_path / "index"))
    index.add(frame("zzzz qqqq jjjj xxxx", "dropped again"), "t", 1)
    index.add(frame("zzzz qqqq jjjj xxxx", "First of all the titles"), "t", 1)
    index.add(frame("vvvv wwww kkkk"), "t", 2)
    assert sorted(r["t"] for r in index.texts().collect()) == ["first of all the titles", "vvvv wwww kkkk", "zzzz qqqq jjjj xxxx"]
    asked = spark.createDataFrame([(1, "zzzz qqqq jjjj xxxy"), (2, "vvvv wwww kkkq"), (3, "first of all titles"), (4, None)], "i long, t string")
    ask = lambda **how: sorted(r["i"] for r in GramIndex(spark, str(tmp_path / "index")).matches(asked, "t", "i", 0.82, **how).collect())
    assert ask() == [1, 2, 3] and ask(below=2) == [1, 3] and ask(below=1) == [3]
    with pytest.raises(ValueError):
        index.matches(asked, "t", "i", 0.7)
    again = GramIndex.create(frame("vvvv wwww kkkk"), "t", str(tmp_path / "index"))
    assert [r["t"] for r in again.texts().collect()] == ["vvvv wwww kkkk"]
    empty = GramIndex.of(frame("x").where("false"), "t", "edit", 0.82)
    assert empty.matches(asked, "t", "i", 0.82).count() == 0


def test_stored_texts_do_not_meet(spark):
    """The plan joins the batch's grams with the stored ones; nothing joins these with themselves."""
    old = spark.createDataFrame([("the same title again",)] * 50 + [(f"the same title again {i}",) for i in range(200)], "t string")
    index = GramIndex.of(old, "t", "edit", 0.82)
    got = index.matches(spark.createDataFrame([(1, "something else entirely")], "i long, t string"), "t", "i", 0.82)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/grams") <= 1 and got.count() == 0


@pytest.mark.parametrize("kind", ["edit", "jaccard"])
def test_copies_are_looked_for_once(spark, monkeypatch, kind):
    """Equal texts of the rows have one set of grams and one comparison, and every row its matches."""
    met, compared = [], dedup._compared
    monkeypatch.setattr(dedup, "_compared", lambda both, *how: met.append(both.count()) or compared(both, *how))
    index = GramIndex.of(spark.createDataFrame([("the same title again",), ("quo vadis",)], "t string"), "t", kind, 0.82)
    texts = ["the same title again", "the same title agaim", None, "", "zzz"]
    rows = spark.createDataFrame([(i, texts[i % 5]) for i in range(200)], "i long, t string")
    got = sorted((r["i"], round(r["similarity"], 6)) for r in index.matches(rows, "t", "i", 0.82).collect())
    measure = ratio if kind == "edit" else jaccard
    assert got == [(i, round(measure(texts[0], texts[i % 5]), 6)) for i in range(200) if i % 5 < 2] and met[0] <= 6  # 3 different texts, 2 stored


@pytest.mark.parametrize("few", [0, 10])
def test_stored_grams_are_no_table_of_each_task(spark, monkeypatch, few):
    """Files of grams are small, what a task would keep of them is not: only a batch of few texts is sent to all tasks."""
    monkeypatch.setattr(dedup, "FEW_TEXTS", few, raising=False)
    index = GramIndex.of(spark.createDataFrame([(t,) for t in titles(7, 60)], "t string"), "t", "edit", 0.82)
    got = index.matches(spark.createDataFrame(list(enumerate(titles(7, 5))), "i long, t string"), "t", "i", 0.82)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert {"Broadcast" in p for p in plan if "Join [q#" in p and "band#" in p} == {few > 0}
    assert {r["i"] for r in got.where("similarity = 1").collect()} == set(range(5))


def test_ingest_keeps_the_index(spark, tmp_path):
    batches = [titles(20 + k, 25) for k in range(3)]
    source = tmp_path / "in"
    rows, kept = [], []
    for k, batch in enumerate(batches):
        rows.append([(k * 100 + i, t) for i, t in enumerate(batch + (batches[0][:5] if k else []))])
        for s, t in rows[-1]:
            if all(ratio(t, o) < 0.82 for _, o in kept):
                kept.append((s, t))
    for k, own in enumerate(rows):
        spark.createDataFrame(own, "seq long, title string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("seq long, title string").parquet(str(source))
        incremental.ingest(stream, str(tmp_path / "table"), str(tmp_path / "cp"), "seq long, title string").awaitTermination()
        if k == 1:  # an index that is lost is made again from the table
            GramIndex.create(spark.createDataFrame([], "title string"), "title", f"{tmp_path / 'table'}.grams")
    table = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(r["seq"] for r in table.collect()) == [s for s, _ in kept]
    stored = GramIndex(spark, f"{tmp_path / 'table'}.grams").texts()
    assert sorted(r["t"] for r in stored.collect()) == sorted(t.lower() for _, t in kept)
