"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import chat, decontamination, html_text, pieces, quality_knn, quality_rules, queries, sharding, simhash, suffix_dedup, toxicity
from cairn.llm.training import held_out

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdeéß日", k=r.randint(1, 6))) for _ in range(50)]
    passage = " ".join(r.choices(words, k=40))
    rows = []
    for i in range(150):
        t = " ".join(r.choices(words, k=r.randint(0, 60)))
        if r.random() < 0.3:
            t += " " + passage + "\n" + t[:30]
        if rows and r.random() < 0.2:
            t = r.choice(rows)[1]
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "ab" * 400), (204, "x" * 3000), (205, "word " * 6000), (3, rows[3][1]), (3, "same id, other text " * 4), (None, rows[4][1]), (None, None)]
    return spark.createDataFrame([(i, t, "k", "h", 1) for i, t in rows], "doc_id long, text string, kept string, hash string, m int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_sharding(odd, none):
    got = sharding.shard_documents(odd, buckets=16).collect()
    assert len(got) == odd.count() and sharding.shard_documents(none).count() == 0
    sizes, shards, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        sizes[r["group_key"]] += r["size"]
        shards[r["group_key"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [sizes[k] for k in sorted(sizes)]

    def feasible(c):
        n, s = 1, 0
        for x in order:
            n, s = (n + 1, x) if s + x > c else (n, s + x)
        return n <= 8

    least = next(c for c in range(max(max(order), -(-sum(order) // 8)), sum(order) + 1) if feasible(c))
    load = collections.Counter()
    for k, s in shards.items():
        load[min(s)] += sizes[k]
    assert max(load.values()) == least
    by_id = {(r["doc_id"], r["text_crc32"]): r["size"] for r in got}
    assert by_id[(200, 0)] == 1 and by_id[(201, 0)] == 1


def test_sharding_hot_group(spark):
    rows = spark.createDataFrame([(i, "hot" * 50 if i % 3 == 0 else f"t{i}" * 5) for i in range(300)], "doc_id long, text string")
    got = sharding.shard_documents(rows, buckets=8).collect()
    load = collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == 100 * 151 and len({r["shard"] for r in got if r["size"] == 151}) == 1


def brute_repeats(rows, width=50):
    first = {}
    docs = [(2**63 - 1 if i is None else i, (t or "").encode(), i) for i, t in rows]
    for i, b, _ in docs:
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(first.get(b[p : p + width], i), i)
    out = []
    for i, b, own in docs:
        hit = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                hit[p : p + width] = b"\1" * width
        spans = sum(1 for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1]))
        out.append((own, len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(odd, none):
    got = suffix_dedup.remove_repeats(odd)
    assert got.columns == ["doc_id", "text", "hash", "m", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"]
    got = sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    want = brute_repeats([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got == want and sum(r[2] for r in want) > 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_with_a_common_passage(spark):
    r = random.Random(9)
    passage = "one very common line that nearly every document has, and more than once at times"
    rows = []
    for i in range(160):
        own = lambda: "".join(r.choices("abcdef ghij", k=r.randint(0, 90)))
        rows.append((i, own() + passage + own() + (passage + own()) * r.randint(0, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(suffix_dedup.hot_grams(suffix_dedup.keyed(docs, "doc_id", "text"), 50, 16)) > 0
    got = sorted((tuple(x) for x in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute_repeats(rows)


def test_suffix_dedup_in_parts(odd, spark, monkeypatch):
    """Small parts, buckets above them, and hashes that all agree change nothing."""
    r = random.Random(10)
    line = "".join(r.choices("abcdefg ", k=400))
    docs = [(i, (line[: r.randint(60, 400)] + "".join(r.choices("ab", k=r.randint(0, 80)))).encode()) for i in range(60)]
    doc = np.array([i for i, _ in docs])
    data = np.frombuffer(b"".join(b for _, b in docs), np.uint8)
    offs = np.cumsum([0, *[len(b) for _, b in docs]])
    want = [x.tolist() for x in suffix_dedup._found(doc, data, offs, 50)]
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    assert [x.tolist() for x in suffix_dedup._found(doc, data, offs, 50)] == want and len(want[0])

    def batch():
        n = len(docs)
        return suffix_dedup._segment_batch(np.full(n, 5, np.uint64), doc, np.zeros(n), np.zeros(n), data, offs, np.zeros(n), pa.nulls(n, pa.binary()))

    def covered(batches):
        out = set()
        for b in batches:
            for x in b.to_pylist():
                out |= {(x["doc"], k) for k in range(x["start"], x["end"])}
        return out

    spans = covered(suffix_dedup.find_repeats(50, 16)(iter([batch()])))
    monkeypatch.setattr(suffix_dedup, "segment_hashes", lambda buf, start, end: np.asarray(end - start).astype(np.uint64) * np.uint64(0))
    assert covered(suffix_dedup.find_repeats(50, 16)(iter([batch()]))) == spans
    for i, _, removed, _, _ in brute_repeats([(i, b.decode()) for i, b in docs]):
        assert sum(1 for x, _ in spans if x == i) == removed


def test_hot_hashes_of_a_sample(spark):
    line = "one very common line that nearly every document has, and more than once at times"
    docs = spark.createDataFrame([(i, line + str(i) * 40) for i in range(300)], "doc_id long, text string")
    rows = suffix_dedup.keyed(docs, "doc_id", "text")
    assert len(suffix_dedup.hot_of_sample(rows, 50, 16, 100, 4, sampled=2)) > 0 and len(suffix_dedup.hot_of_sample(rows, 50, 16, 100, 4, sampled=2, most=1)) == 1


def test_suffix_groups_are_exact():
    r = np.random.default_rng(1)
    text = np.concatenate([np.tile(r.integers(97, 99, 300), 9), np.full(500, 97), np.tile([97, 98], 200), r.integers(97, 101, 500)]).astype(np.uint8)
    text[r.integers(0, 2700, 60)] = 99
    width = 20
    padded = np.concatenate([text, np.zeros(2 * width, np.uint8)])
    starts = np.arange(len(text) - width + 1)
    suffix_dedup.SUFFIXES, kept = 700, suffix_dedup.SUFFIXES
    try:
        got = {}
        for k, (here, number) in enumerate(suffix_dedup.suffix_groups(padded, starts, width)):
            for p, n in zip(here.tolist(), number.tolist()):
                got.setdefault((k, n), set()).add(p)
    finally:
        suffix_dedup.SUFFIXES = kept
    want = collections.defaultdict(set)
    for p in starts.tolist():
        want[text[p : p + width].tobytes()].add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_cut_texts(odd):
    out = suffix_dedup.cut_texts(odd)
    assert out.columns == odd.columns and out.where("text IS NULL").count() == odd.where("text IS NULL").count()


@pytest.mark.parametrize("table", ["labelled", "odd"])
def test_quality_rules(spark, odd, none, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = collections.Counter(tuple(r) for r in quality_rules.judge(docs.select("doc_id", "text")).select("doc_id", *quality_rules.BASE, "base_failed").collect())
    want = collections.Counter()
    for i, t in docs.select("doc_id", "text").collect():
        t = t or ""
        w = WORD.findall(t)
        n, hit = len(w), [0] * len(w)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(n - 7))
        for k in range(n - 7):
            if c[tuple(w[k : k + 8])] > 1:
                hit[k : k + 8] = [1] * 8
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, n, sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit), n < 20 or 100 * sum(hit) > 30 * n)] += 1
    assert got == want
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.judge(docs).where("kept").count()
    assert quality_rules.keep_good(none).count() == 0


def test_quality_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text")).join(labels, "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() == 0
    assert judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()


def fingerprint(t):
    w = [x.encode() for x in WORD.findall(low(t or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash(spark, odd, none, limit, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", limit)  # a low limit sends nearly every bucket round again, and again
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((i, f"{fp[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    own = {(i, t) for k, (i, t) in enumerate(rows) if least[find(k)] == i}
    assert sorted(ids) == sorted(i for i, _ in own)


def test_covering_masks():
    r = random.Random(2)
    for free in (list(range(64)), list(range(0, 64, 2)), list(range(5, 21)), list(range(13)), list(range(40, 46))):
        masks = [int(m) for m in simhash.covering_masks(4, free)]
        assert len(masks) == 31 and (all(masks) or len(free) <= simhash.FEW)  # every deal keeps a bit more, so dealing ends
        for _ in range(500):
            bits = sum(1 << b for b in r.sample(free, 4))
            assert any(not m & bits for m in masks)


def test_chain_component(spark):
    chain = [0]
    for k in range(20):
        chain.append(chain[-1] | (7 << (3 * k)))
    fps = spark.createDataFrame([(c,) for c in chain], "fp long")
    from cairn.llm.components import connected
    from cairn.scratch import Scratch

    labels = {r["node"]: r["label"] for r in connected(simhash.near_links(fps, 4), Scratch(spark, "t")).collect()}
    assert len(labels) == 21 and set(labels.values()) == {0}


def brute_windows(docs, bench, window=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    held = collections.defaultdict(set)
    for i, t in bench:
        w = find(low(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w = find(low(t or ""))
        hit, items = [0] * len(w), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if x := held.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [1] * n
                    items |= x
        out.append((i, len(w), sum(hit), sorted(map(str, items))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1 << 22, 300])
def test_decontamination(spark, odd, none, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 2000)
    texts = [r["text"] for r in odd.collect()]
    bench = [(1, texts[0]), (2, "b!c"), (3, None), (4, ""), (5, "  ?! "), (11, texts[1]), (11, texts[1]), (12, " ".join((texts[2] or "x").upper().split()[:12]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontamination.scan_documents(odd, items, limit=limit).collect()), key=repr)
    want = brute_windows([(r["doc_id"], r["text"]) for r in odd.collect()], bench)
    assert got == want and any(w[2] for w in want)
    spans = lambda n: sorted((tuple(r) for r in decontamination.scan_documents(odd, items, limit=n).collect()), key=repr)
    assert spans(limit) == spans(1 << 22)
    clean = decontamination.drop_contaminated(odd, items, limit=limit)
    assert clean.columns == odd.columns and clean.count() == sum(1 for w in want if not w[2])
    assert decontamination.scan_documents(none, items).count() == 0
    assert decontamination.scan_documents(odd, items.where("false")).where("n_hit > 0").count() == 0


def test_cut_items_keep_their_windows():
    r = random.Random(4)
    for n in (1, 9, 10, 30, 200):
        raw = " ".join("".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(n)).encode()
        windows = lambda t: {tuple(w[k : k + 10]) for w in [decontamination.words_of(t)] for k in range(max(1, len(w) - 9))}
        for size in (40, 150, 10000):
            parts = decontamination.cut_item(raw, size, 10)
            assert set().union(*map(windows, parts)) == windows(raw)


def test_spans_are_one_run(spark):
    text = "zero one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, text[:49]), (2, text[5:])], "item_id long, text string")
    for limit in (1 << 22, 60):
        assert [tuple(s) for s in decontamination.scan_documents(docs, items, limit=limit).first()["spans"]] == [(0, len(text))]


def test_spans_point_into_the_text(spark):
    docs = spark.createDataFrame([(1, "Éa! ONE, two; thréé 四 five six seven eight nine ten. Rest")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two thréé 四 five six seven eight nine ten")], "item_id long, text string")
    r = decontamination.scan_documents(docs, items).first()
    s = r["spans"][0]
    assert docs.first()["text"][s["start"] : s["end"]] == "ONE, two; thréé 四 five six seven eight nine ten"


def test_pieces(spark, odd, none):
    p = pieces.load(pieces.MODEL)
    ids = {b: i for i, b in enumerate(p.bytes) if np.isfinite(p.scores[i])}

    def best(w):
        n = len(w)
        paths = [(0.0, ())] + [(-1e18, None)] * n
        for s in range(n):
            if paths[s][1] is None:
                continue
            size = min(1 if w[s] < 0xC0 else 2 if w[s] < 0xE0 else 3 if w[s] < 0xF0 else 4, n - s)
            for d in range(1, min(p.longest, n - s) + 1):
                if (i := ids.get(w[s : s + d])) is not None and paths[s][0] + p.scores[i] > paths[s + d][0]:
                    paths[s + d] = (paths[s][0] + p.scores[i], paths[s][1] + (i,))
            if w[s : s + size] not in ids and paths[s][0] + p.unknown > paths[s + size][0]:
                paths[s + size] = (paths[s][0] + p.unknown, paths[s][1] + tuple(int(p.byte_ids[c]) for c in w[s : s + size]))
        return list(paths[n][1])

    r = random.Random(8)
    texts = ["", " ", "  two  spaces ", "▁x▁", "日本語 テスト\n\t🎉 a\0b", "Hello, world!", "x" * 200, "é" * 70 + " thea", "x" * 400, "".join(r.choices("的一是不了人我在龍🎉", k=300)), "".join(r.choices("thea,", k=500)), "a" * 63 + " " + "b" * 65]
    encoder = pieces.Encoder(p)
    for t, x in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert encoder.decode(x).decode() == t and x.tolist() == best(b" " + t.encode())
    out = pieces.decode(pieces.encode(odd))
    assert out.where("NOT text <=> decoded").count() == 0
    checked = pieces.encode_and_check(odd)
    assert checked.count() == odd.count() and checked.where("NOT round_trip").count() == 0 and pieces.encode_and_check(none).count() == 0


def test_pieces_of_long_words():
    p = pieces.load(pieces.MODEL)
    encoder = pieces.Encoder(p)
    for t in ("的一是不了人我在" * 5000, "x" * 1_000_000, "word " * 1000 + "日本語" * 20000):
        began = time.time()
        assert encoder.decode(encoder.encode([t.encode()])[0]).decode() == t and time.time() - began < 20
    assert all(len(w) <= pieces.REMEMBERED_WORD for w in encoder.number)
    again = pieces.Encoder(p)
    a, b = encoder.encode([b"word tea", b"more"]), again.encode([b"word tea", b"more"])
    assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True))


def test_double_array():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "é", "zz", "zza"])}
    base, check, value = pieces.double_array(words)
    for w, i in words.items():
        s = 0
        for c in w:
            t = base[s] + c
            assert check[t] == s
            s = t
        assert value[s] == i


def test_quality_knn(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_knn.score_documents(docs, labels)
    assert got.count() == docs.count()
    judged = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in judged]) > 0.97
    assert quality_knn.score_documents(none, labels).count() == 0
    scores = quality_knn.score_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), labels.where("false")).collect()
    assert [r["score"] for r in scores] == [0.5, 0.5]


def test_toxicity(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    judged = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in judged if not r["toxic"]]
    toxic = [r["predicted"] for r in judged if r["toxic"]]
    assert np.mean(clean) < 0.01 and np.mean(toxic) > 0.9
    assert toxicity.score_documents(none, labels).count() == 0


@pytest.mark.parametrize("operator", [quality_knn, toxicity])
def test_learned_scores_of_odd_rows(spark, odd, operator):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(2000, 0, 0, "x"), (2000, 1, 1, "y"), (None, 1, 1, "z"), (3, None, 7, "z")], "doc_id long, quality int, toxic int, score string")
    mine = odd.select((F.col("doc_id") + 1_000_000).alias("id"), F.col("text").alias("body"), F.lit("c").alias("score"), F.lit(1).alias("predicted"))
    mine = mine.unionByName(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.lit("c").alias("score"), F.lit(1).alias("predicted")))
    got = operator.score_documents(mine, labels.select("doc_id", "quality", "toxic").unionByName(extra.drop("score")), "id", "body").collect()
    assert len(got) == mine.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= operator.THRESHOLD) for r in got)
    by = collections.defaultdict(set)
    ids = {r["id"]: r["body"] for r in mine.where("id IN (1000200, 1000201, 1000003)").collect()}
    for r in got:
        if r["doc_id"] in (1000200, 1000201):
            by[ids[r["doc_id"]] or ""].add(r["score"])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len(by[""]) == 1  # null and empty texts alike


def test_quality_votes_of_nearest():
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 123, r.integers(0, 400), np.uint8)) for _ in range(40)] + [b"$$ ## %% " * k for k in range(1, 30)]
    x = quality_knn.features(texts)
    model = quality_knn.Model(x, np.array([1] * 40 + [0] * 29))
    for t in [*texts[::7], b"", b"new text", b"## $$ " * 9]:
        v = model._units(model._weighted(quality_knn.features([t])))[0]
        near = sorted(((float(v @ u), float(y)) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        w = [max(s, 1e-6) ** quality_knn.SHARPNESS for s, _ in near]
        assert abs(model.score([t])[0] - sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w)) < 1e-3


def test_equal_neighbours():
    """Of equally near ones the first vote, whichever side of the cut they are on."""
    r = np.random.default_rng(2)
    near = r.integers(0, 4, (50, 30)).astype(np.float32)
    got = quality_knn.nearest(near, 7)
    assert [sorted(x) for x in got.tolist()] == [sorted(np.lexsort((np.arange(30), -row))[:7].tolist()) for row in near]


def test_components_of_chains_and_stars(spark):
    from cairn.llm.components import connected, settled
    from cairn.llm.scratch import Scratch

    r = random.Random(4)
    chain = list(range(300))
    r.shuffle(chain)
    links = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2000 + k // 2) for k in range(1, 200)] + [(5, 5)]
    frame = spark.createDataFrame(links, "u long, v long")
    labels = {x["node"]: x["label"] for x in connected(frame, Scratch(spark, "t")).collect()}
    assert labels == {**{k: 0 for k in range(300)}, **{k: 1000 for k in range(1000, 1200)}, **{k: 2000 for k in range(2000, 2200)}}
    assert not settled(frame) and connected(frame.where("false"), Scratch(spark, "t")).count() == 0


def test_html_without_article(spark):
    """The densest element where no tag names it, columns on demand, and elements nested beyond the bound."""
    body = "".join(f"<p>{'Long sentence of prose number %d goes on and on without any link. ' % k * 3}</p>" for k in range(4))
    page = f"<html><body><div class='top'><a href='/a'>one</a> <a href='/b'>two</a></div><div id='x'>{body}</div><div><ul><li><a href='/c'>more</a></li></ul></div></body></html>"
    want = "\n\n".join(("Long sentence of prose number %d goes on and on without any link. " % k * 3).strip() for k in range(4))
    deep = "<div>" * 400 + "<p>inner text of a deep page</p>" + "</div>" * 400
    rows = spark.createDataFrame([(1, "u", page, 5), (2, "v", None, 6), (3, "w", deep, 7)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in html_text.extract(rows, keep=["page_id", "url"]).collect()}
    assert got[1]["text"] == want and got[2]["text"] == "" and got[3]["text"] == "inner text of a deep page"
    assert set(got[1].asDict()) == {"page_id", "url", "text", "n_chars"} and html_text.extract(rows).columns == ["page_id", "url", "html", "text", "n_chars"]


def test_levenshtein_automaton():
    terms = [toxicity.Term("moron", False, 1.0), toxicity.Term("worthless", False, 1.0), toxicity.Term("scum", False, 1.0), toxicity.Term("lowe", True, 1.0), toxicity.Term("blither", True, 1.0), toxicity.Term("weak", False, 0.8), toxicity.Term("ass", False, 1.0)]
    assert [t.edits for t in terms] == [1, 2, 1, 1, 1, 1, 1]
    machine = toxicity.Automaton(terms)
    r = random.Random(3)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def nearest(w, t):
        return min((lev(w[:k], t.text) for k in range(len(w) + 1)), default=9) if t.stem else lev(w, t.text)

    for w in ("noron", "oron", "m0ron", "xmoron", "blitherings", "vlithering", "xblithering", "5cum"):
        assert machine.match(w) and machine.match(w)[0] == 1 or w == "blitherings" and machine.match(w)[0] == 0, w
    some = []
    for k in range(3000):
        w = list(r.choice(terms).text)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w)) if w else 0
            w[k : k + r.randint(0, 1)] = r.choice(["", r.choice("abmorwx0"), "ss"])
        w = "".join(w)
        some.append((w, min(((nearest(w, t), i) for i, t in enumerate(terms) if w and nearest(w, t) <= t.edits), default=None)))
    assert all(machine.match(w) == want for w, want in some[:500])
    assert machine.match_all({w for w, _ in some}) == dict(some)
    assert toxicity.Automaton([]).match("word") is None and {t.edits for t in (toxicity.Term("ab", False, 1.0), toxicity.Term("abc", True, 1.0))} == {0}


def test_misspelled_terms_of_any_weight():
    """Short terms, open stems and terms that do not tell by themselves bear edits too, in features of their own."""
    terms = [toxicity.Term("fag", False, 1.0), toxicity.Term("worthless", False, 0.95), toxicity.Term("moron", False, 1.0), toxicity.Term("blit", True, 1.0)]
    scorer = toxicity.Scorer(terms, [*toxicity.BELIEF, -4.0])
    at = {name: k for k, name in enumerate(toxicity.FEATURES)}
    for text, kind in (("a fa9 here", "misspelled"), ("so worthles", "loose"), ("so vorthles", "loose"), ("a mor0n", "misspelled"), ("blxtering", "loose"), ("worthless", "soft"), ("a moron", "strong")):
        x = list(scorer.each([text], lambda t: scorer.features(t)[0]))[0]
        assert [k for k in ("strong", "soft", "misspelled", "loose") if x[at[k]] > 0] == [kind], text


def test_quotation_counts_less():
    scorer = toxicity.Scorer([toxicity.Term("moron", False, 1.0)], [*toxicity.BELIEF, -4.0])
    plain, quoted, wrong, none = (scorer.score(t)[0] for t in ("what a moron he is", 'the word "moron" was used', "what a mor0n he is", "what a day"))
    assert none < quoted < plain and none < wrong


@pytest.mark.parametrize("text, quoted", [
    ("said nothing. moron!", False), ('the "best" people think you are a moron and that is "fine"', False), ('she said moron twice', True), ('he wrote: "you moron!"', True), ("« quel moron »", True), ("»moron«", True), ("„moron“ hier", True),
    ('an "open mark and a moron', False), ('a "first\nmoron" line', False), ("“nested ‹moron› here”", True), ('"a" moron "b"', False), ("moron", False), ("he said.\nmoron", False), ("moron, he said", True),
])
def test_quotation_is_of_paired_marks_and_sentences(text, quoted):
    scorer = toxicity.Scorer([toxicity.Term("moron", False, 1.0)], [*toxicity.BELIEF, -4.0])
    assert scorer.score(text)[1:] == (1, 0, int(quoted))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><header class="site-header"><h1>Site</h1></header><nav><a href="/a">a</a></nav>
<div class="ad">Buy now</div><main><article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>three</b><p>Four&nbsp;&#x35;<ul><li>x<li>y</ul><aside>side</aside></article>
<section class="comments"><p>reader says</p></section></main><form><p>mail</p></form><footer>&copy; f</footer></body></html>"""


def test_html(spark, none):
    assert html_text.main_text(PAGE) == "Head & line\n\nOne two three\n\nFour 5\n\nx\n\ny"
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("bare") == "bare" and html_text.main_text("<p>a<p>b &am") == "a\n\nb &am"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).collect():
        held = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = [" ".join(duckdb_unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", held)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def duckdb_unescape(text):
    import html

    return html.unescape(text)


def test_html_without_article():
    body = "<div id=menu><a href=1>one</a> <a href=2>two</a></div><div><h2>T</h2><p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p></div><div class='cookie-notice'>We use cookies</div><div><a href=3>link</a></div>"
    text = html_text.main_text(f"<body>{body}</body>")
    assert text.startswith("T\n\nword") and "cookies" not in text and "link" not in text and "one" not in text


def test_html_quotes_and_hostile_pages():
    assert html_text.main_text("<p title=it's>Hello one</p><p>World two it's</p><p>Three</p>") == "Hello one\n\nWorld two it's\n\nThree"
    assert html_text.main_text('<p class="a"">Hello one</p><p x="y>Two</p>') == "Hello one\n\nTwo"
    assert html_text.main_text("a < b <3 c</p >d<br/>e") == "a < b <3 c\n\nd e"
    assert html_text.main_text('<main><p class="ad-free story">one two three</p><p class="share-price">four</p></main>') == "one two three\n\nfour"
    began = time.time()
    for part in ("<a b ", '<p title="', "<!-", "<a b='c\" ", "</i>", "<b></i>", "a<"):
        html_text.main_text(part * (500_000 // len(part)))
    html_text.main_text("<div>" * 60_000 + "x" + "</div>" * 60_000)
    assert time.time() - began < 30


def test_html_rows(spark, none):
    pages = spark.createDataFrame([(1, None, "k", 7), (2, "", "k", 7), (3, "<p>a</p>", "k", 7), (3, "<p>a</p>", "k", 7), (4, "<p>" + "word " * 200_000 + "</p>", "k", 7)], "page_id long, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    long = ("word " * 200_000).strip()
    assert got == [(1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (4, long, len(long))]
    assert html_text.extract(pages.where("false")).count() == 0


def test_html_densities(spark):
    """Counts, densities and their sums against a parser of the standard library."""
    import math
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.root = self.at = {"tag": "html", "parent": None, "children": []}

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "parent": self.at, "children": []}
            self.at["children"].append(node)
            if tag != "br":
                self.at = node

        def handle_endtag(self, tag):
            self.at = self.at["parent"]

        def handle_data(self, data):
            self.at["children"].append(data)

    r = random.Random(6)

    def piece(depth):
        kind = r.random()
        if depth > 4 or kind < 0.35:
            return "".join(r.choices("abc  ", k=r.randint(1, 60)))
        tag = r.choice(["div", "section", "span", "a", "b"])
        return f"<{tag}>" + "".join(piece(depth + 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(40):
        page = "<body>" + "".join(f"<div>{piece(0)}</div>" for _ in range(5)) + "</body>"
        parser = Tree()
        parser.feed(page)

        def measure(n):
            own = [c for c in n["children"] if isinstance(c, str)]
            inner = [measure(c) for c in n["children"] if not isinstance(c, str)]
            chars = sum(len(" ".join(c.split())) for c in own) + sum(i["chars"] for i in inner)
            tags, links, a = sum(i["tags"] + 1 for i in inner), sum(i["links"] for i in inner), sum(i["a"] + (i["tag"] == "a") for i in inner)
            return {"tag": n["tag"], "chars": chars, "tags": tags, "links": chars if n["tag"] == "a" else links, "a": a, "inner": inner, "text": any(c.strip() for c in own)}

        top = measure(parser.root["children"][0])
        share = top["links"] / max(1, top["chars"])

        def dense(i):
            if not i["chars"]:
                return 0.0
            base = math.log(i["chars"] / max(1, i["chars"] - i["links"]) * i["links"] + share * i["chars"] + math.e)
            return i["chars"] / max(1, i["tags"]) * math.log(max(1.0, i["chars"] / max(1, i["links"]) * max(1, i["tags"]) / max(1, i["a"]))) / max(0.1, math.log(base))

        sums = []

        def walk(i):
            sums.append(round(sum(map(dense, i["inner"])) + (dense(i) if i["text"] and i["tag"] in ("div", "section", "body") else 0), 6))
            for c in i["inner"]:
                walk(c)

        walk(top)
        body, best = html_text.weigh(html_text.parse(page))
        assert round(best.total, 6) == max(sums) and body.chars == top["chars"]


def test_html_is_the_densest_subtree():
    links = "".join(f"<div><a href={k}>see also page {k}</a></div>" for k in range(8))
    post = "".join(f"<p>{w * 40}</p>" for w in ("one ", "two ", "three "))
    want = "\n\n".join((w * 40).strip() for w in ("one ", "two ", "three "))
    assert html_text.main_text(f"<body><div id=page><div class=links>{links}</div><div class=post>{post}</div><div>Up</div></div></body>") == want
    parts = f"<div class=part>{post}</div><div class=part><p>{'four ' * 60}</p></div>"
    assert html_text.main_text(f"<body><div id=page><div class=links>{links}</div>{parts}</div></body>") == want + "\n\n" + ("four " * 60).strip()
    held = f"<h2><a href=x>Title</a></h2>{post}<div>By me</div><ul><li>a<li>b</ul><p><a href=y>the paper</a></p>"
    for tag in ("article", "main"):
        assert html_text.main_text(f"<body><div><{tag}>{held}<div class=links>{links}</div></{tag}></div></body>") == f"Title\n\n{want}\n\nBy me\n\na\n\nb\n\nthe paper"


def test_html_names():
    text = "one two three four five six " * 12
    held = f"<h1>Title</h1><p>{text}</p><p>{text}</p>"
    want = f"Title\n\n{text.strip()}\n\n{text.strip()}"
    for name in ("wrap no-sidebar", "has-sidebar", "right-sidebar", "post-widget", "hasSidebar", "social"):
        for inner in (f"<article>{held}</article>", f"<div>{held}</div>"):
            assert html_text.main_text(f"<body><div class='{name}'>{inner}</div><div class='cookie-notice'>We use cookies</div></body>") == want, name
    for part in ("related-work", "social-policy", "comments-on-method", "comments"):
        for tag in ("article", "div"):
            page = f"<body><{tag}>{held}<h2 id='{part}'>Part</h2><p>{text}</p></{tag}></body>"
            assert html_text.main_text(page) == f"{want}\n\nPart\n\n{text.strip()}"
            page = f"<body><article>{held}<section id='{part}'><h2>Part</h2><p>{text}</p></section></article></body>"
            assert html_text.main_text(page) == f"{want}\n\nPart\n\n{text.strip()}"
    says = f"<p>{'says ' * 90}</p>" * 4
    for page in (f"<article>{held}</article><section class=comments>{says}</section>", f"<div>{held}</div><div id=comments>{says}</div>", f"<div class=right-sidebar><div>{held}</div><div class='comments-list'>{says}</div></div>", f"<article>{held}<div class=ad-slot><b>Buy</b> <b>now</b></div></article><div class=sideBar>{says}</div>"):
        assert html_text.main_text(f"<body>{page}</body>") == want


def test_chat(spark):
    says = [("a\\nb\nc", "x<|im_end|>\n<\\|<\\\\|"), ("assistant", "<|im_start|>assistant ok"), ("", ""), ("assistant", "é\n")]
    rows = spark.createDataFrame([(1, says), (2, []), (3, None)], "conv_id long, turns array<struct<role:string,text:string>>")
    out = chat.format_turns(rows).select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r["conv_id"]: ([tuple(t) for t in r["t"]], r["loss"]) for r in out} == {1: (says, "<|im_start|>assistant oké\n"), 2: ([], ""), 3: ([], "")}


def test_chat_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","completion":"a"}', '{"question":"q","answer":"a"}', '{"instruction":"q","output":"a"}', '{"zzz":1}', "{bad", None]
    out = chat.canonical_turns_from_json(spark.createDataFrame(list(enumerate(rows)), "conv_id long, j string"), "j").orderBy("conv_id").collect()
    assert [[tuple(t) for t in r["turns"]] if r["turns"] else None for r in out] == [[("user", "q"), ("assistant", "a")]] * 5 + [None] * 3
    odd = {
        '{"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a"}],"id":7,"meta":{"tags":["x"],"deep":{"y":1}}}': [("user", "q"), ("assistant", "a")],
        '{"messages":[]}': [], '{"messages":[{"role":"user"}]}': [("user", "")], '{"id":"1","prompt":"q","completion":5,"more":[]}': [("user", "q"), ("assistant", "5")], '{"messages":[{"role":"user","content":[{"type":"text","text":"q"}]}]}': None,
        '{"messages":null}': None, '[]': None, '"messages"': None, '{}': None, '': None,
    }
    out = chat.canonical_turns_from_json(spark.createDataFrame(list(enumerate(odd)), "conv_id long, j string"), "j").orderBy("conv_id").collect()
    assert [[tuple(t) for t in r["turns"]] if r["turns"] is not None else None for r in out] == list(odd.values())
    assert all((r["layout"] is None) == (r["turns"] is None) for r in out)
    table = spark.createDataFrame([(1, 1, "assistant", None, "x"), (1, 0, "user", "q", "x")], "conv_id long, turn long, role string, text string, extra string")
    assert [tuple(t) for t in chat.canonical_turns(table).first()["turns"]] == [("user", "q"), ("assistant", "")]
    typed = spark.createDataFrame([(1, "i", "n", "o")], "conv_id long, instruction string, input string, output string")
    assert [tuple(t) for t in chat.canonical_turns(typed).first()["turns"]] == [("user", "i\n\nn"), ("assistant", "o")]
    with pytest.raises(ValueError):
        chat.canonical_turns(typed.withColumnRenamed("output", "other"))


def test_chat_rows_of_the_query(spark):
    rows = [(1, 1, "assistant", "a", 0), (1, 0, "user", "q", 0), (1, 0, "user", "q", 0), (2, 0, None, None, 0), (None, 0, "user", "n", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    assert chat.BY_FINGERPRINT[chat.fingerprint(chat.known_paths(chat.paths_of(table.drop("conv_id").schema)))].name == "rows"
    out = chat.digest(chat.format_turns(chat.canonical_turns(table))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {1: (3, sha("user\nq\nuser\nq\nassistant\na\n"), 1, sha("a")), 2: (1, sha("\n\n"), 0, sha("")), None: (1, sha("user\nn\n"), 0, sha(""))}
    assert {r["conv_id"]: tuple(r)[1:5] for r in out} == want
    assert chat.digest(chat.format_turns(chat.canonical_turns(table.where("false")))).count() == 0


def test_held_out(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id")
    assert {r["doc_id"] for r in rows.where(held_out()).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(dict(zip(names, r))[k] for k in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in columns) for r in got.collect()), key=repr) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
    last = corpus_pipeline.run(spark, SF).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    fps = {i: fingerprint(rows[i]) for i in good}
    root = {i: i for i in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(good)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = sorted({find(i) for i in good})
    spans = {r[0]: r for r in brute_repeats([(i, rows[i]) for i in kept])}
    texts = {r["doc_id"]: r["decoded_sha256"] for r in last}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = [i for i in kept if spans[i][2] == 0]
    clean = {w[0] for w in brute_windows([(i, rows[i]) for i in whole], bench) if not w[2]}
    assert {i for i in whole if i in texts} == clean and set(texts) <= set(kept)
    assert all(texts[i] == hashlib.sha256(rows[i].encode()).hexdigest() for i in clean) and all(r["round_trip"] for r in last)
