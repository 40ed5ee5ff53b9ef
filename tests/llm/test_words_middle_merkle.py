"""Substring dedup, fill-in-middle and the Merkle manifest against brute-force versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import fill_in_middle, merkle, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, other scripts, marks, and columns with clashing names."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdeéß日𝒳", k=r.randint(1, 5))) for _ in range(60)]
    passages = [" ".join(r.choices(words, k=k)) for k in (19, 20, 21, 45)]
    rows = []
    for i in range(120):
        t = r.choice([" ", "\n", "\t  "]).join(r.choices(words, k=r.randint(0, 50)))
        if r.random() < 0.5:
            t += r.choice([" ", "\v"]) + r.choice(passages) + r.choice(["", " end", "\n" + r.choice(passages)])
        if rows and r.random() < 0.2:
            t = r.choice(rows)[1]
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "ab " * 400), (204, "x" * 3000), (205, "word " * 6000), (3, rows[3][1]), (3, "other " + rows[4][1]), (None, rows[4][1]), (None, None), (-7, passages[3]), (206, "a<P>b"), (207, "a<<S"), (208, "İstanbul ÅNGSTRÖM " * 9)]
    return spark.createDataFrame([(i, t, "k", 1, None if i and i % 5 == 0 else ("é" if i and i % 2 else "z"), "src", len(t) if t else None) for i, t in rows], "doc_id long, text string, kept_text string, n int, lang string, source string, n_chars long")


def without_repeats(rows, size=20):
    first = {}
    split = [(i if i is not None else 2**63 - 1, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for (i, w), (doc, _) in zip(split, rows, strict=True):
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < (i, p) for q in range(p, p + size)}
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [None, 1 << 10])
def test_substrings(odd, monkeypatch, cells):
    if cells:  # a sketch so full that it rules out next to nothing
        monkeypatch.setattr(substring_dedup, "LEAST_CELLS", cells)
    got = substring_dedup.remove_repeats(odd, most_cells=cells or substring_dedup.MOST_CELLS)
    assert sorted(got.columns) == sorted([*odd.columns, "n_words", "n_removed", "spans"])
    want = without_repeats([(r["doc_id"], r["text"]) for r in odd.collect()])
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows), key=repr) == want
    assert all(r["n_removed"] == sum(s["last"] - s["first"] + 1 for s in r["spans"]) for r in rows)
    assert sum(r["n_removed"] for r in rows) > 1000


def test_substrings_pieces_of_texts(odd, monkeypatch):
    """Texts looked at a few at a time, partial sketches of a few anchors."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 300)
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    texts = [(r["text"] or "").encode() for r in odd.collect()]
    assert substring_dedup.remove_repeats(odd.where("false")).count() == 0
    known = substring_dedup.sketch(odd.select("text"))
    seen = {}
    for w in map(lambda t: substring_dedup.Words([t]), texts):
        for s, a in zip(w.window.tolist(), w.anchor.tolist(), strict=True):
            key = w.text[w.start[s] : w.end[s + 19]].tobytes()
            n, _ = seen.get(key, (0, a))
            seen[key] = n + 1, a
    repeated = np.array([a for n, a in seen.values() if n > 1], np.uint64)
    assert len(repeated) > 100 and known.repeated(repeated).all()
    assert len({a for _, a in seen.values()}) < len(seen)  # one anchor stands for several windows


def test_sketch_counts_all_partitions(spark):
    """An anchor of two partitions, once in each, is repeated; one of a single text is not, at this load."""
    r = random.Random(3)
    texts = [" ".join(str(r.random()) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts + texts[:1]], "text string").repartition(8)
    known = substring_dedup.sketch(docs)
    assert known.repeated(substring_dedup.Words([texts[0].encode()]).anchor).all()
    alone = np.concatenate([substring_dedup.Words([t.encode()]).anchor for t in texts[1:]])
    assert known.repeated(alone).mean() < 0.01


def brute_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_middle(odd):
    got = fill_in_middle.transform(odd).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute_middle(r["doc_id"], r["text"]) for r in odd.collect()), key=repr)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == want
    assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(odd.where("false")).count() == 0


def test_middle_parts_beside_marks(spark):
    """Parts that end or begin with pieces of marks are told apart from the marks."""
    rows = [(i, t) for i in range(40) for t in ("<P<S<M", "<>P>S>M>", "S>a<", "<<<>>>", "M><")]
    out = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), plain_from=100, spm=50)
    back = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert back.where("back != text OR form = 'plain'").count() == 0


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(rows, changed, fanout=8):
    """{(group, k): (leaf, subroot, root, proof, folded root, siblings)} by the definition."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*(value(r[c]) for c in merkle.FIELDS))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                first = i - i % fanout
                paths[k].append((nodes[first:i], nodes[i + 1 : first + fanout]))
            nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
            at = [i // fanout for i in at]
        return nodes[0], paths

    tops = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        tops[g] = climb([leaf(r) for r in own])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, above = climb([tops[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for r, path in zip(groups[g], tops[g][1], strict=True):
            node = leaf(changed(r))
            for left, right in path + up:
                node = digest(*left, node, *right)
            out.append((r["doc_id"], leaf(r), tops[g][0], root, digest(*(x for a, b in path + up for x in a + b)), node))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digits", [1, 3])
def test_merkle(odd, digits):
    tampered = lambda i: zlib.crc32(str(i).encode()) % 3 == 0 if i is not None else False
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = odd.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Big "), "text")).otherwise(F.col("text")))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = merkle.manifest(docs, changed={"text": F.when(hit, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))}, digits=digits, with_path=True).collect()
    want = brute_tree([r.asDict() for r in docs.collect()], lambda r: {**r, "text": low(r["text"])} if tampered(r["doc_id"]) else r)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got), key=repr) == want
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 2
    assert all(digest(*(x[side] for x in r["path"] for side in ("left", "right"))) == r["proof_sha256"] for r in got)
    assert merkle.manifest(odd.where("false")).count() == 0


def test_merkle_lone_leaf_and_far_ids(spark):
    rows = [(i, "t", "a", 1, "s") for i in (-(2**63), -5000, -1, 0, 4095, 4096, 2**40, 2**63 - 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string")
    got = merkle.manifest(docs).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows] and [r["rank"] for r in got] == list(range(8))
    assert all(r["verified"] and r["root"] == r["subroot"] for r in got)
    one = merkle.manifest(docs.where("doc_id = 0")).first()
    assert one["root"] == one["subroot"] == one["leaf"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = [random.Random(4).randrange(-(2**62), 2**62) for _ in range(3000)]
    ranks = merkle.manifest(spark.createDataFrame([(i, "t", "a", 1, "s") for i in ids], docs.schema)).select("rank", "doc_id").orderBy("rank").collect()
    assert [r["doc_id"] for r in ranks] == sorted(ids)
