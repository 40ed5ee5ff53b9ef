"""The queue's drain through failures, and the search index against a scan."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators.predicates import search
from cairn.operators.search_index import SearchIndex
from cairn.plans import publish
from cairn.sources import readers
from cairn.streaming import inbox


def test_drain_through_failures(spark, tmp_path):
    """A failure after the writes and before the commit: the batch comes again and replaces what it wrote."""
    queue = tmp_path / "queue"
    queue.mkdir()
    for k in range(3):
        lines = [{"url": f"http://x/{10 * k + i}", "source_name": "own" if i % 2 else ""} for i in range(4)] + [{"url": ""}]
        (queue / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
    pages = spark.createDataFrame([(f"http://x/{n}", f"<title>page {n}</title>" if n % 4 else "<p>no title</p>") for n in range(30) if n % 3], "url string, html string")
    stream = lambda: spark.readStream.schema(schemas.INBOX).option("maxFilesPerTrigger", 1).json(str(queue))
    where = [str(tmp_path / x) for x in ("table", "left", "cp")]
    failed = []

    def fail_once(number):
        if number not in failed and number < 2:
            failed.append(number)
            raise RuntimeError("lost between the write and the commit")

    for _ in range(2):
        with pytest.raises(Exception, match="lost between"):
            inbox.drain(stream(), pages, *where, before_commit=fail_once).awaitTermination()
    inbox.drain(stream(), pages, *where, before_commit=fail_once).awaitTermination()
    read = lambda path: [r["url"] for r in spark.read.schema("url string, batch long").parquet(path).collect()]
    kept, left = read(where[0]), read(where[1])
    urls = [10 * k + i for k in range(3) for i in range(4)]
    assert failed == [0, 1] and sorted(kept) == sorted(f"http://x/{n}" for n in urls if n % 3 and n % 4) and sorted(left) == sorted(f"http://x/{n}" for n in urls if not (n % 3 and n % 4))
    inbox.drain(stream(), pages, *where).awaitTermination()  # nothing is left on the queue
    assert sorted(read(where[0])) == sorted(kept)


def test_search_index(spark, tmp_path):
    words = ["Insurance", "保险新规", "reinsurance treaty", "İstanbul", "aa", "aaa", "aaaa", "a%b_c", None, ""]
    rows = [(i, words[i % 10], words[(i * 7 + 3) % 10], words[(i // 10) % 10], "claims" if i % 2 else "product") for i in range(100)]
    items = spark.createDataFrame(rows, "id long, title string, summary string, source_name string, category string")
    index = SearchIndex.create(items, str(tmp_path / "index"))
    for keyword in ("insurance", "SURAN", "保险新", "险新规", "aaa", "aaaa", "aaaaa", "aa", "a", "", "treaty ", "%b_", "nothing like it", "i̇st"):
        for category in ("all", "claims"):
            want = sorted(r["id"] for r in search(items, keyword, category, ("title", "summary", "source_name")).collect())
            assert sorted(r["id"] for r in SearchIndex(spark, str(tmp_path / "index")).search(items, keyword, category).collect()) == want, (keyword, category)
    assert index.candidates("aa") is None
    plan = index.candidates("treaty")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    SearchIndex.create(items.limit(1), str(tmp_path / "index"))
    assert SearchIndex(spark, str(tmp_path / "index")).candidates("treaty").count() == 0


def test_injected(spark):
    rows = spark.createDataFrame([("a<s>x<e>b<s>y<e>",), ("no markers",), ("<e>a<s>",), ("<s><e>",), (None,)], "t string")
    got = [r[0] for r in rows.select(publish.injected(F.col("t"), "<s>", "<e>", F.lit(r"\1$2"))).collect()]
    assert got == [r"a<s>\1$2<e>b<s>y<e>", None, None, r"<s>\1$2<e>", None]
    assert publish.inject("a<s>x<e>b<s>y<e>", "<s>", "<e>", r"\1$2") == got[0]


def test_first_rows_of_each_key(spark, tmp_path):
    """Rows of a key within the watermark's delay count once, over several micro-batches."""
    import datetime as dt

    from cairn.streaming import incremental

    at = lambda day, hour=0: dt.datetime(2026, 7, day, hour)
    for rows in ([("a", at(1)), ("b", at(1)), ("a", at(1, 5))], [("a", at(2)), ("c", at(2))], [("b", at(3)), ("d", at(20))]):
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = incremental.distinct_within(stream, ["k"])
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]


def test_markdown_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "claims", "S", 6.5), (1, "a", "claims", "T", 7.5), (3, "c", "other", None, 9.0)], "seq int, title string, category string, source_name string, ai_score double")
    got = {r["category"]: r["markdown"] for r in publish.daily_markdown(rows, "2026-07-01", {"claims": "K"}).collect()}
    assert got["claims"] == "## 2026-07-01 K\n\n- **a** (T)\n- b (S)\n" and got["other"].startswith("## 2026-07-01 other\n\n")
    publish.write_json(rows, str(tmp_path / "json"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert '"source_name":null' in "".join(r[0] for r in spark.read.text(str(tmp_path / "json")).collect())


def test_a_written_document_keeps_rows_without_an_order(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (-3, "b"), (2, "c")], "n long, id string")
    publish.write_lines(publish.json_document({"reports": (rows, "n")}, {"description": "d"}), str(tmp_path / "lines"), 2)
    lines = readers.document_lines(spark, str(tmp_path / "lines"))
    assert [(r["seq"], r["id"]) for r in readers.section(lines, "reports", "id string").orderBy("seq").collect()] == [(0, "a"), (1, "b"), (2, "c")]
