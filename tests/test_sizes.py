"""What one task has of a larger table: files, ranges and joins grow in number, not in size."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators import select
from cairn.plans import publish
from cairn.sources import readers


@pytest.fixture
def rows(spark):
    return spark.range(300).select(F.col("id"), F.col("id").alias("seq"), F.format_string('t %d ,"news":[ {', "id").alias("title"), F.repeat(F.lit("x]\n}"), 50).alias("summary"), F.lit("u").alias("source_url"), F.lit(7.5).alias("ai_score"), F.lit("c").alias("category"), F.lit("s").alias("source_name"), F.lit("2026-01-01").alias("published_at"), F.lit(None).cast("timestamp").alias("ts"))


def test_a_long_feed_is_several_whole_files(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(publish, "FILE_BYTES", 10000)
    items = publish.rss_rows(rows, "http://s").withColumn("xml", F.regexp_replace("xml", "\n", "&#10;"))
    publish.write_feeds(items, "id", str(tmp_path / "rss"), "<rss><channel>", "</channel></rss>")
    files = sorted((tmp_path / "rss").glob("part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 30000
    assert [t.text for f in files for t in ET.parse(f).iter("title")] == [r["title"] for r in rows.orderBy("id").collect()]
    assert sorted(r["title"] for r in readers.rss_items(spark, str(tmp_path / "rss")).collect()) == sorted(r["title"] for r in rows.collect())


def test_a_long_document_is_read_by_lines(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(publish, "FILE_BYTES", 10000)
    path = tmp_path / "lines"
    publish.write_lines(publish.json_document({"news": (rows.drop("ts"), "seq"), "sources": (rows.limit(3).select("seq", F.col("title").alias("name")), "seq")}, {"version": "1"}), str(path))
    files = sorted(path.glob("part-*"))
    assert len(files) > 3
    want = json.loads("".join(f.read_text() for f in files))
    lines = readers.document_lines(spark, str(path))
    got = readers.section(lines, "news", schemas.NEWS).orderBy("seq").collect()
    assert [(r["seq"], r["id"], r["title"], r["summary"]) for r in got] == [(k, x["id"], x["title"], x["summary"]) for k, x in enumerate(want["news"])] and len(got) == 300
    assert [r["name"] for r in readers.section(lines, "sources", schemas.SOURCE).orderBy("seq").collect()] == [x["name"] for x in want["sources"]]
    assert readers.head(lines, "version string").first()["version"] == "1"


def test_numbers_of_long_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(select, "RANGE_BYTES", 10000)
    out = select.numbered(rows, [F.desc("seq")], "n")
    assert len(out.inputFiles()) > 3 and all(r["n"] == 300 - r["seq"] for r in out.collect())


def test_a_day_of_few_categories(spark, rows):
    """Whole rows never go to the few tasks that have a category."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = publish.daily_document(rows.select("seq", "title", F.col("source_url").alias("url"), F.col("summary").alias("content"), "source_name", "category", "published_at", "ai_score", F.lit(None).cast("string").alias("ai_reason")), "2026-01-01", {"c": "C"})
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.where("place.part = 3").count() == 301
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lists_of_the_index_are_made_before_the_shuffle(spark, tmp_path, rows):
    from cairn.operators.search_index import SearchIndex

    index = SearchIndex.create(rows.coalesce(1), str(tmp_path / "index"))
    lists = index._lists()
    assert lists.where("gram = 'new'").count() == 1 and lists.where("gram = 'new'").selectExpr("size(keys)").first()[0] == 300
    assert index.candidates("T 12 ,").count() == 1 and index.candidates('"news":[').count() == 300


@pytest.mark.parametrize("few", [0, 100])
def test_addresses_stay_where_they_are(spark, monkeypatch, few):
    """Addresses within one wide range do not meet in a task, and what they hit is counted without a sort."""
    from cairn.operators import addresses as A

    plans, save = [], A.Scratch.save
    plan = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(A, "FEW_RANGES", few, raising=False)
    monkeypatch.setattr(A.Scratch, "save", lambda self, df, *how: plan(df) or save(self, df, *how))
    known = spark.createDataFrame([(4, 8, "00001010", True), (4, 16, "0000101000000001", False), (4, 16, "0000101000000010", False), (4, 16, "0000101000000010", True), (4, 24, "000010100000000100000001", None)], "family int, size int, prefix string, closed boolean")
    given = ["10.0.0.1", "10.1.0.1", "10.1.1.1", "10.2.0.1", "11.0.0.1", "::1", "x", "", None, "10.0.0.1"]
    rows = spark.createDataFrame(list(enumerate(given)), "i long, address string")
    out = A.with_public(rows, known)
    plan(out)
    assert [r["public"] for r in out.orderBy("i").collect()] == [False, True, True, False, True, True, False, False, False, False]
    assert not any("SortAggregate" in p for p in plans) and (few == 0 or not any("[family" in line for p in plans for line in p.splitlines() if "SortMergeJoin" in line))
