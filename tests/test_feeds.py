"""Feeds are written in pages of bounded size, whatever the keys of the rows are."""

import pytest
from pyspark.sql import functions as F

from lexloom.registry import changes, feeds
from lexloom.sources import records

N = 3000


@pytest.fixture
def folder(spark, tmp_path):
    """Tables whose rows have the same key, or none, and one with all customers in one nation."""
    ids = spark.range(N, numPartitions=2)
    same = F.when(F.col("id") % 2 == 0, F.lit(5).cast("long"))
    ids.select(same.alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    ids.select(F.lit(5).cast("long").alias("o_orderkey"), F.lit("2020-01-02").cast("timestamp").alias("o_orderdate"), F.lit("O").alias("o_orderstatus"),
               F.lit("1").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    ids.select(F.col("id").alias("c_custkey"), (F.col("id") % 2).cast("int").alias("c_nationkey"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), F.lit(1).alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1).select(F.lit(1).alias("r_regionkey"), F.lit("R").alias("r_name")).write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, listed, bound, whole, rows", [
    ("read_echr_listing", "results", 512, True, N // 2), ("read_cjeu_bindings", "results.bindings", 512, True, N), ("read_court_export", "results", 128, False, N // 2)])
def test_pages_are_bounded(spark, folder, tmp_path, monkeypatch, name, listed, bound, whole, rows):
    monkeypatch.setattr(feeds, "_work", lambda *_: f"{tmp_path}/feed")
    assert feeds.QUERIES[name](spark, folder).count() == rows
    sizes = [r[0] for r in spark.read.json(f"{tmp_path}/feed", multiLine=whole).select(F.size(listed)).collect()]
    assert sum(sizes) == N and max(sizes) <= bound


def test_tables_of_contents_are_bounded(spark, folder, monkeypatch):
    seen, flatten = [], records.flatten_toc
    monkeypatch.setattr(records, "flatten_toc", lambda df: seen.append(df) or flatten(df))
    rows = feeds.toc(spark, folder).collect()
    assert len(rows) == N and {(r["text_id"], r["path"], int(r["id"]) % 2) for r in rows} == {(1, "R>N0", 0), (1, "R>N1", 1)}
    articles = "size(from_json(toc, 'sections array<struct<sections:array<struct<articles:array<struct<id:string>>>>>>').sections[0].sections.articles)"
    nested = [r[0] for r in seen[0].selectExpr(articles).collect()]
    assert max(nested) == 2  # a table of contents has several sections
    held = [r[0] for r in seen[0].selectExpr("toc").collect()]
    assert sum(t.count('"id"') for t in held) == N and max(t.count('"id"') for t in held) <= 1024


def test_late_log_is_not_written_by_one_task(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "_work_dir", lambda *_: f"{tmp_path}/late")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        changes.stream_late(spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "late" / "in").glob("part-*"))) > 3
