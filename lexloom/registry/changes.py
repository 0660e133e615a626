"""Merges, patches, gaps, usage counters and streams. Orders are the kept table; residues of the
key decide what a batch or a change log does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import filters, joins, merge, windows
from lexloom.plans import index
from lexloom.registry import Query, table
from lexloom.runtime import shared_dir, stage
from lexloom.streaming import flows
from lexloom.streaming.tables import ChangeTable

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), "o_custkey")


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).where(F.col("id") % 10 < 7).select("id", "v")


def batch(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the rows come twice; the second delivery has a higher number and another value."""
    r = _rows(spark, folder).where(F.col("id") % 10 >= 5)
    one = r.select("id", F.lower("v").alias("v"), F.col("o_custkey").alias("seq"))
    two = r.where(F.col("id") % 2 == 0).select("id", F.concat("v", F.lit("2")).alias("v"), (F.col("o_custkey") + 10_000_000).alias("seq"))
    return one.unionByName(two)


_KEPT_SQL = "kept AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 < 7)"
_BATCH_SQL = """last AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '2' ELSE lower(o_orderstatus) END AS v FROM orders WHERE o_orderkey % 10 >= 5),
first AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS v FROM orders WHERE o_orderkey % 10 >= 5)"""

QUERIES["upsert"] = lambda spark, folder: merge.upsert(kept(spark, folder), batch(spark, folder), "id", "seq").select("id", "v")
ORACLES["upsert"] = f"WITH {_KEPT_SQL}, {_BATCH_SQL} SELECT id, v FROM kept WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, v FROM last"
QUERIES["insert_ignore"] = lambda spark, folder: merge.insert_ignore(kept(spark, folder), batch(spark, folder), "id", "seq").select("id", "v")
ORACLES["insert_ignore"] = f"WITH {_KEPT_SQL}, {_BATCH_SQL} SELECT id, v FROM kept UNION ALL SELECT id, v FROM first WHERE id NOT IN (SELECT id FROM kept)"


def log(spark: SparkSession, folder: str) -> DataFrame:
    b = batch(spark, folder)
    op = F.when(F.col("id") % 3 == 0, "delete").when(F.col("id") % 3 == 1, "modify").otherwise("create")
    return b.withColumn("op", op).unionByName(b.withColumn("op", op))  # delivered twice


_ALIVE = "id % 3 <> 0"
QUERIES["apply_changes"] = lambda spark, folder: merge.apply_changes(kept(spark, folder), log(spark, folder), "id", "seq")
ORACLES["apply_changes"] = f"WITH {_KEPT_SQL}, {_BATCH_SQL} SELECT id, v FROM kept WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, v FROM last WHERE {_ALIVE}"
QUERIES["change_counts"] = lambda spark, folder: merge.change_counts(merge.change_actions(kept(spark, folder), log(spark, folder), "id", "seq"))
ORACLES["change_counts"] = f"""WITH {_KEPT_SQL}, {_BATCH_SQL} SELECT CASE WHEN id % 3 = 0 THEN CASE WHEN id % 10 < 7 THEN 'deleted' ELSE 'ignored' END
  WHEN id % 10 < 7 THEN 'updated' ELSE 'inserted' END AS action, count(*) AS n FROM last GROUP BY ALL"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("legiarti"), F.col("o_orderdate").cast("date").alias("date_debut"), F.lit("a").alias("v"))
    old = o.where(F.col("legiarti") % 2 == 0).dropDuplicates(["legiarti", "date_debut"])
    return merge.append_versions(old, o.withColumn("v", F.lit("b")))


QUERIES["append_versions"] = versions
ORACLES["append_versions"] = "SELECT DISTINCT o_custkey AS legiarti, CAST(o_orderdate AS DATE) AS date_debut, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS v FROM orders"


def open_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions with an open start, delivered twice."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("legiarti"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("date")).alias("date_debut"),
                                              F.col("o_orderkey").alias("v"))
    once = merge.append_versions(o.limit(0), o, "v")
    return merge.append_versions(once, o, "v")


QUERIES["append_versions_twice"] = open_versions
ORACLES["append_versions_twice"] = "SELECT o_custkey AS legiarti, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS date_debut, min(o_orderkey) AS v FROM orders GROUP BY ALL"
QUERIES["patch_columns_twice"] = lambda spark, folder: joins.patch_columns(_rows(spark, folder), batch(spark, folder), "id", "seq").select("id", "v", "o_custkey")
ORACLES["patch_columns_twice"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 5 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '2'
  ELSE lower(o_orderstatus) END AS v, o_custkey FROM orders"""
QUERIES["patch_text_twice"] = lambda spark, folder: joins.patch_text(table(spark, folder, "documents"), table(spark, folder, "documents").select(
    "doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("text")).withColumn("n", F.when(F.col("text") == "a", 2).otherwise(1)), "doc_id", "text", 1000, "n").select(
    "doc_id", F.md5("text").alias("digest"))
ORACLES["patch_text_twice"] = "SELECT doc_id, md5(CASE WHEN length(text) < 1000 OR NOT contains(text, chr(10)) THEN 'a' ELSE text END) AS digest FROM documents"
QUERIES["align_schema"] = lambda spark, folder: merge.align_schema(kept(spark, folder), _rows(spark, folder).where("id % 10 = 9").withColumnRenamed("o_custkey", "extra")).groupBy(
    F.col("extra").isNull().alias("blank")).agg(F.count("*").alias("n"), F.count("v").alias("filled"))
ORACLES["align_schema"] = "SELECT o_orderkey % 10 < 7 AS blank, count(*) AS n, count(o_orderstatus) AS filled FROM orders WHERE o_orderkey % 10 < 7 OR o_orderkey % 10 = 9 GROUP BY ALL"

QUERIES["gaps"] = lambda spark, folder: joins.gaps(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "documents").join(
    table(spark, folder, "labels"), "doc_id", "left_semi"), "doc_id", "text", 600)
ORACLES["gaps"] = "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE length(text) > 600)"
QUERIES["not_enriched"] = lambda spark, folder: joins.not_enriched(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "doc_id").select("doc_id", "source")
ORACLES["not_enriched"] = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
QUERIES["with_meta"] = lambda spark, folder: joins.with_meta(table(spark, folder, "documents"), table(spark, folder, "labels").withColumnRenamed("doc_id", "decision_id"), "doc_id").select(
    "doc_id", "source", F.col("quality").cast("long").alias("quality"))
ORACLES["with_meta"] = "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)"


def known_split(spark: SparkSession, folder: str) -> DataFrame:
    known, unknown = joins.split_known(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")
    return known.agg(F.count("*").alias("n")).withColumn("known", F.lit(True)).unionByName(unknown.agg(F.count("*").alias("n")).withColumn("known", F.lit(False)))


QUERIES["split_known"] = known_split
ORACLES["split_known"] = "SELECT known, count(*) AS n FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS known FROM documents) GROUP BY ALL"


def patched_text(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    patch = d.where(F.col("doc_id") % 2 == 0).select("doc_id", F.concat(F.lit("nouveau "), "source").alias("text"))
    return joins.patch_text(d, patch, "doc_id", "text", 1000).select("doc_id", F.md5("text").alias("digest"))


QUERIES["patch_text"] = patched_text
ORACLES["patch_text"] = "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND (length(text) < 1000 OR NOT contains(text, chr(10))) THEN 'nouveau ' || source ELSE text END) AS digest FROM documents"
QUERIES["patch_columns"] = lambda spark, folder: joins.patch_columns(_rows(spark, folder), batch(spark, folder).where("seq >= 10000000").withColumn("inconnu", F.lit(1)), "id").select("id", "v", "o_custkey")
ORACLES["patch_columns"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 >= 5 AND o_orderkey % 2 = 0 THEN o_orderstatus || '2' ELSE o_orderstatus END AS v, o_custkey FROM orders"


def renamed(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    c = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit("TJ de "), F.lpad("n_nationkey", 5, "0")).alias("juridiction"), F.concat(F.lit("TJ de "), F.lpad("n_nationkey", 5, "0"), F.lit(", n° "), "c_custkey").alias("titre"))
    ren = n.where(F.col("n_nationkey") % 4 > 0).select(F.concat(F.lit("TJ de "), F.lpad("n_nationkey", 5, "0")).alias("old_name"), F.concat(F.lit("TJ de "), "n_name").alias("new_name"))
    return joins.rename_locations(c, ren)


QUERIES["location_rename"] = lambda spark, folder: renamed(spark, folder)
_RENAMED_SQL = """SELECT c_custkey, CASE WHEN n_nationkey % 4 > 0 THEN 'TJ de ' || n_name ELSE 'TJ de ' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS juridiction FROM customer JOIN nation ON c_nationkey = n_nationkey"""
ORACLES["location_rename"] = f"WITH r AS ({_RENAMED_SQL}) SELECT c_custkey, juridiction, juridiction || ', n° ' || c_custkey AS titre FROM r"
QUERIES["rename_residuals"] = lambda spark, folder: joins.rename_residuals(renamed(spark, folder))
ORACLES["rename_residuals"] = f"WITH r AS ({_RENAMED_SQL}) SELECT juridiction, count(*) AS n FROM r WHERE regexp_matches(juridiction, ' de [0-9]{{5}}$') GROUP BY ALL"


def locations(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    c = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ca_ville_"), "c_nationkey")).otherwise(F.concat(F.lit("tj"), "c_nationkey")).alias("location"),
                                                F.when(F.col("c_custkey") % 2 == 0, "ca").otherwise("tj").alias("jurisdiction"))
    dim = n.where(F.col("n_nationkey") % 3 == 0).select(F.concat(F.lit("tj"), "n_nationkey").alias("location"), F.concat(F.lit("Tribunal judiciaire de "), "n_name").alias("name"))
    return joins.location_name(c, dim).select("c_custkey", "juridiction")


QUERIES["location_name"] = locations
ORACLES["location_name"] = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Cour d''appel de Ville ' || c_nationkey WHEN c_nationkey % 3 = 0 THEN 'Tribunal judiciaire de NATION_' || c_nationkey
  ELSE 'Tribunal judiciaire de ' || c_nationkey END AS juridiction FROM customer"""


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one source and tenth are versions of one case."""
    d = table(spark, folder, "documents").select("doc_id", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50)).alias("case"), F.when(F.col("lang") == "fr", "FRE").when(F.col("lang") == "en", "ENG").otherwise("ZZZ").alias("lang"), "text")
    return joins.best_language(d, ["case"], "lang", "text", "doc_id", 1000).select("case_key", "doc_id", "lang")


QUERIES["best_language"] = languages
ORACLES["best_language"] = """WITH d AS (SELECT doc_id, source || '-' || CAST(floor(doc_id / 50) AS BIGINT) AS case_key, CASE lang WHEN 'fr' THEN 'FRE' WHEN 'en' THEN 'ENG' ELSE 'ZZZ' END AS lang FROM documents WHERE length(text) > 1000),
r AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY CASE lang WHEN 'FRE' THEN 0 WHEN 'ENG' THEN 1 ELSE 2 END, doc_id) AS rn FROM d) SELECT case_key, doc_id, lang FROM r WHERE rn = 1"""


def reindexed(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth document is replaced by its source name, every seventh vanishes."""
    d = table(spark, folder, "documents").select("doc_id", "text", "source")
    before = stage(index.postings(d, "doc_id", ["text"], "d"), "before")
    after = d.where(F.col("doc_id") % 7 > 0).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.col("text")))
    changed = d.where((F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 5 == 0)).select("doc_id")
    return index.term_stats(index.reindex(before, after, changed, "doc_id", ["text"], "d")).select("term", "df", "cf")


QUERIES["reindex"] = reindexed
ORACLES["reindex"] = r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(strip_accents(lower(CASE WHEN doc_id % 5 = 0 THEN source ELSE text END)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term
  FROM documents WHERE doc_id % 7 > 0) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY ALL"""
QUERIES["recent"] = lambda spark, folder: filters.recent(table(spark, folder, "events"), 48, "ts", F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")
ORACLES["recent"] = "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'"

# Usage: events are tool calls.
_DAY, _HOUR = "strftime(ts + INTERVAL 2 HOURS, '%Y-%m-%d')", "strftime(ts + INTERVAL 2 HOURS, '%Y-%m-%dT%H')"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES["usage_by_day"] = lambda spark, folder: flows.usage_counts(events(spark, folder), "1 day")
ORACLES["usage_by_day"] = f"SELECT {_DAY} AS bucket, count(*) AS n FROM events GROUP BY ALL"
QUERIES["usage_by_hour_tool"] = lambda spark, folder: flows.usage_counts(events(spark, folder), "1 hour", tool_col="event_type")
ORACLES["usage_by_hour_tool"] = f"SELECT {_HOUR} AS bucket, event_type AS tool, count(*) AS n FROM events GROUP BY ALL"
QUERIES["retain_latest"] = lambda spark, folder: flows.usage_series(events(spark, folder))["hours_tools"]
ORACLES["retain_latest"] = f"WITH u AS (SELECT {_HOUR} AS bucket, event_type AS tool, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM u WHERE bucket IN (SELECT DISTINCT bucket FROM u ORDER BY bucket DESC LIMIT 75)"
QUERIES["retain_latest_days"] = lambda spark, folder: windows.retain_latest(flows.usage_counts(events(spark, folder), "1 day"), "bucket", 7)
ORACLES["retain_latest_days"] = f"WITH u AS (SELECT {_DAY} AS bucket, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM u ORDER BY bucket DESC LIMIT 7"


def _work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared area for one run of a streaming query."""
    return f"{shared_dir(spark)}/lexloom-stream/{name}-{uuid.uuid4().hex}"


def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Events arrive as files; hourly counts per tool end up in a keyed table."""
    work = _work_dir(spark, "usage")
    source = table(spark, folder, "events")
    source.repartition(4).write.parquet(f"{work}/in")
    target = ChangeTable(spark, f"{work}/table", "id string, bucket string, tool string, n long", "id")
    target.create()
    flows.usage_counters(spark, f"{work}/in", source.schema, target, f"{work}/cp", "1 hour").awaitTermination()
    return target.read().select("bucket", "tool", "n")


QUERIES["stream_usage"] = stream_usage
ORACLES["stream_usage"] = ORACLES["usage_by_hour_tool"]


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A change log delivered with overlap keeps the orders table current."""
    work = _work_dir(spark, "upsert")
    entries = log(spark, folder).withColumn("tx_id", F.concat_ws("-", "id", "seq")).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp")).withColumn("id", F.col("id").cast("string"))
    entries.select("seq", "tx_id", "id", "op", "ts", "v").repartition(3).write.json(f"{work}/in")
    target = ChangeTable(spark, f"{work}/table", "id string, v string", "id")
    target.create(kept(spark, folder).withColumn("id", F.col("id").cast("string")))
    flows.stream_change_log(spark, f"{work}/in", "v string", target, f"{work}/cp").awaitTermination()
    return target.read().select(F.col("id").cast("long").alias("id"), "v")


def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose time stamps go back by months while the log is read, file by file."""
    work = _work_dir(spark, "late")
    entries = log(spark, folder).withColumn("tx_id", F.concat_ws("-", "id", "seq")).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 3600)).withColumn("id", F.col("id").cast("string"))
    for part in range(3):
        entries.where(F.pmod(F.xxhash64("tx_id"), F.lit(3)) == part).select("seq", "tx_id", "id", "op", "ts", "v").repartition("tx_id").write.mode("append").json(f"{work}/in")
        target = ChangeTable(spark, f"{work}/table", "id string, v string", "id")
        if part == 0:
            target.create(kept(spark, folder).withColumn("id", F.col("id").cast("string")))
        flows.stream_change_log(spark, f"{work}/in", "v string", target, f"{work}/cp").awaitTermination()
    return target.read().select(F.col("id").cast("long").alias("id"), "v")


QUERIES["stream_late_changes"] = stream_late
ORACLES["stream_late_changes"] = ORACLES["apply_changes"]
QUERIES["stream_upsert"] = stream_upsert
ORACLES["stream_upsert"] = ORACLES["apply_changes"]
QUERIES["skip_complete"] = lambda spark, folder: flows.skip_complete(table(spark, folder, "documents"), table(spark, folder, "documents").where("doc_id % 2 = 0"), "doc_id", "text", 1000).select("doc_id")
ORACLES["skip_complete"] = "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 OR length(text) <= 1000"
