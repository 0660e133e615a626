"""Sources and sinks as round trips: given tables are written as a feed in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans import index
from lexloom.registry import Query, table
from lexloom.runtime import shared_dir
from lexloom.sources import records, sinks

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Records on one page of a listing, decisions with their texts in one object of an export, articles of one table of contents.
LISTED, EXPORTED, ARTICLES = 512, 128, 1024


def _work(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom-feeds/{name}-{uuid.uuid4().hex}"


def _paged(df: DataFrame, size: int) -> DataFrame:
    """Add ``_page``: every page has at most ``size`` (a power of two) rows, whatever their keys are, as rows are counted off in their task."""
    return df.withColumn("_page", F.shiftright(F.monotonically_increasing_id(), size.bit_length() - 1))


def directory_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a contact file with quotes, line ends and several addresses."""
    work = _work(spark, "csv")
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit('"'), "c_name", F.lit('";\nx')).alias("nom"),
        F.when(F.col("c_custkey") % 3 > 0, F.array(F.lit("a@b.fr"), F.concat("c_mktsegment", F.lit("@c.fr")))).alias("mails"))
    sinks.write_csv_sorted(c, work, "ord")
    return records.read_directory_csv(spark, work, "ord long, nom string, mails string").select("ord", "nom", F.array_join("mails", "|").alias("mails"))


QUERIES["read_directory_csv"] = directory_csv
ORACLES["read_directory_csv"] = """SELECT c_custkey AS ord, '"' || c_name || '";' || chr(10) || 'x' AS nom,
  CASE WHEN c_custkey % 3 > 0 THEN 'a@b.fr|' || c_mktsegment || '@c.fr' ELSE '' END AS mails FROM customer"""


def patch_tsv(spark: SparkSession, folder: str) -> DataFrame:
    work = _work(spark, "tsv")
    d = table(spark, folder, "documents").where("doc_id is not null")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")))
    d.select(line.alias("value")).write.text(work)
    return records.read_patch_tsv(spark, work, "doc_id long, text string").select("doc_id", F.md5("text").alias("digest"))


QUERIES["read_patch_tsv"] = patch_tsv
ORACLES["read_patch_tsv"] = "SELECT doc_id, md5(text) AS digest FROM documents"


def echr_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as listing pages, a few without identifier."""
    work = _work(spark, "echr")
    item = F.struct(F.when(F.col("doc_id") % 10 > 0, F.col("doc_id").cast("string")).otherwise(" ").alias("itemid"), F.col("source").alias("docname"),
                    F.lit("2001-02-03T00:00:00").alias("kpdate"), F.col("lang").alias("doctype"))
    pages = _paged(table(spark, folder, "documents"), LISTED).groupBy("_page").agg(F.collect_list(F.struct(item.alias("columns"))).alias("results"))
    pages.select("results").write.option("maxRecordsPerFile", 1).json(work)
    return records.read_echr_listing(spark, work).select("itemid", "docname", "date", "doctype")


QUERIES["read_echr_listing"] = echr_listing
ORACLES["read_echr_listing"] = "SELECT CAST(doc_id AS VARCHAR) AS itemid, source AS docname, '2001-02-03' AS date, lang AS doctype FROM documents WHERE doc_id % 10 > 0"


def cjeu_bindings(spark: SparkSession, folder: str) -> DataFrame:
    work = _work(spark, "cjeu")
    value = lambda c: F.struct(c.alias("value"))
    celex = F.concat(F.lit("62019CJ"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    binding = F.struct(value(celex).alias("celex"), value(F.when(F.col("o_orderkey") % 2 == 0, F.lit("ECLI:EU:C:2019:1"))).alias("ecli"),
                       value(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date"), value(F.concat(F.lit("http://x/y#/"), "o_orderstatus")).alias("type"),
                       value(F.col("o_orderpriority")).alias("title"))
    page = _paged(table(spark, folder, "orders"), LISTED).groupBy("_page").agg(F.struct(F.collect_list(binding).alias("bindings")).alias("results"))
    page.select("results").write.option("maxRecordsPerFile", 1).json(work)
    return records.read_cjeu_bindings(spark, work)


QUERIES["read_cjeu_bindings"] = cjeu_bindings
ORACLES["read_cjeu_bindings"] = """SELECT '62019CJ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS celex,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ECLI:EU:C:2019:1' ELSE 'ECLI:EU:C:2019:' || (o_orderkey % 10000) END AS ecli, strftime(o_orderdate, '%Y-%m-%d') AS date,
  o_orderstatus AS type, o_orderpriority AS title FROM orders"""


def admin_hits(spark: SparkSession, folder: str) -> DataFrame:
    work = _work(spark, "hits")
    d = table(spark, folder, "documents")
    source = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("Identification"), F.col("source").alias("Code_Juridiction"),
                      F.when(F.col("doc_id") % 4 == 0, "undefined").otherwise(F.col("lang")).alias("Nom_Juridiction"),
                      F.when(F.col("doc_id") % 3 > 0, "2010-11-12").otherwise(" ").alias("Date_Lecture"), F.lit("2013-01-02T10:00").alias("lastModified"),
                      F.concat(F.lit("$$$ un $$$"), "source", F.lit(" $$$ $$$")).alias("paragraph"))
    d.select(source.alias("_source")).write.json(work)
    return records.read_admin_hits(spark, work).select("id", "juridiction_code", "juridiction_name", "date", "texte")


QUERIES["read_admin_hits"] = admin_hits
ORACLES["read_admin_hits"] = """SELECT CAST(doc_id AS VARCHAR) AS id, source AS juridiction_code, CASE WHEN doc_id % 4 > 0 THEN lang END AS juridiction_name,
  CASE WHEN doc_id % 3 > 0 THEN '2010-11-12' ELSE '2013-01-02' END AS date, 'un' || chr(10) || chr(10) || source AS texte FROM documents"""


def court_export(spark: SparkSession, folder: str) -> DataFrame:
    work = _work(spark, "export")
    row = F.struct(F.when(F.col("doc_id") % 9 > 0, F.col("doc_id").cast("string")).alias("id"), F.lit("autre").alias("jurisdiction"), F.array("source", "lang").alias("themes"), "text")
    _paged(table(spark, folder, "documents"), EXPORTED).groupBy("_page").agg(F.collect_list(row).alias("results")).select("results").write.json(work)
    return records.read_court_export(spark, work).select("id", "titre", "juridiction", F.md5("text").alias("digest"))


QUERIES["read_court_export"] = court_export
ORACLES["read_court_export"] = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS titre, 'autre' AS juridiction, md5(text) AS digest FROM documents WHERE doc_id % 9 > 0"


def json_sink(spark: SparkSession, folder: str) -> DataFrame:
    work = _work(spark, "json")
    d = table(spark, folder, "documents")
    sinks.write_json(d, work, d.groupBy("lang").agg(F.count("*").alias("n")))
    rows = spark.read.schema(d.schema).json(f"{work}/rows").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return rows.join(spark.read.schema("lang string, n long").json(f"{work}/meta"), ["lang", "n"])


QUERIES["write_json"] = json_sink
ORACLES["write_json"] = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL"


def table_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by year, a few without a date."""
    work = _work(spark, "table")
    o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 > 0, F.col("o_orderdate").cast("date").cast("string")).alias("date"))
    sinks.write_table(o, work)
    return spark.read.parquet(work).select("o_orderkey", "date", F.col("year").cast("long").alias("year"))


QUERIES["write_table"] = table_sink
ORACLES["write_table"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 8 > 0 THEN year(o_orderdate) ELSE 0 END AS year FROM orders"""


def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """A stored index gives the postings it was written from."""
    name = f"lexloom_postings_{uuid.uuid4().hex}"
    index.write_postings(index.postings(table(spark, folder, "documents"), "doc_id", ["text"], "documents"), name, 8)
    return index.read_postings(spark, name).groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("tf").cast("long").alias("occurrences"))


QUERIES["write_postings"] = stored_index
ORACLES["write_postings"] = r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(list_distinct(w)) AS words, len(w) AS occurrences FROM t WHERE len(w) > 0"""


def toc(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations and customers as nested tables of contents, several of bounded size for each region."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    leaf = _paged(c, ARTICLES).groupBy("_page", F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("num"))).alias("articles"))
    mid = n.join(leaf, "n_nationkey").groupBy("_page", F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("title"), "articles")).alias("sections"))
    top = r.join(mid, "r_regionkey").select(F.col("r_regionkey").alias("text_id"), F.to_json(F.struct(F.lit("").alias("title"), F.array(F.struct(F.col("r_name").alias("title"), "sections")).alias("sections"))).alias("toc"))
    return records.flatten_toc(top).select("text_id", F.array_join("path", ">").alias("path"), "id", "num")


QUERIES["flatten_toc"] = toc
ORACLES["flatten_toc"] = """SELECT r_regionkey AS text_id, r_name || '>' || n_name AS path, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS num
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
