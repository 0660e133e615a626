"""Directory: customers and suppliers are two feeds of contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import norm_name
from lexloom.operators import aggregates, filters, windows
from lexloom.plans import directory
from lexloom.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Names repeat (key modulo 40), a third has no address, other fields are filled by residues.
_FEED_SQL = """d AS (SELECT c_custkey AS ord, lower(c_mktsegment) AS type, 'Bureau ' || (c_custkey % 40) AS nom, CASE WHEN c_custkey % 3 > 0 THEN 'c' || c_custkey || '@x.fr' END AS mail,
  CASE WHEN c_custkey % 5 > 0 THEN '01' END AS tel, CASE WHEN c_custkey % 7 > 0 THEN 'site' END AS site, 'dila' AS source FROM customer
UNION ALL SELECT 100000000 + s_suppkey, 'machinery', 'BUREAU  ' || (s_suppkey % 40), CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey || '@y.fr' END,
  CASE WHEN s_suppkey % 3 > 0 THEN '02' END, NULL, 'api' FROM supplier)"""


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    mails = lambda test, mail: F.when(test, F.array(mail)).otherwise(F.array().cast("array<string>")).alias("mails")
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    one = c.select(k.alias("ord"), F.lower("c_mktsegment").alias("type"), F.concat(F.lit("Bureau "), k % 40).alias("nom"), mails(k % 3 > 0, F.concat(F.lit("c"), k, F.lit("@x.fr"))),
                   F.when(k % 5 > 0, "01").alias("tel"), F.when(k % 7 > 0, "site").alias("site"), F.lit("dila").alias("source"))
    two = s.select((j + 100000000).alias("ord"), F.lit("machinery").alias("type"), F.concat(F.lit("BUREAU  "), j % 40).alias("nom"), mails(j % 2 == 0, F.concat(F.lit("s"), j, F.lit("@y.fr"))),
                   F.when(j % 3 > 0, "02").alias("tel"), F.lit("api").alias("source"))
    return windows.union_directory(one, two)


def merge_directory(spark: SparkSession, folder: str) -> DataFrame:
    return windows.merge_directory(feeds(spark, folder)).select("ord", "type", norm_name("nom").alias("nom"), F.array_join("mails", ";").alias("mails"))


_MERGED_SQL = f"""{_FEED_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY type, lower(regexp_replace(nom, '\\s+', ' ', 'g')) ORDER BY
  CASE WHEN mail IS NULL THEN 0 ELSE 1 END DESC, CASE WHEN mail IS NULL THEN 0 ELSE (CASE WHEN tel IS NULL THEN 0 ELSE 1 END + CASE WHEN site IS NULL THEN 0 ELSE 1 END) END DESC, ord) AS rn FROM d),
u AS (SELECT * FROM m WHERE rn = 1)"""
QUERIES["merge_directory"] = merge_directory
ORACLES["merge_directory"] = f"WITH {_MERGED_SQL} SELECT ord, type, lower(regexp_replace(nom, '\\s+', ' ', 'g')) AS nom, coalesce(mail, '') AS mails FROM u"
QUERIES["coverage"] = lambda spark, folder: aggregates.coverage(feeds(spark, folder))
ORACLES["coverage"] = f"WITH {_FEED_SQL} SELECT type, count(*) AS total, count(mail) AS with_mail, round(count(mail) * 100.0 / count(*), 1)::DOUBLE AS rate FROM d GROUP BY ALL"
QUERIES["directory_meta"] = lambda spark, folder: aggregates.directory_meta(windows.merge_directory(feeds(spark, folder)))
ORACLES["directory_meta"] = f"""WITH {_MERGED_SQL} SELECT count(*) AS entries, count(mail) AS with_mail, count(tel) AS with_phone, count(site) AS with_site, count(*) FILTER (source = 'dila') AS from_dila,
  count(*) FILTER (source = 'api') AS from_api, 0 AS from_manual, count(DISTINCT type) AS types, count(mail) AS addresses FROM u"""


def gates(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"volume": (F.count("*"), 50), "with_phone": (F.count("tel"), 1_000_000), "no_blank_name": (-F.count_if(F.trim("nom") == ""), 0),
             "mails_have_at": (-F.count_if(F.exists("mails", lambda m: ~m.contains("@"))), 0)}
    return aggregates.quality_gates(feeds(spark, folder), rules)


QUERIES["quality_gates"] = gates
ORACLES["quality_gates"] = f"""WITH {_FEED_SQL}, g AS (SELECT count(*)::DOUBLE AS a, count(tel)::DOUBLE AS b FROM d)
SELECT 'volume' AS rule, a AS actual, 50.0::DOUBLE AS minimum, a >= 50 AS passed FROM g UNION ALL SELECT 'with_phone', b, 1000000, b >= 1000000 FROM g
UNION ALL SELECT 'no_blank_name', 0, 0, true UNION ALL SELECT 'mails_have_at', 0, 0, true"""


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    return windows.dedup_contacts(feeds(spark, folder).select("ord", F.lower("nom").alias("organisme"), F.coalesce("tel", F.lit("")).alias("adresse")), "ord")


QUERIES["dedup_contacts"] = contacts
ORACLES["dedup_contacts"] = f"WITH {_FEED_SQL} SELECT min(ord) AS ord, lower(nom) AS organisme, coalesce(tel, '') AS adresse FROM d GROUP BY 2, 3"


def ordered(spark: SparkSession, folder: str) -> DataFrame:
    typed = feeds(spark, folder).withColumn("type", F.get(F.array(*[F.lit(t) for t in ("mairie", "ta", "inconnu", "tgi")]), (F.col("ord") % 4).cast("int")))
    return windows.ordered_directory(typed).select("ord", F.col("type_rank").cast("long").alias("type_rank"))


QUERIES["ordered_directory"] = ordered
ORACLES["ordered_directory"] = f"WITH {_FEED_SQL} SELECT ord, [26, 3, 99, 0][ord % 4 + 1] AS type_rank FROM d"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return feeds(spark, folder).select(F.col("ord").alias("entry_id"), F.coalesce(F.get("mails", F.lit(0)), F.lit("")).alias("mail"), F.col("nom").alias("organisme"),
                                       F.col("type").alias("service"), F.col("type").alias("categorie"), F.upper("type").alias("categorie_slug"), "source")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """One query per nation: part of an address, of a name or of a type, in any letter case."""
    n = F.col("n_nationkey")
    return table(spark, folder, "nation").select(n.alias("query_id"), F.when(n % 3 == 0, F.concat(F.lit(" C"), n, F.lit("@X"))).when(n % 3 == 1, F.concat(F.lit("au "), n)).otherwise(
        F.get(F.array(*[F.lit(t) for t in ("machin", "HOLD", "fu")]), (n % 3).cast("int"))).alias("query"))


_ASKED_SQL = """q AS (SELECT n_nationkey AS query_id, lower(trim(CASE n_nationkey % 3 WHEN 0 THEN ' C' || n_nationkey || '@X' WHEN 1 THEN 'au ' || n_nationkey ELSE ['machin','HOLD','fu'][n_nationkey % 3 + 1] END)) AS q FROM nation),
s AS (SELECT query_id, ord AS entry_id, CASE WHEN contains(lower(coalesce(mail, '')), q) THEN 3 WHEN contains(lower(nom), q) THEN 2 WHEN contains(type, q) THEN 1 ELSE 0 END AS score FROM q, d)"""
QUERIES["search_directory"] = lambda spark, folder: directory.search_directory(_asked(spark, folder), _entries(spark, folder)).select(
    "query_id", "entry_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
ORACLES["search_directory"] = f"""WITH {_FEED_SQL}, {_ASKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s WHERE score > 0)
SELECT query_id, entry_id, score, rank FROM r WHERE rank <= 20"""
QUERIES["directory_totals"] = lambda spark, folder: directory.directory_totals(_asked(spark, folder), _entries(spark, folder))
ORACLES["directory_totals"] = f"WITH {_FEED_SQL}, {_ASKED_SQL} SELECT query_id, count(*) AS total FROM s WHERE score > 0 GROUP BY ALL"
QUERIES["directory_filter"] = lambda spark, folder: filters.directory_filter(_entries(spark, folder), " Build", "DILA").select("entry_id", "categorie")
ORACLES["directory_filter"] = f"WITH {_FEED_SQL} SELECT ord AS entry_id, type AS categorie FROM d WHERE contains(type, 'build') AND source = 'dila'"
QUERIES["unlisted_profile"] = lambda spark, folder: aggregates.unlisted_profile(
    feeds(spark, folder).withColumn("dated", F.when(F.col("ord") % 2 == 0, F.lit("2024"))), "nom", "tel", "dated")
ORACLES["unlisted_profile"] = f"WITH {_FEED_SQL} SELECT count(DISTINCT nom) AS organisations, count(tel) AS with_phone, count(*) FILTER (ord % 2 = 0) AS dated FROM d"
