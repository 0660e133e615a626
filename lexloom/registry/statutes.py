"""Statute look-ups. Versions are the orders of a customer, each valid until ten days (odd keys)
or no day before the next; references are one day per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.identifiers import source_url
from lexloom.operators import asof, joins
from lexloom.plans.citing import decisions_citing, resolve_citations
from lexloom.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VERSIONS_SQL = """
versions AS (
  SELECT 'LEGIARTI' || o_orderkey AS legiarti, 'LEGITEXT' || o_custkey AS legitext, 'L' || (o_custkey % 10) AS num,
         CASE o_orderstatus WHEN 'O' THEN 'VIGUEUR' ELSE 'MODIFIE' END AS etat, CAST(o_orderdate AS DATE) AS date_debut,
         CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE)
           - CAST((o_orderkey % 2) * 10 AS INTEGER) AS date_fin
  FROM orders),
refs AS (
  SELECT c_custkey AS ref_id, 'LEGITEXT' || c_custkey AS code, 'L' || (c_custkey % 10) AS num,
         CAST(DATE '1991-06-01' + CAST((c_custkey * 37) % 3300 AS INTEGER) AS DATE) AS date
  FROM customer)
"""
_WINNER_SQL = """
ranked AS (
  SELECT r.ref_id, r.date, v.*,
         CASE WHEN v.date_debut <= r.date AND (v.date_fin IS NULL OR v.date_fin >= r.date) THEN 1
              WHEN v.etat = 'VIGUEUR' THEN 2 ELSE 3 END AS tier,
         row_number() OVER (PARTITION BY r.ref_id ORDER BY
              CASE WHEN v.date_debut <= r.date AND (v.date_fin IS NULL OR v.date_fin >= r.date) THEN 1
                   WHEN v.etat = 'VIGUEUR' THEN 2 ELSE 3 END,
              v.date_debut DESC, coalesce(v.date_fin, DATE '9999-12-31') DESC, v.legiarti) AS rn
  FROM refs r JOIN versions v ON v.legitext = r.code AND v.num = r.num),
winner AS (SELECT * FROM ranked WHERE rn = 1)
"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    nxt = F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("date")
    return o.select(
        F.concat(F.lit("LEGIARTI"), F.col("o_orderkey")).alias("legiarti"), F.concat(F.lit("LEGITEXT"), F.col("o_custkey")).alias("legitext"),
        F.concat(F.lit("L"), F.col("o_custkey") % 10).alias("num"),
        F.when(F.col("o_orderstatus") == "O", "VIGUEUR").otherwise("MODIFIE").alias("etat"),
        F.col("o_orderdate").cast("date").alias("date_debut"),
        F.date_sub(nxt, ((F.col("o_orderkey") % 2) * 10).cast("int")).alias("date_fin"))


def refs(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("ref_id"), F.concat(F.lit("LEGITEXT"), F.col("c_custkey")).alias("code"),
        F.concat(F.lit("L. "), F.col("c_custkey") % 10).alias("num"),
        F.date_add(F.lit("1991-06-01").cast("date"), ((F.col("c_custkey") * 37) % 3300).cast("int")).alias("date"))


def law_at_date(spark: SparkSession, folder: str) -> DataFrame:
    return asof.law_at_date(refs(spark, folder), versions(spark, folder)).select(
        "ref_id", "legiarti", "tier", "date_debut", "date_fin", "note", "source_url")


_NOTE_SQL = """CASE tier WHEN 2 THEN 'Aucune version en vigueur à ' || CAST(date AS VARCHAR) || '. Version courante affichée.'
       WHEN 3 THEN 'Article non trouvé à la date demandée ; version la plus récente retournée.' END AS note"""
_URL_SQL = """'https://www.legifrance.gouv.fr/codes/article_lc/' || legiarti || '/' ||
       CAST(CASE tier WHEN 1 THEN date ELSE date_debut END AS VARCHAR) AS source_url"""

QUERIES["law_at_date"] = law_at_date
ORACLES["law_at_date"] = f"""WITH {_VERSIONS_SQL}, {_WINNER_SQL}
SELECT ref_id, legiarti, tier, date_debut, date_fin, {_NOTE_SQL}, {_URL_SQL} FROM winner"""


def law_batch(spark: SparkSession, folder: str) -> DataFrame:
    r = refs(spark, folder)
    some_blank = r.withColumn("num", F.when(F.col("ref_id") % 11 == 0, F.lit(" ")).otherwise(F.col("num")))
    return asof.law_batch(some_blank, versions(spark, folder)).select("ref_id", "found", "tier", "legiarti", "error")


QUERIES["law_batch"] = law_batch
ORACLES["law_batch"] = f"""WITH {_VERSIONS_SQL}, {_WINNER_SQL}
SELECT r.ref_id, (w.tier IS NOT NULL AND r.ref_id % 11 <> 0) AS found, CASE WHEN r.ref_id % 11 <> 0 THEN w.tier END AS tier,
       CASE WHEN r.ref_id % 11 <> 0 THEN w.legiarti END AS legiarti,
       CASE WHEN r.ref_id % 11 = 0 THEN 'code and num are required' WHEN w.tier IS NULL THEN 'no version of this article' END AS error
FROM refs r LEFT JOIN winner w USING (ref_id)"""


def law_versions(spark: SparkSession, folder: str) -> DataFrame:
    return asof.law_versions(refs(spark, folder), versions(spark, folder)).select(
        "ref_id", "legiarti", "date_debut", F.col("version_no").cast("long").alias("version_no"))


QUERIES["law_versions"] = law_versions
ORACLES["law_versions"] = f"""WITH {_VERSIONS_SQL}
SELECT r.ref_id, v.legiarti, v.date_debut,
       row_number() OVER (PARTITION BY v.legitext, v.num ORDER BY v.date_debut, v.legiarti) AS version_no
FROM refs r JOIN versions v ON v.legitext = r.code AND v.num = r.num"""


def resolve_code(spark: SparkSession, folder: str) -> DataFrame:
    aliases = ["CC", "CP", "CONST", "LIL", "ZZ"]
    c = table(spark, folder, "customer").withColumn("code", F.get(F.array(*[F.lit(a) for a in aliases]), (F.col("c_custkey") % 5).cast("int")))
    return asof.resolve_code(c).groupBy("code", "legitext").agg(F.count("*").alias("n"))


QUERIES["resolve_code"] = resolve_code
ORACLES["resolve_code"] = """SELECT code, legitext, count(*) AS n FROM (
  SELECT ['CC','CP','CONST','LIL','ZZ'][c_custkey % 5 + 1] AS code,
         ['LEGITEXT000006070721','LEGITEXT000006070719','JORFTEXT000000571356','JORFTEXT000000886460',NULL][c_custkey % 5 + 1] AS legitext
  FROM customer) GROUP BY ALL"""


def in_force(spark: SparkSession, folder: str) -> DataFrame:
    return asof.in_force(versions(spark, folder)).groupBy("num").agg(F.count("*").alias("n"))


QUERIES["in_force"] = in_force
ORACLES["in_force"] = """SELECT 'L' || (o_custkey % 10) AS num, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL"""

_TITLES_SQL = """
articles AS (
  SELECT p_brand AS legitext, CAST(p_partkey % 3 AS VARCHAR) AS num, DATE '1990-01-01' + CAST(p_partkey % 400 AS INTEGER) AS date_debut,
         (10 + p_size) || '-' || (p_partkey % 40) AS x, p_partkey % 7 AS m FROM part),
asked AS (SELECT DISTINCT (10 + c_custkey % 50) || '-' || (c_custkey % 40) AS numero FROM customer),
titled AS (SELECT x AS numero, legitext, count(*) AS nb, min(date_debut) AS date_debut FROM articles WHERE m < 2
           AND x IN (SELECT numero FROM asked) GROUP BY ALL),
texts AS (SELECT x AS numero, legitext, count(*) AS nb, min(date_debut) AS date_debut FROM articles WHERE m BETWEEN 2 AND 4 AND num = '1'
          AND x IN (SELECT numero FROM asked) AND x NOT IN (SELECT numero FROM titled) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY numero ORDER BY nb DESC, legitext) AS rn FROM (SELECT * FROM titled UNION ALL SELECT * FROM texts)),
totals AS (SELECT legitext, count(*) AS articles_count FROM articles GROUP BY ALL)
"""


def resolve_law_number(spark: SparkSession, folder: str) -> DataFrame:
    p, c = table(spark, folder, "part"), table(spark, folder, "customer")
    x = F.concat_ws("-", (F.col("p_size") + 10).cast("string"), (F.col("p_partkey") % 40).cast("string"))
    m = F.col("p_partkey") % 7
    arts = p.select(
        F.col("p_brand").alias("legitext"), (F.col("p_partkey") % 3).cast("string").alias("num"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int")).alias("date_debut"),
        F.when(m == 0, F.concat(F.lit("Loi n° "), x, F.lit(" du"))).when(m == 1, F.concat(F.lit("Décret n°"), x)).otherwise("").alias("titre_text"),
        F.when(m.between(2, 4), F.concat(F.lit("la loi n° "), x, F.lit(" dispose"))).otherwise("").alias("texte"))
    asked = c.select(F.concat_ws("-", (F.col("c_custkey") % 50 + 10).cast("string"), (F.col("c_custkey") % 40).cast("string")).alias("numero"))
    return asof.resolve_law_number(asked, arts).select("numero", "legitext", "nb", "articles_count", F.col("date_debut").cast("date").alias("date_debut"))


QUERIES["resolve_law_number"] = resolve_law_number
ORACLES["resolve_law_number"] = f"""WITH {_TITLES_SQL}
SELECT b.numero, b.legitext, b.nb, t.articles_count, b.date_debut FROM best b JOIN totals t USING (legitext) WHERE rn = 1"""


def backfill_title(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").select(F.col("n_nationkey"), F.col("n_regionkey").alias("key"),
                                              F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("titre"))
    r = table(spark, folder, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name"))
    joined = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.backfill_title(joined, r, "key", "titre", "r_name").select("c_custkey", "titre")


QUERIES["backfill_title"] = backfill_title
ORACLES["backfill_title"] = """SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE n_name END AS titre
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def citation_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item cites an article of its order's customer; the order is dated a month later."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    cites = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("LEGITEXT"), F.col("o_custkey")).alias("code"),
        F.concat(F.lit("L"), F.col("o_custkey") % 10).alias("num"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("date"))
    return resolve_citations(cites, docs, versions(spark, folder)).groupBy("legiarti", "tier").agg(F.count("*").alias("n"))


QUERIES["resolve_citations"] = citation_links
ORACLES["resolve_citations"] = f"""WITH {_VERSIONS_SQL.replace('refs AS', 'unused AS')},
refs AS (SELECT o_orderkey AS ref_id, 'LEGITEXT' || o_custkey AS code, 'L' || (o_custkey % 10) AS num, CAST(o_orderdate AS DATE) + 30 AS date FROM orders),
{_WINNER_SQL}
SELECT legiarti, tier, count(*) AS n FROM lineitem JOIN winner ON ref_id = l_orderkey GROUP BY ALL"""


def reverse_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Orders citing a part: the newest five per part."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    cites = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.lit("CC").alias("code"), F.col("l_partkey").cast("string").alias("num")).agg(F.count("*").alias("n"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("date"))
    asked = table(spark, folder, "part").select(F.col("p_partkey").alias("ref_id"), F.lit("CC").alias("code"), F.col("p_partkey").cast("string").alias("num"))
    return decisions_citing(asked, cites, docs, limit=5).select("ref_id", "doc_id", "n", "date", F.col("rank").cast("long").alias("rank"))


QUERIES["decisions_citing"] = reverse_citations
ORACLES["decisions_citing"] = """WITH c AS (SELECT l_partkey AS ref_id, l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT c.*, CAST(o_orderdate AS DATE) AS date, row_number() OVER (PARTITION BY ref_id ORDER BY CAST(o_orderdate AS DATE) DESC, n DESC, doc_id) AS rank
      FROM c JOIN orders ON doc_id = o_orderkey JOIN part ON p_partkey = ref_id)
SELECT ref_id, doc_id, n, date, rank FROM r WHERE rank <= 5"""

_ID_FORMS = [
    ("'LEGIARTI' || o_orderkey", "'https://www.legifrance.gouv.fr/codes/article_lc/LEGIARTI' || o_orderkey || '/' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
    ("'JORFTEXT' || o_orderkey", "'https://www.legifrance.gouv.fr/loda/id/JORFTEXT' || o_orderkey || '/' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
    ("'JURITEXT' || o_orderkey", "'https://www.legifrance.gouv.fr/juri/id/JURITEXT' || o_orderkey"),
    ("'CETATEXT' || o_orderkey", "'https://www.legifrance.gouv.fr/ceta/id/CETATEXT' || o_orderkey"),
    ("'DTA_' || o_orderkey", "'https://opendata.justice-administrative.fr/recherche/decision/DTA_' || o_orderkey"),
    ("'62021CJ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')",
     "'https://eur-lex.europa.eu/legal-content/FR/TXT/?uri=CELEX:62021CJ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"),
    ("'ECLI:EU:C:2021:' || o_orderkey", "'https://eur-lex.europa.eu/legal-content/FR/TXT/?uri=ecli:ECLI:EU:C:2021:' || o_orderkey"),
    ("'001-' || o_orderkey", "'https://hudoc.echr.coe.int/fre?i=001-' || o_orderkey"),
    ("'ECLI:FR:CCASS:2020:' || o_orderkey", "NULL"),
    ("'inconnu' || o_orderkey", "NULL"),
]
_FAMILIES = ["statute_article", "statute_text", "judicial", "admin_bulk", "admin_open_data", "eu_court", "eu_court", "human_rights", None, None]


def _identifiers(spark: SparkSession, folder: str) -> DataFrame:
    chain = None
    for i, (expr, _) in enumerate(_ID_FORMS):
        value = F.expr(expr.replace("VARCHAR", "STRING"))
        chain = F.when(F.col("o_orderkey") % 10 == i, value) if chain is None else chain.when(F.col("o_orderkey") % 10 == i, value)
    return table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), chain.alias("ident"))


QUERIES["source_url"] = lambda spark, folder: _identifiers(spark, folder).select("o_orderkey", "ident", source_url("ident", None, F.col("day")).alias("url"))
ORACLES["source_url"] = "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {a}" for i, (a, _) in enumerate(_ID_FORMS)) + \
    " END AS ident, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {b}" for i, (_, b) in enumerate(_ID_FORMS)) + " END AS url FROM orders"


def id_family(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.functions.identifiers import id_family as family
    return _identifiers(spark, folder).groupBy(family("ident").alias("family")).agg(F.count("*").alias("n"))


QUERIES["id_family"] = id_family
ORACLES["id_family"] = "SELECT CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN " + (f"'{f}'" if f else "NULL") for i, f in enumerate(_FAMILIES)) + \
    " END AS family, count(*) AS n FROM orders GROUP BY ALL"
