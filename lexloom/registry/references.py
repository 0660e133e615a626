"""References, intents, identifiers and look-ups. Texts are composed from table rows, so the
expected outcome is known without parsing them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions import identifiers as ids
from lexloom.functions.citations import cited_articles, explode_citations, explode_norm_mentions
from lexloom.functions.dates import format_fr_date, parse_fr_date
from lexloom.functions.queries import classify_queries, queries_to_clauses, route
from lexloom.functions.references import is_reference, parse_references
from lexloom.operators import filters, joins
from lexloom.operators.filters import to_result
from lexloom.plans.cascade import resolve_references
from lexloom.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MONTHS_SQL = "[" + ",".join(f"'{m}'" for m in dims.MONTHS) + "]"
_DAY = "CAST(o_orderdate AS DATE)"
# 1 orders row -> one French reference.
_REF_SQL = f"""CASE o_orderkey % 4
  WHEN 0 THEN 'Cour d''appel de Douai, ' || day(o_orderdate) || ' ' || {_MONTHS_SQL}[month(o_orderdate)] || ' ' || year(o_orderdate) || ', n° ' || rg
  WHEN 1 THEN 'TA Lille, ' || CAST({_DAY} AS VARCHAR) || ', n° ' || docket
  WHEN 2 THEN 'cass ' || appeal
  ELSE 'CJUE, C-' || (o_orderkey % 900 + 1) || '/' || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') END"""
_O_SQL = """o AS (SELECT *, lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') || '/' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS rg,
  CAST(2000000 + o_orderkey AS VARCHAR) AS docket,
  lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS appeal
  FROM orders)"""


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    k = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    two = pad(k % 90 + 10, 2)
    return o.withColumn("rg", F.concat(two, F.lit("/"), pad(k % 100000, 5))).withColumn(
        "docket", (k + 2000000).cast("string")).withColumn(
        "appeal", F.concat(two, F.lit("-"), two, F.lit("."), pad(k % 1000, 3))).withColumn("two", two)


def reference_texts(spark: SparkSession, folder: str) -> DataFrame:
    o, k = _orders(spark, folder), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Cour d'appel de Douai, "), format_fr_date(F.col("day").cast("string")), F.lit(", n° "), F.col("rg")))
        .when(k == 1, F.concat(F.lit("TA Lille, "), F.col("day").cast("string"), F.lit(", n° "), F.col("docket")))
        .when(k == 2, F.concat(F.lit("cass "), F.col("appeal")))
        .otherwise(F.concat(F.lit("CJUE, C-"), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit("/"), F.col("two")))
    )
    return o.select(F.col("o_orderkey").alias("ref_id"), text.alias("query"))


def parse_refs(spark: SparkSession, folder: str) -> DataFrame:
    p = parse_references(reference_texts(spark, folder), "query")
    first = F.get("numeros", F.lit(0))
    return p.select("ref_id", "query", "juri_type", "juri_ville", "ref_date", first["kind"].alias("kind"), first["value"].alias("value"),
                    is_reference().alias("is_reference"))


QUERIES["parse_refs"] = parse_refs
ORACLES["parse_refs"] = f"""WITH {_O_SQL}
SELECT o_orderkey AS ref_id, {_REF_SQL} AS query, ['ca','ta','cass','cjue'][o_orderkey % 4 + 1] AS juri_type, ['Douai','Lille','',''][o_orderkey % 4 + 1] AS juri_ville,
  CASE WHEN o_orderkey % 4 < 2 THEN {_DAY} END AS ref_date, ['rg','dossier','pourvoi','cjue'][o_orderkey % 4 + 1] AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN rg WHEN 1 THEN docket WHEN 2 THEN appeal ELSE 'C-' || (o_orderkey % 900 + 1) || '/' || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') END AS value,
  true AS is_reference FROM o"""


def resolve_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Every second order is held as a decision; each reference must find its own or admit it is missing."""
    o = _orders(spark, folder).where(F.col("o_orderkey") % 8 < 4)
    k = F.col("o_orderkey") % 4
    day = F.col("day").cast("string")
    key = F.col("o_orderkey").cast("string")
    judicial = o.where(k.isin(0, 2)).select(
        F.concat(F.lit("JURITEXT"), key).alias("id"), F.when(k == 0, F.col("rg")).otherwise(F.col("appeal")).alias("numero"),
        F.when(k == 0, "Cour d'appel de Douai").otherwise("Cour de cassation").alias("juridiction"), day.alias("date"))
    admin = o.where(k == 1).select(
        F.concat(F.lit("DTA_"), F.col("docket"), F.lit("_"), F.date_format("day", "yyyyMMdd")).alias("id"), F.col("docket").alias("numero"),
        F.lit("TA de Lille").alias("juridiction"), day.alias("date"))
    eu = o.where(k == 3).groupBy((F.col("o_orderkey") % 900).alias("_n"), "two").agg(F.min("day").alias("day")).select(
        ids.case_to_celex(F.concat(F.lit("C-"), (F.col("_n") + 1).cast("string"), F.lit("/"), F.col("two"))).alias("celex"),
        day.alias("date")).distinct()
    rows = to_result(judicial, "dila").unionByName(to_result(admin, "admin")).unionByName(to_result(eu, "cjue"))
    found = resolve_references(reference_texts(spark, folder), rows, limit=1)
    # Several references share a number; what matters is the number and source of the hit.
    return found.select("ref_id", "source", F.when(F.col("source") == "cjue", F.col("id")).otherwise(F.col("numero")).alias("hit"),
                        F.col("note").isNotNull().alias("missing"))


QUERIES["resolve_references"] = resolve_refs
ORACLES["resolve_references"] = f"""WITH {_O_SQL},
h AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN rg WHEN 1 THEN docket || '_' || CAST({_DAY} AS VARCHAR) WHEN 2 THEN appeal
        ELSE '6' || CASE WHEN o_orderkey % 90 + 10 > 50 THEN '19' ELSE '20' END || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') || 'CJ' || lpad(CAST(o_orderkey % 900 + 1 AS VARCHAR), 4, '0') END AS k,
        CASE o_orderkey % 4 WHEN 1 THEN 'admin' WHEN 3 THEN 'cjue' ELSE 'dila' END AS src FROM o),
held AS (SELECT DISTINCT src, k FROM h WHERE o_orderkey % 8 < 4),
days AS (SELECT DISTINCT {_DAY} AS d FROM o WHERE o_orderkey % 8 = 0)
SELECT h.o_orderkey AS ref_id, CASE WHEN held.k IS NOT NULL THEN h.src WHEN h.o_orderkey % 4 = 0 AND d IS NOT NULL THEN 'dila' END AS source,
  CASE WHEN held.k IS NULL THEN CASE WHEN h.o_orderkey % 4 = 0 AND d IS NOT NULL THEN
     (SELECT rg FROM o x WHERE x.o_orderkey % 8 = 0 AND CAST(x.o_orderdate AS DATE) = d ORDER BY 'JURITEXT' || x.o_orderkey LIMIT 1) END
   WHEN h.o_orderkey % 4 = 1 THEN h.docket ELSE h.k END AS hit,
  held.k IS NULL AND NOT (h.o_orderkey % 4 = 0 AND d IS NOT NULL) AS missing
FROM h LEFT JOIN held USING (src, k) LEFT JOIN days ON d = CAST(h.o_orderdate AS DATE)"""

# One query per intent, and the texts of the conversation log.
_INTENTS = [
    ("'DTA_' || o_orderkey || '_20200101'", "dce_id"), ("'001-' || (10000 + o_orderkey % 900000)", "itemid_hudoc"), ("'juritext' || o_orderkey", "juritext"),
    ("'ECLI:EU:C:2021:' || o_orderkey", "ecli"), ("'62021CJ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')", "celex"),
    ("'14-' || (10000 + o_orderkey % 90000)", "pourvoi"), ("'23/' || (10000 + o_orderkey % 90000)", "rg"), ("'2' || (100000 + o_orderkey % 900000)", "dossier_admin"),
    ("CAST(10000 + o_orderkey % 90000 AS VARCHAR)", "ariane_id"), ("'\"' || o_orderpriority || '\"'", "phrase"), ("o_orderpriority || ' x'", "fts"), ("'  '", "empty"),
]


def _query_log(spark: SparkSession, folder: str) -> DataFrame:
    chain = None
    for i, (expr, _) in enumerate(_INTENTS):
        value, test = F.expr(expr.replace("VARCHAR", "STRING")), F.col("o_orderkey") % len(_INTENTS) == i
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"), chain.alias("query"))


def intents(spark: SparkSession, folder: str) -> DataFrame:
    log = _query_log(spark, folder).unionByName(table(spark, folder, "conversations").select(
        (-1 - F.col("conv_id") * 100 - F.col("turn")).alias("query_id"), F.col("text").alias("query")))
    routed = route(classify_queries(log, "query"), list(dims.SOURCE_CAPABILITIES))
    return routed.groupBy("intent", F.array_join("sources", ",").alias("sources")).agg(F.count("*").alias("n"), F.sum(F.length("intent_value")).alias("chars"))


def _sources_of(intent: str) -> str:
    able = [s for s, kinds in dims.SOURCE_CAPABILITIES.items() if intent in kinds]
    return ",".join(able or list(dims.SOURCE_CAPABILITIES))


QUERIES["intents"] = intents
ORACLES["intents"] = "WITH q AS (SELECT CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_INTENTS)) + \
    " END AS intent, CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN {e}" for i, (e, _) in enumerate(_INTENTS)) + \
    """ END AS query FROM orders
UNION ALL SELECT CASE WHEN trim(text) = '' THEN 'empty' ELSE 'fts' END, text FROM conversations)
SELECT intent, CASE intent """ + " ".join(f"WHEN '{k}' THEN '{_sources_of(k)}'" for _, k in _INTENTS) + \
    """ END AS sources, count(*) AS n, CAST(sum(length(CASE WHEN intent = 'phrase' THEN trim(replace(query, '"', '')) ELSE trim(query) END)) AS BIGINT) AS chars
FROM q GROUP BY ALL"""


def clauses(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), F.concat(
        F.lit('"'), F.col("p_name"), F.lit('" '), F.lower("p_type"), F.lit(" OU "), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(" -"), F.col("p_size").cast("string"), F.lit("*")).alias("query"))
    return queries_to_clauses(p, "query_id", "query").select("query_id", F.col("clause_id").cast("long").alias("clause_id"), "op", F.array_join("terms", " ").alias("terms"), "is_phrase", "is_prefix")


QUERIES["queries_to_clauses"] = clauses
ORACLES["queries_to_clauses"] = """SELECT p_partkey AS query_id, 1 AS clause_id, 'must' AS op, lower(p_name) AS terms, contains(p_name, ' ') AS is_phrase, false AS is_prefix FROM part
UNION ALL SELECT p_partkey, 2, 'must', lower(p_type), false, false FROM part
UNION ALL SELECT p_partkey, 2, 'must', lower(replace(p_brand, '#', '')), false, false FROM part
UNION ALL SELECT p_partkey, 3, 'not', CAST(p_size AS VARCHAR), false, true FROM part"""

_CITE_TEXT_SQL = """'vu les articles L. ' || o_custkey || '-1, ' || (o_orderkey % 500 + 1) || ' et R. 9 du code du travail ; l''article ' || (o_orderkey % 700 + 1) ||
  ' alinéa 2 du code civil, la loi n° 2005-' || o_custkey || ' et le règlement (UE) 2016/' || (o_orderkey % 900 + 1)"""


def _citing_texts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return table(spark, folder, "orders").select(k.alias("doc_id"), F.concat(
        F.lit("vu les articles L. "), s(F.col("o_custkey")), F.lit("-1, "), s(k % 500 + 1), F.lit(" et R. 9 du code du travail ; l'article "), s(k % 700 + 1),
        F.lit(" alinéa 2 du code civil, la loi n° 2005-"), s(F.col("o_custkey")), F.lit(" et le règlement (UE) 2016/"), s(k % 900 + 1)).alias("text"))


QUERIES["citations"] = lambda spark, folder: explode_citations(_citing_texts(spark, folder), "doc_id", "text").select(
    "doc_id", "code", "num", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
_CITES_SQL = f"""WITH t AS (SELECT o_orderkey AS doc_id, o_custkey, o_orderkey, {_CITE_TEXT_SQL} AS text FROM orders),
n AS (SELECT doc_id, text, 'CT' AS code, 'L. ' || o_custkey || '-1' AS raw, 'L' || o_custkey || '-1' AS num, 'vu les articles ' AS lead FROM t
 UNION ALL SELECT doc_id, text, 'CT', CAST(o_orderkey % 500 + 1 AS VARCHAR), CAST(o_orderkey % 500 + 1 AS VARCHAR), 'vu les articles L. ' || o_custkey || '-1, ' FROM t
 UNION ALL SELECT doc_id, text, 'CT', 'R. 9', 'R9', 'vu les articles L. ' || o_custkey || '-1, ' || (o_orderkey % 500 + 1) || ' et ' FROM t
 UNION ALL SELECT doc_id, text, 'CC', CAST(o_orderkey % 700 + 1 AS VARCHAR), CAST(o_orderkey % 700 + 1 AS VARCHAR),
   'vu les articles L. ' || o_custkey || '-1, ' || (o_orderkey % 500 + 1) || ' et R. 9 du code du travail ; l''article ' FROM t)"""
ORACLES["citations"] = f"{_CITES_SQL} SELECT doc_id, code, num, length(lead) AS start, length(lead) + length(raw) AS \"end\" FROM n"
QUERIES["cited_articles"] = lambda spark, folder: cited_articles(_citing_texts(spark, folder), "doc_id", "text")
ORACLES["cited_articles"] = f"{_CITES_SQL} SELECT doc_id, code, num FROM n"


def cited_in_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Citations put into the middle and at the end of the given texts, of any length, with their places."""
    d, half, key = table(spark, folder, "documents"), (F.length("text") / 2).cast("int"), F.col("doc_id").cast("string")
    planted = F.concat(
        F.substring("text", 1, half), F.lit(" vu les articles 5, alinéa 2, 7 et R. 9 du code civil, "), F.substring("text", half + 1, F.length("text")),
        F.lit(" ; art. L. "), key, F.lit("-1 C. pr. civ. et l'article premier de la Constitution"))
    return explode_citations(d.select("doc_id", planted.alias("text")), "doc_id", "text").select(
        "doc_id", "code", "num", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


QUERIES["cited_in_documents"] = cited_in_documents
ORACLES["cited_in_documents"] = """WITH t AS (SELECT doc_id, length(text) AS n, length(text) // 2 AS h, length(doc_id::VARCHAR) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'CC' AS code, '5' AS num, h + 17 AS start, h + 18 AS "end" FROM t UNION ALL SELECT doc_id, 'CC', '7', h + 30, h + 31 FROM t
UNION ALL SELECT doc_id, 'CC', 'R9', h + 35, h + 39 FROM t
UNION ALL SELECT doc_id, 'CPC', 'L' || doc_id || '-1', n + 63, n + 68 + k FROM t
UNION ALL SELECT doc_id, 'CONST', '1', n + 94 + k, n + 101 + k FROM t"""
QUERIES["norm_mentions"] = lambda spark, folder: explode_norm_mentions(_citing_texts(spark, folder), "doc_id", "text")
ORACLES["norm_mentions"] = """SELECT o_orderkey AS doc_id, 'LOI' AS kind, 'loi n° 2005-' || o_custkey AS mention FROM orders WHERE o_custkey >= 0
UNION ALL SELECT o_orderkey, 'REG-EU', 'règlement (UE) 2016/' || (o_orderkey % 900 + 1) FROM orders"""


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Roll, appeal and EU numbers of each order in all their spellings."""
    o = _orders(spark, folder)
    case = F.concat(F.lit("C-"), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit("/"), F.col("two"))
    celex = ids.case_to_celex(case)
    return o.select("o_orderkey", ids.norm_rg(F.replace("rg", F.lit("/"), F.lit("-"))).alias("rg"), ids.rg_key("rg").alias("rg_key"),
                    F.array_join(ids.appeal_variants("appeal"), " ").alias("appeals"), celex.alias("celex"), ids.celex_to_case(celex).alias("case_no"),
                    ids.celex_to_ecli(celex).alias("ecli"), ids.admin_docket(F.concat(F.lit(" n° "), "docket")).alias("docket"),
                    ids.extract_rg(F.concat(F.lit("vu le N° RG : "), "rg", F.lit(" x"))).alias("found_rg"),
                    ids.extract_appno(F.concat(F.lit("Requête no "), (F.col("o_orderkey") % 99999 + 1).cast("string"), F.lit("/02)"))).alias("appno"))


QUERIES["identifiers"] = numbers
ORACLES["identifiers"] = f"""WITH {_O_SQL}, c AS (SELECT *, lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') AS two, o_orderkey % 900 + 1 AS num,
  CASE WHEN o_orderkey % 90 + 10 > 50 THEN '19' ELSE '20' END || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') AS y FROM o)
SELECT o_orderkey, rg, rg || ' ' || replace(rg, '/', '-') || ' ' || replace(rg, '/', '') AS rg_key, replace(appeal, '.', '') || ' ' || appeal AS appeals,
  '6' || y || 'CJ' || lpad(CAST(num AS VARCHAR), 4, '0') AS celex, 'C-' || num || '/' || two AS case_no, 'ECLI:EU:C:' || y || ':' || num AS ecli, docket,
  rg AS found_rg, (o_orderkey % 99999 + 1) || '/02' AS appno FROM c"""


def dates(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("iso", F.col("o_orderdate").cast("date").cast("string"))
    return o.select("o_orderkey", format_fr_date("iso").alias("long_date"), parse_fr_date(F.concat(F.lit("Lecture du "), format_fr_date("iso"))).alias("day"))


QUERIES["french_dates"] = dates
ORACLES["french_dates"] = f"SELECT o_orderkey, day(o_orderdate) || ' ' || {_MONTHS_SQL}[month(o_orderdate)] || ' ' || year(o_orderdate) AS long_date, {_DAY} AS day FROM orders"

# Look-ups: decisions are orders, dockets are customer numbers, courts are nations.
_DEC_SQL = """dec AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) || ' ' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS numero,
  n_name AS juridiction, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    full = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey)
    cust = F.col("o_custkey").cast("string")
    return full.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.concat_ws(" ", cust, "o_orderkey")).otherwise(cust).alias("numero"),
                       F.col("n_name").alias("juridiction"), F.col("o_orderdate").cast("date").alias("date"))


def by_id(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    return filters.by_id(decisions(spark, folder), asked).select("id", "numero", "date")


QUERIES["by_id"] = by_id
ORACLES["by_id"] = f"WITH {_DEC_SQL} SELECT id, numero, date FROM dec WHERE id IN (SELECT l_partkey FROM lineitem)"


def by_field(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("value"))
    return filters.by_field(decisions(spark, folder), "numero", values).select("value", "id", F.col("rank").cast("long").alias("rank"))


QUERIES["by_field"] = by_field
ORACLES["by_field"] = f"""WITH {_DEC_SQL}, r AS (SELECT CAST(c_custkey AS VARCHAR) AS value, id, row_number() OVER (PARTITION BY c_custkey ORDER BY
  CASE WHEN numero = CAST(c_custkey AS VARCHAR) THEN 0 ELSE 1 END, id) AS rank FROM dec JOIN customer ON numero = CAST(c_custkey AS VARCHAR) OR starts_with(numero, c_custkey || ' '))
SELECT value, id, rank FROM r WHERE rank <= 5"""


def by_docket(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    shifted = n.select(F.col("n_nationkey"), F.col("n_name").alias("juridiction"))
    refs = c.join(shifted, ((c.c_nationkey + c.c_custkey % 2) % 25) == shifted.n_nationkey).select(
        F.col("c_custkey").alias("ref_id"), F.col("c_custkey").cast("string").alias("numero"), "juridiction")
    return filters.by_docket(decisions(spark, folder), refs).select("ref_id", "id", F.col("rank").cast("long").alias("rank"))


QUERIES["by_docket"] = by_docket
ORACLES["by_docket"] = f"""WITH {_DEC_SQL}, refs AS (SELECT c_custkey AS ref_id, CAST(c_custkey AS VARCHAR) AS numero, n_name AS asked FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey % 2) % 25),
r AS (SELECT ref_id, id, row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN juridiction = asked THEN 0 ELSE 1 END, id) AS rank
      FROM refs JOIN dec USING (numero) WHERE contains(lower(juridiction), lower(asked)))
SELECT ref_id, id, rank FROM r WHERE rank <= 5"""


def by_rg(spark: SparkSession, folder: str) -> DataFrame:
    """References spell the number with a dash, without separator, or not as a roll number at all."""
    o = _orders(spark, folder)
    dec = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("appeal")).otherwise(F.col("rg")).alias("numero"), F.col("day").alias("date"))
    asked = o.select(F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("appeal")).when(
        F.col("o_orderkey") % 3 == 1, F.replace("rg", F.lit("/"), F.lit("-"))).otherwise(F.replace("rg", F.lit("/"), F.lit(""))).alias("numero"))
    return filters.by_rg(dec, asked, k=3).groupBy("ref_id").agg(F.count("*").alias("n"), F.max("date").alias("newest"))


QUERIES["by_rg"] = by_rg
ORACLES["by_rg"] = f"""WITH {_O_SQL}, d AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN appeal ELSE rg END AS k, {_DAY} AS date FROM o),
g AS (SELECT k, least(count(*), 3) AS n, max(date) AS newest FROM d GROUP BY ALL)
SELECT o_orderkey AS ref_id, n, newest FROM o JOIN g ON k = CASE WHEN o_orderkey % 3 = 0 THEN appeal ELSE rg END"""


def probes(spark: SparkSession, folder: str) -> DataFrame:
    o = _orders(spark, folder)
    prefix = F.get(F.array(*[F.lit(p) for p in ("DTA", "DCAA", "DCE", "ORTA")]), (F.col("o_orderkey") % 4).cast("int"))
    dec = o.select(F.concat_ws("_", prefix, "docket", F.date_format("day", "yyyyMMdd")).alias("id"))
    court = F.get(F.array(*[F.lit(c) for c in ("ta", "caa", "", "xx")]), (F.col("o_orderkey") % 3).cast("int"))
    refs = o.select(F.col("o_orderkey").alias("ref_id"), court.alias("juri_type"), F.col("docket").alias("value"), F.col("day").alias("ref_date"))
    return joins.probe_ids(refs, dec).select("ref_id", "id")


QUERIES["probe_ids"] = probes
ORACLES["probe_ids"] = f"""WITH {_O_SQL} SELECT o_orderkey AS ref_id, ['DTA','DCAA','DCE','ORTA'][o_orderkey % 4 + 1] || '_' || docket || '_' || strftime(o_orderdate, '%Y%m%d') AS id
FROM o WHERE CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 4 IN (0, 3) WHEN 1 THEN o_orderkey % 4 = 1 ELSE true END"""


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    k = F.col("c_custkey") % 10000
    four = F.lpad(k.cast("string"), 4, "0")
    form = F.col("c_custkey") % 3
    dec = c.select(F.col("c_custkey").alias("id"), F.when(form == 0, F.concat(F.lit("C"), four)).when(form == 1, four).otherwise(F.lpad(four, 5, "0")).alias("numero"),
                   F.when(F.col("c_custkey") % 5 == 0, "autre").otherwise("Tribunal des conflits").alias("juridiction"))
    refs = c.select(F.col("c_custkey").alias("ref_id"), F.concat(F.lit("c"), four).alias("value"))
    return joins.probe_conflicts(refs, dec).groupBy("ref_id").agg(F.count("*").alias("n"))


QUERIES["probe_conflicts"] = conflicts
ORACLES["probe_conflicts"] = """WITH d AS (SELECT c_custkey % 10000 AS k, c_custkey % 3 AS form, c_custkey % 5 = 0 AS other FROM customer),
h AS (SELECT c_custkey AS ref_id, form, count(*) AS n FROM customer JOIN d ON k = c_custkey % 10000 AND (form = 0 OR NOT other) GROUP BY ALL)
SELECT ref_id, min_by(n, form) AS n FROM h GROUP BY ALL"""


def courts(spark: SparkSession, folder: str) -> DataFrame:
    codes = sorted(dims.ADMIN_COURTS)
    c = table(spark, folder, "customer").withColumn("code", F.get(F.array(*[F.lit(x) for x in codes]), (F.col("c_custkey") % len(codes)).cast("int")))
    named = filters.court_name(c, "code")
    return filters.court_code(named.withColumn("court_name", F.upper("court_name")), "court_name", "back").groupBy("code", "back").agg(F.count("*").alias("n"))


QUERIES["court_codes"] = courts
ORACLES["court_codes"] = "SELECT code, code AS back, count(*) AS n FROM (SELECT [" + ",".join(f"'{c}'" for c in sorted(dims.ADMIN_COURTS)) + \
    f"][c_custkey % {len(dims.ADMIN_COURTS)} + 1] AS code FROM customer) GROUP BY ALL"


def date_policy(blanks: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("date")).alias("day"))
        return filters.date_range(o, "day", "1994-01-01", "1995-12-31", blanks=blanks)
    return run


QUERIES["date_range_keep"] = date_policy("keep")
QUERIES["date_range_drop"] = date_policy("drop")
_BLANKED_SQL = f"WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN {_DAY} END AS day FROM orders) SELECT * FROM b WHERE day BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'"
ORACLES["date_range_keep"] = _BLANKED_SQL + " OR day IS NULL"
ORACLES["date_range_drop"] = _BLANKED_SQL
QUERIES["date_slice"] = lambda spark, folder: filters.date_slice(decisions(spark, folder), "date", "id", "1993-01-01", "1997-12-31", ["nation_1", "nation_7"], limit=300).select("id", "date", "juridiction")
ORACLES["date_slice"] = f"""WITH {_DEC_SQL} SELECT id, date, juridiction FROM dec WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'
AND (contains(lower(juridiction), 'nation_1') OR contains(lower(juridiction), 'nation_7')) ORDER BY date DESC, id LIMIT 300"""


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    o = _orders(spark, folder)
    changes = o.where(F.col("o_orderkey") % 2 == 0).select(F.concat(F.lit("h"), F.col("o_orderkey")).alias("id"), F.concat_ws("/", F.lit("21"), F.lpad((F.col("o_orderkey") % 3000).cast("string"), 5, "0")).alias("numero"))
    known = o.where(F.col("o_orderkey") % 2 == 1).select(F.concat(F.lit("J"), F.col("o_orderkey")).alias("id"), F.concat_ws("-", F.lit("21"), F.lpad((F.col("o_orderkey") % 3001).cast("string"), 5, "0")).alias("numero"))
    return joins.stable_id(changes, known).select("id", "numero")


QUERIES["stable_id"] = stable_ids
ORACLES["stable_id"] = """WITH ch AS (SELECT 'h' || o_orderkey AS id, lpad(CAST(o_orderkey % 3000 AS VARCHAR), 5, '0') AS r FROM orders WHERE o_orderkey % 2 = 0),
kn AS (SELECT min('J' || o_orderkey) AS old, lpad(CAST(o_orderkey % 3001 AS VARCHAR), 5, '0') AS r FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
f AS (SELECT r, min(id) AS first FROM ch GROUP BY ALL)
SELECT CASE WHEN id = first AND old IS NOT NULL THEN old ELSE id END AS id, '21/' || r AS numero FROM ch JOIN f USING (r) LEFT JOIN kn USING (r)"""


def court_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Court family and decision nature over the orders."""
    o = table(spark, folder, "orders").select("o_orderkey", F.get(F.array(*[F.lit(x) for x in ("Cour d'appel de Lyon", "Tribunal judiciaire de Lyon", "Conseil constitutionnel")]), (F.col("o_orderkey") % 3).cast("int")).alias("juridiction"),
                                              F.get(F.array(F.lit("DC"), F.lit("QPC")), (F.col("o_orderkey") % 2).cast("int")).alias("nature"))
    return filters.nature_filter(filters.court_family(o, "constit"), "qpc").select("o_orderkey", "juridiction", "nature")


QUERIES["court_family_and_nature"] = court_filters
ORACLES["court_family_and_nature"] = "SELECT o_orderkey, 'Conseil constitutionnel' AS juridiction, 'QPC' AS nature FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 2 = 1"
