"""Searches of single collections, over documents laid out as each collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import citations, text
from lexloom.operators import joins, windows
from lexloom.plans import collections, thesaurus
from lexloom.registry import Query, table
from lexloom.registry.retrieval import _ANY_WORD_SQL, _BASE_SQL, _SCORE_SQL, _q, _queries, _word, documents

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_DAY = "DATE '2000-01-01' + CAST(doc_id % 700 AS INTEGER)"


def _day() -> Column:
    return F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 700).cast("int"))


def _any_word(spark: SparkSession, folder: str) -> DataFrame:
    return _queries(spark, folder, _q('"', _word(3), '" OR "', _word(5), '"'))


def _sql(searched: str, order: str, keep: str = "true", k: int = 20) -> str:
    """Ranked hits of the any-word queries over ``searched`` (an expression over documents)."""
    return f"""WITH docs AS (SELECT 'documents' AS coll, doc_id, {searched} AS text FROM documents), {_BASE_SQL}, {_ANY_WORD_SQL}, {_SCORE_SQL},
h AS (SELECT query_id, doc_id, score, {_DAY} AS date, source, d.text FROM score s JOIN documents d USING (doc_id)),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_key) AS rank FROM (SELECT *, CAST(doc_id AS VARCHAR) AS doc_key FROM h) x WHERE {keep})
SELECT query_id, doc_id, rank FROM r WHERE rank <= {k}"""


def _out(hits: DataFrame, id_col: str) -> DataFrame:
    return hits.select("query_id", F.col(id_col).cast("long").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


def _key() -> Column:
    return F.col("doc_id").cast("string")


def gazette(spark: SparkSession, folder: str) -> DataFrame:
    df = documents(spark, folder).select(_key().alias("jorftext"), F.col("source").alias("nature"), F.col("text").alias("texte"), _day().alias("date_publi"))
    return _out(collections.search_gazette(_any_word(spark, folder), df, 7, nature="SRC3", date_min="2000-02-01"), "jorftext")


QUERIES["search_gazette"] = gazette
ORACLES["search_gazette"] = _sql("source || ' ' || text", "score DESC, date DESC", "source = 'src3' AND date >= DATE '2000-02-01'", 7)


def agreements(spark: SparkSession, folder: str) -> DataFrame:
    df = documents(spark, folder).select(_key().alias("id"), F.col("source").alias("idcc"), F.col("text").alias("texte"), _day().alias("date_publi"))
    return _out(collections.search_agreements(_any_word(spark, folder), df, 9, idcc="src5", sort="date_asc"), "id")


QUERIES["search_agreements"] = agreements
ORACLES["search_agreements"] = _sql("source || ' ' || text", "date ASC", "source = 'src5'", 9)


def deliberations(spark: SparkSession, folder: str) -> DataFrame:
    df = documents(spark, folder).select(_key().alias("id"), F.col("source").alias("formation"), F.col("text").alias("texte"), _day().alias("date"))
    return _out(collections.search_deliberations(_any_word(spark, folder), df, 5, sort="date_desc", date_max="2001-03-31"), "id")


QUERIES["search_deliberations"] = deliberations
ORACLES["search_deliberations"] = _sql("source || ' ' || text", "date DESC", "date <= DATE '2001-03-31'", 5)


def judicial(spark: SparkSession, folder: str) -> DataFrame:
    court = F.when(F.col("doc_id") % 3 == 0, "Cour d'appel de Riom").otherwise("Tribunal de commerce")
    df = documents(spark, folder).select(_key().alias("id"), "text", court.alias("juridiction"), _day().alias("date"))
    return _out(collections.search_judicial(_any_word(spark, folder), df, 6, family="appel"), "id")


QUERIES["search_judicial"] = judicial
ORACLES["search_judicial"] = _sql("CASE WHEN doc_id % 3 = 0 THEN 'Cour d appel de Riom' ELSE 'Tribunal de commerce' END || ' ' || text", "score DESC, date DESC", "doc_id % 3 = 0", 6)


def constit(spark: SparkSession, folder: str) -> DataFrame:
    court = F.when(F.col("doc_id") % 2 == 0, "Conseil constitutionnel").otherwise("Cour de cassation")
    df = documents(spark, folder).select(_key().alias("id"), "text", court.alias("juridiction"), F.when(F.col("doc_id") % 4 == 0, "DC").otherwise("QPC").alias("nature"), _day().alias("date"))
    return _out(collections.search_constit(_any_word(spark, folder), df, 8, nature="DC"), "id")


QUERIES["search_constit"] = constit
ORACLES["search_constit"] = _sql("CASE WHEN doc_id % 2 = 0 THEN 'Conseil constitutionnel' ELSE 'Cour de cassation' END || ' ' || text", "date DESC", "doc_id % 4 = 0", 8)


def _number_or_words(spark: SparkSession, folder: str, number: Column) -> DataFrame:
    """Even queries ask for a number beside their word, so that exact holders lead."""
    words = _any_word(spark, folder)
    return words.withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat("query", F.lit(' OR "'), number, F.lit('"'))).otherwise(F.col("query")))


def echr(spark: SparkSession, folder: str) -> DataFrame:
    df = documents(spark, folder).select(
        _key().alias("itemid"), "text", F.concat((F.col("doc_id") % 900 + 100).cast("string"), F.lit("/12")).alias("appno"),
        F.when(F.col("doc_id") % 5 == 0, "HFJUD").otherwise("HFDEC").alias("doctype"), _day().alias("date"))
    q = _number_or_words(spark, folder, F.concat((F.col("query_id") + 100).cast("string"), F.lit("/12")))
    return _out(collections.search_echr(q, df, 6, min_len=900), "itemid")


_ASKED = "AND query_id % 2 = 0 THEN 0 ELSE 1 END"
QUERIES["search_echr"] = echr
ORACLES["search_echr"] = _sql("text", f"CASE WHEN doc_id % 900 + 100 = query_id + 100 {_ASKED}, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END, score DESC, length(text) DESC",
                              "length(text) > 900", 6)


def cjeu(spark: SparkSession, folder: str) -> DataFrame:
    df = documents(spark, folder).select(_key().alias("celex"), "text", F.concat(F.lit("C-"), (F.col("doc_id") % 50 + 1).cast("string"), F.lit("/09")).alias("affaire_num"))
    q = _number_or_words(spark, folder, F.concat(F.lit("C-"), (F.col("query_id") + 1).cast("string"), F.lit("/09")))
    return _out(collections.search_cjeu(q, df, 6), "celex")


QUERIES["search_cjeu"] = cjeu
ORACLES["search_cjeu"] = _sql("text", f"CASE WHEN doc_id % 50 = query_id {_ASKED}, score DESC", "true", 6)


def admin(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the queries are dockets; half of these are held."""
    df = documents(spark, folder).select(_key().alias("id"), F.col("text").alias("texte"), (F.col("doc_id") * 2 + 2_000_000).cast("string").alias("numero"),
                                         F.col("source").alias("juridiction"), _day().alias("date"))
    q = _any_word(spark, folder).withColumn("query", F.when(F.col("query_id") % 3 == 0, (F.col("query_id") + 2_000_000).cast("string")).otherwise(F.col("query")))
    return _out(collections.search_admin(q, df, 4), "id")


QUERIES["search_admin"] = admin
ORACLES["search_admin"] = f"""WITH words AS ({_sql("source || ' ' || (doc_id * 2 + 2000000) || ' ' || text", 'score DESC, date DESC', 'query_id % 3 <> 0', 4)})
SELECT * FROM words UNION ALL SELECT item_id, doc_id, 1 FROM benchmark JOIN documents ON doc_id * 2 = item_id WHERE item_id % 3 = 0"""
QUERIES["newest_admin"] = lambda spark, folder: collections.newest_admin(documents(spark, folder).select(
    "doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("juridiction_code"), F.when(F.col("doc_id") % 11 > 0, _day()).alias("date")), 3, id_col="doc_id").select(
    "doc_id", "juridiction_code", F.col("rank").cast("long").alias("rank"))
ORACLES["newest_admin"] = f"""SELECT doc_id, source AS juridiction_code, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
  CASE WHEN doc_id % 11 > 0 THEN {_DAY} END DESC NULLS LAST, doc_id) AS rank FROM documents WHERE doc_id % 7 > 0) WHERE rank <= 3"""


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as keys of a flat synonym table, asked for between other words."""
    p = table(spark, folder, "part")
    synonyms = p.groupBy(F.col("p_name").alias("term")).agg(F.array(F.min("p_brand")).alias("synonyms"))
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("avant "), "p_name", F.lit(" ensuite")).alias("query"))
    return thesaurus.expand_with_dict(q, synonyms).select("query_id", "expanded")


QUERIES["expand_with_dict"] = dictionary
ORACLES["expand_with_dict"] = """WITH s AS (SELECT p_name, min(p_brand) AS b FROM part GROUP BY ALL)
SELECT p_partkey AS query_id, 'avant ("' || p_name || '" OR ' || CASE WHEN contains(b, ' ') THEN '"' || b || '"' ELSE b END || ') ensuite' AS expanded FROM part JOIN s USING (p_name)"""
QUERIES["union_sources"] = lambda spark, folder: windows.union_sources(
    table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom")),
    table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("pays")))
ORACLES["union_sources"] = "SELECT c_custkey AS id, c_name AS nom, NULL AS pays FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier"


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a citation in front, as linked markup."""
    d = documents(spark, folder).select("doc_id", F.concat(F.lit("<l'article "), (F.col("doc_id") + 1).cast("string"), F.lit(" du code civil> "), "text").alias("t"))
    out = citations.annotate_citations(citations.with_citation_spans(d, "t"), "t", "spans")
    return out.select("doc_id", F.md5("annotated").alias("digest"))


QUERIES["annotate_citations"] = annotated
ORACLES["annotate_citations"] = """SELECT doc_id, md5('&lt;l&#x27;article <a href="/loi/CC/' || (doc_id + 1) || '" class="lawref" title="CC ' || (doc_id + 1) || '">' || (doc_id + 1) || '</a> du code civil&gt; ' ||
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM documents"""


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return joins.parse_json_columns(joins.json_columns(e, ["v"]), {"v": "array<double>"}).select(
        "vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


QUERIES["json_columns"] = round_trip
ORACLES["json_columns"] = "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"
QUERIES["decode_payload"] = lambda spark, folder: documents(spark, folder).select("doc_id", F.md5(text.decode_payload(
    F.when(F.col("lang") == "fr", F.encode(F.regexp_replace("text", "[^\\u0000-\\u00ff]", "?"), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")))).alias("digest"))
ORACLES["decode_payload"] = r"SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN regexp_replace(text, '[^\x{0000}-\x{00ff}]', '?', 'g') ELSE text END) AS digest FROM documents"
