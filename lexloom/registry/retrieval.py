"""Index and search. Documents stand for decisions, benchmark passages supply the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import words
from lexloom.operators.filters import to_result
from lexloom.operators.windows import dedup_by_parent, dedup_hits, order_hits, page, page_hits, page_marker, union_sources
from lexloom.plans import collections, federation, index, search
from lexloom.registry import Query, table
from lexloom.runtime import stage

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPLIT = r"list_filter(string_split_regex(strip_accents(lower({col})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def split_sql(col: str) -> str:
    return _SPLIT.format(col=col)


# Token and statistics steps shared by all search queries; `docs` must offer coll, doc_id, text.
_BASE_SQL = f"""
tok AS (SELECT coll, doc_id, {split_sql('text')} AS w FROM docs),
stats AS (SELECT coll, count(*) AS n, avg(len(w)) AS a FROM tok GROUP BY ALL),
tf AS (SELECT coll, doc_id, dl, term, count(*) AS tf FROM (SELECT coll, doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
bw AS (SELECT item_id AS query_id, {split_sql('text')} AS w FROM benchmark)
"""
_DOCS_SQL = "docs AS (SELECT 'documents' AS coll, doc_id, text FROM documents)"
# Scores of (query, atom) hits; `hit` must offer coll, query_id, atom, clause, doc_id, tf, dl.
_SCORE_SQL = """
dfs AS (SELECT coll, query_id, atom, count(*) AS df FROM hit GROUP BY ALL),
score AS (SELECT coll, query_id, doc_id, count(DISTINCT clause) AS held,
            round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
          FROM hit JOIN dfs USING (coll, query_id, atom) JOIN stats USING (coll) GROUP BY ALL)
"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("w"))


def _word(i: int) -> Column:
    return F.get("w", F.lit(i - 1))


def _q(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _queries(spark: SparkSession, folder: str, text: Column) -> DataFrame:
    return passages(spark, folder).select("query_id", text.alias("query"))


def _atom(clause: int, *terms: Column, op: str = "must", is_prefix: bool = False) -> Column:
    return F.struct(F.lit(clause).alias("clause_id"), F.lit(op).alias("op"), F.array(*terms).alias("terms"), F.lit(is_prefix).alias("is_prefix"))


def _searches(spark: SparkSession, folder: str, *atoms: Column) -> DataFrame:
    """One search for each passage, as rows of words taken from it."""
    return passages(spark, folder).select("query_id", F.inline(F.array(*atoms)))


def _hits(matches: DataFrame, k: int = 10) -> DataFrame:
    return search.top_k(matches, k).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    p = index.postings(documents(spark, folder), "doc_id", ["text"], "documents")
    return p.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len"),
                    F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


QUERIES["postings"] = postings
ORACLES["postings"] = f"""WITH {_DOCS_SQL}, tok AS (SELECT doc_id, {split_sql('text')} AS w FROM docs),
occ AS (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tok)
SELECT term, doc_id, count(*) AS tf, doc_len, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id, doc_len"""


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    p = index.postings(documents(spark, folder), "doc_id", ["text"], "documents")
    c = index.corpus_stats(p)
    # One row of totals above the per-word rows.
    per_word = index.term_stats(p).select("term", "df", "cf")
    return per_word.unionByName(c.select(F.lit("").alias("term"), F.col("n_docs").alias("df"), F.round("avg_len").cast("long").alias("cf")))


QUERIES["corpus_stats"] = corpus_stats
ORACLES["corpus_stats"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY ALL
UNION ALL SELECT '', n, CAST(round(a) AS BIGINT) FROM stats"""


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    q = _searches(spark, folder, _atom(1, _word(1)), _atom(2, _word(2)))
    return _hits(search.match_docs(q, documents(spark, folder), "doc_id", ["text"]))


_TWO_WORDS_SQL = """hit AS (SELECT t.coll, query_id, atom, atom AS clause, doc_id, tf, dl FROM
  (SELECT query_id, 1 AS atom, w[1] AS term FROM bw UNION ALL SELECT query_id, 2, w[2] FROM bw) q JOIN tf t USING (term))"""

QUERIES["bm25_search"] = bm25_search
ORACLES["bm25_search"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_TWO_WORDS_SQL}, {_SCORE_SQL},
r AS (SELECT *, {_RANK} FROM score WHERE held = 2)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""


def search_totals(spark: SparkSession, folder: str) -> DataFrame:
    q = _searches(spark, folder, _atom(1, _word(1)), _atom(2, _word(2)))
    return search.totals(search.match_docs(q, documents(spark, folder), "doc_id", ["text"])).select("query_id", "total")


QUERIES["search_totals"] = search_totals
ORACLES["search_totals"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_TWO_WORDS_SQL}
SELECT query_id, count(*) AS total FROM (SELECT query_id, doc_id FROM hit GROUP BY ALL HAVING count(DISTINCT clause) = 2) GROUP BY ALL"""


def bm25_boolean(spark: SparkSession, folder: str) -> DataFrame:
    q = _searches(spark, folder, _atom(1, _word(2)), _atom(1, _word(4)), _atom(2, _word(6)), _atom(3, _word(8), op="not"))
    return _hits(search.match_docs(q, documents(spark, folder), "doc_id", ["text"]))


QUERIES["bm25_boolean"] = bm25_boolean
ORACLES["bm25_boolean"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL},
hit AS (SELECT t.coll, query_id, atom, clause, doc_id, tf, dl FROM
  (SELECT query_id, 1 AS atom, 1 AS clause, w[2] AS term FROM bw UNION ALL SELECT query_id, 2, 1, w[4] FROM bw
   UNION ALL SELECT query_id, 3, 2, w[6] FROM bw) q JOIN tf t USING (term)), {_SCORE_SQL},
bad AS (SELECT query_id, doc_id FROM bw JOIN tf ON term = w[8]),
r AS (SELECT *, {_RANK} FROM score s WHERE held = 2 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.query_id = s.query_id AND b.doc_id = s.doc_id))
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""


def phrase(spark: SparkSession, folder: str) -> DataFrame:
    q = _searches(spark, folder, _atom(1, _word(1), _word(2), _word(3)))
    return _hits(search.match_docs(q, documents(spark, folder), "doc_id", ["text"]))


_OCC_SQL = "occ AS (SELECT coll, doc_id, len(w) AS dl, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tok)"
QUERIES["phrase"] = phrase
ORACLES["phrase"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_OCC_SQL},
tri AS (SELECT coll, doc_id, dl, term || ' ' || lead(term) OVER o || ' ' || lead(term, 2) OVER o AS g FROM occ WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
hit AS (SELECT coll, query_id, 1 AS atom, 1 AS clause, doc_id, count(*) AS tf, dl FROM bw JOIN tri ON g = w[1] || ' ' || w[2] || ' ' || w[3] GROUP BY ALL), {_SCORE_SQL},
r AS (SELECT *, {_RANK} FROM score)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""


def prefix(spark: SparkSession, folder: str) -> DataFrame:
    q = _searches(spark, folder, _atom(1, F.substring(_word(3), 1, 4), is_prefix=True), _atom(2, _word(5)))
    posts = stage(index.postings(documents(spark, folder), "doc_id", ["text"], "documents"), "postings")
    return _hits(search.match(search.parsed(q), posts, index.corpus_stats(posts)))


QUERIES["prefix"] = prefix
ORACLES["prefix"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL},
hit AS (SELECT coll, query_id, 1 AS atom, 1 AS clause, doc_id, sum(tf) AS tf, dl FROM bw JOIN tf ON starts_with(term, substr(w[3], 1, 4)) GROUP BY ALL
  UNION ALL SELECT coll, query_id, 2, 2, doc_id, tf, dl FROM bw JOIN tf ON term = w[5]), {_SCORE_SQL},
r AS (SELECT *, {_RANK} FROM score WHERE held = 2)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""


def prefix_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same search over documents without an index."""
    q = _searches(spark, folder, _atom(1, F.substring(_word(3), 1, 4), is_prefix=True), _atom(2, _word(5)))
    return _hits(search.match_docs(q, documents(spark, folder), "doc_id", ["text"]))


QUERIES["search_prefix_all"] = prefix_scan
ORACLES["search_prefix_all"] = ORACLES["prefix"]


def prefix_excluded(spark: SparkSession, folder: str) -> DataFrame:
    q = _searches(spark, folder, _atom(1, _word(5)), _atom(2, F.substring(_word(3), 1, 4), op="not", is_prefix=True))
    return _hits(search.match_docs(q, documents(spark, folder), "doc_id", ["text"]))


QUERIES["search_prefix_not"] = prefix_excluded
ORACLES["search_prefix_not"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL},
hit AS (SELECT coll, query_id, 1 AS atom, 1 AS clause, doc_id, tf, dl FROM bw JOIN tf ON term = w[5]), {_SCORE_SQL},
bad AS (SELECT query_id, doc_id FROM bw JOIN tf ON starts_with(term, substr(w[3], 1, 4))),
r AS (SELECT *, {_RANK} FROM score s WHERE held = 1 AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.query_id = s.query_id AND b.doc_id = s.doc_id))
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""


def citing_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain the opening of a benchmark passage."""
    q = _queries(spark, folder, _q('"', F.array_join(F.slice("w", 1, 6), " "), '"'))
    return search.match_docs(q, documents(spark, folder), "doc_id", ["text"]).select("query_id", "doc_id")


QUERIES["citing_docs"] = citing_docs
ORACLES["citing_docs"] = f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({split_sql('text')}, ' ') || ' ' AS s FROM documents),
q AS (SELECT item_id AS query_id, ' ' || array_to_string(list_slice({split_sql('text')}, 1, 6), ' ') || ' ' AS p FROM benchmark)
SELECT query_id, doc_id FROM t JOIN q ON contains(s, p)"""


def snippet(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    q = _searches(spark, folder, _atom(1, _word(1)), _atom(2, _word(2)))
    atoms = search.parsed(q)
    hits = search.top_k(search.match_atoms(atoms, docs, "doc_id", ["text"], "documents"), 3)
    return search.with_snippets(hits, docs, atoms, "doc_id", "text").select("query_id", "doc_id", "extract")


QUERIES["snippet"] = snippet
ORACLES["snippet"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_TWO_WORDS_SQL}, {_SCORE_SQL},
r AS (SELECT *, {_RANK} FROM score WHERE held = 2),
top AS (SELECT query_id, r.doc_id, regexp_extract_all(d.text, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS s, tok.w AS f, [bw.w[1], bw.w[2]] AS q
        FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN tok ON tok.doc_id = r.doc_id JOIN bw USING (query_id) WHERE rank <= 3),
spots AS (SELECT *, unnest(range(0, greatest(len(s) - 28, 0) + 1)) AS i FROM top),
scored AS (SELECT *, len(list_distinct(list_filter(f[i + 1 : i + 28], lambda t: list_contains(q, t)))) AS c FROM spots),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY c DESC, i) AS rn FROM scored)
SELECT query_id, doc_id, CASE WHEN i > 0 THEN '…' ELSE '' END ||
  array_to_string(list_transform(range(i + 1, least(i + 28, len(s)) + 1), lambda j: CASE WHEN list_contains(q, f[j]) THEN '<em>' || s[j] || '</em>' ELSE s[j] END), ' ')
  || CASE WHEN i + 28 < len(s) THEN '…' ELSE '' END AS extract FROM best WHERE rn = 1"""

# Documents are dealt to five collections by their source.
_COLLECTIONS = ["cjue", "cedh", "jade", "dila", "legi"]
_COLL_SQL = "docs AS (SELECT ['cjue','cedh','jade','dila','legi'][CAST(substr(source, 4) AS INTEGER) % 5 + 1] AS coll, doc_id, text FROM documents)"


def search_all_weighted(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).withColumn("_c", F.substring("source", 4, 5).cast("int") % 5)
    tables = {c: (d.where(F.col("_c") == i), "doc_id", ["text"]) for i, c in enumerate(_COLLECTIONS)}
    q = passages(spark, folder).select("query_id", _q('"', _word(1), '"').alias("query"),
                                       F.when(F.col("query_id") % 2 == 0, _q('"', _word(1), '" "', _word(7), '"')).alias("expanded"))
    return federation.search_all(q, tables, limit=5).select(
        "query_id", F.col("variant").cast("long").alias("variant"), "source", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


QUERIES["search_all_weighted"] = search_all_weighted
ORACLES["search_all_weighted"] = f"""WITH {_COLL_SQL}, {_BASE_SQL},
v AS (SELECT query_id * 2 + 1 AS query_id, w[1] AS t1, NULL AS t2 FROM bw UNION ALL SELECT query_id * 2, w[1], w[7] FROM bw WHERE query_id % 2 = 0),
hit AS (SELECT coll, query_id, 1 AS atom, 1 AS clause, doc_id, tf, dl FROM v JOIN tf ON term = t1
        UNION ALL SELECT coll, query_id, 2, 2, doc_id, tf, dl FROM v JOIN tf ON term = t2), {_SCORE_SQL},
r AS (SELECT s.*, row_number() OVER (PARTITION BY coll, s.query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM score s JOIN v USING (query_id)
      WHERE held = CASE WHEN t2 IS NULL THEN 1 ELSE 2 END),
u AS (SELECT query_id // 2 AS query_id, query_id % 2 AS variant, coll AS source, CAST(doc_id AS VARCHAR) AS id, rank,
        CAST(round(CASE coll WHEN 'cjue' THEN 1.2 WHEN 'cedh' THEN 1.2 WHEN 'jade' THEN 1.1 WHEN 'dila' THEN 1.15 ELSE 0.8 END - (rank - 1) * 0.001, 4) AS DOUBLE) AS score
      FROM r WHERE rank <= 5)
SELECT * FROM u WHERE variant = (SELECT min(variant) FROM u x WHERE x.query_id = u.query_id)"""



def search_merged(spark: SparkSession, folder: str) -> DataFrame:
    """One list of the three best over all collections, with what each holds."""
    found = search_all_weighted(spark, folder)
    return federation.merge_sources(found, 3).withColumn("place", F.col("place").cast("long"))


QUERIES["search_all_merged"] = search_merged
ORACLES["search_all_merged"] = f"""WITH f AS ({ORACLES['search_all_weighted']}), r AS (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, rank, id) AS place, count(*) OVER (PARTITION BY query_id, source) AS source_hits,
  count(*) OVER (PARTITION BY query_id) AS hits FROM f)
SELECT *, hits > 3 AS truncated FROM r WHERE place <= 3"""

_DATE_SQL = "DATE '2000-01-01' + CAST({k} % 4000 AS INTEGER)"


def _federated(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Documents, pages and conversations as three sources; a third of the queries are dockets."""
    day = lambda k: F.date_add(F.lit("2000-01-01").cast("date"), (F.col(k) % 4000).cast("int")).cast("string").alias("date")
    d = documents(spark, folder).select(F.col("doc_id").cast("string").alias("id"), "text", day("doc_id"),
                                        F.format_string("%02d/%05d", (F.col("doc_id") % 90 + 10).cast("int"), F.col("doc_id").cast("int")).alias("numero"))
    p = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("celex"), F.col("html").alias("text"), day("page_id"))
    c = table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", day("conv_id"))
    docket = F.format_string("%02d/%05d", (F.col("query_id") % 90 + 10).cast("int"), F.col("query_id").cast("int"))
    q = passages(spark, folder).select("query_id", F.when(F.col("query_id") % 3 == 0, docket).otherwise(_q('"', _word(1), '" "', _word(2), '"')).alias("query"))
    q = q.select("query_id", F.when(F.col("query").startswith('"'), F.concat(F.col("query"), F.lit(" "))).otherwise(F.col("query")).alias("query"))
    tables = {"dila": (d, ["text"]), "cjue": (p, ["text"]), "admin": (c, ["text"])}
    return federation.search_federated(q, tables, limit=10, **options).select(
        "query_id", "intent", "source", "id", "date", F.col("rank").cast("long").alias("rank"))


def _federated_sql(per_source: int, order: str = "score DESC, date DESC", dates: str = "true") -> str:
    return f"""WITH docs AS (SELECT 'dila' AS coll, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
  UNION ALL SELECT 'cjue', CAST(page_id AS VARCHAR), html FROM pages UNION ALL SELECT 'admin', conv_id || '-' || turn, text FROM conversations),
dates AS (SELECT * FROM (SELECT 'dila' AS coll, CAST(doc_id AS VARCHAR) AS doc_id, {_DATE_SQL.format(k='doc_id')} AS date FROM documents
  UNION ALL SELECT 'cjue', CAST(page_id AS VARCHAR), {_DATE_SQL.format(k='page_id')} FROM pages
  UNION ALL SELECT 'admin', conv_id || '-' || turn, {_DATE_SQL.format(k='conv_id')} FROM conversations) WHERE {dates}), {_BASE_SQL},
{_TWO_WORDS_SQL.replace('FROM bw', 'FROM bw WHERE query_id % 3 <> 0')}, {_SCORE_SQL},
s AS (SELECT *, row_number() OVER (PARTITION BY coll, query_id ORDER BY {order}, doc_id) AS rk FROM score JOIN dates USING (coll, doc_id) WHERE held = 2),
u AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'rg' ELSE 'phrase_or_fts' END AS intent, coll, doc_id FROM s WHERE rk <= {per_source}
      UNION ALL SELECT item_id, 'rg', 'dila', CAST(doc_id AS VARCHAR) FROM benchmark JOIN documents ON doc_id = item_id WHERE item_id % 3 = 0),
r AS (SELECT query_id, CASE WHEN intent = 'rg' THEN 'rg' ELSE 'fts' END AS intent, coll AS source, doc_id AS id, date,
        row_number() OVER (PARTITION BY query_id ORDER BY date DESC, coll, doc_id) AS rank FROM u JOIN dates USING (coll, doc_id))
SELECT query_id, intent, source, id, date, rank FROM r WHERE rank <= 10"""


QUERIES["federated_topk"] = lambda spark, folder: _federated(spark, folder, per_source=10)
ORACLES["federated_topk"] = _federated_sql(10)
QUERIES["federated_dates"] = lambda spark, folder: _federated(spark, folder, per_source=3, date_min="2000-06-01", date_max="2002-01-31")
ORACLES["federated_dates"] = _federated_sql(3, dates="date BETWEEN DATE '2000-06-01' AND DATE '2002-01-31'")
QUERIES["federated_date_sort"] = lambda spark, folder: _federated(spark, folder, per_source=2, sort="date_desc")
ORACLES["federated_date_sort"] = _federated_sql(2, "date DESC")

_ANY_WORD_SQL = """hit AS (SELECT t.coll, query_id, atom, 1 AS clause, doc_id, tf, dl FROM
  (SELECT query_id, 1 AS atom, w[3] AS term FROM bw UNION ALL SELECT query_id, 2, w[5] FROM bw) q JOIN tf t USING (term))"""


def _any_word(spark: SparkSession, folder: str) -> DataFrame:
    q = _queries(spark, folder, _q('"', _word(3), '" OR "', _word(5), '"'))
    return search.match_docs(q, documents(spark, folder), "doc_id", ["text"])


def statute_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as versions of articles, two to five each; the best version counts."""
    d = documents(spark, folder).select(
        F.floor(F.col("doc_id") / 4).cast("string").alias("legiarti"), F.col("source").alias("legitext"), F.col("text").alias("texte"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 4).cast("int")).alias("date_debut"))
    q = _queries(spark, folder, _q('"', _word(3), '" OR "', _word(5), '"'))
    return collections.search_statutes(q, d, 5).select("query_id", "legiarti", "legitext", "date_debut", F.col("rank").cast("long").alias("rank"))


QUERIES["search_statutes_versions"] = statute_versions
ORACLES["search_statutes_versions"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_ANY_WORD_SQL}, {_SCORE_SQL},
v AS (SELECT query_id, CAST(doc_id // 4 AS VARCHAR) AS legiarti, source AS legitext, DATE '2000-01-01' + CAST(doc_id % 4 AS INTEGER) AS date_debut, score
      FROM score JOIN documents USING (doc_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, legiarti ORDER BY score DESC, date_debut DESC) AS n1 FROM v),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, legitext ORDER BY score DESC, legiarti) AS n2 FROM a WHERE n1 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, date_debut DESC, legiarti) AS rank FROM t WHERE n2 = 1)
SELECT query_id, legiarti, legitext, date_debut, rank FROM r WHERE rank <= 5"""


def parent_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.attach(_any_word(spark, folder), documents(spark, folder), "doc_id", "source")
    return dedup_by_parent(hits, "source", "doc_id").select("query_id", "source", "doc_id", F.round("score", 4).alias("score"))


QUERIES["dedup_by_parent"] = parent_hits
ORACLES["dedup_by_parent"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_ANY_WORD_SQL}, {_SCORE_SQL},
r AS (SELECT query_id, d.source, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id, d.source ORDER BY score DESC, doc_id) AS rn
      FROM score JOIN documents d USING (doc_id))
SELECT query_id, source, doc_id, score FROM r WHERE rn = 1"""


def unique_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The same document found by two searches counts once, with its best score."""
    one = _any_word(spark, folder).select("query_id", "doc_id", "score")
    two = search.match_docs(_searches(spark, folder, _atom(1, _word(3))), documents(spark, folder), "doc_id", ["text"]).select("query_id", "doc_id", "score")
    return dedup_hits(union_sources(one, two), "doc_id", "query_id", F.desc("score")).groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


QUERIES["dedup_hits"] = unique_hits
ORACLES["dedup_hits"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_ANY_WORD_SQL}, {_SCORE_SQL}
SELECT query_id, count(*) AS n, round(max(score), 4) AS best FROM score GROUP BY ALL"""


def paging(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of ten with the truncation marker."""
    matches = stage(_any_word(spark, folder), "matches", rows_per_file=search.FILE_ROWS)
    second = page_hits(search.top_k(matches, 20), 10, 10)
    return page_marker(second, search.totals(matches), offset=10).select("query_id", "total", "returned", "truncated", F.col("next_offset").cast("long").alias("next_offset"))


QUERIES["page_marker"] = paging
ORACLES["page_marker"] = f"""WITH {_DOCS_SQL}, {_BASE_SQL}, {_ANY_WORD_SQL}, t AS (SELECT query_id, count(DISTINCT doc_id) AS total FROM hit GROUP BY ALL),
m AS (SELECT query_id, total, greatest(least(total - 10, 10), 0) AS returned FROM t)
SELECT query_id, total, returned, returned + 10 < total AS truncated, CASE WHEN returned + 10 < total THEN returned + 10 END AS next_offset FROM m"""


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("titre"),
        F.when(F.col("o_orderkey") % 2 == 0, "cc").otherwise("autre").alias("juridiction"), F.col("o_orderdate").cast("date").cast("string").alias("date"),
        F.col("o_custkey").cast("string").alias("numero"))
    return to_result(o, "dila").select("id", "title", "juridiction", "date", "source_label")


QUERIES["to_result"] = result_rows
ORACLES["to_result"] = """WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'Cour de cassation' ELSE 'autre' END AS juridiction FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE juridiction || ' — n° ' || o_custkey END AS title,
  juridiction, CAST(o_orderdate AS DATE) AS date, 'JUDICIAIRE' AS source_label FROM o"""


def ordered_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of hits: exact key first, unknown dates last."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date")).alias("date"),
                                              F.round("o_totalprice", 2).alias("relevance"), "o_custkey")
    return page(order_hits(o, "date_asc", F.col("o_custkey") == 7), 50, 5).select("id", "date", "relevance")


QUERIES["order_hits"] = ordered_page
ORACLES["order_hits"] = """SELECT id, date, relevance FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS date,
  round(o_totalprice, 2) AS relevance, o_custkey FROM orders) ORDER BY CASE WHEN o_custkey = 7 THEN 0 ELSE 1 END, date ASC NULLS LAST, id LIMIT 50 OFFSET 5"""
