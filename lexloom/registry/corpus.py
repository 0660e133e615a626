"""Corpus mining: text cleaning, addresses, classification, thesaurus, pages, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import summaries, text
from lexloom.functions.identifiers import lang_flag, publication_label
from lexloom.operators import aggregates, windows
from lexloom.plans import thesaurus
from lexloom.registry import Query, table
from lexloom.sources.html import html_to_text, parse_contact_pages

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_MAILS_SQL = rf"""m AS (SELECT doc_id, trim(lower(unnest(regexp_extract_all(text, '{_MAIL}'))), '.,;:') AS mail FROM documents WHERE contains(text, '@'))"""


def mine_emails(spark: SparkSession, folder: str) -> DataFrame:
    mined = aggregates.mine_emails(table(spark, folder, "documents"), "text", "doc_id", "source")
    return mined.select("mail", "n", F.col("first_seen.doc_id").alias("doc_id"), F.col("first_seen.source").alias("source"))


QUERIES["mine_emails"] = mine_emails
ORACLES["mine_emails"] = f"""WITH {_MAILS_SQL}, g AS (SELECT mail, count(*) AS n, min(doc_id) AS doc_id FROM m GROUP BY ALL)
SELECT mail, n, doc_id, source FROM g JOIN documents USING (doc_id)"""
QUERIES["email_domains"] = lambda spark, folder: aggregates.email_domains(aggregates.mine_emails(table(spark, folder, "documents"), "text", "doc_id"))
ORACLES["email_domains"] = f"""WITH {_MAILS_SQL} SELECT split_part(mail, '@', -1) AS domain, count(DISTINCT mail) AS addresses, count(*) AS mentions FROM m GROUP BY ALL"""


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_to_text(table(spark, folder, "pages")).select("page_id", "title", "text")


def _plain_sql(col: str) -> str:
    out = rf"regexp_replace({col}, '(?s)<script[^>]*>.*?</script>', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?s)<style[^>]*>.*?</style>', ' ', 'g')"
    out = rf"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity, ch in {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}.items():
        out = f"replace({out}, '{entity}', '{ch}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


QUERIES["html_to_text"] = html_text
ORACLES["html_to_text"] = f"""SELECT page_id, {_plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  {_plain_sql("regexp_replace(html, '(?is)<title[^>]*>.*?</title>', ' ', 'g')")} AS text FROM pages"""


def contact_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The navigation links of a page stand for contact cards: name = link text, address = link target."""
    return parse_contact_pages(table(spark, folder, "pages"), "html", "page_id", card=r"(?s)<li>(.*?)</li>", name=r"(?s)<a[^>]*>(.*?)</a>",
                               address=r'href="/([^"]*)"', officer=r"(?s)<i>(.*?)</i>", mail=r'href="(/[^"]*)"').select(
        "page_id", F.col("card_no").cast("long").alias("card_no"), "organisme", "adresse", F.array_join("courriels", ";").alias("courriels"))


_UNESC = "replace(replace({0}, '&quot;', '\"'), '&amp;', '&')"
QUERIES["contact_pages"] = contact_pages
ORACLES["contact_pages"] = rf"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS cards FROM pages),
r AS (SELECT page_id, unnest(cards) AS card, generate_subscripts(cards, 1) - 1 AS card_no FROM c)
SELECT page_id, card_no, trim(regexp_replace({_UNESC.format("regexp_extract(card, '(?s)<a[^>]*>(.*?)</a>', 1)")}, '\s+', ' ', 'g')) AS organisme,
  trim(regexp_replace({_UNESC.format("regexp_extract(card, 'href=\"/([^\"]*)\"', 1)")}, '\s+', ' ', 'g')) AS adresse,
  regexp_extract(card, 'href="(/[^"]*)"', 1) AS courriels FROM r"""


def text_columns(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.md5(text.fold("text")).alias("folded"), text.preview("text", 80).alias("preview"),
                    F.md5(text.norm_name("source")).alias("name"), text.norm_article(F.concat(F.lit(" R. "), F.col("n_chars").cast("string"), F.lit("-8"))).alias("article"),
                    F.md5(text.fix_line_separators(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("repaired"),
                    text.clean_highlights(F.concat(F.lit("{1,2}<em>"), F.col("source"), F.lit("</em> {3,4}"))).alias("clean"))


QUERIES["text_functions"] = text_columns
ORACLES["text_functions"] = r"""WITH d AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, md5(strip_accents(lower(text))) AS folded, CASE WHEN length(flat) <= 80 THEN flat ELSE regexp_replace(substr(flat, 1, 80), ' [^ ]*$', '') || '…' END AS preview,
  md5(lower(source)) AS name, 'R' || n_chars || '-8' AS article, md5(text) AS repaired, source AS clean FROM d"""


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Markup kept as paragraphs; residual markup; paragraph openings inserted into one-line texts."""
    d = table(spark, folder, "documents")
    marked = F.concat(F.lit("<p>A "), F.col("source"), F.lit("</p><p>b<br/>c</p>"))
    block = F.concat(F.lit("Vu. "), F.repeat(F.lit("mot "), 130), F.lit("fin. Considérant que "), F.col("source"), F.lit(". PAR CES MOTIFS"))
    return d.select("doc_id", text.strip_markup_keep_paras(marked).alias("kept"), text.clean_residual_markup(F.concat(marked, F.lit("&amp;"))).alias("cleaned"),
                    F.substring_index(text.clean_residual_markup(block), "fin.", -1).alias("split"))


QUERIES["paragraphs"] = paragraphs
ORACLES["paragraphs"] = """SELECT doc_id, 'A ' || source || chr(10) || chr(10) || 'b' || chr(10) || 'c' AS kept, 'A ' || source || chr(10) || chr(10) || 'b' || chr(10) || 'c&' AS cleaned,
  chr(10) || chr(10) || 'Considérant que ' || source || '.' || chr(10) || chr(10) || 'PAR CES MOTIFS' AS split FROM documents"""


def defects(spark: SparkSession, folder: str) -> DataFrame:
    f = text.text_defects(table(spark, folder, "documents"), "text")
    return f.groupBy("is_missing", "is_stub", "lt_100", "lt_200", "no_newline").agg(F.count("*").alias("n"))


QUERIES["text_defects"] = defects
ORACLES["text_defects"] = """SELECT trim(text) = '' AS is_missing, length(text) <= 20 AS is_stub, length(text) < 100 AS lt_100, length(text) < 200 AS lt_200,
  NOT contains(text, chr(10)) AS no_newline, count(*) AS n FROM documents GROUP BY ALL"""
QUERIES["labels_and_languages"] = lambda spark, folder: table(spark, folder, "documents").groupBy(
    lang_flag("lang").alias("foreign"), publication_label(F.upper(F.substring("source", 4, 1)), F.when(F.col("doc_id") % 2 == 0, "oui")).alias("label")).agg(F.count("*").alias("n"))
ORACLES["labels_and_languages"] = "SELECT lang <> 'fr' AS \"foreign\", substr(source, 4, 1) AS label, count(*) AS n FROM documents GROUP BY ALL"

# Classification: code = region-nation-segment.
_CODES_SQL = """c AS (SELECT CAST(n_regionkey AS VARCHAR) AS a, n_regionkey || '-' || n_nationkey AS b, n_regionkey || '-' || n_nationkey || '-' || length(c_mktsegment) AS c, c_custkey, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_mktsegment", F.concat_ws("-", "n_regionkey", "n_nationkey", F.length("c_mktsegment")).alias("code"))


QUERIES["hierarchy_cumfreq"] = lambda spark, folder: aggregates.cumulative_frequency(_codes(spark, folder).withColumn("freq", F.lit(1)))
ORACLES["hierarchy_cumfreq"] = f"""WITH {_CODES_SQL} SELECT code, count(*) AS freq_cumulative, CAST(sum(leaf) AS BIGINT) AS freq_as_leaf FROM
  (SELECT a AS code, 0 AS leaf FROM c UNION ALL SELECT b, 0 FROM c UNION ALL SELECT c, 1 FROM c) GROUP BY ALL"""
QUERIES["ancestors"] = lambda spark, folder: _codes(spark, folder).select("c_custkey", F.posexplode(summaries.ancestors("code")).alias("depth", "code")).select(
    "c_custkey", F.col("depth").cast("long").alias("depth"), "code")
ORACLES["ancestors"] = f"WITH {_CODES_SQL} SELECT c_custkey, 0 AS depth, a AS code FROM c UNION ALL SELECT c_custkey, 1, b FROM c UNION ALL SELECT c_custkey, 2, c FROM c"


def label_mode(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _codes(spark, folder).select(F.substring_index("code", "-", 2).alias("code"), F.col("c_mktsegment").alias("label"))
    return aggregates.classification_labels(blocks, 3).select("code", "label", F.array_join(F.transform(
        "variants", lambda v: F.concat_ws(":", v["label"], v["n"].cast("string"))), ",").alias("variants"))


QUERIES["label_mode"] = label_mode
ORACLES["label_mode"] = f"""WITH {_CODES_SQL}, g AS (SELECT b AS code, c_mktsegment AS label, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, label) AS rk FROM g)
SELECT code, max(CASE WHEN rk = 1 THEN label END) AS label, string_agg(label || ':' || n, ',' ORDER BY rk) AS variants FROM r WHERE rk <= 3 GROUP BY ALL"""


def classification(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries composed from customers: a header with three levels, or the marked form."""
    c = _codes(spark, folder).withColumn("r", F.split("code", "-"))
    body = F.concat(F.lit("DOMAINE "), F.col("r")[0], F.lit(". - PAYS NUMERO "), F.col("r")[1], F.lit(". - "), F.col("c_mktsegment"))
    text_ = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x "), F.col("code"), F.lit(" "), body, F.lit(" z"), F.col("code"), F.lit("z fin"))).otherwise(
        F.concat(F.col("code"), F.lit(" "), body, F.lit(" - DETAIL le contrat")))
    tree = aggregates.classification_tree(c.select("c_custkey", text_.alias("s")), "c_custkey", "s")
    return tree.select("code", "label", "parent_code", F.col("depth").cast("long").alias("depth"), "freq_as_leaf", "freq_cumulative")


QUERIES["classification_tree"] = classification
ORACLES["classification_tree"] = f"""WITH {_CODES_SQL}, l AS (SELECT a AS code, 'DOMAINE ' || a AS label, NULL AS parent_code, 1 AS depth, 0 AS leaf FROM c
  UNION ALL SELECT b, 'PAYS NUMERO ' || split_part(b, '-', 2), a, 2, 0 FROM c UNION ALL SELECT c, c_mktsegment, b, 3, 1 FROM c),
g AS (SELECT code, label, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT code, label, row_number() OVER (PARTITION BY code ORDER BY n DESC, label) AS rk FROM g)
SELECT l.code, b.label, l.parent_code, l.depth, CAST(sum(leaf) AS BIGINT) AS freq_as_leaf, count(*) AS freq_cumulative FROM l JOIN b ON b.code = l.code AND rk = 1 GROUP BY ALL"""
QUERIES["classification_profile"] = lambda spark, folder: aggregates.classification_profile(
    aggregates.cumulative_frequency(_codes(spark, folder).withColumn("freq", F.lit(1))).withColumn("depth", F.size(F.split("code", "-")).cast("long")))[0]
ORACLES["classification_profile"] = f"WITH {_CODES_SQL}, a AS (SELECT 1 AS depth, a AS code FROM c UNION ALL SELECT 2, b FROM c UNION ALL SELECT 3, c FROM c) SELECT depth, count(DISTINCT code) AS n FROM a GROUP BY ALL"


def summary_parts(spark: SparkSession, folder: str) -> DataFrame:
    c = _codes(spark, folder)
    s = c.select("c_custkey", F.concat(F.lit("39-02-005 MARCHES. - "), F.col("c_mktsegment"), F.lit(". 68-03-02-08 Le texte "), F.col("c_custkey"), F.lit(". 1. Cf. CE, 1990.")).alias("s"))
    return summaries.split_summary(s, "s").select("c_custkey", "abstrats", "resume", "renvois")


QUERIES["split_summary"] = summary_parts
ORACLES["split_summary"] = "SELECT c_custkey, '39-02-005 MARCHES. - ' || c_mktsegment AS abstrats, '68-03-02-08 Le texte ' || c_custkey || '.' AS resume, '1. Cf. CE, 1990.' AS renvois FROM customer"

# Thesaurus: labels are part names (two words); a name's first word is a child of it.
_THES_SQL = """names AS (SELECT p_name AS label, min(p_partkey) AS code FROM part GROUP BY ALL),
syn AS (SELECT DISTINCT a.label AS term, 'child ' || b.p_type AS s FROM names a JOIN part b ON b.p_name = a.label
        UNION SELECT DISTINCT label, 'pref ' || code FROM names),
top8 AS (SELECT term, s, row_number() OVER (PARTITION BY term ORDER BY s) AS rk FROM syn),
exp AS (SELECT term, list(s ORDER BY s) AS syns FROM top8 WHERE rk <= 8 GROUP BY ALL)"""


def _thesaurus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, folder, "part")
    names = p.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("k"))
    code = F.col("k").cast("string").alias("code")
    none = F.lit(None).cast("string")
    top = names.select(F.lit("pcja").alias("source"), code, F.concat(F.lit("pref "), F.col("k")).alias("label"), none.alias("parent_code"))
    kids = p.join(names, p.p_name == names.label).select(F.lit("pcja").alias("source"), F.concat(F.col("k"), F.lit("-"), F.col("p_type")).alias("code"),
                                                         F.concat(F.lit("child "), F.col("p_type")).alias("label"), F.col("k").cast("string").alias("parent_code")).distinct()
    labels = names.select(F.lit("pcja").alias("source"), code, "label", text.fold_upper("label").alias("label_normalized"), F.lit("alt").alias("label_type"))
    return top.unionByName(kids), labels


def expand_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "part").select(F.col("p_name").alias("term"), F.lit("admin").alias("scope"))
    return thesaurus.expand_terms(terms, *_thesaurus(spark, folder)).select("term", F.array_join("synonyms", "|").alias("synonyms"))


QUERIES["expand_terms"] = expand_terms
ORACLES["expand_terms"] = f"WITH {_THES_SQL} SELECT term, array_to_string(syns, '|') AS synonyms FROM exp"


def expand_queries(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("avant "), F.col("p_name"), F.lit(' -non "'), F.col("p_name"), F.lit('"')).alias("query"))
    return thesaurus.expand_queries(q, *_thesaurus(spark, folder)).select("query_id", "expanded", F.size("trace").cast("long").alias("n_expanded"))


QUERIES["expand_queries"] = expand_queries
ORACLES["expand_queries"] = f"""WITH {_THES_SQL} SELECT p_partkey AS query_id, 'avant ("' || p_name || '" OR ' || array_to_string(list_transform(syns, lambda s: '"' || s || '"'), ' OR ') || ') -non "' || p_name || '"' AS expanded, 1 AS n_expanded
FROM part JOIN exp ON term = p_name"""


def thesaurus_counts(spark: SparkSession, folder: str) -> DataFrame:
    concepts, labels = _thesaurus(spark, folder)
    built = thesaurus.build_thesaurus([(concepts.withColumn("depth", F.lit(1)).withColumn("scope", F.lit("admin")), labels, thesaurus.parent_relations(concepts))])
    return aggregates.thesaurus_stats(*built).where("level = 7 or source is not null").select("kind", "source", "n")


QUERIES["thesaurus_stats"] = thesaurus_counts
ORACLES["thesaurus_stats"] = """WITH n AS (SELECT count(DISTINCT p_name) AS names, (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type FROM part)) AS kids FROM part)
SELECT kind, source, n FROM (SELECT 'concepts' AS kind, names + kids AS n FROM n UNION ALL SELECT 'labels', names FROM n UNION ALL SELECT 'relations', kids FROM n), (SELECT unnest(['pcja', NULL]) AS source)"""

_COURT_SQL = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def _by_court(spark: SparkSession, folder: str) -> DataFrame:
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).withColumn("juridiction", F.col("n_name")).withColumn("date", F.col("o_orderdate").cast("date"))


QUERIES["stats"] = lambda spark, folder: aggregates.stats(_by_court(spark, folder))
ORACLES["stats"] = f"SELECT n_name AS juridiction, count(*) AS n FROM {_COURT_SQL} GROUP BY ALL UNION ALL SELECT NULL, count(*) FROM {_COURT_SQL}"
QUERIES["topk_per_court"] = lambda spark, folder: windows.topk_per_court(_by_court(spark, folder), ["juridiction"], "date", "o_orderkey", 5).select(
    "juridiction", "o_orderkey", "date", F.col("rank").cast("long").alias("rank"))
ORACLES["topk_per_court"] = f"""WITH r AS (SELECT n_name AS juridiction, o_orderkey, CAST(o_orderdate AS DATE) AS date, row_number() OVER (PARTITION BY n_name ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS rank FROM {_COURT_SQL})
SELECT * FROM r WHERE rank <= 5"""
QUERIES["per_court_totals"] = lambda spark, folder: aggregates.per_group_totals(_by_court(spark, folder), "o_orderstatus", "juridiction")
ORACLES["per_court_totals"] = f"SELECT o_orderstatus, n_name AS juridiction, count(*) AS total FROM {_COURT_SQL} GROUP BY ALL"


def counts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("etat", F.when(F.col("o_orderstatus") == "O", "VIGUEUR").otherwise("MODIFIE"))
    tables = {"statute_version": o, "decision": table(spark, folder, "documents"), "events": table(spark, folder, "events")}
    return aggregates.page_counts(aggregates.count_collections(tables), size=500)


QUERIES["count_collections"] = counts
ORACLES["count_collections"] = """SELECT collection, total, CAST(floor(total / 500) + 1 AS BIGINT) AS pages FROM (
  SELECT 'statute_version' AS collection, count(*) AS total FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'decision', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events)"""
QUERIES["page_counts"] = lambda spark, folder: aggregates.page_counts(table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total")), size=100)
ORACLES["page_counts"] = "SELECT o_orderstatus, count(*) AS total, CAST(floor(count(*) / 100) + 1 AS BIGINT) AS pages FROM orders GROUP BY ALL"


def enumerate_pages(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate").cast("date")).alias("date"))
    return windows.enumerate_pages(o, "id", "date", page_size=400)


QUERIES["enumerate_pages"] = enumerate_pages
ORACLES["enumerate_pages"] = """SELECT id, date, position, CAST(floor(position / 400) AS BIGINT) AS page FROM (SELECT *, row_number() OVER (ORDER BY date DESC NULLS LAST, id) - 1 AS position FROM
  (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders))"""


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.split_by_volume(table(spark, folder, "part"), "p_name", 20).groupBy("page").agg(F.count("*").alias("n"))


QUERIES["split_by_volume"] = volumes
ORACLES["split_by_volume"] = "WITH g AS (SELECT p_name, count(*) AS c FROM part GROUP BY ALL) SELECT CASE WHEN c >= 20 THEN p_name ELSE 'autres' END AS page, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY ALL"
QUERIES["n_sources"] = lambda spark, folder: aggregates.n_sources(table(spark, folder, "part").withColumn("l", F.concat_ws("|", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")), F.lit(" "))), "l").groupBy(
    F.col("n_sources").cast("long").alias("n_sources")).agg(F.count("*").alias("n"))
ORACLES["n_sources"] = "SELECT CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS n_sources, count(*) AS n FROM part GROUP BY ALL"
