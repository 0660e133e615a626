"""Citation graph: cited articles resolved at the decision's date, and decisions citing an article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.citations import ALL_NAMES, cited_articles
from lexloom.functions.text import norm_article
from lexloom.operators.asof import law_batch
from lexloom.operators.windows import keep_best
from lexloom.plans.search import match_docs

# Plain names by which a code is searched in text.
SEARCH_NAMES = {
    "CC": ["code civil"], "CP": ["code pénal"], "CPC": ["code de procédure civile"],
    "CPP": ["code de procédure pénale"], "CT": ["code du travail"], "CSP": ["code de la santé publique"],
    "CJA": ["code de justice administrative"], "CGCT": ["code général des collectivités territoriales"],
    "CRPA": ["code des relations entre le public et l'administration"],
    "CPI": ["code de la propriété intellectuelle"], "CASF": ["code de l'action sociale et des familles"],
    "CMF": ["code monétaire et financier"], "CGI": ["code général des impôts"],
    "CESEDA": ["code de l'entrée et du séjour des étrangers et du droit d'asile"],
    "CSS": ["code de la sécurité sociale"], "CCH": ["code de la construction et de l'habitation"],
    "C.com": ["code de commerce"], "C.cons": ["code de la consommation"], "C.éduc": ["code de l'éducation"],
    "CU": ["code de l'urbanisme"], "C.env": ["code de l'environnement"], "CR": ["code rural"],
    "CONST": ["Constitution"], "CEDH": ["Convention européenne des droits de l'homme"],
}


def citation_table(docs: DataFrame, id_col: str, text_col: str, names: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, code, num, n`` — the inverted citation table, one row per document and article."""
    return cited_articles(docs.withColumnRenamed(id_col, "doc_id"), "doc_id", text_col, names or ALL_NAMES).groupBy(
        "doc_id", "code", "num").agg(F.count("*").alias("n"))


def resolve_citations(cites: DataFrame, docs: DataFrame, versions: DataFrame, id_col: str = "doc_id",
                      date_col: str = "date") -> DataFrame:
    """Version of each cited article in force at the date of the citing decision, with its URL.

    Popular articles are resolved once per day, not once per citation.
    """
    dated = cites.join(docs.select(F.col(id_col).alias("doc_id"), F.col(date_col).cast("date").alias("date")), "doc_id")
    return law_batch(dated, versions).select(
        "doc_id", "code", "num", "date", "legitext", "legiarti", "tier", "found", "source_url")


def decisions_citing(refs: DataFrame, cites: DataFrame, docs: DataFrame | None = None, id_col: str = "doc_id",
                     date_col: str = "date", limit: int | None = None) -> DataFrame:
    """Decisions that cite each asked article (``ref_id, code, num``), from the citation table."""
    asked = refs.select("ref_id", "code", norm_article("num").alias("num"))
    found = cites.join(asked, ["code", "num"])
    if docs is not None:
        found = found.join(docs.withColumnRenamed(id_col, "doc_id"), "doc_id")
    if limit:
        order = [F.col(date_col).desc_nulls_last()] if docs is not None else []
        found = keep_best(found, ["ref_id"], *order, F.desc("n"), F.col("doc_id"), k=limit, rank_col="rank")
    return found


def citing_query(refs: DataFrame) -> DataFrame:
    """The boolean text query for each article: `(article N | art N) & (code name | alias)`."""
    names = F.create_map(*[x for code, group in SEARCH_NAMES.items() for x in (
        F.lit(code), F.lit(" OR ".join(f'"{n}"' for n in [*group, code])))])
    spaced = F.trim(F.regexp_replace(F.regexp_replace("num", r"^([LRDA])\.?\s*(?=\d)", "$1 "), r"[-.\s]+", " "))
    joined = norm_article("num")
    article = F.concat_ws(" OR ", *[
        F.concat(F.lit(f'"{word} '), form, F.lit('"')) for word in ("article", "articles", "art")
        for form in (spaced, F.regexp_replace(joined, "-", " "))])
    code = F.coalesce(F.try_element_at(names, F.col("code")), F.concat(F.lit('"'), F.col("code"), F.lit('"')))
    return refs.select(F.col("ref_id").alias("query_id"), F.concat(
        F.lit("("), article, F.lit(") AND ("), code, F.lit(")")).alias("query"))


def decisions_citing_text(refs: DataFrame, docs: DataFrame, id_col: str, fields: list[str], collection: str) -> DataFrame:
    """The same question asked as a text search, for collections without a citation table."""
    return match_docs(citing_query(refs), docs, id_col, fields, collection).withColumnRenamed("query_id", "ref_id")
