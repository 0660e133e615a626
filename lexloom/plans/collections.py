"""Search per collection: filters, exact-number precedence and sort keys on top of BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.dates import date_order
from lexloom.functions.identifiers import admin_docket
from lexloom.functions.queries import split_constitutional_ref
from lexloom.functions.text import fold
from lexloom.operators.filters import by_docket, court_matches
from lexloom.operators.windows import dedup_by_parent, hit_order, keep_best
from lexloom.plans import search
from lexloom.plans.search import BATCH, match_docs
from lexloom.runtime import blank_to_null, small, stage
from lexloom.schemas import COLLECTION_COLUMNS, TEXT_COLUMNS


# Columns that never take part in ranking.
LONG_TEXTS = ("text", "texte", "nota", "sommaire")


def collection_matches(queries: DataFrame, df: DataFrame, collection: str, keep: Column | None = None,
                       id_col: str | None = None) -> DataFrame:
    """All documents of a collection that satisfy a query, with their short columns and score.

    Filters apply after matching, so that word statistics always describe the whole collection.
    Long texts stay behind until ranking has left a few rows; see :func:`with_texts`.
    """
    id_col = id_col or COLLECTION_COLUMNS[collection]["id"]
    fields = [c for c in TEXT_COLUMNS[collection] if c in df.columns]
    hits = match_docs(queries, df, id_col, fields, collection).select("query_id", F.col("doc_id").alias(id_col), "score")
    rows = df if keep is None else df.where(keep)
    return hits.join(rows.drop(*LONG_TEXTS), id_col)


def with_texts(hits: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """Ranked hits with the long texts of their documents, in the collection's order of columns.

    The hits are written before, so their number is known and few hits go to the texts instead of all texts to them.
    """
    hits = small(stage(hits, "ranked"), BATCH)
    texts = df.select(id_col, *[c for c in LONG_TEXTS if c in df.columns])
    own = [c for c in hits.columns if c not in df.columns]
    return hits.join(texts, id_col).select(*[c for c in own if c == "query_id"], *df.columns, *[c for c in own if c != "query_id"])


def between(collection: str, lo: str | None, hi: str | None) -> Column | None:
    """Date filter of a collection; rows without a date drop out once a bound is given."""
    col = F.col(COLLECTION_COLUMNS[collection]["date"] or "date")
    cond = None
    if lo:
        cond = col >= F.lit(lo)
    if hi:
        cond = (col <= F.lit(hi)) if cond is None else cond & (col <= F.lit(hi))
    return cond


def _both(*conditions: Column | None) -> Column | None:
    out = None
    for c in conditions:
        if c is not None:
            out = c if out is None else out & c
    return out


def ranked(hits: DataFrame, collection: str, k: int, sort: str = "relevance") -> DataFrame:
    """The ``k`` first hits per query in the given sort mode."""
    cols = COLLECTION_COLUMNS[collection]
    date_col = cols["date"] if cols["date"] in hits.columns else None
    order = hit_order(sort, date_col, "score") if date_col else [F.col("score").desc()]
    return keep_best(hits, ["query_id"], *order, F.col(cols["id"]), k=k, rank_col="rank")


def search_collection(queries: DataFrame, df: DataFrame, collection: str, k: int = 20, sort: str = "relevance",
                      date_min: str | None = None, date_max: str | None = None, keep: Column | None = None) -> DataFrame:
    hits = collection_matches(queries, df, collection, _both(keep, between(collection, date_min, date_max)))
    return with_texts(ranked(hits, collection, k, sort), df, COLLECTION_COLUMNS[collection]["id"])


def search_statutes(queries: DataFrame, versions: DataFrame, k: int = 20, legitext: str | None = None,
                    sort: str = "relevance", date_min: str | None = None, date_max: str | None = None) -> DataFrame:
    """Statute articles, the best one per parent text; deduplicated before the limit, so it is exact.

    The hits are written before their versions meet, so they are dealt over as many tasks as their number asks for.
    """
    keep = _both(F.col("legitext") == legitext if legitext else None, between("statute_version", date_min, date_max))
    # Every version is a document of its own; of an article the best version counts, the newer one in a tie.
    version = F.concat_ws("\u0001", "legiarti", F.coalesce(F.col("date_debut").cast("string"), F.lit("")))
    dated = versions.withColumn("_version", version)
    hits = stage(collection_matches(queries, dated, "statute_version", keep, "_version"), "matches", rows_per_file=search.FILE_ROWS)
    dealt = hits.repartition(1 + hits.count() // search.HITS, "query_id", "legiarti")
    best = keep_best(dealt, ["query_id", "legiarti"], F.desc("score"), F.col("date_debut").desc_nulls_last())
    first = ranked(dedup_by_parent(best, "legitext", "legiarti"), "statute_version", k, sort)
    return with_texts(first, dated, "_version").drop("_version")


def search_gazette(queries: DataFrame, df: DataFrame, k: int = 20, nature: str | None = None, **opts) -> DataFrame:
    """Gazette texts, optionally of one nature."""
    keep = (fold("nature") == fold(F.lit(nature))) if nature else None
    return search_collection(queries, df, "gazette_text", k, keep=keep, **opts)


def search_agreements(queries: DataFrame, df: DataFrame, k: int = 20, idcc: str | None = None, **opts) -> DataFrame:
    """Collective agreements, optionally of one agreement number."""
    return search_collection(queries, df, "agreement", k, keep=(F.col("idcc") == idcc) if idcc else None, **opts)


def search_deliberations(queries: DataFrame, df: DataFrame, k: int = 20, **opts) -> DataFrame:
    return search_collection(queries, df, "deliberation", k, **opts)


def search_judicial(queries: DataFrame, df: DataFrame, k: int = 20, family: str | None = None, **opts) -> DataFrame:
    """Judicial decisions ranked by BM25, optionally of one court family."""
    keep = fold("juridiction").contains(fold(F.lit(dims.COURT_FAMILIES[family]))) if family else None
    return search_collection(queries, df, "decision_enriched", k, keep=keep, **opts)


def search_constit(queries: DataFrame, df: DataFrame, k: int = 20, nature: str | None = None,
                   date_min: str | None = None, date_max: str | None = None) -> DataFrame:
    """Constitutional decisions, newest first; `2008-562 DC` searches the number and filters the nature."""
    ref = split_constitutional_ref("query")
    asked = queries.withColumn("_ref", ref).withColumn(
        "query", F.coalesce(F.concat(F.lit('"'), F.col("_ref.number"), F.lit('"')), F.col("query")))
    wanted = asked.select("query_id", F.coalesce(F.col("_ref.nature"), F.lit(nature).cast("string")).alias("_nature"))
    keep = _both(fold("juridiction").contains("conseil constitutionnel"), between("decision_enriched", date_min, date_max))
    hits = collection_matches(asked.select("query_id", "query"), df, "decision_enriched", keep)
    hits = hits.join(small(wanted, BATCH), "query_id").where(F.col("_nature").isNull() | (F.col("nature") == F.col("_nature")))
    return with_texts(ranked(hits.drop("_nature"), "decision_enriched", k, "date_desc"), df, "id")


def constit_by_number(refs: DataFrame, df: DataFrame) -> DataFrame:
    """The newest constitutional decision that carries each number (``query_id, number``)."""
    asked = refs.select("query_id", F.concat(F.lit('"'), F.col("number"), F.lit('"')).alias("query"))
    keep = fold("juridiction").contains("conseil constitutionnel")
    return with_texts(ranked(collection_matches(asked, df, "decision_enriched", keep), "decision_enriched", 1, "date_desc"), df, "id")


def search_echr(queries: DataFrame, df: DataFrame, k: int = 20, min_len: int = 200) -> DataFrame:
    """Human-rights decisions with a usable text: the asked application first, then full judgments,
    then relevance, then the longer text."""
    shape = r"\b(\d{1,5})[/\s]+(\d{2,4})\b"
    number = F.when(F.col("query").rlike(shape), F.concat_ws(
        "/", F.regexp_extract("query", shape, 1), F.regexp_extract("query", shape, 2)))
    asked = queries.select("query_id", number.alias("_appno"))
    sized = df.withColumn("_length", F.length(F.coalesce("text", F.lit(""))))
    hits = collection_matches(queries, sized, "echr_decision", F.col("_length") > min_len).join(small(asked, BATCH), "query_id")
    best = keep_best(
        hits, ["query_id"], F.when(F.col("appno") == F.col("_appno"), 0).otherwise(1),
        F.when(F.col("doctype").isin(dims.FULL_JUDGMENTS), 0).otherwise(1), F.desc("score"),
        F.desc("_length"), F.col("itemid"), k=k, rank_col="rank").drop("_appno", "_length")
    return with_texts(best, df, "itemid")


def search_cjeu(queries: DataFrame, df: DataFrame, k: int = 20) -> DataFrame:
    """EU-court decisions: the asked case first, then relevance."""
    shape = r"(?i)\b([CTF])[\s-]+(\d{1,4})[/\s]+(\d{2})\b"
    case = F.when(F.col("query").rlike(shape), F.concat(
        F.upper(F.regexp_extract("query", shape, 1)), F.lit("-"),
        F.regexp_replace(F.regexp_extract("query", shape, 2), "^0+(?=\\d)", ""), F.lit("/"),
        F.regexp_extract("query", shape, 3)))
    hits = collection_matches(queries, df, "cjeu_decision").join(small(queries.select("query_id", case.alias("_case")), BATCH), "query_id")
    best = keep_best(hits, ["query_id"], F.when(F.col("affaire_num") == F.col("_case"), 0).otherwise(1),
                     F.desc("score"), F.col("celex"), k=k, rank_col="rank").drop("_case")
    return with_texts(best, df, "celex")


def search_admin(queries: DataFrame, df: DataFrame, k: int = 20, juridiction: str | None = None,
                 collection: str = "decision", **opts) -> DataFrame:
    """Administrative decisions: a docket goes straight to the look-up, anything else to text search.

    A docket that is not held falls back to text search as well.
    """
    court = F.lit(juridiction).cast("string")
    asked = queries.withColumn("numero", admin_docket("query"))
    direct = by_docket(df, asked.where(F.col("numero").isNotNull()).select(
        F.col("query_id").alias("ref_id"), "numero", court.alias("juridiction")), k).withColumnRenamed("ref_id", "query_id")
    direct = direct.withColumn("score", F.lit(None).cast("double"))
    rest = queries.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    keep = court_matches(F.col("juridiction"), court) if juridiction else None
    text = search_collection(rest, df, collection, k, keep=keep, **opts)
    columns = ["query_id", *df.columns, "score", "rank"]
    return direct.select(*columns).unionByName(text.select(*columns))


def newest_admin(df: DataFrame, k: int = 20, court_col: str = "juridiction_code", id_col: str = "id") -> DataFrame:
    """The newest decisions of every administrative court."""
    return keep_best(df.where(blank_to_null(court_col).isNotNull()), [court_col], date_order("date"), F.col(id_col),
                     k=k, rank_col="rank")
