"""One search over several collections: weighted union, routing, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.queries import classify_queries, exact_number, route
from lexloom.operators.filters import to_result
from lexloom.operators.windows import hit_order, keep_best
from lexloom.plans.search import match_collections, top_k
from lexloom.runtime import map_lookup, stage


def weigh(ranked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Score of ranked hits of several sources: ``weight − 0.001 · (rank − 1)``.

    The decay keeps each source's own order among hits of equal weight. Needs ``source, rank``.
    """
    weight = map_lookup({s: str(w) for s, w in (weights or dims.AUTHORITY).items()}, F.col("source"), F.lit("1.0"))
    return ranked.withColumn("score", F.round(weight.cast("double") - (F.col("rank") - 1) * dims.RANK_DECAY, 6))


def choose_variant(hits: DataFrame, query_col: str = "query_id", variant_col: str = "variant") -> DataFrame:
    """Keep the hits of the expanded query (variant 0), or of the plain one (1) where that found nothing."""
    best = hits.groupBy(query_col).agg(F.min(variant_col).alias(variant_col))
    return hits.join(best, [query_col, variant_col], "left_semi")


def search_all(queries: DataFrame, tables: dict[str, tuple[DataFrame, str, list[str]]], limit: int = 20,
               weights: dict[str, float] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Unified search of ``query_id, query[, expanded]`` over ``source -> (table, id column, text columns)``.

    Both forms of a query run in the same plan; the plain one counts only where the expanded
    one finds nothing anywhere. ``rank`` is the place inside the source; :func:`merge_sources` makes
    one list of it.
    """
    expanded = F.col("expanded") if "expanded" in queries.columns else F.lit(None).cast("string")
    both = queries.select(F.struct("query_id", F.lit(0).alias("variant")).alias("query_id"),
                          expanded.alias("query")).where(
        F.col("query").isNotNull()).unionByName(queries.select(
            F.struct("query_id", F.lit(1).alias("variant")).alias("query_id"), F.col("query")))

    found = match_collections(both, tables)
    for source, condition in (keep or {}).items():
        df, id_col, _ = tables[source]
        inside = df.where(condition).select(F.lit(source).alias("collection"), F.col(id_col).cast("string").alias("doc_id"))
        found = found.where(F.col("collection") != source).unionByName(
            found.join(inside, ["collection", "doc_id"], "left_semi"))
    ranked = top_k(found, limit).select("query_id", "collection", F.col("doc_id").alias("id"), "rank")
    merged = weigh(ranked.withColumnRenamed("collection", "source"), weights)
    flat = merged.select("query_id.query_id", "query_id.variant", "source", "id", "rank", "score")
    return choose_variant(flat)


def merge_sources(found: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` best hits of a query over all sources: adds ``place`` (from 1), the hits held of
    each source and of all (``source_hits, hits``) and whether some were cut off."""
    per_source = found.groupBy("query_id", "source").agg(F.count("*").alias("source_hits"))
    overall = per_source.groupBy("query_id").agg(F.sum("source_hits").alias("hits"))
    best = keep_best(found, ["query_id"], F.desc("score"), F.col("source"), F.col("rank"), F.col("id"), k=limit, rank_col="place")
    return best.join(per_source, ["query_id", "source"]).join(overall, "query_id").withColumn("truncated", F.col("hits") > limit)


# Which column answers an identifier query directly, per source.
DIRECT_KEYS: dict[str, dict[str, str]] = {
    "dila": {"juritext": "id", "ecli": "ecli", "pourvoi": "numero", "rg": "numero"},
    "admin": {"dce_id": "id", "dossier_admin": "numero", "ariane_id": "numero", "ecli": "ecli"},
    "ariane": {"ariane_id": "numero"},
    "cedh": {"itemid_hudoc": "id", "ecli": "ecli"},
    "cjue": {"celex": "id", "ecli": "ecli"},
}


def direct_hits(queries: DataFrame, rows: DataFrame, source: str, k: int = 5) -> DataFrame:
    """Rows of one source that an identifier query names; a docket matches by its first number."""
    parts = []
    for intent, column in DIRECT_KEYS.get(source, {}).items():
        asked = queries.where(F.col("intent") == intent).select("query_id", F.col("intent_value").alias("_key"))
        key = F.substring_index(column, " ", 1) if column == "numero" else F.col(column)
        key = F.replace(key, F.lit("."), F.lit("")) if intent == "pourvoi" else key
        parts.append(rows.withColumn("_key", key).join(asked, "_key").drop("_key"))
    if not parts:
        return rows.limit(0).withColumn("query_id", F.lit(None).cast("long"))
    found = reduce(DataFrame.unionByName, parts)
    return keep_best(found, ["query_id"], F.col("id"), k=k)


def search_federated(queries: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], limit: int = 20,
                     per_source: int = 20, sort: str = "relevance", court: str = "", date_min: str | None = None,
                     date_max: str | None = None, relevance_sources: tuple[str, ...] = ("ariane",)) -> DataFrame:
    """Federated search of ``query_id, query`` over ``source -> (table, text columns)``.

    Intent decides the sources asked; an identifier is looked up directly and text search only
    complements it; hits merge by relevance where the source has one, else newest first; a hit
    whose number is exactly the one in the query leads.
    """
    allowed = [s for s in dims.COURT_DISPATCH[court] if s in tables]
    asked = stage(route(classify_queries(queries, "query"), allowed), "routed")
    pairs = asked.select("*", F.explode("sources").alias("source"))
    rows = {s: to_result(tables[s][0], s) for s in allowed}
    if date_min or date_max:  # dates decide before any limit
        lo, hi = F.lit(date_min or "0001-01-01").cast("date"), F.lit(date_max or "9999-12-31").cast("date")
        rows = {s: df.where(F.col("date").isNull() | F.col("date").between(lo, hi)) for s, df in rows.items()}
    direct = reduce(DataFrame.unionByName, [direct_hits(pairs.where(F.col("source") == s), rows[s], s) for s in allowed])

    by_text = pairs.where(F.col("intent") != "empty").join(
        direct.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    id_of = {s: next(c for c in ("itemid", "celex", "id") if c in tables[s][0].columns) for s in allowed}
    matches = match_collections(by_text.select("query_id", "query").distinct(),
                                {s: (tables[s][0], id_of[s], tables[s][1]) for s in allowed})
    routed = matches.withColumnRenamed("collection", "source").join(
        by_text.select("query_id", "source"), ["query_id", "source"], "left_semi")
    everything = reduce(DataFrame.unionByName, rows.values()).drop("relevance")
    # Only ids and dates meet the matches; whole rows are joined to what the limit leaves.
    routed = routed.withColumnRenamed("doc_id", "id").join(everything.select("source", "id", "date"), ["source", "id"])
    found = top_k(routed, per_source, *hit_order(sort, "date", "score"), F.col("id"), per=["query_id", "source"]).select(
        "query_id", "source", "id", "score")
    text_hits = everything.join(found, ["source", "id"]).withColumn(
        "relevance", F.when(F.col("source").isin(list(relevance_sources)), F.col("score"))).drop("score")
    hits = direct.unionByName(text_hits.select(*direct.columns))
    numbers = asked.select("query_id", "intent", F.when(
        F.col("intent").isin("fts", "phrase"), exact_number("intent_value")).alias("_number"))
    hits = hits.join(numbers, "query_id")
    plain = F.replace(F.coalesce("numero", F.lit("")), F.lit("."), F.lit(""))
    boost = F.when(plain == F.col("_number"), 0).otherwise(1)
    return keep_best(hits, ["query_id"], boost, *hit_order(sort), F.col("source"), F.col("id"), k=limit,
                     rank_col="rank").drop("_number")
