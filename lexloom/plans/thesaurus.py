"""Thesaurus build and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.text import fold_upper
from lexloom.operators.merge import first
from lexloom.operators.windows import keep_best

MAX_SYNONYMS = 8
_SEGMENTS = "array<struct<kind:string,text:string>>"


def build_thesaurus(sources: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union of (concepts, labels, relations) of several sources, keyed and deduplicated."""
    def union(i: int) -> DataFrame:
        out = sources[0][i]
        for s in sources[1:]:
            out = out.unionByName(s[i], allowMissingColumns=True)
        return out

    concepts = first(union(0), ["source", "code"], ["depth", "label"])
    labels = union(1).withColumn("label_normalized", fold_upper("label")).where(F.col("label_normalized") != "")
    labels = labels.dropDuplicates(["source", "code", "label_normalized", "label_type"])
    relations = union(2).distinct()
    return concepts, labels, relations


def concept_labels(concepts: DataFrame) -> DataFrame:
    """Preferred-label rows of concepts that come without a label table."""
    return concepts.select("source", "code", "label", F.lit("pref").alias("label_type"))


def parent_relations(concepts: DataFrame) -> DataFrame:
    """Broader edges from the parent column."""
    return concepts.where(F.col("parent_code").isNotNull()).select(
        "source", F.col("code").alias("src_code"), F.col("parent_code").alias("dst_code"), F.lit("broader").alias("rel_type"))


def synonym_table(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """``label_normalized, source, synonym`` — alternates, preferred label and direct children of a label's concepts."""
    names = labels.select("source", "code", "label_normalized").distinct()
    alts = labels.where("label_type = 'alt'").select("source", "code", F.col("label").alias("synonym"))
    prefs = concepts.select("source", "code", F.col("label").alias("synonym"))
    children = concepts.where(F.col("parent_code").isNotNull()).select(
        "source", F.col("parent_code").alias("code"), F.col("label").alias("synonym"))
    offered = alts.unionByName(prefs).unionByName(children)
    return names.join(offered, ["source", "code"]).where(
        fold_upper("synonym") != F.col("label_normalized")).select("label_normalized", "source", "synonym").distinct()


def expand_terms(terms: DataFrame, concepts: DataFrame, labels: DataFrame, limit: int = MAX_SYNONYMS) -> DataFrame:
    """``term, scope, synonyms`` for each asked ``term, scope`` that has any: sorted, the first eight."""
    asked = terms.select("term", "scope").distinct().withColumn("label_normalized", fold_upper("term"))
    scopes = F.broadcast(dims.scope_table(terms.sparkSession))
    allowed = asked.join(scopes, "scope")
    found = allowed.join(synonym_table(concepts, labels), ["label_normalized", "source"]).select(
        "term", "scope", "synonym").distinct()
    kept = keep_best(found, ["term", "scope"], F.col("synonym"), k=limit)
    return kept.groupBy("term", "scope").agg(F.array_sort(F.collect_list("synonym")).alias("synonyms"))


def segments(col: Column | str) -> Column:
    """A query cut into ``struct<kind, text>``: quoted phrase, excluded word or phrase, free term."""
    col = F.col(col) if isinstance(col, str) else col
    raw = F.regexp_extract_all(col, F.lit(r'(?<!\S)-"[^"]*"|(?<!\S)-[^\s"]+|"[^"]*"|[^\s"]+'), F.lit(0))
    bare = lambda s: F.replace(s, F.lit('"'), F.lit(""))
    return F.transform(raw, lambda s: F.struct(
        F.when(s.startswith('"'), "phrase").when(s.startswith("-") & (F.length(s) > 1), "neg").otherwise("term").alias("kind"),
        F.when(s.startswith("-") & (F.length(s) > 1), F.regexp_replace(bare(s), "^-", "")).otherwise(bare(s)).alias("text"),
    )).cast(_SEGMENTS)


def _quoted(text: Column) -> Column:
    return F.when(text.contains(" "), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def _or_group(term: Column, synonyms: Column) -> Column:
    return F.concat(F.lit("("), _quoted(term), F.lit(" OR "),
                    F.array_join(F.transform(synonyms, lambda s: _quoted(s)), " OR "), F.lit(")"))


def expand_queries(queries: DataFrame, concepts: DataFrame, labels: DataFrame, scope_col: str | None = None,
                   max_words: int = 3) -> DataFrame:
    """Add ``expanded`` and ``trace`` to ``query_id, query``.

    From left to right, the longest run of one to three free words that has synonyms becomes an
    OR group and its words are used up. Phrases and exclusions stay as they are.
    """
    scope = F.col(scope_col) if scope_col else F.lit("toutes")
    cut = queries.withColumn("_scope", F.when(scope.isin(list(dims.SCOPE_SOURCES)), scope).otherwise("toutes")).withColumn(
        "_segs", segments("query")).withColumn(
        "_terms", F.transform(F.filter("_segs", lambda s: s["kind"] == "term"), lambda s: s["text"]))
    runs = F.flatten(F.transform("_terms", lambda _, i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("_terms") - i)),
        lambda n: F.struct(i.alias("at"), n.alias("span"), F.array_join(F.slice("_terms", i + 1, n), " ").alias("term")))))
    grams = cut.where(F.size("_terms") > 0).select("query_id", F.col("_scope").alias("scope"), F.inline(runs))
    found = grams.join(expand_terms(grams.select("term", "scope"), concepts, labels), ["term", "scope"])
    options = found.groupBy("query_id").agg(F.collect_list(F.struct("at", "span", "term", "synonyms")).alias("_options"))
    return _rewrite(cut.join(options, "query_id", "left"))


def expand_with_dict(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Expansion from a flat synonym table (``term, synonyms``): the longest key first, no overlaps."""
    keys = synonyms.select(fold_upper("term").alias("_key"), "synonyms")
    widest = keys.agg(F.coalesce(F.max(F.size(F.split("_key", r"\s+"))), F.lit(1)).alias("_widest"))  # one row
    cut = queries.withColumn("_scope", F.lit("toutes")).withColumn("_segs", segments("query")).withColumn(
        "_terms", F.transform(F.filter("_segs", lambda s: s["kind"] == "term"), lambda s: s["text"]))
    runs = F.flatten(F.transform("_terms", lambda _, i: F.transform(
        F.sequence(F.lit(1), F.least(F.col("_widest"), F.size("_terms") - i)),
        lambda n: F.struct(i.alias("at"), n.alias("span"), F.array_join(F.slice("_terms", i + 1, n), " ").alias("term")))))
    grams = cut.crossJoin(F.broadcast(widest)).where(F.size("_terms") > 0).select("query_id", F.inline(runs)).withColumn("_key", fold_upper("term"))
    options = "array<struct<at:int,span:int,term:string,synonyms:array<string>>>"
    # Longest key first: take the candidates in that order and keep each that touches no earlier one.
    longest = lambda a, b: F.when(F.length(a["term"]) > F.length(b["term"]), -1).when(
        F.length(a["term"]) < F.length(b["term"]), 1).otherwise(a["at"] - b["at"])
    overlaps = lambda a, b: (a["at"] < b["at"] + b["span"]) & (b["at"] < a["at"] + a["span"])
    chosen = F.aggregate(F.array_sort(F.col("_all").cast(options), longest), F.array().cast(options),
                         lambda acc, c: F.when(F.exists(acc, lambda o: overlaps(o, c)), acc).otherwise(
                             F.array_append(acc, c).cast(options)))
    picked = grams.join(keys, "_key").groupBy("query_id").agg(
        F.collect_list(F.struct("at", "span", "term", "synonyms")).alias("_all")).select("query_id", chosen.alias("_options"))
    return _rewrite(cut.join(picked, "query_id", "left"))


def _rewrite(df: DataFrame) -> DataFrame:
    """Rebuild the query text from segments and the expansions chosen greedily from the left."""
    start = F.struct(F.lit(0).alias("term_no"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"),
                     F.array().cast("array<struct<original:string,synonyms:array<string>>>").alias("trace"))
    options = F.coalesce(F.col("_options"),
                         F.array().cast("array<struct<at:int,span:int,term:string,synonyms:array<string>>>"))

    def step(acc: Column, seg: Column) -> Column:
        here = F.filter(options, lambda o: o["at"] == acc["term_no"])
        best = F.get(F.array_sort(here, lambda a, b: b["span"] - a["span"]), F.lit(0))
        is_term, free = seg["kind"] == "term", acc["term_no"] >= acc["used"]
        expand = is_term & free & best.isNotNull()
        text = (
            F.when(seg["kind"] == "phrase", F.concat(F.lit('"'), seg["text"], F.lit('"')))
            .when(seg["kind"] == "neg", F.concat(F.lit("-"), _quoted(seg["text"])))
            .when(expand, _or_group(best["term"], best["synonyms"]))
            .otherwise(seg["text"])
        )
        return F.struct(
            (acc["term_no"] + is_term.cast("int")).alias("term_no"),
            F.when(expand, acc["term_no"] + best["span"]).otherwise(acc["used"]).alias("used"),
            F.when(is_term & ~free, acc["out"]).otherwise(F.array_append(acc["out"], text)).cast("array<string>").alias("out"),
            F.when(expand, F.array_append(acc["trace"], F.struct(
                best["term"].alias("original"), best["synonyms"].alias("synonyms"))))
            .otherwise(acc["trace"]).cast("array<struct<original:string,synonyms:array<string>>>").alias("trace"))

    built = F.aggregate("_segs", start, step)
    return df.withColumn("_built", built).withColumn("expanded", F.array_join("_built.out", " ")).withColumn(
        "trace", F.col("_built.trace")).drop("_built", "_segs", "_terms", "_scope", "_options")
