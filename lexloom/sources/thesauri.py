"""Thesaurus sources: SKOS files, flat theme lists, two-level taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import fold_upper
from lexloom.sources.xml import read_xml

_LABELS = "array<struct<_VALUE:string,`_xml:lang`:string>>"
_LINKS = "array<struct<`_rdf:resource`:string>>"
SKOS = (f"`_rdf:about` string, `rdf:type` {_LINKS}, `skos:prefLabel` {_LABELS}, `skos:altLabel` {_LABELS}, "
        f"`skos:broader` {_LINKS}, `skos:narrower` {_LINKS}, `skos:related` {_LINKS}")


def _code(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^/#]+)/?$", 1)


def skos_triples(spark: SparkSession, path: str, lang: str = "fr") -> DataFrame:
    """``code, predicate, at, object`` of every node of a SKOS file, typed or described; labels in one language.

    ``at`` numbers the values of one element of one node.
    """
    typed = read_xml(spark, path, "skos:Concept", SKOS).withColumn("_concept", F.lit(True))
    concept = F.coalesce(F.exists("rdf:type", lambda t: t["_rdf:resource"].endswith("#Concept")), F.lit(False))
    described = read_xml(spark, path, "rdf:Description", SKOS).withColumn("_concept", concept)
    said = []
    for name in ("pref", "alt"):
        own = F.filter(F.col(f"`skos:{name}Label`"), lambda x: F.coalesce(x["_xml:lang"], F.lit(lang)) == lang)
        said.append((name, F.transform(own, lambda x: F.trim(x["_VALUE"]))))
    for name in ("broader", "narrower", "related"):
        said.append((name, F.transform(F.col(f"`skos:{name}`"), lambda x: _code(x["_rdf:resource"]))))
    said.append(("type", F.when(F.col("_concept"), F.array(F.lit("Concept")))))
    rows = F.concat(*[F.coalesce(F.transform(values, lambda x, i: F.struct(F.lit(name).alias("predicate"), i.alias("at"), x.alias("object"))),
                                 F.array().cast("array<struct<predicate:string,at:int,object:string>>")) for name, values in said])
    nodes = typed.unionByName(described).where(F.col("`_rdf:about`").isNotNull())
    return nodes.select(_code(F.col("`_rdf:about`")).alias("code"), F.inline(rows)).where("object <> ''")


def read_skos(spark: SparkSession, path: str, source: str, scope: str, lang: str = "fr") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, labels and relations of a SKOS file, in one language.

    What is said of a concept may be spread over several nodes, typed ones and descriptions; all meet
    as triples of their subject. A subject counts if any node says that it is a concept and any gives a preferred label.
    """
    said = skos_triples(spark, path, lang)
    order = F.struct("at", "object")
    pivoted = said.groupBy("code").pivot("predicate", ["type", "pref", "broader"]).agg(F.min_by("object", order))
    known = pivoted.where("type is not null and pref is not null")
    concepts = known.select(F.lit(source).alias("source"), "code", F.col("pref").alias("label"), F.col("broader").alias("parent_code"),
                            F.lit(None).cast("int").alias("depth"), F.lit(scope).alias("scope"), F.lit(0).cast("long").alias("freq"))
    told = said.join(known.select("code"), "code").select(F.lit(source).alias("source"), "code", "predicate", "object").distinct()
    labels = told.where(F.col("predicate").isin("pref", "alt")).select(
        "source", "code", F.col("object").alias("label"), fold_upper("object").alias("label_normalized"), F.col("predicate").alias("label_type"))
    relations = told.where(F.col("predicate").isin("broader", "narrower", "related")).select(
        "source", F.col("code").alias("src_code"), F.col("object").alias("dst_code"), F.col("predicate").alias("rel_type"))
    return concepts, labels, relations


def themes_flat(df: DataFrame, source: str, text_col: str = "value", prefix: str = "jc", scope: str = "judiciaire") -> DataFrame:
    """A list of quoted themes to concepts with running codes (`jc0001` …)."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r'["\']([^"\']+)["\']'), F.lit(1))
    return df.select(F.posexplode(found).alias("_i", "label")).select(
        F.lit(source).alias("source"), F.format_string(f"{prefix}%04d", F.col("_i") + 1).alias("code"), F.trim("label").alias("label"),
        F.lit(None).cast("string").alias("parent_code"), F.lit(1).alias("depth"), F.lit(scope).alias("scope"), F.lit(0).cast("long").alias("freq"))


def themes_tree(df: DataFrame, source: str, json_col: str = "value", scope: str = "judiciaire") -> tuple[DataFrame, DataFrame]:
    """Two-level taxonomy `code -> {label, subs{code: label}}` to concepts and broader edges."""
    tree = F.from_json(F.col(json_col), "map<string,struct<label:string,subs:map<string,string>>>")
    top = df.select(F.explode(tree).alias("code", "_v"))
    concept = lambda d, parent, depth: d.select(
        F.lit(source).alias("source"), "code", "label", parent.alias("parent_code"), F.lit(depth).alias("depth"),
        F.lit(scope).alias("scope"), F.lit(0).cast("long").alias("freq"))
    first = concept(top.select("code", F.col("_v.label").alias("label")), F.lit(None).cast("string"), 1)
    second = concept(top.select(F.col("code").alias("_p"), F.explode("_v.subs").alias("code", "label")), F.col("_p"), 2)
    concepts = first.unionByName(second)
    edges = concepts.where(F.col("parent_code").isNotNull()).select(
        "source", F.col("code").alias("src_code"), F.col("parent_code").alias("dst_code"), F.lit("broader").alias("rel_type"))
    return concepts, edges
