"""Statute text at a date, version histories, law-number resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.identifiers import source_url
from lexloom.functions.text import norm_article
from lexloom.operators.windows import number_rows
from lexloom.runtime import blank_to_null

_OPEN_START = "0001-01-01"
_OPEN_END = "9999-12-31"
KEY = ["legitext", "num"]


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def resolve_code(df: DataFrame, code_col: str = "code", out_col: str = "legitext",
                 codes: DataFrame | None = None) -> DataFrame:
    """Add the text id of a code alias; a raw text id passes through; unknown aliases give NULL."""
    codes = codes if codes is not None else dims.code_table(df.sparkSession)
    lookup = F.broadcast(codes.select(F.col("code").alias("_alias"), F.col("text_id").alias("_text_id")))
    raw = F.col(code_col).startswith("LEGITEXT") | F.col(code_col).startswith("JORFTEXT")
    joined = df.join(lookup, F.col(code_col) == F.col("_alias"), "left")
    return joined.withColumn(out_col, F.coalesce(F.when(raw, F.col(code_col)), F.col("_text_id"))).drop(
        "_alias", "_text_id")


def code_of_text(df: DataFrame, text_col: str = "legitext", out_col: str = "code") -> DataFrame:
    """The reverse look-up: code alias of a text id."""
    codes = F.broadcast(dims.code_table(df.sparkSession).select(
        F.col("code").alias("_alias"), F.col("text_id").alias("_text_id")))
    return df.join(codes, F.col(text_col) == F.col("_text_id"), "left").withColumn(
        out_col, F.col("_alias")).drop("_alias", "_text_id")


def in_force(df: DataFrame, state_col: str = "etat") -> DataFrame:
    return df.where(F.col(state_col) == "VIGUEUR")


def _typed(versions: DataFrame) -> DataFrame:
    """Narrow version rows: key, id, state and typed bounds; blank bounds are open."""
    def as_date(name: str) -> Column:
        if versions.schema[name].dataType.typeName() == "string":
            return F.try_to_date(blank_to_null(name), "yyyy-MM-dd")
        return F.col(name).cast("date")

    return versions.select(
        "legitext", "num", "legiarti", "etat",
        as_date("date_debut").alias("date_debut"), as_date("date_fin").alias("date_fin"))


def version_at(points: DataFrame, versions: DataFrame) -> DataFrame:
    """Winner and tier for each distinct ``legitext, num, at`` of ``points``.

    Tier 1: the bounds contain the day (both ends inclusive, NULL = open); tier 2: in force now;
    tier 3: any. Within a tier the latest start wins, then the latest end, then the smallest id.

    Days and versions of an article are merged in one sorted pass instead of being paired. Both
    sides are first reduced to one row per article and day, so even an article cited by a third
    of all decisions gives a window of at most two rows per calendar day.
    """
    v = _typed(versions)
    start = F.coalesce("date_debut", _day(_OPEN_START))
    end = F.coalesce("date_fin", _day(_OPEN_END))
    winner = F.struct(F.datediff(_day(_OPEN_END), end).alias("left"), F.col("legiarti"),
                      F.col("etat"), F.col("date_debut"), F.col("date_fin"))
    by_start = v.groupBy(*KEY, start.alias("at")).agg(F.min(winner).alias("v"))
    days = points.select(*KEY, "at").where(F.col("legitext").isNotNull() & F.col("num").isNotNull()).distinct()

    merged = by_start.select(*KEY, "at", F.lit(0).alias("is_point"), "v").unionByName(
        days.select(*KEY, "at", F.lit(1).alias("is_point")), allowMissingColumns=True)
    upto = W.partitionBy(*KEY).orderBy("at", "is_point").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = F.last("v", ignorenulls=True).over(upto)
    # `left` counts days to the open end, so the smallest value seen is the furthest reach so far.
    swept = (
        merged.withColumn("latest", latest)
        .withColumn("reach", F.min(F.col("v.left")).over(upto))
        .where("is_point = 1")
        .withColumn("need", F.datediff(_day(_OPEN_END), F.col("at")))
    )
    contains = F.col("latest").isNotNull() & (F.col("latest.left") <= F.col("need"))
    # The latest start has ended, but an earlier version reaches further: only such nested
    # validities are compared pair by pair.
    nested = F.coalesce(~contains & (F.col("reach") <= F.col("need")), F.lit(False))
    plain = swept.where(~nested).select(*KEY, "at", F.when(contains, F.col("latest")).alias("t1"))
    outer = (
        swept.where(nested).select(*KEY, "at", "need")
        .join(by_start.withColumnRenamed("at", "start"), KEY)
        .where((F.col("start") <= F.col("at")) & (F.col("v.left") <= F.col("need")))
        .groupBy(*KEY, "at").agg(F.max_by("v", "start").alias("t1"))
    )
    recency = F.coalesce(F.datediff(_day(_OPEN_END), F.col("date_debut")), F.lit(10_000_000))
    ranked = F.struct(recency.alias("age"), winner.alias("v"))
    fallback = v.groupBy(*KEY).agg(
        F.min(F.when(F.col("etat") == "VIGUEUR", ranked)).alias("t2"), F.min(ranked).alias("t3"))
    tiers = plain.unionByName(outer).join(fallback, KEY)
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).otherwise(3)
    return tiers.withColumn("tier", tier).withColumn(
        "v", F.coalesce("t1", "t2.v", "t3.v")).select(
        *KEY, "at", "tier", "v.legiarti", "v.etat", "v.date_debut", "v.date_fin")


def law_batch(refs: DataFrame, versions: DataFrame, payload: list[str] | None = None,
              today: Column | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Resolve ``ref_id, code, num, date`` to article versions; misses stay, with a reason.

    Output: the reference, the version found, ``tier``, ``note`` (NULL for tier 1), ``source_url``
    dated by the request (tier 1) or by the version, ``found`` and ``error``.
    """
    today = today if today is not None else F.current_date()
    asked = (
        resolve_code(refs, codes=codes)
        .withColumn("num", F.when(norm_article("num") != "", norm_article("num")))
        .withColumn("at", F.coalesce(F.col("date").cast("date"), today))
    )
    won = version_at(asked, versions)
    out = asked.join(won, [*KEY, "at"], "left")
    if payload:
        body = versions.select(*KEY, "legiarti", F.col("date_debut").cast("string").alias("_start"),
                               *payload)
        body = body.withColumn("_start", F.coalesce(blank_to_null("_start"), F.lit("")))
        out = out.withColumn("_start", F.coalesce(F.col("date_debut").cast("string"), F.lit("")))
        # Of repeated versions the greatest text counts.
        key = [*KEY, "legiarti", "_start"]
        body = body.groupBy(*key).agg(F.max(F.struct(*payload)).alias("_body")).select(*key, "_body.*")
        out = out.join(body, key, "left").drop("_start")
    found = F.col("tier").isNotNull()
    url_date = F.when(F.col("tier") == 1, F.coalesce(F.col("date").cast("date"), F.col("date_debut"))).otherwise(
        F.col("date_debut"))
    return (
        out.withColumn("found", found)
        .withColumn("note", F.when(F.col("tier") == 2, F.concat(
            F.lit("Aucune version en vigueur à "), F.col("at").cast("string"),
            F.lit(". Version courante affichée.")))
            .when(F.col("tier") == 3, "Article non trouvé à la date demandée ; version la plus récente retournée."))
        .withColumn("source_url", source_url("legiarti", F.col("legitext"), url_date))
        .withColumn("error", F.when(F.col("code").isNull() | F.col("num").isNull(), "code and num are required")
                    .when(F.col("legitext").isNull(), "unknown code")
                    .when(~found, "no version of this article"))
    )


def law_at_date(refs: DataFrame, versions: DataFrame, payload: list[str] | None = None,
                today: Column | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Only the references that resolve; see :func:`law_batch`."""
    return law_batch(refs, versions, payload, today, codes).where("found").drop("found", "error")


def law_versions(refs: DataFrame, versions: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Every version of each asked article with its position in time (``version_no`` from 1).

    Versions are numbered in one global order and counted from the first of their article, so an
    article with very many versions is not handled by one task.
    """
    numbered = number_rows(_typed(versions), *KEY, F.col("date_debut").asc_nulls_first(), "legiarti")
    first = numbered.groupBy(*KEY).agg(F.min("position").alias("_first"))
    placed = numbered.join(first, KEY).withColumn("version_no", F.col("position") - F.col("_first") + 1).drop(
        "position", "_first")
    asked = resolve_code(refs, codes=codes).withColumn("num", norm_article("num"))
    return asked.join(placed, KEY)


def resolve_law_number(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """Law number -> the text most of whose articles name it in their title.

    Numbers are read once out of all titles; numbers found in no title are looked for in first
    articles (`loi n° X`). Output: ``numero, legitext, nb, titre_section, date_debut,
    articles_count, source_url``.
    """
    asked = refs.select("numero").where(F.col("numero").rlike(r"^\d{2,4}-\d+$")).distinct()

    def best(mentions: DataFrame) -> DataFrame:
        counted = mentions.join(asked, "numero", "left_semi").groupBy("numero", "legitext").agg(
            F.count("*").alias("nb"), F.max("titre").alias("titre_section"), F.min("start").alias("date_debut"))
        order = F.struct((-F.col("nb")).alias("o"), F.col("legitext"))
        top = F.min_by(F.struct("legitext", "nb", "titre_section", "date_debut"), order)
        return counted.groupBy("numero").agg(top.alias("b")).select("numero", "b.*")

    def numbers(col: str, pattern: str) -> Column:
        return F.explode(F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(1))))

    start = F.col("date_debut").cast("string").alias("start")
    titled = versions.select("legitext", F.col("titre_text").alias("titre"), start,
                             numbers("titre_text", r"n° ?(\d{2,4}-\d+)").alias("numero"))
    in_text = versions.where(F.col("num") == "1").select(
        "legitext", F.lit("").alias("titre"), start, numbers("texte", r"(?i)loi n° (\d{2,4}-\d+)").alias("numero"))
    from_title = best(titled)
    from_text = best(in_text.join(from_title, "numero", "left_anti"))
    totals = versions.groupBy("legitext").agg(F.count("*").alias("articles_count"))
    return from_title.unionByName(from_text).join(totals, "legitext").withColumn(
        "source_url", source_url("legitext"))
