"""Predicates, look-ups and projections to the common result row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.dates import clean_iso_date, parse_fr_date
from lexloom.functions.identifiers import rg_digits
from lexloom.functions.text import fold
from lexloom.operators.windows import keep_best
from lexloom.runtime import blank_to_null, map_lookup

RESULT_COLUMNS = ["id", "source", "source_label", "title", "juridiction", "date", "formation", "numero", "ecli",
                  "extract", "relevance"]

# Where each source keeps the fields of the common result row (first non-blank column wins).
RESULT_FIELDS: dict[str, dict[str, list[str]]] = {
    "dila": {"id": ["id"], "title": ["titre"], "juridiction": ["juridiction"], "date": ["date"],
             "formation": ["formation"], "numero": ["numero"], "ecli": ["ecli"], "extract": ["snippet"]},
    "admin": {"id": ["id"], "title": ["titre", "title"], "juridiction": ["juridiction_name", "juridiction"],
              "date": ["date", "last_modified"], "formation": ["formation"],
              "numero": ["numero_dossier", "numero"], "ecli": ["ecli"], "extract": ["snippet"]},
    "ariane": {"id": ["id"], "title": ["title"], "extract": ["extracts"], "ecli": ["ecli"]},
    "cedh": {"id": ["itemid", "id"], "title": ["docname"], "date": ["date"], "formation": ["originating_body"],
             "numero": ["appno"], "ecli": ["ecli"], "extract": ["snippet"]},
    "cjue": {"id": ["celex", "id"], "title": ["title"], "date": ["date"], "formation": ["type"],
             "numero": ["affaire_num"], "ecli": ["ecli"], "extract": ["snippet"]},
}
_COURT_OF = {"ariane": "Conseil d'État", "cedh": "Cour EDH", "cjue": "CJUE"}
_GENERIC_TITLES = ["Conseil d'État", "Conseil d'Etat", ""]


def parse_ce_header(df: DataFrame, title_col: str = "title", extract_col: str = "extracts") -> DataFrame:
    """Number, date and telling title of a Council of State hit from its title and extracts."""
    title = F.trim(F.coalesce(F.col(title_col), F.lit("")))
    extract = F.coalesce(F.col(extract_col), F.lit(""))
    number = r"(?iuU)\bN[°o]\s*(\d{4,8})\b"
    ecli_year = r"(?i)ECLI:[A-Z]{2}:[A-Z]+:(\d{4}):"
    first = F.regexp_replace(F.trim(F.substring_index(extract, ";", 1)), r"[.,;]+$", "")
    telling = F.when(F.length(first) > 5, F.substring(first, 1, 140)).otherwise("Arrêt du Conseil d'État")

    def dated(text: Column) -> Column:
        from_year = F.try_to_date(F.concat(F.regexp_extract(text, ecli_year, 1), F.lit("-01-01")), "yyyy-MM-dd")
        return F.coalesce(parse_fr_date(text), from_year)

    new_title = F.when(title.isin(_GENERIC_TITLES), telling).otherwise(title)
    return (
        df.withColumn("numero", F.coalesce(blank_to_null(F.regexp_extract(extract, number, 1)),
                                           blank_to_null(F.regexp_extract(title, number, 1))))
        .withColumn("date", F.coalesce(dated(new_title), dated(extract)))
        .withColumn("ecli", blank_to_null(F.regexp_extract(F.concat_ws(" ", title, extract),
                                                           r"(?i)(ECLI:[A-Z]{2}:[A-Z]+:\d{4}:[\w.]+)", 1)))
        .withColumn(title_col, new_title)
    )


def to_result(df: DataFrame, source: str) -> DataFrame:
    """Project rows of one source onto the common result row."""
    if source == "ariane":
        df = parse_ce_header(df)
    fields = RESULT_FIELDS[source]

    def pick(name: str) -> Column:
        present = [blank_to_null(F.col(c).cast("string")) for c in fields.get(name, [name]) if c in df.columns]
        return F.coalesce(*present, F.lit(None).cast("string"))

    court = pick("juridiction")
    court = F.lit(_COURT_OF[source]) if source in _COURT_OF else map_lookup(dims.COURT_LABELS, F.lower(court), court)
    numero = pick("numero")
    title = F.coalesce(pick("title"), F.when(numero.isNotNull(), F.concat(court, F.lit(" — n° "), numero)), court)
    relevance = F.col("relevance").cast("double") if "relevance" in df.columns else F.lit(None).cast("double")
    return df.select(
        pick("id").alias("id"), F.lit(source).alias("source"), F.lit(dims.SOURCE_LABELS[source]).alias("source_label"),
        title.alias("title"), court.alias("juridiction"),
        (F.col("date") if source == "ariane" else clean_iso_date(pick("date"))).alias("date"),
        pick("formation").alias("formation"), numero.alias("numero"), pick("ecli").alias("ecli"),
        F.coalesce(pick("extract"), F.lit("")).alias("extract"), relevance.alias("relevance"))


def by_id(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is asked for."""
    return df.join(ids.select(F.col(id_col)).distinct(), id_col, "left_semi")


def by_field(df: DataFrame, field: str, values: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """Up to ``k`` rows per asked value; a multi-valued docket matches by its first number too."""
    asked = values.select(F.col("value")).where(blank_to_null("value").isNotNull()).distinct()
    key = F.col(field)
    hits = df.withColumn("value", F.substring_index(key, " ", 1) if field == "numero" else key).join(asked, "value")
    if field == "numero":
        # An asked value may itself hold a space; those match on the whole field.
        spaced = df.withColumn("value", key).where(key.contains(" ")).join(asked, "value")
        hits = hits.unionByName(spaced)
    exact = F.when(F.col(field) == F.col("value"), 0).otherwise(1)
    rank = F.row_number().over(W.partitionBy("value").orderBy(exact, id_col))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


_COURT_WORDS = (r"(?iuU)\b(?:cour|administrative|administratif|d['’]appel|appel|tribunal|conseil|de|du|des|la|le|"
                r"d['’]etat|caa|ta|ce)\b")


def court_city(col: Column) -> Column:
    """What is left of a court name once the words for the kind of court are removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(col), _COURT_WORDS, " "), r"\s+", " "))


def court_matches(stored: Column, asked: Column) -> Column:
    """Tolerant court comparison: equal, contained without accents, or same city."""
    city = court_city(asked)
    return (stored == asked) | fold(stored).contains(fold(asked)) | (
        (F.length(city) >= 3) & fold(stored).contains(city))


def by_docket(df: DataFrame, refs: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """Decisions by docket and, where given, court; at most ``k`` per reference, exact court first.

    ``refs``: ``ref_id, numero, juridiction``.
    """
    asked = refs.select("ref_id", "numero", F.col("juridiction").alias("_asked")).where(
        blank_to_null("numero").isNotNull())
    hits = asked.join(df, "numero").where(
        blank_to_null("_asked").isNull() | court_matches(F.col("juridiction"), F.col("_asked")))
    exact = F.when(F.col("juridiction") == F.col("_asked"), 0).otherwise(1)
    rank = F.row_number().over(W.partitionBy("ref_id").orderBy(exact, id_col))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("_asked")


def by_rg(df: DataFrame, refs: DataFrame, k: int = 50, id_col: str = "id") -> DataFrame:
    """Decisions by roll number in any spelling, newest first; else by the exact docket.

    Each number keeps its ``k`` first decisions before references meet them, so references that
    share a number with many decisions never become pairs of both.
    """
    asked = refs.select("ref_id", F.col("numero").alias("_asked")).where(blank_to_null("numero").isNotNull())
    key = lambda col: F.when(rg_digits(col).rlike(r"^\d{6,11}$"), rg_digits(col))
    order = (F.col("date").desc_nulls_last(), F.col(id_col))

    def newest(keyed: DataFrame) -> DataFrame:
        return keep_best(keyed.where(F.col("_key").isNotNull()), ["_key"], *order, k=k)

    rolled = asked.withColumn("_key", key(F.col("_asked"))).join(
        newest(df.withColumn("_key", key(F.col("numero")))), "_key").drop("_key")
    missing = asked.join(rolled.select("ref_id").distinct(), "ref_id", "left_anti")
    exact = missing.withColumn("_key", F.col("_asked")).join(
        newest(df.withColumn("_key", blank_to_null("numero"))), "_key").drop("_key")
    return keep_best(rolled.unionByName(exact), ["ref_id"], *order, k=k, rank_col="rank").drop("_asked")


def date_range(df: DataFrame, col: str, lo: str | None = None, hi: str | None = None, blanks: str = "keep") -> DataFrame:
    """Rows inside the inclusive range; ``blanks`` says what a row without a date does."""
    day = F.col(col)
    inside = F.lit(True)
    if lo:
        inside = inside & (day >= F.lit(lo).cast("date"))
    if hi:
        inside = inside & (day < F.date_add(F.lit(hi).cast("date"), 1))
    if blanks == "keep":
        return df.where(day.isNull() | inside)
    if blanks == "drop":
        return df.where(inside)
    raise ValueError("blanks must be 'keep' or 'drop'")


def date_slice(df: DataFrame, date_col: str, id_col: str, lo: str | None, hi: str | None,
               court_fragments: list[str] | None = None, court_col: str = "juridiction", limit: int = 500) -> DataFrame:
    """The ``limit`` newest rows of a date range, optionally of some courts; no text query involved."""
    out = date_range(df, date_col, lo, hi, blanks="drop")
    if court_fragments:
        name = fold(court_col)
        wanted = F.lit(False)
        for fragment in court_fragments:
            wanted = wanted | name.contains(fragment.lower())
        out = out.where(wanted)
    return out.orderBy(F.col(date_col).desc_nulls_last(), id_col).limit(limit)


def court_family(df: DataFrame, family: str, court_col: str = "juridiction") -> DataFrame:
    return df.where(F.lower(court_col).contains(dims.COURT_FAMILIES[family].lower()))


def nature_filter(df: DataFrame, nature: str, col: str = "nature") -> DataFrame:
    if nature.upper() not in dims.CONSTITUTIONAL_NATURES:
        raise ValueError(f"unknown nature {nature!r}")
    return df.where(F.col(col) == nature.upper())


def court_name(df: DataFrame, code_col: str, out_col: str = "court_name") -> DataFrame:
    """Court name of a court code."""
    return df.withColumn(out_col, map_lookup(dims.ADMIN_COURTS, F.upper(F.col(code_col))))


def court_code(df: DataFrame, name_col: str, out_col: str = "court_code") -> DataFrame:
    """Court code of a court name: the longest known name contained in it, accents ignored."""
    name = fold(name_col)
    known = sorted(dims.ADMIN_COURTS.items(), key=lambda kv: (-len(kv[1]), kv[0]))
    return df.withColumn(out_col, F.coalesce(*[F.when(name.contains(fold(F.lit(n))), code) for code, n in known]))


def recent(df: DataFrame, hours: int, col: str = "fetched_at", now: Column | None = None) -> DataFrame:
    """Rows ingested within the last ``hours``."""
    now = now if now is not None else F.current_timestamp()
    return df.where(F.col(col).cast("timestamp") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def directory_filter(df: DataFrame, category: str | None = None, source: str | None = None) -> DataFrame:
    """Directory rows by category fragment and exact source, letter case ignored."""
    if category:
        wanted = category.strip().lower()
        df = df.where(F.lower("categorie_slug").contains(wanted) | F.lower("categorie").contains(wanted))
    if source:
        df = df.where(F.lower("source") == source.strip().lower())
    return df
