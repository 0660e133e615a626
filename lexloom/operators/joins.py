"""Patches, gaps, look-ups and probes between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.identifiers import norm_rg, rg_digits
from lexloom.runtime import blank_to_null, map_lookup


def backfill_title(children: DataFrame, parents: DataFrame, key: str, child_title: str, parent_title: str) -> DataFrame:
    """Fill blank titles from the parent row."""
    names = parents.groupBy(key).agg(F.min(blank_to_null(parent_title)).alias("_title"))
    return children.join(names, key, "left").withColumn(
        child_title, F.coalesce(blank_to_null(child_title), F.col("_title"))).drop("_title")


def location_name(df: DataFrame, locations: DataFrame, code_col: str = "location", type_col: str = "jurisdiction",
                  out_col: str = "juridiction") -> DataFrame:
    """Court name of a location code: official name, else base name plus a readable location.

    ``locations``: ``location, name``. A slug such as `ca_lyon` is title-cased, `tj75056` keeps
    its numeric part.
    """
    code = F.coalesce(F.col(code_col), F.lit(""))
    base = map_lookup(dims.API_COURTS, F.col(type_col), F.coalesce(F.col(type_col), F.lit("")))
    slug = F.initcap(F.replace(F.substring(code, 4, 1000), F.lit("_"), F.lit(" ")))
    place = F.when(code.rlike("^(?:ca|tj|cc)_"), slug).when(
        code.rlike(r"^tj\d+$"), F.substring(code, 3, 1000)).otherwise(code)
    fallback = F.when((place != "") & (base != ""), F.concat(base, F.lit(" de "), place)).when(
        base != "", base).otherwise(place)
    names = locations.select(F.col("location").alias("_loc"), F.col("name").alias("_name"))
    return df.join(names, F.col(code_col) == F.col("_loc"), "left").withColumn(
        out_col, F.coalesce("_name", fallback)).drop("_loc", "_name")


def rename_locations(df: DataFrame, renames: DataFrame, name_col: str = "juridiction", title_col: str = "titre") -> DataFrame:
    """Replace an outdated court name by the official one, inside the title as well.

    ``renames``: ``old_name, new_name``.
    """
    dim = renames.groupBy(F.col("old_name").alias("_old")).agg(F.min("new_name").alias("_new"))
    known = F.col("_new").isNotNull()
    return (
        df.join(dim, F.col(name_col) == F.col("_old"), "left")
        .withColumn(title_col, F.when(known, F.replace(F.col(title_col), F.col("_old"), F.col("_new")))
                    .otherwise(F.col(title_col)))
        .withColumn(name_col, F.coalesce("_new", name_col))
        .drop("_old", "_new")
    )


def rename_residuals(df: DataFrame, name_col: str = "juridiction", pattern: str = r" de \d{4,5}$") -> DataFrame:
    """Names that still hold a bare location code, with their counts."""
    return df.where(F.col(name_col).rlike(pattern)).groupBy(name_col).agg(F.count("*").alias("n"))


def not_enriched(decisions: DataFrame, meta: DataFrame, id_col: str = "id", meta_id: str = "decision_id") -> DataFrame:
    """Decisions without metadata yet."""
    return decisions.join(meta.select(F.col(meta_id).alias(id_col)), id_col, "left_anti")


def gaps(listing: DataFrame, held: DataFrame, id_col: str, text_col: str = "text", min_len: int = 100) -> DataFrame:
    """Listed ids that are not held with a usable text."""
    usable = held.where(F.length(text_col) > min_len).select(id_col)
    return listing.select(id_col).distinct().join(usable, id_col, "left_anti")


def split_known(patch: DataFrame, target: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Patch rows whose id exists in the target, and those whose id does not."""
    ids = target.select(id_col)
    return patch.join(ids, id_col, "left_semi"), patch.join(ids, id_col, "left_anti")


def patch_text(target: DataFrame, patch: DataFrame, id_col: str = "id", text_col: str = "text",
               min_len: int = 200, order: str | None = None) -> DataFrame:
    """Overwrite a text only where it is blank, short or one single line.

    Of several patches of an id the last by ``order`` counts, without it the greatest text.
    """
    new = patch.groupBy(id_col).agg(F.max_by(text_col, order if order else text_col).alias("_new"))
    old = F.coalesce(F.col(text_col), F.lit(""))
    defect = (F.length(old) < min_len) | (F.instr(old, "\n") == 0)
    return target.join(new, id_col, "left").withColumn(
        text_col, F.when(F.col("_new").isNotNull() & defect, F.col("_new")).otherwise(F.col(text_col))).drop("_new")


def patch_columns(target: DataFrame, patch: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Overwrite the columns the patch brings, for the ids it lists; unknown columns are ignored.

    Of several patches of an id the last by ``order`` counts, without it the greatest row.
    """
    shared = [c for c in patch.columns if c in target.columns and c != id_col]
    values = F.struct(*[F.col(c).alias(f"_new_{c}") for c in shared], F.lit(True).alias("_hit"))
    last = F.max_by(values, order) if order else F.max(values)
    out = target.join(patch.groupBy(id_col).agg(last.alias("_v")).select(id_col, "_v.*"), id_col, "left")
    return out.select(*[
        (F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c))
        for c in target.columns])


def with_meta(decisions: DataFrame, meta: DataFrame, id_col: str = "id", meta_id: str = "decision_id") -> DataFrame:
    """Decisions with the columns of their API metadata."""
    clash = [c for c in meta.columns if c in decisions.columns]
    return decisions.join(meta.drop(*clash).withColumnRenamed(meta_id, id_col), id_col, "left")


def probe_ids(refs: DataFrame, decisions: DataFrame, id_col: str = "id") -> DataFrame:
    """Exact ids built from court type, docket and day: ``prefix_docket_yyyymmdd``.

    ``refs``: ``ref_id, juri_type, value, ref_date``. The prefixes tried depend on the court.
    """
    prefixes = F.create_map(*[
        x for court, names in dims.ADMIN_ID_PREFIXES.items()
        for x in (F.lit(court), F.array(*[F.lit(n) for n in names]))])
    tried = F.coalesce(F.try_element_at(prefixes, F.col("juri_type")), F.try_element_at(prefixes, F.lit("")))
    built = refs.where(F.col("ref_date").isNotNull()).select(
        "ref_id", "value", F.date_format("ref_date", "yyyyMMdd").alias("_day"), F.explode(tried).alias("_prefix"))
    built = built.select("ref_id", F.concat_ws("_", "_prefix", "value", "_day").alias(id_col)).distinct()
    return built.join(decisions, id_col)


def probe_conflicts(refs: DataFrame, decisions: DataFrame, id_col: str = "id") -> DataFrame:
    """Conflict-tribunal numbers in their three historical spellings; the first that exists wins.

    `C3830` is unique; the bare and the zero-padded form count only for that court.
    """
    upper = F.upper("value")
    digits = F.regexp_replace(upper, "^C", "")
    spelled = F.array(upper, digits, F.lpad(digits, 5, "0"))
    tried = refs.select("ref_id", F.posexplode(spelled).alias("spelling", "numero"))
    court_ok = F.lower("juridiction").contains("conflits")
    hits = tried.join(decisions, "numero").where((F.col("spelling") == 0) | court_ok)
    best = hits.groupBy("ref_id").agg(F.min("spelling").alias("spelling"))
    return hits.join(best, ["ref_id", "spelling"], "left_semi").drop("spelling")


def best_language(df: DataFrame, case_cols: list[str], lang_col: str = "lang", text_col: str = "text",
                  id_col: str = "id", min_len: int = 100) -> DataFrame:
    """Per case the best readable version: preferred language first, texts over ``min_len`` only."""
    case = F.coalesce(*[blank_to_null(c) for c in case_cols])
    order = F.coalesce(*[F.when(F.upper(lang_col) == lang, i) for i, lang in enumerate(dims.LANGUAGE_PRIORITY)],
                       F.lit(len(dims.LANGUAGE_PRIORITY)))
    usable = df.where(F.length(text_col) > min_len).withColumn("case_key", case).where(F.col("case_key").isNotNull())
    best = F.min_by(F.struct(id_col, lang_col, text_col), F.struct(order, F.col(id_col)))
    return usable.groupBy("case_key").agg(best.alias("b")).select("case_key", "b.*")


def fill_from_sibling(df: DataFrame, case_cols: list[str], lang_col: str = "lang", text_col: str = "text",
                      id_col: str = "id", min_len: int = 100) -> DataFrame:
    """Give a row without usable text the best version of the same case; keeps track of its origin."""
    case = F.coalesce(*[blank_to_null(c) for c in case_cols])
    best = best_language(df, case_cols, lang_col, text_col, id_col, min_len).select(
        "case_key", F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    lacks = F.coalesce(F.length(text_col), F.lit(0)) <= min_len
    out = df.withColumn("case_key", F.when(lacks, case)).join(best, "case_key", "left")
    return out.withColumn("text_itemid", F.coalesce("_id", id_col)).withColumn(
        "text_lang", F.coalesce("_lang", lang_col)).withColumn(
        text_col, F.coalesce("_text", text_col)).drop("case_key", "_id", "_lang", "_text")


def stable_id(changes: DataFrame, decisions: DataFrame, id_col: str = "id", numero_col: str = "numero") -> DataFrame:
    """Keep the id under which a roll number is already known, for its first incoming match only.

    Several courts share roll numbers, so the second and later homonyms keep their own id.
    """
    roll = lambda c: F.when(norm_rg(c).rlike(r"^\d{2,4}/\d{4,7}$"), rg_digits(c))
    known = decisions.select(roll(F.col(numero_col)).alias("_roll"), F.col(id_col).alias("_old")).where(
        F.col("_roll").isNotNull()).groupBy("_roll").agg(F.min("_old").alias("_old"))
    tagged = changes.withColumn("_roll", roll(F.col(numero_col)))
    first = tagged.where(F.col("_roll").isNotNull()).groupBy("_roll").agg(F.min(id_col).alias("_first"))
    joined = tagged.join(first, "_roll", "left").join(known, "_roll", "left")
    takes = (F.col(id_col) == F.col("_first")) & F.col("_old").isNotNull()
    return joined.withColumn(id_col, F.when(takes, F.col("_old")).otherwise(F.col(id_col))).drop(
        "_roll", "_first", "_old")


def json_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Serialise nested columns to JSON text; missing values become an empty list."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.to_json(F.col(c)), F.lit("[]")))
    return df


def parse_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The inverse: JSON text to nested columns of the given type."""
    for c, ddl in schemas.items():
        df = df.withColumn(c, F.from_json(F.col(c), ddl))
    return df


