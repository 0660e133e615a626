"""Ranking, deduplication, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.dates import date_order
from lexloom.functions.text import norm_name
from lexloom.runtime import blank_to_null, stage


def keep_best(df: DataFrame, keys: list[str], *order: Column | str, k: int = 1, rank_col: str | None = None) -> DataFrame:
    """The ``k`` best rows per key. The limit is applied before the shuffle as well as after it."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank_col) if rank_col else out.drop("_rank")


def dedup_by_parent(hits: DataFrame, parent_col: str, id_col: str = "id", query_col: str = "query_id",
                    score_col: str = "score") -> DataFrame:
    """The best hit of each parent text per query; a hit without parent stands for itself."""
    parent = F.coalesce(blank_to_null(F.col(parent_col).cast("string")), F.concat(F.lit("\u0000"), F.col(id_col).cast("string")))
    return keep_best(hits.withColumn("_parent", parent), [query_col, "_parent"],
                     F.col(score_col).desc(), F.col(id_col)).drop("_parent")


def dedup_hits(hits: DataFrame, id_col: str = "id", query_col: str = "query_id", *order: Column | str) -> DataFrame:
    """One row per hit id and query, the first in the given order."""
    return keep_best(hits, [query_col, id_col], *order)


def topk_per_court(df: DataFrame, court_cols: list[str], date_col: str, id_col: str, k: int) -> DataFrame:
    """The ``k`` newest rows of each court."""
    return keep_best(df, court_cols, date_order(date_col), F.col(id_col), k=k, rank_col="rank")


RICHNESS_FIELDS = ["tel", "site", "adresse_postale", "hierarchie", "source_url"]


def merge_directory(df: DataFrame, ord_col: str = "ord", richness_fields: list[str] | None = None) -> DataFrame:
    """One entry per type and normalised name: with an address first, then the richest, then the earliest."""
    fields = [c for c in (richness_fields or RICHNESS_FIELDS) if c in df.columns]
    richness = sum((blank_to_null(F.col(c).cast("string")).isNotNull().cast("int") for c in fields), F.lit(0))
    has_mail = (F.size("mails") > 0).cast("int")
    order = F.struct((-has_mail).alias("a"), F.when(has_mail == 1, -richness).otherwise(0).alias("b"),
                     F.col(ord_col).alias("c"))
    row = F.struct(*df.columns)
    return df.groupBy("type", norm_name("nom").alias("_name")).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def dedup_contacts(df: DataFrame, ord_col: str, org_col: str = "organisme", address_col: str = "adresse") -> DataFrame:
    """First contact of each organisation and address."""
    return df.groupBy(org_col, address_col).agg(
        F.min_by(F.struct(*df.columns), F.col(ord_col)).alias("_r")).select("_r.*")


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``position`` (from 0) in one global order that must end with a unique key.

    Rows are range partitioned and written once with a per-partition sequence number; the first
    number of each partition comes from the partition sizes, so no task ever sees more than its
    own range. Meant for narrow rows.
    """
    columns = df.columns
    ordered = stage(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per range partition: the only window over everything runs on this tiny table.
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "position", F.col("_start") + within).select(*columns, "position")


def enumerate_pages(df: DataFrame, id_col: str, date_col: str | None = None,
                    page_size: int = dims.ENUMERATION_PAGE, extra: list[str] | None = None) -> DataFrame:
    """Number all rows, newest first with the id as tie-break (or by id alone), and cut them into pages."""
    order = ([date_order(date_col)] if date_col else []) + [F.col(id_col)]
    columns = [id_col, *([date_col] if date_col else []), *(extra or [])]
    return number_rows(df.select(*columns), *order).withColumn("page", F.floor(F.col("position") / page_size)).select(
        *columns, "position", "page")


def retain_latest(df: DataFrame, bucket_col: str, n: int) -> DataFrame:
    """Rows of the ``n`` most recent buckets."""
    kept = df.select(bucket_col).distinct().orderBy(F.desc(bucket_col)).limit(n)
    return df.join(kept, bucket_col, "left_semi")


def ordered_directory(df: DataFrame, type_col: str = "type", name_col: str = "nom") -> DataFrame:
    """Add the display rank of the type and sort by it, then by name; unknown types come last."""
    at = F.array_position(F.array(*[F.lit(t) for t in dims.DIRECTORY_ORDER]), F.col(type_col))
    rank = F.when(at > 0, at - 1).otherwise(99)
    return df.withColumn("type_rank", rank).orderBy("type_rank", name_col)


def order_hits(df: DataFrame, mode: str = "relevance", exact: Column | None = None, id_col: str = "id",
               date_col: str = "date", score_col: str = "relevance") -> DataFrame:
    """Sort hits: by relevance (hits without one after, newest first), or by date either way.

    Rows matching ``exact`` come first in every mode; unknown dates come last.
    """
    boost = [F.when(exact, 0).otherwise(1)] if exact is not None else []
    return df.orderBy(*boost, *hit_order(mode, date_col, score_col), id_col)


def hit_order(mode: str, date_col: str = "date", score_col: str = "relevance") -> list[Column]:
    if mode == "date_desc":
        return [date_order(date_col, "desc")]
    if mode == "date_asc":
        return [date_order(date_col, "asc")]
    if mode == "relevance":
        return [F.col(score_col).desc_nulls_last(), date_order(date_col, "desc")]
    raise ValueError(f"unknown sort mode {mode!r}")


def page(df: DataFrame, limit: int, offset: int = 0, max_limit: int = 100, max_offset: int = 10_000) -> DataFrame:
    """One page of a sorted result; a page beyond the bounds is refused, not cut."""
    if not 1 <= limit <= max_limit or not 0 <= offset <= max_offset:
        raise ValueError(f"a page has 1 to {max_limit} rows and starts at 0 to {max_offset}")
    return df.offset(offset).limit(limit)


def page_hits(ranked: DataFrame, limit: int, offset: int = 0, rank_col: str = "rank") -> DataFrame:
    """The same page of every query of a batch; the rank is 1-based."""
    return ranked.where(F.col(rank_col).between(offset + 1, offset + limit))


def page_marker(page_rows: DataFrame, totals: DataFrame, offset: int = 0, query_col: str = "query_id") -> DataFrame:
    """Per query: total, returned, whether something was cut off and where the next page starts."""
    returned = page_rows.groupBy(query_col).agg(F.count("*").alias("returned"))
    out = totals.join(returned, query_col, "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    nxt = F.col("returned") + offset
    return out.withColumn("truncated", nxt < F.col("total")).withColumn(
        "next_offset", F.when(nxt < F.col("total"), nxt))


def order_ci(df: DataFrame, col: str) -> DataFrame:
    """Sort letter-case insensitively."""
    return df.orderBy(F.lower(col), col)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Rows of several sources under one schema."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


union_directory = union_sources
