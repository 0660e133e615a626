"""Substring search over the consolidated directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.windows import keep_best

GRAM = 3


def _grams(col: Column, n: int) -> Column:
    """Distinct character n-grams of a text."""
    last = F.length(col) - n
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(col, i + 1, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def directory_matches(queries: DataFrame, entries: DataFrame, mail: str = "mail", org: str = "organisme",
                      service: str = "service", id_col: str = "entry_id") -> DataFrame:
    """Every entry that contains a query, scored: in the address 3, organisation 2, service 1.

    A query meets the entries through the rarest of its three-letter pieces (shorter queries
    through themselves), an equality join; the substring test then decides. Queries are never
    paired with every entry.
    """
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in (mail, org, service)]
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where(F.col("q") != "")
    pieces = asked.select("query_id", "q", F.explode(F.when(F.length("q") == 1, _grams(F.col("q"), 1)).when(
        F.length("q") == 2, _grams(F.col("q"), 2)).otherwise(_grams(F.col("q"), GRAM))).alias("gram"))
    own_grams = F.array_distinct(F.flatten(F.array(*[_grams(f, n) for f in fields for n in (1, 2, GRAM)])))
    offered = entries.select(id_col, F.explode_outer(own_grams).alias("gram")).join(
        pieces.select("gram").distinct(), "gram", "left_semi")
    commonness = offered.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(commonness, "gram").groupBy("query_id", "q").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    hits = offered.join(rarest, "gram").drop("gram").join(entries, id_col)
    score = F.coalesce(*[F.when(f.contains(F.col("q")), s) for f, s in zip(fields, (3, 2, 1))], F.lit(0))
    return hits.withColumn("score", score).where("score > 0").drop("q")


def search_directory(queries: DataFrame, entries: DataFrame, limit: int = 20, id_col: str = "entry_id", **fields) -> DataFrame:
    """The best entries per query, see :func:`directory_matches`."""
    return keep_best(directory_matches(queries, entries, id_col=id_col, **fields), ["query_id"],
                     F.desc("score"), F.col(id_col), k=limit, rank_col="rank")


def directory_totals(queries: DataFrame, entries: DataFrame, **fields) -> DataFrame:
    """Matches per query regardless of the limit."""
    return directory_matches(queries, entries, **fields).groupBy("query_id").agg(F.count("*").alias("total"))
