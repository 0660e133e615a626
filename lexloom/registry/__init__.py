"""Registered queries: every operator run over the driver's tables, with its SQL counterpart.

Each module fills ``QUERIES`` (name -> function of session and table folder) and ``ORACLES``
(name -> SQL over views of the same tables). The tables hold no legal text, so each query maps
them onto the shape an operator expects; the mapping is written identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are parsed or taken apart by queries.
LARGE = ("documents", "pages", "orders", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; files that Spark would read in fewer tasks than there are cores (one row group each) are dealt out."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LARGE and df.rdd.getNumPartitions() < cores else df


def all_queries() -> dict[str, Query]:
    from lexloom.registry import bulk, changes, corpus, directory, feeds, live, references, retrieval, shelves, statutes
    return {name: q for m in (statutes, retrieval, shelves, references, corpus, directory, changes, feeds, bulk, live) for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    from lexloom.registry import bulk, changes, corpus, directory, feeds, live, references, retrieval, shelves, statutes
    return {name: q for m in (statutes, retrieval, shelves, references, corpus, directory, changes, feeds, bulk, live) for name, q in m.ORACLES.items()}
