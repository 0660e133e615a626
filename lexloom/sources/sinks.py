"""Sinks and table freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.dates import clean_iso_date
from lexloom.plans.index import write_postings  # noqa: F401  (index tables are a sink too)


def write_csv_sorted(df: DataFrame, path: str, *order, files: int | None = None) -> None:
    """`;`-delimited export in global order; the files' names follow that order."""
    flat = df.select(*[F.array_join(f.name, " ; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
                       for f in df.schema.fields])
    out = flat.repartitionByRange(files, *order).sortWithinPartitions(*order) if files else flat.orderBy(*order)
    out.write.mode("overwrite").csv(path, sep=";", header=True, escape='"')


def write_json(df: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Rows as JSON lines, and their counters in a folder beside them."""
    df.write.mode("overwrite").json(f"{path}/rows")
    if meta is not None:
        meta.write.mode("overwrite").json(f"{path}/meta")


def write_table(df: DataFrame, path: str, date_col: str | None = "date", mode: str = "overwrite") -> None:
    """Collection table as Parquet, partitioned by year so that date filters prune folders.

    The rows are rebalanced by year before the write: adaptive execution cuts a year of many rows into
    tasks of the advisory size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) and joins small
    years to one task, so files follow the data and not the number of input tasks.
    """
    if date_col is None:
        df.write.mode(mode).parquet(path)
        return
    day = clean_iso_date(F.col(date_col).cast("string"))
    dated = df.withColumn("year", F.coalesce(F.year(day), F.lit(0)))
    dated.hint("rebalance", F.col("year")).write.mode(mode).partitionBy("year").parquet(path)


def freshness(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Last file change of each collection, from the listing alone; no file is opened."""
    def one(name: str, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("modificationTime")
        return files.agg(F.max("modificationTime").alias("last_update")).select(F.lit(name).alias("collection"), "last_update")
    return reduce(DataFrame.unionByName, [one(n, p) for n, p in paths.items()])
