"""Running sums over one global order, from the totals of range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.runtime import stage


def running_sums(df: DataFrame, order: Sequence[str], values: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Add ``<v>_upto`` for every value: its sum over the rows of the group up to and with this row.

    Rows are range partitioned by group and order, so neither a hot group nor a hot key lands in
    one task. The placed rows are written once; the totals of each partition and group (one row
    each) then tell every partition what lies before it, and a sorted pass inside the partition
    adds the rest. Meant for narrow rows. ``groups`` must not be null; rows equal in the whole
    order follow one another in any order.
    """
    groups, values = list(groups), list(values)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    totals = placed.groupBy("_part", *groups).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", *groups, *[
        F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values])
    within = W.partitionBy("_part", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(before, ["_part", *groups]).select(*df.columns, *[
        (F.col(f"_b_{v}") + F.sum(v).over(within)).alias(f"{v}_upto") for v in values])
