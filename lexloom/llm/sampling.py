"""Hold-out rule and bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC-32 of its id as text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def bounded_sample(labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (doc_id, label) of every label, the same ones on every run.

    A label with many rows is first thinned by a hash of the id to about four times what is asked,
    so no task ranks more than that, however many rows a label has. The counts that decide this
    are one row for each label; labels are assumed to be hundreds, as for all that is fitted on them.
    """
    rows = labelled.select("doc_id", label)
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / (1 << 30)
    turn = F.row_number().over(W.partitionBy(label).orderBy(place, "doc_id"))
    thinned = rows.join(F.broadcast(counts), label).where(place * F.col("_n") <= 4 * per_label)
    return thinned.withColumn("_turn", turn).where(F.col("_turn") <= per_label).select("doc_id", label)
