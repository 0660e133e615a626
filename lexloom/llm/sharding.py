"""Contiguous shards of near equal size, cut from global prefix sums of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.prefix import running_sums
from lexloom.runtime import stage

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to ``shards`` contiguous shards whose byte sizes are as equal as whole rows allow.

    The global order is (first 60 bits of the text's MD5, id), so equal texts are neighbours and only a cut can
    part them. The size of a row is its text's UTF-8 bytes (none for a null) plus ``ROW_BYTES``; a
    row goes to the shard in whose equal share of all bytes its middle lies. Returns doc_id, size,
    text_crc32, shard and slot (position inside the shard, from 0). A null id sorts first; rows
    equal in id and text are numbered apart; a shard may stay empty when there are fewer rows
    than shards. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    narrow = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), place.alias("_hash")).withColumn("_one", F.lit(1).cast("long")), "shard-sizes")
    placed = running_sums(narrow, ["_hash", "doc_id", "size"], ["size", "_one"])
    whole = narrow.agg(F.sum("size").alias("_all"))
    middle = 2 * F.col("size_upto") - F.col("size")
    placed = placed.crossJoin(F.broadcast(whole)).withColumn(  # one row
        "shard", F.least(F.lit(shards - 1), F.floor(middle / F.col("_all") * (shards / 2))).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_one_upto").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_one_upto") - F.col("_first")).alias("slot"))
