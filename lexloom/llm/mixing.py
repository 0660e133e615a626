"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.prefix import running_sums
from lexloom.runtime import stage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: How often a document may be taken, and how many times its size a source may give.
PASSES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Share the total of ``sizes`` (source, source_size) among the sources by weight.

    Sources take the weights in turn, by code point, null last. No source gets more than
    ``passes`` times its size; what is above goes to the others by weight, again and again. That
    is one water level: sources in the order of size per weight are full as long as the level
    that remains for the others is above them. Adds ``rank`` (from 0) and ``target``. The table
    has one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", turn).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * passes).cast("double")
    by_level = W.orderBy(cap / F.col("_w"), "rank")
    whole = W.partitionBy()
    earlier = by_level.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    left = (total - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)))
    level = ranked.withColumn("_cap", cap).withColumn("_left", left).withColumn(
        "_level", F.max(F.when(F.col("_left") * F.col("_w") <= F.col("_cap"), F.col("_left"))).over(whole))
    return level.select("source", "source_size", "rank", F.least(
        F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _finish(turn: Column) -> Column:
    return (turn * F.col("source_size") + F.col("size_upto")) / F.col("target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, passes: int = PASSES, seed: str = "mix", keep_source: bool = False, numbers: Sequence[str] = ()) -> DataFrame:
    """How many words of every document the mix takes: doc_id, size, source_size, target, taken.

    Inside its source a document stands at a place shuffled by a hash of its id and ``seed``. Its
    virtual finish time in each pass is the source's words up to and with it, divided by the
    source's target; the copies are sorted by that time over all sources and cut off where their
    words reach the total of all sizes. A document is taken whole, up to ``passes`` times. A null
    text has no words and is never taken; a null source is a source; an empty table gives no rows.
    Rows with equal id, source and size follow one another and are decided each, in the order of
    the columns ``numbers``, which are kept, or in any order; other columns are ignored.
    """
    base = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed))).alias("place"), *numbers), "mix-sizes")
    aimed = stage(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes), "mix-targets")
    ranked = base.join(aimed, base["source"].eqNullSafe(aimed["source"])).select(
        "doc_id", base["source"], "size", "place", *numbers, "rank", "source_size", "target")
    queued = stage(running_sums(ranked, ["place", "doc_id", "size", *numbers], ["size"], ["rank"]), "mix-queue")
    rated = queued.where("size > 0 and target > 0")
    copies = rated.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    key = ["finish", "rank", "pass", "place", "doc_id"]
    # By time 1 and the longest document, every source has given its target: later copies never count.
    last = F.broadcast(rated.agg((1.000001 + F.max(F.col("size") / F.col("target"))).alias("_last")))  # one row
    copies = copies.withColumn("finish", _finish(F.col("pass"))).crossJoin(last).where("finish <= _last").select(*key, "size")
    total = F.broadcast(aimed.agg(F.sum("source_size").alias("_all")))  # one row
    kept = running_sums(copies, [*key, "size"], ["size"]).crossJoin(total).where("size_upto <= _all")
    cut = kept.agg(F.max(F.struct(*key)).alias("_cut"))
    at = lambda p: F.struct(_finish(F.lit(p)).alias("finish"), "rank", F.lit(p).alias("pass"), "place", "doc_id")
    times = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (at(p) <= F.col("_cut")), 1).otherwise(0)
                 for p in range(passes)), F.lit(0))
    return queued.crossJoin(F.broadcast(cut)).select(  # one row
        "doc_id", *(["source"] if keep_source else []), *numbers, "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))



def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents themselves: every row as often as ``mix`` takes it, with all its columns.

    The rows are written once, each as one struct with a number by which it is met again, so repeated
    rows and rows without an id are decided and counted each, and columns may have any names. Of rows equal in id, source and size those
    with the lower hash of the text come first.
    """
    numbered = stage(docs.select(F.struct("*").alias("held"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    held = F.col("held")
    marked = numbered.select("row", held[id_col].alias("doc_id"), held[text_col].alias("text"), held[source_col].alias("source"), F.xxhash64(held[text_col]).alias("mark"))
    taken = mix(marked, numbers=["mark", "row"], **options).where("taken > 0").select("row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return numbered.join(taken, "row").select("held", F.explode(F.sequence(F.lit(1), F.col("times")))).select("held.*")
