"""Document fingerprints by one-permutation MinHash with optimal densification, in column expressions."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins, words in a shingle, and low bits that the fingerprint keeps of each bin.
BINS, SHINGLE, BITS = 128, 5, 8
#: Random bins that an empty bin asks, in portions of which each is only tried where those before found no filled bin.
PROBES = (24, 128, 1024, 8192)
_SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words; a shorter text is one shingle, an empty one has none."""
    words = F.transform(F.filter(F.split(text, _SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(words, lambda w: F.when(
        F.size(w) >= SHINGLE,
        F.transform(F.slice(w, 1, F.size(w) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)])),
    ).otherwise(F.filter(F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))), lambda x: F.size(w) > 0)))


def _bin(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 57).cast("int")


def sketch(text: Column) -> Column:
    """BINS low-order values: the least hash of each bin, empty bins filled from others.

    A hash falls into the bin of its seven highest bits, so after one sort the first hash of each
    bin is its minimum. An empty bin takes the value of the first filled bin among those that a
    hash of its number picks, the same for every document. A text without words has zeros.
    """
    least = let(F.sort_array(shingle_hashes(text)), lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    placed = let(let(least, lambda v: F.map_from_arrays(F.transform(v, _bin), v)),
                 lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.try_element_at(m, j)))
    mask = F.lit(BINS - 1).cast("long")

    def first(values: Column) -> Column:
        return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))

    def probed(b: Column, j: Column) -> Column:
        upto = [0, *itertools.accumulate(PROBES)]
        return F.coalesce(*[first(F.transform(F.sequence(F.lit(low + 1), F.lit(high)), lambda t: F.get(b, F.xxhash64(j, t).bitwiseAND(mask).cast("int"))))
                            for low, high in zip(upto, upto[1:])])

    # With no filled bin there is nothing to find, with one only its value; with two, 9,368 probes miss both once in 10**63 times.
    filled = let(placed, lambda b: let(F.filter(b, lambda x: x.isNotNull()), lambda some: F.when(
        F.size(some) < 2, F.transform(b, lambda _: F.get(some, F.lit(0)))).otherwise(F.transform(b, lambda v, j: F.coalesce(v, probed(b, j))))))
    return F.transform(filled, lambda v: F.coalesce(v.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")), F.lit(0)).cast("short"))


def packed(values: Column) -> Column:
    """The sketch as lowercase hex, two digits a bin."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins less those that agree by chance, from 0 to 1."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / BINS
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the row that follows in descending doc_id (after the last: the first).

    Rows are dealt to ranges of ids whose borders are estimated quantiles; the first row of each
    range is also sent to the range above it, where it follows that range's last row. So texts are
    shuffled once and no task sees more than one range. Rows that share an id follow by text.
    """
    spark = rows.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    borders = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    border = F.array(*[F.lit(x).cast("long") for x in sorted(set(borders))]) if borders else F.array().cast("array<long>")
    bucket = F.size(F.filter(border, lambda x: x < F.col("doc_id")))
    tops = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()  # one for each range
    above = [(low["top"], high["bucket"]) for low, high in zip(tops, [*tops[1:], *tops[:1]])]
    schema = "top long, above int"
    lent = F.broadcast(spark.createDataFrame(above, schema))
    dealt = rows.withColumn("bucket", bucket).join(lent, F.col("doc_id") == F.col("top"), "left").select(
        *rows.columns, F.explode(F.filter(F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lent")),
            F.struct(F.col("above").alias("bucket"), F.lit(True).alias("lent"))), lambda x: x["bucket"].isNotNull())).alias("at"))
    order = W.partitionBy("at.bucket").orderBy("at.lent", F.desc("doc_id"), "text")
    return dealt.select(*rows.columns, "at", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not at.lent").drop("at")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document.

    The edited text has its last half (of the code points, rounded down) replaced by the beginning
    of the next document in descending id. A null text is empty; two empty texts are alike (1), an
    empty and a filled one are not (0). A row with a null id has itself as next. Equal texts have
    equal fingerprints; repeated rows are treated each; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    met = with_next(rows.where("doc_id is not null"), ["text", "sketch"])
    alone = rows.where("doc_id is null").select("*", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.char_length("text") - half), F.col("next_text").substr(F.lit(1), half))
    both = met.union(alone).select("doc_id", "text", "sketch", "next_sketch", edited.alias("edited"))
    seen = let(sketch(F.col("edited")), lambda e: F.struct(packed(e).alias("print"), likeness(F.col("sketch"), e).alias("near")))
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"), seen.alias("seen"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("seen.print").alias("edited_fingerprint"),
             F.col("seen.near").alias("near_edited"), "near_next")
