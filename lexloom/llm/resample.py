"""Importance resampling towards a target collection, by hashed runs of one to three words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.prefix import running_sums
from lexloom.llm.words import portions
from lexloom.runtime import stage

BUCKETS = 10_000
_WORDS = re.compile(rb"([0-9a-z\x80-\xff]+)")
_SENTINEL = b"\n"
#: Bytes that one table step passes over; longer words take several steps.
_STRIDE = 64


@cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 table of one byte, and what 0.._STRIDE zero bytes make of each byte of a checksum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    steps = np.empty((_STRIDE + 1, 4, 256), np.uint32)
    steps[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(_STRIDE):
        steps[n + 1] = one[steps[n] & np.uint32(255)] ^ (steps[n] >> np.uint32(8))
    return one, steps


def _spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums after one more space."""
    one, _ = _crc_tables()
    state = ~crc
    return ~(one[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def _joined(before: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of what has checksum ``before`` followed by ``length`` bytes of checksum ``crc``: CRC-32 is linear."""
    _, steps = _crc_tables()
    before, left = before.copy(), length.copy()
    todo = np.arange(len(before))
    while len(todo):
        n, state = np.minimum(left[todo], _STRIDE), before[todo]
        before[todo] = (steps[n, 0, state & np.uint32(255)] ^ steps[n, 1, (state >> np.uint32(8)) & np.uint32(255)]
                        ^ steps[n, 2, (state >> np.uint32(16)) & np.uint32(255)] ^ steps[n, 3, state >> np.uint32(24)])
        left[todo] -= n
        todo = todo[left[todo] > 0]
    return before ^ crc


class Runs(NamedTuple):
    """Buckets of the runs of 1, 2 and 3 words that begin at each word (BUCKETS: the run would leave its text), and words by text."""

    buckets: tuple[np.ndarray, np.ndarray, np.ndarray]
    first: np.ndarray


def word_runs(column: pa.Array) -> Runs:
    """Runs of all texts of a batch, found in one pass over their concatenation.

    The texts are joined with a sentinel that is in no word, one pattern pass cuts the whole into
    words, the words' places among the texts' offsets tell their text, and runs whose ends lie in
    different texts are masked.
    """
    texts = pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
    pieces = _WORDS.split(_SENTINEL.join(texts).lower())
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes)[:-1:2]
    begins = np.concatenate([[0], np.cumsum([len(t) + len(_SENTINEL) for t in texts])])
    owner = np.searchsorted(begins, starts, "right") - 1
    words, length = pieces[1::2], sizes[1::2]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    two = _joined(_spaced(crc[:-1]), crc[1:], length[1:])
    three = _joined(_spaced(two[:-1]), crc[2:], length[2:])
    buckets = []
    for k, names in enumerate((crc, two, three)):
        runs = np.full(len(words), BUCKETS, np.int64)
        runs[: len(names)] = np.where(owner[: len(names)] == owner[k : k + len(names)], names % np.uint32(BUCKETS), BUCKETS)
        buckets.append(runs)
    return Runs(tuple(buckets), np.searchsorted(owner, np.arange(len(texts) + 1)))


def _count(text_col: str) -> Callable:
    """How many features of all texts of the task are in each bucket."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, np.int64)
        for batch in portions(batches, text_col):
            for runs in word_runs(batch.column(text_col)).buckets:
                held += np.bincount(runs, minlength=BUCKETS + 1)
        some = np.flatnonzero(held[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["bucket", "n"])

    return count


def _weigh(text_col: str, gains: np.ndarray) -> Callable:
    """Number of words and features and sum of gains of every text."""
    gains = np.append(gains, 0)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            buckets, first = word_runs(batch.column(text_col))
            upto = np.concatenate([[0], np.cumsum(sum(gains[b] for b in buckets))])
            words = np.diff(first)
            features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            columns = dict(zip(batch.schema.names, batch.columns)) | {
                "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(upto[first[1:]] - upto[first[:-1]])}
            yield pa.RecordBatch.from_arrays([columns[c] for c in ("doc_id", "n_words", "n_features", "weight")], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without any are left out."""
    return texts.select(F.col(text_col).alias("text")).mapInArrow(_count("text"), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket: thousandths of the log ratio of its smoothed shares in target and docs, rounded down."""
    spark = docs.sparkSession
    held = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    held = held.join(docs.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    totals = held.agg(F.sum("s").cast("double").alias("of_docs"), F.sum("t").cast("double").alias("of_target"))
    share = lambda n, total: (F.col(n).cast("double") + 1, F.col(total) + BUCKETS)
    (t, of_target), (s, of_docs) = share("t", "of_target"), share("s", "of_docs")
    return held.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.ln((t * of_docs) / (s * of_target))).cast("long").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score and, if drawn, its rank.

    Drawn are ``percent`` of the documents with at least ``least_words`` words, without replacement
    and with chances that grow with the likeness to the target: the weight, a sum of log ratios,
    plus Gumbel noise from a hash of seed and id, highest first, ties to the smaller id. All
    documents and target texts are counted; nothing is sampled but the draw itself.

    One row for each row of ``docs``. A null or wordless text has no features and weight 0. Rows of one
    id have the same noise; a null id has the noise of an empty one and comes first among equals. Rows
    equal in id, score and counts take their ranks in any order. Without documents or target texts
    all shares are the smoothed ones. Other columns are not read.

    Tasks get the gains of the 10,000 buckets and return at most one count for each of them.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    known = np.zeros(BUCKETS, np.int64)
    for bucket, gain in gains.collect():
        known[bucket] = gain
    weighed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _weigh("text", known), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((place + 0.5) / 4294967296.0))).cast("long")
    scored = stage(weighed.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()}), "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = running_sums(fit.withColumns({"from_top": -F.col("score"), "rank": F.lit(1).cast("long")}), ["from_top", "doc_id", "n_features", "row"], ["rank"])
    ranked = ranked.withColumn("rank", F.when(F.col("rank_upto") <= drawn, F.col("rank_upto")))
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).union(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out))
