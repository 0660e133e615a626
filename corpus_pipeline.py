"""The training-data pipeline over ``documents``: stages, each written as Parquet and read by the next.

Every stage handles null texts, ids and sources, repeated rows and empty tables as its operator
says; columns beyond those of ``documents`` are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.mixing import mix_rows
from lexloom.llm.neardup import keep_one
from lexloom.llm.packing import pack_documents
from lexloom.llm.quality import fit, keep_good
from lexloom.llm.recompress import remove_repeats
from lexloom.runtime import stage


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose passages score as good ones do; the model learns from ``labels``."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates (five words, similarity 0.8) stays."""
    return keep_one(docs, words_per_shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are removed; a document may end up empty, but stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, with_text=True, others=others)
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns}
    if "n_chars" in own:
        changed = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("others.n_chars"))
        own["n_chars"] = changed.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*own.values())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix to target weights takes it."""
    return mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer cannot be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
