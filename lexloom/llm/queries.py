"""The operations as registered queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rules of the URL filter (host, path, verdict).
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
             ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict; a page counts as good if the document that its path numbers has quality 1."""
    from lexloom.llm.urls import filter_urls, path_of
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(F.col("url")), "^/[^/]+/([0-9]{1,18})", 1).try_cast("bigint").alias("doc_id")
    labels = pages.select("page_id", number).where("doc_id is not null").join(
        table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")
    return filter_urls(pages, labels, rules=URL_RULES)


def op2_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.sharding import shard_by_bytes
    return shard_by_bytes(table(spark, folder, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.pivots import search_top
    return search_top(table(spark, folder, "embeddings"))


def op4_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.mixing import mix
    return mix(table(spark, folder, "documents"))


def op5_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.quality import fit, score_documents
    docs = table(spark, folder, "documents")
    return score_documents(docs, fit(docs, table(spark, folder, "labels")))


def op6_recompressed_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.recompress import remove_repeats
    return remove_repeats(table(spark, folder, "documents"))


def op7_bbit_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.neardup import near_duplicates
    return near_duplicates(table(spark, folder, "documents"), words_per_shingle=3, percent=85)


def op8_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from lexloom.llm.packing import pack_documents
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_one_permutation_prints(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.fingerprints import fingerprint_documents
    return fingerprint_documents(table(spark, folder, "documents"))


def op10_centroid_language(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.langid import fit, identify
    docs = table(spark, folder, "documents")
    return identify(docs, fit(docs))


def op11_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.dualtree import search_lexical
    return search_lexical(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op12_winnowed_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the spans and items that ``contaminated_spans`` finds."""
    from lexloom.llm.decontaminate import contaminated_spans
    found = contaminated_spans(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op13_batch_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.llm.resample import resample
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=5).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_url_reputation, op2_byte_shards, op3_pivot_search, op4_fair_mix, op5_attention_quality, op6_recompressed_repeats, op7_bbit_near_duplicates,
    op8_bin_slack_packing, op9_one_permutation_prints, op10_centroid_language, op11_dual_tree_search, op12_winnowed_decontamination, op13_batch_resampling)}
