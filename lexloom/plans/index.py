"""Positional full-text index as ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import words
from lexloom.runtime import small

# Positions of the i-th field start at i * FIELD_GAP, so a phrase never crosses two fields.
FIELD_GAP = 1 << 24
# Term of the one row per document that restricted postings carry for its length.
DOCUMENT_MARK = ""
# Atoms of queries that every task can hold.
BATCH = 100_000


def _offered(docs: DataFrame, id_col: str, fields: list[str], collection: str | None,
             runs: dict[int, list[int]]) -> DataFrame:
    """``collection, doc_id, doc_len, _pairs``: every run of words of a document that may have been asked for
    (see :func:`query_postings`) with its place, and the empty term at place -1."""
    split = docs.select(
        (F.lit(collection) if collection else F.col("collection")).alias("collection"), F.col(id_col).alias("doc_id"),
        *[words(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_w{i}") for i, f in enumerate(fields)])
    length = sum((F.size(f"_w{i}") for i in range(len(fields))), F.lit(0)).alias("doc_len")
    mark = F.array(F.struct(F.lit(DOCUMENT_MARK).alias("term"), F.lit(-1).alias("pos")))
    parts = [_runs(f"_w{i}", i * FIELD_GAP, n, letters) for i in range(len(fields)) for n, letters in sorted(runs.items())]
    return split.select("collection", "doc_id", length, F.concat(mark, *[p for run in parts for p in run]).alias("_pairs"))


def _runs(col: str, base: int, n: int, letters: list[int]) -> list[Column]:
    """All runs of ``n`` words of a field; by 0 letters whole, by more with that beginning of their last word."""
    at = F.when(F.size(col) >= n, F.sequence(F.lit(0), F.size(col) - n)).otherwise(F.array().cast("array<int>"))

    def cut(t: Column, k: int) -> Column:
        return F.when(F.length(t) >= k, F.concat(F.substring(t, 1, k), F.lit("*"))) if k else t

    def run(k: int) -> Column:
        if n == 1:  # a word too short for the beginning stays null and meets nothing
            return F.transform(F.col(col), lambda t, i: F.struct(cut(t, k).alias("term"), (i + base).alias("pos")))
        word = lambda i, j: F.get(F.col(col), i + j)
        return F.transform(at, lambda i: F.struct(F.concat(*[
            x for j in range(n - 1) for x in (word(i, j), F.lit(" "))], cut(word(i, n - 1), k)).alias("term"), (i + base).alias("pos")))

    return [run(k) for k in sorted(set(letters))]


def _offset_tokens(col: str, base: int):
    return F.transform(F.col(col), lambda t, i: F.struct(t.alias("term"), (i + base).alias("pos")))


def _word_runs(split: DataFrame) -> DataFrame:
    """Postings of each document computed inside its own row.

    The (word, position) pairs of a document are sorted, the places where a new word begins are
    listed, and each run becomes one posting. Nothing is grouped across rows, so building an
    index needs no shuffle. Pairs without a word come first and are dropped as one run.
    """
    pairs = split.withColumn("_sorted", F.sort_array("_pairs")).withColumn("_starts", F.filter(
        F.transform("_sorted", lambda _, i: i),
        lambda at: (at == 0) | ~F.get("_sorted", at)["term"].eqNullSafe(F.get("_sorted", at - 1)["term"])))

    def run(at, i):
        end = F.coalesce(F.get("_starts", i + 1), F.size("_sorted"))
        positions = F.transform(F.slice("_sorted", at + 1, end - at), lambda p: p["pos"])
        return F.struct(F.get("_sorted", at)["term"].alias("term"), (end - at).cast("int").alias("tf"),
                        positions.alias("positions"))

    rows = pairs.select(
        "collection", "doc_id", "doc_len", F.inline_outer(F.transform("_starts", run)))
    return rows.where(F.col("term").isNotNull()).select("collection", "term", "doc_id", "tf", "doc_len", "positions")


def postings(docs: DataFrame, id_col: str, fields: list[str], collection: str | None = None) -> DataFrame:
    """``collection, term, doc_id, tf, doc_len, positions`` — one row per word of a document."""
    split = docs.select(
        (F.lit(collection) if collection else F.col("collection")).alias("collection"), F.col(id_col).alias("doc_id"),
        *[words(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_w{i}") for i, f in enumerate(fields)])
    parts = [_offset_tokens(f"_w{i}", i * FIELD_GAP) for i in range(len(fields))]
    pairs = parts[0] if len(parts) == 1 else F.concat(*parts)
    return _word_runs(split.select("collection", "doc_id", F.size(pairs).alias("doc_len"), pairs.alias("_pairs")))


def query_postings(docs: DataFrame, id_col: str, fields: list[str], keys: DataFrame, runs: dict[int, list[int]],
                   collection: str | None = None, most: int = BATCH) -> DataFrame:
    """Postings of just the asked runs of words (column ``term`` of ``keys``), for searching without an index.

    A run is its words with a space between them; with a star at its end it stands for every run
    that begins so, and these count together. ``runs`` tells how many words the asked runs have
    and how many letters of the last word are given (0: all), so a document offers only such runs
    and meets the asked ones by equality. They are counted inside its own row, so no task collects
    the words of its documents; up to ``most`` asked runs go to the documents, whose words then are not exchanged. One extra row per document under the empty term carries its length.
    Rows that share an id have postings each; see :func:`joined_postings`.
    """
    mark = keys.sparkSession.range(1).select(F.lit(DOCUMENT_MARK).alias("term"))
    kept = keys.select("term").unionByName(mark).distinct()
    return _word_runs(_offered(docs, id_col, fields, collection, runs)).join(small(kept, most), "term", "left_semi").select(
        "collection", "term", "doc_id", "tf", "doc_len", "positions")


def joined_postings(posts: DataFrame, parts: int) -> DataFrame:
    """Rows that share an id are one document: a place counts once. The postings are dealt to ``parts`` tasks."""
    key = ["collection", "term", "doc_id"]
    found = posts.repartition(parts, *key).groupBy(*key).agg(
        F.first("doc_len").alias("doc_len"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found.select(*key, F.size("positions").alias("tf"), "doc_len", F.sort_array("positions").alias("positions"))


def doc_stats(docs: DataFrame, id_col: str, fields: list[str], collection: str | None = None) -> DataFrame:
    """``collection, n_docs, avg_len`` over all documents that have at least one word."""
    length = sum((F.size(words(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields), F.lit(0))
    return docs.select((F.lit(collection) if collection else F.col("collection")).alias("collection"),
                       length.alias("doc_len")).groupBy("collection").agg(
        F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def term_stats(posts: DataFrame) -> DataFrame:
    """``collection, term, df, cf`` — documents and occurrences per word."""
    return posts.groupBy("collection", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(posts: DataFrame) -> DataFrame:
    """``collection, n_docs, avg_len`` out of complete postings.

    Each word of a document stands for ``tf / doc_len`` of it, so these shares add up to the
    number of documents that have any word; no distinct count is needed.
    """
    n_docs = F.round(F.sum(F.col("tf") / F.col("doc_len"))).cast("long")
    return posts.groupBy("collection").agg(n_docs.alias("n_docs"), (F.sum("tf") / n_docs).alias("avg_len"))


def marked_stats(posts: DataFrame) -> DataFrame:
    """The same out of restricted postings, which carry one marked row per document."""
    return posts.where(F.col("term") == DOCUMENT_MARK).groupBy("collection").agg(
        F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def write_postings(posts: DataFrame, table: str, buckets: int = 200) -> None:
    """Persist postings bucketed and sorted by term.

    The rows are rebalanced by bucket before the write: adaptive execution cuts a bucket that a very
    common word fills into tasks of the advisory size and joins small buckets to one task, so the
    number of files follows the data: at most one for each bucket and cut.
    """
    dealt = posts.withColumn("_bucket", F.pmod(F.hash("term"), F.lit(buckets))).hint("rebalance", F.col("_bucket"))
    dealt.drop("_bucket").write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def read_postings(spark: SparkSession, table: str, terms: DataFrame | None = None) -> DataFrame:
    """Postings of the given terms, met by the term that the stored table is laid out by."""
    posts = spark.table(table)
    return posts if terms is None else posts.join(terms.select("term").distinct(), "term", "left_semi")


def reindex(posts: DataFrame, docs: DataFrame, changed: DataFrame, id_col: str, fields: list[str],
            collection: str) -> DataFrame:
    """Postings after some documents changed or vanished: theirs are dropped and rebuilt from content.

    ``changed`` holds the ids (column ``id_col``) to refresh; ``docs`` is the content after the change.
    """
    ids = changed.select(F.col(id_col)).distinct()
    kept = posts.join(ids.withColumnRenamed(id_col, "doc_id"), "doc_id", "left_anti")
    fresh = postings(docs.join(ids, id_col, "left_semi"), id_col, fields, collection)
    return kept.unionByName(fresh.select(*posts.columns))
