"""Counts, profiles and mining aggregates. All are partial-then-final hash aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.summaries import ancestors, explode_classification
from lexloom.functions.text import norm_email
from lexloom.runtime import blank_to_null

# Fixed value: an email address in running text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def stats(df: DataFrame, court_col: str = "juridiction") -> DataFrame:
    """Rows per court and in total (court NULL in the total row)."""
    return (
        df.groupBy(F.coalesce(court_col, F.lit("")).alias(court_col)).agg(F.count("*").alias("n"))
        .groupingSets([[court_col], []], court_col).agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first(court_col))
    )


def count_collections(tables: dict[str, DataFrame], in_force_only: tuple[str, ...] = ("statute_version",)) -> DataFrame:
    """Rows per collection; statutes count only what is in force."""
    def one(name: str, df: DataFrame) -> DataFrame:
        rows = df.where(F.col("etat") == "VIGUEUR") if name in in_force_only else df
        return rows.agg(F.count("*").alias("total")).select(F.lit(name).alias("collection"), "total")
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def coverage(df: DataFrame, type_col: str = "type", mails: str = "mails") -> DataFrame:
    """Per type: entries, entries with an address, rate in percent."""
    with_mail = F.count_if(F.size(mails) > 0)
    return df.groupBy(type_col).agg(F.count("*").alias("total"), with_mail.alias("with_mail")).withColumn(
        "rate", F.round(F.col("with_mail") * 100 / F.col("total"), 1))


def directory_meta(df: DataFrame) -> DataFrame:
    """Counters of a consolidated directory in one pass."""
    filled = lambda c: blank_to_null(c).isNotNull()
    return df.agg(
        F.count("*").alias("entries"),
        F.count_if(F.size("mails") > 0).alias("with_mail"),
        F.count_if(filled("tel")).alias("with_phone"),
        F.count_if(filled("site")).alias("with_site"),
        F.count_if(F.col("source") == "dila").alias("from_dila"),
        F.count_if(F.col("source") == "api").alias("from_api"),
        F.count_if(F.col("source") == "manuel").alias("from_manual"),
        F.count_distinct("type").alias("types"),
        F.coalesce(F.sum(F.size("mails")), F.lit(0)).alias("addresses"),
    )


def classification_labels(blocks: DataFrame, variants: int = 5) -> DataFrame:
    """Per code: its most frequent label and the most frequent variants (count desc, label asc)."""
    counted = blocks.where(F.col("label").isNotNull()).groupBy("code", "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.desc("n"), "label"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= variants)
    listed = F.array_sort(F.collect_list(F.struct("rank", "label", "n")))
    return top.groupBy("code").agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("label"),
        F.transform(listed, lambda v: F.struct(v["label"].alias("label"), v["n"].alias("n"))).alias("variants"))


def cumulative_frequency(leaves: DataFrame, code_col: str = "code", freq_col: str = "freq") -> DataFrame:
    """Own and subtree frequency of every code and every ancestor of a code."""
    own = leaves.groupBy(F.col(code_col).alias("leaf")).agg(F.sum(freq_col).alias("freq"))
    return own.select("freq", "leaf", F.explode(ancestors("leaf")).alias("code")).groupBy("code").agg(
        F.sum("freq").alias("freq_cumulative"),
        F.coalesce(F.sum(F.when(F.col("leaf") == F.col("code"), F.col("freq"))), F.lit(0)).alias("freq_as_leaf"))


def classification_tree(summaries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The classification rebuilt from summaries: label, parent, depth, own and subtree frequency."""
    levels = explode_classification(summaries, id_col, text_col)
    leaves = levels.where(F.col("code") == F.col("leaf_code")).select("code", F.lit(1).alias("freq"))
    labels = classification_labels(levels)
    parent = blank_to_null(F.regexp_extract("code", r"^(.*)-[^-]+$", 1))
    return cumulative_frequency(leaves).join(labels, "code", "left").select(
        "code", F.coalesce("label", F.concat(F.lit("<inconnu "), F.col("code"), F.lit(">"))).alias("label"),
        parent.alias("parent_code"), F.size(F.split("code", "-")).alias("depth"), "freq_as_leaf",
        "freq_cumulative", "variants")


def classification_profile(tree: DataFrame, roots: int = 20) -> tuple[DataFrame, DataFrame]:
    """Codes per depth, and the roots with the largest subtrees."""
    depths = tree.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth")
    largest = tree.where(F.col("depth") == 1).orderBy(F.desc("freq_cumulative"), "code").limit(roots)
    return depths, largest


def email_mentions(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per address found in a text, normalised, with the kept columns.

    Only texts with an `@` are scanned by the pattern.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(EMAIL), F.lit(0))
    return df.where(F.contains(F.col(text_col), F.lit("@"))).select(
        *keep, F.explode_outer(found).alias("_m")).where(F.col("_m").isNotNull()).select(
        *keep, norm_email("_m").alias("mail"))


def mine_emails(df: DataFrame, text_col: str, order_col: str, *meta: str) -> DataFrame:
    """Occurrences of each address and the first row (by ``order_col``) that mentions it."""
    return email_mentions(df, text_col, order_col, *meta).groupBy("mail").agg(
        F.count("*").alias("n"), F.min_by(F.struct(order_col, *meta), order_col).alias("first_seen"))


def email_domains(mails: DataFrame, mail_col: str = "mail", n_col: str = "n") -> DataFrame:
    """Distinct addresses and occurrences per domain."""
    domain = F.substring_index(F.col(mail_col), "@", -1)
    return mails.groupBy(domain.alias("domain")).agg(
        F.count_distinct(mail_col).alias("addresses"), F.sum(n_col).alias("mentions"))


def justice_domains(mails: DataFrame, mail_col: str = "mail") -> DataFrame:
    """Distinct addresses in the two justice domains."""
    inside = lambda d: F.count_distinct(F.when(F.col(mail_col).rlike(rf"@(?:[a-z0-9.-]+\.)?{d}$"), F.col(mail_col)))
    return mails.agg(inside(r"justice\.fr").alias("justice_fr"),
                     inside(r"justice\.gouv\.fr").alias("justice_gouv_fr"))


def per_group_totals(hits: DataFrame, query_col: str, group_col: str) -> DataFrame:
    """Hits per query and court (or source); counted before the shuffle, not over a window."""
    return hits.groupBy(query_col, group_col).agg(F.count("*").alias("total"))


def thesaurus_stats(concepts: DataFrame, labels: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows by source, by scope and by label type, plus the three totals."""
    tagged = (
        concepts.select(F.lit("concepts").alias("kind"), F.col("source"), F.col("scope"),
                        F.lit(None).cast("string").alias("label_type"))
        .unionByName(labels.select(F.lit("labels").alias("kind"), "source", "label_type"), allowMissingColumns=True)
        .unionByName(relations.select(F.lit("relations").alias("kind"), "source"), allowMissingColumns=True)
    )
    return tagged.groupingSets(
        [["kind", "source"], ["kind", "scope"], ["kind", "label_type"], ["kind"]],
        "kind", "source", "scope", "label_type",
    ).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def split_by_volume(df: DataFrame, category_col: str, threshold: int = 100) -> DataFrame:
    """Add ``page``: the category when it holds at least ``threshold`` rows, else `autres`."""
    big = df.groupBy(category_col).agg(F.count("*").alias("category_rows"))
    return df.join(big, category_col, "left").withColumn(
        "page", F.when(F.col("category_rows") >= threshold, F.col(category_col)).otherwise("autres"))


def unlisted_profile(df: DataFrame, org_col: str = "organisme", tel_col: str = "tel", date_col: str = "date_source") -> DataFrame:
    return df.agg(F.count_distinct(org_col).alias("organisations"),
                  F.count_if(blank_to_null(tel_col).isNotNull()).alias("with_phone"),
                  F.count_if(blank_to_null(F.col(date_col).cast("string")).isNotNull()).alias("dated"))


def quality_gates(df: DataFrame, rules: dict[str, tuple[Column, float]]) -> DataFrame:
    """Evaluate all rules in one pass: ``rule, actual, minimum, passed``.

    A rule is an aggregate and the smallest value it may have; a rule on defects is written
    as a negative count with minimum 0.
    """
    measured = df.agg(*[value.cast("double").alias(f"_{i}") for i, (value, _) in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("actual"),
                              F.lit(float(minimum)).alias("minimum"))
                     for i, (name, (_, minimum)) in enumerate(rules.items())])
    return measured.select(F.inline(rows)).withColumn("passed", F.coalesce(F.col("actual") >= F.col("minimum"), F.lit(False)))


def page_counts(collections: DataFrame, total_col: str = "total", size: int = 50_000) -> DataFrame:
    """Pages per collection: ``floor(total / size) + 1``."""
    return collections.withColumn("pages", F.floor(F.col(total_col) / size) + 1)


def n_sources(df: DataFrame, list_col: str, out_col: str = "n_sources") -> DataFrame:
    """Number of sources in a `|`-separated list."""
    return df.withColumn(out_col, F.size(F.filter(F.split(F.coalesce(F.col(list_col), F.lit("")), r"\|"),
                                                  lambda s: F.trim(s) != "")))
