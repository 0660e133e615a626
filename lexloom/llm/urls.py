"""URL filter by shrunken host reputation, with explicit rules above it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered; every other suffix is the last label.
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "co.nz", "com.br", "co.za")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> Column:
    """Public suffix of a host; hosts without a dot and numeric addresses are their own suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last_two = F.substring_index(name, ".", -2)
    return F.when(~name.contains(".") | name.rlike("^[0-9.]+$"), name).when(
        last_two.isin(*wide), last_two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.when(~name.contains(".") | name.rlike("^[0-9.]+$"), name).when(
        F.substring_index(name, ".", -2).isin(*wide), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (host, path, verdict) that fits, as struct(rule, verdict); null if none does.

    The rules are a list a person keeps, held in the plan; equally long ones go by their text.
    """
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def _strength(children: DataFrame, level: str) -> DataFrame:
    """One row: how many observations the parent's mean is worth as a prior of its children.

    Moment estimate of the beta-binomial: the children's spread beyond binomial noise, pooled over
    all parents. ``children`` has n, k and the parent's mean p.
    """
    n, k, p = F.col("n"), F.col("k"), F.col("p")
    noise = p * (1 - p)
    beyond = F.sum((k - n * p) * (k - n * p) - n * noise)
    pairs = F.sum(n * (n - 1) * noise)
    share = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(F.try_divide(beyond, pairs), F.lit(0.001))))
    return children.agg((1 / share - 1).alias(f"m_{level}"))


def reputations(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior mean and lower bound of the share of good pages, for every row of ``hosts``.

    ``outcomes`` has host and good (0 or 1), one row per labelled page; ``hosts`` has distinct
    host values. Beta-binomial priors run from all pages to suffix, registered domain and host;
    how much each level counts is estimated from the spread of the level below it. An unlabelled
    host gets its domain's mean with the domain's prior weight. Nulls in ``good`` are unlabelled.
    """
    seen = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    host = stage(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")).join(
        seen, "host", "left").fillna(0, ["n", "k"]), "url-hosts")
    domain = stage(host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-domains")
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = domain.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p"))
    shrunk = lambda m: ((F.col("k") + F.col(m) * F.col("p")) / (F.col("n") + F.col(m)))

    # Every level is written once: its rows give the strength of their prior and then their own means.
    suffix = stage(suffix.crossJoin(F.broadcast(whole)), "url-suffixes")  # one row on the right, as with every strength below
    suffix = suffix.crossJoin(F.broadcast(_strength(suffix, "suffix"))).select("suffix", shrunk("m_suffix").alias("p"))
    domain = stage(domain.join(suffix, "suffix"), "url-domain-priors")
    domain = domain.crossJoin(F.broadcast(_strength(domain, "domain"))).select("domain", "suffix", shrunk("m_domain").alias("p"))
    host = stage(host.join(domain, ["domain", "suffix"]), "url-host-priors")
    a, b = F.col("k") + F.col("m_host") * F.col("p"), F.col("n") - F.col("k") + F.col("m_host") * (1 - F.col("p"))
    return host.crossJoin(F.broadcast(_strength(host, "host"))).select(
        "host", "domain", "suffix", "n", "k", (a / (a + b)).alias("mean"),
        (a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"))


def filter_urls(urls: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str, str]] = (), least: float = 0.75, z: float = 1.645) -> DataFrame:
    """One verdict per row of ``urls``: the longest fitting rule's, else by the host's lower bound.

    ``labels`` has ``id_col`` and good (0 or 1, null: unlabelled); repeated labels of a page count
    once each, repeated urls are judged each. A null url, or one without ``://``, has the empty
    host and path, and that host's reputation. No labels at all: every host has the prior 1/2.
    Other columns of the input are neither read nor returned; an empty table gives no rows.
    The verdicts are computed per host and joined back; adaptive execution splits a hot host.
    """
    rows = urls.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    outcomes = rows.select("page_id", "host").join(labels.select(F.col(id_col).alias("page_id"), "good"), "page_id")
    known = reputations(outcomes, rows.select("host").distinct(), z).select(
        "host", "domain", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))
    judged = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).join(known, "host")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", F.when(F.col("bound") >= least, "allow").otherwise("block")).alias("verdict"),
                         "domain", "mean", "bound")
