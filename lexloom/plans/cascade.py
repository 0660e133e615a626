"""Resolution of case-law references against landed decisions, from exact ids to court and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import dims
from lexloom.functions.identifiers import case_to_celex, rg_digits
from lexloom.functions.references import is_reference, parse_references
from lexloom.functions.text import fold
from lexloom.operators.joins import probe_conflicts, probe_ids
from lexloom.operators.windows import keep_best
from lexloom.plans.search import match_docs
from lexloom.runtime import map_lookup, stage

_STRING_LIST = "array<string>"
# Kinds of numbers that, with a day, make up the id of a decision.
DOCKETS = ["dossier", "caa_ce"]


def _list_lookup(mapping: dict[str, list[str]], key: Column) -> Column:
    literal = F.create_map(*[x for k, values in mapping.items() for x in (
        F.lit(k), F.array(*[F.lit(v) for v in values]))])
    return F.coalesce(F.try_element_at(literal, key), F.array().cast(_STRING_LIST))


def numbers_of(parsed: DataFrame) -> DataFrame:
    """One row per number of a reference, in the order found, with the sources that may hold it."""
    rows = parsed.select("ref_id", "juri_type", "juri_ville", "ref_date",
                         F.posexplode("numeros").alias("num_no", "_n")).select("*", "_n.kind", "_n.value").drop("_n")
    routed = _list_lookup(dims.NUMBER_ROUTES, F.col("kind"))
    narrowed = F.array_intersect(routed, _list_lookup(dims.COURT_SOURCES, F.col("juri_type")))
    rows = rows.withColumn("sources", F.when(F.size(narrowed) > 0, narrowed).otherwise(routed))
    # What the look-ups of a number depend on: references that agree in it ask once. Only dockets need the day.
    day = F.when(F.col("kind").isin(DOCKETS), F.col("ref_date")).alias("ref_date")
    return rows.withColumn("ask", F.struct("kind", "value", "sources", "juri_type", day))


def number_keys(*cols: Column | str) -> Column:
    """Punctuation-free tokens with a digit: what a row can be found by."""
    blob = F.lower(F.concat_ws(" ", *cols))
    tokens = F.concat(F.split(blob, r"[\s,;:()|]+"), F.split(blob, r"[\s,;:()|_]+"))
    keys = F.transform(tokens, lambda t: F.regexp_replace(t, r"[.\-/°]", ""))
    keys = F.transform(keys, lambda t: F.regexp_replace(t, r"^no?(?=\d)", ""))
    return F.array_distinct(F.filter(keys, lambda t: t.rlike(r"\d") & (F.length(t) >= 3)))


def carries_number(value: Column, *cols: Column | str) -> Column:
    """Whether the number occurs in the fields once punctuation is ignored."""
    strip = lambda c: F.translate(F.lower(c), ".-/ ", "")
    return strip(F.concat_ws(" ", *cols)).contains(strip(value))


def _signature(court: Column) -> Column:
    return map_lookup(dims.COURT_SIGNATURES, court, F.lit(""))


def _by_number(numbers: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits of the number stages for each different ``ask``, with their place in the order of attempts."""
    keyed = numbers.select("ask").distinct().select(F.col("ask").alias("ref_key"), "ask.*")

    def attempt(hits: DataFrame, step: int) -> DataFrame:
        return hits.select(F.col("ref_key").alias("ask"), F.lit(step).alias("step"), *rows.columns)

    admin = rows.where("source = 'admin'")
    dockets = keyed.where(F.col("kind").isin(DOCKETS) & F.array_contains("sources", "admin"))
    probes = probe_ids(dockets.withColumn("ref_id", F.col("ref_key")), admin).withColumnRenamed("ref_id", "ref_key")
    conflicts = probe_conflicts(keyed.where("kind = 'tdc'").withColumn("ref_id", F.col("ref_key")), admin
                                ).withColumnRenamed("ref_id", "ref_key")
    cases = keyed.where("kind = 'cjue'").select("ref_key", case_to_celex("value").alias("id")).join(
        rows.where("source = 'cjue'"), "id")

    rolls = keyed.where((F.col("kind") == "rg") & F.array_contains("sources", "dila")).select(
        "ref_key", rg_digits("value").alias("_roll"), _signature(F.col("juri_type")).alias("_sig"))
    roll_hits = rolls.join(rows.where("source = 'dila'").withColumn("_roll", rg_digits("numero")), "_roll")
    typed = (F.col("_sig") == "") | fold("juridiction").contains(F.col("_sig"))
    any_typed = roll_hits.where(typed).select("ref_key").distinct().withColumn("_any", F.lit(True))
    roll_hits = roll_hits.withColumn("_typed", typed).join(any_typed, "ref_key", "left").where(
        F.col("_typed") | F.col("_any").isNull())

    carried = ["numero", "id", "ecli", "title", "extract"]
    offered = rows.select("*", F.explode(number_keys(*carried)).alias("_key"))
    wanted = keyed.select("ref_key", "value", "sources", F.translate(F.lower("value"), ".-/ ", "").alias("_key"))
    carriers = wanted.join(offered, "_key").where(
        F.array_contains("sources", F.col("source")) & carries_number(F.col("value"), *carried))
    return reduce(DataFrame.unionByName, [attempt(h, i) for i, h in enumerate(
        [probes, conflicts, cases, roll_hits, carriers], start=1)])


def _by_party(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """References without any number: names looked up in titles, on the day given or else on any day."""
    names = F.filter(F.split(fold("ref_text"), r"\s+"), lambda t: (F.length(t) > 3) & ~t.isin(dims.PARTY_NOISE))
    named = parsed.where((F.size("numeros") == 0) & (F.length("ref_text") > 3)).select(
        "ref_id", "ref_text", "ref_date", names.alias("_names"),
        _list_lookup(dims.COURT_SOURCES, F.col("juri_type")).alias("_sources"))
    found = match_docs(named.select(F.col("ref_id").alias("query_id"), F.col("ref_text").alias("query")),
                       rows.withColumn("doc_key", F.concat_ws("\u0001", "source", "id")), "doc_key",
                       ["title", "juridiction", "extract", "numero"], "rows")
    hits = found.select(F.col("query_id").alias("ref_id"), F.split("doc_id", "\u0001").alias("_k")).select(
        "ref_id", F.get("_k", F.lit(0)).alias("source"), F.get("_k", F.lit(1)).alias("id")).join(
        rows, ["source", "id"]).join(named, "ref_id")
    blob = fold(F.concat_ws(" ", "title", "juridiction", "extract", "numero"))
    has_name = F.exists("_names", lambda t: blob.contains(t))
    routed = (F.size("_sources") == 0) | F.array_contains("_sources", F.col("source"))
    same_day = F.coalesce(F.col("date") == F.col("ref_date"), F.lit(False))
    hits = hits.where(routed & (F.col("ref_date").isNull() | has_name)).withColumn(
        "step", F.when(F.col("ref_date").isNull() | same_day, 6).otherwise(7))
    return hits.select("ref_id", F.lit(0).alias("num_no"), "step", *rows.columns)


def _court_types(rows: DataFrame) -> Column:
    """Court types a row can stand for: right source and the signature in its court name."""
    court = fold(F.coalesce("juridiction", F.lit("")))
    return F.filter(F.array(*[
        F.when(F.col("source").isin(sources) & court.contains(dims.COURT_SIGNATURES[kind]), kind)
        for kind, sources in dims.COURT_SOURCES.items()]), lambda k: k.isNotNull())


def _by_day(parsed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Court and day: same date, right kind of court, right city; ``ref_id, ask`` and the rows of each different ``ask``.

    Equal questions are asked once, and rows meet them by date and kind of court; only the city
    is compared as text. All decisions of that court and day go on to the ranking by name.
    """
    asked = parsed.where((F.col("juri_type") != "") & F.col("ref_date").isNotNull()).select(
        "ref_id", F.struct(F.col("ref_date").alias("date"), "juri_type", fold("juri_ville").alias("_city")).alias("ask"))
    questions = asked.select("ask").distinct().select("ask", "ask.*")
    typed = rows.where(F.col("date").isNotNull()).select("*", F.explode(_court_types(rows)).alias("juri_type"))
    hits = questions.join(typed, ["date", "juri_type"]).where(fold("juridiction").contains(F.col("_city")))
    return asked, hits.select("ask", F.lit(8).alias("step"), *rows.columns)


def _traits(parsed: DataFrame) -> DataFrame:
    """What the order of homonyms takes from a reference."""
    return parsed.select("ref_id", fold("juri_ville").alias("_city"), "ref_date",
                         F.filter(F.split(fold("ref_text"), r"\s+"), lambda t: F.length(t) > 3).alias("_words"))


def _score_without_day() -> Column:
    named = fold(F.concat_ws(" ", "juridiction", "title"))
    return (
        F.coalesce("relevance", F.lit(0.0)) / 100
        + F.when((F.col("_city") != "") & named.contains(F.col("_city")), 10.0).otherwise(0.0)
        + F.size(F.filter("_words", lambda t: named.contains(t))) * 1.5
    )


def _candidates(asked: DataFrame, hits: DataFrame, parsed: DataFrame, limit: int) -> DataFrame:
    """``ref_id``, step and row: the hits of its questions that can be among the first ``limit`` of a reference.

    A popular number or day is asked by many references and held by many rows. Apart from its day
    a reference's score depends on its question, city and names only, and the day adds the same to
    all rows of that day, or else of that year. So the first rows of each question, of all days, of
    each year and of each day, hold the first ones of every reference that asks it.
    """
    spans = lambda day: F.explode(F.array_compact(F.array(F.lit(""), F.year(day).cast("string"), F.col(day).cast("date").cast("string"))))
    refs = asked.join(_traits(parsed), "ref_id").distinct()
    key = ["ask", "_city", "_words"]
    rows = hits.columns
    scored = refs.select(*key).distinct().join(hits, "ask").withColumn("_base", _score_without_day()).withColumn("_span", spans("date"))
    once = keep_best(scored, [*key, "_span", "id"], F.desc("_base"), F.col("source"))
    first = keep_best(once, [*key, "_span"], F.desc("_base"), F.col("id"), k=limit)
    return refs.withColumn("_span", spans("ref_date")).join(first, [*key, "_span"]).select("ref_id", *[c for c in rows if c != "ask"])


def rescore(hits: DataFrame, parsed: DataFrame, limit: int) -> DataFrame:
    """Order homonyms: relevance/100, +10 city, +8 same day (+2 same year), +1.5 per name word."""
    refs = _traits(parsed)
    score = _score_without_day() + F.when(F.col("date") == F.col("ref_date"), 8.0).when(
        F.year("date") == F.year("ref_date"), 2.0).otherwise(0.0)
    scored = hits.join(refs, "ref_id").withColumn("score", score).drop("_city", "ref_date", "_words")
    once = keep_best(scored, ["ref_id", "id"], F.desc("score"), F.col("source"))
    return keep_best(once, ["ref_id"], F.desc("score"), F.col("id"), k=limit, rank_col="rank")


def resolve_references(refs: DataFrame, rows: DataFrame, limit: int = 20) -> DataFrame:
    """Resolve ``ref_id, query`` against common result rows of all sources.

    Per reference the first attempt that finds anything decides: exact ids, conflict-tribunal
    numbers, EU cases, roll numbers, rows carrying the number (number by number), then party
    names, then court and day. A reference found nowhere stays as one row with a note; a text
    that is no reference yields nothing.
    """
    cited = stage(parse_references(refs, "query"), "references").where(is_reference())
    exact = rows.withColumn("relevance", F.lit(100.0))

    numbers = stage(numbers_of(cited), "numbers")
    tried = stage(_by_number(numbers, exact), "number-hits")
    steps = tried.groupBy("ask").agg(F.min("step").alias("step"))
    found = numbers.select("ref_id", "num_no", "ask").join(steps, "ask")
    first = stage(found.groupBy("ref_id").agg(F.min(F.struct("num_no", "step")).alias("_f")).select("ref_id", "_f.*"), "first-numbers")
    deciding = found.join(first, ["ref_id", "num_no", "step"], "left_semi").select("ref_id", "ask").distinct()
    by_number = _candidates(deciding, tried.join(steps, ["ask", "step"], "left_semi"), cited, limit)

    left = cited.join(first.select("ref_id"), "ref_id", "left_anti")
    parties = stage(_by_party(left, rows.withColumn("relevance", F.lit(None).cast("double"))), "party-hits")
    best_party = parties.groupBy("ref_id").agg(F.min("step").alias("step"))
    by_party = parties.join(best_party, ["ref_id", "step"], "left_semi").drop("num_no")

    left = left.join(best_party.select("ref_id"), "ref_id", "left_anti")
    by_day = _candidates(*_by_day(left, exact), left, limit)
    hits = rescore(reduce(DataFrame.unionByName, [by_number, by_party, by_day]), cited, limit)

    listed = F.transform("numeros", lambda n: F.concat(F.lit("n° "), n["value"]))
    dated = F.when(F.col("ref_date").isNotNull(), F.array(F.concat(F.lit("du "), F.col("ref_date").cast("string")))
                   ).otherwise(F.array().cast(_STRING_LIST))
    note = F.concat(F.lit("Référence détectée ("), F.array_join(F.concat(listed, dated), ", "),
                    F.lit(") mais introuvable dans nos fonds. La décision n'est peut-être pas (encore) dans les données ouvertes."))
    noted = cited.select("ref_id", note.alias("_note"))
    return noted.join(hits, "ref_id", "left").withColumn(
        "note", F.when(F.col("id").isNull(), F.col("_note"))).drop("_note")
