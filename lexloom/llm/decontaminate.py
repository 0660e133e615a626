"""Benchmark passages in documents, found by winnowed fingerprints whose hits are extended word by word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import NO_TERM, Words, mix64, portions, split_words, text_bytes
from lexloom.runtime import stage

#: Every shared run of WINDOW words holds a kept gram of GRAM words: of WINDOW - GRAM + 1 neighbours the least is kept.
WINDOW, GRAM = 10, 7
REACH = WINDOW - GRAM
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Most 64-bit words of the filter that tells tasks which names the items have (2 MB, however many items there are).
FILTER_WORDS = 1 << 18
_OUTSIDE = {"doc": 0, "item": 1}
_PRINT = pa.struct([("name", pa.int64()), ("at", pa.int32()), ("around", pa.list_(pa.int64()))])


def _grams(names: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Names of all runs of n words; ``kind`` keeps grams of different use apart."""
    size = max(0, len(names) - n + 1)
    out = names[:size].copy()
    for k in range(1, n):
        out *= _BASE
        out += names[k : size + k]
    return mix64(out + np.uint64(kind))


def _ends(words: Words) -> np.ndarray:
    """For every word the number of the first word after its text."""
    return np.repeat(words.first[1:], np.diff(words.first))


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words and names of the kept grams: the least, and of equal ones the last, of every window of one text."""
    size = len(words.name) - WINDOW + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = _grams(words.name, GRAM, WINDOW)
    least, where = gram[:size].copy(), np.arange(size)
    for k in range(1, REACH + 1):
        later = gram[k : size + k]
        take = later <= least
        least[take] = later[take]
        where[take] = np.flatnonzero(take) + k
    kept = np.zeros(len(gram), bool)
    kept[where[np.arange(size) + WINDOW <= _ends(words)[:size]]] = True
    at = np.flatnonzero(kept)
    return at, gram[at]


def _around(words: Words, at: np.ndarray, outside: int) -> np.ndarray:
    """Names of the words from REACH before to REACH after each kept gram; ``outside`` where the text ends."""
    first, end = np.repeat(words.first[:-1], np.diff(words.first)), _ends(words)
    places = at[:, None] + np.arange(-REACH, WINDOW)
    inside = (places >= first[at][:, None]) & (places < end[at][:, None])
    return np.where(inside, words.name[np.clip(places, 0, max(0, len(words.name) - 1))], np.uint64(outside))


def _listed(texts: int, owner: np.ndarray, name: np.ndarray, at: np.ndarray, around: pa.Array) -> pa.Array:
    """One list of prints for each text; ``owner`` rises."""
    rows = pa.StructArray.from_arrays([pa.array(name.view(np.int64)), pa.array(at.astype(np.int32)), around], fields=list(_PRINT))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)), rows)


def _contexts(around: np.ndarray) -> pa.Array:
    bounds = np.arange(0, around.size + 1, WINDOW + REACH, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(around.reshape(-1).view(np.int64)))


def _item_prints(text_col: str, id_col: str) -> Callable:
    """Prints of each item: the kept grams, or for fewer than WINDOW words the whole text as one gram of its own length."""
    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            words = split_words(*text_bytes(batch.column(text_col)), lower=True, between=NO_TERM)
            counts = np.diff(words.first)
            at, name = winnow(words)
            owner = np.searchsorted(words.first, at, "right") - 1
            short = np.flatnonzero((counts > 0) & (counts < WINDOW))
            whole = [_grams(words.name[words.first[d] : words.first[d + 1]], counts[d], counts[d])[0] for d in short.tolist()]
            around = [*_around(words, at, _OUTSIDE["item"]).view(np.int64).tolist(), *[None] * len(short)]
            owner, name = np.concatenate([owner, short]), np.concatenate([name, np.array(whole, np.uint64)])
            at = np.concatenate([at - words.first[owner[: len(at)]], np.zeros(len(short), np.int64)])
            order = np.argsort(owner, kind="stable")
            contexts = pa.array(around, pa.list_(pa.int64())).take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(counts), _listed(len(counts), owner[order], name[order], at[order], contexts)],
                names=["item_id", "n_words", "prints"])

    return prints


def _document_prints(text_col: str, id_col: str, bits: np.ndarray, lengths: list[int]) -> Callable:
    """Of each document the prints that an item may have: kept grams with what stands around them, and runs as long as a short item."""
    shift = np.uint64(64 - int(len(bits)).bit_length() + 1)

    def wanted(name: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (name & np.uint64(63))) | (np.uint64(1) << ((name >> np.uint64(6)) & np.uint64(63)))
        return (bits[(name >> shift).astype(np.int64)] & mask) == mask

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            words = split_words(*text_bytes(batch.column(text_col)), lower=True, between=NO_TERM)
            at, name = winnow(words)
            some = wanted(name)
            at, name = at[some], name[some]
            ats, names, parts = [at], [name], [_contexts(_around(words, at, _OUTSIDE["doc"]))]
            for n in lengths:
                name = _grams(words.name, n, n)
                at = np.flatnonzero(wanted(name) & (np.arange(len(name)) + n <= _ends(words)[: len(name)]))
                ats, names = [*ats, at], [*names, name[at]]
                parts.append(pa.nulls(len(at), pa.list_(pa.int64())))
            at, name = np.concatenate(ats), np.concatenate(names)
            order = np.argsort(at, kind="stable")
            at, name = at[order], name[order]
            owner = np.searchsorted(words.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(np.diff(words.first)),
                 _listed(batch.num_rows, owner, name, at - words.first[owner], pa.concat_arrays(parts).take(pa.array(order)))],
                names=["doc_id", "n_words", "prints"])

    return prints


def _filter_bits(names: DataFrame) -> np.ndarray:
    """Two bits for each name, in one of a power of two of 64-bit words; names that tasks do not find here are in no item."""
    words = 2
    n = names.count()
    while words < min(2 * n, FILTER_WORDS):
        words *= 2
    slot = F.shiftrightunsigned("name", 64 - words.bit_length() + 1)
    mask = F.expr("shiftleft(1L, cast(name & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(name, 6) & 63 as int))")
    bits = np.zeros(words, np.int64)
    for slot_, mask_ in names.groupBy(slot.alias("slot")).agg(F.bit_or(mask).alias("mask")).collect():
        bits[slot_] = mask_
    return bits.view(np.uint64)


def _equal_run(places: Iterable[int]) -> Column:
    """How many of ``places`` hold the same word on both sides, up to the first that does not."""
    run = F.lit(0)
    for p in reversed(list(places)):
        run = F.when(F.col("around")[p] == F.col("item_around")[p], 1 + run).otherwise(0)
    return run


def contaminated_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, the word spans (start, end) that occur in an item, and the ids of those items, sorted as text.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII. A span
    joins the occurrences of all windows of ten consecutive words of an item that overlap or touch;
    an item of fewer words is one window. Fingerprints are winnowed, so that every shared window
    holds a kept gram; documents and items meet on the grams' names and a hit is extended word by
    word on both sides. Items of fewer than ten words meet by their whole text.

    One row for each row of ``docs``, also of repeated ids and null ids. Null, empty and wordless
    texts have no words, spans or items; such items occur nowhere. Items with the same id count once,
    those without an id give spans but no id. Other columns are not read.

    Nothing that grows with the documents is broadcast or collected: tasks get a filter of at most
    2 MB, and only prints that pass it leave a task, with the words around them, so texts are never
    shuffled. Copies of an item are matched once, by the hash of its words.
    """
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(
        _item_prints("text", "item_id"), f"item_id {items.schema[item_col].dataType.simpleString()}, n_words long, prints array<struct<name:long,at:int,around:array<long>>>")
    own = stage(own.withColumn("version", F.xxhash64("n_words", "prints")), "item-prints")
    wanted = stage(own.select("version", "n_words", F.inline("prints")).select("version", "n_words", "name", F.col("around").alias("item_around")).distinct(), "item-grams")
    lengths = [r[0] for r in wanted.where("item_around is null").select("n_words").distinct().collect()]
    bits = _filter_bits(wanted.select("name").distinct())
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _document_prints("text", "doc_id", bits, sorted(lengths)),
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, prints array<struct<name:long,at:int,around:array<long>>>")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "document-prints")

    left, right = _equal_run(range(REACH - 1, -1, -1)), _equal_run(range(WINDOW, WINDOW + REACH))
    core = _equal_run(range(REACH, WINDOW))
    met = found.where(F.size("prints") > 0).select("row", F.inline("prints")).join(wanted, "name")
    short = met.where("item_around is null and around is null").select("row", "version", F.col("at").alias("start"), (F.col("at") + F.col("n_words").cast("int")).alias("end"))
    extended = met.where("item_around is not null and around is not null").select("row", "version", "at", core.alias("core"), left.alias("left"), right.alias("right"))
    extended = extended.where((F.col("core") == GRAM) & (F.col("left") + F.col("right") >= REACH)).select(
        "row", "version", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + GRAM + F.col("right")).alias("end"))
    hits = stage(short.union(extended), "item-hits")

    # The fold closes a span when the next one begins beyond its end.
    joined = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))), F.array().cast("array<struct<start:int,end:int>>"),
        lambda spans, s: F.when((F.size(spans) > 0) & (s["start"] <= F.try_element_at(spans, F.lit(-1))["end"]), F.concat(
            F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))),
            F.array(F.struct(F.try_element_at(spans, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(spans, F.lit(-1))["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(spans, F.array(s))))
    spans = hits.groupBy("row").agg(joined.alias("spans"))
    named = hits.select("row", "version").distinct().join(own.where("item_id is not null").select("version", "item_id"), "version")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = spans.join(named, "row", "left")
    return found.select("row", "doc_id", "n_words").join(hit, "row", "left").select(
        "doc_id", "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
