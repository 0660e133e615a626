"""Exact top-k lexical search: trees over items and documents, batches of pairs pruned by bounds of coordinate maxima."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.prefix import running_sums
from lexloom.llm.words import NO_TERM, portions, split_words, text_bytes
from lexloom.runtime import stage

#: Terms of all items of a block together (and of one more item); blocks of items are searched one after another.
BLOCK_TERMS = 1 << 18
#: Documents of a leaf, leaves of a branch, items of a group.
LEAF, BRANCH, GROUP = 32, 32, 16
#: One document in so many is searched in the first and in the second wave; all others come in the third.
WAVES = (1024, 32)
#: Cells of the tables of bounds and scores that a task holds at a time.
CELLS = 1 << 21


class Sparse(NamedTuple):
    """Rows of coordinates: ``first[r]:first[r + 1]`` are those of row r."""

    first: np.ndarray
    term: np.ndarray
    value: np.ndarray


def _rows(of: Sparse, rows: np.ndarray) -> Sparse:
    """Some rows of a table, in the order asked for."""
    sizes = of.first[rows + 1] - of.first[rows]
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(first[-1]) + np.repeat(of.first[rows] - first[:-1], sizes)
    return Sparse(first, of.term[at], of.value[at])


def _maxima(of: Sparse, size: int) -> Sparse:
    """Each ``size`` consecutive rows as one, with the maximum of every coordinate."""
    n = -(-(len(of.first) - 1) // size)
    node = np.repeat(np.arange(len(of.first) - 1) // size, np.diff(of.first))
    order = np.lexsort((of.term, node))
    node, term, value = node[order], of.term[order], of.value[order]
    new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])])) if len(node) else np.zeros(0, np.int64)
    return Sparse(np.searchsorted(node[new], np.arange(n + 1)), term[new], np.maximum.reduceat(value, new) if len(new) else value)


def _by_term(of: Sparse, terms: int) -> Sparse:
    """The same table by term: for each term the rows that have it."""
    row = np.repeat(np.arange(len(of.first) - 1), np.diff(of.first))
    order = np.argsort(of.term, kind="stable")
    return Sparse(np.searchsorted(of.term[order], np.arange(terms + 1)), row[order], of.value[order])


def _products(left: Sparse, right_by_term: Sparse, columns: int, live: np.ndarray | None = None) -> np.ndarray:
    """Inner products of all left rows with all right rows whose pair is live (others are 0).

    Values are whole numbers whose sums stay below 2**53, so they are exact in doubles.
    """
    rows = len(left.first) - 1
    of = np.repeat(np.arange(rows), np.diff(left.first))
    many = right_by_term.first[left.term + 1] - right_by_term.first[left.term]
    upto = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(rows * columns)
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + CELLS, "right")) - 1)
        at = np.arange(upto[i], upto[j]) + np.repeat(right_by_term.first[left.term[i:j]] - upto[i:j], many[i:j])
        cell = np.repeat(of[i:j] * columns, many[i:j]) + right_by_term.term[at]
        value = np.repeat(left.value[i:j], many[i:j]) * right_by_term.value[at]
        if live is not None:
            some = live.reshape(-1)[cell]
            cell, value = cell[some], value[some]
        if len(cell):
            low, high = int(of[i]) * columns, (int(of[j - 1]) + 1) * columns
            out[low:high] += np.bincount(cell - low, value, high - low)
        i = j
    return out.reshape(rows, columns)


class Block(NamedTuple):
    """Items of one block: class and terms of each, in the order of the tree's leaves; names are the sorted term names."""

    classes: np.ndarray
    names: np.ndarray
    items: Sparse


def _block(rows: list) -> Block:
    """Items with like words become neighbours: they are sorted by their terms, rarest in the block first."""
    names, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.array(r["terms"], np.int64).view(np.uint64) for r in rows]]), return_counts=True)
    own = [np.searchsorted(names, np.sort(np.array(r["terms"], np.int64).view(np.uint64))) for r in rows]
    shared = [t[counts[t] > 1] for t in own]
    keys = [tuple(t[np.lexsort((t, counts[t]))][:4].tolist()) for t in shared]
    order = sorted(range(len(rows)), key=lambda i: (keys[i], rows[i]["class"]))
    own = [own[i] for i in order]
    term = np.concatenate([np.zeros(0, np.int64), *own])
    return Block(np.array([rows[i]["class"] for i in order], np.int64), names,
                 Sparse(np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64), term, np.ones(len(term), np.int64)))


def _item_terms() -> Callable:
    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            words = split_words(*text_bytes(batch.column("text")), lower=True, between=NO_TERM)
            own = [np.unique(words.name[a:b]).view(np.int64) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return terms


def _document_terms(names: np.ndarray) -> Callable:
    """Number of terms of each document, and its terms that any item of the block has, with their counts."""
    def lists(first: np.ndarray, x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32)))

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in portions(batches, "text"):
            words = split_words(*text_bytes(batch.column("text")), lower=True, between=NO_TERM)
            at = np.minimum(np.searchsorted(names, words.name), max(0, len(names) - 1))
            known = names[at] == words.name if len(names) else np.zeros(len(at), bool)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(words.first))[known]
            pairs, tf = np.unique(owner * max(1, len(names)) + at[known], return_counts=True)
            first = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * max(1, len(names)))
            number = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            wave = np.where(number % WAVES[0] == 0, 0, np.where(number % WAVES[1] == 0, 1, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.first)), lists(first, pairs % max(1, len(names))), lists(first, tf), pa.array(wave.astype(np.int32))],
                names=["doc_id", "n", "terms", "tf", "wave"])

    return terms


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py(), column.flatten().to_numpy()


def _frequencies(terms: int) -> Callable:
    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "df"])

    return frequencies


class _Best:
    """The k best documents of each item so far; ``least`` is the score below which no document counts any more."""

    def __init__(self, least: np.ndarray, k: int):
        self.floor, self.least, self.k = least, least.copy(), k
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        self.held.append([item, score, doc, missing])
        self.size += len(item)
        if self.size > 4 * self.k * len(self.least) + (1 << 16):
            self.trim()

    def trim(self) -> list[np.ndarray]:
        if not self.held:
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        item, score, doc, missing = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((doc, missing, -score, item))
        item, score, doc, missing = item[order], score[order], doc[order], missing[order]
        turn = np.arange(len(item)) - np.searchsorted(item, item)
        some = turn < self.k
        last = turn == self.k - 1
        self.least = self.floor.copy()
        self.least[item[last]] = np.maximum(self.floor[item[last]], score[last])
        self.held = [[item[some], score[some], doc[some], missing[some]]]
        self.size = int(some.sum())
        return self.held[0]


def _search(block: Block, weights: np.ndarray, documents: int, words: int, least: np.ndarray, k: int) -> Callable:
    """The k best documents of the task for each item, found by descending pairs of item and document nodes."""
    n_terms, n_items = len(block.names), len(block.classes)
    items = _by_term(block.items, n_terms)
    of_groups = _maxima(block.items, GROUP)
    groups, n_groups = _by_term(of_groups, n_terms), len(of_groups.first) - 1
    group_of, edges = np.arange(n_items) // GROUP, np.arange(0, n_items, GROUP)

    def descend(docs: Sparse, ids: np.ndarray, missing: np.ndarray, best: _Best) -> None:
        leaves = _maxima(docs, LEAF)
        branches = _maxima(leaves, BRANCH)
        n_leaves, n_docs = len(leaves.first) - 1, len(docs.first) - 1
        weakest = np.minimum.reduceat(best.least, edges)
        above = _products(branches, groups, n_groups) >= weakest
        live = above[np.arange(n_leaves) // BRANCH]
        some = np.flatnonzero(live.any(axis=1))
        if not len(some):
            return
        part = _rows(leaves, some)
        live = live[some]
        live &= _products(part, groups, n_groups, live) >= weakest
        pairs = live[:, group_of]
        pairs &= _products(part, items, n_items, pairs) >= best.least
        hot = np.flatnonzero(pairs.any(axis=1))
        if not len(hot):
            return
        rows = (some[hot][:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        mask = np.repeat(pairs[hot], LEAF, axis=0)[rows < n_docs]
        rows = rows[rows < n_docs]
        scores = _products(_rows(docs, rows), items, n_items, mask)
        d, i = np.nonzero(mask & (scores >= best.least))
        best.add(i, scores[d, i].astype(np.int64), ids[rows[d]], missing[rows[d]])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(least, k)
        for batch in batches:
            if not batch.num_rows or not n_items:
                continue
            first, term = _flat(batch.column("terms"))
            tf, n = _flat(batch.column("tf"))[1].astype(np.int64), batch.column("n").to_numpy()
            norm = 50 + (50 * n * documents) // max(1, words)
            docs = Sparse(first, term.astype(np.int64), weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(norm, np.diff(first)))))
            # Documents whose strongest coordinate is the same become neighbours, so that a node's maxima stay low.
            full = np.flatnonzero(np.diff(first))
            strongest = np.full(batch.num_rows, n_terms)
            if len(full):
                top = np.maximum.reduceat(docs.value, first[full])
                strongest[full] = np.minimum.reduceat(np.where(docs.value == np.repeat(top, np.diff(first)[full]), docs.term, n_terms), first[full])
            order = np.lexsort((n, strongest))
            id_column = batch.column("doc_id")
            missing = np.asarray(id_column.is_null())
            ids = id_column.fill_null(0).to_numpy()
            step = LEAF * max(1, CELLS // (LEAF * max(1, n_items)))
            for at in range(0, len(order), step):
                rows = order[at : at + step]
                descend(_rows(docs, rows), ids[rows], missing[rows], best)
                best.trim()
        item, score, doc, missing = best.trim()
        yield pa.RecordBatch.from_arrays([pa.array(block.classes[item]), pa.array(doc, mask=missing), pa.array(score)], names=["class", "doc_id", "score"])

    return search


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("class").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    vectors = stage(docs.mapInArrow(_document_terms(block.names), "doc_id long, n long, terms array<int>, tf array<int>, wave int"), "search-vectors", ["wave"])
    documents, words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.full(len(block.names), math.floor(1000 * math.log(2 * documents + 2)), np.int64)
    for term, df in vectors.select("terms").mapInArrow(_frequencies(len(block.names)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    least, best = np.ones(len(block.classes), np.int64), None
    place = {c: i for i, c in enumerate(block.classes.tolist())}
    for wave in range(len(WAVES) + 1):
        found = vectors.where(F.col("wave") == wave).select("doc_id", "n", "terms", "tf").mapInArrow(
            _search(block, weights, documents, words, least, k), "class long, doc_id long, score long")
        found = found if best is None else found.union(best.select("class", "doc_id", "score"))
        best = stage(_best_of(found, k), "search-best")
        if wave < len(WAVES):
            for row in best.where(F.col("rank") == k).select("class", "score").collect():
                least[place[row["class"]]] = max(1, row["score"])
    return best


def search_lexical(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """The k documents with the highest lexical score for each item: item_id, rank from 1, doc_id, score.

    Terms are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A term
    weighs floor(1000 ln((2N + 2) / (2 df + 1))) and a document scores the sum, over the item's
    terms, of weight * (10**9 tf div (1000 tf + 20 m)) with m = 50 + 50 n N div L, in whole numbers. Scores above
    0 count; of equal ones the smaller doc_id comes first, rows without an id last.

    The search is exact. Documents become vectors over the items' terms. Each task builds a tree over
    its documents whose nodes hold the maximum of every coordinate, and meets it with a tree over the
    items: the product of two nodes' maxima bounds the scores of all pairs below them, and where it is less
    than the weakest k-th score of the items the whole batch of pairs is skipped. The k-th scores
    come from a first and a second wave of documents, which are searched in the same way, and rise
    inside each task; every document is in exactly one wave.

    Items are searched in blocks of at most BLOCK_TERMS terms (or one item), so what tasks and driver
    hold does not grow with their number. Items with the same terms are searched once. Each row
    of ``docs`` and of ``items`` counts by itself, also with repeated or null ids; null and wordless
    texts take no part. Other columns are not read. ids of documents must be whole numbers.
    """
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(
        _item_terms(), f"item_id {items.schema[item_col].dataType.simpleString()}, terms array<long>")
    own = stage(own.where(F.size("terms") > 0).withColumn("class", F.xxhash64("terms")), "search-items")
    classes = own.groupBy("class").agg(F.any_value("terms").alias("terms"), F.any_value(F.size("terms").cast("long")).alias("size"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    placed = running_sums(classes.select("class", "size"), ["class"], ["size"]) if total > BLOCK_TERMS else classes.select("class", F.col("size").alias("size_upto"), F.col("size"))
    block_of = ((F.col("size_upto") - F.col("size")) / BLOCK_TERMS).cast("int") if total > BLOCK_TERMS else F.lit(0)
    blocks = stage(classes.join(placed.select("class", block_of.alias("block")), "class").select("class", "terms", "block"), "search-blocks")
    best = None
    for number in range(max(1, -(-total // BLOCK_TERMS))):
        rows = blocks.where(F.col("block") == number).collect()
        found = _search_block(texts, _block(rows), k)
        best = found if best is None else best.union(found)
    return own.select("class", "item_id").join(best, "class").select("item_id", "rank", "doc_id", "score")
