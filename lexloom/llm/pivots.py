"""Exact search for the highest inner products by elimination over a pivot table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.words import mix64
from lexloom.runtime import stage

PIVOTS = 48
#: Rows that pivots are chosen from and that give every query a first threshold.
PROBE_ROWS = 1024
#: Candidates and queries that meet in one task.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where every sum stays exact."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 1 << 53 else a @ b.T


def _lift(vectors: np.ndarray, longest: int) -> np.ndarray:
    """One coordinate more makes all candidates equally long: the nearest is then the one with the highest product."""
    x = vectors.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x, each as far as possible from those before it."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
        chosen.append(int(far.argmax()))
    return x[chosen]


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _row_keys(vectors: np.ndarray) -> np.ndarray:
    key = np.zeros(len(vectors), np.uint64)
    for column in vectors.T:
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
    return key.view(np.int64)


def _table(dim: int, longest: int, pivots: np.ndarray, probe_ids: np.ndarray, probes: np.ndarray, k: int) -> Callable:
    """Distances to all pivots for every row; for queries also the k-th best score among the probe rows."""
    def table(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim)
            query = np.asarray(batch.column("query"))
            lifted = _lift(v, longest)
            far = [_distances(lifted, pivots), _distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), pivots)]
            least = np.full(len(v), np.iinfo(np.int64).min)
            for i in np.flatnonzero(query):
                scores = np.sort(_products(v[i : i + 1], probes)[0][probe_ids != ids[i]])
                if len(scores) >= k:
                    least[i] = scores[-k]
            rows = lambda x: pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), batch.column("query"), rows(far[0]), rows(far[1]), pa.array(least), pa.array(_row_keys(v))],
                names=["vec_id", "v", "query", "far", "query_far", "least", "row_key"])

    return table


_FOUND = "query_id long, row_key long, vec_id long, score long"


def _search(dim: int, longest: int, k: int) -> Callable:
    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "row_key", "vec_id", "score")])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        far = lambda t, c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.float32).reshape(t.num_rows, -1)
        ids, v, table = candidates.column("vec_id").to_numpy(), _matrix(candidates.column("v"), dim), far(candidates, "far").T.copy()
        query_ids, q, query_far = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), dim), far(queries, "query_far")
        keys, least = queries.column("row_key").to_numpy(), queries.column("least").to_numpy()
        square = (q.astype(float) ** 2).sum(axis=1)
        out: list[list[np.ndarray]] = []
        for i in range(len(q)):
            # |d(q, p) - d(x, p)| for the best of all pivots bounds d(q, x) below, and so the score above.
            low = np.zeros(len(ids), np.float32)
            for p in range(len(table)):
                np.maximum(low, np.abs(table[p] - query_far[i, p]), out=low)
            bound = (square[i] + longest - low.astype(float) ** 2) / 2 + 1 + 1e-5 * (square[i] + longest)
            bound[ids == query_ids[i]] = -np.inf
            left = np.flatnonzero(bound >= max(least[i], -1e300))
            left = left[np.argsort(-bound[left], kind="stable")]
            best_ids, best, at, step = ids[:0], ids[:0], 0, 128
            while at < len(left) and (len(best) < k or bound[left[at]] >= best[-1]):
                some = left[at : at + step]
                best_ids, best = np.concatenate([best_ids, ids[some]]), np.concatenate([best, _products(q[i : i + 1], v[some])[0]])
                top = _top(best_ids, best, k)
                best_ids, best, at, step = best_ids[top], best[top], at + step, step * 4
            out.append([np.full(len(best), query_ids[i]), np.full(len(best), keys[i]), best_ids, best])
        return pa.table([np.concatenate(x) for x in zip(*out)], schema=schema)

    return lambda key, queries, candidates: search(queries, candidates)


def search_top(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
               pivots: int = PIVOTS) -> DataFrame:
    """The k highest integer inner products for each row whose id is divisible by ``every``.

    Components become floor(scale * x). Rows are candidates for every query but those of their own
    id. Vectors that are null, empty or hold null or non-finite components take no part, nor do null
    ids. An inner product needs equal lengths: vectors are searched among those of their own length,
    one length after another (few are expected). A repeated row is a candidate each
    time and one query; different vectors of one id are queries of their own. Ties go to the
    smaller id. Returns query_id, rank (from 1), vec_id and score; fewer than k where there are
    fewer candidates. Other columns are ignored; an empty table gives no rows.

    Candidates and queries are dealt to blocks by a hash; each block of queries meets each block of
    candidates in one task. There a candidate's score is bounded by the triangle inequality over
    all pivots; candidates are evaluated in the order of their bounds until the next bound is below
    the k-th best score. Scores of a bounded number of probe rows give each query a threshold first.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_x")).where(F.col("vec_id").isNotNull() & F.col("_x").isNotNull())
    rows = rows.where(F.coalesce(F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    rows = stage(rows.select("vec_id", F.transform("_x", lambda c: F.floor(c.cast("double") * scale)).alias("v")), "search-rows")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect() if r[0])
    out = None
    for dim in lengths:
        found = _search_length(rows.where(F.size("v") == dim).withColumn("query", F.pmod("vec_id", F.lit(every)) == 0), dim, k, pivots)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search_length(rows: DataFrame, dim: int, k: int, pivots: int) -> DataFrame:
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    n, n_queries, longest = rows.agg(F.count("*"), F.count_if("query"), F.max(square)).first()
    probes = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PROBE_ROWS).select("vec_id", "v").collect()
    probe_ids, probe_rows = np.array([r["vec_id"] for r in probes]), np.array([r["v"] for r in probes], np.int64)
    chosen = _spread_out(_lift(probe_rows, longest), pivots)
    table = stage(rows.mapInArrow(
        _table(dim, longest, chosen, probe_ids, probe_rows, k),
        "vec_id long, v array<long>, query boolean, far binary, query_far binary, least long, row_key long"), "pivot-table")

    blocks, turns = -(-n // CANDIDATE_BLOCK), max(1, -(-n_queries // QUERY_BLOCK))
    candidates = table.select("vec_id", "v", "far", F.pmod(F.xxhash64("vec_id", "row_key", F.lit(1)), F.lit(blocks)).alias("block"),
                              F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
    queries = table.where("query").dropDuplicates(["vec_id", "row_key"]).select(
        "vec_id", "v", "query_far", "least", "row_key", F.pmod(F.xxhash64("vec_id", "row_key", F.lit(2)), F.lit(turns)).alias("turn"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = queries.groupBy("block", "turn").cogroup(candidates.groupBy("block", "turn")).applyInArrow(_search(dim, longest, k), _FOUND)
    place = F.row_number().over(W.partitionBy("query_id", "row_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
