"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.sampling import bounded_sample, held_out
from lexloom.llm.words import owners, portions, split_words, text_bytes

PASSAGE = 64
#: Labelled documents of each class that the model is fitted on, and passages of all of them together, at most; one document may be longer.
PER_CLASS, CLASS_PASSAGES = 3000, 60_000
HIDDEN, STEPS, RATE, SEED = 16, 300, 0.02, 11
LEAST = 0.3
# Classes of bytes: lower, upper, digit, space, line end, full stop or comma, quote or bracket, other marks, beyond ASCII, control.
_CLASS = np.full(256, 7)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?!"]] = 5
_CLASS[[ord(c) for c in "\"'()[]{}<>"]] = 6
_CLASS[128:] = 8
_CLASS[[*range(10), *range(11, 32), 127]] = 9
_KINDS = 10
SHAPES = _KINDS + 8
#: Buckets of hashed words; each has a learned vector, and a passage is encoded by those of its words besides its shape.
WORD_BUCKETS = 256
FEATURES = SHAPES + WORD_BUCKETS
_BLOCK = 2048


class QualityModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def read_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes (passages, SHAPES), words a bucket (passages, WORD_BUCKETS) and the bounds of each text's passages.

    An empty text is one empty passage.
    """
    words = split_words(data, offsets)
    counts = np.diff(words.first)
    n = len(counts)
    passages = np.maximum(1, -(-counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(passages)])
    total = int(bounds[-1])
    text = owners(words.first)
    own = bounds[:-1][text] + (np.arange(len(text)) - words.first[:-1][text]) // PASSAGE
    # A byte belongs to the passage of the last word that began before it.
    begins = np.concatenate([offsets[:-1], words.start])
    marks = np.concatenate([bounds[:-1], own])
    order = np.lexsort((marks, begins))
    begins, marks = begins[order], marks[order]
    spans = np.diff(np.append(begins, len(data)))
    kinds = np.bincount(np.repeat(marks, spans) * _KINDS + _CLASS[data], minlength=total * _KINDS).reshape(total, _KINDS).astype(float)
    size = np.maximum(kinds.sum(axis=1), 1)
    number = np.bincount(own, minlength=total)
    some = np.maximum(number, 1)
    length = (words.end - words.start).astype(float)
    per_word = lambda x: np.bincount(own, weights=x, minlength=total) / some
    mean = per_word(length)
    same = np.zeros(len(own))
    same[1:] = (words.name[1:] == words.name[:-1]) & (own[1:] == own[:-1])
    key = np.sort((own.astype(np.uint64) << np.uint64(40)) | words.name >> np.uint64(24))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    passage = (key >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(passage[new], minlength=total) / some
    runs = np.diff(np.append(np.flatnonzero(new), len(key)))
    most = np.zeros(total)
    np.maximum.at(most, passage[new], runs)
    last = words.data[words.end - 1] if len(own) else np.zeros(0, np.uint8)
    marked = _CLASS[last] >= 5 if len(own) else np.zeros(0, bool)
    shared = np.stack([np.log1p(number), mean, np.sqrt(np.maximum(per_word(length * length) - mean * mean, 0)), distinct,
                       most / some, per_word(same), per_word(marked.astype(float)), per_word((length == 1).astype(float))], axis=1)
    buckets = np.zeros((total, WORD_BUCKETS), np.uint8)  # a passage has at most PASSAGE words
    bucket = (words.name % np.uint64(WORD_BUCKETS)).astype(np.int64)
    for low in range(0, total, _BLOCK):
        high = min(low + _BLOCK, total)
        a, b = np.searchsorted(own, [low, high])
        buckets[low:high] = np.bincount((own[a:b] - low) * WORD_BUCKETS + bucket[a:b], minlength=(high - low) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
    return np.concatenate([kinds / size[:, None], shared], axis=1), buckets, bounds


def _joined(shapes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Shapes beside the square roots of the buckets' shares, which have length 1."""
    total = np.maximum(buckets.sum(axis=1, keepdims=True, dtype=np.float32), 1)
    return np.concatenate([shapes.astype(np.float32), np.sqrt(buckets / total)], axis=1)


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, FEATURES) as the encoder sees them before scaling, and the bounds of each text's passages."""
    shapes, buckets, bounds = read_passages(data, offsets)
    return _joined(shapes, buckets), bounds


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        shapes, buckets, bounds = read_passages(*text_bytes(batch.column("text")))
        spans = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        bags = [pa.array([rows[x].tobytes() for x in spans], pa.binary()) for rows in (shapes.astype(np.float32), buckets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *bags], names=["doc_id", "quality", "shapes", "buckets"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple:
    """Encode passages, weigh them by gated attention, and score the weighted representation."""
    return _weigh(w, np.tanh(x @ w["encode"] + w["encode_b"]), starts, bag)


def _weigh(w: dict[str, np.ndarray], h: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple:
    t, s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    e = (t * s) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return h, t, s, a, z, _sigmoid(z @ w["score"] + w["score_b"])


def train(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Fit encoder, gate and score together by Adam on the cross-entropy of the documents."""
    mean, scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
    mean[:SHAPES], scale[:SHAPES] = x[:, :SHAPES].mean(axis=0, dtype=float), x[:, :SHAPES].std(axis=0, dtype=float) + 1e-6
    x, labels = np.clip((x - mean) / scale, -8, 8).astype(np.float32), labels.astype(np.float32)
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((WORD_BUCKETS, HIDDEN))  # of words: they start without a say
    w = {"encode": np.concatenate([rng.normal(0, SHAPES ** -0.5, (SHAPES, HIDDEN)), vectors]), "encode_b": np.zeros(HIDDEN),
         "tanh": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN)), "gate": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN)),
         "attend": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "score": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "score_b": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    starts, bag = bounds[:-1], np.repeat(np.arange(len(labels)), np.diff(bounds))
    for step in range(1, STEPS + 1):
        h, t, s, a, z, p = _forward(w, x, starts, bag)
        d = (p - labels) / len(labels)
        dz = d[:, None] * w["score"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, ds = de[:, None] * w["attend"] * s * (1 - t * t), de[:, None] * w["attend"] * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ w["tanh"].T + ds @ w["gate"].T
        du = dh * (1 - h * h)
        slopes = {"encode": x.T @ du, "encode_b": du.sum(axis=0), "tanh": h.T @ dt, "gate": h.T @ ds, "attend": (t * s).T @ de,
                  "score": z.T @ d, "score_b": d.sum(keepdims=True)}
        for k, slope in slopes.items():
            slope = slope + 1e-4 * w[k]
            first[k] += 0.1 * (slope - first[k])
            second[k] += 0.001 * (slope * slope - second[k])
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = PER_CLASS, class_passages: int = CLASS_PASSAGES) -> QualityModel:
    """Learn from labelled documents that are not held out, at most ``per_class`` of each label.

    A training document gives all its passages. Documents are taken in the order of a hash of their
    id as long as their label's passages come to at most ``class_passages``, so where texts are long
    fewer documents are learnt from, never parts of them. Several labels of a document count as their majority, good in a tie;
    null labels do not count. Without any labelled document every score is 1/2.
    """
    judged = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality")).where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = F.broadcast(bounded_sample(judged, "quality", per_class))  # bounded by twice per_class rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    # One label has at most per_class ids here, so a running sum over its rows is bounded.
    size = F.greatest(F.ceil(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) / PASSAGE), F.lit(1))
    sized = rows.groupBy("doc_id", "quality").agg(F.sum(size).alias("size"))
    turn = W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    upto = F.sum("size").over(turn.rowsBetween(W.unboundedPreceding, 0))
    fits = sized.withColumns({"upto": upto, "turn": F.row_number().over(turn)}).where((F.col("upto") <= class_passages) | (F.col("turn") == 1))
    rows = rows.join(F.broadcast(fits.select("doc_id")), "doc_id")  # bounded as above
    found = rows.mapInArrow(_features, "doc_id long, quality int, shapes binary, buckets binary").orderBy("doc_id").collect()
    if not found:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), {})
    shapes = [np.frombuffer(r["shapes"], np.float32).reshape(-1, SHAPES) for r in found]
    buckets = [np.frombuffer(r["buckets"], np.uint8).reshape(-1, WORD_BUCKETS) for r in found]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in shapes])])
    return train(_joined(np.concatenate(shapes), np.concatenate(buckets)), bounds, np.array([r["quality"] for r in found], float))


def score_texts(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not model.weights or len(offsets) < 2:
        return np.full(len(offsets) - 1, 0.5)
    shapes, buckets, bounds = read_passages(data, offsets)
    w, h = model.weights, np.empty((len(shapes), HIDDEN))
    for low in range(0, len(shapes), _BLOCK):
        x = _joined(shapes[low : low + _BLOCK], buckets[low : low + _BLOCK])
        h[low : low + _BLOCK] = np.tanh(np.clip((x - model.mean) / model.scale, -8, 8) @ w["encode"] + w["encode_b"])
    return _weigh(w, h, bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))[-1]


def _score(model: QualityModel) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            scores = score_texts(model, *text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return score


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``least``) for every whole text.

    A null or empty text is one empty passage and is scored as such; a null id is kept; repeated
    rows are scored each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            yield batch.filter(pa.array(score_texts(model, *text_bytes(batch.column(text_col))) >= least))

    return docs.mapInArrow(keep, docs.schema)
