"""Language of a text by the nearest of several centroids of each language."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.sampling import bounded_sample, held_out
from lexloom.llm.words import portions, text_bytes

DIMENSIONS = 4096
CENTROIDS = 3
#: Labelled documents that a language's centroids are fitted on, at most.
PER_LANGUAGE = 400
#: Share of the sample's own documents that a centroid's reach takes in.
REACH = 0.999
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ROWS = 256


class LanguageModel(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # least cosine that is not rejected
    idf: np.ndarray


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMENSIONS) counts of hashed 3-byte n-grams; what is no letter counts as one space."""
    n = len(offsets) - 1
    folded = _FOLD[data].astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    gram = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA6B) + folded[2:] * np.uint32(0xC2B2AE35)
    gram = ((gram ^ gram >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    inside = (text[:-2] == text[2:]) & (folded[1:-1] != 32) & ((folded[:-2] != 32) | (folded[2:] != 32))
    at = text[:-2][inside] * DIMENSIONS + gram[inside]
    return np.bincount(at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for a in range(0, batch.num_rows, _ROWS):
        b = min(a + _ROWS, batch.num_rows)
        yield a, b, _counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    length = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
    return np.divide(weighted, length, out=np.zeros_like(weighted), where=length > 0)


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in portions(batches, "text"):
        for _, _, counts in _chunks(batch):
            total += (counts > 0).sum(axis=0)
            texts += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[texts], total]))], names=["gram", "n"])


def _cluster(idf: np.ndarray, centroids: int) -> Callable:
    def cluster(table: pa.Table) -> pa.Table:
        """Spherical k-means from the vectors farthest apart; a language of few documents has fewer centroids."""
        language = table.column("lang")[0].as_py()
        table = table.sort_by("doc_id")
        vectors = np.concatenate([_vectors(c, idf) for b in portions(table.combine_chunks().to_batches(), "text") for _, _, c in _chunks(b)])
        vectors = vectors[vectors.any(axis=1)]
        if not len(vectors):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "reach": pa.array([], pa.float64())})
        mean = vectors.mean(axis=0)
        centres = [mean / np.linalg.norm(mean)]
        while len(centres) < min(centroids, len(vectors)):
            centres.append(vectors[np.argmin(np.max(vectors @ np.array(centres).T, axis=1))])
        centres = np.array(centres)
        for _ in range(10):
            nearest = np.argmax(vectors @ centres.T, axis=1)
            for k in range(len(centres)):
                if (nearest == k).any():
                    own = vectors[nearest == k].mean(axis=0)
                    centres[k] = own / max(np.linalg.norm(own), 1e-12)
        cosine = vectors @ centres.T
        nearest = np.argmax(cosine, axis=1)
        reach = [float(np.quantile(cosine[nearest == k, k], 1 - REACH)) if (nearest == k).any() else 1.0 for k in range(len(centres))]
        return pa.table({"lang": [language] * len(centres), "centroid": [c.astype(np.float32).tobytes() for c in centres], "reach": reach})

    return cluster


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from documents that are not held out and have a language.

    Document frequencies of n-grams are counted over all of them. Centroids are fitted per
    language on at most ``per_language`` documents. What comes to the driver is one number for
    each n-gram slot and a few vectors for each language; languages are assumed to be hundreds.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    counted = {r["gram"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    texts = counted.get(-1, 0)
    idf = np.log((1 + texts) / (1 + np.array([counted.get(i, 0) for i in range(DIMENSIONS)]))) + 1
    # Bounded by per_language rows for each language.
    chosen = F.broadcast(bounded_sample(rows.select("doc_id", "lang"), "lang", per_language).distinct())
    found = rows.join(chosen, ["doc_id", "lang"], "left_semi").groupBy("lang").applyInArrow(
        _cluster(idf, centroids), "lang string, centroid binary, reach double").orderBy("lang", "centroid").collect()
    return LanguageModel([r["lang"] for r in found], np.array([np.frombuffer(r["centroid"], np.float32) for r in found], np.float64).reshape(len(found), DIMENSIONS),
                         np.array([r["reach"] for r in found]), idf)


def _has_letter(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = text_bytes(batch.column("text"))
    letter = np.concatenate([[0], np.cumsum(_FOLD[data] - 97 < 26)])
    found = letter[offsets[1:]] > letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _predict(model: LanguageModel) -> Callable:
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in portions(batches, "text"):
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if model.languages:
                for a, b, counts in _chunks(batch):
                    cosine = _vectors(counts, model.idf) @ model.centroids.T
                    best[a:b], score[a:b] = cosine.argmax(axis=1), cosine.max(axis=1)
                near = score >= model.reach[best]
            else:
                near = np.zeros(batch.num_rows, bool)
            found = _has_letter(batch)
            best[~found], score[~found] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(found & near)],
                names=["doc_id", "lang_pred", "score", "near"])

    return predict


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine) and near for every row.

    ``near`` is false where the text lies farther from its centroid than nearly all documents the
    centroid was fitted on; with ``reject`` such rows get ``und`` as well. A null text, one without
    any letter, or a model without languages gives ``und`` and score 0; ties go to the language
    first by name. Repeated rows are judged each; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, near boolean")
    if reject:
        out = out.withColumn("lang_pred", F.when(F.col("near"), F.col("lang_pred")).otherwise("und"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "near")
