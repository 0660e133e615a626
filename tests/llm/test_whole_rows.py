"""Names that operators use themselves, whole training texts, sparse sketches, several vector lengths, large near groups."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.llm import fingerprints, langid, mixing, neardup, pivots, quality
from lexloom.llm.sampling import held_out
from lexloom.llm.words import text_bytes

CLASHING = "doc_id long, text string, lang string, source string, row int, mark string, held string, times int, _row int, _copy string, _times int, _mark string, component_id string, band int"


def test_clashing_names(spark):
    rows = [(i, f"un texte de plus {i % 3} " * 3 if i % 4 else None, "fr", "ab"[i % 2], 1, "m", "h", 2, 3, "c", 4, "k", "x", 5) for i in range(12)]
    df = spark.createDataFrame(rows, CLASHING)
    for out in (mixing.mix_rows(df), neardup.keep_one(df)):
        assert out.columns == df.columns and out.schema == df.schema
        got = {tuple(r) for r in out.collect()}
        assert got and got <= set(rows)
    assert neardup.keep_one(df).count() == 3 + 3  # three texts, and each row without one
    assert mixing.mix_rows(df.limit(0)).count() == neardup.keep_one(df.limit(0)).count() == 0


def test_one_late_passage_is_learnt(spark):
    """Only passage 100 of 120 tells the label: a bag that leaves passages out cannot know it."""
    plain, loud = "mot " * 64, "?!?! (((( " * 64
    rows = [(i, plain * 100 + (loud if i % 2 else plain) + plain * 19, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df, df.select("doc_id", "quality"))
    right = [r["predicted"] == r["doc_id"] % 2 for r in quality.score_documents(df, model, least=0.5).collect()]
    assert np.mean(right) > 0.95
    few = quality.fit(df, df.select("doc_id", "quality"), class_passages=1)  # one whole document of each label
    assert few.weights and len(quality.score_documents(df, few).collect()) == 80


def test_words_of_one_shape_are_told_apart(spark):
    """Equal lengths, bytes and repeats: only which words a passage holds tells the label."""
    rng = random.Random(4)
    kinds = (["chat", "mule", "lynx", "loup"], ["rose", "iris", "buis", "aune"])
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(100)), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = quality.score_documents(df, quality.fit(df, df.select("doc_id", "quality")), least=0.5).collect()
    assert any(r["held_out"] for r in scored) and all(r["predicted"] == r["doc_id"] % 2 for r in scored)


def test_words_of_a_bucket_are_counted_in_blocks(monkeypatch):
    texts = pa.array(["a b a", None, "b " * 200, "c"])
    whole = quality.read_passages(*text_bytes(texts))
    monkeypatch.setattr(quality, "_BLOCK", 2)
    for one, other in zip(whole, quality.read_passages(*text_bytes(texts))):
        assert (one == other).all()
    assert whole[1].sum(axis=1).tolist() == [3, 0, 64, 64, 64, 8, 1]


def test_quality_scores_against_plain_python(spark, docs, sf_dir):
    """The batched forward pass equals one document at a time, written out."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.limit(40).collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    w = model.weights
    for doc, text in texts.items():
        x, _ = quality.passage_features(*text_bytes(pa.array([text])))
        h = np.tanh(np.clip((x - model.mean) / model.scale, -8, 8) @ w["encode"] + w["encode_b"])
        gated = [float(np.tanh(row @ w["tanh"]) * (1 / (1 + np.exp(-(row @ w["gate"])))) @ w["attend"]) for row in h]
        weight = np.exp(np.array(gated) - max(gated))
        z = (weight / weight.sum()) @ h
        assert abs(got[doc] - 1 / (1 + np.exp(-float(z @ w["score"] + w["score_b"][0])))) < 1e-4


def test_sparse_sketches_are_filled_by_probing(spark):
    """Two to five filled bins: every empty bin holds the value of the first filled one that its own hash sequence meets."""
    texts = [" ".join(f"w{i}{k}" for k in range(5 + i % 4)) for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("hashes", fingerprints.shingle_hashes(F.col("t"))).withColumn("sketch", fingerprints.sketch(F.col("t")))
    order = spark.range(fingerprints.BINS).select("id", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda t: F.xxhash64(F.col("id").cast("int"), t).bitwiseAND(F.lit(fingerprints.BINS - 1).cast("long"))).alias("asked"))
    asked = {r["id"]: r["asked"] for r in order.collect()}
    for row in df.collect():
        least = {}
        for h in sorted(row["hashes"]):
            least.setdefault((h % (1 << 64)) >> 57, h)
        for j, value in enumerate(row["sketch"]):
            bin_ = j if j in least else next(b for b in asked[j] if b in least)
            assert value == least[bin_] % 256


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 2).round(3).tolist()) for i in range(120)] + [(500, []), (501, [1.0] * 9)]
    got = {}
    for r in pivots.search_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=10).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    lifted = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows}
    for q in range(0, 120, 10):
        scored = sorted((-int(lifted[q] @ v), i) for i, v in lifted.items() if len(v) == len(lifted[q]) and i != q)[:3]
        assert sorted(got[q], key=lambda x: (-x[1], x[0])) == [(i, -s) for s, i in scored]
    assert 500 not in got and 501 not in got


def test_sub_groups_of_one_template(spark):
    """Many near copies of one text in sub-groups, some of which only a chain of members joins: brute force agrees."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(6):
        own = list(base)
        for i in rng.sample(range(120), 6):
            own[i] = f"g{g}.{i}"
        for m in range(70):
            words = list(own)
            for i in rng.sample(range(120), rng.randint(0, 5)):
                words[i] = f"m{g}.{m}.{i}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[i:i + 3]) for i in range(118)} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    block, neardup.BLOCK = neardup.BLOCK, 64
    try:
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    finally:
        neardup.BLOCK = block
    assert got == {i: find(i) for i in range(len(rows))}


def test_languages_against_plain_python(spark, docs):
    """Document frequencies and predictions, written out text by text on the fitted centroids."""
    def grams(text):
        folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
        for a, b, c in zip(folded, folded[1:], folded[2:]):
            if b != 32 and (a != 32 or c != 32):
                g = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
                yield ((g ^ g >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20

    model = langid.fit(docs)
    rows = docs.withColumn("held", held_out(F.col("doc_id"))).collect()
    counted = {r["doc_id"]: Counter(grams(r["text"])) for r in rows}
    learnt = [r["doc_id"] for r in rows if r["lang"] is not None and r["text"] is not None and not r["held"]]
    df = Counter(g for d in learnt for g in counted[d])
    idf = [math.log((1 + len(learnt)) / (1 + df[g])) + 1 for g in range(langid.DIMENSIONS)]
    assert np.allclose(idf, model.idf)
    for r in langid.identify(docs, model).collect():
        vector = {g: math.log1p(n) * idf[g] for g, n in counted[r["doc_id"]].items()}
        length = math.sqrt(sum(v * v for v in vector.values())) or 1
        cosines = [sum(v * c[g] for g, v in vector.items()) / length for c in model.centroids]
        if r["lang_pred"] != "und":
            assert abs(max(cosines) - r["score"]) < 1e-6
            assert max(c for c, name in zip(cosines, model.languages) if name == r["lang_pred"]) > max(cosines) - 1e-9
