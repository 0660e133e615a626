"""Words, packing, classifiers, repeats, near duplicates and search against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import langid, links, neardup, packing, pivots, quality, recompress
from lexloom.llm.queries import QUERIES
from lexloom.llm.sampling import held_out
from lexloom.llm.words import shingles, split_words, text_bytes

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab Ü\n\t\u00a0x"), max_size=30)), max_size=8))
def test_words(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = split_words(data, offsets)
    assert [[bytes(words.data[a:b]) for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first[:-1], words.first[1:])] == [
        (t or "").encode().split() for t in texts]
    names, bounds = shingles(words, 3)
    brute = []
    for t in texts:
        own = (t or "").encode().split()
        brute.append([tuple(own[i:i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [tuple(own)] if own else [])
    assert np.diff(bounds).tolist() == [len(b) for b in brute]
    known = {}
    assert all(known.setdefault(s, n) == n for s, n in zip([s for b in brute for s in b], names.tolist())) and len(set(known.values())) == len(known)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
def test_windows_are_filled(counts):
    used = dict.fromkeys(counts, 0)
    for pattern, repeats in packing.fill_windows(counts, 64):
        assert 0 < sum(n * t for n, t in pattern.items()) <= 64
        for n, t in pattern.items():
            used[n] += t * repeats
    assert used == counts


def packed_ids(rows):
    whole, sequences = {}, {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return whole, sequences


def test_packing(spark, docs, small):
    rows = packing.pack(packing.token_pieces(docs, VOCABULARY, PATTERN, with_ids=True)).collect()
    whole, sequences = packed_ids(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (doc, text), e in zip(small, tokenizer.encode_batch([t for _, t in small], add_special_tokens=False)):
        assert whole[doc] == e.ids + [1]
    assert len(sequences) * 2048 - sum(map(len, whole.values())) < 4096


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack_documents(odd, VOCABULARY, PATTERN).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] in (1, 2)) == 2 and sum(r["doc_id"] == 4 for r in rows) == 2
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack_documents(odd.limit(0), VOCABULARY, PATTERN).count() == 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(sizes[r["doc_id"]] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())


def brute_repeats(rows, window=13):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = text.encode().split()
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i:i + window]), doc) < doc:
                keep[i:i + window] = [False] * window
        kept = [w for w, k in zip(words, keep) if k]
        out[doc] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("group_bytes", [1 << 14, 1 << 23])
def test_repeats(spark, docs, small, group_bytes):
    rows = recompress.remove_repeats(docs, group_bytes=group_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_repeats(small)


def test_repeats_with_runs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b"], int(rng.integers(5, 60)), p=[0.85, 0.15]))) for i in range(120)]
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=900).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=13, max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_equal_windows_have_equal_representatives(before, passage, behind):
    def represented(words):
        names = np.array([0x9E3779B97F4A7C15 * (w + 1) & 0xFFFFFFFFFFFFFFFF for w in words], np.uint64)
        return recompress._representatives(names, np.arange(len(words) - 12))

    alone, inside = represented(passage), represented(before + passage + behind)
    assert alone.tolist() == inside[len(before) : len(before) + len(passage) - 12].tolist()
    assert represented(behind + passage + before)[len(behind) :][: len(alone)].tolist() == alone.tolist()


def test_windows_share_the_symbols_of_a_round():
    names = np.random.default_rng(4).integers(0, 1 << 63, 20_000).astype(np.uint64)
    shape = recompress._representatives(names, np.arange(len(names) - 12))
    assert len(np.unique(shape)) < 0.45 * len(shape)
    symbols = recompress.Symbols(names, np.arange(len(names)), np.arange(1, len(names) + 1))
    for turn in range(1, recompress.ROUNDS + 1):
        merged = recompress._round(symbols, turn)
        assert 0.6 * len(symbols.name) < len(merged.name) < 0.85 * len(symbols.name)
        symbols = merged


def test_repeats_in_a_text_longer_than_a_group(spark):
    rng = np.random.default_rng(5)
    long = [f"w{x}" for x in rng.integers(0, 1 << 40, 400_000)]
    rows = [(1, " ".join(long[1000:1040])), (2, " ".join(long)), (3, "other words " + " ".join(long[250_000:250_060])), (4, " ".join(long[:9] * 40))]
    assert len(rows[1][1]) > recompress.GROUP_BYTES
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


def test_rows_of_one_id_are_spread(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(7, f"{passage} end{i}") for i in range(30)] + [(3, passage)]
    got = recompress.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=300).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(3, 20, 0)] + [(7, 21, 20)] * 30


def test_repeats_of_odd_rows(spark, odd):
    rows = recompress.remove_repeats(odd, with_text=True, others=["source", "g"]).collect()
    assert len(rows) == odd.count() and rows[0]["others"].asDict().keys() == {"source", "g"}
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["n_words"] == 0 and got[9]["n_removed"] == 2999 and got[9]["text"] == ""
    assert got[8]["n_removed"] == 0 and got[None]["n_removed"] == 0
    assert recompress.remove_repeats(odd.limit(0)).count() == 0


def brute_near(rows, n, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for doc, text in rows:
        w = text.encode().translate(lower).split()
        sets[doc] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, small, n, percent):
    rows = neardup.near_duplicates(docs, n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute_near(small, n, percent)


def test_near_duplicates_in_a_large_group(spark):
    """Copies with random edits: many links, found without comparing all pairs, as one component or as brute force says."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            words[at] = f"n{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(rows, 3, 85)


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["n_shingles"], got[1]["component_id"], got[1]["kept"]) == (0, 1, True)
    assert got[None]["component_id"] is None and got[None]["kept"] and got[9]["component_id"] == 8 and not got[9]["kept"]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (205, 200), (205, 203)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op5_attention_quality"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_documents(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    empty = quality.fit(odd.limit(0), labels)
    assert {r["score"] for r in quality.score_documents(odd, empty).collect()} == {0.5}
    assert quality.keep_good(odd, empty).columns == odd.columns and quality.score_documents(odd.limit(0), empty).count() == 0


def test_training_slopes():
    """One step down the slope lowers the loss, for random bags."""
    rng = np.random.default_rng(1)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 80))])
    y = rng.integers(0, 2, 80).astype(float)
    x = rng.normal(size=(bounds[-1], quality.FEATURES))
    x[bounds[:-1]] += 2 * y[:, None]  # one passage of each bag tells
    model = quality.train(x, bounds, y)
    scaled = np.clip((x - model.mean) / model.scale, -8, 8)
    p = quality._forward(model.weights, scaled, bounds[:-1], np.repeat(np.arange(80), np.diff(bounds)))[-1]
    assert ((p > 0.5) == y).mean() > 0.95


def test_language_on_held_out_documents(spark, docs):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_centroid_language"](spark, folder).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97


def test_language_of_odd_rows(spark, odd):
    model = langid.fit(odd)
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[1]["score"] == 0
    assert rows[5]["lang_pred"] in model.languages and langid.identify(odd, model).count() == odd.count()
    none = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(odd.limit(0), model).count() == 0
    far = langid.identify(spark.createDataFrame([(1, "zqx zqx kkjw")], "doc_id long, text string"), langid.fit(odd), reject=True).first()
    assert far["lang_pred"] == "und" or far["near"]


def test_held_out(spark):
    rows = spark.range(200)
    got = {r["id"]: r["h"] for r in rows.select("id", held_out(rows["id"]).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_search_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(1, 300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (401, rows[0][1]), (0, rows[0][1]), (50, None), (100, [1.0, None, 0.0, 0.0]), (150, [float("nan"), 0.0, 0.0, 0.0]),
             (200, [1.0, 2.0]), (None, rows[1][1]), (250, [float("inf")] * 4)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    exact = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all()]
    want, seen = set(), set()
    for qid, q in exact:
        if qid % 50 == 0 and (qid, tuple(q)) not in seen:
            seen.add((qid, tuple(q)))
            best = sorted((-int(q @ v), i) for i, v in exact if i != qid)[:5]
            want |= {(qid, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = pivots.search_top(df).collect()
    assert {tuple(r) for r in got} == want
    assert pivots.search_top(df.limit(0)).count() == 0 and pivots.search_top(df.where("vec_id = 0")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        last, docs = docs, step(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == last.columns
        kept[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(docs.toArrow())
    near = [(r["doc_id"], r["text"]) for r in kept["quality classifier"]]
    assert all(before[d] == t for d, t in near)
    want = {d for d, (_, _, keep) in brute_near(near, 5, 80).items() if keep}
    assert {r["doc_id"] for r in kept["MinHash near-dedup"]} == want
    cut = brute_repeats([(r["doc_id"], r["text"]) for r in kept["MinHash near-dedup"]])
    for r in kept["substring dedup"]:
        words = r["text"].encode().split()
        assert hashlib.sha256(b" ".join(words)).hexdigest() == cut[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    texts = {r["doc_id"]: r["text"] for r in kept["substring dedup"]}
    assert all(texts[r["doc_id"]] == r["text"] for r in kept["mixing"])
    assert sum(r["length"] for r in kept["packing"] if r["start"] == 0) and {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["mixing"]}
