"""Lexical search, decontamination and resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import decontaminate, dualtree, resample
from lexloom.llm.words import NO_TERM, split_words, text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "Ab c7 d e f g h i j k l m n o p q"
ITEMS = [
    (1, PASSAGE), (2, "c7 d e f g h i j k l x"), (3, "two words"), (3, "two words"), (4, None), (5, " ,.! "), (None, "zz yy"), (6, "same " * 12),
    (7, "one"), (8, "Ünïcode and"), (9, "x" * 30_000), (10, "a row without an id but with quite a few words in it to be seen"),
]
MORE = [
    (20, f"head {PASSAGE.upper()} tail two, WORDS"), (21, "b c7 d e f g h i j k l x zz yy"), (22, " ".join([PASSAGE] * 400)), (23, "same " * 9), (24, "d e f g h i j k l"),
    (25, "one two words one"), (25, "one two words one"), (26, "word " * 25), (27, "a b " * 15), (28, "b a " * 15),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def many(odd, spark):
    """The odd rows and some more, with the same extra columns."""
    more = spark.createDataFrame([(i, t, "en", "a", 7, "x", 0.5, 1, "rank") for i, t in MORE], odd.schema)
    return odd.union(more)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in ITEMS], "item_id long, text string, rank int, score long, doc_id string")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), max_size=6))
def test_every_window_holds_a_kept_gram(texts):
    w = split_words(*text_bytes(pa.array(texts, pa.string())), lower=True, between=NO_TERM)
    kept = set(decontaminate.winnow(w)[0].tolist())
    for d in range(len(texts)):
        for i in range(w.first[d], w.first[d + 1] - decontaminate.WINDOW + 1):
            assert any(p in kept for p in range(i, i + decontaminate.WINDOW - decontaminate.GRAM + 1))


def test_spans(many, items):
    want = []
    for doc, text in rows_of(many):
        own, hit, found = words(text), set(), set()
        for item, t in ITEMS:
            w = words(t)
            n = min(len(w), 10)
            windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(own) - n + 1):
                if n and tuple(own[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        want.append((doc, len(own), sorted(hit), sorted(found)))
    got = [(r["doc_id"], r["n_words"], [p for s in r["spans"] for p in range(s["start"], s["end"])], r["items"])
           for r in decontaminate.contaminated_spans(many, items).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_full_filter_loses_nothing(many, items, monkeypatch):
    whole = sorted(map(str, decontaminate.contaminated_spans(many, items).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_WORDS", 2)
    assert sorted(map(str, decontaminate.contaminated_spans(many, items).collect())) == whole


def brute_search(docs, queries, k):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for doc, c, n in counted:
            m = 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


@pytest.mark.parametrize("block", [1 << 18, 20])
def test_search(many, items, monkeypatch, block):
    monkeypatch.setattr(dualtree, "BLOCK_TERMS", block)
    got = [tuple(r) for r in dualtree.search_lexical(many, items, k=4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_search(rows_of(many), ITEMS, 4)))


def test_search_prunes_and_stays_whole(docs, small, spark, sf_dir, monkeypatch):
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_search(small, [(r["item_id"], r["text"]) for r in queries.collect()], 5)
    for name, value in (("LEAF", 4), ("BRANCH", 3), ("GROUP", 2), ("CELLS", 512)):
        monkeypatch.setattr(dualtree, name, value)
    assert sorted(tuple(r) for r in dualtree.search_lexical(docs, queries, k=5).collect()) == sorted(want)


def test_products_and_maxima():
    rng = np.random.default_rng(3)
    def table(rows):
        dense = rng.integers(0, 9, (rows, 11)) * (rng.random((rows, 11)) < 0.4)
        return dense, dualtree.Sparse(np.concatenate([[0], np.cumsum((dense > 0).sum(1))]), np.nonzero(dense)[1], dense[dense > 0])
    (a, left), (b, right) = table(23), table(7)
    assert (dualtree._products(left, dualtree._by_term(right, 11), 7) == a @ b.T).all()
    highest = dualtree._maxima(left, 5)
    for node in range(5):
        dense = np.zeros(11, int)
        dense[highest.term[highest.first[node]:highest.first[node + 1]]] = highest.value[highest.first[node]:highest.first[node + 1]]
        assert (dense == a[node * 5:(node + 1) * 5].max(axis=0)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBz9 é\n-"), max_size=30), st.just("y" * 200 + " b " + "z" * 65)), max_size=6))
def test_runs_have_their_checksums(texts):
    runs = resample.word_runs(pa.array(texts, pa.string()))
    for d, text in enumerate(texts):
        own = words(text)
        assert runs.first[d + 1] - runs.first[d] == len(own)
        for k in range(3):
            want = [zlib.crc32(" ".join(own[i:i + k + 1]).encode()) % 10_000 if i + k < len(own) else 10_000 for i in range(len(own))]
            assert runs.buckets[k][runs.first[d]:runs.first[d + 1]].tolist() == want


def test_resample(many, items):
    def features(text):
        own = words(text)
        return [zlib.crc32(" ".join(own[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(own) - k + 1)]
    docs = rows_of(many)
    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for _, x in ITEMS for f in features(x))
    want, fit = [], []
    for doc, text in docs:
        own = features(text)
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * (s.total() + 10_000) / ((s[f] + 1) * (t.total() + 10_000)))) for f in own)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((doc, len(words(text)), len(own), weight, score))
        fit.append(len(words(text)) >= 20)
    best = sorted((x for x, f in zip(want, fit) if f), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))[: sum(fit) * 40 // 100]
    got = [tuple(r) for r in resample.resample(many, items, percent=40).collect()]
    assert sorted(map(str, (g[:5] for g in got))) == sorted(map(str, want))
    assert [g[:5] for g in sorted((g for g in got if g[5] is not None), key=lambda g: g[5])] == best and len(best) > 2
    assert sorted(g[5] for g in got if g[5] is not None) == list(range(1, len(best) + 1))


def test_empty_tables(many, items):
    none, no_items = many.limit(0), items.limit(0)
    for docs, wanted in ((none, items), (many, no_items), (none, no_items)):
        n = 0 if docs is none else many.count()
        assert dualtree.search_lexical(docs, wanted).count() == 0
        spans = decontaminate.contaminated_spans(docs, wanted).collect()
        assert len(spans) == n and not any(r["spans"] or r["items"] for r in spans)
        assert resample.resample(docs, wanted).count() == n
