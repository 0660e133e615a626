"""Repeated rows, rows without an id and literals of added tokens, against brute force."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import mixing, packing

COLUMNS = "doc_id long, text string, source string"


def test_mixed_rows_straddling_the_cut(spark):
    """100 equal rows of weight 5 and 100 rows of weight 2, 10 words each: 1428 and 571 words of 2000."""
    docs = spark.createDataFrame([(1, "w " * 10, "a")] * 100 + [(i, "w " * 10, "b") for i in range(100, 200)], COLUMNS)
    wanted = Counter()
    for r in mixing.mix(docs, keep_source=True).collect():
        wanted[r["source"]] += r["taken"] // r["size"]
    got = Counter(r["source"] for r in mixing.mix_rows(docs).collect())
    assert got == wanted and abs(got["a"] - 143) <= 1 and 198 <= sum(got.values()) <= 200


def brute_mix(rows, targets):
    """Copies of every place in its source's queue, up to the total of all sizes; rows are (source, place, size)."""
    copies, upto, total = [], Counter(), sum(r[2] for r in rows)
    sizes = Counter()
    for source, _, size in rows:
        sizes[source] += size
    ranks = {s: i for i, s in enumerate(sorted(sizes))}
    for i, (source, place, size) in enumerate(sorted(rows)):
        upto[source] += size
        copies += [((p * sizes[source] + upto[source]) / targets[source], ranks[source], p, i, source, size) for p in range(3)]
    used, out = 0, Counter()
    for *_, i, source, size in sorted(copies):
        if used + size > total:
            break
        used += size
        out[source, i] += 1
    return out


def test_multiplicities_of_the_mix(spark):
    """Rows with equal ids, or none, and different texts: every row at most three times, sources as brute force says."""
    texts = [f"t{i} " + "w " * 9 for i in range(40)]
    docs = spark.createDataFrame([(None, t, "a") for t in texts] + [(7, t, "b") for t in texts for _ in range(2)] + [(7, "same " * 10, "c")] * 60, COLUMNS)
    targets = {r["source"]: r["target"] for r in mixing.mix(docs, keep_source=True).collect()}
    given = docs.collect()
    brute = brute_mix([(r["source"], i, 10) for i, r in enumerate(given)], targets)
    rows = mixing.mix_rows(docs).collect()
    of_source = Counter()
    for (source, _), times in brute.items():
        of_source[source] += times
    assert Counter(r["source"] for r in rows) == of_source
    of_text, copies = Counter((r["source"], r["text"]) for r in rows), Counter((r["source"], r["text"]) for r in given)
    assert all(n <= 3 * copies[k] for k, n in of_text.items()) and len(rows) <= len(given)
    assert Counter((r["source"], r["text"]) for r in mixing.mix_rows(docs.repartition(5)).collect()) == of_text


@pytest.mark.parametrize("texts", [["a <|endoftext|> b"], [
    "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n\n z", " \t<|endoftext|>  ", "<|endoftext|", "a<|endoftext|>\u00a0 b\u3000<|endoftext|>'s",
    "plain text", "\u2003<|endoftext|>\u2003\u2003x", "<|endoftext|>'ll  123<|endoftext|>4"]])
def test_literals_of_added_tokens(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert len(texts) > 1 or rows[0]["ids"] == [64, 220, 50256, 275, 1]


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b.replace("b59", "other")
    docs = spark.createDataFrame([(3, a, "s"), (3, a, "s"), (2, a, "t"), (2, a, "t"), (None, a, "s"), (None, b, "s"), (None, b, "s"), (None, near, "s"),
                                  (3, c, "s"), (None, "", "s"), (None, None, "s"), (9, "", "s"), (9, "", "s")], COLUMNS)
    rows = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert [r[:2] for r in rows if r[1] == a] == [(2, a)] and [r[:2] for r in rows if r[1] == c] == [(3, c)]
    assert len([r for r in rows if r[1] in (b, near)]) == 1
    assert len([r for r in rows if not r[1]]) == 4  # texts without words are near nothing
