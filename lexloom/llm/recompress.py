"""Repeated passages across documents, found by recompression and removed.

The words of all texts are rewritten in rounds. In each round equal neighbours merge into a run and
then a left symbol merges with a right symbol behind it, where a bit of the name tells left from
right; a merged symbol takes a new name. A name is a hash of what it stands for, so equal runs and
pairs have equal names everywhere and naming needs no exchange between tasks. Each symbol knows
the words that decide it: wherever these words stand, the same symbol stands.

A window is represented by symbols of the last round that its own words decide: by the chain of
three neighbours with the least name, or of two, or by one. Windows that decide no symbol (parts
of a longer run, say) represent themselves. Equal windows have equal representatives, so a window
can only repeat if its representative does. Shared representatives are counted first; only the
windows that have one are then named as a whole and compared, with the smallest document of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.llm.words import Words, join_names, mix64, owners, split_words, text_bytes

WINDOW = 13
#: Rounds of merging, and how many neighbouring symbols of the last round represent a window.
ROUNDS = 2
CHAIN = 3
#: Text bytes of the documents that one task holds at a time.
GROUP_BYTES = 4 << 20
#: Text bytes of a group for each bucket that its names are dealt to: about 16 names go together.
BUCKET_BYTES = 512
#: Groups for each bucket at most, which bounds a bucket for a corpus of any size.
BUCKET_GROUPS = 4
MESSAGE = "g long, bucket long, kind int, names binary, more binary, docs binary"


class Symbols(NamedTuple):
    name: np.ndarray
    low: np.ndarray  # the words low:high decide that the symbol is there
    high: np.ndarray


class Parsed(NamedTuple):
    words: Words
    ids: np.ndarray
    known: np.ndarray  # texts that have an id
    start: np.ndarray  # first word of each window, of texts with an id
    text: np.ndarray  # text of each window
    shape: np.ndarray  # name of the window's representative


def _is_left(names: np.ndarray, turn: int) -> np.ndarray:
    return (mix64(names ^ np.uint64(turn * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)


def _round(symbols: Symbols, turn: int) -> Symbols:
    """One round: equal neighbours merge into a run, then a left symbol and the right symbol behind it into a pair.

    What becomes of a symbol depends on its neighbours only, so the words that decide a merged
    symbol are those that decide its parts and the symbol on either side. At the ends of the words
    there is no such symbol; what stands there is decided by no window.
    """
    name, n = symbols.name, len(symbols.name)
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    length = np.diff(np.append(first, n))
    base = name[first]
    run = np.where(length > 1, join_names(base, length.astype(np.uint64)), base)
    left = _is_left(base, turn)
    begins = np.concatenate([[True], ~(left[:-1] & ~left[1:])])
    at = np.flatnonzero(begins)
    upto = np.append(at[1:], len(first))
    merged = np.where(upto - at > 1, join_names(run[at], run[upto - 1]), run[at])
    before, behind = first[at] - 1, np.append(first, n)[upto]
    low = np.where(before >= 0, symbols.low[before], -1)
    high = np.where(behind < n, symbols.high[np.minimum(behind, n - 1)], symbols.high[-1] + 1)
    return Symbols(merged, low, high)


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each range, none of which is empty or longer than a window."""
    out, size, width = np.empty(len(begin), np.uint64), end - begin, 1
    while True:
        these = np.flatnonzero((size >= width) & (size < 2 * width))
        out[these] = np.minimum(values[begin[these]], values[end[these] - width])
        if 2 * width > WINDOW or len(values) <= width:
            return out
        values, width = np.minimum(values[:-width], values[width:]), 2 * width


def _representatives(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each window the name of its representative."""
    symbols = Symbols(names, np.arange(len(names)), np.arange(1, len(names) + 1))
    for turn in range(1, ROUNDS + 1):
        symbols = _round(symbols, turn)
    shape, open_ = np.empty(len(start), np.uint64), np.arange(len(start))
    for count in range(CHAIN, 0, -1):
        chains = len(symbols.name) - count + 1
        if chains < 1:
            continue
        chain = symbols.name[:chains]
        for k in range(1, count):
            chain = join_names(chain, symbols.name[k : chains + k])
        begin = np.searchsorted(symbols.low[:chains], start[open_], "left")
        end = np.searchsorted(symbols.high[count - 1 :], start[open_] + WINDOW, "right")
        inside = end > begin
        shape[open_[inside]] = mix64(_least(chain, begin[inside], end[inside]) + np.uint64(count))
        open_ = open_[~inside]
    whole = names[start[open_]]
    for k in range(1, WINDOW):
        whole = join_names(whole, names[start[open_] + k])
    shape[open_] = whole
    return shape


def _parse(table: pa.Table) -> Parsed:
    column = table.column("doc_id")
    known = ~np.asarray(column.is_null())
    ids = column.fill_null(0).to_numpy()
    words = split_words(*text_bytes(table.column("text")))
    per_text = np.where(known, np.maximum(np.diff(words.first) - WINDOW + 1, 0), 0)
    text = np.repeat(np.arange(len(ids)), per_text)
    start = np.arange(len(text)) + np.repeat(words.first[:-1] - (np.cumsum(per_text) - per_text), per_text)
    shape = _representatives(words.name, start) if len(start) else np.zeros(0, np.uint64)
    return Parsed(words, ids, known, start, text, shape)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Names are spread evenly, so equal ranges of their upper half are buckets, and sorting keeps buckets together."""
    return (names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _shapes(parsed: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """The group's distinct representatives, sorted, and which of them several documents have."""
    shape, doc = parsed.shape, parsed.ids[parsed.text]
    if not len(shape):
        return shape, np.zeros(0, bool)
    change = np.concatenate([[True], (shape[1:] != shape[:-1]) | (doc[1:] != doc[:-1])])
    shape, doc = shape[change], doc[change]
    order = np.lexsort((doc, shape))
    shape, doc = shape[order], doc[order]
    new = np.concatenate([[True], shape[1:] != shape[:-1]])
    first = np.flatnonzero(new)
    several = np.zeros(len(first), bool)
    several[np.unique(np.cumsum(new)[1:][~new[1:] & (doc[1:] != doc[:-1])] - 1)] = True
    return shape[first], several


def _names(parsed: Parsed, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of the chosen windows, by doubling."""
    out = []
    for names in (parsed.words.name, mix64(parsed.words.name ^ np.uint64(0xA24BAED4963EE407))):
        two = join_names(names[:-1], names[1:])
        four = join_names(two[:-2], two[2:])
        at = parsed.start[chosen]
        out.append(join_names(join_names(join_names(four[at], four[at + 4]), four[at + 8]), names[at + 12]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


class Named(NamedTuple):
    chosen: np.ndarray  # windows
    entry: np.ndarray  # of each chosen window
    name: np.ndarray  # of each entry, sorted
    more: np.ndarray
    doc: np.ndarray  # smallest id in the group


def _named(parsed: Parsed, shapes: np.ndarray, shared: np.ndarray) -> Named:
    chosen = np.flatnonzero(shared[np.searchsorted(shapes, parsed.shape)]) if len(shapes) else np.zeros(0, np.int64)
    if not len(chosen):
        none = np.zeros(0, np.int64)
        return Named(none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint32), none)
    name, more = _names(parsed, chosen)
    doc = parsed.ids[parsed.text[chosen]]
    order = np.lexsort((doc, more, name))
    name, more = name[order], more[order]
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (more[1:] != more[:-1])])
    entry = np.empty(len(chosen), np.int64)
    entry[order] = np.cumsum(new) - 1
    return Named(chosen, entry, name[new], more[new], doc[order][new])


def _messages(g: int, buckets: int, kind: int, names: np.ndarray, more: np.ndarray | None, docs: np.ndarray | None) -> list[tuple]:
    bucket = _bucket(names, buckets).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    out = []
    for a, b in zip(edges, [*edges[1:], len(bucket)]):
        out.append((g, int(bucket[a]), kind, names[a:b].tobytes(), None if more is None else more[a:b].tobytes(), None if docs is None else docs[a:b].tobytes()))
    return out


def _as_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["g", "bucket", "kind", "names", "more", "docs"])


def _bits(replies: pa.Table, kind: int, sizes: np.ndarray) -> np.ndarray:
    """Answers to what the group asked, in the order of its names: one bit for each."""
    out = []
    rows = sorted((r for r in replies.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    for row in rows:
        out.append(np.unpackbits(np.frombuffer(row["names"], np.uint8), count=int.from_bytes(row["docs"], "little")))
    found = np.concatenate(out).astype(bool) if out else np.zeros(0, bool)
    if len(found) != sizes:
        raise ValueError("an answer is missing")
    return found


def _packed(bits: np.ndarray) -> tuple[bytes, None, bytes]:
    return np.packbits(bits).tobytes(), None, len(bits).to_bytes(8, "little")


def _ask_shapes(buckets: int) -> Callable:
    def ask(table: pa.Table) -> pa.Table:
        shapes, several = _shapes(_parse(table))
        return _as_table(_messages(table.column("g")[0].as_py(), buckets, 1, shapes, several.view(np.uint8), None))

    return ask


def _joined(table: pa.Table, column: str, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def _answer_shapes(table: pa.Table) -> pa.Table:
    """Which representatives several documents have, of one group or of several."""
    names, sizes = _joined(table, "names", np.uint64)
    several = _joined(table, "more", np.uint8)[0].astype(bool)
    _, back, counts = np.unique(names, return_inverse=True, return_counts=True)
    shared = several | (counts[back] > 1)
    parts = np.split(shared, np.cumsum(sizes)[:-1])
    return _as_table([(g, b, 1, *_packed(p)) for g, b, p in zip(table.column("g").to_pylist(), table.column("bucket").to_pylist(), parts)])


def _ask_windows(buckets: int) -> Callable:
    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _as_table([])
        g, parsed = table.column("g")[0].as_py(), _parse(table)
        shapes, _ = _shapes(parsed)
        shared = _bits(replies, 1, len(shapes))
        named = _named(parsed, shapes, shared)
        # The answer to the first question travels on with the second one.
        return _as_table([(g, g % buckets, 1, *_packed(shared)), *_messages(g, buckets, 2, named.name, named.more, named.doc)])

    return ask


def _answer_windows(table: pa.Table) -> pa.Table:
    """Which windows start in a smaller document elsewhere; earlier answers pass through."""
    kind = table.column("kind").to_numpy()
    rows = [tuple(r.values()) for r in table.filter(pa.array(kind == 1)).to_pylist()]
    table = table.filter(pa.array(kind == 2))
    if table.num_rows:
        (names, sizes), more, docs = _joined(table, "names", np.uint64), _joined(table, "more", np.uint32)[0], _joined(table, "docs", np.int64)[0]
        order = np.lexsort((docs, more, names))
        name, other = names[order], more[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (other[1:] != other[:-1])])
        least = np.empty(len(docs), np.int64)
        least[order] = docs[order][new][np.cumsum(new) - 1]
        parts = np.split(least < docs, np.cumsum(sizes)[:-1])
        rows += [(g, b, 2, *_packed(p)) for g, b, p in zip(table.column("g").to_pylist(), table.column("bucket").to_pylist(), parts)]
    return _as_table(rows)


def _cut(with_text: bool, schema: pa.Schema) -> Callable:
    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        parsed = _parse(table)
        words, n = parsed.words, table.num_rows
        shapes, _ = _shapes(parsed)
        named = _named(parsed, shapes, _bits(replies, 1, len(shapes)))
        earlier = _bits(replies, 2, len(named.name))
        repeated = named.chosen[earlier[named.entry] | (parsed.ids[parsed.text[named.chosen]] > named.doc[named.entry])]
        steps = np.zeros(len(words.name) + 1, np.int64)
        np.add.at(steps, parsed.start[repeated], 1)
        np.add.at(steps, parsed.start[repeated] + WINDOW, -1)
        removed = np.cumsum(steps[:-1]) > 0
        counts = np.diff(words.first)
        gone = np.bincount(owners(words.first), weights=removed, minlength=n).astype(np.int64)
        data, offsets = text_bytes(table.column("text"))
        raw, kept, digests = data.tobytes(), [], []
        for i in range(n):
            text, low, high = raw[offsets[i] : offsets[i + 1]], words.first[i], words.first[i + 1]
            own = text.split()
            left = b" ".join(compress(own, (~removed[low:high]).tolist()) if gone[i] else own)
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(_segments(raw, words, removed, low, high) if gone[i] else text)
        columns = {"doc_id": table.column("doc_id"), "n_words": pa.array(counts), "n_removed": pa.array(gone), "kept_sha256": pa.array(digests)}
        if with_text:
            texts = [x.decode() for x in kept]
            columns["text"] = pa.array([y if there else None for y, there in zip(texts, table.column("text").is_valid().to_pylist())], pa.string())
        return pa.table([columns[f.name] if f.name in columns else table.column(f.name) for f in schema], schema=schema)

    return cut


def _segments(raw: bytes, words: Words, removed: np.ndarray, low: int, high: int) -> bytes:
    """What is left of a text, with its own white space inside each stretch that stays."""
    stays = np.concatenate([[False], ~removed[low:high], [False]])
    begins, ends = np.flatnonzero(stays[1:] & ~stays[:-1]), np.flatnonzero(~stays[1:] & stays[:-1])
    return b" ".join(raw[words.start[low + a] : words.end[low + b - 1]] for a, b in zip(begins.tolist(), ends.tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   others: Sequence[str] = (), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Remove every word covered by a 13-word window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by one
    space), with ``with_text`` the text that is left, and the columns named in ``others`` as one
    struct of that name. Windows are judged on the input. Documents are dealt to groups of about ``group_bytes`` text by a hash
    of their id and text; a group tells each of its distinct representatives once, however many of its
    documents have it, so a passage that a third of all documents share is told once a group. An
    answer is one bit for each name asked. All three passes read one shuffle of the texts.

    A null text has no words and stays null. Rows that share an id are never each other's smaller
    document. A row with a null id loses nothing and makes no other lose. An empty table gives no
    rows; columns not named are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    buckets = max(1, min(groups, max(group_bytes // BUCKET_BYTES, groups // BUCKET_GROUPS)))
    spread = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    dealt = docs.select(F.pmod(spread, F.lit(groups)).alias("g"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        *([F.struct(*[F.col(c) for c in others]).alias("others")] if others else []))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept_sha256", T.StringType()), *([T.StructField("text", T.StringType())] if with_text else []),
                        *([dealt.schema["others"]] if others else [])])
    schema = to_arrow_schema(out)
    asked = dealt.groupBy("g").applyInArrow(_ask_shapes(buckets), MESSAGE)
    told = asked.groupBy("bucket").applyInArrow(_answer_shapes, MESSAGE)
    asked = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_ask_windows(buckets), MESSAGE)
    told = asked.groupBy("bucket").applyInArrow(_answer_windows, MESSAGE)
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_cut(with_text, schema), out)
