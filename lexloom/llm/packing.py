"""Pack token sequences with little padding: minimum bin slack by subset sums over remaining lengths."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.prefix import running_sums
from lexloom.llm.words import hash_spans, portions, split_words, text_bytes
from lexloom.runtime import stage

#: Slots of a worker's table of known units, and token ids kept for them.
UNIT_SLOTS = 1 << 20
UNIT_IDS = 4 << 20
#: Tokens that the vocabulary's tokenizer adds to it: their literals are cut out of a text before all else.
ADDED = {"<|endoftext|>": 50256}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class UnitTokenizer:
    """Byte-level BPE of whole texts, remembering the ids of frequent units.

    A unit is a word with the white space before it. The vocabulary's splitting pattern never joins
    letters across white space, so the ids of a text are those of its units in turn; texts with
    white space outside ASCII, for which that does not hold, are encoded in one piece. The literal
    of an added token is that token, wherever it stands in a word.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)
        self.clear()

    def encode(self, text: str) -> list[int]:
        if any(literal in text for literal in ADDED):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)

    def clear(self) -> None:
        self.keys = np.zeros(UNIT_SLOTS, np.uint64)
        self.at, self.size = np.zeros(UNIT_SLOTS, np.int32), np.zeros(UNIT_SLOTS, np.int16)
        self.pool, self.used = np.zeros(UNIT_IDS, np.uint32), 0

    def _slots(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each name, and whether the name is there."""
        mask = np.uint64(UNIT_SLOTS - 1)
        slot = (names & mask).astype(np.int64)
        there = self.keys[slot] == names
        other = np.flatnonzero(~there)
        second = ((names[other] >> np.uint64(32)) & mask).astype(np.int64)
        found = self.keys[second] == names[other]
        slot[other[found]] = second[found]
        there[other[found]] = True
        return slot, there

    def units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        names = hash_spans(data, start, end)
        slot, there = self._slots(names)
        missing = np.flatnonzero(~there)
        size = np.empty(len(names), np.int64)
        source = np.empty(len(names), np.int64)
        size[there], source[there] = self.size[slot[there]], self.at[slot[there]]
        pool = self.pool
        if len(missing):
            _, first, back = np.unique(names[missing], return_index=True, return_inverse=True)
            new = missing[first]
            raw = data.tobytes()
            ids = [self.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[new].tolist(), end[new].tolist())]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.uint32, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
            pool = np.concatenate([self.pool[: self.used], flat])
            size[missing], source[missing] = sizes[back], self.used + begins[back]
            self._remember(names[new], sizes, flat, begins)
        total = int(size.sum())
        before = np.cumsum(size) - size
        return pool[np.arange(total) + np.repeat(source - before, size)], size

    def _remember(self, names: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> None:
        if self.used + len(flat) > UNIT_IDS:
            self.clear()
        if len(flat) > UNIT_IDS:
            return
        mask = np.uint64(UNIT_SLOTS - 1)
        slot = (names & mask).astype(np.int64)
        taken = self.keys[slot] != 0
        slot[taken] = ((names[taken] >> np.uint64(32)) & mask).astype(np.int64)
        keep = sizes < 1 << 15
        self.keys[slot[keep]] = names[keep]
        # Of names that meet in one slot the last stays, and its key with it.
        self.at[slot[keep]], self.size[slot[keep]] = (self.used + begins[keep]), sizes[keep]
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        words = split_words(data, offsets)
        n = len(offsets) - 1
        counts = np.diff(words.first)
        last = np.where(counts > 0, words.end[np.minimum(words.first[1:], len(words.end)) - 1] if len(words.end) else 0, offsets[:-1])
        tail = last < offsets[1:]  # white space after the last word is a unit of its own
        text = np.concatenate([np.repeat(np.arange(n), counts), np.flatnonzero(tail)])
        end = np.concatenate([words.end, offsets[1:][tail]])
        order = np.argsort(end, kind="stable") if tail.any() else slice(None)
        text, end = text[order], end[order]
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        odd = np.unique(np.searchsorted(offsets, _odd_spaces(data), "right") - 1)
        ids, size = self.units(data, start, end)
        per_text = np.bincount(text, weights=size, minlength=n).astype(np.int64)
        if not len(odd):
            return ids, per_text
        begins, parts, done = np.cumsum(per_text) - per_text, [], 0
        for d in odd.tolist():
            own = np.array(self.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
            parts += [ids[done : begins[d]], own]
            done = begins[d] + per_text[d]
            per_text[d] = len(own)
        return np.concatenate([*parts, ids[done:]]), per_text


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII begins."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | (
        (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
    return lead[two | three]


_TOKENIZERS: dict[tuple[str, str], UnitTokenizer] = {}


def _pieces(vocabulary: str, pattern: str, window: int, end_id: int, with_ids: bool) -> Callable:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get((vocabulary, pattern))
        if tokenizer is None:  # one for each worker process
            tokenizer = _TOKENIZERS[vocabulary, pattern] = UnitTokenizer(vocabulary, pattern)
        for batch in portions(batches, "text"):
            flat, counts = tokenizer.texts(*text_bytes(batch.column("text")))
            n = len(counts)
            ids = np.empty(len(flat) + n, np.dtype("<u4"))
            ends = np.cumsum(counts + 1)
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = flat
            ids[ends - 1] = end_id
            pieces = (counts + window) // window  # of counts + 1 ids
            text = np.repeat(np.arange(n), pieces)
            start = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, (counts + 1)[text] - start)
            low = (ends - counts - 1)[text] + start
            bounds = list(zip(low.tolist(), (low + length).tolist()))
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in bounds]
            out = [batch.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array((counts + 1)[text])]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    return cut


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every text's token ids, with ``end_id`` after them, into pieces of ``window`` and a remainder.

    ``vocabulary`` is a file of base64 tokens and ranks that every executor has. A null or empty
    text has the end id alone. ``with_ids`` adds the ids themselves as an array.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(vocabulary, pattern, window, end_id, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def fill_windows(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Use up a multiset of lengths (length -> how many): patterns (length -> times) and their repeats.

    The longest length left opens a window; a bitset of reachable sums over the lengths left finds
    the fill closest to the window, and walking the bitsets back tells the lengths used. A pattern
    repeats while the counts last, so the work depends on the number of different lengths, not on
    the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    patterns = []
    while left:
        opening = max(left)
        room = window - opening
        mask, reached, steps = (1 << (room + 1)) - 1, 1, []
        for n in sorted(left, reverse=True):
            spare, take = min(left[n] - (n == opening), room // n), 1
            while spare > 0 and not reached >> room & 1:
                take = min(take, spare)
                steps.append((n, take, reached))
                reached |= reached << (n * take) & mask
                spare, take = spare - take, take * 2
            if reached >> room & 1:
                break
        at, used = reached.bit_length() - 1, {opening: 1}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                at -= n * take
                used[n] = used.get(n, 0) + take
        repeats = min(left[n] // times for n, times in used.items())
        patterns.append((used, repeats))
        for n, times in used.items():
            left[n] -= times * repeats
            if not left[n]:
                del left[n]
    return patterns


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Give every piece (doc_id, start, length, ids_crc32 ...) a sequence_id and an offset there.

    Only the histogram of lengths, at most ``window`` numbers, and the patterns that use it up
    come to the driver. A piece's place among the pieces of its length, counted over range
    partitions, picks its pattern and repeat. An empty table gives no rows; equal pieces take
    places in any order.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if max(histogram, default=0) > window:
        raise ValueError("a piece is longer than the window")
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, repeats in fill_windows(histogram, window):
        offset = 0
        for n, times in sorted(pattern.items(), reverse=True):
            rows.append((n, used[n], used[n] + times * repeats, times, sequence, offset))
            used[n] += times * repeats
            offset += n * times
        sequence += repeats
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _times long, _sequence long, _offset long")
    ranked = running_sums(pieces.withColumn("_one", F.lit(1).cast("long")), ["doc_id", "start", "ids_crc32"], ["_one"], ["length"])
    rank = F.col("_one_upto") - 1
    # The plan has a few rows for each length up to the window: its size does not grow with the corpus.
    placed = ranked.join(F.broadcast(plan), "length").where((rank >= F.col("_from")) & (rank < F.col("_to")))
    nth = rank - F.col("_from")
    return placed.select(*pieces.columns, (F.col("_sequence") + F.floor(nth / F.col("_times"))).alias("sequence_id"),
                         (F.col("_offset") + F.pmod(nth, F.col("_times")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, window: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: one row per piece. Repeated documents are packed each; other columns are ignored."""
    return pack(stage(token_pieces(docs, vocabulary, pattern, window, 1, id_col, text_col), "token-pieces"), window)
