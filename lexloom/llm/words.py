"""Words of UTF-8 texts as numpy arrays, taken straight from Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D. It is named by a 64-bit hash of its
bytes, the same in every task, so equal words have equal names without any coordination.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are in no term: ASCII other than digits and a-z (A-Z is lower-cased before).
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLAB = 1 << 18
PORTION_BYTES = 2 << 20


class Words(NamedTuple):
    """``first[d]:first[d + 1]`` are the words of text d; start and end are byte positions in ``data``."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    name: np.ndarray


def _powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - grows with the longest text
    if len(_kept.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            powers = np.full(max(n, _SLAB + 1), base, np.uint64)
            powers[0] = 1
            _kept[key] = np.cumprod(powers)
    return _kept["up"], _kept["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of what is named a followed by what is named b."""
    return mix64(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one number more than texts); null is empty."""
    array = pc.fill_null(column.cast(pa.large_string()), "")
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans stand in order and do not overlap."""
    names = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(end, low + _SLAB, "right")))
        n = int(end[j - 1] - low)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = start[i:j] - low, end[i:j] - low
        names[i:j] = mix64(((sums[b] - sums[a]) * down[a]) ^ ((b - a).astype(np.uint64) << np.uint64(48)))
        i = j
    return names


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """All words of all texts; ``lower`` turns A-Z into a-z before naming, ``between`` marks the bytes that are in no word."""
    data = _LOWER[data] if lower else data
    inside = ~between[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    edges = offsets[:-1][full]
    begins[edges] = inside[edges]
    edges = offsets[1:][full] - 1
    ends[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, np.searchsorted(start, offsets), start, end, hash_spans(data, start, end))


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of n words and their bounds by text; a shorter text is one shingle, an empty one has none."""
    counts = np.diff(words.first)
    total = len(words.name)
    names = words.name.copy() * np.uint64(0x9FB21C651E98DF25)
    for k in range(1, n):  # texts end where their words end: what reaches over is cut off below
        names[: total - k] = join_names(names[: total - k], words.name[k:])
    per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = []
    for d in short:
        name = words.name[words.first[d] : words.first[d] + 1] * np.uint64(0x9FB21C651E98DF25)
        for k in range(1, counts[d]):
            name = join_names(name, words.name[words.first[d] + k : words.first[d] + k + 1])
        whole.append(mix64(name + np.uint64(counts[d]))[0])
    source = np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], per_text)
    out = names[source] if len(source) else names[:0]
    if len(short):
        out[bounds[:-1][short]] = whole
    return out, bounds


def portions(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` text bytes (or one row), which bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            spent = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, spent + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
