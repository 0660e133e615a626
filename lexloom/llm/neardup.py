"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.links import components
from lexloom.llm.words import join_names, mix64, portions, shingles, split_words, text_bytes
from lexloom.runtime import stage

#: Minima kept of each; four make a band, and 4 low bits of each stay in the signature.
MINIMA, BAND, BITS = 96, 4, 4
LONGS = MINIMA * BITS // 64
#: Members of a hub's surroundings, and bytes of their sets, that meet as many others in one task; shingles counted at a time.
BLOCK, BLOCK_BYTES, KINDS = 512, 16 << 20, 4096
SIGNATURE = ", ".join(f"s{i} long" for i in range(LONGS))


def _sets(words_per_shingle: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text, sorted, and their bounds by text."""
    names, bounds = shingles(split_words(data, offsets, lower=True), words_per_shingle)
    new = np.ones(len(names), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            own = names[a:b]
            own.sort()
            new[a + 1 : b] = own[1:] != own[:-1]
    upto = np.concatenate([[0], np.cumsum(new)])
    return names[new], upto[bounds]


def _minima(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(MINIMA, texts) least 32-bit hashes; every text has at least one name."""
    rng = np.random.default_rng(7)
    factors, shifts = rng.integers(1, 1 << 32, MINIMA, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, MINIMA, np.uint32)
    short = (names >> np.uint64(32)).astype(np.uint32)
    out = np.empty((MINIMA, len(starts)), np.uint32)
    hashed, folded = np.empty_like(short), np.empty_like(short)
    for i in range(MINIMA):
        np.multiply(short, factors[i], out=hashed)
        hashed += shifts[i]
        np.right_shift(hashed, np.uint32(15), out=folded)
        hashed ^= folded
        hashed *= np.uint32(0x2C1B3C6D)
        out[i] = np.minimum.reduceat(hashed, starts)
    return out


def _signatures(words_per_shingle: int) -> Callable:
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            names, bounds = _sets(words_per_shingle, *text_bytes(batch.column("text")))
            n = batch.num_rows
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands, packed = np.zeros((n, MINIMA // BAND), np.uint64), np.zeros((n, LONGS), np.uint64)
            if len(full):
                starts = bounds[:-1][full]
                k1[full] = np.add.reduceat(mix64(names), starts)
                k2[full] = np.add.reduceat(mix64(names ^ np.uint64(0x5851F42D4C957F2D)), starts)
                least = _minima(names, starts).astype(np.uint64)
                for j in range(MINIMA // BAND):
                    key = np.full(len(full), j + 1, np.uint64)
                    for r in least[j * BAND : (j + 1) * BAND]:
                        key = join_names(key, r)
                    bands[full, j] = key
                for i in range(MINIMA):
                    packed[full, i * BITS // 64] |= (least[i] & np.uint64((1 << BITS) - 1)) << np.uint64(i * BITS % 64)
            flat = pa.array(bands[full].reshape(-1).view(np.int64))
            at = np.concatenate([[0], np.cumsum((size > 0) * (MINIMA // BAND))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 *[pa.array(packed[:, i].copy().view(np.int64)) for i in range(LONGS)], pa.ListArray.from_arrays(pa.array(at), flat)],
                names=["doc_id", "n_shingles", "k1", "k2", *[f"s{i}" for i in range(LONGS)], "bands"])

    return sign


def likeness(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal b-bit minima, less those that agree by chance."""
    different: Column = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        for k in (1, 2):  # any of the four bits, in the lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        different = different + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0 ** -BITS
    return ((1 - different / MINIMA) - chance) / (1 - chance)


def _compare(words_per_shingle: int, percent: int) -> Callable:
    """Pairs whose whole sets overlap enough."""
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text_a", 1 << 20):
            a, x = _sets(words_per_shingle, *text_bytes(batch.column("text_a")))
            b, y = _sets(words_per_shingle, *text_bytes(batch.column("text_b")))
            near = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = a[x[i] : x[i + 1]], b[y[i] : y[i + 1]]
                if min(len(p), len(q)) * 100 < percent * max(len(p), len(q)) or not len(p):
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                near[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return compare


def _keep_sets(words_per_shingle: int) -> Callable:
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            names, bounds = _sets(words_per_shingle, *text_bytes(batch.column("text")))
            sets = [names[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "names"])

    return keep


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many names each left set shares with each right one, KINDS names at a time."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    kinds, item, counts = np.unique(flat, return_inverse=True, return_counts=True)
    row, item = row[counts[item] > 1], (np.cumsum(counts > 1) - 1)[item[counts[item] > 1]]
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((counts > 1).sum()), KINDS):
        i, j = np.searchsorted(item, (first, first + KINDS))
        marks = np.zeros((len(left) + len(right), KINDS), np.float32)
        marks[row[i:j], item[i:j] - first] = 1
        out += marks[: len(left)] @ marks[len(left) :].T
    return out.astype(np.int64)


def _within(percent: int) -> Callable:
    """Links between two blocks of one hub's surroundings that join different components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def within(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        node, block, component = (table.column(c).to_numpy() for c in ("node", "block", "component"))
        names = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        if len(left) and len(right) and len(np.unique(component)) > 1:
            common = _common([names[i] for i in left], [names[i] for i in right])
            size = np.array([len(x) for x in names])
            union = size[left][:, None] + size[right][None, :] - common
            near = (100 * common >= percent * union) & (component[left][:, None] != component[right][None, :])
            for i, j in zip(*np.nonzero(near)):
                p, q = find(int(component[left[i]])), find(int(component[right[j]]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(node[left[i]]), int(node[right[j]])))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return within


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    margin: float = 0.16) -> DataFrame:
    """Group documents whose shingle sets overlap by ``percent`` of their union: doc_id, n_shingles, component_id, kept.

    A-Z count as a-z; a text of fewer words is one shingle; an empty or null text has none and is
    linked with nothing. Documents with equal sets become one node first, so copies cost nothing
    later. Nodes that agree in one of 24 bands of four minima are candidates: at the threshold a
    link is missed with a chance below 1e-5. The packed b-bit signatures estimate their likeness,
    corrected for chance; who comes within ``margin`` (about four standard errors) of what is asked
    is compared on the whole sets.

    A bucket is not expanded into its pairs. Its hub is the member that meets most others over all
    bands, the middle of a group of copies, and every member is compared with it; links are joined
    to components. A hub whose surroundings (the members of all its buckets) all lie in one component is
    settled. The others' surroundings are dealt to blocks of bounded size, two of which meet in one
    task on whole sets; only links that join components leave it. Members that are like each
    other, but less than asked, are thus counted by blocks: the rows sent grow with the square of
    the number of blocks, by ``BLOCK`` times less than the pairs.

    Rows that share an id are one document with the links of both. A null id has no component and
    is kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(rows.mapInArrow(_signatures(words_per_shingle), f"doc_id long, n_shingles long, k1 long, k2 long, {SIGNATURE}, bands array<long>"), "minhash")
    key, held = ["k1", "k2", "n_shingles"], [*[f"s{i}" for i in range(LONGS)], "bands"]
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    first = filled.groupBy(*key).agg(F.min(F.struct("doc_id", *held)).alias("_first"))
    first = stage(first.select(*key, F.col("_first.doc_id").alias("node"), *[f"_first.{c}" for c in held]), "near-nodes")
    signatures = first.drop("bands", *key)
    texts = rows.where("doc_id is not null")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are likely by signature and near by their documents' whole sets."""
        likely = pairs.distinct().join(signatures.alias("p"), F.col("a") == F.col("p.node")).join(
            signatures.alias("q"), F.col("b") == F.col("q.node")).where(likeness("p", "q") >= percent / 100 - margin).select("a", "b")
        met = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return stage(met.select("a", "b", "text_a", "text_b").mapInArrow(_compare(words_per_shingle, percent), "a long, b long"), "near-links")

    marks = first.select("node", F.explode("bands").alias("band"))
    marks = marks.join(marks.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    marks = stage(marks.join(marks.groupBy("node").agg(F.sum("n").alias("degree")), "node").select("band", "node", "degree"), "near-marks")
    hubs = marks.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("_minus"))).alias("_h")).select("band", (-F.col("_h._minus")).alias("hub"))
    around = stage(marks.join(hubs, "band").select("hub", "node").distinct(), "near-around")
    links = confirmed(around.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    around = around.join(components(links), "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    mixed = around.join(first.groupBy("node").agg(F.max("n_shingles").alias("n")), "node").groupBy("hub").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("members"), F.sum("n").alias("names")).where("_low <> _high")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, 8 * F.col("names") / BLOCK_BYTES))
    around = stage(around.join(mixed.select("hub", blocks.alias("blocks")), "hub"), "near-mixed").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    sets = texts.select(F.col("doc_id").alias("node"), "text").join(around.select("node").distinct(), "node", "left_semi")
    sets = sets.mapInArrow(_keep_sets(words_per_shingle), "node long, names binary")
    cells = around.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "hub", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"), "node", "block", "component")
    late = cells.join(sets, "node").groupBy("hub", "low", "high").applyInArrow(_within(percent), "a long, b long")
    links = links.union(stage(late, "near-late"))
    same = signed.select("doc_id", *key).join(first.select(*key, "node"), key, "left")
    same = stage(same.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "near-documents")
    # An id of several rows may have several nodes, which it links.
    several = same.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_most")).where("a <> _most")
    links = links.union(same.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    found = same.join(components(links), "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, with all its columns.

    Every row counts by itself, under a number of its own: of rows that share an id those stay that
    are not near one another, and rows without an id are linked as others are, but stay only if no
    row of their group has an id. Rows are written once, each as one struct, so columns may have any names.
    """
    numbered = stage(docs.select(F.struct("*").alias("held"), F.monotonically_increasing_id().alias("row")), "near-rows")
    texts = numbered.select("row", F.col("held")[text_col].alias("text"))
    grouped = near_duplicates(texts, words_per_shingle, percent, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    ids = numbered.select("row", F.col("held")[id_col].alias("id"))
    kept = grouped.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return numbered.join(kept, "row", "left_semi").select("held.*")
