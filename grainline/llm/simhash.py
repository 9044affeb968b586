"""Operator 6. SimHash near-duplicates, paired by vantage-point trees over fingerprints."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, few, remove, written, written_path
from .components import components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Points that a leaf of a tree compares all with all, points of a shard aimed at, and points that one task holds at once.
LEAF, SHARD_POINTS, BLOCK_POINTS = 16, 256, 16384
#: Share of the points that a median split by a vantage point sends to one side, its boundary included, as bits.
SPLIT_BITS = 0.77


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text in A-Z lower case; the whole sequence is one if it is shorter.

    Words are cut from one byte string by numpy places, so that a very long text takes little more than itself.
    """
    from xxhash import xxh64_intdigest

    joined = b" ".join((text or "").encode().translate(_LOWER).split())
    if not joined:
        return np.empty(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    if len(ends) > shingle:
        starts, ends = starts[: len(ends) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    out = np.empty(len(ends), np.uint64)
    for at in range(0, len(ends), 1 << 14):
        a, b = starts[at : at + (1 << 14)].tolist(), ends[at : at + (1 << 14)].tolist()
        out[at : at + len(a)] = [xxh64_intdigest(joined[x:y], seed) for x, y in zip(a, b, strict=True)]
    return out


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes h, so many a text; 0 where there are none."""
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if len(own):
        at = np.cumsum(counts[own]) - counts[own]
        for bit in range(64):
            on = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), at)
            out[own] |= (2 * on > counts[own].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text: bits set in over half of its shingles' XXH64; 0 without words."""
    own = [shingle_hashes(t, shingle, seed) for t in texts]
    return majority(np.concatenate(own) if own else np.empty(0, np.uint64), np.array([len(x) for x in own], np.int64))


def fingerprints(df: DataFrame, shingle: int = 4, seed: int = 42, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp the fingerprint's bits as a signed long, whole texts hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                fp = fingerprint(part.column("text").to_pylist(), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made of each hash; the 0-th is the hash itself."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Partition:
    """Vantage points by which fingerprints are dealt out to shards, such that every pair within `bits` bits meets in one.

    The 64 bits are cut into bits // 2 + 1 blocks: a pair has at most one differing bit (`reach`) in some
    block. Each block has a tree whose nodes of one level share a vantage point and split at the median
    distance from it. A point on the boundary, whose distance is within reach of the other side's, goes
    to both sides; by the triangle inequality a pair that the block keeps within reach then shares a leaf.
    Levels are as many as make shards of about SHARD_POINTS of so many points. A level splits points by
    0.77 bits (boundaries included) and copies 0.17 of them, so rows grow as the points to the power 1.3.
    """

    def __init__(self, bits: int, points: int, seed: int = 42):
        blocks = bits // 2 + 1
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        self.reach = bits // blocks
        levels = math.ceil(max(0.0, math.log2(max(1, points) / SHARD_POINTS)) / SPLIT_BITS)
        self.blocks = []
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            mask = np.uint64((1 << b) - (1 << a))
            vantages = np.random.default_rng([seed, k]).integers(0, 1 << 64, min(levels, b - a), dtype=np.uint64) & mask
            self.blocks.append((mask, vantages, (b - a) // 2))

    def deal(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in fp, shard) of every copy of every fingerprint."""
        places, shards = [], []
        for k, (mask, vantages, median) in enumerate(self.blocks):
            at, shard = np.arange(len(fp)), np.full(len(fp), k, np.uint64)
            for v in vantages:
                d = np.bitwise_count((fp & mask) ^ v)[at]
                outside, edge = d > median, (d <= median) & (d > median - self.reach)
                shard, crossed = mixed(np.where(outside, shard + np.uint64(1 << 32), shard), 1), mixed(shard[edge] + np.uint64(1 << 32), 1)
                at, shard = np.concatenate([at, at[edge]]), np.concatenate([shard, crossed])
            places.append(at)
            shards.append(shard)
        return np.concatenate(places), np.concatenate(shards).view(np.int64)


def across(pa_: np.ndarray, a: np.ndarray, pb: np.ndarray, b: np.ndarray, bits: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (places in pa_, places in pb) to compare, which hold every pair of pa_[a] and pb[b] within `bits` bits.

    A vantage point splits the larger side at its median distance; of the other side, each part gets what
    lies within its boundary and the overlap.
    """
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= leaf * leaf:
            yield a, b
            continue
        swap = len(a) > len(b)
        small, large, ps, pl = (b, a, pb, pa_) if swap else (a, b, pa_, pb)
        v = pl[large[0]]
        ds, dl = (np.bitwise_count(p[x] ^ v).astype(np.int64) for p, x in ((ps, small), (pl, large)))
        m = int(np.median(dl))
        parts = [(small[ds <= m + bits], large[dl <= m]), (small[ds > m - bits], large[dl > m])]
        if sum(len(x) * len(y) for x, y in parts) > 0.9 * len(a) * len(b):  # nothing to prune here
            step = max(1, (1 << 16) // len(small)) if len(small) < 256 else 256
            for i in range(0, len(small), 256):
                for j in range(0, len(large), step):
                    x, y = small[i : i + 256], large[j : j + step]
                    yield (y, x) if swap else (x, y)
        else:
            todo += [(y, x) if swap else (x, y) for x, y in parts]


class Forest:
    """Classes of points linked within `bits` bits, found by a vantage-point tree joined with itself.

    A node splits its points at the median distance from a vantage point. A pair across the split is
    within reach only if both lie in the overlap of the boundary, so each side's overlap alone is joined
    with the other's, again by a vantage point, until few are left. Points within bits / 2 of a vantage
    point are linked to it and to each other without a comparison. `compared` counts pairs looked at.
    """

    def __init__(self, points: np.ndarray, bits: int, leaf: int = LEAF):
        self.points, self.bits, self.leaf, self.compared = points, bits, leaf, 0
        self.up = np.arange(len(points))
        for a, b in self.within(np.arange(len(points))):
            self.compare(a, b)
        self.label = self.find(np.arange(len(points)))

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while (above := self.up[root]).tobytes() != root.tobytes():
            root = above
        self.up[at] = root
        return root

    def link(self, at: np.ndarray) -> None:
        found = np.unique(self.find(at))
        self.up[found[1:]] = found[0]

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        self.compared += len(a) * (len(a) - 1) // 2 if a is b else len(a) * len(b)
        near = np.bitwise_count(self.points[a][:, None] ^ self.points[b][None, :]) <= self.bits
        if a is b:
            np.fill_diagonal(near, False)
        for i in np.flatnonzero(near.any(1)):
            self.link(np.append(b[near[i]], a[i]))

    def within(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of points to compare, which hold every pair within reach."""
        todo = [at]
        while todo:
            at = todo.pop()
            if len(at) <= self.leaf:
                yield at, at
                continue
            d = np.bitwise_count(self.points[at] ^ self.points[at[0]]).astype(np.int64)
            m = int(np.median(d))
            self.link(at[2 * d <= self.bits])
            low, high = at[d <= m], at[d > m]
            if not len(high):  # all as far away as the farthest: the rest against the first few, then on
                yield at[: self.leaf], at[: self.leaf]
                yield from across(self.points, at[: self.leaf], self.points, at[self.leaf :], self.bits, self.leaf)
                todo.append(at[self.leaf :])
                continue
            todo += [low, high]
            yield from across(self.points, at[(d <= m) & (d > m - self.bits)], self.points, at[(d > m) & (d <= m + self.bits)], self.bits, self.leaf)


def by_group(make: Callable, out: Callable):
    """A mapInArrow function over rows sorted by (shard, block, role): role 0 are a block's own rows, 1 visit it.

    make(columns of the own rows) gives an object whose own() and visit(columns) give what is found, of
    which out() makes a batch. Own rows are held until the block ends, visitors one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, home, found, n = None, [], None, [], 0

        def opened():
            return make(held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]})

        for batch in batches:
            columns = {c: _column(batch.column(c)) for c in batch.schema.names}
            shard, block, role = columns.pop("shard"), columns.pop("block"), columns.pop("role")
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                if key != (shard[lo], block[lo]):
                    if home is None and held and (len(held) > 1 or len(held[0]["fp"]) > 1):
                        found.append(opened().own())
                    key, held, home = (shard[lo], block[lo]), [], None
                part = {c: x[lo:hi] for c, x in columns.items()}
                if role[lo] == 0:
                    held.append(part)
                elif held:
                    if home is None:
                        home = opened()
                        found.append(home.own())
                    found.append(home.visit(part))
                if len(found) > 1000:
                    yield from out(found)
                    found = []
        if home is None and held:
            found.append(opened().own())
        yield from out(found)

    return run


def _column(a: pa.Array) -> np.ndarray:
    if pa.types.is_binary(a.type):
        x = np.empty(len(a), object)
        x[:] = a.to_pylist()
        return x
    if pa.types.is_list(a.type):
        return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
    return a.to_numpy(zero_copy_only=False)


def _pairs_out(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    both = np.concatenate([np.empty((0, 2), np.int64), *found])
    for at in range(0, len(both), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in both[at : at + (1 << 18)].T.copy()], ["a", "b"])


class Prints:
    """A block of fingerprints: links among its own, and of visitors to one of each class within reach."""

    def __init__(self, columns: dict[str, np.ndarray], bits: int):
        self.rep, self.points, self.bits = columns["rep"], columns["fp"].view(np.uint64), bits
        self.forest = Forest(self.points, bits)

    def own(self) -> np.ndarray:
        label = self.forest.label
        other = np.flatnonzero(label != np.arange(len(label)))
        return np.stack([self.rep[other], self.rep[label[other]]], 1)

    def visit(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        fp, found = columns["fp"].view(np.uint64), [np.empty((0, 2), np.int64)]
        for a, b in across(fp, np.arange(len(fp)), self.points, np.arange(len(self.points)), self.bits):
            i, j = np.nonzero(np.bitwise_count(fp[a][:, None] ^ self.points[b][None, :]) <= self.bits)
            if len(i):
                found.append(np.unique(np.stack([a[i], self.forest.label[b[j]]], 1), axis=0))
        links = np.unique(np.concatenate(found), axis=0).astype(np.int64)
        return np.stack([columns["rep"][links[:, 0]], self.rep[links[:, 1]]], 1)


def _dealt(partition: Partition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                place, shard = partition.deal(part.column("fp").to_numpy().view(np.uint64))
                rep, fp = (part.column(c).to_numpy()[place] for c in ("rep", "fp"))
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(fp), pa.array(shard)], ["rep", "fp", "shard"])

    return run


def clusters(prints: DataFrame, bits: int = 4) -> DataFrame:
    """prints (doc_id, fp) with component_id: the smallest doc_id that links of at most `bits` bits reach.

    Equal fingerprints become one point first, so copies cost nothing more. Partition deals points out to
    shards, boundary points to each side; a shard is joined with itself by a tree of its own over all 64
    bits (Forest), and gives at most one link per point, never all pairs. A shard of more than
    BLOCK_POINTS points is cut into blocks, and each block's points visit the later ones. Links are
    exact: a pair within reach shares a shard. They then become components by distributed rounds. A row
    without an id takes the component of rows with its very fingerprint, else null; repeated rows are
    kept; an empty table gives an empty one.
    """
    spark = prints.sparkSession
    points_path = written_path(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-points")
    points = spark.read.schema("fp bigint, rep bigint").parquet(points_path)
    dealt = points.where("rep IS NOT NULL").select("rep", "fp").mapInArrow(_dealt(Partition(bits, points.count())), "rep bigint, fp bigint, shard bigint")
    large = written(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK_POINTS), "simhash-large")
    if large.isEmpty():
        rows = dealt.withColumns({"block": F.lit(0), "role": F.lit(0)})
    else:
        rows = dealt.join(large, "shard", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK_POINTS), F.lit(1)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("block", F.explode(F.sequence("own", F.col("blocks") - 1)))
        rows = rows.select("rep", "fp", "shard", "block", (F.col("block") != F.col("own")).cast("int").alias("role"))
    rows = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "role", "fp")
    links = written(rows.mapInArrow(by_group(lambda own: Prints(own, bits), _pairs_out), "a bigint, b bigint").distinct(), "simhash-links")
    roots = components(links, "simhash-links")
    found = points.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    # both sides are plain exchanges, so the adaptive plan splits a fingerprint that very many rows have
    found = written(found, "simhash-classes")
    remove(spark, points_path)
    return prints.join(found, "fp")


def op6_vantage_point_trees(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    prints = written(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "simhash-prints", rows=512)
    return clusters(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near duplicates by similarity

#: Least-hash bands that deal texts out to shards, and hashes of a band: a pair of similarity 0.8 shares a band with probability 0.992.
BANDS, BAND_HASHES = 16, 6
#: Bits within which fingerprints of texts of similarity 0.8 lie: 9.7 +- 2.9 are expected.
SIMILAR_BITS = 18
#: Texts and shingles of a block of a shard that one task holds.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 21
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) of each text's distinct hashes h, so many a text: the least of each of several hashes, by bands."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    own = np.flatnonzero(counts)
    if len(own):
        at = np.cumsum(counts[own]) - counts[own]
        for k, factor in enumerate(_FACTORS):
            out[own, k // BAND_HASHES] = mixed(out[own, k // BAND_HASHES] ^ np.minimum.reduceat(h * factor, at), 1)
    return out


def shingle_sets(df: DataFrame, shingle: int, seed: int = 42, doc: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, key, n, fp, bands) of every row: a 128-bit hash of its set of shingles, the set's size, fingerprint and band keys.

    With `sets`, (doc_id, key, hashes) instead: the set itself, as ascending 64-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [np.unique(shingle_hashes(t, shingle, seed)) for t in part.column("text").to_pylist()]
                keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())
                if sets:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), keys, pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "key", "hashes"])
                    continue
                n, h = np.array([len(x) for x in own], np.int32), np.concatenate(own)
                bands = pa.array(list(band_keys(h, n).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), keys, pa.array(n), pa.array(majority(h, n.astype(np.int64)).view(np.int64)), bands], ["doc_id", "key", "n", "fp", "bands"])

    rows = df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, key binary, hashes binary" if sets else "doc_id bigint, key binary, n int, fp bigint, bands array<bigint>")


def _similar_sets(x: bytes, y: bytes, similarity: float) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar_sets(x.as_buffer(), y.as_buffer(), similarity) for x, y in zip(batch.column("x_set"), batch.column("y_set"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Texts:
    """A block of texts of a shard; visitors' links to them, a pair only where it is new.

    A pair within reach is measured on the whole sets in the first of its common bands, unless its two
    classes, as known so far, are one. So what a block gives is at most a link per text, whatever it compares.
    """

    def __init__(self, columns: dict[str, np.ndarray], similarity: float):
        self.own_rows, self.similarity = columns, similarity
        self.points = columns["fp"].view(np.uint64)
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (above := self.up.get(x, x)) != x:
            x = above
        return x

    def own(self) -> list[tuple[bytes, bytes]]:
        return []

    def visit(self, q: dict[str, np.ndarray]) -> list[tuple[bytes, bytes]]:
        d, fp, found = self.own_rows, q["fp"].view(np.uint64), []
        for a, b in across(fp, np.arange(len(fp)), self.points, np.arange(len(self.points)), SIMILAR_BITS):
            far = np.bitwise_count(fp[a][:, None] ^ self.points[b][None, :])
            i, j = np.nonzero(far <= SIMILAR_BITS)
            order = np.argsort(far[i, j], kind="stable")
            i, j = a[i[order]], b[j[order]]
            n, m = q["n"][i], d["n"][j]
            fit = np.minimum(n, m) >= self.similarity * np.maximum(n, m)
            fit &= q["c"][i] != d["c"][j]
            fit &= (q["bands"][i] == d["bands"][j]).argmax(1) == q["band"][i]
            for x, y in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                if d["visits"][y] and q["node"][x] < d["node"][y]:
                    continue  # y visits x's block
                r, s = self.find(q["c"][x]), self.find(d["c"][y])
                if r != s and _similar_sets(q["hashes"][x], d["hashes"][y], self.similarity):
                    self.up[s] = r
                    found.append((q["node"][x], d["node"][y]))
        return found


def _nodes_out(found: list[list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
    both = [x for part in found for x in part]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in both], pa.binary()) for k in (0, 1)], ["a", "b"])


def _node(doc: Column, key: Column) -> Column:
    """A text's node: 8 bytes that sort as its smallest doc_id, then its key."""
    return F.concat(F.unhex(F.lpad(F.hex(doc.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), key)


def _doc(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, key) of every row and (key, doc_id, node, root) of every distinct set of shingles.

    See deduplicated(). Classes are components of all pairs that share a band, lie within SIMILAR_BITS
    and have the similarity. They don't depend on how shards are cut, since a pair is left unmeasured
    only where its ends are known to be in one class. Bands travel as pairs of longs; only texts of shards
    that hold several are hashed again for their whole sets.
    """
    spark = docs.sparkSession
    whole = written(shingle_sets(docs, shingle, doc=doc, text=text), "simhash-sets", rows=512)
    points = whole.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    points = written(points.withColumns({"node": _node(F.col("doc_id"), F.col("key")), "pid": F.monotonically_increasing_id()}), "simhash-points")
    dealt = points.select("pid", F.posexplode("bands").alias("band", "shard")).select("pid", "band", F.xxhash64("band", "shard").alias("shard"))
    shared = dealt.groupBy("shard").agg(F.min("pid").alias("centre"), F.max("pid").alias("last")).where("centre <> last").drop("last")
    rows = written(dealt.join(shared, "shard").join(points.select("pid", "node", "n", "fp"), "pid"), "simhash-shared")
    wanted = written(rows.select("pid").distinct().join(points.select("pid", "doc_id", "key"), "pid"), "simhash-wanted")
    some = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = some.join(few(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    # grouped as joined: the sets of repeated rows meet without another exchange
    sets = shingle_sets(some, shingle, sets=True).join(wanted, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("pid").alias("pid"), F.first("hashes").alias("hashes"))
    sets = written(sets.select("pid", "hashes"), "simhash-hashes", rows=512)
    about = points.select("pid", "node", "n", "fp")

    def measured(rows: DataFrame) -> DataFrame:
        """Similar pairs of each shard's centre with its rows."""
        pairs = rows.where("pid <> centre").select(F.col("centre").alias("x"), F.col("pid").alias("y")).distinct()
        for side in "xy":
            pairs = pairs.join(about.select(*[F.col(c).alias(side + "_" * (c != "pid") + c * (c != "pid")) for c in about.columns]), side)
        fit = (F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n")) & (F.bit_count(F.col("x_fp").bitwiseXOR(F.col("y_fp"))) <= SIMILAR_BITS)
        pairs = pairs.where(fit).select("x", "y", F.col("x_node").alias("a"), F.col("y_node").alias("b"))
        for side in "xy":
            pairs = pairs.join(sets.select(F.col("pid").alias(side), F.col("hashes").alias(f"{side}_set")), side).drop(side)
        return written(pairs.mapInArrow(_similar(similarity), "a binary, b binary"), "simhash-similar", rows=256)

    def mixed_shards(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of shards that hold several classes, with their class and whether it is the shard's commonest."""
        d = rows.join(roots, rows["node"] == roots["node"], "left").select("shard", "band", "pid", rows["node"], "n", "fp", F.coalesce("root", rows["node"]).alias("c"))
        by_class = d.groupBy("shard", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
        main = by_class.groupBy("shard").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("size", "c"))["c"].alias("main"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))
        main = main.where("classes > 1").drop("classes")
        return written(d.join(main, "shard").withColumn("visits", F.col("c") != F.col("main")).drop("main"), "simhash-mixed")

    links = measured(rows)
    left = mixed_shards(rows, components(links, "simhash-links"))
    # what a first centre doesn't hold together, a second one may
    open_rows = left.where("visits").select("shard", "pid")
    links = links.unionByName(measured(open_rows.join(open_rows.groupBy("shard").agg(F.min("pid").alias("centre")), "shard")))
    left = mixed_shards(left, components(links, "simhash-links"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    left = left.withColumn("blocks", blocks).drop("size", "shingles")
    own = left.withColumns({"block": F.pmod(F.xxhash64("pid"), "blocks").cast("int"), "role": F.lit(0)})
    visiting = left.where("visits").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "role": F.lit(1)})
    both = own.unionByName(visiting).drop("blocks").join(points.select("pid", "bands"), "pid").join(sets, "pid").drop("pid")
    both = both.repartition("shard", "block").sortWithinPartitions("shard", "block", "role", "node")
    links = links.unionByName(written(both.mapInArrow(by_group(lambda x: Texts(x, similarity), _nodes_out), "a binary, b binary").distinct(), "simhash-rest", rows=512))
    roots = components(links, "simhash-links")
    classes = points.join(roots, "node", "left").select("key", "doc_id", "node", F.coalesce("root", "node").alias("root"))
    return whole.select("doc_id", "key"), written(classes, "simhash-classes")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each class, the rows of the smallest id stay.

    Classes are the components of links between texts whose sets of shingles have a Jaccard similarity of
    at least `similarity`, measured on the whole sets, so no text goes that no similar one stays for.

    Candidates share one of BANDS least-hash bands and lie within SIMILAR_BITS of each other's
    fingerprint. Bands rather than vantage points deal texts out to shards, since similarity 0.8 is some
    ten bits of 64, where a vantage point's boundary holds nearly all points; a text has BANDS copies
    however many texts there are. First each shard's smallest text is measured against the others, twice
    over; then, in shards that still hold several classes, all texts outside the commonest class visit
    every block of the shard. What bands miss is stated in the README.

    Equal sets, by a 128-bit hash, are one text: among n texts n * n / 2**129 false pairs are expected.
    Texts without words are equal. A row without an id stays. Rows of one id stay or go together, and go
    only if each of their texts has a class with a smaller id. An empty table gives an empty one; other
    columns are kept as they are.
    """
    whole, classes = similar_classes(docs, shingle, similarity, doc, text)
    verdict = whole.where("doc_id IS NOT NULL").join(classes.select("key", _doc(F.col("root")).alias("first")), "key")
    gone = verdict.groupBy("doc_id").agg(F.min(F.col("first") < F.col("doc_id")).alias("gone")).where("gone")
    return docs.join(few(written(gone.select(F.col("doc_id").alias(doc)), "simhash-gone")), doc, "left_anti")
