"""Operator 10. Language-model scores by a weighted backoff automaton over smoothed n-grams."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, remove, written, written_path
from .tokens import blocks, column

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The end token, which no text can hold as a word.
END = b" end"
#: Bytes of text of a chunk, and input bytes per part of the n-grams' hash space.
CHUNK_BYTES, PART_BYTES, MOST_PARTS = 8 << 20, 4 << 20, 4096
#: A word seen n times is taken to have FOLLOWERS * n ** GROWTH different followers; its failure weight follows from that.
FOLLOWERS, GROWTH = 2.0, 0.9


def is_held_out(doc: int | None) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def squeezed(a: np.ndarray) -> bytes:
    """A compressed array: its bytes by plane, so that small numbers' high bytes cost next to nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return struct.pack("<cI", a.dtype.char.encode(), len(a)) + zstandard.ZstdCompressor(level=1).compress(planes)


def spread(data: bytes) -> np.ndarray:
    kind, n = struct.unpack_from("<cI", data)
    kind = np.dtype(kind.decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, n * kind.itemsize)), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unbundle(data: bytes, n: int) -> list[bytes]:
    ends = list(itertools.accumulate(struct.unpack_from(f"<{n}I", data), initial=4 * n))
    return [data[a:b] for a, b in itertools.pairwise(ends)]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """56 bits of two words' hashes: among n bigrams n * n / 2**57 pairs are expected to share one."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(8)


@dataclass
class Chunk:
    """Some megabytes of documents as indices into their own words and bigrams, each sorted by hash."""

    docs: np.ndarray  # ids; those of rows without one are masked
    held_out: np.ndarray
    ends: np.ndarray  # of each document's tokens
    hashes: np.ndarray  # of its words, ascending
    words: np.ndarray  # of each token
    pairs: np.ndarray  # hashes of its bigrams, ascending
    pair: np.ndarray  # of each token but documents' first, with the token before it

    @staticmethod
    def of(docs: np.ndarray, held_out: np.ndarray, ends: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> Chunk:
        h = pair_hash(hashes[words[:-1]], hashes[words[1:]])
        inner = np.ones(len(words), bool)
        inner[np.append(0, ends[:-1])] = False
        pairs, pair = np.unique(h[inner[1:]], return_inverse=True)
        return Chunk(docs, held_out, ends, hashes, words, pairs, pair)

    @staticmethod
    def read(docs: list[int | None], texts: list[str | None]) -> Chunk:
        from xxhash import xxh64_intdigest

        tokens: list[bytes] = []
        ends = []
        for t in texts:
            tokens += (t or "").encode().translate(_LOWER).split()
            tokens.append(END)
            ends.append(len(tokens))
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        hashes = np.array([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ids = np.ma.array([0 if d is None else d for d in docs], mask=[d is None for d in docs], dtype=np.int64)
        return Chunk.of(ids, np.array([is_held_out(d) for d in docs]), np.array(ends, np.int64), hashes[order], place[coded.indices.to_numpy(zero_copy_only=False)])

    def dumped(self) -> bytes:
        # words by falling frequency, whose indices compress better
        order = np.argsort(-np.bincount(self.words, minlength=len(self.hashes)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return bundle(squeezed(self.docs.data), squeezed(self.held_out + np.uint8(2) * np.ma.getmaskarray(self.docs)), squeezed(np.diff(self.ends, prepend=0)), squeezed(rank[self.words]))

    @staticmethod
    def loaded(data: bytes, hashes: np.ndarray, order: np.ndarray) -> Chunk:
        docs, flags, lengths, ranks = map(spread, unbundle(data, 4))
        return Chunk.of(np.ma.array(docs, mask=flags > 1), flags % 2 == 1, np.cumsum(lengths), hashes, order.astype(np.int32)[ranks])

    def train(self) -> tuple[np.ndarray, np.ndarray]:
        """How often training documents have each word and each bigram."""
        lengths = np.diff(self.ends, prepend=0)
        counted = ~np.repeat(self.held_out, lengths)
        inner = np.ones(len(self.words), bool)
        inner[np.append(0, self.ends[:-1])] = False
        word = np.bincount(self.words, counted, len(self.hashes))
        pair = np.bincount(self.pair, counted[inner], len(self.pairs))
        return word.astype(np.uint32), pair.astype(np.uint32)


class Automaton:
    """States: the root and one per word. Arcs: seen bigrams, and from the root every word.

    A state without an arc for the next token takes its failure arc to the root, at the state's own
    failure weight, and reads the token there. With c for counts, p(w) = (c(w) + 1) / (N + V + 1) at the
    root. After u, with t = FOLLOWERS * c(u) ** GROWTH followers expected, the root has the share
    f = t / (t + c(u)) and seen arcs the estimate (1 - f) c(uw) / c(u) + f p(w). So a seen arc's weight is
    the log10 of that, and u's failure weight that of f. A word without training count fails free.
    """

    def __init__(self, chunk: Chunk, word: np.ndarray, pair: np.ndarray, total: int, types: int):
        self.chunk = chunk
        self.root = np.log10((word + 1.0) / (total + types + 1.0))
        share = FOLLOWERS / (FOLLOWERS + np.maximum(word, 1) ** (1 - GROWTH))
        self.failure = np.where(word > 0, np.log10(share), 0.0)
        self.arc = np.full(len(pair), np.nan)
        seen = pair > 0
        first = np.zeros(len(pair), np.int64)  # some token that ends each bigram
        inner = np.ones(len(chunk.words), bool)
        inner[np.append(0, chunk.ends[:-1])] = False
        self.inner = np.flatnonzero(inner)
        first[chunk.pair] = self.inner
        u, w = chunk.words[first[seen] - 1], chunk.words[first[seen]]
        self.arc[seen] = np.log10((1 - share[u]) * pair[seen] / word[u] + share[u] * 10 ** self.root[w])

    def traverse(self) -> np.ndarray:
        """log10 probability of each document: one pass over its tokens, each read from the state before."""
        c = self.chunk
        weight = self.root[c.words]  # a document starts in the root
        arc = self.arc[c.pair]
        weight[self.inner] = np.where(np.isnan(arc), self.failure[c.words[self.inner - 1]] + weight[self.inner], arc)
        return np.add.reduceat(weight, np.append(0, c.ends[:-1]))


def _gathered(parts: int, chunk_bytes: int):
    """Chunks of a partition's texts: one row with the documents, and one per part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        edges = [i * (1 << 64) // parts for i in range(1, parts)]
        for k, table in enumerate(blocks(batches, "text", chunk_bytes)):
            chunk = Chunk.read(column(table, "doc").to_pylist(), column(table, "text").to_pylist())
            word, pair = chunk.train()
            order = np.argsort(-np.bincount(chunk.words, minlength=len(chunk.hashes)), kind="stable").astype(np.int32)
            cut_w = np.searchsorted(chunk.hashes, np.array(edges, np.uint64)).tolist()
            cut_p = np.searchsorted(chunk.pairs, np.array([e >> 8 for e in edges], np.uint64)).tolist()
            number = at << 32 | k
            rows = [("docs", number, -1, bundle(chunk.dumped(), squeezed(np.diff(chunk.hashes, prepend=np.uint64(0))), squeezed(order)))]
            for p, ((a, b), (c, d)) in enumerate(zip(itertools.pairwise([0, *cut_w, len(word)]), itertools.pairwise([0, *cut_p, len(pair)]), strict=True)):
                if b > a or d > c:
                    own = chunk.hashes[a:b], chunk.pairs[c:d]
                    rows.append(("grams", number, p, bundle(*[squeezed(np.diff(x, prepend=np.uint64(0))) for x in own], squeezed(word[a:b]), squeezed(pair[c:d]))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["kind", "chunk", "part", "payload"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One part of the hash space: the training counts over all chunks, for each chunk's own n-grams."""
    rows = rows.sort_values("chunk")
    found = [[spread(x) for x in unbundle(p, 4)] for p in rows["payload"]]
    out, stats = [], []
    for k in (0, 1):
        values = [np.cumsum(f[k], dtype=np.uint64) for f in found]
        unique, inverse = np.unique(np.concatenate(values), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([f[k + 2] for f in found]), len(unique)).astype(np.int64)
        cuts = np.cumsum([len(v) for v in values])[:-1]
        out.append([squeezed(totals[i].astype(np.uint32) if totals.size and totals.max() < 1 << 32 else totals[i]) for i in np.split(inverse, cuts)])
        stats.append((int(totals.sum()), int((totals > 0).sum())))
    result = pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "part": rows["part"].to_numpy(), "payload": [bundle(a, b) for a, b in zip(*out, strict=True)]})
    result["total"], result["types"] = 0, 0
    result.loc[result.index[0], ["total", "types"]] = stats[0]
    return result


def _scored(total: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, deltas, order = unbundle(batch.column("docs")[row].as_py(), 3)
                chunk = Chunk.loaded(docs, np.cumsum(spread(deltas), dtype=np.uint64), spread(order))
                parts = sorted(batch.column("parts")[row].as_py(), key=lambda x: x["part"])
                counts = [[spread(x) for x in unbundle(p["payload"], 2)] for p in parts]
                word, pair = (np.concatenate([c[k] for c in counts]).astype(np.int64) for k in (0, 1))
                starts = np.append(0, chunk.ends[:-1])
                base = np.log10((word + 1.0) / (total + types + 1.0))[chunk.words]
                sums = [np.add.reduceat(x, starts) for x in ((word > 0)[chunk.words].astype(np.int64), base)]
                score = Automaton(chunk, word, pair, total, types).traverse()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.docs.data, mask=np.ma.getmaskarray(chunk.docs)), pa.array(chunk.held_out), pa.array(np.diff(chunk.ends, prepend=0)), pa.array(sums[0]), pa.array(np.full(len(score), total, np.int64)), pa.array(sums[1]), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def scored(df: DataFrame, doc: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model is learned from all rows but the held-out ones (is_held_out). Text is read once, in chunks
    of chunk_bytes; a chunk keeps its tokens as indices and sends each distinct word and bigram once, with
    its count, to the part of the hash space that sums it over all chunks; sums come back to the chunks
    that asked, which build their piece of the automaton and traverse it. Nothing is cut off or sampled.
    What a task holds is one chunk, or one part; a very frequent n-gram is one entry per chunk.

    Null and empty texts have the end token only; a row without an id stays without one and is not held
    out; repeated rows are counted and scored each; other columns are not read, whatever their names; an
    empty table gives an empty one. Words are compared by 64-bit hashes, bigrams by 56-bit ones.
    """
    spark = df.sparkSession

    d = df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(8, min(MOST_PARTS, size // PART_BYTES))
    schema = "kind string, chunk bigint, part int, payload binary"
    path = written_path(d.mapInArrow(_gathered(parts, chunk_bytes), schema), "lm-chunks", "kind", rows=512)

    chunks = spark.read.schema(schema).parquet(path)
    sums = written(
        chunks.where("kind = 'grams'").drop("kind").repartition(parts, "part").groupBy("part").applyInPandas(_summed, "chunk bigint, part int, payload binary, total bigint, types bigint"),
        "lm-sums",
        rows=8,
    )
    remove(spark, f"{path}/kind=grams")
    total, types = sums.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    docs = spark.read.schema("chunk bigint, payload binary").parquet(f"{path}/kind=docs") if total or not sums.isEmpty() else chunks.where("false").select("chunk", "payload")
    by_chunk = sums.groupBy("chunk").agg(F.collect_list(F.struct("part", "payload")).alias("parts"))
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.withColumnRenamed("payload", "docs").join(by_chunk, "chunk").select("docs", "parts").mapInArrow(_scored(total, types), out)


def op10_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
