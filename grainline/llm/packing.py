"""Operator 4. Best-fit decreasing packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import BATCH_BYTES, LITTLE, REMEMBERED, Encoder, blocks, column

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"
#: Rows of one group in which pieces of one length are numbered.
GROUP_ROWS = 4096


def pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc: str = "doc_id", text: str = "text", with_ids: bool = True, little: bool = False) -> DataFrame:
    """The pieces (PIECES, without ids if with_ids is off) of all documents, of at most capacity tokens.

    A document's tokens are its text's ids and end_id. Only a longer one is cut, so that all pieces but
    the first are full. Null and empty texts have one token. Repeated rows give pieces each.
    `little` encodes with less memory.
    """
    remembered, batch_bytes = LITTLE if little else (REMEMBERED, BATCH_BYTES)
    names = [c.split()[0] for c in PIECES.split(", ")][: None if with_ids else -1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer, remembered), np.array([end_id], np.uint32)
        for table in blocks(batches, "text", batch_bytes):
            rows = []
            for d, x in zip(column(table, "doc").to_pylist(), encoder.encode(column(table, "text")), strict=True):
                x = np.concatenate([x, end]).astype("<u4")
                ends = list(range(len(x), 0, -capacity))[::-1]
                at = 0
                for k, e in enumerate(ends):
                    row = (d, k, at, e - at, zlib.crc32(x[at:e].tobytes()))
                    rows.append((*row, x[at:e].astype(np.int32)) if with_ids else row)
                    at = e
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names)  # noqa: B905

    d = df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(cut, PIECES if with_ids else PIECES.rpartition(",")[0])


class OpenBins:
    """A segment tree over remaining capacities: at each leaf, the runs of open bins with so much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, room: int, first: int, n: int) -> None:
        self.runs[room].append((first, n))
        self._grow(room, n)

    def _grow(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least need that an open bin has, in logarithmic time."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
            at >>= 1
        if at == 1:
            return None
        at += 1
        while at < self.size:
            at *= 2
            at += not self.count[at]
        return at - self.size

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to most bins of a run with this room: the first's number and how many."""
        first, n = self.runs[room].pop()
        got = min(n, most)
        if got < n:
            self.runs[room].append((first + got, n - got))
        self._grow(room, -got)
        return first, got


@dataclass
class Plan:
    """Where the pieces of each length go: for its rank-th piece, the last rule with from_rank <= rank.

    Its bin is bin + (rank - from_rank) // each, its offset offset + (rank - from_rank) % each * length.
    """

    length: list[int] = field(default_factory=list)
    from_rank: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def rule(self, *row: int) -> None:
        for c, x in zip((self.length, self.from_rank, self.bin, self.each, self.offset), row, strict=True):
            c.append(x)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The packing that best-fit decreasing makes of so many pieces of each length.

    Pieces of one length are alike, and so are bins with the same room, so both are handled as runs:
    the tree gives the tightest room that fits, and one step fills a whole run of bins. Where none
    fits, new bins take as many of the length as they hold, as piece-by-piece best fit would. State
    and steps depend on the number of lengths, at most capacity, and not on the number of pieces.
    """
    tree, plan = OpenBins(capacity), Plan()
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is not None:
                first, n = tree.take(room, left)
                plan.rule(length, rank, first, 1, capacity - room)
                if room > length:
                    tree.add(room - length, first, n)
                rank, left = rank + n, left - n
                continue
            each = capacity // length
            for n, of in ((left // each, each), (1, left % each)):
                if n and of:
                    plan.rule(length, rank, plan.bins, of, 0)
                    if room := capacity - of * length:
                        tree.add(room, plan.bins, n)
                    plan.bins += n
                    rank, left = rank + n * of, left - n * of
    return plan


def packed(d: DataFrame, capacity: int = 2048) -> DataFrame:
    """d, pieces with (doc_id, piece, length), with sequence_id and offset (long).

    The driver holds the count of each length, at most capacity numbers, and the plan made from them.
    Pieces of a length are ranked by counts of hashed groups, so a length that most pieces have is
    spread over tasks. Columns of d named sequence_id or offset are replaced; an empty table gives an
    empty one. Lengths over capacity or under 1 raise an error. d is read several times: materialise it
    where it is costly.
    """
    n = d.count()
    groups = max(1, -(-n // GROUP_ROWS))
    keep = [c for c in d.columns if c not in ("sequence_id", "offset")]
    d = d.select(*keep, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("_gl_group"))
    sums = d.groupBy("length", "_gl_group").agg(F.count(F.lit(1)).alias("_gl_n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_gl_n").alias("n")).collect()}
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = best_fit_decreasing(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("_gl_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_gl_group", F.coalesce(F.sum("_gl_n").over(earlier), F.lit(0)).alias("_gl_before"))
    within = Window.partitionBy("length", "_gl_group").orderBy("doc_id", "piece")
    d = d.join(sums, ["length", "_gl_group"]).withColumn("_gl_rank", F.row_number().over(within) - 1 + F.col("_gl_before"))
    lengths, ranks, bins, each, offsets = (np.array(x, np.int64) for x in (plan.length, plan.from_rank, plan.bin, plan.each, plan.offset))
    order = np.lexsort((ranks, lengths))
    lengths, ranks, bins, each, offsets = (x[order] for x in (lengths, ranks, bins, each, offsets))
    first = np.searchsorted(lengths, np.arange(capacity + 2))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(n), np.int64)
        for x in np.unique(n):
            own = n == x
            lo = first[x]
            at[own] = lo + np.searchsorted(ranks[lo : first[x + 1]], r[own], side="right") - 1
        k = r - ranks[at]
        return pd.DataFrame({"sequence_id": bins[at] + k // each[at], "offset": offsets[at] + k % each[at] * n})

    return d.withColumn("_gl_at", place("length", "_gl_rank")).select(*keep, "_gl_at.sequence_id", "_gl_at.offset")


def sequences(d: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, from packed() over pieces with ids."""
    rows = d.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))


def packing_table(docs: DataFrame, capacity: int = 2048, little: bool = False) -> DataFrame:
    """One row per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    cut = written(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity, with_ids=False, little=little), "pieces", rows=512)
    return packed(cut, capacity)


def op4_best_fit_decreasing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    return packing_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
