"""Operator 7. Token ids in files of fixed-width bit-packed blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_rows, shared_dir
from .tokens import Encoder, blocks, column

MAGIC = b"GLBP"
#: Ids of a block at least, but for the last of a file; a block holds whole documents.
BLOCK_IDS = 1 << 16
BLOCK = "part int, block int, start bigint, n_ids bigint, n_docs int, first_doc bigint, last_doc bigint, payload binary"


def width_of(vocabulary: int) -> int:
    """The least bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(docs: list[tuple[int | None, np.ndarray]], width: int) -> bytes:
    """One block: magic, width, number of documents and of those without an id, which come first, their ids and ends, then all token ids, width bits each.

    Bits fill bytes from the lowest; the token at place i is bits i * width on, so any stretch is read alone.
    """
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    head = MAGIC + struct.pack("<BII", width, len(docs), sum(d is None for d, _ in docs))
    head += np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.cumsum([len(x) for _, x in docs], dtype="<i8").tobytes()
    if width == 16:  # the same bits, without taking them apart
        return head + ids.astype("<u2").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return head + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def directory(payload: bytes) -> tuple[int, list[int | None], np.ndarray, int]:
    """Of a block: width, ids and ends of its documents, and where its bits begin."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    width, n, without = struct.unpack_from("<BII", payload, 4)
    ids = [None] * without + np.frombuffer(payload, "<i8", n, 13)[without:].tolist()
    return width, ids, np.frombuffer(payload, "<i8", n, 13 + 8 * n), 13 + 16 * n


def unpack(payload: bytes, start: int, end: int) -> np.ndarray:
    """The token ids at places start to end (without) of a block, read from their own bytes only."""
    width, _, _, at = directory(payload)
    if end <= start:
        return np.empty(0, np.uint32)
    if width == 16:
        return np.frombuffer(payload, "<u2", end - start, at + 2 * start).astype(np.uint32)
    first, last = start * width // 8, -(-end * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, at + first), bitorder="little")
    skip = start * width - first * 8
    bits = bits[skip : skip + (end - start) * width].reshape(-1, width).astype(np.uint32)
    return (bits << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> None:
    """Encodes every whole text, appends end_id, and writes blocks to path in ascending order of doc.

    The files are Parquet, one row a block (BLOCK), the block itself in payload; Spark's committer makes
    a lost or repeated task harmless. Documents are dealt out by ranges of their ids, so a part is a
    stretch of the whole sequence and parts follow each other in order. A block closes with the document
    that brings it to BLOCK_IDS; a very long text makes one larger block.

    Null texts are read as empty: their one id is end_id. Rows without an id come first and stay without
    one. Repeated rows and ids are all written, ties in no fixed order between equal ids. An empty
    table writes no block. Other columns are not read.
    """
    spark = df.sparkSession
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = width_of(max(vocabulary, end_id + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), Encoder.of(tokenizer), np.array([end_id], np.uint32)
        held: list[tuple[int, np.ndarray]] = []
        n = block = start = 0

        def closed() -> pa.RecordBatch:
            row = {"part": part, "block": block, "start": start, "n_ids": n, "n_docs": len(held), "first_doc": held[0][0], "last_doc": held[-1][0], "payload": pack(held, width)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("payload", pa.binary())]))

        for table in blocks(batches, "text"):
            for d, x in zip(column(table, "doc").to_pylist(), encoder.encode(column(table, "text")), strict=True):
                held.append((d, np.concatenate([x, end])))
                n += len(x) + 1
                if n >= BLOCK_IDS:
                    yield closed()
                    block, start, held, n = block + 1, start + n, [], 0
        if held:
            yield closed()

    d = df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    d = d.repartitionByRange("doc").sortWithinPartitions("doc")
    with arrow_rows(spark, 512):
        d.mapInArrow(encode, BLOCK).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: str, of) -> DataFrame:
    """of(doc id or None, token ids) as a row (columns, DDL) of every document in the files, with `start`.

    start: token ids before the document in the whole sequence, by sums over parts (a few rows each).
    """
    stored = spark.read.schema(BLOCK).parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = [c.split()[0] for c in columns.split(",")]
    types = [f.type for f in to_arrow_schema(stored.select(F.lit(0).cast("bigint").alias("start"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(",")]).schema)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, docs, ends, _ = directory(row["payload"])
                at, rows = 0, []
                for d, e in zip(docs, ends.tolist(), strict=True):
                    rows.append((row["before"] + row["start"] + at, *of(d, unpack(row["payload"], at, e))))
                    at = e
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["start", *names])

    return stored.join(F.broadcast(sums) if sums.count() <= 100_000 else sums, "part").select("before", "start", "payload").mapInArrow(decode, f"start bigint, {columns}")


def op7_bit_packed_ids(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to the shared folder and returns what the files hold."""
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_tokens(d, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = read_tokens(spark, path, "doc_id bigint, n_tokens bigint, ids_crc32 bigint", lambda d, x: (d, len(x), zlib.crc32(x.astype("<u4").tobytes())))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
