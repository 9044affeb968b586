"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.runtime import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character that is not one of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Rows of an Arrow batch while something is run here, as before afterwards; Spark itself keeps batches below 64 MB or one row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        if rows:
            spark.conf.set(name, str(rows))
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, *partition_by: str, rows: int | None = None) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: lineage ends here."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, name, *partition_by, rows=rows))


def written_path(df: DataFrame, name: str, *partition_by: str, rows: int | None = None) -> str:
    """Writes df to a new folder below the shared one, with so many rows in an Arrow batch, and returns the folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, rows):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


#: Rows of ids up to which a join broadcasts them, some 16 bytes each; more are shuffled.
FEW_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """One column of ids, read from a written table, for a join: broadcast if there are at most FEW_IDS rows."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written_path() made and that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
