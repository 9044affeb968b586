"""Operator 8. Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one window group aimed at, and the most groups that a stratum is dealt into.
GROUP_ROWS, MOST_GROUPS = 1024, 20_000


def _numbered(df: DataFrame, part: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Adds out, the place of each row from 0 among the rows of its part, by (bucket, order).

    The rows of a part are counted by bucket and numbered within each bucket, so that no task gets a
    whole part. Needs buckets that few rows share, known from a row alone.
    """
    counts = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("_gl_n"))
    over = Window.partitionBy(*part)
    earlier = over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *part, bucket,
        F.coalesce(F.sum("_gl_n").over(earlier), F.lit(0)).alias("_gl_before"),
        F.sum("_gl_n").over(over).alias("_gl_total"),
    )
    within = Window.partitionBy(*part, bucket).orderBy(*order)
    return df.join(counts, [*part, bucket]).withColumn(out, F.row_number().over(within) - 1 + F.col("_gl_before")).drop("_gl_before")


def interleave(df: DataFrame, n_shards: int = 16, stratum: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """All rows of df with `shard` (int, from 0) and `slot` (long, gapless from 0 in its shard).

    Rows are shuffled by a seeded hash of their key within their stratum; the k-th of n, from 0, gets the
    fractional rank (k + p) / n, p between 0 and 1 the stratum's own, so that strata of one size don't
    stand in step. Sorted by that rank, every stretch holds the strata in proportion,
    and cutting it into n_shards equal parts gives shards with the mixture of the whole table, with
    counts that differ by one at most. Both orders are numbered by buckets, so a stratum that holds a
    third of all rows is still spread over many tasks.

    A null stratum is one stratum; a null key is hashed like any value; repeated rows each get a slot;
    an empty table gives an empty one. Input columns named shard or slot are replaced.
    """
    n = df.count()
    groups = max(1, min(MOST_GROUPS, -(-n // GROUP_ROWS)))
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    d = df.select(
        *columns,
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("_gl_stratum"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("_gl_hash"),
    )
    ties = [F.col(c) for c, kind in df.dtypes if c in columns and not kind.startswith(("map", "variant"))]
    d = d.withColumn("_gl_group", F.pmod("_gl_hash", F.lit(groups)))
    d = _numbered(d, ["_gl_stratum"], "_gl_group", [F.col("_gl_hash"), F.col(key), *ties], "_gl_rank")
    phase = (F.pmod(F.xxhash64(F.lit(seed), "_gl_stratum"), F.lit(1_000_000)) + 0.5) / 1_000_000
    d = d.withColumn("_gl_share", (F.col("_gl_rank") + phase) / F.col("_gl_total")).drop("_gl_group", "_gl_total")
    d = d.withColumn("_gl_group", F.floor(F.col("_gl_share") * groups)).withColumn("_gl_all", F.lit(0))
    d = _numbered(d, ["_gl_all"], "_gl_group", [F.col("_gl_share"), F.col("_gl_stratum"), F.col("_gl_rank")], "_gl_place")
    return (
        d.withColumn("shard", F.expr(f"CAST(_gl_place * {n_shards} DIV {max(n, 1)} AS INT)"))
        .withColumn("slot", F.expr(f"_gl_place - (shard * {n}L + {n_shards - 1}) DIV {n_shards}"))
        .select(*columns, "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes interleave(df, **options) as one folder per shard, each file in slot order.

    Rows meet by shard and by a stretch of slots, so no task holds a whole large shard.
    """
    d = interleave(df, **options).withColumn("_gl_stretch", F.expr("slot DIV 1000000"))
    d = d.repartition("shard", "_gl_stretch").sortWithinPartitions("shard", "slot").drop("_gl_stretch")
    d.write.partitionBy("shard").parquet(path)


def op8_stratified_interleave(spark, sf_dir: str) -> DataFrame:
    """Digests of all documents with shard and slot; law `rows`: shard counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return interleave(d, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
