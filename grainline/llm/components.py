"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written_path


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that a path reaches.

    Nodes can be of any type with an order. Loops, repeated edges and edges with a null end add
    nothing; an empty table gives an empty one. Each round writes its edges to the shared folder, so
    lineage stays short and a lost executor costs one round at most; rounds go on until nothing
    changes. Only minima of groups are aggregated, never whole groups.
    """
    spark = edges.sparkSession
    current = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    schema = current.schema
    path = written_path(current, name)
    current = spark.read.schema(schema).parquet(path)
    before = _signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = written_path(small, name)
        remove(spark, path)
        path, current = new, spark.read.schema(schema).parquet(new)
        now = _signature(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
