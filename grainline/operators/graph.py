"""Adjacency and budgeted traversals. Frontiers are bounded by the budget; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.runtime import materialized


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, out): per source its (dst, eid) in order. Parallel edges and self-loops stay."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "eid"))).alias("out"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("eid", "src", "dst")])


def trace(edges: DataFrame, starts: list, budget: int) -> DataFrame:
    """(seq, hop, src, dst, eid): the edges that a first-in-first-out walk crosses, in order.

    Every crossed edge's end is queued again, seen before or not. The walk stops after the edge with
    which edges crossed and distinct ends found add up to the budget. Each level is one join of a
    frontier of at most `budget` rows, broadcast, with edges, and takes no more rows than can count.
    """
    spark, key = edges.sparkSession, edges.schema["src"].dataType
    frontier, nodes, rows, hop = list(starts), set(), [], 0
    while frontier and len(rows) + len(nodes) < budget:
        hop += 1
        f = spark.createDataFrame(list(enumerate(frontier)), "qpos long, src " + key.simpleString())
        level = edges.select("src", "dst", "eid").join(F.broadcast(f), "src").orderBy("qpos", "dst", "eid").limit(budget - len(rows) - len(nodes)).collect()
        frontier = []
        for r in level:
            rows.append((len(rows), hop, r["src"], r["dst"], r["eid"]))
            nodes.add(r["dst"])
            frontier.append(r["dst"])
            if len(rows) + len(nodes) >= budget:
                break
    k = key.simpleString()
    return spark.createDataFrame(rows, f"seq long, hop int, src {k}, dst {k}, eid long")


def trace_distinct(edges: DataFrame, start, budget: int) -> DataFrame:
    """As trace() from one start, with edges as a set and no node queued twice, so it ends on cycles."""
    spark, key = edges.sparkSession, edges.schema["src"].dataType
    frontier, nodes, rows, queued = [start], set(), [], {start}
    while frontier and len(rows) + len(nodes) < budget:
        f = spark.createDataFrame(list(enumerate(frontier)), "qpos long, src " + key.simpleString())
        level = edges.select("src", "dst", "eid").join(F.broadcast(f), "src").orderBy("qpos", "dst", "eid").limit(budget - len(rows) - len(nodes)).collect()
        frontier = []
        for r in level:
            rows.append((len(rows), r["src"], r["dst"], r["eid"]))
            nodes.add(r["dst"])
            if r["dst"] not in queued:
                queued.add(r["dst"])
                frontier.append(r["dst"])
            if len(rows) + len(nodes) >= budget:
                break
    k = key.simpleString()
    return spark.createDataFrame(rows, f"seq long, src {k}, dst {k}, eid long")


def best_first(edges: DataFrame, start, budget: int, weight: str = "weight") -> DataFrame:
    """(seq, src, dst, eid): always the heaviest edge that leaves a reached node and isn't taken; ties to the larger eid.

    A step asks for the heaviest open edges of the nodes reached by the last ones only: those of earlier
    nodes are held, at most budget of them. Stops as trace() does.
    """
    spark, key = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    reached, nodes, rows, fresh, open_edges = {start}, set(), [], [start], []
    while len(rows) + len(nodes) < budget:
        if fresh:
            f = spark.createDataFrame([(x,) for x in fresh], f"src {key}")
            found = edges.join(F.broadcast(f), "src").orderBy(F.desc(weight), F.desc("eid")).limit(budget).collect()
            open_edges = sorted(open_edges + [(r[weight], r["eid"], r["src"], r["dst"]) for r in found])[-budget:]
            fresh = []
        if not open_edges:
            break
        _, eid, src, dst = open_edges.pop()
        rows.append((len(rows), src, dst, eid))
        nodes.add(dst)
        if dst not in reached:
            reached.add(dst)
            fresh = [dst]
    return spark.createDataFrame(rows, f"seq long, src {key}, dst {key}, eid long")


def reach_levels(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, hop): every node within so many hops of starts (node), at its least hop. Distributed level by level."""
    seen = materialized(starts.select("node", F.lit(0).alias("hop")).distinct(), "reach")
    level = seen
    for h in range(1, hops + 1):
        new = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        level = materialized(new.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)), "reach")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def edge_hits(hits: DataFrame, attributes: DataFrame) -> DataFrame:
    """hits (seq, eid, src, dst) with edges' attributes (eid, ...), in the hits' order by seq."""
    return attributes.join(F.broadcast(hits), "eid", "right")


def node_hits(hits: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every distinct end of hits with nodes' attributes (id, ...); a node without any has its id alone."""
    ends = hits.groupBy(F.col("dst").alias("id")).agg(F.min("seq").alias("seq"))
    return attributes.join(F.broadcast(ends), "id", "right")


def as_json(df: DataFrame, columns: list[str], out: str = "json") -> DataFrame:
    """df's rows as JSON objects of the columns, without nulls."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))
