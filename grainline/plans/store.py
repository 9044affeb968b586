"""The life of a graph store: encode to an archive, restore from it, and answer budgeted queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators import graph, predictors, segments, trees
from grainline.operators.ids import dense_ids, with_ids
from grainline.runtime import materialized
from grainline.sources.tables import archive, stored_bytes, unarchive


#: White space at a value's ends is part of it, and an empty value isn't null; null is a private-use character by itself.
AS_IS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "nullValue": "\uE0FF"}


def csv_line(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with `line`: the columns as one CSV line that from_csv() with AS_IS undoes."""
    return df.withColumn("line", F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), AS_IS))


def encode(edges: DataFrame, vertices: DataFrame | None, path: str, model: str = "order_k", edge_columns: tuple[str, ...] = (), vertex_columns: tuple[str, ...] = (), method: str = "word_bag", w: int = 4, chunk_rows: int = 4096) -> predictors.Model:
    """Writes an archive of edges (eid, src, dst, ...) and vertices (pos, key, ...), and returns the symbol model.

    Topology: dense ids, adjacency, symbols, then only the symbols that the model gets wrong, and the model
    itself. Attributes: CSV lines as trees of edit scripts, and their columns' names and types. The
    dictionary of ids is kept, so results can name original keys. query() needs the archive alone.
    """
    spark = edges.sparkSession
    ids = materialized(dense_ids(vertices, edges), "ids")
    symbols = segments.stream(with_ids(edges, ids))
    predict = segments.fit(symbols, model)
    kinds = [(t, c, d.schema[c].dataType.simpleString()) for t, d, cs in (("edge_tree", edges, edge_columns), ("vertex_tree", vertices, vertex_columns)) for c in cs]
    tables = {
        "ids": ids,
        "model": predictors.model_table(spark, predict),
        "columns": spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "place int, tree string, name string, type string").coalesce(1),
        "corrections": segments.corrections(symbols, predict),
        "edge_tree": trees.attribute_tree(csv_line(edges.withColumn("pos", F.col("eid")), list(edge_columns)), method, w, chunk_rows),
    }
    if vertices is not None:
        tables["vertex_tree"] = trees.attribute_tree(csv_line(vertices, list(vertex_columns)), method, w, chunk_rows)
        tables["vertex_pos"] = vertices.select("pos", "key")
    archive(tables, path)
    return predict


def topology(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, eid) of every edge of an archive, by dense ids."""
    t = unarchive(spark, path)
    return segments.edges(t["corrections"], predictors.model_of(t["model"]))


class Opened:
    """An archive whose topology is decoded once, into the shared folder, for any number of walks."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = unarchive(spark, path)
        self.edges = materialized(topology(spark, path), "edges")

    def query(self, starts: list[str], budget: int, backward: bool = False) -> tuple[DataFrame, DataFrame]:
        """(edges, nodes) that a budgeted walk from the keys meets, with the keys of their ends and their attributes; only hits' attributes are decoded."""
        t, spark = self.tables, self.edges.sparkSession
        ids = t["ids"]
        first = [r["vid"] for r in ids.join(F.broadcast(spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "o int, key string")), "key").orderBy("o").collect()]
        hits = materialized(graph.trace(graph.reversed_edges(self.edges) if backward else self.edges, first, budget), "hits")
        columns = t["columns"].orderBy("place").collect()

        def read(tree: str, wanted: DataFrame) -> DataFrame:
            lines, own = trees.lookup(t[tree], wanted, few=True), [c for c in columns if c["tree"] == tree]
            if not own:
                return lines.select("pos")
            row = F.from_csv("line", ", ".join(f"`{c['name']}` string" for c in own), AS_IS).alias("r")
            return lines.select("pos", row).select("pos", *[F.col(f"r.`{c['name']}`").cast(c["type"]).alias(c["name"]) for c in own])

        ends = hits.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        ends = ids.join(F.broadcast(ends), "vid")
        edge_rows = graph.edge_hits(hits, read("edge_tree", hits.select(F.col("eid").alias("pos"))).withColumnRenamed("pos", "eid"))
        for side in ("src", "dst"):
            edge_rows = edge_rows.join(ends.select(F.col("vid").alias(side), F.col("key").alias(f"{side}_key")), side)
        nodes = hits.groupBy(F.col("dst").alias("vid")).agg(F.min("seq").alias("seq"))
        nodes = ids.join(F.broadcast(nodes), "vid")
        if "vertex_tree" in t:
            at = nodes.join(t["vertex_pos"], "key", "left")
            nodes = at.join(read("vertex_tree", at.where("pos IS NOT NULL").select("pos")), "pos", "left").drop("pos")
        return edge_rows, nodes


def query(spark: SparkSession, path: str, starts: list[str], budget: int, backward: bool = False) -> tuple[DataFrame, DataFrame]:
    """Opened(path).query(...), for one walk. The archive is all it needs."""
    return Opened(spark, path).query(starts, budget, backward)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, files, bytes) of an archive's tables, and of all together as `total`."""
    d = stored_bytes(spark, path)
    return d.unionByName(d.agg(F.lit("total").alias("name"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")))
