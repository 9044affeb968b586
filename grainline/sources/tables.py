"""Vertex and edge tables from CSV, result and archive sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators.ids import keep_first

#: Per layout, the columns that hold ids: (vertex id, edge source, edge destination, edge id).
LAYOUTS = {
    "toy": ("hash", "parentVertexHash", "childVertexHash", "hash"),
    "tc": ("id", "subject_id", "predicate_id", "id"),
    "optc": (None, "subject_id", "predicate_id", "id"),
    "audit": ("id", "parentVertexHash", "childVertexHash", None),
}


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header: typed by the schema, or by one pass over the whole file.

    Fields may be quoted and hold line breaks. pos is the row's place among the rows of its file.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def id_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An id file: header skipped, values stripped, blank lines and lines with an empty id left out."""
    d = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    d = d.select(*[F.trim(c).alias(c) for c in columns])
    return d.where(" AND ".join(f"`{c}` <> ''" for c in columns))


def split_vertices(df: DataFrame, layout: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ids, properties) of a vertex table, first row of each id only: by `order`, else as the table is read."""
    key = LAYOUTS[layout][0]
    d = df if order else df.withColumn("_read", F.monotonically_increasing_id())
    d = keep_first(d, [key], [order or "_read"]).drop("_read")
    return d.select(key), d.drop(key)


def split_edges(df: DataFrame, layout: str) -> tuple[DataFrame, DataFrame]:
    """(source and destination, properties) of an edge table; id columns that are absent are no error."""
    _, src, dst, eid = LAYOUTS[layout]
    return df.select(src, dst), df.drop(src, dst, *([eid] if eid else []))


def with_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """df with missing columns added and nulls filled by a default."""
    return df.select("*", *[F.lit(v).alias(c) for c, v in defaults.items() if c not in df.columns]).na.fill(defaults)


def archive(tables: dict[str, DataFrame], path: str, codec: str = "zstd") -> None:
    """Every table as compressed Parquet below path, and a manifest of names, rows and schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count(), df.schema.json()))
    spark.createDataFrame(rows, "name string, n long, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest.json")


def unarchive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive, by its manifest."""
    from pyspark.sql.types import StructType

    rows = spark.read.json(f"{path}/_manifest.json", schema="name string, n long, schema string").collect()
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['name']}") for r in rows}


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(name, files, bytes) of an archive's tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    name = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header, in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def write_per_file(df: DataFrame, path: str, file: str = "file") -> None:
    """A set of outputs for each input file: rows with the file's name go to a folder of that name."""
    df.write.mode("overwrite").partitionBy(file).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON objects without nulls, one a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def edge_list(edges: DataFrame, path: str) -> None:
    """Plain `src,dst` lines."""
    edges.select(F.concat_ws(",", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def upsert_sink(df: DataFrame, connect, key: str = "id") -> None:
    """Rows to a store that updates by key. connect() is called once per partition on its executor and
    returns a function that takes a list of row dicts; a repeated task writes the same rows again."""

    def send(rows) -> None:
        write, held = connect(), []
        for r in rows:
            held.append({k: v for k, v in r.asDict(True).items() if v is not None})
            if len(held) == 1000:
                write(held)
                held = []
        if held:
            write(held)

    df.where(F.col(key).isNotNull()).foreachPartition(send)
