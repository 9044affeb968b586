"""Queries of scans, splits, sinks and streams: each writes its files to the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainline.functions import codecs, editscript
from grainline.operators import predictors, templates, trees
from grainline.runtime import materialized, numbered, shared_dir
from grainline.sources import logs, tables
from grainline.streaming import ingest as streams

from .attribute_queries import _LINES, _lines, _records
from .attribute_queries import SQL as ATTRIBUTE_SQL
from .base import E_SQL, edges, table
from .graph_queries import _WRONG, _events, _sequence
from .graph_queries import SQL as GRAPH_SQL

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ scans


@query("SELECT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R'")
def id_lines_scan(spark, sf):
    """An id file with padded values; lines of returned items have a blank id and are no edges."""
    path = _folder(spark, "id-lines")
    d = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", F.lit("  ")).otherwise(F.concat(F.lit(" O"), "l_orderkey")).alias("src"), F.concat(F.lit("P"), "l_partkey", F.lit("  ")).alias("dst")
    )
    d.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.id_lines(spark, path, ["src", "dst"])


def _audit(spark, sf):
    """JSON arrays of up to 1,000 events each: clicks as nodes, all else as edges, the rest of each event as annotations."""
    path = _folder(spark, "audit")
    text = lambda c: F.col(c).cast("string")
    k = F.get_json_object("props", "$.k").alias("k")
    node = F.struct(text("event_id").alias("id"), F.col("event_type").alias("type"), F.struct(k, text("user_id").alias("user")).alias("annotations"))
    edge = F.struct(text("user_id").alias("from"), text("event_id").alias("to"), F.col("event_type").alias("type"), F.struct(text("event_id").alias("event id"), k).alias("annotations"))
    d = table(spark, sf, "events").select(F.expr("event_id DIV 1000").alias("b"), F.when(F.col("event_type") == "click", F.to_json(node)).otherwise(F.to_json(edge)).alias("j"))
    d.groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.partitionBy("b").text(path)
    return logs.audit_tables(spark, path)


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(user_id AS VARCHAR) AS \"user\" FROM events WHERE event_type = 'click'")
def audit_nodes(spark, sf):
    return _audit(spark, sf)[0]


@query("SELECT CAST(user_id AS VARCHAR) AS parentVertexHash, CAST(event_id AS VARCHAR) AS childVertexHash, event_type AS type, CAST(event_id AS VARCHAR) AS \"event id\", CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_type <> 'click'")
def audit_edges(spark, sf):
    return _audit(spark, sf)[1]


@query("SELECT 'O' || o_orderkey AS value, true AS own FROM orders")
def per_file_outputs(spark, sf):
    """Lines of a folder's files, written as one set of outputs a file; own says that a line lies under its file's name."""
    path = _folder(spark, "per-file")
    table(spark, sf, "orders").select("o_orderpriority", F.concat(F.lit("O"), "o_orderkey").alias("value")).write.partitionBy("o_orderpriority").text(f"{path}/in")
    lines = logs.log_files(spark, f"{path}/in", "*/*.txt")
    tables.write_per_file(lines.withColumn("origin", F.col("file")), f"{path}/out")
    return spark.read.parquet(f"{path}/out").select("value", (F.col("file") == F.col("origin")).alias("own"))


#: Record types' fields as (column, place in the record, value of a part, value where the record has none). A part is a record of the type
#: that its key modulo eight picks; records of parts of an odd size lack all fields.
_U, _S = "com|bbn|tc|schema|avro|cdm20|UUID", "com|bbn|tc|schema|avro|cdm20|SHORT"
_PROPERTIES = "baseObject.properties.map."
_FIELDS = {
    "SrcSinkObject": [("internalType", "type", "p_type", None), ("fileDescriptor", "fileDescriptor.int", "p_size", 0), ("epoch", "baseObject.epoch.int", "p_size", 0), ("pid", _PROPERTIES + "pid", "p_name", None)],
    "NetFlowObject": [
        ("localAddress", "localAddress.string", "p_name", ""), ("localPort", "localPort.int", "p_size", 0), ("remoteAddress", "remoteAddress.string", "p_brand", ""),
        ("remotePort", "remotePort.int", "p_size", 0), ("ipProtocol", "ipProtocol.int", "p_size", 0), ("epoch", "baseObject.epoch.int", "p_size", 0),
    ],
    "FileObject": [("internalType", "type", "p_type", ""), ("permission", f"baseObject.permission.{_S}", "p_brand", None), ("epoch", "baseObject.epoch.int", "p_size", 0), ("path", _PROPERTIES + "path", "p_name", "")],
    "Subject": [
        ("internalType", "type", "p_type", None), ("cid", "cid", "p_size", 0), ("parentSubject", f"parentSubject.{_U}", "p_name", None), ("localPrincipal", f"localPrincipal.{_U}", "p_brand", ""),
        ("startTimestampNanos", "startTimestampNanos.long", "p_partkey", 0), ("unitId", "unitId.int", "p_size", 0), ("iteration", "iteration.int", "p_size", None), ("count", "count.int", "p_size", None),
        ("cmdLine", "cmdLine.string", "p_name", None), ("name", "properties.map.name", "p_name", ""), ("cwd", "properties.map.cwd", "p_brand", ""), ("ppid", "properties.map.ppid", "p_type", ""),
        ("seen_time", "properties.map.seen time", "p_name", ""),
    ],
    "MemoryObject": [("memoryAddress", "memoryAddress", "p_partkey", 0), ("size", None, "p_partkey", 0), ("tgid", _PROPERTIES + "tgid", "p_name", "")],
    "IpcObject": [
        ("internalType", "type", "p_type", ""), ("fd1", "fd1.int", "p_size", None), ("fd2", "fd2.int", "p_size", None), ("pid", _PROPERTIES + "pid", "p_name", ""), ("subtype", _PROPERTIES + "subtype", "p_brand", ""),
        ("path", _PROPERTIES + "path", "p_name", ""), ("permission", f"baseObject.permission.{_S}", "p_brand", ""), ("epoch", "baseObject.epoch.int", "p_size", 0),
    ],
    "Principal": [("internalType", "type", "p_type", None), ("userId", "userId", "p_name", None), ("euid", "properties.map.euid", "p_brand", None)],
    "Host": [("hostName", "hostName", "p_name", None), ("ta1Version", "ta1Version", "p_brand", None), ("hostType", "hostType", "p_type", None), ("osDetails", "osDetails.string", "p_name", None)],
}
#: The array columns, joined by |: (type, column, SQL of the joined value, SQL where the record has none).
_ARRAYS = [
    ("Principal", "groupIds", "p_name || '|7'", "''"),
    ("Host", "hostIdentifiersIdType", "'serial|' || p_type", "NULL"),
    ("Host", "hostIdentifiersIdValue", "p_name || '|' || p_brand", "NULL"),
    ("Host", "interfacesName", "'lo|' || p_name", "NULL"),
    ("Host", "interfacesMacAddress", "'0|' || p_brand", "NULL"),
    ("Host", "interfacesIpAddresses", "'10.0.0.1,10.0.0.2|' || p_name", "NULL"),
]


def _record_sql():
    kinds = list(_FIELDS)
    by_column = {}
    for kind, found in _FIELDS.items():
        for column, _, value, missing in found:
            by_column.setdefault(column, []).append((kind, value, "NULL" if missing is None else "''" if missing == "" else str(missing)))
    for kind, column, value, missing in _ARRAYS:
        by_column.setdefault(column, []).append((kind, value, missing))
    case = lambda found: " ".join(f"WHEN '{kind}' THEN CASE WHEN p_size % 2 = 0 THEN {value} ELSE {missing} END" for kind, value, missing in found)
    out = ", ".join(f'CASE type {case(found)} END AS "{column}"' for column, found in by_column.items())
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"WITH p AS (SELECT *, [{names}][p_partkey % 8 + 1] AS type FROM part) SELECT CAST(p_partkey AS VARCHAR) AS id, type, {out} FROM p"


def _nested(fields):
    """A struct of {place: column}, places split at dots; | within a place stands for a dot."""
    inner = {}
    for place, c in fields.items():
        head, _, rest = place.partition(".")
        inner.setdefault(head, {})[rest] = c
    return F.struct(*[(found[""] if "" in found else _nested(found)).alias(head.replace("|", ".")) for head, found in inner.items()])


@query(_record_sql())
def record_types(spark, sf):
    """Parts as records of all eight vertex types in the log's JSON, every column parsed; odd sizes leave everything out."""
    even = lambda c: F.when(F.col("p_size") % 2 == 0, c)
    arrays = {
        "Principal": {"groupIds.array": F.array("p_name", F.lit("7"))},
        "Host": {
            "hostIdentifiers.array": F.array(F.struct(F.lit("serial").alias("idType"), F.col("p_name").alias("idValue")), F.struct(F.col("p_type").alias("idType"), F.col("p_brand").alias("idValue"))),
            "interfaces.array": F.array(
                F.struct(F.lit("lo").alias("name"), F.lit("0").alias("macAddress"), F.struct(F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2")).alias("array")).alias("ipAddresses")),
                F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("macAddress"), F.struct(F.array("p_name").alias("array")).alias("ipAddresses")),
            ),
        },
    }
    value = None
    for k, (kind, found) in enumerate(_FIELDS.items()):
        fields = {place: even(F.col(c)) for _, place, c, _ in found if place} | {p: even(c) for p, c in arrays.get(kind, {}).items()}
        line = F.to_json(F.create_map(F.lit("datum"), F.create_map(F.lit(logs.TYPE_PREFIX + kind), _nested({"uuid": F.col("p_partkey").cast("string")} | fields))))
        at = F.col("p_partkey") % 8 == k
        value = F.when(at, line) if value is None else value.when(at, line)
    v = logs.vertices(logs.record_lines(table(spark, sf, "part").select(value.alias("value"))))
    return v.select(*[F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in v.dtypes])


# ------------------------------------------------------------------ splits and sinks


@query("SELECT DISTINCT user_id AS id FROM events")
def vertex_split_ids(spark, sf):
    return _vertex_split(spark, sf)[0]


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def vertex_split_properties(spark, sf):
    """What a vertex table holds besides ids, of each id's first row."""
    return _vertex_split(spark, sf)[1]


def _vertex_split(spark, sf):
    return tables.split_vertices(table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value"), "tc", "event_id")


def _edge_split(spark, sf, name, schema):
    path = _folder(spark, "edge-split")
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("parentVertexHash"), F.col("o_orderkey").alias("childVertexHash"), "o_orderstatus", "o_totalprice")
    tables.write_tables(dict(zip(("ids", "properties"), tables.split_edges(d, "toy"), strict=True)), path)
    return tables.csv(spark, f"{path}/{name}", schema)


@query("SELECT o_custkey AS parentVertexHash, o_orderkey AS childVertexHash FROM orders")
def edge_split_ids(spark, sf):
    return _edge_split(spark, sf, "ids", "parentVertexHash bigint, childVertexHash bigint")


@query("SELECT o_orderstatus, o_totalprice FROM orders")
def edge_split_properties(spark, sf):
    return _edge_split(spark, sf, "properties", "o_orderstatus string, o_totalprice double")


@query(f"WITH {E_SQL} SELECT src || ',' || dst AS value FROM E")
def edge_list_lines(spark, sf):
    path = _folder(spark, "edge-list")
    tables.edge_list(edges(spark, sf), path)
    return spark.read.text(path)


@query(GRAPH_SQL["packed_roundtrip"])
def packed_json(spark, sf):
    """Packed groups as JSON lines, read back and unpacked."""
    path = _folder(spark, "packed-json")
    groups = codecs.packed_groups(_events(spark, sf))
    tables.json_lines(groups, path)
    d = spark.read.text(path).select(F.from_json("value", groups.schema).alias("g")).select("g.*")
    return codecs.unpacked_groups(d)


@query(_LINES)
def payload_append(spark, sf):
    """An attribute tree written chunk after chunk, the last one twice, and restored."""
    path = _folder(spark, "payloads")
    tree = materialized(trees.attribute_tree(_lines(spark, sf), "word_bag", 4, chunk_rows=256), "tree")
    last = tree.agg(F.max("chunk")).first()[0]
    for part in (tree.where(F.col("chunk") != last), tree.where(F.col("chunk") == last), tree.where(F.col("chunk") == last)):
        trees.append(part, path)
    return trees.decoded(spark.read.schema(tree.schema).parquet(path))


@query(f"{_WRONG} SELECT (SELECT count(*) FROM q) AS n, count(*) AS wrong, count(*) / (SELECT count(*) FROM q) AS ratio FROM x")
def stored_model_ratio(spark, sf):
    """How often a model that was written and loaded again is wrong."""
    s, path = materialized(_sequence(spark, sf), "sequence"), _folder(spark, "model")
    predictors.model_table(spark, predictors.fit(predictors.windows(s), "order_k", k=2)).write.parquet(path)
    return predictors.accuracy(s, predictors.corrections(s, predictors.model_of(spark.read.parquet(path))))


@query(
    GRAPH_SQL["corr_gaps"].replace("SELECT seg, pos, sym, pos -", ", g AS (SELECT seg, pos, sym, pos -")
    + """) SELECT seg, string_agg(CASE WHEN gap >= 128 THEN lower(printf('%04X', (gap // 128) | 32768)) ELSE '' END || lower(printf('%02X%02X', gap % 128, sym)), '' ORDER BY pos) AS data FROM g GROUP BY seg"""
)
def correction_bytes(spark, sf):
    """Each segment's corrections as bytes, in hexadecimal."""
    s = materialized(_sequence(spark, sf), "sequence")
    d = predictors.gaps(predictors.corrections(s, predictors.fit(predictors.windows(s), "order_k", k=2)))
    d = d.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("pos", "gap", "sym"))).alias("c"))

    def run(batches):
        for rows in batches:
            rows["data"] = [editscript.gap_bytes([int(x) for x in g], [int(x) for x in y]).hex() for g, y in zip(rows["gap"], rows["sym"], strict=True)]
            yield rows[["seg", "data"]]

    return d.select("seg", F.col("c.gap").alias("gap"), F.col("c.sym").alias("sym")).mapInPandas(run, "seg bigint, data string")


# ------------------------------------------------------------------ values and tokens


@query("SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value FROM events")
def whole_numbers(spark, sf):
    return table(spark, sf, "events").select("event_id", templates.whole_number(F.col("value")).alias("value"))


@query("SELECT event_id, right(CAST(event_id * 7919 AS VARCHAR), 4) AS last FROM events")
def token_tails(spark, sf):
    """The last four digits' symbols of a number."""
    d = table(spark, sf, "events").select("event_id", templates.tail(codecs.digits(F.col("event_id") * 7919), 4).alias("t"))
    return d.select("event_id", F.array_join(F.transform("t", lambda x: x.cast("string")), "").alias("last"))


@query(
    """WITH v AS (SELECT 0 AS side, n_nationkey AS id, n_name AS t FROM nation UNION ALL SELECT 1, s_suppkey, s_name FROM supplier),
    x AS (SELECT side, id, unnest(range(length(t))) AS step, t FROM v) SELECT row_number() OVER (ORDER BY side, id, step) - 1 AS pos, ascii(substr(t, step + 1, 1)) AS token FROM x"""
)
def token_streams_joined(spark, sf):
    """One stream: the characters of all vertices' names, then those of all edges' names, numbered through."""
    chars = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    one = lambda t, kind, key, name: templates.steps(table(spark, sf, t).select(key, chars(F.col(name)).alias("s")), kind, key, "s")
    both = one("nation", "0", "n_nationkey", "n_name").unionByName(one("supplier", "1", "s_suppkey", "s_name"))
    return numbered(both, ["kind", "id", "step"], "pos").select("pos", "token")


@query(
    """WITH d AS (SELECT DISTINCT 'user' AS col, CAST(user_id AS VARCHAR) AS value FROM events UNION SELECT 'user', CAST(c_custkey AS VARCHAR) FROM customer
    UNION SELECT 'type', event_type FROM events UNION SELECT 'segment', c_mktsegment FROM customer) SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS code FROM d"""
)
def shared_dictionary(spark, sf):
    """One dictionary over the columns of vertices and edges together."""
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("type"))
    return templates.value_dictionary(v.unionByName(e, allowMissingColumns=True), ["user", "type", "segment"])


# ------------------------------------------------------------------ streams


@query(ATTRIBUTE_SQL["second_object_explode"])
def stream_ingest(spark, sf):
    """Log files read as a stream: the edges that all batches appended."""
    path = _folder(spark, "stream")
    _records(spark, sf).write.text(f"{path}/in")
    streams.ingest(spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out/edges").select("id", "subject_id", "predicate_id", "sequence", "timestampNanos", "threadId")


@query(
    """SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2
    HAVING max(date_trunc('hour', ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def stream_counts(spark, sf):
    """Events a type and hour, of a stream of files: the hours that the watermark has closed."""
    path = _folder(spark, "stream-counts")
    table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.parquet(f"{path}/in")
    counts = streams.windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(f"{path}/in"))
    counts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.unix_seconds("start").alias("start"), "event_type", "n")
