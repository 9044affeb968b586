"""Audit and provenance logs as vertex and edge tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators.ids import upsert

#: The prefix of record types in JSON lines, and the keys of wrapped ids and short numbers.
TYPE_PREFIX = "com.bbn.tc.schema.avro.cdm20."
WRAPPED = {"U": '["com.bbn.tc.schema.avro.cdm20.UUID"]', "S": '["com.bbn.tc.schema.avro.cdm20.SHORT"]'}
#: Per record type, output column -> (JSON path below the record, Spark type, default).
#: `U` ends a path at a wrapped id, `S` at a wrapped short number. A null default leaves the column null where the path is missing.
RECORDS: dict[str, dict[str, tuple[str, str, object]]] = {
    "SrcSinkObject": {
        "id": ("uuid", "string", None), "internalType": ("type", "string", None), "fileDescriptor": ("fileDescriptor.int", "int", 0),
        "epoch": ("baseObject.epoch.int", "int", 0), "pid": ("baseObject.properties.map.pid", "string", None),
    },
    "NetFlowObject": {
        "id": ("uuid", "string", ""), "localAddress": ("localAddress.string", "string", ""), "localPort": ("localPort.int", "int", 0),
        "remoteAddress": ("remoteAddress.string", "string", ""), "remotePort": ("remotePort.int", "int", 0), "ipProtocol": ("ipProtocol.int", "int", 0), "epoch": ("baseObject.epoch.int", "int", 0),
    },
    "FileObject": {
        "id": ("uuid", "string", ""), "internalType": ("type", "string", ""), "permission": ("baseObject.permission.S", "string", None),
        "epoch": ("baseObject.epoch.int", "int", 0), "path": ("baseObject.properties.map.path", "string", ""),
    },
    "Subject": {
        "id": ("uuid", "string", None), "internalType": ("type", "string", None), "cid": ("cid", "int", 0), "parentSubject": ("parentSubject.U", "string", None), "localPrincipal": ("localPrincipal.U", "string", ""),
        "startTimestampNanos": ("startTimestampNanos.long", "bigint", 0), "unitId": ("unitId.int", "int", 0), "iteration": ("iteration.int", "int", None), "count": ("count.int", "int", None),
        "cmdLine": ("cmdLine.string", "string", None), "name": ("properties.map.name", "string", ""), "cwd": ("properties.map.cwd", "string", ""), "ppid": ("properties.map.ppid", "string", ""),
        "seen_time": ("properties.map.seen time", "string", ""),
    },
    # size really is the address: results must agree with logs parsed before
    "MemoryObject": {"id": ("uuid", "string", None), "memoryAddress": ("memoryAddress", "bigint", 0), "size": ("memoryAddress", "bigint", 0), "tgid": ("baseObject.properties.map.tgid", "string", "")},
    "IpcObject": {
        "id": ("uuid", "string", ""), "internalType": ("type", "string", ""), "fd1": ("fd1.int", "int", None), "fd2": ("fd2.int", "int", None), "pid": ("baseObject.properties.map.pid", "string", ""),
        "subtype": ("baseObject.properties.map.subtype", "string", ""), "path": ("baseObject.properties.map.path", "string", ""), "permission": ("baseObject.permission.S", "string", ""), "epoch": ("baseObject.epoch.int", "int", 0),
    },
    "Principal": {"id": ("uuid", "string", None), "internalType": ("type", "string", None), "userId": ("userId", "string", None), "groupIds": ("groupIds.array", "array<string>", None), "euid": ("properties.map.euid", "string", None)},
    "Host": {
        "id": ("uuid", "string", None), "hostName": ("hostName", "string", None), "ta1Version": ("ta1Version", "string", None), "hostType": ("hostType", "string", None), "osDetails": ("osDetails.string", "string", None),
        "hostIdentifiersIdType": ("hostIdentifiers.array[*].idType", "array<string>", None), "hostIdentifiersIdValue": ("hostIdentifiers.array[*].idValue", "array<string>", None),
        "interfacesName": ("interfaces.array[*].name", "array<string>", None), "interfacesMacAddress": ("interfaces.array[*].macAddress", "array<string>", None),
        "interfacesIpAddresses": ("interfaces.array[*].ipAddresses.array", "array<string>", None),
    },
}
#: The same for events, whose two objects give an edge each.
EVENT = {
    "id": ("uuid", "string", None), "subject_id": ("subject.U", "string", ""), "predicate_id": ("predicateObject.U", "string", ""), "predicate_id2": ("predicateObject2.U", "string", ""), "sequence": ("sequence.long", "bigint", 0),
    "type": ("type", "string", ""), "threadId": ("threadId.int", "int", 0), "timestampNanos": ("timestampNanos", "bigint", 0), "size": ("size.long", "bigint", None),
    **{k: (f"properties.map.{k}", "string", None) for k in ("flags", "opm", "protection", "signal", "mode", "operation")},
}


def at_path(record: Column, path: str, kind: str, default: object = None, root: str = "$") -> Column:
    """A nested value; the default where a key is missing or something on the way is no object. A null stays null.

    [*] takes a path of every element of an array, and inner arrays are comma-joined.
    """
    head, each, rest = path.partition("[*].")
    steps = [WRAPPED.get(s, f'["{s}"]') for s in head.split(".")]
    whole = root + "".join(steps)
    if kind.startswith("array"):
        items = F.try_variant_get(record, whole, "array<variant>")
        if each:
            inner = "$" + "".join(f'["{s}"]' for s in rest.split("."))
            if rest.endswith(".array"):
                return F.transform(items, lambda x: F.array_join(F.try_variant_get(x, inner, "array<string>"), ","))
            return F.transform(items, lambda x: F.try_variant_get(x, inner, "string"))
        return F.coalesce(F.transform(items, lambda x: x.cast("string")), F.array().cast("array<string>"))
    value = F.try_variant_get(record, whole, kind)
    if default is None:
        return value
    there = F.try_variant_get(record, whole, "variant")
    return F.when(there.isNull(), F.lit(default).cast(kind)).otherwise(value)


def record_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(type, record variant) of JSON lines {"datum": {"<prefix><type>": {...}}}. Broken lines are left out, or raise if strict.

    The type is read off the line, so that a filter on it comes before parsing.
    """
    kind = F.regexp_extract("value", r'"datum"\s*:\s*\{\s*"' + TYPE_PREFIX.replace(".", r"\.") + r'(\w+)"', 1)
    d = lines.select(kind.alias("type"), "value")
    parse = F.parse_json if strict else F.try_parse_json
    return d.where("type <> ''").select("type", parse("value").alias("record"))


def _root(kind: str) -> str:
    return f'$["datum"]["{TYPE_PREFIX}{kind}"]'


def vertices(records: DataFrame) -> DataFrame:
    """All known vertex types' records in one table, the union of their columns; other types give no row.

    One pass: a column is taken from the path that its row's type has for it.
    """
    by_column: dict[str, list[tuple[str, tuple[str, str, object]]]] = {}
    for kind, columns in RECORDS.items():
        for c, spec in columns.items():
            by_column.setdefault(c, []).append((kind, spec))
    out = [F.col("type")]
    for c, found in by_column.items():
        value = F.lit(None).cast(found[0][1][1])
        for kind, spec in found:
            value = F.when(F.col("type") == kind, at_path(F.col("record"), *spec, root=_root(kind))).otherwise(value)
        out.append(value.alias(c))
    return records.where(F.col("type").isin(*RECORDS) & F.col("record").isNotNull()).select(*out)


def event_edges(records: DataFrame) -> DataFrame:
    """One edge per event, and a second to its second object if there is one."""
    d = records.where("type = 'Event' AND record IS NOT NULL").select(*[at_path(F.col("record"), *spec, root=_root("Event")).alias(c) for c, spec in EVENT.items()])
    ends = F.concat(F.array("predicate_id"), F.filter(F.array("predicate_id2"), lambda x: x != ""))
    columns = [c for c in EVENT if c not in ("predicate_id", "predicate_id2")]
    d = d.select(*columns, F.posexplode(ends).alias("_k", "predicate_id"))
    return d.select("id", "subject_id", "predicate_id", *columns[2:])


def flat_edges(lines: DataFrame, properties: list[str] | None = None) -> DataFrame:
    """Edges of JSON lines {id, actorID, objectID, ..., properties{...}}: properties override, ids come first."""
    d = lines.select(F.from_json("value", "map<string,string>").alias("m")).where("m IS NOT NULL")
    inner = F.coalesce(F.from_json(F.try_element_at("m", F.lit("properties")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = override(F.map_filter("m", lambda k, v: k != "properties"), inner)
    d = d.select(F.transform_keys(merged, lambda k, v: F.when(k == "actorID", "subject_id").when(k == "objectID", "predicate_id").otherwise(k)).alias("m"))
    keys = properties or sorted(r["k"] for r in d.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())
    first = ["id", "subject_id", "predicate_id"]
    return d.select(*[F.try_element_at("m", F.lit(k)).alias(k) for k in [*first, *[k for k in keys if k not in first]]])


def override(base: Column, over: Column) -> Column:
    """Two maps as one; the second's value holds where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def classified(rows: DataFrame, column: str = "m") -> DataFrame:
    """rows (a map) with kind: node if it has id and type, else edge if it has from, to and type, else skipped."""
    has = lambda *ks: F.expr(" AND ".join(f"map_contains_key({column}, '{k}')" for k in ks))
    return rows.withColumn("kind", F.when(has("id", "type"), "node").when(has("from", "to", "type"), "edge").otherwise("skipped"))


def audit_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON array of objects with annotations; annotation keys become sorted columns."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m")).where("m IS NOT NULL")
    notes = F.coalesce(F.from_json(F.try_element_at("m", F.lit("annotations")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    d = classified(rows).select("kind", override(F.map_filter("m", lambda k, v: k != "annotations"), notes).alias("m"))

    def table(kind: str, first: dict[str, str]) -> DataFrame:
        own = d.where(F.col("kind") == kind)
        keys = sorted({r["k"] for r in own.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect()} - set(first))
        value = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
        return own.select(*[value(k).alias(out) for k, out in first.items()], *[value(k).alias(k) for k in keys])

    nodes = table("node", {"id": "id", "type": "type"})
    return nodes, table("edge", {"from": "parentVertexHash", "to": "childVertexHash", "type": "type", "event id": "event id"})


def _scalars(kind: str, path: str = "$") -> list[tuple[str, str]]:
    """(path, type) of each scalar in a variant's type, as OBJECT<a: BIGINT, `b c`: ARRAY<STRING>>."""
    if kind.startswith("ARRAY<"):
        return _scalars(kind[6:-1], path + "[*]")
    if not kind.startswith("OBJECT<"):
        return [(path, kind.partition("(")[0])]
    out, inner = [], kind[7:-1]
    while inner:
        if inner[0] == "`":
            end = re.match(r"`((?:[^`]|``)*)`: ", inner)
            key = end[1].replace("``", "`")
        else:
            end = re.match(r"([^:]*): ", inner)
            key = end[1]
        inner, depth, at = inner[end.end() :], 0, 0
        quoted = False
        while at < len(inner) and (depth or quoted or inner[at] != ","):
            quoted ^= inner[at] == "`"
            depth += (inner[at] in "<(") * (not quoted) - (inner[at] in ">)") * (not quoted)
            at += 1
        out += _scalars(inner[:at], f"{path}.{key}")
        inner = inner[at + 2 :]
    return out


def structure(values: DataFrame, column: str = "value") -> DataFrame:
    """(path, type, n) of every scalar in JSON texts: where it stands, of what type, in how many texts.

    A path of several types has a row for each. [*] stands for an array's elements; where an array's
    elements differ in type, that is VARIANT. An empty object or array gives no row.
    """
    d = values.select(F.try_parse_json(column).alias("v")).where("v IS NOT NULL").select(F.schema_of_variant("v").alias("type"))
    kinds = d.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for rows in batches:
            found = [(p, t, int(n)) for kind, n in zip(rows["type"], rows["n"], strict=True) for p, t in dict.fromkeys(_scalars(kind))]
            yield pd.DataFrame(found, columns=["path", "type", "n"])

    d = kinds.mapInPandas(run, "path string, type string, n bigint")
    return d.groupBy("path", "type").agg(F.sum("n").alias("n"))


def merged_structure(values: DataFrame, column: str = "value") -> str:
    """One schema for all JSON texts, colliding types as VARIANT."""
    return values.select(F.try_parse_json(column).alias("v")).agg(F.schema_of_variant_agg("v")).first()[0]


def log_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, value): lines of every file of a folder, by file."""
    return spark.read.text(f"{folder}/{pattern}").select(F.col("_metadata.file_name").alias("file"), "value")


def latest(rows: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """What a database that updates in place would hold after all rows."""
    return upsert(rows, key, order)
