"""Log parsing, tables, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from grainline.sources import logs, tables
from grainline.streaming import ingest as streams


def wrapped(kind, record):
    return json.dumps({"datum": {logs.TYPE_PREFIX + kind: record}})


UID = "com.bbn.tc.schema.avro.cdm20.UUID"


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_defaults_nulls_and_non_objects(spark):
    rows = [
        wrapped("FileObject", {"uuid": "f1", "baseObject": {"properties": {"map": {"path": "/a"}}}}),
        wrapped("FileObject", {"uuid": None, "type": None, "baseObject": 5}),
        wrapped("MemoryObject", {"uuid": "m", "memoryAddress": 77}),
        wrapped("Host", {"uuid": "h", "interfaces": {"array": [{"name": "e", "ipAddresses": {"array": ["1", "2"]}}]}}),
        "{broken",
        "",
    ]
    got = {r.type + str(r.id): r for r in logs.vertices(logs.record_lines(lines(spark, rows))).collect()}
    assert got["FileObjectf1"].path == "/a" and got["FileObjectf1"].epoch == 0 and got["FileObjectf1"].internalType == ""
    assert got["FileObjectNone"].internalType is None and got["FileObjectNone"].path == ""
    assert got["MemoryObjectm"].size == 77
    assert got["Hosth"].interfacesIpAddresses == ["1,2"]
    assert len(got) == 4


def test_second_object_and_empty_first(spark):
    rows = [
        wrapped("Event", {"uuid": "e", "subject": {UID: "s"}, "predicateObject": {UID: "p"}, "predicateObject2": {UID: "q"}, "properties": {"map": {"flags": "x"}}}),
        wrapped("Event", {"uuid": "g", "subject": None}),
    ]
    got = sorted((r.id, r.subject_id, r.predicate_id, r.flags) for r in logs.event_edges(logs.record_lines(lines(spark, rows))).select("id", F.coalesce("subject_id", F.lit("")).alias("subject_id"), "predicate_id", "flags").collect())
    assert got == [("e", "s", "p", "x"), ("e", "s", "q", "x"), ("g", "", "", None)]


def test_audit_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "type": "P", "annotations": {"b": "2", "a": "1", "type": "Q"}}, {"from": "1", "to": "2", "type": "E", "annotations": {"z": "9"}}, {"x": "1"}]))
    nodes, edges = logs.audit_tables(spark, str(tmp_path / "a.json"))
    assert nodes.columns == ["id", "type", "a", "b"] and [tuple(r) for r in nodes.collect()] == [("1", "Q", "1", "2")]
    assert edges.columns == ["parentVertexHash", "childVertexHash", "type", "event id", "z"] and [tuple(r) for r in edges.collect()] == [("1", "2", "E", "", "9")]


def test_flat_edges_override(spark):
    d = logs.flat_edges(lines(spark, ['{"id": "1", "actorID": "a", "objectID": "o", "pid": 4, "properties": {"pid": "5"}}']))
    assert d.columns == ["id", "subject_id", "predicate_id", "pid"] and tuple(d.first()) == ("1", "a", "o", "5")


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "v.csv").write_text('hash,name\n1,"a,\nb"\n2,\n\n 3 ,x\n')
    d = tables.csv(spark, str(tmp_path / "v.csv"), "hash string, name string")
    assert {(r.hash.strip(), r.name) for r in d.collect()} == {("1", "a,\nb"), ("2", None), ("3", "x")}
    (tmp_path / "e.csv").write_text("src,dst\n1,2\n\n 3 , 4\n5,\n")
    assert sorted(map(tuple, tables.id_lines(spark, str(tmp_path / "e.csv"), ["src", "dst"]).collect())) == [("1", "2"), ("3", "4")]


def test_archive_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "é", None), (2, None, [1])], "a long, b string, c array<int>")
    tables.archive({"t": d, "none": d.limit(0)}, str(tmp_path / "z"))
    back = tables.unarchive(spark, str(tmp_path / "z"))
    assert sorted(map(tuple, back["t"].collect())) == [(1, "é", None), (2, None, [1])] and back["none"].count() == 0
    assert {r.name for r in tables.stored_bytes(spark, str(tmp_path / "z")).collect()} >= {"t"}
    tables.json_lines(d.select("a", "b"), str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1,"b":"é"}', '{"a":2}']


def test_ingest_appends_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: streams.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (src / "1.json").write_text(wrapped("FileObject", {"uuid": "f"}) + "\n" + wrapped("Event", {"uuid": "e", "predicateObject": {UID: "f"}}))
    run()
    (src / "2.json").write_text(wrapped("Event", {"uuid": "e2", "predicateObject": {UID: "f"}}))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/vertices")).count() == 1


PREFIX = "com.bbn.tc.schema.avro.cdm20."
SHORT = PREFIX + "SHORT"
#: A full record of each type, and what every column of it must be.
FULL = {
    "SrcSinkObject": ({"uuid": "a", "type": "T", "fileDescriptor": {"int": 3}, "baseObject": {"epoch": {"int": 4}, "properties": {"map": {"pid": "7"}}}}, {"id": "a", "internalType": "T", "fileDescriptor": 3, "epoch": 4, "pid": "7"}),
    "NetFlowObject": (
        {"uuid": "a", "localAddress": {"string": "l"}, "localPort": {"int": 1}, "remoteAddress": {"string": "r"}, "remotePort": {"int": 2}, "ipProtocol": {"int": 6}, "baseObject": {"epoch": {"int": 4}}},
        {"id": "a", "localAddress": "l", "localPort": 1, "remoteAddress": "r", "remotePort": 2, "ipProtocol": 6, "epoch": 4},
    ),
    "FileObject": ({"uuid": "a", "type": "T", "baseObject": {"permission": {SHORT: "0644"}, "epoch": {"int": 4}, "properties": {"map": {"path": "/p"}}}}, {"id": "a", "internalType": "T", "permission": "0644", "epoch": 4, "path": "/p"}),
    "Subject": (
        {
            "uuid": "a", "type": "T", "cid": 5, "parentSubject": {UID: "p"}, "localPrincipal": {UID: "q"}, "startTimestampNanos": {"long": 1557239724513000001}, "unitId": {"int": 1}, "iteration": {"int": 2}, "count": {"int": 3},
            "cmdLine": {"string": "ls"}, "properties": {"map": {"name": "n", "cwd": "/", "ppid": "1", "seen time": "9"}},
        },
        {
            "id": "a", "internalType": "T", "cid": 5, "parentSubject": "p", "localPrincipal": "q", "startTimestampNanos": 1557239724513000001, "unitId": 1, "iteration": 2, "count": 3, "cmdLine": "ls", "name": "n", "cwd": "/",
            "ppid": "1", "seen_time": "9",
        },
    ),
    "MemoryObject": ({"uuid": "a", "memoryAddress": 77, "baseObject": {"properties": {"map": {"tgid": "8"}}}}, {"id": "a", "memoryAddress": 77, "size": 77, "tgid": "8"}),
    "IpcObject": (
        {"uuid": "a", "type": "T", "fd1": {"int": 1}, "fd2": {"int": 2}, "baseObject": {"permission": {SHORT: "0600"}, "epoch": {"int": 4}, "properties": {"map": {"pid": "7", "subtype": "s", "path": "/p"}}}},
        {"id": "a", "internalType": "T", "fd1": 1, "fd2": 2, "pid": "7", "subtype": "s", "path": "/p", "permission": "0600", "epoch": 4},
    ),
    "Principal": ({"uuid": "a", "type": "T", "userId": "u", "groupIds": {"array": ["1", "2"]}, "properties": {"map": {"euid": "0"}}}, {"id": "a", "internalType": "T", "userId": "u", "groupIds": ["1", "2"], "euid": "0"}),
    "Host": (
        {
            "uuid": "a", "hostName": "h", "ta1Version": "v", "hostType": "d", "osDetails": {"string": "o"}, "hostIdentifiers": {"array": [{"idType": "x", "idValue": "1"}, {"idType": "y", "idValue": "2"}]},
            "interfaces": {"array": [{"name": "e0", "macAddress": "m", "ipAddresses": {"array": ["1", "2"]}}]},
        },
        {
            "id": "a", "hostName": "h", "ta1Version": "v", "hostType": "d", "osDetails": "o", "hostIdentifiersIdType": ["x", "y"], "hostIdentifiersIdValue": ["1", "2"], "interfacesName": ["e0"], "interfacesMacAddress": ["m"],
            "interfacesIpAddresses": ["1,2"],
        },
    ),
}


def test_every_column_of_every_record(spark):
    rows = {r.type: r for r in logs.vertices(logs.record_lines(lines(spark, [wrapped(k, record) for k, (record, _) in FULL.items()]))).collect()}
    assert set(rows) == set(logs.RECORDS) == set(FULL)
    for kind, (_, want) in FULL.items():
        assert set(want) == set(logs.RECORDS[kind])
        assert {c: rows[kind][c] for c in want} == want, kind


def test_missing_null_and_non_object_values_of_every_record(spark):
    """A missing value, or one below something that is no object, gives the default; an explicit null at the path's end stays null."""
    for make in (lambda record: {}, lambda record: {k: 5 if isinstance(v, dict) else v for k, v in record.items()}):
        rows = {r.type: r for r in logs.vertices(logs.record_lines(lines(spark, [wrapped(k, make(record)) for k, (record, _) in FULL.items()]))).collect()}
        for kind, (record, _) in FULL.items():
            for c, (path, type_, default) in logs.RECORDS[kind].items():
                if path.split(".")[0] in make(record) and "." not in path:
                    continue
                want = [] if type_.startswith("array") and "[*]" not in path and default is None else default
                assert rows[kind][c] in (want, None if type_.startswith("array") else want), (kind, c)
    null = wrapped("FileObject", {"uuid": "a", "baseObject": {"permission": {SHORT: None}, "epoch": {"int": None}}})
    r = logs.vertices(logs.record_lines(lines(spark, [null]))).first()
    assert (r.permission, r.epoch, r.path) == (None, None, "")


def test_structure_by_path(spark):
    rows = ['{"a": 1, "b": {"c d": "x", "e": [1, 2]}}', '{"a": "t", "b": {}}', '{"a": 2}', "{broken", '{"g": [{"h": true}, {"h": false}], "x<y": 1.5}']
    got = {(r.path, r.type): r.n for r in logs.structure(lines(spark, rows)).collect()}
    assert got == {("$.a", "BIGINT"): 2, ("$.a", "STRING"): 1, ("$.b.c d", "STRING"): 1, ("$.b.e[*]", "BIGINT"): 1, ("$.g[*].h", "BOOLEAN"): 1, ("$.x<y", "DECIMAL"): 1}


def test_an_output_for_each_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"log{k}.json").write_text("\n".join(f"{k} {i}" for i in range(k + 1)))
    tables.write_per_file(logs.log_files(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    for k in range(3):
        assert spark.read.parquet(str(tmp_path / "out" / f"file=log{k}.json")).count() == k + 1
    tables.write_tables({"one": spark.range(3), "two": spark.range(2)}, str(tmp_path / "csv"))
    assert [spark.read.option("header", True).csv(str(tmp_path / "csv" / n)).count() for n in ("one", "two")] == [3, 2]


def test_first_rows_of_vertices(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 5, "z")], "hash string, n int, p string").coalesce(1)
    ids, properties = tables.split_vertices(d, "toy")
    assert sorted(r.hash for r in ids.collect()) == ["a", "b"] and properties.columns == ["n", "p"] and sorted(r.p for r in properties.collect()) == ["x", "z"]
    assert sorted(r.p for r in tables.split_vertices(d, "toy", "n")[1].collect()) == ["y", "z"]
