"""Queries of parsing, similarity, edit scripts, attribute trees, templates and archives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainline.functions import editscript
from grainline.operators import ids, records, similarity, templates, trees
from grainline.runtime import materialized, running, shared_dir
from grainline.sources import logs, tables

from .base import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ------------------------------------------------------------------ logs and JSON


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return d.select("event_id", logs.at_path(F.col("v"), "k", "bigint").alias("k"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS subject_id, event_type AS predicate_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_flatten_override(spark, sf):
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("actorID"), F.col("event_type").alias("objectID"), F.lit("gone").alias("k"), F.from_json("props", "map<string,string>").alias("properties")))
    return logs.flat_edges(e.select(line.alias("value")), ["k"])


_MADE = "SELECT p_partkey, p_name, p_size, p_type FROM part"


def _records(spark, sf):
    """Parts as file records and line items as events on a part and a supplier, in the log's JSON."""
    uid = lambda c: F.create_map(F.lit("com.bbn.tc.schema.avro.cdm20.UUID"), c.cast("string"))
    wrap = lambda kind, s: F.to_json(F.create_map(F.lit("datum"), F.create_map(F.lit(logs.TYPE_PREFIX + kind), s)))
    part = table(spark, sf, "part").select(
        wrap("FileObject", F.struct(F.col("p_partkey").cast("string").alias("uuid"), F.col("p_type").alias("type"), F.struct(F.struct(F.col("p_size").alias("int")).alias("epoch"), F.struct(F.struct(F.col("p_name").alias("path")).alias("map")).alias("properties")).alias("baseObject"))).alias("value")
    )
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    line = line.select(
        wrap(
            "Event",
            F.struct(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uuid"), F.lit("EVENT_READ").alias("type"), uid(F.col("l_orderkey")).alias("subject"), uid(F.col("p")).alias("predicateObject"),
                F.when(F.col("s") % 2 == 0, uid(F.col("s"))).alias("predicateObject2"), F.struct(F.col("l_linenumber").cast("bigint").alias("long")).alias("sequence"), F.lit(1557239724513000000).alias("timestampNanos"),
            ),
        ).alias("value")
    )
    broken = spark.createDataFrame([("{not json",), ("",), ('{"datum": {"com.bbn.tc.schema.avro.cdm20.TimeMarker": {"tsNanos": 1}}}',)], "value string")
    return part.unionByName(line).unionByName(broken)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'FileObject' AS type, p_type AS internalType, p_size AS epoch, p_name AS path FROM part")
def record_vertices(spark, sf):
    v = logs.vertices(logs.record_lines(_records(spark, sf)))
    return v.select("id", "type", "internalType", "epoch", "path")


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)
    SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS subject_id, CAST(p AS VARCHAR) AS predicate_id, CAST(l_linenumber AS BIGINT) AS sequence, 1557239724513000000 AS timestampNanos, 0 AS threadId FROM e
    UNION ALL SELECT l_orderkey || '-' || l_linenumber, CAST(l_orderkey AS VARCHAR), CAST(s AS VARCHAR), CAST(l_linenumber AS BIGINT), 1557239724513000000, 0 FROM e WHERE s % 2 = 0"""
)
def second_object_explode(spark, sf):
    return logs.event_edges(logs.record_lines(_records(spark, sf))).select("id", "subject_id", "predicate_id", "sequence", "timestampNanos", "threadId")


@query(
    """SELECT CASE WHEN event_type = 'click' THEN 'node' WHEN event_type = 'view' THEN 'edge' ELSE 'skipped' END AS kind, count(*) AS n FROM events GROUP BY 1"""
)
def route_nodes_edges(spark, sf):
    e = table(spark, sf, "events")
    m = F.when(F.col("event_type") == "click", F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("type"), F.lit("x"), F.lit("from"), F.lit("1"), F.lit("to"), F.lit("2")))
    m = m.when(F.col("event_type") == "view", F.create_map(F.lit("from"), F.lit("1"), F.lit("to"), F.lit("2"), F.lit("type"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("id"), F.lit("1")))
    return logs.classified(e.select(m.alias("m"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS k FROM events")
def annotation_keys(spark, sf):
    d = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("k"))
    return d.distinct()


@query(
    """WITH j AS (SELECT CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '{"k": "' || event_type || '", "in": {"t": [' || event_id || ']}}' ELSE '{"k": null}' END AS v FROM events),
    p AS (SELECT unnest(['k', 'in.t[0]']) AS place, v FROM j), t AS (SELECT '$.' || replace(place, '[0]', '[*]') AS path, json_type(v, '$.' || place) AS type FROM p)
    SELECT path, CASE type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE type END AS type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY ALL"""
)
def json_structure(spark, sf):
    """Paths and types of events' properties, where a key holds numbers, texts and nulls."""
    value = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(
        F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("k"), F.struct(F.array("event_id").alias("t")).alias("in")))
    ).otherwise(F.lit('{"k": null}'))
    return logs.structure(table(spark, sf, "events").select(value.alias("value")))


@query("SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) FILTER (o_totalprice > 100000) AS price FROM orders GROUP BY 1")
def upsert_last_write(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return logs.latest(o)


# ------------------------------------------------------------------ similarity

_NAMES = "n AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name AS a FROM part)"
_PAIRS = f"WITH {_NAMES}, x AS (SELECT a.i, b.i AS p, a.a, b.a AS b FROM n a JOIN n b ON b.i > a.i AND b.i <= a.i + 4)"


def _names(spark, sf):
    from grainline.runtime import numbered

    return numbered(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_partkey"], "pos")


@query(f"{_PAIRS} SELECT i, p, CAST(levenshtein(a, b) AS DOUBLE) AS d FROM x")
def win_levenshtein(spark, sf):
    return similarity.window_distances(_names(spark, sf), 4, "p_name", "edit")


@query(
    f"""{_PAIRS}, c AS (SELECT i, c, count(*) AS k FROM (SELECT i, unnest(string_split(a, '')) AS c FROM n) GROUP BY ALL),
    u AS (SELECT i, p, c, k FROM x JOIN c USING (i) UNION ALL SELECT x.i, x.p, c, -k FROM x JOIN c ON c.i = x.p)
    SELECT i, p, CAST(sum(abs(k)) AS DOUBLE) AS d FROM (SELECT i, p, c, sum(k) AS k FROM u GROUP BY ALL) GROUP BY i, p"""
)
def win_wordbag_l1(spark, sf):
    return similarity.window_distances(_names(spark, sf), 4, "p_name", "word_bag")


@query(f"{_PAIRS} SELECT i, p, CAST(levenshtein(a, b) AS DOUBLE) AS d FROM x WHERE levenshtein(a, b) <= 4")
def win_threshold(spark, sf):
    return similarity.window_distances(_names(spark, sf), 4, "p_name", "edit", within=4.0)


@query(
    f"""WITH {_NAMES}, v AS (SELECT i, length(a) AS v FROM n)
    SELECT i, concat_ws(',', coalesce(lag(v, 2) OVER w, 0), coalesce(lag(v) OVER w, 0), v, coalesce(lead(v) OVER w, 0), coalesce(lead(v, 2) OVER w, 0)) AS view FROM v WINDOW w AS (ORDER BY i)"""
)
def win_padded(spark, sf):
    d = similarity.neighbour_view(_names(spark, sf).withColumn("v", F.length("p_name")), 2, "v")
    return d.select("i", F.concat_ws(",", F.transform("view", lambda x: x.cast("string"))).alias("view"))


@query(f"WITH {_NAMES} SELECT i AS pos, ascii(c) AS code, count(*) AS n FROM (SELECT i, unnest(string_split(a, '')) AS c FROM n) GROUP BY ALL")
def char_hist(spark, sf):
    return similarity.char_histogram(_names(spark, sf), "p_name")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id AS i, b.vec_id AS p, CAST(round((1 - list_cosine_similarity(a.v, b.v)) * 100000) AS BIGINT) AS d FROM e a JOIN e b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 4"""
)
def win_cosine(spark, sf):
    d = similarity.window_distances(table(spark, sf, "embeddings"), 4, "embedding", "cosine", pos="vec_id")
    return d.select("i", "p", F.round(F.col("d") * 100000).cast("bigint").alias("d"))


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    x AS (SELECT a.vec_id AS q, b.vec_id AS p, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT q, p, CAST(row_number() OVER (PARTITION BY q ORDER BY d, p) AS INT) AS rank FROM x QUALIFY rank <= 5"""
)
def knn_exact(spark, sf):
    e = table(spark, sf, "embeddings")
    return similarity.nearest(e, e.where("vec_id % 20 = 0"), 5).select("q", "p", "rank")


# ------------------------------------------------------------------ edit scripts and trees


@query(f"WITH {_NAMES} SELECT a.i, CAST(levenshtein(a.a, b.a) AS BIGINT) AS cost, b.a AS text FROM n a JOIN n b ON b.i = a.i + 1")
def edit_scripts(spark, sf):
    import pandas as pd

    pairs = similarity.neighbours(_names(spark, sf), 1, "p_name")

    def run(batches):
        for rows in batches:
            found = [editscript.decode(editscript.encode(editscript.script(a, b))) for a, b in zip(rows["a"], rows["b"], strict=True)]
            yield pd.DataFrame({"i": rows["i"], "cost": [editscript.cost(e) for e in found], "text": [editscript.apply(a, e) for a, e in zip(rows["a"], found, strict=True)]})

    return pairs.mapInPandas(run, "i bigint, cost bigint, text string")


_LINES = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name || ',' || p_brand || ',' || p_type AS line FROM part"


def _lines(spark, sf):
    return _names(spark, sf).select("pos", F.concat_ws(",", "p_name", "p_brand", "p_type").alias("line"))


def _tree(name, make):
    QUERIES[name], SQL[name] = (lambda spark, sf: trees.decoded(make(_lines(spark, sf)))), _LINES


_tree("attr_tree_roundtrip", lambda d: trees.attribute_tree(d, "word_bag", 4))
_tree("attr_tree_edit_roundtrip", lambda d: trees.attribute_tree(d, "edit_distance", 2, chunk_rows=512))
_tree("attr_tree_vector_roundtrip", lambda d: trees.attribute_tree(d, "vector", 4))
_tree("threshold_tree_roundtrip", lambda d: trees.attribute_tree(d, "word_bag", 4, limit=8, rounds=1))
_tree("nearest_tree_roundtrip", lambda d: trees.neighbour_tree(d))
_tree("bucketed_tree_roundtrip", lambda d: trees.neighbour_tree(d, exact=False))


@query("SELECT doc_id AS pos, coalesce(text, '') AS line FROM documents")
def text_tree_roundtrip(spark, sf):
    """The whole text of every document through the text tree."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("line"))
    return trees.decoded(trees.attribute_tree(d, "word_bag", 4, chunk_rows=256))


_ROOTS = f"l AS (SELECT pos, octet_length(encode(line)) AS b FROM ({_LINES})), r AS (SELECT pos, b + CASE WHEN b < 251 THEN 3 ELSE 7 END AS size FROM l)"


@query(f"WITH {_ROOTS} SELECT pos AS child, CAST(0 AS BIGINT) AS up, size, CAST(sum(size) OVER (ORDER BY pos) - size AS BIGINT) AS start FROM r")
def payload_offsets(spark, sf):
    """Where each encoded line starts, of a tree of roots alone: an insertion takes its op, place, length and text."""
    return trees.payload_offsets(materialized(trees.attribute_tree(_lines(spark, sf), "word_bag", 4, limit=-1), "tree"))


@query(f"WITH {_ROOTS} SELECT (SELECT count(*) FROM l) AS lines, CAST((SELECT sum(size) FROM r) AS BIGINT) AS edit_bytes, CAST((SELECT sum(b) FROM l) AS BIGINT) AS text_bytes")
def size_account(spark, sf):
    return trees.size_account(trees.attribute_tree(_lines(spark, sf), "word_bag", 4, limit=-1), _lines(spark, sf))


@query("SELECT count(*) AS rows, count(*) AS children, CAST(0 AS BIGINT) AS far FROM part")
def attr_tree_invariants(spark, sf):
    t = trees.attribute_tree(_lines(spark, sf), "word_bag", 4)
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("child").alias("children"), F.coalesce(F.sum(F.when(F.abs(F.col("child") - F.col("parent")) > trees.REACH, 1)), F.lit(0)).alias("far"))


@query(_LINES)
def attr_tree_lookup(spark, sf):
    """Every line looked up by its place."""
    t = materialized(trees.attribute_tree(_lines(spark, sf), "word_bag", 4), "tree")
    return trees.lookup(t, _lines(spark, sf).select("pos"))


@query("SELECT p_partkey AS id, CAST(sum(length(p_name)) OVER (ORDER BY p_partkey) - length(p_name) AS BIGINT) AS before FROM part")
def running_offsets(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.length("p_name").alias("n"))
    return running(d, ["id"], "n", "before").select("id", "before")


# ------------------------------------------------------------------ templates and dictionaries

_LABELLED = "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
_T = "concat_ws(',', CASE WHEN lang IS NOT NULL THEN 'lang' END, CASE WHEN quality IS NOT NULL THEN 'quality' END, CASE WHEN toxic IS NOT NULL THEN 'toxic' END)"
COLUMNS = ["lang", "quality", "toxic"]


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@query(f"SELECT template, n, row_number() OVER (ORDER BY template) - 1 AS template_id FROM (SELECT {_T} AS template, count(*) AS n FROM ({_LABELLED}) GROUP BY 1)")
def key_templates(spark, sf):
    return templates.key_templates(_labelled(spark, sf), COLUMNS)


_DICT = "SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS code FROM (SELECT DISTINCT 'role' AS col, role AS value FROM conversations UNION SELECT DISTINCT 'text', text FROM conversations)"


@query(_DICT)
def value_dictionary(spark, sf):
    return templates.value_dictionary(table(spark, sf, "conversations"), ["role", "text"])


@query("SELECT 'l_quantity' AS col, min(l_quantity) AS least FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice) FROM lineitem")
def column_minima(spark, sf):
    return templates.column_minima(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(f"SELECT doc_id, lang, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM ({_LABELLED})")
def template_roundtrip(spark, sf):
    d = _labelled(spark, sf)
    words = materialized(templates.value_dictionary(d, COLUMNS), "dictionary")
    coded = templates.coded(d, "doc_id", COLUMNS, words)
    stream = coded.select("doc_id", "template", templates.tokens(F.col("codes")).alias("s"))
    back = stream.select("doc_id", "template", templates.fields(F.col("s")).alias("codes"))
    return templates.decoded(back, "doc_id", COLUMNS, words)


@query("SELECT 'd' AS kind, doc_id AS id, 0 AS step, lang AS value FROM documents")
def record_correction_roundtrip(spark, sf):
    d = _labelled(spark, sf)
    words = materialized(templates.value_dictionary(d, ["lang"]), "dictionary")
    true = materialized(templates.steps(templates.coded(d, "doc_id", ["lang"], words), "d", "doc_id", "codes"), "steps")
    guess = true.select("kind", "id", "step").join(templates.previous_step(true), ["kind", "step"], "left")
    table_ = templates.correction_table(true, guess)
    back = templates.corrected(guess, table_)
    return back.join(words.select("value", F.col("code").alias("token")), "token").select("kind", "id", "step", "value")


@query("SELECT o_orderkey, split_part(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', 1) AS whole FROM orders")
def number_parts(spark, sf):
    whole, _ = templates.split_number(F.col("p"))
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p")).select("o_orderkey", whole.alias("whole"))


@query("SELECT 'whole' AS part, CAST(min(split_part(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', 1)) AS BIGINT) AS least FROM orders UNION ALL SELECT 'fraction', CAST(min(split_part(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', 2)) AS BIGINT) FROM orders")
def number_part_minima(spark, sf):
    return templates.part_minima(table(spark, sf, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("p")), "p")


@query(f"SELECT template, array_to_string(list_transform(string_split(template, ','), lambda k: CASE WHEN k = 'quality' THEN 'grade' ELSE k END), ',') AS renamed FROM (SELECT DISTINCT {_T} AS template FROM ({_LABELLED}))")
def template_rename(spark, sf):
    return templates.key_templates(_labelled(spark, sf), COLUMNS).select("template", templates.renamed_key(F.col("template"), "quality", "grade").alias("renamed"))


# ------------------------------------------------------------------ records as character tokens

_WORDS = "w AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'verteid:' ELSE 'eventid:' END || event_id AS head, event_id, event_type AS f FROM events)"
_CODES = f"{_WORDS}, c AS (SELECT ch, row_number() OVER (ORDER BY ch) + 1 AS code FROM (SELECT DISTINCT unnest(string_split(head || f, '')) AS ch FROM w))"
_STREAM = f"{_CODES}, x AS (SELECT event_id, unnest(range(length(head) + length(f) + 3)) AS k, head || chr(0) || f || chr(0) || chr(1) AS t, length(head) AS h FROM w), s AS (SELECT event_id, k, h, CASE substr(t, k + 1, 1) WHEN chr(0) THEN 0 WHEN chr(1) THEN 1 ELSE code END AS sym FROM x LEFT JOIN c ON ch = substr(t, k + 1, 1))"


def _event_records(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, "v").otherwise("e").alias("kind"), F.col("event_id").cast("string").alias("id"), F.array("event_type").alias("fields"))
    codes = records.code_map(records.characters(e.select(F.concat(records.prefix(F.col("kind"), F.col("id")), F.col("fields")[0]).alias("t")), "t"))
    return records.record_tokens(e, "fields", codes)


@query(f"WITH {_STREAM} SELECT CAST(event_id AS VARCHAR) AS id, string_agg(CAST(sym AS VARCHAR), ',' ORDER BY k) AS tokens FROM s GROUP BY event_id")
def record_tokens(spark, sf):
    """Events as token streams: the id field with its kind's prefix, then a field, in codes of characters."""
    return _event_records(spark, sf).select("id", F.concat_ws(",", F.transform("tokens", lambda t: t.cast("string"))).alias("tokens"))


@query(f"""WITH {_STREAM}, l AS (SELECT event_id, k - h - 1 AS step, sym AS y, coalesce(lag(sym, 10) OVER o, 0) AS c1, coalesce(lag(sym, 5) OVER o, 0) AS c6, lag(sym) OVER o AS c10 FROM s WINDOW o AS (PARTITION BY event_id ORDER BY k))
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(step AS INT) AS step, CAST(c1 AS INT) AS c1, CAST(c6 AS INT) AS c6, CAST(c10 AS INT) AS c10, CAST(y AS INT) AS y FROM l WHERE step >= 0""")
def record_windows(spark, sf):
    return records.record_windows(_event_records(spark, sf)).select("id", "step", "c1", "c6", "c10", "y")


@query(f"SELECT doc_id, lang, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM ({_LABELLED})")
def record_fetch(spark, sf):
    """Every document's labels, regenerated token by token from an archive of templates, dictionaries, model and corrections."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    d = _labelled(spark, sf).select(F.lit("v").alias("kind"), F.col("doc_id").alias("id"), *COLUMNS)
    records.store(d, COLUMNS, path)
    return records.fetch(spark, path, d.select("kind", "id")).select(F.col("id").cast("bigint").alias("doc_id"), *COLUMNS)


# ------------------------------------------------------------------ tables and archives


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def archive_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    tables.archive({"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")}, path)
    return tables.unarchive(spark, path)["nation"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS hash, s_name FROM supplier")
def csv_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("hash"), "s_name").write.option("header", True).csv(path)
    d = tables.csv(spark, path, "hash string, s_name string")
    key, properties = tables.split_vertices(d.unionByName(d).withColumn("own", F.col("hash")), "toy", "s_name")
    return key.join(properties.select(F.col("own").alias("hash"), "s_name"), "hash")


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), '') AS priority, '' AS note FROM orders")
def defaults_filled(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return tables.with_columns(d, {"priority": "", "note": ""})


@query("SELECT n_nationkey AS id, CAST(to_json(struct_pack(id := n_nationkey, name := n_name)) AS VARCHAR) AS json FROM nation")
def json_rows(spark, sf):
    from grainline.operators.graph import as_json

    d = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("gone"))
    return as_json(d, ["id", "name", "gone"]).select("id", "json")
