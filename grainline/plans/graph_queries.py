"""Queries of ids, adjacency, traversal and the topology codecs over the test graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.functions import codecs
from grainline.operators import graph, ids, predictors, segments
from grainline.runtime import dropped, materialized, slices_of

from .base import E_SQL, IDS_SQL, dense, dense_once, edges, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {E_SQL} SELECT eid, src, dst FROM E")
def edges_build(spark, sf):
    return edges(spark, sf).select("eid", "src", "dst")


@query(f"WITH {IDS_SQL} SELECT key, vid FROM ids")
def dense_ids(spark, sf):
    return dense(spark, sf)[0]


@query(
    """WITH u AS (SELECT 0 AS rank, s_suppkey AS pos, 'S' || s_suppkey AS key FROM supplier
       UNION ALL SELECT 1, l_partkey, 'P' || l_partkey FROM lineitem)
       SELECT key, row_number() OVER (ORDER BY f) AS gid FROM (SELECT key, min((rank, pos)) AS f FROM u GROUP BY key)"""
)
def global_ids_union(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("S"), "s_suppkey").alias("key"))
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos"), F.concat(F.lit("P"), "l_partkey").alias("key"))
    return ids.global_ids([s, p])


@query("SELECT DISTINCT o_custkey AS id, 'Unknown' AS type FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unknown_endpoints(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return ids.unknown_endpoints(e, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def dedup_keep_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return ids.keep_first(d, ["text"], ["doc_id"]).select("doc_id", "lang")


@query(f"WITH {IDS_SQL} SELECT src AS key, row_number() OVER (PARTITION BY src ORDER BY dst, eid) - 1 AS k, dst AS other, eid FROM DE")
def adjacency_fwd(spark, sf):
    return graph.adjacency(dense(spark, sf)[1]).select(F.col("src").alias("key"), F.posexplode("out").alias("k", "o")).select("key", F.col("k").cast("bigint").alias("k"), F.col("o.dst").alias("other"), "o.eid")


@query(f"WITH {IDS_SQL} SELECT dst AS key, row_number() OVER (PARTITION BY dst ORDER BY src, eid) - 1 AS k, src AS other, eid FROM DE")
def adjacency_rev(spark, sf):
    a = graph.adjacency(graph.reversed_edges(dense(spark, sf)[1]))
    return a.select(F.col("src").alias("key"), F.posexplode("out").alias("k", "o")).select("key", F.col("k").cast("bigint").alias("k"), F.col("o.dst").alias("other"), "o.eid")


@query(f"WITH {E_SQL} SELECT src, dst, count(*) AS n, min(eid) AS first_eid FROM E GROUP BY src, dst HAVING count(*) > 1")
def parallel_edges(spark, sf):
    return edges(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("first_eid")).where("n > 1")


@query(f"WITH {E_SQL} SELECT src, count(*) AS n, count(DISTINCT dst) AS n_distinct FROM E GROUP BY src")
def out_degree(spark, sf):
    return edges(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("n_distinct"))


def _trace_sql(start: str, edge: str, budget: int) -> str:
    """The walk over a graph two levels deep: rows by level and path, cut where edges and new nodes reach the budget."""
    return f"""WITH {E_SQL},
    G AS ({edge}),
    l1 AS (SELECT 1 AS hop, row_number() OVER (ORDER BY dst, eid) AS a, CAST(0 AS BIGINT) AS b, src, dst, eid FROM G WHERE src = ({start})),
    l2 AS (SELECT 2 AS hop, l1.a, row_number() OVER (PARTITION BY l1.a ORDER BY G.dst, G.eid) AS b, G.src, G.dst, G.eid FROM l1 JOIN G ON G.src = l1.dst),
    w AS (SELECT row_number() OVER (ORDER BY hop, a, b) - 1 AS seq, * FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2)),
    n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dst ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM w),
    t AS (SELECT *, seq + 1 + sum(fresh) OVER (ORDER BY seq) AS total FROM n)
    SELECT seq, CAST(hop AS INT) AS hop, src, dst, eid FROM t WHERE total - 1 - fresh < {budget} AND seq <= coalesce((SELECT min(seq) FROM t WHERE total >= {budget}), 1000000000)"""


FORWARD, BACKWARD = "SELECT src, dst, eid FROM E", "SELECT dst AS src, src AS dst, eid FROM E"
FIRST_CUSTOMER, FIRST_PART = "SELECT 'C' || min(o_custkey) FROM orders", "SELECT 'P' || min(l_partkey) FROM lineitem"


def _customer(spark, sf):
    return "C" + str(table(spark, sf, "orders").agg(F.min("o_custkey")).first()[0])


def _part(spark, sf):
    return "P" + str(table(spark, sf, "lineitem").agg(F.min("l_partkey")).first()[0])


@query(_trace_sql(FIRST_CUSTOMER, FORWARD, 20))
def bfs_budget_fwd(spark, sf):
    return graph.trace(edges(spark, sf), [_customer(spark, sf)], 20)


@query(_trace_sql(FIRST_PART, BACKWARD, 20))
def bfs_budget_bwd(spark, sf):
    return graph.trace(graph.reversed_edges(edges(spark, sf)), [_part(spark, sf)], 20)


@query(_trace_sql(FIRST_CUSTOMER, FORWARD, 4096))
def bfs_budget_wide(spark, sf):
    return graph.trace(edges(spark, sf), [_customer(spark, sf)], 4096)


_HITS = _trace_sql(FIRST_CUSTOMER, FORWARD, 20)


@query(
    f"""WITH hits AS ({_HITS}), ends AS (SELECT dst AS id, min(seq) AS seq FROM hits GROUP BY dst)
    SELECT 'edge' AS kind, eid AS eid, src || '>' || dst AS id, seq, CAST(NULL AS VARCHAR) AS label FROM hits
    UNION ALL SELECT 'node', NULL, id, seq, coalesce(o_orderpriority, p_name) FROM ends LEFT JOIN orders ON id = 'O' || o_orderkey LEFT JOIN part ON id = 'P' || p_partkey"""
)
def bfs_attributes(spark, sf):
    hits = graph.trace(edges(spark, sf), [_customer(spark, sf)], 20)
    o = table(spark, sf, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    nodes = graph.node_hits(hits, o.unionByName(p)).select(F.lit("node").alias("kind"), F.lit(None).cast("bigint").alias("eid"), "id", "seq", "label")
    e = hits.select(F.lit("edge").alias("kind"), "eid", F.concat("src", F.lit(">"), "dst").alias("id"), "seq", F.lit(None).cast("string").alias("label"))
    return e.unionByName(nodes)


@query(
    f"""WITH {E_SQL}, s AS ({FIRST_CUSTOMER} AS k), l0 AS (SELECT k AS node FROM s), l1 AS (SELECT DISTINCT dst AS node FROM E JOIN l0 ON src = node),
    l2 AS (SELECT DISTINCT dst AS node FROM E JOIN l1 ON src = node)
    SELECT node, CAST(min(hop) AS INT) AS hop FROM (SELECT node, 0 AS hop FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2) GROUP BY node""".replace("AS k)", ")").replace("SELECT 'C' || min(o_custkey) FROM orders ", "SELECT 'C' || min(o_custkey) AS k FROM orders")
)
def reach_levels(spark, sf):
    return graph.reach_levels(edges(spark, sf), spark.createDataFrame([(_customer(spark, sf),)], "node string"), 3)


@query("SELECT seq, src, dst, eid FROM (" + _trace_sql(FIRST_CUSTOMER, FORWARD, 20) + ")")
def distinct_walk(spark, sf):
    return graph.trace_distinct(edges(spark, sf), _customer(spark, sf), 20)


@query(
    f"""WITH {E_SQL}, o AS (SELECT eid, src, dst FROM E WHERE src = ({FIRST_CUSTOMER})),
    r AS (SELECT eid AS a, 0 AS line, CAST(0 AS DOUBLE) AS w, src, dst, eid FROM o UNION ALL SELECT o.eid, 1, E.w, E.src, E.dst, E.eid FROM o JOIN E ON E.src = o.dst),
    w AS (SELECT row_number() OVER (ORDER BY a DESC, line, w DESC, eid DESC) - 1 AS seq, * FROM r),
    n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dst ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM w),
    t AS (SELECT *, seq + 1 + sum(fresh) OVER (ORDER BY seq) AS total FROM n)
    SELECT seq, src, dst, eid FROM t WHERE seq <= coalesce((SELECT min(seq) FROM t WHERE total >= 20), 1000000000)"""
)
def best_first(spark, sf):
    return graph.best_first(edges(spark, sf).withColumnRenamed("w", "weight"), _customer(spark, sf), 20)


_DELTA = f"WITH {IDS_SQL}, d AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst, eid) - 1 AS k, dst - coalesce(lag(dst) OVER (PARTITION BY src ORDER BY dst, eid), 0) AS delta, eid FROM DE)"


@query(f"{_DELTA} SELECT src, k, delta FROM d")
def topo_delta(spark, sf):
    a = graph.adjacency(dense(spark, sf)[1])
    return a.select("src", F.posexplode(codecs.deltas(F.col("out.dst"))).alias("k", "delta")).select("src", F.col("k").cast("bigint").alias("k"), "delta")


_RUNS = f"""{_DELTA}, c AS (SELECT *, CASE WHEN delta = lag(delta) OVER (PARTITION BY src ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM d),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY k) AS island FROM c), r AS (SELECT src, CAST(island - 1 AS BIGINT) AS k, count(*) AS n, min(delta) AS value FROM i GROUP BY src, island)"""


@query(f"{_RUNS} SELECT src, k, n, value FROM r")
def topo_rle(spark, sf):
    a = graph.adjacency(dense(spark, sf)[1]).select("src", codecs.deltas(F.col("out.dst")).alias("d"))
    return a.select("src", F.posexplode(codecs.runs(F.col("d"))).alias("k", "r")).select("src", F.col("k").cast("bigint").alias("k"), "r.n", "r.value")


@query(
    f"""{_RUNS}, v AS (SELECT n AS x FROM r UNION ALL SELECT value FROM r UNION ALL SELECT 1 FROM d UNION ALL SELECT eid FROM d UNION ALL SELECT DISTINCT src FROM d),
    digits AS (SELECT CAST(unnest(string_split(CAST(x AS VARCHAR), '')) AS INT) AS sym FROM v),
    parents AS (SELECT count(DISTINCT src) AS p FROM d)
    SELECT sym, count(*) AS n FROM digits GROUP BY sym
    UNION ALL SELECT 10, (SELECT count(*) FROM v) - (SELECT p FROM parents) UNION ALL SELECT 11, p - 1 FROM parents UNION ALL SELECT 12, 1"""
)
def topo_symbol_hist(spark, sf):
    s = predictors.stream(codecs.adjacency_symbols(graph.adjacency(dense(spark, sf)[1])))
    return s.groupBy(F.col("sym").cast("int").alias("sym")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {IDS_SQL} SELECT src, dst, eid FROM DE")
def topo_roundtrip(spark, sf):
    return codecs.symbols_adjacency(codecs.adjacency_symbols(graph.adjacency(dense(spark, sf)[1])))


def _learned(name, **options):
    def run(spark, sf):
        d, spent = dense_once(spark, sf)
        s = segments.stream(d, slices=slices_of(d), spent=spent)
        model = segments.fit(s, name, **options)
        found = segments.edges(segments.corrections(s, model), model)
        dropped(s)
        return found

    return run


for _name in predictors.MODELS:
    QUERIES[f"learned_roundtrip_{_name}"], SQL[f"learned_roundtrip_{_name}"] = _learned(_name), SQL["topo_roundtrip"]


def _symbols(spark, sf):
    return predictors.stream(codecs.adjacency_symbols(graph.adjacency(dense(spark, sf)[1])))


@query()
def model_accuracy_order_k(spark, sf):
    s = materialized(_symbols(spark, sf), "symbols")
    return predictors.accuracy(s, predictors.corrections(s, predictors.fit(predictors.windows(s), "order_k")))


#: A symbol sequence that SQL can build: digits of events' users in event order.
_SEQ = """s0 AS (SELECT event_id, string_split(CAST(user_id AS VARCHAR), '') AS a FROM events),
    s1 AS (SELECT event_id, unnest(range(len(a))) AS k, unnest(a) AS c FROM s0),
    s AS (SELECT row_number() OVER (ORDER BY event_id, k) - 1 AS pos, CAST(c AS TINYINT) AS sym FROM s1),
    q AS (SELECT pos // 1024 AS seg, pos, sym FROM s)"""
_LAGS = ", ".join(f"lag(sym, {11 - i}) OVER w AS c{i}" for i in range(1, 11))


def _sequence(spark, sf):
    from grainline.runtime import numbered

    d = table(spark, sf, "events").select("event_id", F.posexplode(codecs.digits(F.col("user_id"))).alias("k", "sym"))
    return numbered(d, ["event_id", "k"], "pos").select(F.expr("pos DIV 1024").alias("seg"), "pos", "sym")


@query(f"WITH {_SEQ}, w AS (SELECT seg, pos, {_LAGS}, sym AS y FROM q WINDOW w AS (PARTITION BY seg ORDER BY pos)) SELECT * FROM w WHERE c1 IS NOT NULL")
def seq_windows(spark, sf):
    return predictors.windows(_sequence(spark, sf))


_TABLE = f"""WITH {_SEQ}, w AS (SELECT seg, pos, {_LAGS}, sym AS y FROM q WINDOW w AS (PARTITION BY seg ORDER BY pos)),
    t AS (SELECT c9 || ',' || c10 AS context, y AS sym, count(*) AS n FROM w WHERE c1 IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT context, sym, n FROM t QUALIFY row_number() OVER (PARTITION BY context ORDER BY n DESC, sym) = 1)"""


@query(f"{_TABLE} SELECT context, sym, n FROM b")
def order_k_table(spark, sf):
    return predictors.order_k_table(predictors.windows(_sequence(spark, sf)), 2)


_WRONG = f"""{_TABLE}, x AS (SELECT q.seg, q.pos, q.sym FROM q LEFT JOIN w USING (pos) LEFT JOIN b ON c9 || ',' || c10 = b.context WHERE c1 IS NULL OR b.sym <> q.sym)"""


@query(f"{_WRONG} SELECT seg, pos, sym, pos - coalesce(lag(pos) OVER (PARTITION BY seg ORDER BY pos), seg * 1024 - 1) AS gap FROM x")
def corr_gaps(spark, sf):
    s = materialized(_sequence(spark, sf), "sequence")
    return predictors.gaps(predictors.corrections(s, predictors.fit(predictors.windows(s), "order_k", k=2)))


@query(f"{_WRONG} SELECT (SELECT count(*) FROM q) AS n, count(*) AS wrong, count(*) / (SELECT count(*) FROM q) AS ratio FROM x")
def wrong_ratio(spark, sf):
    s = materialized(_sequence(spark, sf), "sequence")
    return predictors.accuracy(s, predictors.corrections(s, predictors.fit(predictors.windows(s), "order_k", k=2)))


@query(f"WITH {_SEQ}, w AS (SELECT pos, list(sym) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM s) SELECT pos, array_to_string(a, '') AS w FROM w WHERE len(a) = 5 AND pos % 3 = 0")
def strided_windows(spark, sf):
    d = predictors.sliding(_sequence(spark, sf), 5, 3)
    return d.select("pos", F.array_join(F.transform("w", lambda x: x.cast("string")), "").alias("w"))


_EV = "ev AS (SELECT event_id AS eid, user_id AS dst, event_type AS op, epoch_us(ts) AS ts, CAST(round(value) AS BIGINT) AS src FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("eid"), F.round("value").cast("bigint").alias("src"), F.col("user_id").alias("dst"), F.col("event_type").alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


_M = 1_000_003


@query(
    f"""WITH {_EV}, o AS (SELECT *, row_number() OVER w - 1 AS k, ts - lag(ts) OVER w AS delta FROM ev WINDOW w AS (PARTITION BY dst, op ORDER BY eid))
    SELECT dst, op, k, src, eid, delta, CASE WHEN k = 0 THEN (ts - 1) // {_M} END AS q0, CASE WHEN k = 0 THEN (ts - 1) % {_M} END AS r0 FROM o"""
)
def packed_groups(spark, sf):
    g = codecs.packed_groups(_events(spark, sf), _M)
    d = g.select("dst", "op", "q0", "r0", F.posexplode(F.arrays_zip("src", F.col("eids").alias("eid"), F.concat(F.array(F.lit(None).cast("bigint")), "deltas").alias("delta"))).alias("k", "e"))
    first = lambda c: F.when(F.col("k") == 0, F.col(c)).alias(c)
    return d.select("dst", "op", F.col("k").cast("bigint").alias("k"), "e.src", "e.eid", "e.delta", first("q0"), first("r0"))


@query(f"WITH {_EV} SELECT eid, src, dst, op, ts FROM ev")
def packed_roundtrip(spark, sf):
    return codecs.unpacked_groups(codecs.packed_groups(_events(spark, sf)))


@query("SELECT count(*) / count(DISTINCT (user_id, event_type)) AS mean_size FROM events")
def packed_mean_group(spark, sf):
    return codecs.packed_groups(_events(spark, sf)).agg(F.avg(F.size("src")).alias("mean_size"))


@query("SELECT event_id, (event_id) // 7 AS q, (event_id) % 7 AS r FROM events")
def golomb_split(spark, sf):
    d = table(spark, sf, "events").select("event_id", (F.col("event_id") + 1).alias("n"))
    q, r = codecs.golomb("n", 7)
    return d.select("event_id", q.alias("q"), r.alias("r"))


@query("SELECT event_id, bin(event_id % 1000003) AS digits, event_id % 1000003 AS n FROM events")
def binary_digits(spark, sf):
    d = table(spark, sf, "events").select("event_id", codecs.to_binary(F.col("event_id") % 1000003).alias("digits"))
    return d.withColumn("n", codecs.from_binary(F.col("digits")))


_GLOBAL = """v AS (SELECT 0 AS rank, c_custkey AS pos, 'U' || c_custkey AS key FROM customer UNION ALL SELECT 1, event_id, 'U' || user_id FROM events UNION ALL SELECT 2, event_id, event_type FROM events),
    g AS (SELECT key, row_number() OVER (ORDER BY f) AS gid FROM (SELECT key, min((rank, pos)) AS f FROM v GROUP BY key))"""


def _renumbered(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("U"), "c_custkey").alias("id"), "c_name")
    e = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("U"), "user_id").alias("subject_id"), F.col("event_type").alias("predicate_id"), F.col("event_type").alias("type"), "value")
    return ids.renumbered(v, e, ["subject_id", "predicate_id", "type"], ["value"])


@query(f"WITH {_GLOBAL} SELECT row_number() OVER (ORDER BY event_id) AS id, s.gid AS subject_id, p.gid AS predicate_id, event_type AS type FROM events JOIN g s ON s.key = 'U' || user_id JOIN g p ON p.key = event_type")
def renumbered_edges(spark, sf):
    return _renumbered(spark, sf)["edges"]


@query("SELECT row_number() OVER (ORDER BY event_id) AS id, value FROM events")
def renumbered_other(spark, sf):
    return _renumbered(spark, sf)["edges_other"]


@query(f"WITH {_GLOBAL} SELECT gid AS id, c_name FROM customer JOIN g ON key = 'U' || c_custkey")
def renumbered_vertices(spark, sf):
    return _renumbered(spark, sf)["vertices"]


@query("SELECT event_id, user_id AS n FROM events")
def digits_roundtrip(spark, sf):
    return table(spark, sf, "events").select("event_id", codecs.from_digits(codecs.digits(F.col("user_id"))).alias("n"))
