"""Traversal against a plain queue, and topology codecs on small and awkward graphs."""

import random

import pytest
from pyspark.sql import functions as F

from grainline.functions import codecs
from grainline.operators import graph, ids, predictors


def plain_trace(rows, starts, budget):
    near = {}
    for e, s, d in rows:
        near.setdefault(s, []).append((d, e))
    for v in near.values():
        v.sort()
    queue, nodes, out = list(starts), set(), []
    while queue:
        x = queue.pop(0)
        for d, e in near.get(x, []):
            queue.append(d)
            nodes.add(d)
            out.append((x, d, e))
            if len(out) + len(nodes) >= budget:
                return out
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trace_on_cyclic_multigraphs(spark, seed):
    r = random.Random(seed)
    rows = [(e, r.randrange(8), r.randrange(8)) for e in range(r.randrange(1, 20))]
    df = spark.createDataFrame(rows, "eid long, src long, dst long")
    got = [(x.src, x.dst, x.eid) for x in graph.trace(df, [0, 3], 20).orderBy("seq").collect()]
    assert got == plain_trace(rows, [0, 3], 20)


def test_walks_end_on_cycles_and_without_edges(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 2, 1)], "eid long, src long, dst long")
    assert graph.trace_distinct(df, 1, 100).count() == 2
    assert graph.trace(df, [9], 100).count() == 0
    assert graph.trace(df, [1], 7).count() == 5  # goes round: 5 edges and 2 nodes
    assert {(r.node, r.hop) for r in graph.reach_levels(df, spark.createDataFrame([(1,)], "node long"), 9).collect()} == {(1, 0), (2, 1)}


def test_best_first_takes_the_heaviest(spark):
    df = spark.createDataFrame([(0, 1, 2, 5.0), (1, 1, 3, 9.0), (2, 3, 4, 1.0), (3, 2, 5, 7.0)], "eid long, src long, dst long, weight double")
    assert [r.eid for r in graph.best_first(df, 1, 100).orderBy("seq").collect()] == [1, 0, 3, 2]


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_topology_round_trip(spark, n):
    r = random.Random(n)
    rows = [(e, r.randrange(0, 300), r.randrange(0, 300)) for e in range(n)] + [(n + k, 7, 7) for k in range(3)] * (n > 0)
    df = spark.createDataFrame(rows, "eid long, src long, dst long")
    symbols = predictors.stream(codecs.adjacency_symbols(graph.adjacency(df)))
    back = codecs.symbols_adjacency(predictors.records_of(symbols))
    assert sorted((x.eid, x.src, x.dst) for x in back.collect()) == sorted(rows)


def test_symbols_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 2), (3, 1, 2)], "eid long, src long, dst long")
    got = [r.sym for r in predictors.stream(codecs.adjacency_symbols(graph.adjacency(df))).orderBy("pos").collect()]
    want = "0 10 2 10 1 10 1 10 0 10 1 10 0 10 1 10 1 10 1 10 2 11 1 10 1 10 2 10 1 10 3 12"
    assert got == [int(x) for x in want.split()]


@pytest.mark.parametrize("name", sorted(predictors.MODELS))
@pytest.mark.parametrize("length", [1, 9, 10, 11, 1024, 1029, 2100])
def test_corrections_restore_any_length(spark, name, length):
    r = random.Random(length)
    rows = [(p // 1024, p, 12 if p == length - 1 else r.choice([0, 1, 10])) for p in range(length)]
    s = spark.createDataFrame(rows, "seg long, pos long, sym byte")
    predict = predictors.fit(predictors.windows(s), name)
    predict = predictors.model_of(predictors.model_table(spark, predict))
    table, lengths = predictors.corrections(s, predict), s.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    assert sorted((x.seg, x.pos, x.sym) for x in predictors.restored(table, lengths, predict).collect()) == rows


@pytest.mark.parametrize("long", [False, True])
def test_records_are_cut_as_restored(spark, long):
    """Records of a few symbols, and of several segments."""
    r = random.Random(8)
    symbols = [11 if r.random() < (0.0003 if long else 0.1) else r.randrange(11) for _ in range(9000)] + [12]
    s = spark.createDataFrame([(p // 1024, p, x) for p, x in enumerate(symbols)], "seg long, pos long, sym byte")
    predict = predictors.fit(predictors.windows(s), "order_k")
    got = predictors.restored_records(predictors.corrections(s, predict), s.groupBy("seg").agg(F.count(F.lit(1)).alias("n")), predict)
    want = predictors.records_of(s)
    assert sorted(x.symbols for x in got.collect()) == sorted(x.symbols for x in want.collect())
    assert sum(len(x.symbols) for x in got.collect()) == 9001


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        predictors.fit(None, "none")


def test_packed_groups_keep_order_and_negative_steps(spark):
    rows = [(0, 5, 1, "r", 100), (1, 6, 1, "r", 40), (2, 5, None, "w", 7), (3, 5, 1, "r", 100)]
    df = spark.createDataFrame(rows, "eid long, src long, dst long, op string, ts long")
    for m in (3, codecs.DIVISOR):
        back = codecs.unpacked_groups(codecs.packed_groups(df, m), m).select("eid", "src", "dst", "op", "ts")
        assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows


def test_ids_skip_nulls_and_empty(spark):
    v = spark.createDataFrame([(0, "b"), (1, "b"), (2, None)], "pos long, key string")
    e = spark.createDataFrame([(0, "c", "b"), (1, "", "a")], "eid long, src string, dst string")
    assert {(r.key, r.vid) for r in ids.dense_ids(v, e).collect()} == {("b", 0), ("c", 1), ("a", 2)}
    assert ids.dense_ids(None, e.limit(0)).count() == 0
