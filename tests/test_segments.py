"""Streams a segment a row against the plain ones, and how much the round trips write."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline import catalog, runtime
from grainline.functions import codecs
from grainline.operators import graph, ids, predictors, segments
from grainline.plans import base


def _edges(spark, n=4000):
    r = np.random.default_rng(2)
    src, dst = r.integers(0, 300, n), r.integers(0, 50, n)
    src[: n // 4] = 7  # a hub with parallel edges
    return spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), range(n), strict=True)), "src long, dst long, eid long")


def _round_trip(spark, d, name):
    s = segments.stream(d)
    model = segments.fit(s, name)
    again = predictors.model_of(predictors.model_table(spark, model))
    got = segments.edges(segments.corrections(s, model), again)
    return sorted(map(tuple, got.select("src", "dst", "eid").collect()))


def test_stream_is_the_plain_stream(spark):
    d = _edges(spark).repartition(5)
    plain = predictors.stream(codecs.adjacency_symbols(graph.adjacency(d))).orderBy("pos").collect()
    got = segments.stream(d).orderBy("seg").collect()
    assert [r.seg for r in got] == list(range(len(got)))
    assert b"".join(bytes(r.data) for r in got) == bytes(r.sym for r in plain)


@pytest.mark.parametrize("rows", [[], [(0, 5, 3)], [(0, 0, 0), (9, 9, 1), (9, 9, 10**15)], [(4, k, k) for k in range(2000)]])
def test_small_and_one_source_streams_come_back(spark, rows):
    d = spark.createDataFrame(rows, "src long, dst long, eid long")
    assert _round_trip(spark, d, "order_k") == sorted(rows)


@pytest.mark.parametrize("name", sorted(segments.FITS))
def test_round_trip_writes_no_row_per_symbol(spark, sf, tmp_path, name, monkeypatch):
    """Every edge comes back, and no table in the shared folder has more rows than there are edges; it was a row per symbol, some 20 an edge."""
    want = sorted(map(tuple, base.dense(spark, sf)[1].select("src", "dst", "eid").collect()))
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    got = catalog.QUERIES[f"learned_roundtrip_{name}"](spark, sf)
    assert sorted(map(tuple, got.select("src", "dst", "eid").collect())) == want
    rows = {d: spark.read.parquet(f"{tmp_path}/{d}").count() for d in os.listdir(tmp_path) if not d.startswith("drawn")}  # of drawn windows there are about 200,000 at most
    assert max(rows.values()) <= len(want) + 1000, rows


def _walked(feature, most, levels, row):
    at = 0
    for _ in range(levels):
        at = 2 * at + 1 + int(feature[at] >= 0 and row[feature[at]] > most[at])
    return at


@pytest.mark.parametrize("context", [1, 4, 10])
@pytest.mark.parametrize("levels", [0, 1, 5, 6, 8])
def test_descent_is_a_walk_from_node_to_node(context, levels):
    r = np.random.default_rng(levels)
    feature, most = r.integers(-1, context, 511).astype(np.int32), r.integers(0, 13, 511).astype(np.int8)
    feature[r.random(511) < 0.2] = -1
    most[feature < 0] = 127
    x = np.ascontiguousarray(r.integers(0, 13, (context, 400)).astype(np.int8)).T
    assert segments._descent(feature, most, levels, context)(x).tolist() == [_walked(feature, most, levels, row) for row in x]


@pytest.mark.parametrize(("features", "share"), [(10, None), (4, 0.8)])
@pytest.mark.parametrize("level", [0, 4, 5])
def test_trees_count_all_windows_with_few_passes(features, share, level, monkeypatch):
    """Counts of every asked feature against windows one by one; two features a pass while there are few nodes, it was one."""
    r = np.random.default_rng(7)
    trees = segments._Trees(2, 6, features, 10, share)
    trees.feature[:] = r.integers(-1, 10, trees.feature.shape)
    trees.most[:] = np.where(trees.feature < 0, 127, r.integers(0, 12, trees.most.shape))
    segs, grid = np.arange(5), r.integers(0, 13, (40, 5)).astype(np.int8)
    grid[25:, 4] = -1
    want = np.zeros((2, features, 2**level, 13, 13), np.int64)
    for t in range(2):
        for s, w in enumerate(trees.weights(segs, t)):
            for k in range(10, 40 if s < 4 else 25):
                node = _walked(trees.feature[t], trees.most[t], level, grid[k - 10 : k, s]) - (2**level - 1)
                for f, c in enumerate(trees.asked[t, 2**level - 1 + node]):
                    want[t, f, node, grid[k - 10 + c, s], grid[k, s]] += w
    passes, plain = [0], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: passes.__setitem__(0, passes[0] + 1) or plain(*a, **b))
    assert (trees.count(level, 10)(segs, None, grid).reshape(want.shape) == want).all()
    assert passes[0] <= (5 if level < 5 else 10) * sum(len(np.unique(w[w > 0])) for w in (trees.weights(segs, t) for t in range(2)))


def test_forest_votes_go_to_the_smallest_of_the_most_frequent():
    r = np.random.default_rng(3)
    a = {"feature": r.integers(-1, 10, (6, 63)).astype(np.int32), "most": r.integers(0, 12, (6, 63)).astype(np.int8), "label": r.integers(0, 13, (6, 63)).astype(np.int8)}
    a["most"][a["feature"] < 0] = 127
    x = np.ascontiguousarray(r.integers(0, 13, (10, 300)).astype(np.int8)).T
    votes = [[label[_walked(f, m, 5, row)] for f, m, label in zip(*a.values(), strict=True)] for row in x]
    assert segments.compiled(predictors.Model("heaps", a))(x).tolist() == [np.bincount(v, minlength=13).argmax() for v in votes]


def _kinds(path):
    return sorted(d.rpartition("-")[0] for d in os.listdir(path))


@pytest.mark.parametrize("shift", [0, 1 << 60])
def test_dense_edges_by_whole_numbers_are_those_by_text(spark, sf, tmp_path, shift, monkeypatch):
    """Alike for any key, ends that customers lack, nulls and repeated lines; only the ids and the edges stay, it was every step's table."""
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path / "shared"))
    for t, keys in (("customer", ["c_custkey"]), ("orders", ["o_orderkey", "o_custkey"]), ("lineitem", ["l_orderkey", "l_partkey"])):
        d = spark.read.parquet(f"{sf}/{t}.parquet").limit(1500)
        d = d.unionByName(d.limit(20)) if t == "lineitem" else d.where(f"{keys[0]} % 5 <> 1").unionByName(d.limit(1).withColumn(keys[0], F.lit(-7).cast("bigint")))
        d = d.withColumn(keys[-1], F.when(F.col(keys[-1]) % 11 != 3, F.col(keys[-1]))) if t != "customer" else d
        d.withColumns({k: F.col(k) + shift for k in keys}).write.parquet(f"{tmp_path}/a/{t}.parquet")
    os.symlink(tmp_path / "a", tmp_path / "b")
    found = [sorted(map(tuple, x.collect())) for x in base.dense(spark, f"{tmp_path}/a")]
    assert _kinds(tmp_path / "shared") == (["dense", "dense-edges"] if not shift else ["dense", "dense-edges", "numbered"])  # edges() by text stay for other queries
    monkeypatch.setattr(base, "_numbered_keys", lambda *_: None)
    assert [sorted(map(tuple, x.collect())) for x in base.dense(spark, f"{tmp_path}/b")] == found
    assert len(found[1]) > 500


@pytest.mark.parametrize("name", ["neural_net", "support_vectors", "random_forest"])
def test_round_trip_drops_what_was_read(spark, sf, tmp_path, name, monkeypatch):
    """No table of segments or windows stays beside the restored edges."""
    base.dense(spark, sf)
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    catalog.QUERIES[f"learned_roundtrip_{name}"](spark, sf).collect()
    assert _kinds(tmp_path) == ["restored", "running"]


def test_large_tables_are_joined_and_sorted_in_slices(spark, sf, tmp_path, monkeypatch):
    """Same ids, edges and stream, while no query sorts or joins more than some 0.4 of the edges at once; it was all of them."""
    os.symlink(sf, tmp_path / "whole")
    os.symlink(sf, tmp_path / "slices")
    want = [sorted(map(tuple, x.collect())) for x in base.dense(spark, f"{tmp_path}/whole")]
    plain = {r.seg: bytes(r.data) for r in segments.stream(base.dense(spark, f"{tmp_path}/whole")[1]).collect()}
    monkeypatch.setattr(runtime, "SLICE", 1000)
    written, put = [], runtime.materialized_slices

    def noted(slices, name):
        slices = list(slices)
        written.append((name, [d.count() for d in slices]))
        return put(slices, name)

    for m in (ids, segments):
        monkeypatch.setattr(m, "materialized_slices", noted)
    got = base.dense(spark, f"{tmp_path}/slices")
    assert [sorted(map(tuple, x.collect())) for x in got] == want
    assert {r.seg: bytes(r.data) for r in segments.stream(got[1], slices=runtime.slices_of(got[1])).collect()} == plain
    assert [name for name, _ in written] == ["half", "dense-edges", "pieces"]
    for _, rows in written[:2]:
        assert len(rows) == 4 and sum(rows) == len(want[1]) and max(rows) < 0.4 * len(want[1])
    assert len(written[2][1]) == 4


@pytest.mark.parametrize("rows", [[], [(7, k % 5, k) for k in range(50)], [(k, 1, k) for k in range(50)]])
def test_stream_in_slices_of_few_sources(spark, rows):
    d = spark.createDataFrame(rows, "src long, dst long, eid long")
    plain, got = ({r.seg: bytes(r.data) for r in segments.stream(d, 16, n).collect()} for n in (1, 4))
    assert got == plain


@pytest.mark.parametrize("name", ["support_vectors", "random_forest"])
def test_round_trip_alone_in_a_session_leaves_no_dense_edges(spark, sf, tmp_path, name, monkeypatch):
    """They and their ids stayed beside what was restored; where another query built them they still stay."""
    os.symlink(sf, tmp_path / "alone")
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path / "shared"))
    got = catalog.QUERIES[f"learned_roundtrip_{name}"](spark, f"{tmp_path}/alone")
    assert _kinds(tmp_path / "shared") == ["restored", "running"]
    got = sorted(map(tuple, got.select("src", "dst", "eid").collect()))
    assert got == sorted(map(tuple, base.dense(spark, f"{tmp_path}/alone")[1].select("src", "dst", "eid").collect()))
    catalog.QUERIES[f"learned_roundtrip_{name}"](spark, f"{tmp_path}/alone")
    assert {"dense", "dense-edges"} < set(_kinds(tmp_path / "shared"))


def test_net_in_whole_numbers_predicts_alike_in_any_batch():
    """As the net it is made of but for near ties, and exactly as plain whole numbers, whatever stands beside a row."""
    r = np.random.default_rng(5)
    x = np.ascontiguousarray(r.integers(0, 13, (10, 2000)).astype(np.int8)).T
    for scale in (0.01, 2, 40):
        layers = {"w0": r.normal(size=(16, 10)) * scale, "b0": r.normal(size=16), "w1": r.normal(size=(13, 16)) * scale, "b1": r.normal(size=13)}
        model = segments._whole_net(layers)
        got = model(x)
        a = {k: v.astype(np.int64) for k, v in model.arrays.items()}
        hidden = a["sigmoid"][np.clip((a["w0"] @ x.T + a["b0"][:, None]) >> a["shift"][0], 0, len(a["sigmoid"]) - 1)]
        assert (got == (a["w1"] @ hidden + a["b1"][:, None]).argmax(0)).all()
        assert (np.abs(a["w0"]).sum(1) * 12 + np.abs(a["b0"])).max() < 2**24 > (np.abs(a["w1"]).sum(1) * 1023 + np.abs(a["b1"])).max()
        assert (got == predictors.Model("layers", layers)(x)).mean() > 0.98
        for n in (1, 3, 17):
            assert (model(np.ascontiguousarray(x[50 : 50 + n].T).T) == got[50 : 50 + n]).all()


@pytest.mark.parametrize("tie", [False, True])
def test_linear_predictions_are_plain_ones(tie, monkeypatch):
    """Weights of whole 2 ** -26ths go to the first largest sum without a comparison per symbol."""
    r = np.random.default_rng(6)
    w, b = segments._exact(r.normal(size=(13, 10))), segments._exact(np.r_[-1e9, r.normal(size=12)])
    if tie:
        w[9], b[9], w[4], b[4] = w[2], b[2], w[2], b[2]
    x = np.ascontiguousarray(r.integers(0, 13, (10, 2000)).astype(np.int8)).T
    monkeypatch.setattr(segments, "_highest", None)
    assert (segments.compiled(predictors.Model("linear", {"weights": w, "bias": b}))(x) == (w @ x.T + b[:, None]).argmax(0)).all()
