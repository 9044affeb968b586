"""Records as character tokens against plain versions."""

import numpy as np
import pytest

from grainline.operators import predictors, records


def test_records_come_back(spark, tmp_path):
    """Nulls in any column, empty and repeated values, values of other alphabets; only records asked for are regenerated."""
    rows = [("v" if k % 3 else "e", k, None if k % 4 == 0 else f"n{k % 5}", "" if k % 7 == 0 else f"é {k % 3}\n,", None if k % 2 else k * 1.5) for k in range(60)] + [("v", 1000, None, None, None)]
    d = spark.createDataFrame(rows, "kind string, id long, a string, b string, c double")
    records.store(d, ["a", "b", "c"], str(tmp_path / "r"))
    wanted = d.where("id % 2 = 0").select("kind", "id")
    got = {(r.kind, int(r.id)): (r.a, r.b, r.c) for r in records.fetch(spark, str(tmp_path / "r"), wanted).collect()}
    assert got == {(kind, i): (a, b, None if c is None else str(c)) for kind, i, a, b, c in rows if i % 2 == 0}


def test_windows_and_training_batches(spark):
    d = spark.createDataFrame([("v", str(k), ["x" * k, None, "yz"]) for k in range(5)], "kind string, id string, fields array<string>")
    codes = {c: k + 2 for k, c in enumerate("0123456789:dietvrnxyz")}
    tokens = records.record_tokens(d, "fields", codes)
    want = {}
    for k in range(5):
        t = [codes[c] for c in f"verteid:{k}"] + [0] + [codes["x"]] * k + [0, 0, codes["y"], codes["z"], 0, 1]
        start = t.index(0) + 1
        padded = [0] * 10 + t
        want |= {(str(k), s): tuple(padded[start + s : start + s + 11]) for s in range(len(t) - start)}
    windows = records.record_windows(tokens)
    got = {(r.id, r.step): tuple(r[f"c{i + 1}"] for i in range(10)) + (r.y,) for r in windows.collect()}
    assert got == want
    batches = records.training_windows(windows, 7).groupBy("batch").count().collect()
    assert len(batches) == len(want) // 7 and {r["count"] for r in batches} == {7}
    model = records.token_model(windows, 30)
    again = predictors.Model.loaded(model.kind, model.dumped())
    x = np.array([w[:10] for w in want.values()])
    assert (model(x) == again(x)).all()
    wrong = {(r.kind, r.id): dict(zip(r.steps, r.tokens, strict=True)) for r in records.corrections(windows, model).collect()}
    for (i, s), w in want.items():
        assert wrong.get(("v", i), {}).get(s, int(model(np.array([w[:10]]))[0])) == w[10]
    keys = [r.key for r in records.keyed_json(records.corrections(windows, model)).collect()]
    assert keys == sorted(keys)


def test_endless_records_raise(spark):
    model = predictors.Model("constant", {"symbol": np.array([5], np.int8)})
    wanted = spark.createDataFrame([("v", "1")], "kind string, id string")
    none = spark.createDataFrame([], "kind string, id string, steps array<int>, tokens array<int>")
    with pytest.raises(Exception, match="no end"):
        records.regenerated(wanted, none, model, {c: k + 2 for k, c in enumerate("verteid:1")}, most=20).collect()
