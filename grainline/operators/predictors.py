"""Next-symbol models over symbol streams, and correction tables that make them lossless."""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainline.functions.codecs import END
from grainline.runtime import materialized, running

#: Symbols of a segment, and symbols that a prediction looks back on.
SEGMENT, CONTEXT = 1024, 10
SYMBOLS = END + 1


def stream(records: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(seg, pos, sym): the records (src, symbols) one after another by src, the last symbol of all being END."""
    d = running(records.withColumn("n", F.size("symbols").cast("bigint")), ["src"], "n", "start")
    total = d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    d = d.select("start", F.posexplode("symbols").alias("k", "sym")).select((F.col("start") + F.col("k")).alias("pos"), "sym")
    return d.select(F.expr(f"pos DIV {segment}").alias("seg"), "pos", F.when(F.col("pos") == total - 1, F.lit(END)).otherwise(F.col("sym")).cast("tinyint").alias("sym"))


def windows(symbols: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(seg, pos, c1..cK, y): each symbol with the ones before it in its segment, where there are enough."""
    over = Window.partitionBy("seg").orderBy("pos")
    d = symbols.select("seg", "pos", *[F.lag("sym", context - i).over(over).alias(f"c{i + 1}") for i in range(context)], F.col("sym").alias("y"))
    return d.where("c1 IS NOT NULL")


def order_k_table(rows: DataFrame, k: int, context: int = CONTEXT) -> DataFrame:
    """(context, sym, n): per context of the last k symbols its most frequent next one, ties to the smallest."""
    key = F.concat_ws(",", *[F.col(f"c{i}") for i in range(context - k + 1, context + 1)])
    n = rows.groupBy(key.alias("context"), F.col("y").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("context").agg(F.max(F.struct(F.col("n"), (-F.col("sym")).alias("s"))).alias("b"))
    return best.select("context", (-F.col("b.s")).cast("tinyint").alias("sym"), F.col("b.n").alias("n"))


Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A fitted model as plain arrays: called with rows of CONTEXT symbols it gives the next ones, alike in every session."""

    kind: str
    arrays: dict[str, np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return PREDICT[self.kind](self.arrays, x)

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.arrays)
        return out.getvalue()

    @staticmethod
    def loaded(kind: str, data: bytes) -> Model:
        with np.load(io.BytesIO(data), allow_pickle=False) as found:
            return Model(kind, {k: found[k] for k in found.files})


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """(kind, data): the model as one row, for an archive."""
    return spark.createDataFrame([(model.kind, bytearray(model.dumped()))], "kind string, data binary")


def model_of(table: DataFrame) -> Model:
    row = table.first()
    return Model.loaded(row["kind"], bytes(row["data"]))


def _constant(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.full(len(x), arrays["symbol"][0], np.int8)


def _back_off(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """From the longest context that was seen to shorter ones; table j is of the last j symbols of an alphabet of `base`."""
    base = int(arrays["base"][0])
    out = np.full(len(x), -1, arrays["0"].dtype)
    for j in sorted((int(k) for k in arrays if k != "base"), reverse=True):
        at = np.zeros(len(x), np.int64)
        for c in range(x.shape[1] - j, x.shape[1]):
            at = at * base + x[:, c]
        out = np.where(out < 0, arrays[str(j)][at], out)
    return np.maximum(out, 0)


def _votes(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The majority of all trees, ties to the smallest symbol. Trees stand one after another; `first` are their roots."""
    feature, threshold, left, right, prediction, first = (arrays[k] for k in ("feature", "threshold", "left", "right", "prediction", "first"))
    at, rows = np.tile(first, (len(x), 1)), np.arange(len(x))[:, None]
    while (feature[at] >= 0).any():
        below = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(feature[at] >= 0, np.where(below, left[at], right[at]), at)
    if len(first) == 1:
        return prediction[at][:, 0]
    return (prediction[at][:, :, None] == np.arange(SYMBOLS)).sum(1).argmax(1).astype(np.int8)


def _compiled(kind: str) -> Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]:
    def predict(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        from grainline.operators.segments import compiled

        return compiled(Model(kind, arrays))(x)

    return predict


def _linear(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    # rounded, so that sums in another order don't change a near tie
    return np.round(x.astype(float) @ arrays["weights"].T + arrays["bias"], 9).argmax(1).astype(np.int8)


def _layers(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """A feed-forward net: sigmoid layers, the last one's largest output wins."""
    h = x.astype(float) / END
    for k in range(len(arrays) // 2):
        z = h @ arrays[f"w{k}"].T + arrays[f"b{k}"]
        h = 1 / (1 + np.exp(-z))
    return np.round(z, 9).argmax(1).astype(np.int8)


PREDICT: dict[str, Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]] = {
    "constant": _constant, "order_k": _back_off, "trees": _votes, "heaps": _compiled("heaps"), "linear": _linear, "layers": _layers, "net": _compiled("net"),
}


def order_k(rows: DataFrame, k: int = 4, context: int = CONTEXT) -> Model:
    """Back-off from the last k symbols to fewer. The table has at most the sum of 13**i entries."""
    # one pass counts the longest contexts; shorter ones are sums of them
    code = F.lit(0).cast("bigint")
    for c in [*[f"c{i}" for i in range(context - k + 1, context + 1)], "y"]:
        code = code * SYMBOLS + F.col(c)
    counts = np.zeros(SYMBOLS ** (k + 1), np.int64)
    for r in rows.groupBy(code.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["at"]] = r["n"]
    return order_k_of(counts, k)


def order_k_of(counts: np.ndarray, k: int) -> Model:
    """The model of counts by the last k symbols and the next one, as digits to the base SYMBOLS."""
    tables = {"base": np.array([SYMBOLS], np.int64)}
    for j in range(k + 1):
        own = counts.reshape(SYMBOLS ** (k - j), SYMBOLS**j, SYMBOLS).sum(0)
        tables[str(j)] = np.where(own.sum(1) > 0, own.argmax(1), -1).astype(np.int8)
    return Model("order_k", tables)


def _assembled(rows: DataFrame, context: int, scale: float = 1.0) -> DataFrame:
    columns = [f"c{i + 1}" for i in range(context)]
    return VectorAssembler(inputCols=columns, outputCol="x").transform(rows.select(*[(F.col(c) / scale).cast("double").alias(c) for c in columns], F.col("y").cast("double").alias("y")))


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at random, seeded; all where there are fewer."""
    return rows.sample(min(1.0, most / max(1, rows.count())), seed=42)


def _trees(models: list) -> Model:
    """Fitted trees as arrays one after another: feature (-1 at a leaf), threshold, left, right, prediction."""
    rows: list[list[float]] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
        return at

    first = [walk(m._call_java("rootNode")) for m in models]
    f, t, left, right, p = np.array(rows).T
    return Model("trees", {"feature": f.astype(np.int32), "threshold": t, "left": left.astype(np.int32), "right": right.astype(np.int32), "prediction": p.astype(np.int8), "first": np.array(first, np.int32)})


def decision_tree(rows: DataFrame, depth: int = 8, context: int = CONTEXT) -> Model:
    return _trees([DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=depth, seed=42).fit(_assembled(rows, context))])


def random_forest(rows: DataFrame, trees: int = 6, depth: int = 5, context: int = CONTEXT) -> Model:
    """Stands in for boosted trees, of which Spark has two-class ones only."""
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, subsamplingRate=0.8, seed=42).fit(_assembled(rows, context))
    return _trees(model.trees)


def naive_bayes(rows: DataFrame, context: int = CONTEXT) -> Model:
    model = NaiveBayes(featuresCol="x", labelCol="y", modelType="multinomial", smoothing=1.0).fit(_assembled(rows, context))
    return Model("linear", {"weights": model.theta.toArray(), "bias": np.array(model.pi.toArray())})


def support_vectors(rows: DataFrame, context: int = CONTEXT, most_rows: int = 200_000, passes: int = 5) -> Model:
    """A linear support-vector machine for each symbol against the rest, fitted on about most_rows windows."""
    d = _assembled(_sampled(rows, most_rows), context).persist()
    weights, bias = np.zeros((SYMBOLS, context)), np.full(SYMBOLS, -1e9)
    seen = sorted(int(r["y"]) for r in d.select("y").distinct().collect())
    if len(seen) == 1:
        bias[seen] = 0
    else:
        machine = LinearSVC(featuresCol="x", labelCol="z", maxIter=passes)
        with ThreadPool(4) as pool:  # jobs of a machine are short, so four machines share the cores
            fitted = pool.map(lambda k: machine.fit(d.select("x", (F.col("y") == k).cast("double").alias("z"))), seen)
        for k, m in zip(seen, fitted, strict=True):
            weights[k], bias[k] = m.coefficients.toArray(), m.intercept
    d.unpersist()
    return Model("linear", {"weights": weights, "bias": bias})


def neural_net(rows: DataFrame, context: int = CONTEXT, hidden: int = 16, most_rows: int = 200_000, passes: int = 30) -> Model:
    """A feed-forward net over the window, in place of recurrent and convolutional ones, fitted on about most_rows windows."""
    sizes = [context, hidden, SYMBOLS]
    net = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=sizes, maxIter=passes, seed=42).fit(_assembled(_sampled(rows, most_rows), context, END))
    flat, arrays, at = net.weights.toArray(), {}, 0
    for k, (n, m) in enumerate(itertools.pairwise(sizes)):
        arrays[f"w{k}"], at = flat[at : at + n * m].reshape(n, m).T.copy(), at + n * m
        arrays[f"b{k}"], at = flat[at : at + m], at + m
    return Model("layers", arrays)


MODELS: dict[str, Callable[..., Model]] = {
    "order_k": order_k, "decision_tree": decision_tree, "random_forest": random_forest, "naive_bayes": naive_bayes, "support_vectors": support_vectors, "neural_net": neural_net,
}


def fit(rows: DataFrame, name: str, **options) -> Model:
    """A model of windows() rows by name; the same numpy code predicts when encoding and when decoding.

    Without a window, or where every window goes on with the same symbol, it is a constant.
    """
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; one of {sorted(MODELS)}")
    least, most = rows.agg(F.min("y"), F.max("y")).first()
    if least == most:
        return Model("constant", {"symbol": np.array([least or 0], np.int8)})
    return MODELS[name](rows, **options)


def _grid(rows: pd.DataFrame, segs: np.ndarray, segment: int) -> np.ndarray:
    """One row per segment of ascending segs, -1 where rows (seg, pos, sym) have nothing."""
    grid = np.full((len(segs), segment), -1, np.int8)
    grid[np.searchsorted(segs, rows["seg"].to_numpy(np.int64)), rows["pos"].to_numpy(np.int64) % segment] = rows["sym"].to_numpy(np.int8)
    return grid


def _rows(grid: np.ndarray, keep: np.ndarray, segs: np.ndarray, segment: int) -> pd.DataFrame:
    i, k = np.nonzero(keep)
    return pd.DataFrame({"seg": segs[i], "pos": segs[i] * segment + k, "sym": grid[i, k]})


def corrections(symbols: DataFrame, predict: Predict, segment: int = SEGMENT, context: int = CONTEXT, batch: int = 256) -> DataFrame:
    """(seg, pos, sym) of every symbol that the decoder can't know: a segment's first ones, the last of all, and wrong predictions."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        segs = np.unique(rows["seg"].to_numpy(np.int64))
        grid = _grid(rows, segs, segment)
        before = np.lib.stride_tricks.sliding_window_view(grid, context, axis=1)[:, :-1]
        there = grid[:, context:] >= 0
        keep = grid >= 0
        found = np.zeros_like(there)
        found[there] = predict(before[there]) != grid[:, context:][there]
        keep[:, context:] = found | (grid[:, context:] == END)
        return _rows(grid, keep, segs, segment)

    d = symbols.withColumn("_b", F.expr(f"seg DIV {batch}"))
    return d.groupBy("_b").applyInPandas(run, "seg bigint, pos bigint, sym tinyint")


def _filled(rows: pd.DataFrame, predict: Predict, segment: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segs, ends, grid) of a batch of segments, all advanced in step."""
    n = rows.groupby("seg")["n"].first().sort_index()
    segs, ends = n.index.to_numpy(np.int64), n.to_numpy(np.int64)
    grid = _grid(rows[rows["pos"].notna()], segs, segment)
    for k in range(context, segment):
        unknown = np.flatnonzero((grid[:, k] < 0) & (ends > k))
        if len(unknown):
            grid[unknown, k] = predict(grid[unknown, k - context : k])
    return segs, ends, grid


def restored(table: DataFrame, lengths: DataFrame, predict: Predict, segment: int = SEGMENT, context: int = CONTEXT, batch: int = 256) -> DataFrame:
    """(seg, pos, sym) again, from corrections and segments' lengths (seg, n). A batch of segments advances in step."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        segs, ends, grid = _filled(rows, predict, segment, context)
        return _rows(grid, np.arange(segment) < ends[:, None], segs, segment)

    d = lengths.join(table, "seg", "left").withColumn("_b", F.expr(f"seg DIV {batch}"))
    return d.groupBy("_b").applyInPandas(run, "seg bigint, pos bigint, sym tinyint")


def restored_records(table: DataFrame, lengths: DataFrame, predict: Predict, segment: int = SEGMENT, context: int = CONTEXT, batch: int = 256) -> DataFrame:
    """(symbols) per record, as records_of(restored(...)): records are cut where their segments are restored.

    Only the parts of records that cross a segment's end travel on, two a segment: they are numbered by a
    running sum over segments and joined.
    """
    from grainline.functions.codecs import RECORD

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        segs, ends, grid = _filled(rows, predict, segment, context)
        out = []
        for seg, end, row in zip(segs.tolist(), ends.tolist(), grid, strict=True):
            cuts = (np.flatnonzero(row[:end] >= RECORD) + 1).tolist()
            if not cuts:
                out.append((seg, 0, 0, row[:end].tobytes()))
                continue
            out.append((seg, 0, 1, row[: cuts[0]].tobytes()))
            out += [(seg, 1, 0, row[a:b].tobytes()) for a, b in itertools.pairwise(cuts)]
            if cuts[-1] < end:
                out.append((seg, 2, 0, row[cuts[-1] : end].tobytes()))
        return pd.DataFrame(out, columns=["seg", "part", "last", "data"])

    d = lengths.join(table, "seg", "left").withColumn("_b", F.expr(f"seg DIV {batch}"))
    d = materialized(d.groupBy("_b").applyInPandas(run, "seg bigint, part tinyint, last bigint, data binary"), "records")
    # a head that ends a record belongs to what came before it, so its own end counts only for later parts
    ends = running(d.where("part <> 1"), ["seg", "part"], "last", "record")
    ends = ends.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("seg", "part", "data"))).alias("x"))
    data = d.where("part = 1").select("data").unionByName(ends.select(F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data")))
    return data.select(F.transform(F.split(F.regexp_replace(F.hex("data"), "(..)", "$1,"), ","), lambda h: F.conv(h, 16, 10).cast("tinyint")).alias("symbols")).select(F.slice("symbols", 1, F.size("symbols") - 1).alias("symbols"))


def records_of(symbols: DataFrame) -> DataFrame:
    """(symbols) per record of a stream: cut after each RECORD or END symbol, records that cross segments included."""
    from grainline.functions.codecs import RECORD

    ends = symbols.withColumn("_e", (F.col("sym") >= RECORD).cast("bigint"))
    d = running(ends, ["pos"], "_e", "record")
    return d.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]).alias("symbols"))


def gaps(table: DataFrame) -> DataFrame:
    """(seg, pos, sym, gap): the distance of each correction from the one before it in its segment."""
    over = Window.partitionBy("seg").orderBy("pos")
    return table.select("seg", "pos", "sym", (F.col("pos") - F.coalesce(F.lag("pos").over(over), F.col("seg") * SEGMENT - 1)).alias("gap"))


def accuracy(symbols: DataFrame, table: DataFrame) -> DataFrame:
    """(n, wrong, ratio): how many symbols, how many of them corrections, and their share."""
    return symbols.agg(F.count(F.lit(1)).alias("n")).crossJoin(table.agg(F.count(F.lit(1)).alias("wrong"))).select("n", "wrong", (F.col("wrong") / F.col("n")).alias("ratio"))


def sliding(symbols: DataFrame, length: int, stride: int) -> DataFrame:
    """(pos, w): every stride-th window of so many symbols of the whole stream."""
    from grainline.operators.similarity import neighbours

    d = neighbours(symbols.select("pos", "sym"), length - 1, "sym").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("p", "b"))).alias("r"), F.first("a").alias("a"))
    d = d.where(f"size(r) = {length - 1} AND i % {stride} = 0")
    return d.select(F.col("i").alias("pos"), F.concat(F.array("a"), F.col("r.b")).alias("w"))
