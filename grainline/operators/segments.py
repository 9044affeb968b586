"""Symbol streams a segment a row: encoding edges, fitting, correcting and restoring without a row per symbol."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.functions.codecs import END, FIELD, RECORD
from grainline.operators import predictors
from grainline.operators.predictors import CONTEXT, SEGMENT, SYMBOLS, Model
from grainline.runtime import dropped, materialized, materialized_slices, running

#: Symbols of a stored piece of the stream, about, and windows that a model sees at once.
PIECE, STEP = 1 << 20, 1 << 15


# ------------------------------------------------------------------ edges to symbols and back


def symbols_of(src: np.ndarray, dst: np.ndarray, eid: np.ndarray) -> np.ndarray:
    """The records of codecs.adjacency_symbols(), one after another, of whole sources in order of (src, dst, eid)."""
    n = len(src)
    first = np.r_[True, src[1:] != src[:-1]]
    delta = np.where(first, dst, dst - np.r_[np.int64(0), dst[:-1]])
    record = np.cumsum(first) - 1
    starts = [np.flatnonzero(first | np.r_[True, x[1:] != x[:-1]]) for x in (delta, eid)]
    runs = [np.bincount(record[s], minlength=record[-1] + 1) for s in starts]
    size = 1 + 2 * runs[0] + 2 * runs[1]
    base = np.cumsum(size) - size
    numbers = np.empty(size.sum(), np.int64)
    numbers[base] = src[first]
    for s, x, r, own in zip(starts, (delta, eid), (base + 1, base + 1 + 2 * runs[0]), runs, strict=True):
        at = r[record[s]] + 2 * (np.arange(len(s)) - (np.cumsum(own) - own)[record[s]])
        numbers[at], numbers[at + 1] = np.diff(np.append(s, n)), x[s]
    digits = np.ones(len(numbers), np.int64)
    for k in range(1, 19):
        if not (more := numbers >= 10**k).any():
            break
        digits += more
    end = np.cumsum(digits + 1) - 1
    out = np.full(end[-1] + 1, FIELD, np.int8)
    out[end[base + size - 1]] = RECORD
    at = end - 1
    while len(at):
        rest = numbers // 10
        out[at] = numbers - 10 * rest
        left = np.flatnonzero(rest)
        numbers, at = rest[left], at[left] - 1
    return out


def edges_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, eid) of whole records: the inverse of symbols_of()."""
    end = np.flatnonzero(symbols >= FIELD)
    start = np.r_[0, end[:-1] + 1]
    size, numbers, at = end - start, np.zeros(len(end), np.int64), np.arange(len(end))
    for k in range(int(size.max(initial=0))):
        at = at[size[at] > k]
        numbers[at] = numbers[at] * 10 + symbols[start[at] + k]
    last = symbols[end] >= RECORD
    record = np.cumsum(last) - last
    key = np.r_[True, last[:-1]]
    pairs = numbers[~key].reshape(-1, 2)
    of = record[~key][::2]
    both = np.bincount(of, weights=pairs[:, 0], minlength=last.sum()).astype(np.int64)  # exact below 2 ** 53
    values, whose = np.repeat(pairs[:, 1], pairs[:, 0]), np.repeat(np.arange(len(both)), both)
    begin = np.cumsum(both) - both
    front = np.arange(len(values)) - begin[whose] < (both // 2)[whose]
    delta, eid, whose = values[front], values[~front], whose[front]
    total = np.cumsum(delta)
    begin = np.cumsum(both // 2) - both // 2
    return numbers[key][whose], total - np.r_[0, total][begin][whose], eid


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _pieces(batches: Iterator[pa.RecordBatch], slice_: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, done = (slice_ << 32) + TaskContext.get().partitionId(), 0

    def put(held: list) -> pa.RecordBatch:
        nonlocal done
        data = symbols_of(*[np.concatenate(c) for c in zip(*held, strict=True)]).tobytes()
        done += len(data)
        return pa.record_batch({"part": pa.array([part], pa.int64()), "at": pa.array([done - len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _columns(batch)
        if rows > PIECE // 20 and (cut := np.searchsorted(x[0], x[0][0] + (held[-1][0][-1] == x[0][0]))) < len(x[0]):
            yield put([*held, [c[:cut] for c in x]])
            x, held, rows = [c[cut:] for c in x], [], 0
        held.append(x)
        rows += len(x[0])
    if held:
        yield put(held)


def stream(edges: DataFrame, segment: int = SEGMENT, slices: int = 1, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(seg, data): the symbols of edges (src, dst, eid) as predictors.stream() numbers them, a segment a row, a symbol a byte.

    Sources are dealt by ranges and written in pieces; a piece's whole segments are cut out of it, and only its
    two ends meet those of its neighbours. With slices, ranges of about as many edges are sorted one after another.
    Tables that edges rests on (spent) go once the pieces are written.
    """
    order = ["src", "dst", "eid"]
    cuts = sorted(set(edges.approxQuantile("src", [k / slices for k in range(1, slices)], 0.02))) if slices > 1 else []

    def sliced(k: int) -> DataFrame:
        d = edges.select(*order)
        for on in [F.col("src") > int(c) for c in cuts[k - 1 : k] if k] + [F.col("src") <= int(c) for c in cuts[k : k + 1]]:
            d = d.where(on)
        d = d.repartitionByRange("src").sortWithinPartitions(*order)
        return d.mapInArrow(lambda batches: _pieces(batches, k), "part bigint, at bigint, data binary")

    pieces = materialized_slices(map(sliced, range(len(cuts) + 1)), "pieces")
    for t in spent:
        dropped(t)
    sizes = sorted((r["part"], r["n"]) for r in pieces.groupBy("part").agg(F.sum(F.octet_length("data")).alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], itertools.accumulate([n for _, n in sizes], initial=0), strict=False))
    total = sum(n for _, n in sizes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seg, at, data) -> pa.RecordBatch:
            return pa.record_batch({"seg": pa.array(seg, pa.int64()), "at": pa.array(at, pa.int64()), "data": data})

        for batch in batches:
            for part, at, data in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "data")), strict=True):
                start = before[part] + at
                end = start + len(data)
                if end == total:
                    data = data[:-1] + bytes([END])
                a, b = -(-start // segment), end // segment
                if a > b:  # within one segment
                    yield rows([b], [start], pa.array([data], pa.binary()))
                    continue
                if start < a * segment:
                    yield rows([a - 1], [start], pa.array([data[: a * segment - start]], pa.binary()))
                for k in range(a, b, 4096):
                    n = min(4096, b - k)
                    whole = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * segment, segment, dtype=np.int32)), pa.py_buffer(data[k * segment - start : (k + n) * segment - start])])
                    yield rows(np.arange(k, k + n), [-1] * n, whole)
                if b * segment < end:
                    yield rows([b], [b * segment], pa.array([data[b * segment - start :]], pa.binary()))

    d = materialized(pieces.mapInArrow(cut, "seg bigint, at bigint, data binary"), "segments")
    dropped(pieces)
    ends = d.where("at >= 0").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("x"))
    return d.where("at < 0").select("seg", "data").unionByName(ends.select("seg", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data")))


# ------------------------------------------------------------------ grids of segments


def _grids(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segs, ends, grid): a column per segment in ascending order, a row per place, -1 beyond its end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        segs = batch.column("seg").to_numpy()
        data = batch.column("data").to_pylist()
        ends = np.array([len(x) for x in data])
        grid = np.frombuffer(b"".join(x if len(x) == segment else x + b"\xff" * (segment - len(x)) for x in data), np.int8).reshape(-1, segment)
        order = np.argsort(segs)
        yield segs[order], ends[order], np.ascontiguousarray(grid[order].T)


def _windows(grid: np.ndarray, context: int, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(x, y, place, place): windows as rows of x in the grid's order, and the symbols that follow them; -1 where a segment has ended."""
    n = max(1, step // max(1, grid.shape[1]))
    for lo in range(context, len(grid), n):
        hi = min(lo + n, len(grid))
        yield np.stack([grid[lo - context + c : hi - context + c].ravel() for c in range(context)]).T, grid[lo:hi].ravel(), lo, hi


def _there(grid: np.ndarray, context: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and what follows them, without places beyond a segment's end. x.T is contiguous."""
    whole = (grid >= 0).all()
    for x, y, _, _ in _windows(grid, context):
        if not whole:
            on = y >= 0
            x, y = np.ascontiguousarray(x.T[:, on]).T, y[on]
        if len(y):
            yield x, y


def _summed(segments: DataFrame, count: Callable, segment: int) -> dict[int, int]:
    """Sums over all segments of count(segs, ends, grid), (places, numbers) of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for segs, ends, grid in _grids(batches, segment):
            own = count(segs, ends, grid)
            sums = own if sums is None else sums + own
        if sums is not None:
            at = np.flatnonzero(sums)
            yield pa.record_batch({"at": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    d = segments.select("seg", "data").mapInArrow(run, "at bigint, n bigint")
    return {r["at"]: r["n"] for r in d.groupBy("at").agg(F.sum("n").alias("n")).collect()}


def _array(found: dict[int, int], *shape: int) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[list(found)] = list(found.values())
    return out.reshape(shape)


# ------------------------------------------------------------------ models of all windows


def _order_k(segments: DataFrame, context: int, segment: int, k: int = 4) -> Model:
    def count(segs, ends, grid):
        out = np.zeros(SYMBOLS ** (k + 1), np.int64)
        for x, y in _there(grid, context):
            code = np.zeros(len(y), np.int64)
            for c in [*(x[:, j] for j in range(context - k, context)), y]:
                code = code * SYMBOLS + c
            out += np.bincount(code, minlength=len(out))
        return out

    return predictors.order_k_of(_array(_summed(segments, count, segment), SYMBOLS ** (k + 1)), k)


class _Trees:
    """Trees that grow a level at a time, as heaps: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, trees: int, depth: int, features: int, context: int, share: float | None):
        nodes = 2 ** (depth + 1) - 1
        self.depth, self.share = depth, share
        self.feature, self.most = np.full((trees, nodes), -1, np.int32), np.full((trees, nodes), 127, np.int8)
        self.label = np.zeros((trees, nodes), np.int8)
        r = np.random.default_rng(42)
        self.asked = np.stack([np.stack([np.sort(r.permutation(context)[:features]) for _ in range(nodes)]) for _ in range(trees)]).astype(np.int32)

    def weights(self, segs: np.ndarray, tree: int) -> np.ndarray:
        """How often each segment counts: once, or as drawn with replacement for the tree, alike whenever it is asked."""
        if self.share is None:
            return np.ones(len(segs), np.int64)
        with np.errstate(over="ignore"):
            h = (segs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((tree + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
            for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                h = (h ^ (h >> np.uint64(by))) * np.uint64(times)
        steps = np.cumsum([np.exp(-self.share) * self.share**i / np.prod(np.arange(1, i + 1)) for i in range(12)])
        return np.searchsorted(steps, (h >> np.uint64(11)).astype(float) / 2**53)

    def count(self, level: int, context: int) -> Callable:
        """Counts by (tree, node of the level, asked feature, value, next symbol).

        Every feature is counted at every node, two at once while there are few nodes; what a node doesn't ask is left out at the end.
        """
        nodes = 2**level
        wide = 1 if nodes > 16 else 2
        groups = [list(range(a, min(a + wide, context))) for a in range(0, context, wide)]
        asked = self.asked[:, nodes - 1 : 2 * nodes - 1]

        def count(segs, ends, grid):
            out = np.zeros((len(self.feature), *asked.shape[:0:-1], SYMBOLS, SYMBOLS), np.int64)
            for t in range(len(self.feature)):
                place, drawn = _descent(self.feature[t], self.most[t], level, context), self.weights(segs, t)
                found = [np.zeros(nodes * SYMBOLS ** (len(g) + 1), np.int64) for g in groups]
                for w in np.unique(drawn[drawn > 0]):
                    for x, y in _there(grid if (drawn == w).all() else np.ascontiguousarray(grid[:, drawn == w]), context):
                        base = (place(x) - (nodes - 1)) * SYMBOLS + y
                        bases = {n: base * SYMBOLS**n for n in {len(g) for g in groups}}
                        for g, sums in zip(groups, found, strict=True):
                            sums += w * np.bincount(bases[len(g)] + _code(x, g), minlength=len(sums))
                single = np.zeros((context, nodes, SYMBOLS, SYMBOLS), np.int64)  # (feature, node, value, next symbol)
                for g, sums in zip(groups, found, strict=True):
                    n = sums.reshape(nodes, SYMBOLS, *[SYMBOLS] * len(g))
                    for i, f in enumerate(g):
                        single[f] = n.sum(tuple(2 + j for j in range(len(g)) if j != i)).transpose(0, 2, 1)
                out[t] = single[asked[t].T, np.arange(nodes)]
            return out.ravel()

        return count

    def grow(self, segments: DataFrame, context: int, segment: int) -> None:
        trees, features = len(self.feature), self.asked.shape[2]
        for level in range(self.depth):
            nodes = 2**level
            n = _array(_summed(segments, self.count(level, context), segment), trees, features, nodes, SYMBOLS, SYMBOLS).transpose(0, 2, 1, 3, 4).astype(float)
            below = n.cumsum(3)  # (tree, node, feature, value, symbol): at most this value
            all_ = below[:, :, :, -1:]
            gini = lambda c: c.sum(-1) - (c**2).sum(-1) / np.maximum(c.sum(-1), 1)
            gain = gini(all_) - gini(below) - gini(all_ - below)
            gain[(below.sum(-1) == 0) | ((all_ - below).sum(-1) == 0)] = 0
            for t in range(trees):
                for i in range(nodes):
                    at = nodes - 1 + i
                    if level == 0:
                        self.label[t, at] = all_[t, i, 0, 0].argmax()
                    f, v = np.unravel_index(gain[t, i].argmax(), gain.shape[2:])
                    if all_[t, i, 0, 0].sum() and gain[t, i, f, v] > 1e-9:
                        self.feature[t, at], self.most[t, at] = self.asked[t, at, f], v
                        self.label[t, 2 * at + 1], self.label[t, 2 * at + 2] = below[t, i, f, v].argmax(), (all_[t, i, 0, 0] - below[t, i, f, v]).argmax()
                    else:
                        self.label[t, 2 * at + 1] = self.label[t, 2 * at + 2] = self.label[t, at]

    def model(self) -> Model:
        return Model("heaps", {"feature": self.feature, "most": self.most, "label": self.label})


def _code(x: np.ndarray, columns: list[int]) -> np.ndarray:
    """The symbols of up to three columns as one number."""
    out = x[:, columns[0]].astype(np.int16)
    for c in columns[1:]:
        out *= np.int16(SYMBOLS)
        out += x[:, c]
    return out


def _descent(feature: np.ndarray, most: np.ndarray, levels: int, context: int) -> Callable[[np.ndarray], np.ndarray]:
    """The node that rows come to after so many levels of a heap.

    Of the first six levels a bit stands for each of up to 64 ends, from left to right. A node where a row goes to
    the right takes away the ends on its left; the first end left is the row's. What is left by each
    value of three columns at once is looked up.
    """
    top = min(levels, 6)
    groups = [list(range(a, min(a + 3, context))) for a in range(0, context, 3)] if top else []
    by_value = np.full((context, SYMBOLS), (1 << 64) - 1, np.uint64)
    for level in range(top):
        for k in range(2**level):
            if (f := feature[2**level - 1 + k]) >= 0:
                half = 2 ** (top - level - 1)
                by_value[f, max(0, int(most[2**level - 1 + k]) + 1) :] &= np.uint64((1 << 64) - 1 ^ ((1 << half) - 1) << 2 * half * k)
    tables = []
    for g in groups:
        left = by_value[g[0]]
        for f in g[1:]:
            left = (left[:, None] & by_value[f]).ravel()
        if not tables or (left != left.max()).any():  # else no node asks these columns
            tables.append((g, left))
    to = np.maximum(feature, 0).astype(np.intp)

    def run(x: np.ndarray) -> np.ndarray:
        if top:
            left = tables[0][1].take(_code(x, tables[0][0]))
            for g, table in tables[1:]:
                left &= table.take(_code(x, g))
            left &= ~left + np.uint64(1)
            at = (left.astype(float).view(np.int64) >> 52) - (1023 - (2**top - 1))  # a power of two's exponent
        else:
            at = np.zeros(len(x), np.int64)
        if levels > top:
            flat, rows = x.T.ravel(), np.arange(len(x))
            for _ in range(levels - top):
                more = flat.take(to.take(at) * len(x) + rows) > most.take(at)
                at *= 2
                at += 1
                at += more
        return at

    return run


def _decision_tree(segments: DataFrame, context: int, segment: int, depth: int = 8) -> Model:
    trees = _Trees(1, depth, context, context, None)
    trees.grow(segments, context, segment)
    return trees.model()


def _random_forest(segments: DataFrame, context: int, segment: int, trees: int = 6, depth: int = 5) -> Model:
    """A node asks the root of all features; each tree draws segments with replacement, 0.8 of them on average."""
    grown = _Trees(trees, depth, int(np.ceil(context**0.5)), context, 0.8)
    grown.grow(segments, context, segment)
    return grown.model()


def _naive_bayes(segments: DataFrame, context: int, segment: int) -> Model:
    """Multinomial with one added to every count, from sums over all windows."""

    def count(segs, ends, grid):
        out = np.zeros((context + 1, SYMBOLS), np.int64)
        for x, y in _there(grid, context):
            y = y.astype(np.int32)
            out[context] += np.bincount(y, minlength=SYMBOLS)
            for f in range(context):
                out[f] += np.bincount(x[:, f].astype(np.int32) * SYMBOLS + y, minlength=SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS).T @ np.arange(SYMBOLS)
        return out.ravel()

    n = _array(_summed(segments, count, segment), context + 1, SYMBOLS)
    seen, sums, rows = n[context] > 0, n[:context].T, n[context]
    bias = np.where(seen, np.log(rows + 1) - np.log(rows.sum() + seen.sum()), -(2.0**20))
    return Model("linear", {"weights": _exact(np.log(sums + 1) - np.log(sums.sum(1) + context)[:, None]), "bias": _exact(bias)})


def _exact(a: np.ndarray) -> np.ndarray:
    """Rounded so that sums of products with symbols are exact in any order."""
    return np.round(np.clip(a, -(2.0**20), 2.0**20) * 2.0**26) / 2.0**26


def _drawn(segments: DataFrame, context: int, segment: int, most_rows: int) -> DataFrame:
    """About most_rows windows (c1.., y) at random, seeded; all where there are fewer."""
    n = segments.agg(F.sum(F.greatest(F.octet_length("data") - context, F.lit(0)))).first()[0] or 0
    share = min(1.0, most_rows / max(1, n))
    names = [*[f"c{i + 1}" for i in range(context)], "y"]

    def run(batches):
        for segs, _, grid in _grids(batches, segment):
            r = np.random.default_rng([42, *segs[:1]])
            for x, y in _there(grid, context):
                on = r.random(len(y)) < share
                yield pa.record_batch([*(pa.array(x[on, c]) for c in range(context)), pa.array(y[on])], names=names)

    return materialized(segments.select("seg", "data").mapInArrow(run, ", ".join(f"{c} tinyint" for c in names)), "drawn")


def _support_vectors(segments: DataFrame, context: int, segment: int, most_rows: int = 200_000, passes: int = 5) -> Model:
    rows = _drawn(segments, context, segment, most_rows)
    m = predictors.support_vectors(rows.coalesce(8), context, 2 * most_rows, passes)
    dropped(rows)
    return Model("linear", {k: _exact(v) for k, v in m.arrays.items()})


def _neural_net(segments: DataFrame, context: int, segment: int, hidden: int = 16, most_rows: int = 200_000, passes: int = 30) -> Model:
    rows = _drawn(segments, context, segment, most_rows)
    m = predictors.neural_net(rows.coalesce(8), context, hidden, 2 * most_rows, passes)
    dropped(rows)
    return _whole_net(m.arrays)


def _whole_net(layers: dict[str, np.ndarray], range_: int = 16, steps: int = 128, most: int = 1023) -> Model:
    """A net of one hidden layer in whole numbers, whose sums stay below 2 ** 24: exact in single precision, in any order and on any machine.

    What the hidden layer sums is cut to 1 / steps within +-range_, and its sigmoid, from 0 to most, is looked up.
    """

    def whole(w: np.ndarray, b: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, int]:
        bits = int(np.floor(np.log2((2**24 - largest * w.shape[1] - 1) / max(1e-9, (np.abs(w).sum(1) * largest + np.abs(b)).max()))))
        return np.rint(np.ldexp(w, bits)).astype(np.float32), np.rint(np.ldexp(b, bits)).astype(np.float32), bits

    w0, b0, w1, b1 = (np.nan_to_num(layers[k], posinf=0, neginf=0) for k in ("w0", "b0", "w1", "b1"))
    widest = 2**23 / steps / (w0.shape[1] + 2)  # so that whole steps are left of the hidden sums
    w0, b0, bits = whole(np.clip(w0, -widest, widest) / END, np.clip(b0, -widest, widest) + range_, END)
    w1, b1, _ = whole(w1 / most, b1, most)
    at = (np.arange(2 * range_ * steps) + 0.5) / steps - range_
    return Model("net", {"w0": w0, "b0": b0, "shift": np.array([bits - int(np.log2(steps))]), "sigmoid": np.rint(most / (1 + np.exp(-at))).astype(np.float32), "w1": w1, "b1": b1})


FITS: dict[str, Callable[..., Model]] = {
    "order_k": _order_k, "decision_tree": _decision_tree, "random_forest": _random_forest, "naive_bayes": _naive_bayes, "support_vectors": _support_vectors, "neural_net": _neural_net,
}


def fit(segments: DataFrame, name: str, segment: int = SEGMENT, context: int = CONTEXT, **options) -> Model:
    """As predictors.fit(), from segments (seg, data)."""
    if name not in FITS:
        raise ValueError(f"unknown model {name!r}; one of {sorted(FITS)}")
    seen = sorted(_summed(segments, lambda segs, ends, grid: np.bincount(grid[context:][grid[context:] >= 0], minlength=SYMBOLS), segment))
    if len(seen) < 2:
        return Model("constant", {"symbol": np.array([*seen, 0][:1], np.int8)})
    return FITS[name](segments, context, segment, **options)


# ------------------------------------------------------------------ predictions


def _highest(z: np.ndarray) -> np.ndarray:
    """For each column the first row with the largest value."""
    best, at = z[0].copy(), np.zeros(z.shape[1], np.int8)
    for c in range(1, len(z)):
        more = z[c] > best
        at[more] = c
        np.maximum(best, z[c], out=best)
    return at


def compiled(model: Model) -> predictors.Predict:
    """The model's predictions for rows x whose x.T is contiguous, made ready once; encoder and decoder both use it."""
    a = model.arrays
    if model.kind == "order_k" and a["base"][0] == SYMBOLS:
        k = max(int(j) for j in a if j != "base")
        table = predictors._back_off(a, np.indices((SYMBOLS,) * k).reshape(k, -1).T) if k else None

        def order_k(x: np.ndarray) -> np.ndarray:
            at = np.zeros(len(x), np.int32)
            for c in range(x.shape[1] - k, x.shape[1]):
                at *= SYMBOLS
                at += x[:, c]
            return table[at]

        return order_k if k else model
    if model.kind == "heaps":
        levels = int(np.log2(a["feature"].shape[1] + 1)) - 1
        ready: dict[int, list] = {}

        def heaps(x: np.ndarray) -> np.ndarray:
            if (width := x.shape[1]) not in ready:
                ready[width] = [_descent(f, m, levels, width) for f, m in zip(a["feature"], a["most"], strict=True)]
            labels = [label.take(place(x)) for place, label in zip(ready[width], a["label"], strict=True)]
            if len(labels) == 1:
                return labels[0]
            votes = np.zeros((SYMBOLS, len(x)), np.int8)
            for c in range(SYMBOLS):
                for own in labels:
                    votes[c] += (own == c).view(np.int8)
            return _highest(votes)

        return heaps
    if model.kind == "linear":
        weights, bias = (np.ldexp(a[k], 26) for k in ("weights", "bias"))
        if (np.rint(weights) == weights).all() and (np.rint(bias) == bias).all() and (np.abs(weights).sum(1) * END + np.abs(bias)).max() < 2**48:
            # sums are whole numbers; the lowest four bits say whose they are
            weights, bias = 16 * weights, (16 * bias + 15 - np.arange(len(bias)))[:, None]
            return lambda x: (15 - (np.max(weights @ x.T.astype(float) + bias, axis=0).astype(np.int64) & 15)).astype(np.int8)
        return lambda x: _highest(a["weights"] @ x.T.astype(float) + a["bias"][:, None])
    if model.kind == "net":
        w0, b0, w1, b1, shift, sigmoid = a["w0"], a["b0"][:, None], a["w1"], a["b1"][:, None], int(a["shift"][0]), a["sigmoid"]
        own = 15 - np.arange(len(w1), dtype=np.int32)[:, None]

        def net(x: np.ndarray) -> np.ndarray:
            z = w0 @ x.T.astype(np.float32)
            z += b0
            at = z.astype(np.int32)
            at >>= shift
            h = w1 @ sigmoid.take(at, mode="clip")
            h += b1
            z = h.astype(np.int32)
            z <<= 4
            z += own
            return (15 - (z.max(0) & 15)).astype(np.int8)

        return net
    if model.kind == "layers":

        def layers(x: np.ndarray) -> np.ndarray:
            h = x.T.astype(float) / END
            for i in range(len(a) // 2):
                z = a[f"w{i}"] @ (h if i == 0 else 1 / (1 + np.exp(-h))) + a[f"b{i}"][:, None]
                h = z
            return _highest(np.round(h, 9))

        return layers
    return model


# ------------------------------------------------------------------ corrections


def corrections(segments: DataFrame, model: Model, segment: int = SEGMENT, context: int = CONTEXT) -> DataFrame:
    """(seg, n, wrong, data): a segment's length, a bit per symbol that the decoder can't know, and those symbols, as predictors.corrections()."""

    def run(batches):
        predict = compiled(model)
        for segs, ends, grid in _grids(batches, segment):
            keep = grid >= 0
            for x, y, lo, hi in _windows(grid, context):
                keep[lo:hi] &= ((predict(np.maximum(x.T, 0).T) != y) | (y == END)).reshape(hi - lo, -1)
            keep = np.ascontiguousarray(keep.T)
            bits = np.packbits(keep, axis=1)
            data = np.ascontiguousarray(grid.T)[keep]
            offsets = np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32)
            fixed = np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)
            binary = lambda at, x: pa.BinaryArray.from_buffers(pa.binary(), len(segs), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.record_batch({"seg": pa.array(segs, pa.int64()), "n": pa.array(ends, pa.int32()), "wrong": binary(fixed, bits), "data": binary(offsets, data)})

    return segments.select("seg", "data").mapInArrow(run, "seg bigint, n int, wrong binary, data binary")


def _restored(batch: pa.RecordBatch, predict: predictors.Predict, segment: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segs, ends, grid) of corrections, segments in ascending order; all advance in step."""
    segs, ends = batch.column("seg").to_numpy(), batch.column("n").to_numpy()
    keep = np.unpackbits(np.frombuffer(b"".join(batch.column("wrong").to_pylist()), np.uint8).reshape(len(segs), -1), axis=1)[:, :segment].astype(bool)
    grid = np.zeros((len(segs), segment), np.int8)
    grid[keep] = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.int8)
    order = np.argsort(segs)
    grid, known, ends = np.ascontiguousarray(grid[order].T), np.ascontiguousarray(keep[order].T), ends[order]
    for k in range(context, int(ends.max(initial=0))):
        np.copyto(grid[k], predict(grid[k - context : k].T), where=~known[k])
    return segs[order], ends, grid


EDGE = "src bigint, dst bigint, eid bigint, seg bigint, part tinyint, last bigint, data binary"


def edges(table: DataFrame, model: Model, segment: int = SEGMENT, context: int = CONTEXT) -> DataFrame:
    """(src, dst, eid) of every edge, from corrections(). Segments that stand together are read as one stretch.

    Only the parts of records that cross a stretch's end travel on, two a stretch: they are numbered by a
    running sum and joined.
    """

    def rows(src, dst, eid) -> pa.RecordBatch:
        gone = [pa.nulls(len(src), t) for t in (pa.int64(), pa.int8(), pa.int64(), pa.binary())]
        return pa.record_batch([*(pa.array(x, pa.int64()) for x in (src, dst, eid)), *gone], names=["src", "dst", "eid", "seg", "part", "last", "data"])

    def ends_of(found: list) -> pa.RecordBatch:
        seg, part, last, data = zip(*found, strict=True)
        gone = [pa.nulls(len(seg), pa.int64())] * 3
        return pa.record_batch([*gone, pa.array(seg, pa.int64()), pa.array(part, pa.int8()), pa.array(last, pa.int64()), pa.array(data, pa.binary())], names=["src", "dst", "eid", "seg", "part", "last", "data"])

    def run(batches):
        predict = compiled(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            segs, ends, grid = _restored(batch, predict, segment, context)
            found = []
            cuts = np.flatnonzero(np.diff(segs) != 1) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(segs)]):
                if (ends[a:b] == segment).all():
                    flat = grid[:, a:b].T.ravel()
                else:
                    flat = np.concatenate([grid[: ends[i], i] for i in range(a, b)])
                stops = np.flatnonzero(flat >= RECORD) + 1
                if not len(stops):
                    found.append((int(segs[a]), 0, 0, flat.tobytes()))
                    continue
                found.append((int(segs[a]), 0, 1, flat[: stops[0]].tobytes()))
                if stops[-1] < len(flat):
                    found.append((int(segs[a]), 2, 0, flat[stops[-1] :].tobytes()))
                for lo, hi in itertools.pairwise([stops[0], *stops[np.searchsorted(stops, np.arange(stops[0] + PIECE, stops[-1], PIECE))].tolist(), stops[-1]]):
                    if hi > lo:
                        yield rows(*edges_of(flat[lo:hi]))
            yield ends_of(found)

    def joined(batches):
        for batch in batches:
            for x in batch.column("data").to_pylist():
                src, dst, eid = edges_of(np.frombuffer(x, np.int8))
                yield pa.record_batch({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "eid": pa.array(eid, pa.int64())})

    d = materialized(table.select("seg", "n", "wrong", "data").mapInArrow(run, EDGE), "restored")
    # a head that ends a record belongs to what came before it
    ends = running(d.where("seg IS NOT NULL").select("seg", "part", "last", "data"), ["seg", "part"], "last", "record")
    ends = ends.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("seg", "part", "data"))).alias("x"))
    whole = ends.select(F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data")).where("length(data) > 0")
    return d.where("seg IS NULL").select("src", "dst", "eid").unionByName(whole.mapInArrow(joined, "src bigint, dst bigint, eid bigint"))
