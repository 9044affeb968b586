"""Distances between rows at most w places apart, character histograms, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def neighbours(df: DataFrame, w: int, value: str, pos: str = "pos", chunk_rows: int = 4096) -> DataFrame:
    """(i, p, a, b): every pair of rows with 0 < p - i <= w places between, and their values.

    Rows meet in chunks of places; each chunk also gets the w rows that follow it, so no window ever
    spans the table and no task sorts all rows.
    """
    d = df.select(F.col(pos).alias("i"), F.col(value).alias("a"))
    copies = F.array_distinct(F.array(F.expr(f"i DIV {chunk_rows}"), F.greatest(F.expr(f"(i - {w}) DIV {chunk_rows}"), F.lit(0))))
    d = d.withColumn("chunk", F.explode(copies))
    over = Window.partitionBy("chunk").orderBy("i")
    pairs = F.array(*[F.struct(F.lead("i", k).over(over).alias("p"), F.lead("a", k).over(over).alias("b")) for k in range(1, w + 1)])
    d = d.withColumn("n", pairs).where(F.expr(f"i DIV {chunk_rows} = chunk")).select("i", "a", F.explode("n").alias("n"))
    return d.select("i", "n.p", "a", "n.b").where("p IS NOT NULL")


def neighbour_view(df: DataFrame, w: int, value: str, pos: str = "pos", chunk_rows: int = 4096) -> DataFrame:
    """(i, view): of each row the values of the w rows before it, its own and of the w after it, 0 beyond the ends. Places are gapless."""
    d = df.select(F.col(pos).alias("i"), F.col(value).alias("a"))
    copies = F.array_distinct(F.array(*[F.expr(f"greatest((i + {k}) DIV {chunk_rows}, 0)") for k in (-w, 0, w)]))
    d = d.withColumn("chunk", F.explode(copies))
    over = Window.partitionBy("chunk").orderBy("i")
    view = F.array(*[F.coalesce(F.lag("a", -k).over(over) if k else F.col("a"), F.lit(0)) for k in range(-w, w + 1)])
    return d.withColumn("view", view).where(F.expr(f"i DIV {chunk_rows} = chunk")).select("i", "view")


def _runs(codes: Column, make) -> Column:
    """make(code, how many) of each run of equal codes of a sorted array, in one pass over where runs start."""
    starts = F.filter(F.transform(codes, lambda c, i: F.when((i == 0) | (c != F.get(codes, i - 1)), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda s, k: make(F.get(codes, s), F.coalesce(F.get(starts, k + 1), F.size(codes)) - s))


def _codes(text: Column, bins: int) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.sort_array(F.transform(chars, lambda c: F.least(F.greatest(F.ascii(c) - 32, F.lit(0)), F.lit(bins - 1)).cast("bigint")))


def char_histogram(df: DataFrame, text: str, pos: str = "pos") -> DataFrame:
    """(pos, code, n): characters of each row's text, without the zeros."""
    chars = df.select(pos, F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("c"))
    return chars.groupBy(pos, F.ascii("c").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def char_bag(text: Column, bins: int = 256) -> Column:
    """The text's character bins with their counts, each as one number count * bins + bin; time is n log n in the text."""
    return _runs(_codes(text, bins), lambda c, n: n.cast("bigint") * bins + c)


def bag_l1(a: Column, b: Column, bins: int = 256) -> Column:
    """The L1 distance of two bags' counts. Bags have a number per bin at most."""
    one = F.map_from_entries(F.transform(a, lambda x: F.struct(x % bins, F.expr("1L") * F.floor(x / bins))))
    other = F.map_from_entries(F.transform(b, lambda x: F.struct(x % bins, F.expr("1L") * F.floor(x / bins))))
    both = F.map_zip_with(one, other, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.aggregate(F.map_values(both), F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")


DISTANCES = {
    "edit": lambda a, b: F.levenshtein(a, b).cast("double"),
    "word_bag": lambda a, b: bag_l1(char_bag(a), char_bag(b)),
    "cosine": lambda a, b: F.lit(1.0) - dot(a, b),
}


def window_distances(df: DataFrame, w: int, value: str, method: str, pos: str = "pos", within: float | None = None) -> DataFrame:
    """(i, p, d) for all pairs of rows at most w places apart, by a named distance, at most `within` if given."""
    if method not in DISTANCES:
        raise ValueError(f"unknown distance {method!r}; one of {sorted(DISTANCES)}")
    d = df
    if method == "cosine":
        d = df.select(pos, unit(F.col(value)).alias(value))
    elif method == "word_bag":  # once per row rather than once per pair
        d = df.select(pos, F.explode(F.array(char_bag(F.col(value)))).alias(value))
    measure = bag_l1 if method == "word_bag" else DISTANCES[method]
    out = neighbours(d, w, value, pos).select("i", "p", measure(F.col("a"), F.col("b")).alias("d"))
    return out if within is None else out.where(F.col("d") <= within)


def _matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whole): vectors of one length as rows of doubles, and which of them are neither null nor hold a null; others are zeros."""
    values = pa.array(values.to_pylist(), pa.list_(pa.float64())) if values.type.num_fields == 0 else values.cast(pa.list_(pa.float64()))
    n = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    dims = int(n.max(initial=0))
    flat = values.flatten()
    whole = (n == dims) & values.is_valid().to_numpy(zero_copy_only=False)
    if flat.null_count:
        gone = np.repeat(np.arange(len(n)), n)[flat.is_null().to_numpy(zero_copy_only=False)]
        whole[gone] = False
    out = np.zeros((len(n), dims))
    out[whole] = flat.fill_null(0).to_numpy(zero_copy_only=False)[np.repeat(whole, n)].reshape(-1, dims)
    return out, whole


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and b, summed place by place, so that equal sums are equal everywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(out)


def _nearest_of_block(x: np.ndarray, y: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, spare: int = 1, rows: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): for each row i of x its k nearest rows j of y, ties to the smaller j, without pairs for which same(i, j).

    Products of matrices bound every squared distance; what may be among the k nearest by these bounds is
    measured place by place. Of equal rows of y only the first k + spare can count, spare being the most that
    same() may take from a row of x.
    """
    packed = np.ascontiguousarray(y + 0.0)  # one zero for both
    _, group = np.unique(packed.view(np.dtype((np.void, packed.dtype.itemsize * max(1, packed.shape[1])))).ravel(), return_inverse=True) if packed.shape[1] else (None, np.zeros(len(y), np.int64))
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    left = np.sort(order[place < k + spare])
    y = y[left]
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps
    step, found = max(1, rows // max(1, len(y))), []
    for lo in range(0, len(x), step):
        a = x[lo : lo + step]
        with np.errstate(over="ignore", invalid="ignore"):
            about = xx[lo : lo + step, None] + yy - 2 * (a @ y.T)
            off = slack * (xx[lo : lo + step, None] + yy.max(initial=0, where=np.isfinite(yy)))
        odd = ~np.isfinite(about)
        about[odd] = np.inf
        n = min(k + spare, len(y))
        bound = np.partition(about, n - 1, axis=1)[:, n - 1 : n]
        i, j = np.nonzero((about <= bound + 2 * off) | odd)
        i += lo
        keep = ~same(i, left[j])
        i, j = i[keep], j[keep]
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.concatenate([_distance(x[i[s : s + rows // 32]], y[j[s : s + rows // 32]]) for s in range(0, len(i), rows // 32)] or [np.zeros(0)])
        at = np.lexsort((j, d, i))
        i, j, d = i[at], j[at], d[at]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        found.append((i[best], left[j[best]], d[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", block_rows: int = 4096) -> DataFrame:
    """(q, p, rank, d): the k nearest points of each query by Euclidean distance, ties to the smaller key.

    A stated query set against all points: blocks of queries meet blocks of points, each pair of blocks keeps
    its own best k, and only those meet again. A query is not its own neighbour; vectors that are null or
    hold a null come last. Blocks have at least block_rows points and 16 times as many at most, so a task's
    work and memory don't grow with the table.
    """
    n, asked = points.count(), queries.count()
    rows = min(16 * block_rows, max(block_rows, n // 64))
    blocks, wide = max(16, -(-n // rows)), max(1, -(-asked // (16 * block_rows)))
    dealt = lambda m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("a"), dealt(wide).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    p = points.where(F.col(key).isNotNull()).select(F.col(key).alias("p"), F.col(vector).alias("b"), dealt(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("column"))
    kinds = {c: to_arrow_type(d.schema[c].dataType) for d, c in ((q, "q"), (p, "p"))}

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("p")
        keys = pa.concat_arrays([*asked["q"].cast(kinds["p"]).chunks, *there["p"].chunks]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        mine, own = keys[: len(asked)], keys[len(asked) :]
        a, b = asked["a"].combine_chunks(), there["b"].combine_chunks()
        (x, x_whole), (y, y_whole) = _matrix(a), _matrix(b)
        if x.shape[1] != y.shape[1]:  # vectors of two lengths have no distance
            x_whole[:] = False
        xi, yi = np.flatnonzero(x_whole), np.flatnonzero(y_whole)
        spare = int(np.bincount(own).max(initial=1))
        parts = []
        if len(xi) and len(yi):
            i, j, d = _nearest_of_block(x[xi], y[yi], lambda i, j: mine[xi[i]] == own[yi[j]], k, spare)
            parts.append((xi[i], yi[j], d, np.ones(len(i), bool)))
        for whole, others in ((True, np.flatnonzero(~y_whole)[: k + spare]), (False, np.arange(min(len(there), k + spare)))):
            of = np.flatnonzero(x_whole == whole)
            i, j = np.repeat(of, len(others)), np.tile(others, len(of))
            apart = mine[i] != own[j]
            parts.append((i[apart], j[apart], np.zeros(apart.sum()), np.zeros(apart.sum(), bool)))
        i, j, d, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table({"q": asked["q"].take(pa.array(i)), "p": there["p"].take(pa.array(j)), "d": pa.array(d, mask=~known)})

    d = q.groupBy("block", "column").cogroup(p.groupBy("block", "column")).applyInArrow(run, f"q {q.schema['q'].dataType.simpleString()}, p {p.schema['p'].dataType.simpleString()}, d double")
    over = Window.partitionBy("q").orderBy(F.asc_nulls_last("d"), "p")
    return d.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("q", "p", "rank", "d")


def hashed_vectors(df: DataFrame, text: str, features: int = 64, n: int = 3) -> DataFrame:
    """df with `vec`: unit vectors of hashed character n-grams, in place of a sentence encoder. Texts are read once, sorted by feature."""
    grams = F.expr(f"sort_array(transform(sequence(0, greatest(length({text}) - {n}, 0)), i -> CAST(pmod(xxhash64(substring({text}, i + 1, {n})), {features}) AS INT)))")
    d = df.withColumn("_g", grams).withColumn("_m", F.map_from_entries(_runs(F.col("_g"), lambda c, k: F.struct(c, k))))
    counts = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda b: F.coalesce(F.element_at("_m", b), F.lit(0)).cast("double"))
    return d.withColumn("_c", counts).withColumn("vec", unit(F.col("_c"))).drop("_g", "_m", "_c")
