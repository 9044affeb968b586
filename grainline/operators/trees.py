"""Attribute trees: each line as an edit of a similar line nearby."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.functions import editscript
from grainline.operators.similarity import hashed_vectors
from grainline.runtime import running

#: Rounds of merging, and the most places between a line and its parent.
ROUNDS, REACH = 5, 100
TREE = "chunk bigint, child bigint, parent bigint, payload binary"


class Sets:
    """Disjoint sets with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[b] = a
        return a != b


def _counts(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 256), np.int32)
    for k, line in enumerate(lines):
        codes = np.clip(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 32, 0, 255)
        out[k] = np.bincount(codes, minlength=256)
    return out


def _edit(lines: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.array([editscript.cost(editscript.script(lines[a], lines[b])) for a, b in zip(i, j, strict=True)], float)


def _vectors(lines: list[str], features: int = 64, n: int = 3) -> np.ndarray:
    """Unit vectors of hashed character n-grams."""
    out = np.zeros((len(lines), features))
    for k, line in enumerate(lines):
        grams = [zlib.crc32(line[i : i + n].encode("utf-8", "surrogatepass")) % features for i in range(max(1, len(line) - n + 1))]
        out[k] = np.bincount(grams, minlength=features)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def windowed(lines: list[str], method: str, w: int, limit: float | None = None, rounds: int = ROUNDS) -> list[int]:
    """Each line's parent, itself for roots, by greedy merging of representatives.

    A round measures representatives at most w places apart in their list and takes pairs by (distance,
    i, j): i becomes j's parent and j stops representing, if both still represent, lie in different sets
    and at most REACH lines apart. Rounds end when one line is left or nothing merges.
    """
    n = len(lines)
    parent, sets = list(range(n)), Sets(n)
    values = _counts(lines) if method == "word_bag" else _vectors(lines) if method == "vector" else None
    alive = np.arange(n)
    for _ in range(rounds):
        if len(alive) < 2:
            break
        a = np.concatenate([alive[:-k] for k in range(1, w + 1)])
        b = np.concatenate([alive[k:] for k in range(1, w + 1)])
        near = b - a <= REACH
        a, b = a[near], b[near]
        if method == "vector":
            d = np.round(1 - (values[a] * values[b]).sum(1), 9)
        else:
            d = np.abs(values[a] - values[b]).sum(1).astype(float) if values is not None else _edit(lines, a, b)
        if limit is not None:
            a, b, d = a[d <= limit], b[d <= limit], d[d <= limit]
        on = np.zeros(n, bool)
        on[alive] = True
        # (d, j, i) always follows (d, i, j), by when one of the two no longer represents
        for k in np.lexsort((b, a, d)):
            i, j = int(a[k]), int(b[k])
            if on[i] and on[j] and sets.join(i, j):
                parent[j], on[j] = i, False
        if on.sum() == len(alive):
            break
        alive = np.flatnonzero(on)
    return parent


def spanning(lines: list[str], vectors: np.ndarray, k: int = 5) -> list[int]:
    """Parents by a minimum spanning forest over each line's k nearest vectors, from each set's first line."""
    n = len(lines)
    d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(2) if n <= 512 else None
    pairs = []
    for i in range(n):
        own = d[i] if d is not None else ((vectors - vectors[i]) ** 2).sum(1)
        order = np.lexsort((np.arange(n), own))[: k + 1]
        pairs += [(float(own[j]), min(i, int(j)), max(i, int(j))) for j in order if j != i]
    sets, near = Sets(n), [[] for _ in range(n)]
    for _, i, j in sorted(set(pairs)):
        if sets.join(i, j):
            near[i].append(j)
            near[j].append(i)
    parent = [-1] * n
    for root in range(n):
        if parent[root] < 0:
            parent[root], todo = root, [root]
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if parent[y] < 0:
                        parent[y] = x
                        todo.append(y)
    return parent


def encoded(lines: DataFrame, parents: Callable[[pd.DataFrame], list[int]], chunk_rows: int = 4096) -> DataFrame:
    """TREE rows of lines (pos, line, ...), by chunks of places: payload is the script from the parent, or from ''.

    parents gets a chunk's rows in order and returns each row's parent by place in the chunk.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        text, pos = rows["line"].fillna("").tolist(), rows["pos"].tolist()
        up = parents(rows)
        made: dict[tuple[str, str], bytes] = {}  # once for each pair of texts
        data = []
        for k, p in enumerate(up):
            pair = ("" if p == k else text[p], text[k])
            if pair not in made:
                made[pair] = editscript.encode(editscript.near_script(*pair))
            data.append(made[pair])
        return pd.DataFrame({"chunk": rows["chunk"], "child": pos, "parent": [None if p == k else pos[p] for k, p in enumerate(up)], "payload": data}).astype({"parent": "Int64"})

    d = lines.withColumn("chunk", F.expr(f"pos DIV {chunk_rows}"))
    return d.groupBy("chunk").applyInPandas(run, TREE)


def attribute_tree(lines: DataFrame, method: str = "word_bag", w: int = 4, chunk_rows: int = 4096, limit: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The tree of lines (pos, line) by windowed merging; method word_bag, edit_distance or vector (cosine of hashed n-grams)."""
    if method not in ("word_bag", "edit_distance", "vector"):
        raise ValueError(f"unknown method {method!r}")
    return encoded(lines.select("pos", "line"), lambda rows: windowed(rows["line"].fillna("").tolist(), method, w, limit, rounds), chunk_rows)


def neighbour_tree(lines: DataFrame, k: int = 5, chunk_rows: int = 1024, dims: int = 10, exact: bool = True) -> DataFrame:
    """The tree of lines (pos, line) by nearest neighbours of hashed n-gram vectors, PCA-reduced unless dims is 0.

    exact compares all vectors of a chunk; otherwise signs of random projections first sort lines into buckets.
    """
    d = hashed_vectors(lines.select("pos", F.coalesce("line", F.lit("")).alias("line")), "line")

    def parents(rows: pd.DataFrame) -> list[int]:
        x = np.array(rows["vec"].tolist())
        text = rows["line"].tolist()
        if dims and len(x) > dims:
            x = x - x.mean(0)
            _, _, axes = np.linalg.svd(x, full_matrices=False)
            x = x @ axes[:dims].T
        if exact:
            return spanning(text, x, k)
        side = (x @ np.random.default_rng(3).normal(size=(x.shape[1], 6)) > 0) @ (1 << np.arange(6))
        up = list(range(len(text)))
        for b in np.unique(side):
            own = np.flatnonzero(side == b)
            for at, p in enumerate(spanning([text[i] for i in own], x[own], k)):
                up[own[at]] = int(own[p])
        return up

    return encoded(d, parents, chunk_rows)


def append(tree: DataFrame, path: str) -> None:
    """Adds a tree's chunks to the payloads in a folder. A chunk that is there already is replaced, so one that is run again does no harm."""
    tree.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def decoded(tree: DataFrame) -> DataFrame:
    """(pos, line) of every line: each chunk's scripts applied from its roots on, without recursion."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text: dict[int, str] = {}
        rows = rows.set_index("child")
        payload, parent = rows["payload"].to_dict(), rows["parent"].to_dict()
        for pos in payload:
            chain = []
            while pos not in text:
                chain.append(pos)
                if pd.isna(parent[pos]):
                    break
                pos = int(parent[pos])
            for p in reversed(chain):
                above = "" if pd.isna(parent[p]) else text[int(parent[p])]
                text[p] = editscript.apply(above, editscript.decode(payload[p]))
        return pd.DataFrame({"pos": list(text), "line": list(text.values())})

    return tree.groupBy("chunk").applyInPandas(run, "pos bigint, line string")


def closure(tree: DataFrame, hits: DataFrame, few: bool = False) -> DataFrame:
    """The tree rows that decoding hits (pos) needs: theirs and all above them, level by level. few: hits go to the tree's rows, which aren't shuffled."""
    from grainline.runtime import materialized

    sent = F.broadcast if few else lambda d: d
    need = materialized(tree.join(sent(hits.select(F.col("pos").alias("child")).distinct()), "child", "left_semi"), "closure")
    level = need
    while True:
        above = level.where("parent IS NOT NULL").select("chunk", F.col("parent").alias("child")).distinct()
        above = above.join(need, ["chunk", "child"], "left_anti")
        level = materialized(tree.join(sent(above), ["chunk", "child"], "left_semi"), "closure")
        if level.isEmpty():
            return need
        need = materialized(need.unionByName(level), "closure")


def lookup(tree: DataFrame, hits: DataFrame, few: bool = False) -> DataFrame:
    """(pos, line) of hits (pos) alone, decoding nothing that they don't rest on."""
    return decoded(closure(tree, hits, few)).join(hits.select("pos").distinct(), "pos", "left_semi")


def payload_offsets(tree: DataFrame) -> DataFrame:
    """(child, up, size, start) of a tree's rows by child: how far up the parent is (0 for roots), the payload's bytes, and all bytes before it."""
    d = tree.select("child", (F.col("child") - F.coalesce("parent", "child")).alias("up"), F.octet_length("payload").cast("bigint").alias("size"))
    return running(d, ["child"], "size", "start").select("child", "up", "size", "start")


def size_account(tree: DataFrame, lines: DataFrame) -> DataFrame:
    """(lines, edit_bytes, text_bytes): what a tree's scripts take and what the lines (pos, line) themselves do."""
    t = tree.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("edit_bytes"))
    return t.crossJoin(lines.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length(F.coalesce("line", F.lit("")))), F.lit(0)).alias("text_bytes"))).select("lines", "edit_bytes", "text_bytes")
