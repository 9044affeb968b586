"""Lossless codecs of topology and timestamps, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols beside the digits 0 to 9 of an encoded adjacency.
FIELD, RECORD, END = 10, 11, 12
#: Fixed value: the divisor of the quotient and remainder split of first timestamps.
DIVISOR = 1557239724513000000


def digits(n: Column) -> Column:
    """Decimal digits of a non-negative integer, tinyints."""
    return F.transform(F.split(n.cast("string"), ""), lambda d: d.cast("tinyint"))


def from_digits(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda n, d: n * 10 + d)


def deltas(a: Column) -> Column:
    """Differences of neighbours, the first value kept."""
    return F.transform(a, lambda x, i: x - F.coalesce(F.get(a, i - 1), F.lit(0)))


def summed(df: DataFrame, keys: list[str], place: str, column: str) -> DataFrame:
    """df, a row per element, with column's running sum in order of place: undoes deltas() in linear time."""
    over = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.sum(column).over(over))


def runs(a: Column) -> Column:
    """Runs of equal neighbours: array<struct<n, value>>, found by where values change."""
    starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda s, k: F.struct((F.coalesce(F.get(starts, k + 1), F.size(a)) - s).cast("bigint").alias("n"), F.get(a, s).alias("value")))


def unrolled(r: Column) -> Column:
    return F.flatten(F.transform(r, lambda x: F.array_repeat(x["value"], x["n"].cast("int"))))


def golomb(n: str, m: int) -> tuple[Column, Column]:
    """Quotient and remainder of column n, less 1, by m, rounded down."""
    return F.expr(f"({n} - 1 - pmod({n} - 1, {m}L)) DIV {m}L"), F.expr(f"pmod({n} - 1, {m}L)")


def ungolomb(q: str, r: str, m: int) -> Column:
    return F.expr(f"{q} * {m}L + {r} + 1")


def to_binary(n: Column) -> Column:
    """A non-negative integer's binary digits as text."""
    return F.bin(n)


def from_binary(digits_: Column) -> Column:
    """The integer of binary digits as text."""
    return F.conv(digits_, 2, 10).cast("bigint")


def adjacency_symbols(adjacency: DataFrame) -> DataFrame:
    """(src, symbols): each source's record of the symbol stream, from (src, out array<struct<dst, eid>>).

    key, then run and value of every run of child deltas, then run and value of every run of edge ids,
    digit by digit, each number closed by FIELD and the record's last by RECORD.
    """
    field = F.array(F.lit(FIELD).cast("tinyint"))
    number = lambda n: F.concat(digits(n), field)
    d = adjacency.select("src", deltas(F.col("out.dst")).alias("dst"), F.col("out.eid").alias("eid"))
    d = d.select("src", runs(F.col("dst")).alias("dst"), runs(F.col("eid")).alias("eid"))
    body = F.flatten(F.transform(F.concat("dst", "eid"), lambda x: F.concat(number(x["n"]), number(x["value"]))))
    d = d.select("src", F.concat(number(F.col("src")), body).alias("s"))
    return d.select("src", F.concat(F.slice("s", 1, F.size("s") - 1), F.array(F.lit(RECORD).cast("tinyint"))).alias("symbols"))


def symbols_adjacency(records: DataFrame) -> DataFrame:
    """(src, dst, eid) of every edge, from (symbols): the inverse of adjacency_symbols()."""
    text = F.array_join(F.transform("symbols", lambda s: F.when(s < FIELD, s.cast("string")).otherwise(F.lit(","))), "")
    d = records.select(F.transform(F.split(F.rtrim(text, F.lit(",")), ","), lambda x: x.cast("bigint")).alias("n"))
    pairs = F.expr("transform(sequence(1, size(n) - 2, 2), i -> struct(n[i] AS n, n[i + 1] AS value))")
    d = d.select(F.expr("n[0]").alias("src"), pairs.alias("r"))
    d = d.select("src", unrolled(F.col("r")).alias("v")).select("src", "v", F.expr("size(v) DIV 2").alias("half"))
    d = d.select("src", F.expr("slice(v, 1, CAST(half AS INT))").alias("dst"), F.expr("slice(v, CAST(half AS INT) + 1, CAST(half AS INT))").alias("eid"))
    d = d.select("src", F.posexplode(F.arrays_zip("dst", "eid")).alias("k", "e")).select("src", "k", "e.dst", "e.eid")
    return summed(d, ["src"], "k", "dst").select("src", "dst", "eid")


def packed_groups(edges: DataFrame, m: int = DIVISOR) -> DataFrame:
    """(dst, op, q0, r0, src, deltas, eids): edges (eid, src, dst, op, ts) grouped by end and operation.

    Rows stay in eid order; the first timestamp is split by m and the others are differences.
    """
    g = edges.groupBy("dst", "op").agg(F.array_sort(F.collect_list(F.struct("eid", "src", "ts"))).alias("r"))
    q, r = golomb("r[0].ts", m)
    return g.select(
        "dst", "op", q.alias("q0"), r.alias("r0"),
        F.col("r.src").alias("src"),
        F.slice(deltas(F.col("r.ts")), 2, F.size("r")).alias("deltas"),
        F.col("r.eid").alias("eids"),
    )


def unpacked_groups(groups: DataFrame, m: int = DIVISOR) -> DataFrame:
    """(eid, src, dst, op, ts) of every packed edge."""
    d = groups.select("dst", "op", "src", F.col("eids").alias("eid"), F.concat(F.array(ungolomb("q0", "r0", m)), "deltas").alias("ts"))
    d = d.select("dst", "op", F.posexplode(F.arrays_zip("src", "eid", "ts")).alias("k", "e")).select("dst", "op", "k", "e.src", "e.eid", "e.ts")
    return summed(d, ["dst", "op"], "k", "ts").select("eid", "src", "dst", "op", "ts")
