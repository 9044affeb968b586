"""Records as key templates and dictionary codes, token streams, and their corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.runtime import numbered

#: Tokens that close a field and a record; dictionary symbols start at FIRST.
FIELD_END, RECORD_END, FIRST = 0, 1, 2


def template(columns: list[str]) -> Column:
    """The names of a row's non-null columns, comma-joined in the given order."""
    return F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])


def key_templates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(template, n, template_id): distinct templates, ids from 0 by their text."""
    d = df.groupBy(template(columns).alias("template")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(d, ["template"], "template_id")


def value_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, code): each column's distinct non-null values as text, codes from 0 by value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns]))
    d = df.select(pairs.alias("p")).select("p.col", "p.value").where("value IS NOT NULL").distinct()
    # codes by ranges over the whole dictionary, then from each column's first: no task gets a whole column
    d = numbered(d, ["col", "value"], "at")
    first = d.groupBy("col").agg(F.min("at").alias("first"))
    return d.join(F.broadcast(first), "col").select("col", "value", (F.col("at") - F.col("first")).alias("code"))


def column_minima(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, least) of numeric columns, as double."""
    d = df.agg(*[F.min(c).cast("double").alias(c) for c in columns])
    return d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("least")) for c in columns])).alias("p")).select("p.col", "p.least")


def split_number(c: Column) -> tuple[Column, Column]:
    """Whole and fractional digits of a number's text; an empty fraction where there is none."""
    parts = F.split(c.cast("string"), r"\.")
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def part_minima(df: DataFrame, column: str) -> DataFrame:
    """(part, least): the least whole and the least fractional digits of a column's numbers, compared as text, as integers."""
    whole, fraction = split_number(F.col(column))
    d = df.agg(F.min(whole).alias("whole"), F.min(fraction).alias("fraction"))
    return d.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("bigint").alias("least")) for p in ("whole", "fraction")])).alias("p")).select("p.part", "p.least")


def renamed_key(template_: Column, old: str, new: str) -> Column:
    """A template with one key renamed; other keys that hold its name stay."""
    return F.array_join(F.transform(F.split(template_, ","), lambda k: F.when(k == old, F.lit(new)).otherwise(k)), ",")


def whole_number(c: Column) -> Column:
    """A double's text, without .0 where it is whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def coded(df: DataFrame, key: str, columns: list[str], dictionary: DataFrame) -> DataFrame:
    """(key, template, codes): each row's template and, in its order, its values' codes."""
    d = df.select(key, template(columns).alias("template"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("k", "p"))
    d = d.select(key, "template", "k", "p.col", "p.value").join(dictionary, ["col", "value"], "left")
    d = d.groupBy(key, "template").agg(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("k", "code")))).alias("c"))
    return d.select(key, "template", F.col("c.code").alias("codes"))


def decoded(rows: DataFrame, key: str, columns: list[str], dictionary: DataFrame) -> DataFrame:
    """The rows of coded() as text columns again."""
    d = rows.select(key, F.explode_outer(F.arrays_zip(F.split("template", ",").alias("col"), F.col("codes").alias("code"))).alias("p"))
    d = d.select(key, "p.col", "p.code").join(dictionary, ["col", "code"], "left")
    return d.groupBy(key).agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in columns])


def tokens(codes: Column) -> Column:
    """A record's codes as tokens: each shifted by FIRST and closed by FIELD_END, the record by RECORD_END."""
    body = F.flatten(F.transform(codes, lambda c: F.array(c + FIRST, F.lit(FIELD_END).cast("bigint"))))
    return F.concat(body, F.array(F.lit(RECORD_END).cast("bigint")))


def fields(stream: Column) -> Column:
    """Codes of a record's tokens: what stands before each FIELD_END."""
    return F.transform(F.filter(stream, lambda t: t >= FIRST), lambda t: t - FIRST)


def tail(stream: Column, n: int = 10) -> Column:
    """The last n tokens, or all of a shorter stream."""
    return F.slice(stream, F.greatest(F.size(stream) - n, F.lit(0)) + 1, F.lit(n))


def corrected(predicted: DataFrame, table: DataFrame) -> DataFrame:
    """predicted (kind, id, step, token) with the table's (kind, id, step, token) where it has one."""
    t = table.select("kind", "id", "step", F.col("token").alias("_true"))
    return predicted.join(t, ["kind", "id", "step"], "left").select("kind", "id", "step", F.coalesce("_true", "token").alias("token"))


def correction_table(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """(kind, id, step, token) wherever a prediction is missing or wrong."""
    p = predicted.select("kind", "id", "step", F.col("token").alias("_p"))
    return true.join(p, ["kind", "id", "step"], "left").where("NOT token <=> _p").select("kind", "id", "step", "token")


def steps(df: DataFrame, kind: str, key: str, stream: str) -> DataFrame:
    """(kind, id, step, token) of every token of every record."""
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.posexplode(stream).alias("step", "token"))


def previous_step(true: DataFrame) -> DataFrame:
    """The commonest token at each step of each kind, ties to the smallest: a predictor that a record's place alone drives."""
    n = true.groupBy("kind", "step", "token").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("kind", "step").agg(F.max(F.struct(F.col("n"), (-F.col("token")).alias("t"))).alias("b"))
    return best.select("kind", "step", (-F.col("b.t")).alias("token"))
