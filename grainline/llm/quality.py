"""Operator 3. Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, remove, words, written_path

#: Rows, about, of the sample on which cost and selectivity are estimated. They order the rules and decide no row.
SAMPLE_ROWS = 2000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A row fails where `fails`, SQL over the columns of measured(), is true; null counts as false."""

    name: str
    fails: str


#: Rules that always hold, and the count that costs far more than all others.
BASE_RULES = (Rule("few_words", "n_words < 50"), Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"))
DEAR = "n_repeat_words"
#: Limits of common web-text filters.
RULES = (
    Rule("symbols", "n_symbols > 0.1D * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > size(split(trim(_gl_text), '\\n+'))"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
    Rule("exclamations", "2 * (length(_gl_text) - length(replace(_gl_text, '!', ''))) > n_words"),
    Rule("shouting", "length(regexp_replace(_gl_text, '\\\\P{Lu}+', '')) > 0.3D * word_chars"),
    Rule("no_letters", "length(regexp_replace(_gl_text, '\\\\P{L}+', '')) < 0.4D * word_chars"),
)


def measured(df: DataFrame, text: str = "text", only: Column | None = None) -> DataFrame:
    """df with the five base counts (long) and the text as _gl_text, null read as empty.

    With only, a condition on the other counts and the text, rows that don't meet it are left out before
    n_repeat_words is counted.

    Repeated three-word windows are found by sorting: each window's 64-bit hash, its low bits replaced
    by the window's place, so that one sort of longs brings equal windows together. Neighbours are then
    compared by their whole hashes. Time is n log n in a text's words, whatever it repeats. Columns of
    df with these names are replaced.
    """
    gone = {*BASE, "_gl_text"}
    keep = [f"`{c}`" for c in df.columns if c not in gone]
    d = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_gl_text")) if text not in gone else df.select(*keep, F.lit("").alias("_gl_text"))
    d = d.withColumn("_gl_w", words(F.col("_gl_text")))
    keep.append("_gl_text")
    d = d.selectExpr(
        *keep,
        "CAST(size(_gl_w) AS BIGINT) AS n_words",
        r"CAST(length(translate(_gl_text, ' \t\n\u000b\f\r', '')) AS BIGINT) AS word_chars".replace(r"\f", r"\u000c"),
        "CAST(length(_gl_text) - length(translate(_gl_text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols",
        f"filter(split(_gl_text, '\\n'), l -> l rlike r'{WORD}') AS _gl_l",
        "transform(_gl_w, w -> xxhash64(w)) AS _gl_h",
    )
    keep += BASE[:3]
    lines = "CAST(size(_gl_l) - size(array_distinct(_gl_l)) AS BIGINT) AS n_dup_lines"
    if only is not None:
        # a generator, so that the planner doesn't copy the counts into the filter
        d = d.selectExpr(*keep, lines, "_gl_h")
        d = d.selectExpr(*[c for c in keep if c not in BASE], f"inline(array(struct({', '.join(BASE[:4])}, _gl_h)))").where(only)
        lines = "n_dup_lines"
    d = d.selectExpr(
        *keep,
        lines,
        "transform(slice(_gl_h, 1, CAST(greatest(n_words - 2, 0) AS INT)), (h, i) -> xxhash64(h, get(_gl_h, i + 1), get(_gl_h, i + 2))) AS _gl_t",
        "shiftleft(1L, CAST(ceil(log2(greatest(n_words, 2))) AS INT)) - 1 AS _gl_m",
    )
    keep.append("n_dup_lines")
    d = d.selectExpr(*keep, "_gl_t", "_gl_m", "sort_array(transform(_gl_t, (t, i) -> (t & ~_gl_m) | i)) AS _gl_s")
    same = "coalesce((s & ~_gl_m) = (get(_gl_s, k {0} 1) & ~_gl_m) AND get(_gl_t, CAST(s & _gl_m AS INT)) = get(_gl_t, CAST(get(_gl_s, k {0} 1) & _gl_m AS INT)), false)"
    d = d.selectExpr(*keep, f"sort_array(transform(filter(_gl_s, (s, k) -> {same.format('-')} OR {same.format('+')}), s -> s & _gl_m)) AS _gl_p")
    d = d.selectExpr(*keep, "aggregate(transform(_gl_p, (p, k) -> if(k = 0, 3L, least(3L, p - get(_gl_p, k - 1)))), 0L, (a, x) -> a + x) AS n_repeat_words")
    # a generator, so that the planner doesn't copy these expressions into every filter on a count
    return d.selectExpr(*[c for c in keep if c not in BASE], f"inline(array(struct({', '.join(BASE)})))")


def ordered(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, dear: bool = False) -> list[Rule]:
    """The rules by rejections per second, each counted on what the rules before it leave.

    Rows are sampled from all partitions, some sample_rows of them, before they are measured. Cost is the
    time of a rule alone over the sample, less that of reading it; with dear, a rule on the dear count also
    bears the time of counting. Selectivity comes from one count by which rules fail. The order changes the
    cost of cascade(), never its result.
    """
    n = df.count()
    spark = df.sparkSession
    sample = df.select(text).sample(min(1.0, sample_rows / max(n, 1)), seed=42).repartition(4)
    path = written_path(sample, "quality-sample")
    texts = spark.read.schema(sample.schema).parquet(path)
    measures = measured(texts, text)
    counting = 0.0
    if dear:
        for some in (True, False, True):  # the first one compiles
            t = time.perf_counter()
            measured(texts, text, (F.col("n_words") >= 0) == some).agg(*[F.sum(c) for c in BASE]).first()
            counting = time.perf_counter() - t - (counting if some else 0.0)
    measured_path = written_path(measures, "quality-sample")
    remove(spark, path)
    path, sample = measured_path, spark.read.schema(measures.schema).parquet(measured_path)
    fails = [F.coalesce(F.expr(r.fails), F.lit(False)) for r in rules]

    def seconds(c: Column) -> float:
        took = []
        for _ in range(2):
            t = time.perf_counter()
            sample.agg(F.sum(F.length("_gl_text")), F.sum(c.cast("int"))).first()
            took.append(time.perf_counter() - t)
        return min(took)

    floor = seconds(F.lit(False))
    cost = [max(1e-3, seconds(c) - floor) + (max(0.0, counting) if DEAR in r.fails else 0.0) for c, r in zip(fails, rules, strict=True)]
    patterns = sample.groupBy(*[c.alias(f"r{i}") for i, c in enumerate(fails)]).count().collect()
    remove(spark, path)
    left, out = list(range(len(rules))), []
    while left:
        rejected = {i: sum(p["count"] for p in patterns if p[f"r{i}"]) for i in left}
        best = max(left, key=lambda i: (rejected[i] / cost[i], -cost[i], -i))
        out.append(rules[best])
        left.remove(best)
        patterns = [p for p in patterns if not p[f"r{best}"]]
    return out


def cascade(df: DataFrame, rules: list[Rule]) -> Column:
    """The name of the first rule that a row of measured() fails, or null. Later rules aren't evaluated."""
    c = None
    for r in rules:
        c = (F.when if c is None else c.when)(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(r.name))
    return F.lit(None).cast("string") if c is None else c.otherwise(F.lit(None).cast("string"))


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the base counts, base_failed, failed_rule (string, null if none) and kept (booleans).

    Null and empty texts have no words and fail the base. Repeated rows are judged alike; an empty
    table gives an empty one. Columns of df with these names are replaced.
    """
    d = measured(df.drop("base_failed", "failed_rule", "kept"), text)
    order = ordered(df, text, rules)
    d = d.withColumn("base_failed", F.expr(" OR ".join(f"({r.fails})" for r in BASE_RULES)))
    d = d.withColumn("failed_rule", F.when(~F.col("base_failed"), cascade(d, order)))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("_gl_text")


def accepted(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass the base rules and rules: those that judged() keeps, with df's columns as they are.

    All rules are one cascade, the dear count with them: it is made only for rows that pass every rule
    put before it. Null and empty texts go; repeated rows go or stay alike; an empty table gives an empty
    one; columns may have any names.
    """
    d = df.toDF(*[f"_gl_c{i}" for i in range(len(df.columns))])
    own = d.columns[df.columns.index(text)]
    order = ordered(d, own, (*BASE_RULES, *rules), dear=True)
    at = next(i for i, r in enumerate(order) if DEAR in r.fails)
    d = measured(d, own, cascade(d, order[:at]).isNull())
    return d.where(cascade(d, order[at:]).isNull()).select(*[F.col(f"_gl_c{i}").alias(c) for i, c in enumerate(df.columns)])


def op3_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(d).select("doc_id", *BASE, "base_failed", "kept")

#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
),
b AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    n_symbols > 0.1 * n_words OR 2 * n_dup_lines > len(regexp_split_to_array(trim(t, ' '), '\n+')) OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words OR length(regexp_replace(t, '\P{Lu}+', '', 'g')) > 0.3 * word_chars OR length(regexp_replace(t, '\P{L}+', '', 'g')) < 0.4 * word_chars
  ) AS kept
FROM b
"""
