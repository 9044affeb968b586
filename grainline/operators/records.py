"""Records as character tokens: windows, a next-token model, corrections, and regeneration of the records asked for."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators import templates
from grainline.operators.predictors import CONTEXT, Model, model_of, model_table
from grainline.operators.templates import FIELD_END, FIRST, RECORD_END
from grainline.runtime import materialized, numbered
from grainline.sources.tables import archive, unarchive

#: What a record's id field starts with, by kind.
PREFIX = {"v": "verteid:", "e": "eventid:"}
#: Distinct characters that a token dictionary may have; it travels with tasks.
MOST_CHARACTERS = 65_536


def characters(texts: DataFrame, column: str) -> DataFrame:
    """(char, code): the distinct characters of a column, codes from FIRST by character."""
    chars = texts.select(F.explode(F.split(F.col(column), "")).alias("char")).where("char <> ''").distinct()
    return numbered(chars, ["char"], "code", start=FIRST).select("char", "code")


def code_map(chars: DataFrame) -> dict[str, int]:
    rows = chars.limit(MOST_CHARACTERS + 1).collect()
    if len(rows) > MOST_CHARACTERS:
        raise ValueError(f"over {MOST_CHARACTERS} distinct characters")
    return {r["char"]: r["code"] for r in rows}


def tokens(text: Column, codes: dict[str, int]) -> Column:
    """A text's characters as codes; null gives none."""
    known = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(k).cast("int")) for c, k in sorted(codes.items())))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: known[c])


def prefix(kind: Column, key: Column) -> Column:
    """What a record's id field says: the kind's prefix and the id."""
    c = F.lit(None).cast("string")
    for k, text in PREFIX.items():
        c = F.when(kind == k, F.concat(F.lit(text), key.cast("string"))).otherwise(c)
    return c


def record_tokens(rows: DataFrame, fields: str, codes: dict[str, int]) -> DataFrame:
    """rows (kind, id, ...) with `tokens`: the id field, then each field of an array of texts, each closed by FIELD_END, the record by RECORD_END."""
    close = F.array(F.lit(FIELD_END))
    body = F.flatten(F.transform(F.concat(F.array(prefix(F.col("kind"), F.col("id"))), F.col(fields)), lambda f: F.concat(tokens(f, codes), close)))
    return rows.withColumn("tokens", F.concat(body, F.array(F.lit(RECORD_END))))


def id_length(stream: Column) -> Column:
    """Tokens of the id field, its end included."""
    return F.array_position(stream, FIELD_END).cast("int")


def record_windows(records: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(kind, id, step, c1..cK, y): each token after the id field, from step 0, with the ones before it; 0 where there are none."""
    d = records.select("kind", "id", "tokens", id_length(F.col("tokens")).alias("n"))
    d = d.select("kind", "id", F.concat(F.array_repeat(F.lit(0), context), "tokens").alias("t"), "n", F.explode(F.sequence(F.col("n"), F.size("tokens") - 1)).alias("at"))
    return d.select("kind", "id", (F.col("at") - F.col("n")).alias("step"), *[F.get("t", F.col("at") + i).alias(f"c{i + 1}") for i in range(context)], F.get("t", F.col("at") + context).alias("y"))


def training_windows(windows: DataFrame, batch_rows: int, seed: int = 42) -> DataFrame:
    """windows (kind, id, step, ...) with `batch`: seeded shuffled, batch_rows a batch, without the batch that isn't full."""
    order = [F.xxhash64(F.lit(seed), "kind", "id", "step"), F.col("kind"), F.col("id"), F.col("step")]
    d = numbered(windows, order, "_place")
    n = d.count()
    return d.where(F.col("_place") < n // batch_rows * batch_rows).withColumn("batch", F.expr(f"_place DIV {batch_rows}")).drop("_place")


def token_model(windows: DataFrame, alphabet: int, context: int = CONTEXT) -> Model:
    """The commonest next token after the last two, with back-off to one and none; ties to the smallest.

    What comes to the driver is one row per pair of tokens seen, at most the square of the alphabet.
    """
    two = F.col(f"c{context - 1}") * alphabet + F.col(f"c{context}")
    n = windows.groupBy(two.cast("bigint").alias("at"), F.col("y").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    arrays = {"base": np.array([alphabet], np.int64)}
    for j, at in ((2, F.col("at")), (1, F.col("at") % alphabet), (0, F.lit(0))):
        best = n.groupBy(at.alias("at"), "y").agg(F.sum("n").alias("n")).groupBy("at").agg(F.max(F.struct("n", (-F.col("y")).alias("y")))["y"].alias("y"))
        table = np.full(alphabet**j, -1, np.int32)
        for r in best.collect():
            table[r["at"]] = -r["y"]
        arrays[str(j)] = table
    return Model("order_k", arrays)


def corrections(windows: DataFrame, model: Model, context: int = CONTEXT) -> DataFrame:
    """(kind, id, steps, tokens) of each record that the model gets wrong somewhere: where, and what is right."""

    def run(batches):
        for rows in batches:
            wrong = model(rows[[f"c{i + 1}" for i in range(context)]].to_numpy(np.int64)) != rows["y"].to_numpy()
            yield rows.loc[wrong, ["kind", "id", "step", "y"]]

    d = windows.mapInPandas(run, "kind string, id string, step int, y int")
    d = d.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("step", "y"))).alias("x"))
    return d.select("kind", "id", F.col("x.step").alias("steps"), F.col("x.y").alias("tokens"))


def regenerated(wanted: DataFrame, table: DataFrame, model: Model, codes: dict[str, int], most: int = 1 << 20, context: int = CONTEXT) -> DataFrame:
    """(kind, id, tokens) of the records asked for (kind, id), from their corrections alone. Batches of records advance in step.

    A record ends with RECORD_END; one of `most` tokens without it raises an error.
    """
    d = wanted.select("kind", F.col("id").cast("string").alias("id")).distinct().join(table, ["kind", "id"], "left")
    d = d.withColumn("start", F.concat(tokens(prefix(F.col("kind"), F.col("id")), codes), F.array(F.lit(FIELD_END))))

    def run(batches):
        for rows in batches:
            streams = [list(x) for x in rows["start"]]
            right = [{} if s is None else dict(zip(list(s), list(t), strict=True)) for s, t in zip(rows["steps"], rows["tokens"], strict=True)]
            left, step = list(range(len(rows))), 0
            while left:
                if step > most:
                    raise ValueError("a record has no end")
                x = np.array([([0] * context + streams[i])[-context:] for i in left], np.int64)
                for i, guess in zip(left, model(x).tolist(), strict=True):
                    streams[i].append(int(right[i].get(step, guess)))
                left, step = [i for i in left if streams[i][-1] != RECORD_END], step + 1
            yield pd.DataFrame({"kind": rows["kind"], "id": rows["id"], "tokens": streams})

    return d.mapInPandas(run, "kind string, id string, tokens array<int>")


def fields_of(stream: Column, codes: dict[str, int]) -> Column:
    """The texts of a record's fields after its id: tokens between FIELD_ENDs, as characters again."""
    known = F.create_map(*itertools.chain.from_iterable((F.lit(k).cast("int"), F.lit(c)) for c, k in sorted(codes.items())))
    body = F.slice(stream, id_length(stream) + 1, F.size(stream) - id_length(stream) - 1)
    ends = F.filter(F.transform(body, lambda t, i: F.when(t == FIELD_END, i)), lambda i: i.isNotNull())
    first = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
    return F.transform(ends, lambda e, k: F.array_join(F.transform(F.slice(body, first(k) + 1, e - first(k)), lambda t: known[t]), ""))


def store(rows: DataFrame, columns: list[str], path: str) -> None:
    """Archives records (kind, id, columns...): templates, value dictionary, characters, model, and what the model gets wrong.

    A record's fields are its template's number and its values' codes, as digits.
    """
    d = rows.select("kind", F.col("id").cast("string").alias("id"), *columns)
    words, keys = materialized(templates.value_dictionary(d, columns), "values"), materialized(templates.key_templates(d, columns), "templates")
    coded = templates.coded(d.withColumn("key", F.concat_ws(":", "kind", "id")), "key", columns, words).join(keys.select("template", "template_id"), "template")
    coded = coded.select(F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, instr(key, ':') + 1)").alias("id"), F.transform(F.concat(F.array("template_id"), "codes"), lambda c: c.cast("string")).alias("fields"))
    coded = materialized(coded, "fields")
    chars = materialized(characters(coded.select(F.concat(prefix(F.col("kind"), F.col("id")), F.array_join("fields", "")).alias("t")), "t"), "characters")
    codes = code_map(chars)
    windows = materialized(record_windows(record_tokens(coded, "fields", codes)), "windows")
    model = token_model(windows, max([*codes.values(), FIRST]) + 1)
    about = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "place int, name string").coalesce(1)
    archive({"values": words, "templates": keys, "characters": chars, "model": model_table(rows.sparkSession, model), "columns": about, "corrections": corrections(windows, model)}, path)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(kind, id, columns...) as text of the records asked for (kind, id), from an archive of store()."""
    t = unarchive(spark, path)
    codes, columns = code_map(t["characters"]), [r["name"] for r in t["columns"].orderBy("place").collect()]
    d = regenerated(wanted, t["corrections"], model_of(t["model"]), codes).withColumn("f", fields_of(F.col("tokens"), codes))
    d = d.select(F.concat_ws(":", "kind", "id").alias("key"), F.get("f", 0).cast("bigint").alias("template_id"), F.transform(F.slice("f", 2, F.size("f")), lambda x: x.cast("bigint")).alias("codes"))
    d = templates.decoded(d.join(t["templates"].select("template", "template_id"), "template_id"), "key", columns, t["values"])
    return d.select(F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, instr(key, ':') + 1)").alias("id"), *columns)


def keyed_json(table: DataFrame) -> DataFrame:
    """(key, json) of corrections, `kind:id` and [steps, tokens], in order of key."""
    d = table.select(F.concat_ws(":", "kind", "id").alias("key"), F.to_json(F.array(F.transform("steps", lambda x: x.cast("int")), F.col("tokens"))).alias("json"))
    return d.orderBy("key")
