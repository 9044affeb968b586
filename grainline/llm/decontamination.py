"""Operator 2. Benchmark decontamination by template windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, written

#: Words of a window, and the share of an item's windows that a document must hold in line.
WINDOW, SHARE = 5, 0.5
#: Benchmark windows up to which they are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Marks of the private-use area for words that are names or numbers; texts' own are read as spaces.
NAME, NUMBER = "\uE000", "\uE001"
#: Units of measure and number words.
UNITS = (
    "%,€,$,£,mm,cm,m,km,mi,mile,miles,inch,inches,foot,feet,ft,yd,yards,mg,g,kg,gram,grams,kilogram,kilograms,lb,lbs,pound,pounds,oz,ounces,ml,l,liter,liters,litre,litres,"
    "meter,meters,metre,metres,kilometer,kilometers,second,seconds,sec,minute,minutes,min,hour,hours,day,days,week,weeks,month,months,year,years,dollar,dollars,cent,cents,euro,euros,"
    "mph,kph,kmh,degree,degrees,percent,volt,volts,watt,watts,joule,joules,byte,bytes,kb,mb,gb"
).split(",")
NUMBERS = "zero,one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve,thirteen,fourteen,fifteen,sixteen,seventeen,eighteen,nineteen,twenty,thirty,forty,fifty,sixty,seventy,eighty,ninety,hundred,thousand,million".split(",")


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def with_template(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """keep, with arrays _gl_t (template words) and _gl_s (a placeholder's own value, else null; null if there is none).

    Words are runs of letters, digits and signs of units, in lower case, points and the like only inside
    them. A number or number word becomes <num>; a unit after a number <unit>; a capitalised word <name>,
    unless a sentence starts with it or it is all in capitals. Two marks from the private-use area carry
    names and numbers through the split; a name's value keeps its mark.
    """
    t = F.coalesce(text, F.lit(""))
    for mark in (NAME, NUMBER):
        t = F.replace(t, F.lit(mark), F.lit(" "))
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{L}\p{N},;)]\s{1,3})(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", f"{NAME}$1")
    t = F.regexp_replace(t, r"(?=\p{N})(?<![\p{L}\p{N}])\p{N}+(?:[.,:/]\p{N}+)*", f" {NUMBER}$0 ")
    d = df.select(*keep, F.split(F.lower(t), r"[^\p{L}\p{N}\x{E000}\x{E001}%€$£.,:/]+").alias("_gl_w"))
    d = d.selectExpr(*keep, "filter(transform(_gl_w, w -> trim(BOTH '.,:/' FROM w)), w -> w <> '') AS _gl_w")
    number = f"(startswith({{0}}, '{NUMBER}') OR {{0}} IN ({_list(NUMBERS)}))"
    d = d.selectExpr(
        *keep,
        "_gl_w",
        f"transform(_gl_w, (w, i) -> CASE WHEN {number.format('w')} THEN '<num>' WHEN startswith(w, '{NAME}') THEN '<name>' WHEN w IN ({_list(UNITS)}) AND i > 0"
        f" AND {number.format('get(_gl_w, i - 1)')} THEN '<unit>' ELSE w END) AS _gl_t",
    )
    slots = f"zip_with(_gl_w, _gl_t, (w, t) -> if(t IN ('<num>', '<name>', '<unit>'), ltrim('{NUMBER}', w), null))"
    return d.selectExpr(*keep, "_gl_t", f"if(arrays_overlap(_gl_t, array('<num>', '<name>', '<unit>')), {slots}, null) AS _gl_s")


def windows(df: DataFrame, keep: list[str], sizes: list[int], short: bool = False) -> DataFrame:
    """keep, place, hash and slots of each window of so many template words, and with `short` of a shorter text as a whole.

    slots: the placeholders' values in order. A window of placeholders alone is known by their values.
    """
    d = df.selectExpr(*keep, "transform(_gl_t, t -> xxhash64(t)) AS _gl_h", "_gl_s", "size(_gl_t) AS _gl_n")

    def of(size: str, some: str) -> str:
        words, values = f"slice(_gl_h, i + 1, {size})", f"slice(_gl_s, i + 1, {size})"
        plain = f"struct(i AS place, xxhash64({words}) AS hash, CAST(array() AS array<string>) AS slots)"
        valued = f"struct(i AS place, if(exists({values}, s -> s IS NULL), xxhash64({words}), xxhash64('values', {values})) AS hash, array_compact({values}) AS slots)"
        at = f"if({some}, sequence(0, _gl_n - {size}), CAST(array() AS array<int>))"
        return f"if(_gl_s IS NULL, transform({at}, i -> {plain}), transform({at}, i -> {valued}))"

    found = [of(str(k), f"_gl_n >= {k}") for k in sizes] + ([of("_gl_n", f"_gl_n BETWEEN 1 AND {min(sizes) - 1}")] if short else [])
    d = d.selectExpr(*keep, f"inline({found[0] if len(found) == 1 else 'concat(' + ', '.join(found) + ')'})")
    return d.select(*keep, "place", "hash", "slots")


def _found(docs: DataFrame, benchmark: DataFrame, doc: str, text: str, item: str, item_text: str, size: int, share: float) -> DataFrame:
    """(doc_id, digest, item_id, share, start, n_windows) of matches(), a row for each text of an id."""
    b = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("_gl_x"))
    # names as placeholders, and the same words with names as they are, for copies that are in lower case
    both = [with_template(b, t, ["item_id"]).where("size(_gl_t) > 0") for t in (F.col("_gl_x"), F.lower("_gl_x"))]
    lengths = both[0].where(f"size(_gl_t) < {size}").select(F.size("_gl_t").alias("n")).distinct().collect()
    b = windows(both[0], ["item_id"], [size], True).unionByName(windows(both[1], ["item_id"], [size], True)).distinct()
    b = written(b, "benchmark-windows")
    counts = b.groupBy("item_id").agg(F.count_distinct("place").alias("of"))
    item_side = b.select("hash", "item_id", F.col("place").alias("at"), F.col("slots").alias("own"))
    n = b.count()
    row = ["doc_id", "digest"]
    d = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("digest"), F.col(text).cast("string").alias("_gl_x"))
    d = windows(with_template(d, F.col("_gl_x"), row), row, [size, *sorted(r["n"] for r in lengths)])
    if n <= BROADCAST_WINDOWS:
        item_side = F.broadcast(item_side)
    hits = written(d.join(item_side, "hash").where("size(slots) = size(own)").distinct(), "benchmark-hits")
    # lines: hits of a document and item whose places differ alike, up to a few words inserted or dropped
    key = [*row, "item_id", "line"]
    hits = hits.withColumn("off", F.col("place") - F.col("at")).withColumn("line", F.expr("CAST(floor(off / 8.0) AS BIGINT)"))
    lines = hits.unionByName(hits.withColumn("line", F.col("line") + 1)).repartition(*key)
    # a template that recurs within a line also meets itself shifted: each window keeps the hit nearest the line's main offset
    same = Window.partitionBy(*key, "off")
    lines = lines.withColumn("n", F.struct(F.count(F.lit(1)).over(same).alias("n"), F.sum((F.col("own") == F.col("slots")).cast("int")).over(same).alias("same"), (-F.col("off")).alias("off")))
    lines = lines.withColumn("far", F.col("off") + F.max("n").over(Window.partitionBy(*key))["off"]).drop("n")
    near = F.struct(F.abs("far").alias("d"), "far", "own")
    for one, other in (("place", "at"), ("at", "place")):
        kept = F.min_by(F.struct(other, "own", "slots", "off", "far"), near).alias("h")
        lines = lines.groupBy(*key, one).agg(kept).select(*key, one, "h.*")
    found = lines.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("own") == F.col("slots")).alias("n_same"),
        F.min("off").alias("start"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("own", "slots")))).alias("pairs"),
    )
    # a value of the item is one value of the document, and two names of the document are two of the item
    names = f"filter(pairs, p -> startswith(p.slots, '{NAME}'))"
    consistent = F.expr(f"size(array_distinct(transform(pairs, p -> p.own))) = size(pairs) AND size(array_distinct(transform({names}, p -> p.slots))) = size({names})")
    found = found.join(F.broadcast(counts) if n <= BROADCAST_WINDOWS else counts, "item_id")
    found = found.where((F.col("n_windows") >= F.lit(share) * F.col("of")) & (consistent | (F.col("n_same") >= F.lit(share) * F.col("of"))))
    best = found.groupBy(*row, "item_id").agg(F.max(F.struct(F.col("n_windows"), (F.col("n_windows") / F.col("of")).alias("share"), F.col("start"))).alias("best"))
    return best.select(*row, "item_id", "best.share", F.greatest("best.start", F.lit(0)).cast("bigint").alias("start"), "best.n_windows")


def matches(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, share: float = SHARE
) -> DataFrame:
    """(doc_id, item_id, share, start, n_windows): the items whose text or template a document holds.

    A document holds an item if at least `share` of the item's template windows stand in it in line, that
    is at the same distance from their places in the item give or take one word for each insertion or
    deletion, and the slots are consistent: over the line every value of the item has one value in the
    document, and no two names of the item have the same. Of a template that recurs within a line each
    window counts once, where it is nearest the line's main offset; windows with the item's own values
    need no such check if they alone make up the share. An item of fewer words than a window is one
    window of all its words; windows of placeholders alone meet only their own values.

    The benchmark's windows are broadcast if there are at most BROADCAST_WINDOWS of them, else both sides
    are shuffled by hash. All windows of all documents are joined; what is grouped are hits, per document
    and item. Null and empty texts have no window. Different texts of one id, or without an id, are
    judged each by itself; of one id the best match is given, without an id a match has a null doc_id.
    Equal texts of an id count as one; empty tables give an empty result; other columns are not read.
    """
    found = _found(docs, benchmark, doc, text, item, item_text, size, share)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "share", "start")).alias("best"))
    return best.select("doc_id", "item_id", "best.share", "best.start", "best.n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item of the benchmark, as matches() says; rows without an id are told apart by their text."""
    gone = written(_found(docs, benchmark, doc, text, "item_id", "text", WINDOW, SHARE).select(F.col("doc_id").alias("_gl_doc"), F.col("digest").alias("_gl_digest")).distinct(), "contaminated")
    same = F.col(doc).eqNullSafe(F.col("_gl_doc")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_gl_digest"))
    return docs.join(few(gone), same, "left_anti")


def op2_template_windows(spark, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item, over all documents and items."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
