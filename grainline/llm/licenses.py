"""Operator 5. Licence scans over a positional index of rare licence words, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: What separates words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Per label, notices as they stand in files, their mandatory key phrases in brackets.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license",
        "licensed under the [apache license] version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "mit": (
        "released under the [mit license]",
        "licensed under the [mit license]",
        "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "isc": ("[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd": (
        "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met",
        "[neither the name of] the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu [general public license version 3]",
        "it under the terms of the gnu general public license as published by the [free software foundation either version 3] of the license or at your option any later version",
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu [general public license version 2]",
        "it under the terms of the gnu general public license as published by the [free software foundation either version 2] of the license or at your option any later version",
    ),
    "lgpl": ("under the terms of the gnu [lesser general public license] as published by the free software foundation",),
    "agpl": ("under the terms of the gnu [affero general public license] as published by the free software foundation",),
    "mpl-2.0": ("this source code form is subject to the terms of the [mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",),
    "cc-by-nc": ("licensed under [cc by nc] 4 0", "this work is licensed under a [creative commons attribution noncommercial] 4 0 international license"),
    "cc-by-sa": ("licensed under [cc by sa] 4 0", "this work is licensed under a [creative commons attribution sharealike] 4 0 international license"),
    "cc-by-nd": ("licensed under [cc by nd] 4 0", "this work is licensed under a [creative commons attribution noderivatives] 4 0 international license"),
    "cc0": ("[cc0 1 0 universal] public domain dedication", "dedicated to the public domain under [creative commons zero]"),
    "unlicense": ("[this is free and unencumbered software] released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",),
}
#: Places of each template that the index holds: those of the rarest words, two at least of them in the key phrase.
POSTINGS = 5


class Index:
    """Postings of the rarest words of each template: word -> (template, place), with each word's IDF over all templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, base: dict[str, str] = BASE):
        rows = [(label, t, False) for label, ts in templates.items() for t in ts] + [(label, f"[{p}]", True) for p, label in base.items()]
        self.templates = []
        for label, text, is_base in rows:
            before, phrase, _ = re.split(r"[\[\]]", text)
            start = len(before.split())
            self.templates.append((label, re.sub(r"[\[\]]", " ", text).split(), start, phrase.split(), is_base))
        n = len(self.templates)
        df: dict[str, int] = {}
        for _, ws, *_ in self.templates:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for k, (_, ws, start, phrase, _) in enumerate(self.templates):
            # the longest of equally rare words first: short ones are common in other texts
            rare = lambda j: (-self.idf[ws[j]], -len(ws[j]), j)  # noqa: E731, B023
            inner = sorted(range(start, start + len(phrase)), key=rare)[:2]
            for j in [*inner, *sorted(set(range(len(ws))) - set(inner), key=rare)[: POSTINGS - 2 if len(ws) > len(phrase) else 0]]:
                self.postings.setdefault(ws[j], []).append((k, j))


def _strings(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def scanned(df: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """df with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double), matches.

    matches: array of (label, start, end, coverage), one per place of a template's key phrase: words of
    the whole match, from 0, end excluded, and the IDF share of the template's words that stand where the
    key phrase says they must. base counts cover the base phrases alone; labels adds the templates'.
    score is the best coverage, 1 for a whole notice, at least 1/2 where a base phrase stands, and 0
    without any match.

    Every row is done by itself. Its rare licence words, found among all words of the whole text, look up
    their postings; a posting and a place give where its template would start. Postings of a template are
    intersected by that start: two at least of its rare words must agree on it. Only there the key phrase
    is compared, as a whole. Common words have no postings. Null and empty texts have no words; repeated
    rows are done alike; an empty table gives an empty one; input columns of these names are replaced.
    """
    index = index or Index()
    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    keep = [f"`{c}`" for c in df.columns if c not in out]
    d = df.select(*[F.col(c) for c in keep], F.split(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), BREAK).alias("_gl_w"))
    d = d.selectExpr(*keep, "filter(_gl_w, w -> w <> '') AS _gl_w")
    d = d.selectExpr(*keep, "_gl_w", f"filter(transform(_gl_w, (w, i) -> if(w IN ({_strings(index.postings)}), i, -1)), i -> i >= 0) AS _gl_at")

    # constants that the planner folds: each rare word's postings, and each template's phrase and words with their IDF
    # a posting is one number, template * 2**40 + 2**39 - place, so that adding a word's place gives template and start
    postings = ", ".join(f"'{w}', array({', '.join(f'{(k << 40) + (1 << 39) - place}L' for k, place in found)})" for w, found in index.postings.items())
    templates = ", ".join(
        f"named_struct('label', '{label}', 'base', {str(is_base).lower()}, 'at', {start}, 'phrase', array({_strings(phrase)}), 'sum', {sum(index.idf[w] for w in ws)!r}D,"
        f" 'words', array({', '.join(f"named_struct('w', '{w}', 'idf', {index.idf[w]!r}D)" for w in ws)}))"
        for label, ws, start, phrase, is_base in index.templates
    )
    d = d.selectExpr(*keep, "_gl_w", f"sort_array(flatten(transform(_gl_at, p -> transform(element_at(map({postings}), get(_gl_w, p)), x -> x + p)))) AS _gl_x")
    # the intersection: starts on which two of a template's rare words agree, once each
    d = d.selectExpr(*keep, "_gl_w", "filter(_gl_x, (x, i) -> x <=> get(_gl_x, i + 1) AND NOT x <=> get(_gl_x, i - 1)) AS _gl_x")
    d = d.selectExpr(
        *keep,
        "_gl_w",
        f"""filter(transform(_gl_x, x -> struct(get(array({templates}), CAST(shiftright(x, 40) AS INT)) AS t, CAST((x & {(1 << 40) - 1}L) - {1 << 39}L AS INT) AS zero)),
            x -> x.zero + x.t.at >= 0 AND slice(_gl_w, greatest(x.zero + x.t.at, 0) + 1, size(x.t.phrase)) = x.t.phrase) AS _gl_hits""",
    )
    d = d.selectExpr(
        *keep,
        "CAST(size(_gl_w) AS BIGINT) AS n_words",
        "transform(filter(_gl_hits, h -> h.t.base), h -> struct(h.t.label AS label, h.zero AS start)) AS _gl_base",
        """transform(filter(_gl_hits, h -> NOT h.t.base), h -> named_struct('label', h.t.label, 'start', CAST(h.zero + h.t.at AS BIGINT), 'end', CAST(h.zero + h.t.at + size(h.t.phrase) AS BIGINT),
            'coverage', aggregate(transform(h.t.words, (t, j) -> if(h.zero + j >= 0 AND get(_gl_w, h.zero + j) <=> t.w, t.idf, 0D)), 0D, (a, x) -> a + x, a -> least(1D, a / h.t.sum)))) AS _gl_own""",
    )
    d = d.selectExpr(
        *keep,
        "n_words",
        "CAST(size(_gl_base) AS BIGINT) AS n_base",
        "CAST(array_min(_gl_base.start) AS BIGINT) AS first_word",
        "CAST(array_max(_gl_base.start) AS BIGINT) AS last_word",
        "array_join(array_sort(array_distinct(_gl_base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(_gl_base.label, _gl_own.label))), ',') AS labels",
        "coalesce(greatest(array_max(_gl_own.coverage), if(size(_gl_base) > 0, 0.5D, 0D)), 0D) AS score",
        "_gl_own AS matches",
    )
    # a generator, so that the planner doesn't copy these expressions into every filter on a result
    return d.selectExpr(*keep, f"inline(array(struct({', '.join(out)})))")


def op5_rare_word_index(spark, sf_dir: str) -> DataFrame:
    """Base places, labels and score of all documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
