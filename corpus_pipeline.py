"""Quality rules, near-duplicate removal, decontamination and packing over documents, stage after stage.

Each stage works on what the one before it kept, as written to Parquet and read again.
"""

from __future__ import annotations

from grainline.llm import decontamination, packing, quality, simhash
from grainline.llm.common import written


def quality_rules(spark, docs, sf_dir):
    """Drops the documents that the quality rules reject, null and empty texts with them."""
    return quality.accepted(docs)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document, that of the smallest doc_id, of each class of near duplicates: five-word shingles, similarity 0.8."""
    return simhash.deduplicated(docs).select(*docs.columns)


def decontaminate(spark, docs, sf_dir):
    """Drops the documents whose text holds an item of the benchmark.

    Rows are told apart by id and text, so one without an id goes only if its own text is found. Null and
    empty texts stay; repeated rows stay or go alike; an empty table gives an empty one.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Packs all that is left into sequences of at most 2048 tokens; one row per piece.

    Null and empty texts are one token, repeated rows and rows without an id are packed each, and an
    empty table gives an empty one; other columns are not read.
    """
    return packing.packing_table(docs, little=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: Fingerprint classes, template windows and the packing are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
