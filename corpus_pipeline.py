"""Corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``. Between
stages rows are written as Parquet in the shared folder and read again.

Defined results: null texts count as empty; where ids are null or repeat, rows are
told apart by their place in the table, so of repeated rows one stays; empty tables
pass through; extra columns of any name are carried to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from lumenframe.llm.common import bitmap_bits, discard, fresh_name, materialize, read_table

#: Near copies share 80 % of their shingles or more (the contract of op4 is its own, 85). With 28 bands of 4 minima a
#: pair at exactly 0.80 shares no band once in 2.6 million; with op4's 24 of 5 it would be once in 14,000.
NEAR_THRESHOLD, NEAR_BANDS, NEAR_ROWS = 80, 28, 4


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, name of a column that tells every row apart).

    That is doc_id, unless some are null or repeat: then rows are numbered by their
    place in a written copy of the table, in a column whose name the input lacks.
    """
    n, known, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == known == distinct:
        return docs, "doc_id"
    row = fresh_name("row_no", docs)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "stage-rows"), row


def _without(docs: DataFrame, rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Columns of ``docs`` of the ``rows`` whose key is not among ``dropped`` (doc_id).

    A bitmap sized by the number of dropped rows tells which rows may be dropped; all
    others pass without a shuffle, and only those few are joined with the dropped ids.
    """
    gone = materialize(dropped.select(F.col("doc_id").alias(key)).distinct(), "stage-dropped")
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bitmap_bits(gone.count()))) + F.lit(1)
    bitmap = materialize(exact_dedup.group_bitmap(gone, slot), "stage-bitmap")
    maybe = fresh_name("may_be_dropped", rows)
    marked = exact_dedup.mark_members(rows, bitmap, slot, maybe)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    passed = marked.filter(~F.col(maybe))
    left = marked.filter(F.col(maybe)).join(gone, key, "left_anti")
    return passed.select(*columns).unionByName(left.select(*columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _identified(docs)
    judged = exact_dedup.exact_dedup(rows, id_col=key)
    return _without(docs, rows, key, judged.filter("NOT kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _identified(docs)
    judged = minhash.near_duplicates(rows, id_col=key, threshold=NEAR_THRESHOLD, bands=NEAR_BANDS, rows=NEAR_ROWS)
    return _without(docs, rows, key, judged.filter("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _identified(docs)
    found = decontaminate.contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(docs, rows, key, found)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The lexicon, the near-duplicate classes and the packing are beyond SQL; see tests/llm.
ORACLE_SQL = None
