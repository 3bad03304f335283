"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-gram models over ``buckets`` hashed unigrams and bigrams are counted: one
over target texts, one over all raw texts. A text's log importance is the sum over its
n-grams of the log ratio of the models; adding Gumbel noise drawn from a hash of its id
and keeping the ``k`` greatest samples without replacement in proportion to importance.

Both models cover every text of theirs. A bitmap of 16 slots a target id (128 MiB at
most) tells which rows may be targets, so no text is shuffled to be counted. The few
rows whose id only shares a slot are found by a join of ids, counted in a second pass
that shuffles no other texts, and subtracted: the counts are exact.

How it scales: counting emits at most ``buckets`` partial sums a task and merges them
with map-side combine, so what reaches the driver is two vectors of fixed size, while
counts cover every text. The k-th greatest value is found exactly by histograms of
fixed size (a few narrow passes), not by sorting all rows in one place; ties are
settled by further columns in the same way; ``k`` grows with the input.

Defined results: null text counts as empty; a text without words has log importance 0;
equal values are ordered by id (null last), then by a row number; rows that share a
target's id all count as target, a null id never does; repeated rows are sampled row by row; without target texts all importances are 0 and the sample is
uniform; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, discard, fresh_name, materialize, small_batches, text_or_empty
from .exact_dedup import group_bitmap, mark_members
from .shingles import Shingler

BUCKETS = 10_000
SHARE = 0.8
SMOOTHING = 1.0
SEED = 17
HISTOGRAM = 4096
_WORD = re.compile(r"\w+|[^\w\s]+")


def features(text: str, shingler: Shingler, buckets: int) -> np.ndarray:
    """Bucket of every unigram and bigram."""
    words = shingler.shingles(" ".join(_WORD.findall(text.lower())))
    if not len(words):
        return np.empty(0, np.int64)
    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] + np.uint64(0x7F4A7C15))
    pairs ^= pairs >> np.uint64(31)
    return (np.concatenate((words, pairs)) % np.uint64(buckets)).astype(np.int64)


def count_buckets(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts over ``texts`` (text, is_target): row 0 for all, row 1 for target texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column(0), batch.column(1)):
                found = np.bincount(features(text.as_py(), shingler, buckets), minlength=buckets)
                counts[0] += found
                if is_target.as_py():
                    counts[1] += found
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "n", "n_target"])

    rows = (
        texts.select("text", "is_target")
        .mapInArrow(run, "bucket long, n long, n_target long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
        .collect()
    )
    total = np.zeros((2, buckets))
    for r in rows:
        total[:, r["bucket"]] = r["n"], r["n_target"]
    return total


def log_ratio(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target model over raw model for each bucket; zeros without target texts."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    models = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * counts.shape[1])
    return models[1] - models[0]


def _scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    buckets = len(ratio)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for batch in small_batches(batches):
            found = [float(shared.value[features(t.as_py(), shingler, buckets)].sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "log_importance"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_importance double")


def _narrowed(rows: DataFrame, value: str, k: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """(rows surely among the k greatest, rows of which some are, how many of those, whether they are all equal)."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    above = 0
    while True:
        inside = rows.filter((F.col(value) >= low) & (F.col(value) <= high))
        width = (high - low) / HISTOGRAM
        if not width > 0:
            break
        place = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(HISTOGRAM - 1))
        bins = {
            r["b"]: r
            for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        }
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                break
            above += bins[b]["n"]
        narrowed = bins[b]["lo"], bins[b]["hi"]
        done = bins[b]["n"] <= HISTOGRAM or narrowed == (low, high)
        low, high = narrowed
        if done:
            break
    return rows.filter(F.col(value) > high), rows.filter((F.col(value) >= low) & (F.col(value) <= high)), k - above, low == high


def top_k(rows: DataFrame, value: str, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` rows with the greatest ``value``, ties by ``tie`` (least first, null last); exact.

    Histograms of ``HISTOGRAM`` bins close in on the k-th value until one bin's rows are
    few or all equal. Few are ranked; equal ones are narrowed by the next tie column, so
    no sort holds more than a bin. Rows that agree in every column are interchangeable.
    """
    n = rows.count()
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    sure, edge, wanted, equal = _narrowed(rows, value, k)
    if not equal or not tie:
        order = [F.desc(value), *[F.col(c).asc_nulls_last() for c in tie]]
        return sure.unionByName(edge.orderBy(*order).limit(wanted))
    column, *rest = tie
    known, unknown = edge.filter(F.col(column).isNotNull()), edge.filter(F.col(column).isNull())
    n_known, rank = known.count(), fresh_name("rank_by", rows)
    if wanted > n_known:
        chosen = known.unionByName(top_k(unknown.withColumn(rank, F.lit(0)), rank, wanted - n_known, rest).drop(rank))
    else:
        chosen = top_k(known.withColumn(rank, -F.col(column)), rank, wanted, rest).drop(rank)
    return sure.unionByName(chosen)


def target_counts(source: DataFrame, wanted: DataFrame, buckets: int) -> np.ndarray:
    """Counts over source (doc_id, text): row 0 for all texts, row 1 for those whose id is in ``wanted`` (doc_id)."""

    def slot(bits: int) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + F.lit(1)

    def marked(ids: DataFrame, bits: int) -> DataFrame:
        bitmap = materialize(group_bitmap(ids, slot(bits)), "resample-bitmap")
        return mark_members(source, bitmap, slot(bits), "is_target").withColumn("is_target", F.col("is_target") & F.col("doc_id").isNotNull())

    bits = bitmap_bits(wanted.count())
    maybe = marked(wanted, bits)
    counts = count_buckets(maybe, buckets)
    wrong = materialize(maybe.filter("is_target").select("doc_id").distinct().join(wanted, "doc_id", "left_anti"), "resample-wrong")
    n_wrong = wrong.count()
    if n_wrong:
        doubtful = marked(wrong, bitmap_bits(n_wrong)).filter("is_target").join(wrong, "doc_id", "left_semi")
        counts[1] -= count_buckets(doubtful, buckets)[0]
    discard(wrong)
    return counts


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    share: float = SHARE,
    buckets: int = BUCKETS,
    seed: int = SEED,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """``share`` of the rows of docs (doc_id, text): doc_id, log_importance, sample_key.

    ``target`` has the doc_id of target texts.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    wanted = materialize(wanted, "resample-labels")
    ratio = log_ratio(target_counts(source, wanted, buckets), smoothing)
    discard(wanted)

    scored = materialize(_scored(source, ratio).withColumn("row_no", F.monotonically_increasing_id()), "resample-scores")
    # uniform in (0, 1) from 53 bits of a hash of the id
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = materialize(scored.withColumn("sample_key", F.col("log_importance") - F.log(-F.log(uniform))), "resample-keys")
    discard(scored)
    chosen = top_k(keyed, "sample_key", round(share * keyed.count()), ["doc_id", "row_no"])
    return chosen.select("doc_id", "log_importance", "sample_key")
