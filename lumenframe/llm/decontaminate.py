"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select token positions; the hash of the selected tokens is a seed, so a
substituted word in an ignored position does not break it. Seeds of the benchmark
and of the training texts are joined, and each hit is verified along its diagonal:
aligned tokens score +1 if equal and -``PENALTY`` if not, and the best segment must
have ``min_overlap`` equal tokens (``min_share`` of the item's tokens, if it is
shorter).

How it scales
-------------
* Training texts are read once. A two-probe bitmap of the benchmark's seeds, of at
  most ``MAX_BITMAP_BITS`` bits whatever the benchmark's size, is sent to the
  executors; only seeds that pass it leave the scan, with the tokens around them.
  The exact join that follows removes the bitmap's false hits.
* Joins are between written tables: a seed or an item that many documents hold is
  split by adaptive execution, and rows are distinct (region, item, diagonal)
  triples, not pairs of hits.

Items of fewer tokens than the shortest mask have no spaced seed: the hash of the whole
item is joined with the windows of its length, and all its tokens must be equal; of
many such places in one text the first is taken.

Defined results: tokens are lower-cased runs of word characters; null text counts as
empty; items without a token, or with a null id, match nothing; rows with a
null id are reported with a null id; repeated rows give repeated matches of one id,
merged into one row; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slot_bitmap, small_batches, text_or_empty
from .shingles import Shingler

# Positions that take part in a seed.
MASKS = ("111111", "11011011", "1010110101", "1100101011", "110010010101")
MIN_OVERLAP = 13
MIN_SHARE = 0.8
PENALTY = 2
MIN_BITMAP_BITS = 1 << 20
MAX_BITMAP_BITS = 1 << 28
_SALT = 0xD6E8FEB86659FD93
_WORD = re.compile(r"\w+")


def tokens(text: str, shingler: Shingler) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    return shingler.shingles(" ".join(_WORD.findall(text.lower())))


def seeds(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[tuple[str, np.ndarray]]:
    """(mask, seed at every position where the mask fits)."""
    found = []
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, (len(mask) << 32) + int(mask, 2), np.uint64)
        for at, flag in enumerate(mask):
            if flag == "1":
                h = (h ^ words[at : at + n]) * np.uint64(_SALT)
                h ^= h >> np.uint64(32)
        found.append((mask, h))
    return found


def whole_mask(n: int) -> str:
    return "1" * n


def masks_for(n_words: int, masks: tuple[str, ...]) -> tuple[str, ...]:
    """Masks for an item: the spaced ones, or that of the whole item if it is shorter than all of them."""
    return masks if n_words >= min(map(len, masks)) else (whole_mask(n_words),) if n_words else ()


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    return h & np.uint64(bits - 1), (mixed >> np.uint64(20)) & np.uint64(bits - 1)


def _test_seeds(benchmark: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """item_id, words (binary) and seeds array<struct<seed, at>> of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
        for batch in small_batches(batches):
            words = [tokens(t.as_py(), shingler) for t in batch.column(1)]
            found = [
                [{"seed": int(s), "at": k} for _, h in seeds(w, masks_for(len(w), masks)) for k, s in enumerate(h.view(np.int64).tolist())]
                for w in words
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(found, kind)],
                names=["item_id", "words", "seeds"],
            )

    return benchmark.mapInArrow(run, "item_id long, words binary, seeds array<struct<seed long, at int>>")


def _bitmap(seed_table: DataFrame, bits: int) -> bytes:
    """Both probes of every seed, in ``bits`` bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            both = np.unique(np.concatenate(_probes(h, bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both)], names=["slot"])

    return slot_bitmap(seed_table.select("seed").mapInArrow(mark, "slot long"), bits)


def _regions(docs: DataFrame, bitmap, bits: int, margin: int, masks: tuple[str, ...], whole: frozenset[str]) -> DataFrame:
    """doc_id, first, words (binary), hits array<struct<seed, at>>: stretches of text with possible hits.

    Of equal seeds by a mask in ``whole`` a text's first is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        filled = np.frombuffer(bitmap.value, np.uint8)
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))

        def holds(slots: np.ndarray) -> np.ndarray:
            return (filled[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in small_batches(batches):
            ids, firsts, words, hits = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                w = tokens(text.as_py(), shingler)
                found = []
                for mask, h in seeds(w, masks):
                    one, two = _probes(h, bits)
                    at = np.flatnonzero(holds(one))
                    at = at[holds(two[at])]
                    if mask in whole:
                        at = at[np.unique(h[at], return_index=True)[1]]
                    found += zip(at.tolist(), h[at].view(np.int64).tolist())
                found.sort()
                begin = 0
                for k in range(1, len(found) + 1):
                    if k < len(found) and found[k][0] - found[k - 1][0] <= 2 * margin:
                        continue
                    first = max(0, found[begin][0] - margin)
                    ids.append(doc_id.as_py())
                    firsts.append(first)
                    words.append(w[first : found[k - 1][0] + margin].tobytes())
                    hits.append([{"seed": s, "at": a - first} for a, s in found[begin:k]])
                    begin = k
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(words, pa.binary()), pa.array(hits, kind)],
                names=["doc_id", "first", "words", "hits"],
            )

    return docs.mapInArrow(run, "doc_id long, first int, words binary, hits array<struct<seed long, at int>>")


def best_segment(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(equal tokens, start in text, length) of the best segment on one diagonal.

    ``diagonal`` is text position minus item position.
    """
    a = max(0, diagonal)
    b = a - diagonal
    n = min(len(text) - a, len(item) - b)
    if n <= 0:
        return 0, 0, 0
    equal = text[a : a + n] == item[b : b + n]
    gains = np.where(equal, 1, -PENALTY)
    sums = np.concatenate(([0], np.cumsum(gains)))
    lows = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lows))
    begin = int(np.flatnonzero(sums[: end + 1] == lows[end])[-1])
    return int(equal[begin:end].sum()), a + begin, end - begin


def _verify(rows: DataFrame, min_overlap: int, min_share: float, shortest: int) -> DataFrame:
    """rows: doc_id, item_id, diagonal, first, words, item_words; verified overlaps.

    Of items of fewer tokens than ``shortest`` all tokens must be equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list[int]] = [[] for _ in range(5)]
            for r in batch.to_pylist():
                text, item = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
                equal, start, length = best_segment(text, item, r["diagonal"])
                if equal >= (min(min_overlap, min_share * len(item)) if len(item) >= shortest else len(item)):
                    for column, value in zip(out, (r["doc_id"], r["item_id"], equal, length, r["first"] + start)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], names=["doc_id", "item_id", "n_equal", "n_span", "doc_start"]
            )

    return rows.mapInArrow(run, "doc_id long, item_id long, n_equal long, n_span long, doc_start long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_overlap: int = MIN_OVERLAP,
    min_share: float = MIN_SHARE,
    masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, n_equal, n_span, doc_start."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(item_text_col).alias("text"))
    tests = materialize(_test_seeds(tests, masks), "decon-tests")
    test_seeds = materialize(
        tests.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.seed", F.col("s.at").alias("item_at")).distinct(),
        "decon-seeds",
    )
    n_seeds = test_seeds.count()
    n_words = (F.length("words") / 8).cast("int")
    longest = tests.agg(F.max(F.length("words"))).first()[0] or 0
    short = [r["n"] for r in tests.select(n_words.alias("n")).filter(f"n > 0 AND n < {min(map(len, masks))}").distinct().collect()]
    whole = frozenset(map(whole_mask, short))
    margin = max(longest // 8, max(map(len, masks)))
    bits = min(MAX_BITMAP_BITS, max(MIN_BITMAP_BITS, 1 << (64 * max(n_seeds, 1) - 1).bit_length()))
    bitmap = spark.sparkContext.broadcast(_bitmap(test_seeds, bits))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    regions = materialize(
        _regions(source, bitmap, bits, margin, (*masks, *sorted(whole)), whole).withColumn("region", F.monotonically_increasing_id()), "decon-regions"
    )
    hits = regions.select("region", F.explode("hits").alias("h")).select("region", "h.seed", "h.at")
    diagonals = (
        hits.join(test_seeds, "seed")
        .select("region", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )
    diagonals = materialize(diagonals, "decon-diagonals")
    rows = (
        diagonals.join(regions.select("region", "doc_id", "first", "words"), "region")
        .join(tests.select("item_id", F.col("words").alias("item_words")), "item_id")
        .select("doc_id", "item_id", "diagonal", "first", "words", "item_words")
    )
    best = F.max(F.struct("n_equal", (-F.col("n_span")).alias("less"), (-F.col("doc_start")).alias("early"))).alias("best")
    return (
        _verify(rows, min_overlap, min_share, min(map(len, masks)))
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            F.col("best.n_equal").alias("n_equal"),
            (-F.col("best.less")).alias("n_span"),
            (-F.col("best.early")).alias("doc_start"),
        )
    )
