"""Exact deduplication by progressive refinement (built-in functions only).

Rows are grouped by normalised length, then by a hash of a short prefix, then by
a full SHA-256. A row takes part in a finer grouping only while its coarser group
still has company, so full content is grouped only for surviving rows.

How it scales
-------------
* Scan 1 aggregates ``(length, prefix hash) -> rows`` with map-side combine; no
  text leaves its task.
* The surviving groups become a bitmap of 16 slots a group, 512 KiB at least and
  128 MiB at most (or ``slots`` / 8 bytes), so it may be broadcast. A bit shared
  by two groups only lets a lone row go on to the full hash: never a wrong merge.
* Scan 2 computes full hashes and writes narrow fingerprints; texts are never
  shuffled. The final join is between two written tables, so adaptive execution
  splits a hot group of copies.

Defined results: null text counts as empty; empty texts are equal to one
another; among rows with the same length and ``doc_id`` one (the first written)
stays; a null ``doc_id`` loses ties against any other; extra columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, discard, fresh_name, materialize, text_or_empty

PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    """Text without ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _slot(bits: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + F.lit(1)


def group_bitmap(groups: DataFrame, slot: Column) -> DataFrame:
    """Bitmap table (bm_bucket, bm_bits) of the slots present in ``groups``."""
    marked = groups.select(slot.alias("slot"))
    return marked.groupBy(F.bitmap_bucket_number("slot").alias("bm_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bm_bits")
    )


def mark_members(rows: DataFrame, bitmap: DataFrame, slot: Column, flag: str) -> DataFrame:
    """Add boolean ``flag``: the row's slot is set in the fixed-size bitmap.

    Names used on the way are chosen so that they clash with no column of ``rows``.
    """
    at, bucket, bits = (fresh_name(n, rows) for n in ("bm_slot", "bm_bucket", "bm_bits"))
    with_slot = rows.withColumn(at, slot).withColumn(bucket, F.bitmap_bucket_number(at))
    pieces = bitmap.select(F.col("bm_bucket").alias(bucket), F.col("bm_bits").alias(bits))
    position = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    hit = F.getbit(byte.cast("int"), (position % 8).cast("int")) == 1
    return (
        with_slot.join(F.broadcast(pieces), bucket, "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop(at, bucket, bits)
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_all: bool = False,
    prefix_chars: int = PREFIX_CHARS,
    slots: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for rows that earlier groupings proved unique unless
    ``digest_all`` asks for every row's digest.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("raw"))
    shaped = source.select("doc_id", F.length("raw").alias("n_cp"), normalized(F.col("raw")).alias("norm"))
    keyed = shaped.select(
        "doc_id",
        "n_cp",
        "norm",
        F.length("norm").alias("norm_len"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix_hash"),
    )

    prefix_counts = materialize(
        keyed.groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("n_rows")), "dedup-prefixes"
    )
    long_enough = prefix_counts.groupBy("norm_len").agg(F.sum("n_rows").alias("n")).filter("n > 1")
    bits = slots or bitmap_bits(prefix_counts.filter("n_rows > 1").count())
    length_map = group_bitmap(long_enough, _slot(bits, F.col("norm_len")))
    after_length = mark_members(prefix_counts, length_map, _slot(bits, F.col("norm_len")), "by_length")
    after_prefix = after_length.filter("by_length AND n_rows > 1")
    pair_slot = _slot(bits, F.col("norm_len"), F.col("prefix_hash"))
    survivors = materialize(group_bitmap(after_prefix, pair_slot), "dedup-survivors")

    flagged = mark_members(keyed, survivors, pair_slot, "survivor")
    digest = F.sha2(F.col("norm"), 256)
    prints = materialize(
        flagged.select(
            F.monotonically_increasing_id().alias("row_no"),
            "doc_id",
            "n_cp",
            "norm_len",
            "prefix_hash",
            "survivor",
            (digest if digest_all else F.when(F.col("survivor"), digest)).alias("text_sha256"),
        ),
        "dedup-prints",
    )
    discard(prefix_counts, survivors)
    best = F.min(F.struct((-F.col("n_cp")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    groups = (
        prints.filter("survivor")
        .groupBy("norm_len", "prefix_hash", "text_sha256")
        .agg(F.count("*").alias("group_size"), best.alias("best"))
        .filter("group_size > 1")
        .select(
            "text_sha256",
            "group_size",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row_no").alias("keep_row"),
        )
    )
    groups = materialize(groups, "dedup-groups")
    joined = prints.join(groups, "text_sha256", "left")
    alone = F.col("keep_row").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
