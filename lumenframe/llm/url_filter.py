"""URL filter: rules, and a blocked Bloom filter before an exact hash join.

A URL is judged by the longest rule that fits it. URLs without a rule are looked up
in a list of canonical URLs: a blocked Bloom filter (all probes of a key in one
512-bit block) lets possible hits pass, and a hash join with the list removes its
false positives.

How it scales: the filter takes ``BITS_PER_KEY`` bits for each listed URL up to
``MAX_BITS`` (32 MiB); beyond that more false positives pass and the join still
settles them. Only the URL column is read; only possible hits are shuffled, and both
sides of the join are written tables, so adaptive execution splits a URL that many
rows share.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule, is never listed, and is allowed; repeated rows are judged alike; null entries of
the list are ignored; URLs of any length are judged whole; extra columns are ignored; an
empty table gives an empty result, an empty list lists nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slot_bitmap

BITS_PER_KEY = 16
BLOCK_BITS = 512
PROBES = 8
MIN_BITS = 1 << 15
MAX_BITS = 1 << 28

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without closing slashes; empty without a host."""
    bare = F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"/+$", ""))
    return F.when(host == "", F.lit("")).otherwise(bare)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls without one."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        hit = fits(rule, host, path)
        text = F.when(hit, rule.text) if text is None else text.when(hit, rule.text)
        verdict = F.when(hit, rule.verdict) if verdict is None else verdict.when(hit, rule.verdict)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def probe_slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slots of each key, one row a key: one block, ``PROBES`` bits in it."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(bits // BLOCK_BITS)
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    steps = (mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1))
    k = np.arange(PROBES, dtype=np.uint64)
    inner = (steps[0][:, None] + k * steps[1][:, None]) % np.uint64(BLOCK_BITS)
    return (block[:, None] * np.uint64(BLOCK_BITS) + inner).astype(np.int64)


class BlockedBloom:
    """Filter of the 64-bit hashes in a DataFrame column ``h``."""

    def __init__(self, hashes: DataFrame, n_keys: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS):
        bits = self.bits = min(max_bits, max(MIN_BITS, 1 << (bits_per_key * max(n_keys, 1) - 1).bit_length()))

        def slots(batches):
            import pyarrow as pa

            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(probe_slots(h, bits)))], names=["slot"])

        filled = slot_bitmap(hashes.select("h").mapInArrow(slots, "slot long"), bits)
        self._shared = hashes.sparkSession.sparkContext.broadcast(filled)

    def may_hold(self, h: Column) -> Column:
        bits, shared = self.bits, self._shared

        def test(keys: pd.Series) -> pd.Series:
            slots = probe_slots(keys.to_numpy(dtype=np.int64), bits)
            filled = np.frombuffer(shared.value, np.uint8)
            return pd.Series(((filled[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1))

        return F.pandas_udf(test, "boolean")(h)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``listed`` has the canonical URLs to block in its column ``canonical``.
    """
    keys = materialize(listed.select("canonical").filter("canonical <> ''").distinct(), "url-list")
    bloom = BlockedBloom(keys.select(F.xxhash64("canonical").alias("h")), keys.count(), max_bits=max_bits)

    host, path = host_and_path(F.col(url_col))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    judged = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "by_rule": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
        .withColumn("possible", bloom.may_hold(F.xxhash64("canonical")))
    )
    judged = materialize(judged, "url-judged")
    settled = judged.filter("rule IS NOT NULL OR NOT possible").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict")
    )
    found = judged.filter("rule IS NULL AND possible").join(keys.withColumn("is_listed", F.lit(True)), "canonical", "left")
    checked = found.select(
        "page_id", "host", "path", "rule", F.when(F.col("is_listed"), "block").otherwise("allow").alias("verdict")
    )
    return settled.unionByName(checked)


def listed_by_ids(pages: DataFrame, ids: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Canonical URLs of the pages that ``ids`` (column ``id``) names; null ids name none."""
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).join(
        ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi"
    )
    return named.select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()
