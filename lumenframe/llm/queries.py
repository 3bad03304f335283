"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat as _chat
from . import decontaminate as _decontaminate
from . import exact_dedup as _exact
from . import html_text as _html
from . import minhash as _minhash
from . import packing as _packing
from . import resampling as _resampling
from . import toxicity as _toxicity
from . import url_filter as _url
from . import warc as _warc
from .common import read_table
from .sql import ORACLES


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = _warc.derive(_warc.responses(read_table(spark, sf_dir, "pages")))
    return derived.withColumnRenamed("source_id", "page_id")


def op2_html_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract_main_text(read_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the documents, sampled towards those labelled as good."""
    good = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return _resampling.importance_sample(read_table(spark, sf_dir, "documents"), good)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(
        read_table(spark, sf_dir, "documents"),
        json_path=_vocabulary("byte_bpe_50k.json"),
        rank_path=_vocabulary("byte_bpe_50k.tiktoken"),
    )


#: Rules of the registered query: verdict, host, path.
URL_RULES = [
    _url.Rule("allow", "org", "/"),
    _url.Rule("block", "example.org", "/es/"),
    _url.Rule("block", "example.org", "/en/1"),
    _url.Rule("allow", "com", "/fr/"),
    _url.Rule("block", "com", "/de/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of the pages whose numbers reviewers labelled as toxic."""
    pages = read_table(spark, sf_dir, "pages")
    reported = read_table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return _url.judge_urls(pages, _url.listed_by_ids(pages, reported), URL_RULES)


def op6_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return _toxicity.score_texts(docs, _toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_derivatives": op1_warc_derivatives,
        "op2_html_page_differencing": op2_html_page_differencing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_chat_snapshot_collapse": op6_chat_snapshot_collapse,
        "op7_spaced_seed_decontamination": op7_spaced_seed_decontamination,
        "op8_importance_resampling": op8_importance_resampling,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in queries() if name in ORACLES}
