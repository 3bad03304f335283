"""The pipeline's near stage drops near copies from a similarity of 0.80 on."""

import random

import corpus_pipeline as P
from tests.llm.test_dedup import brute_near, family

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pair(rng, words):
    """A text of different words and a copy with one word in the middle changed: five of its shingles differ."""
    text = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    copy = list(text)
    copy[words // 2] = "changed"
    return " ".join(text), " ".join(copy)


def left(spark, texts):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    return {r.doc_id for r in P.near_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}


def test_near_stage_threshold_is_80(spark):
    rng = random.Random(5)
    at = [t for _ in range(40) for t in pair(rng, 49)]  # 40 of 50 shingles
    under = [t for _ in range(40) for t in pair(rng, 48)]  # 39 of 49
    assert left(spark, at + under) == {*range(0, 80, 2), *range(80, 160)}


def test_near_stage_against_brute_force(spark):
    texts = [*family(3, 24), *family(4, 24, words=60)]
    wanted = brute_near(list(enumerate(texts)), threshold=80)
    assert wanted != brute_near(list(enumerate(texts)), threshold=85)
    assert left(spark, texts) == {component for _, component in wanted.values()}
