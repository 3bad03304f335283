import hashlib
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm.components import connected_components
from lumenframe.llm.exact_dedup import exact_dedup
from lumenframe.llm.minhash import near_duplicates

DOCS = "doc_id long, text string, lang string, norm_len string, kept string, bucket string, node string"


def docs(spark, rows):
    """(doc_id, text) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", "y", "z", None) for i, t in rows], DOCS)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


LONG = "wörd " * 40000
EXACT = [(1, "a b"), (2, "ab"), (3, " a b "), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "a b"), (8, LONG), (9, LONG + " "), (10, "ba"), (None, "ab"), (11, "x" * 300 + "1"), (12, "x" * 300 + "2")]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 22])
@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_against_brute_force(spark, bits, digest_all):
    found = exact_dedup(docs(spark, EXACT), digest_all=digest_all, slots=bits).collect()
    wanted = brute_exact(EXACT)
    if digest_all:
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=repr) == wanted
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in found], key=repr) == sorted([w[:3] for w in wanted], key=repr)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found if r.doc_id is not None)


def test_exact_keeps_one_of_repeated_rows(spark):
    found = exact_dedup(docs(spark, [(1, "a"), (1, "a"), (None, "q"), (None, "q")])).collect()
    assert sum(r.kept for r in found) == 2 and all(r.group_size == 2 for r in found)


def test_exact_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows, threshold=85):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= threshold * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def family(seed, n, words=120, edits=(0, 1, 2, 3, 6, 12)):
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for k in range(n):
        copy = list(base)
        for _ in range(edits[k % len(edits)]):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_near_against_brute_force(spark, block):
    texts = [*family(1, 30), *family(2, 12), "a b c", "A B  C", "a b c d", "", None, " \n", "É b c d e f", "é b c d e f", LONG, LONG + "end"]
    rows = list(enumerate(texts))
    found = near_duplicates(docs(spark, rows), block=block).collect()
    wanted = brute_near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(50))
    found = near_duplicates(docs(spark, [(None, text), (3, text), (3, text), (None, "other text here"), (4, None)])).collect()
    assert len(found) == 5
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id) == [(3, 3), (3, 3), (4, 4)]
    assert {r.component_id for r in found if r.doc_id is None} == {3, None}
    assert near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (300, 100)] + [(500, 501 + k) for k in range(50)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in (100, 200, 300)} == {100} and {found[500 + k] for k in range(51)} == {500}
    assert len(found) == 41 + 3 + 51
    assert connected_components(edges.filter(F.lit(False))).count() == 0


def test_components_with_null_ends_and_self_loops(spark):
    from lumenframe.llm.components import connected_components

    rows = [(1, 2), (2, 1), (1, 2), (5, 5), (None, 7), (8, None), (2, 3), (3, 3), (9, 10)]
    edges = spark.createDataFrame([(*r, "x", 0) for r in rows], "a long, b long, node string, u int")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 9), (10, 9)}
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_large_buckets_lose_no_link_beside_their_leader(spark, seed):
    import random

    rng = random.Random(70 + seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"e{rng.randrange(10**6)}"
        return out

    star = [changed(base, 2) for _ in range(25)]
    chains, tip = [], base
    for _ in range(12):  # each step is linked with the one before, not with the first
        tip = changed(tip, 3)
        chains.append(tip)
    apart = [changed(base, 9) for _ in range(12)]
    pairs = [changed(a, 1) for a in apart[:6]]  # linked with each other, not with the family's middle
    rows = list(enumerate(" ".join(t) for t in [base, *star, *chains, *apart, *pairs]))
    rng.shuffle(rows)
    wanted = brute_near(rows)
    assert len({c for _, c in wanted.values()}) > 3
    for block in (1 << 16, 900):
        found = near_duplicates(docs(spark, rows), block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def test_near_texts_are_shuffled_once_for_a_family(spark, monkeypatch):
    from lumenframe.llm import minhash

    rows = list(enumerate([*family(11, 40), *family(12, 30), *family(13, 1)]))
    dealt, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda tasks, *a: dealt.append(tasks.count()) or links(tasks, *a))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows)).collect()}
    assert found == brute_near(rows)
    assert 0 < dealt[0] <= 70  # not once for each of the up to 24 buckets that a copy is in


@pytest.mark.parametrize("crowd", [5, 1 << 12])
def test_near_crowded_buckets_against_brute_force(spark, crowd):
    rows = list(enumerate([*family(21, 30), *family(22, 14, words=60), *family(23, 9, edits=(0, 4, 9, 20))]))
    found = near_duplicates(docs(spark, rows), crowd=crowd, block=2000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_near(rows)


def test_candidates_join_all_sets_that_may_be_linked():
    import numpy as np

    from lumenframe.llm.minhash import _packed, _unpacked, forest_candidates

    rng = np.random.default_rng(4)
    middles = rng.integers(0, 2**32, (3, 120), dtype=np.uint32)
    signs = np.repeat(middles, 5, 0)
    for row in signs:  # each agrees with its family's middle in 100 places
        row[rng.choice(120, 20, replace=False)] = rng.integers(0, 2**32, 20, dtype=np.uint32)
    signs = _unpacked([_packed(row) for row in signs], 120)
    assert signs.shape == (15, 120)
    edges = forest_candidates(signs, np.array([100] * 14 + [10]), 85)
    assert len(edges) == 4 + 4 + 3  # the last is too small for a link
    assert all(i // 5 == k // 5 and 14 not in (i, k) for i, k in edges)


def test_written_tables_leave_no_shuffle_files(spark):
    from lumenframe.llm.common import discard, materialize

    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (found.apply(k).toString() for k in range(found.size())) if name.startswith("shuffle_")}

    before, setting = blocks(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # they go in the background
        left = blocks() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    discard(table)
