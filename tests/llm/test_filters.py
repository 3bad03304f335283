import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import chat as C
from lumenframe.llm import decontaminate as D
from lumenframe.llm import resampling as R
from lumenframe.llm import toxicity as X
from lumenframe.llm import url_filter as U

RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "com", "/de/")]


def test_urls(spark):
    rows = [
        (1, "http://a.Example.ORG/es/x?y#z"), (2, "https://b.org"), (3, "https://b.org/q"), (4, "http://x.com/de/"), (5, None), (6, "no scheme"),
        (7, "http://bad.net/p/"), (8, "https://www.bad.net/p?q=1"), (9, "http://bad.net/other"), (10, "http://com/de/1"), (11, "http://notorg.xorg/"), (11, "http://notorg.xorg/"), (None, "ftp://"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.net/p",), (None,), ("",)], "canonical string")
    found = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in U.judge_urls(pages, listed, RULES).collect()}
    assert found[1, "a.example.org", "/es/x"] == ("example.org/es/", "block")
    assert found[2, "b.org", ""] == (None, "allow") and found[3, "b.org", "/q"] == ("org/", "allow")
    assert found[4, "x.com", "/de/"] == ("com/de/", "block") and found[10, "com", "/de/1"][1] == "block"
    assert found[5, "", ""] == found[6, "", ""] == found[None, "", ""] == (None, "allow")
    assert found[7, "bad.net", "/p/"] == found[8, "www.bad.net", "/p"] == (None, "block")
    assert found[9, "bad.net", "/other"] == found[11, "notorg.xorg", "/"] == (None, "allow")
    assert U.judge_urls(pages, listed, RULES).count() == len(rows)
    assert U.judge_urls(pages.limit(0), listed.limit(0), RULES).count() == 0


def test_false_positives_of_a_small_filter_are_settled_by_the_join(spark):
    rng = random.Random(9)
    urls = [(k, f"https://{rng.choice(('www.', 'm.', ''))}h{rng.randrange(40)}.net/p/{rng.randrange(60)}{rng.choice(('', '/', '?q=1', '#z'))}") for k in range(3000)]
    urls += [(5000, "http://long.net/" + "a" * 300000), (5001, "http://long.net/" + "a" * 299999), (5002, None)]
    pages = spark.createDataFrame([(k, u, "x", True, "c", "r", "v") for k, u in urls], "page_id long, url string, host string, possible boolean, canonical string, rule string, by_rule string")
    ids = spark.createDataFrame([(k,) for k in range(150)] + [(5000,), (None,), (7,), (99999,)], "id long")
    listed = U.listed_by_ids(pages, ids)

    def key(url):
        host, _, path = url.partition("://")[2].split("?")[0].split("#")[0].partition("/")
        return host.removeprefix("www.").removeprefix("m.") + ("/" + path).rstrip("/")

    known = {key(u) for k, u in urls if u and (k < 150 or k == 5000)}
    assert {r.canonical for r in listed.collect()} == known
    wanted = {k: "block" if u and key(u) in known else "allow" for k, u in urls}
    for bits in (512, 1 << 28):
        found = {r.page_id: r.verdict for r in U.judge_urls(pages, listed, [], max_bits=bits).collect()}
        assert found == wanted
    keys = listed.select(F.xxhash64("canonical").alias("h"))
    small = U.BlockedBloom(keys, len(known), max_bits=512)
    passed = pages.filter(small.may_hold(F.xxhash64(U.canonical(*U.host_and_path(F.col("url")))))).count()
    assert passed > sum(v == "block" for v in wanted.values())  # false positives did reach the join


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = U.BlockedBloom(keys, 5000)
    assert keys.filter(~bloom.may_hold(F.col("h"))).count() == 0
    other = spark.range(10**6, 10**6 + 20000).select(F.xxhash64("id").alias("h"))
    assert other.filter(bloom.may_hold(F.col("h"))).count() < 400


def turns(spark, conversations):
    rows = [(c, k, role, text, "extra") for c, ts in conversations for k, (role, text) in enumerate(ts)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")


def test_snapshots_collapse(spark):
    full = [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"a{k}") for k in range(9)]
    other = full[:3] + [("user", "elsewhere")]
    log = [(1, full[:1]), (2, full[:4]), (3, full), (4, other), (5, full), (6, [("system", None)]), (7, [("system", "")]), (8, [(None, "q0")])]
    for chunk in (2, 1024):
        found = C.collapse_and_render(turns(spark, log), chunk).collect()
        assert {r.conv_id for r in found} == {3, 4, 6, 8}
        whole = "".join(r.text for r in sorted((r for r in found if r.conv_id == 3), key=lambda r: r.part))
        assert whole == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in full)
        assert {r.n_turns for r in found if r.conv_id == 3} == {9}
        if chunk == 2:
            assert sum(r.conv_id == 3 for r in found) == 5


def by_brute_force(rows):
    """Maximal conversations as lists of (role, text), from the definition."""
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn is None, turn or 0, hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or ""))
    talks = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in talks.items()}
    out = {}
    for c, talk in talks.items():
        longer = any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks.values())
        first = min((k for k, o in talks.items() if o == talk), key=lambda k: (k is None, k or 0))
        if not longer and first == c:
            out[c] = talk
    return out


def test_chat_ties_nulls_and_empty(spark):
    rows = [(1, None, "user", "z"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "n"), (None, 1, "user", "m"), (7, None, None, None), (7, None, "", "")]
    frame = spark.createDataFrame([(*r, 1, "d", "p") for r in rows], "conv_id long, turn long, role string, text string, at int, digest string, part string")
    found = {r.conv_id: r for r in C.collapse_and_render(frame).collect()}
    for c, talk in by_brute_force(rows).items():
        assert found.pop(c).text == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in talk)
    assert not found and C.collapse_and_render(frame.limit(0)).count() == 0


def test_a_turn_number_of_half_the_table_is_split(spark):
    rng = random.Random(11)
    rows = [(3, 5, "user", "same")] * 60000 + [(3, None, "user", f"{rng.randrange(50)}") for _ in range(40000)] + [(4, k, "user", "w " * 200000) for k in range(3)] + [(5, 0, "user", "w " * 200000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = C.positions(frame, 1024)
        assert sorted(r.pos for r in placed.filter("conv_id = 3").select("pos").collect()) == list(range(100000))
        largest = max(r["count"] for r in placed.filter("conv_id = 3").groupBy("chunk_no").count().collect())
        found = C.collapse_and_render(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert largest == 1024
    wanted = by_brute_force(rows)
    for c, talk in wanted.items():
        parts = sorted((r.part, r.text) for r in found if r.conv_id == c)
        assert "".join(t for _, t in parts) == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in talk)
    assert {r.conv_id for r in found} == set(wanted) == {3, 4}


WORDS = [f"word{k}" for k in range(3000)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_decontamination(spark):
    rng = random.Random(5)
    items = [passage(rng, n) for n in (15, 37, 59, 40)]
    swapped = list(items[2])
    for k in range(6, 59, 9):
        swapped[k] = "other"
    texts = {
        1: passage(rng, 50) + items[0] + passage(rng, 30),
        2: [w.upper() + "," for w in items[1]],
        3: passage(rng, 20) + swapped + passage(rng, 200),
        4: passage(rng, 500),
        5: passage(rng, 10) + items[1][:8] + passage(rng, 10),
        6: items[3][:20] + passage(rng, 5) + items[0],
        9: passage(rng, 30000) + items[3],
    }
    rows = [(i, " ".join(t), "s", 1) for i, t in texts.items()] + [(7, None, "s", 1), (8, "", "s", 1), (1, " ".join(texts[1]), "s", 1), (None, " ".join(items[0]), "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seed string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(8, None), (9, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (3, 2), (6, 3), (6, 0), (9, 3), (None, 0)}
    assert found[1, 0].n_equal == 15 and found[1, 0].doc_start == 50 and found[9, 3].doc_start == 30000
    assert 50 <= found[3, 2].n_equal < 59
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_segment_against_brute_force(seed):
    rng = random.Random(seed)
    text = np.array([rng.randrange(3) for _ in range(25)], np.uint64)
    item = np.array([rng.randrange(3) for _ in range(12)], np.uint64)
    for diagonal in range(-11, 25):
        pairs = [(k, text[k] == item[k - diagonal]) for k in range(25) if 0 <= k - diagonal < 12]
        best = max((sum(1 if e else -D.PENALTY for _, e in pairs[a:b]) for a in range(len(pairs)) for b in range(a, len(pairs) + 1)), default=0)
        equal, _, n = D.best_segment(text, item, diagonal)
        assert equal - D.PENALTY * (n - equal) == best


@pytest.mark.parametrize("changes", range(5))
def test_recall_of_substituted_passages_against_brute_force(spark, changes):
    rng = random.Random(40 + changes)
    items = [passage(rng, rng.randrange(15, 60)) for _ in range(60)]
    texts = []
    for k in range(180):
        planted = list(items[k % 60])
        for at in rng.sample(range(len(planted)), changes):
            planted[at] = "substituted"
        texts.append(passage(rng, rng.randrange(60)) + planted + passage(rng, rng.randrange(60)))
    texts += [passage(rng, 150) for _ in range(60)]
    shingler = D.Shingler(1)
    words = [D.tokens(" ".join(t), shingler) for t in texts]
    tests = [D.tokens(" ".join(t), shingler) for t in items]
    wanted = set()
    for d, text in enumerate(words):
        for i, item in enumerate(tests):
            if len(np.intersect1d(text, item)) >= 12:
                best = max(D.best_segment(text, item, g)[0] for g in range(1 - len(item), len(text)))
                if best >= min(D.MIN_OVERLAP, D.MIN_SHARE * len(item)):
                    wanted.add((d, i))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert found <= wanted and len(found) >= 0.97 * len(wanted) and len(wanted) >= (180 if changes < 2 else 100)


def test_items_shorter_than_every_mask_are_matched_whole(spark):
    rows = [(1, "a rare five token phrase here"), (2, "a rare five TOKEN, phrase"), (3, "a rare five token"), (4, "quux " * 5000), (5, "nothing"), (None, "quux")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A rare five token phrase"), (2, "quux"), (3, "?!"), (None, "nothing"), (5, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_equal, r.doc_start) for r in D.contaminated(docs, bench).collect()}
    assert found == {(1, 1): (5, 0), (2, 1): (5, 0), (4, 2): (1, 0), (None, 2): (1, 0)}


def brute_importance(rows, target, buckets):
    """log importance of each text from two dictionaries of counts."""
    shingler = R.Shingler(1)
    bags = [(i, list(R.features(t or "", shingler, buckets))) for i, t in rows]
    raw, good = [0] * buckets, [0] * buckets
    for i, bag in bags:
        for f in bag:
            raw[f] += 1
            good[f] += i in target
    if not sum(good):
        return [(i, 0.0) for i, _ in bags]
    ratio = [math.log((g + 1) / (sum(good) + buckets)) - math.log((n + 1) / (sum(raw) + buckets)) for g, n in zip(good, raw)]
    return [(i, sum(ratio[f] for f in bag)) for i, bag in bags]


def test_importance_resampling(spark, monkeypatch):
    rng = random.Random(2)
    good = [(k, " ".join(rng.choice(("sun", "moon", "star", "sky")) for _ in range(30))) for k in range(60)]
    bad = [(100 + k, " ".join(rng.choice(("buy", "now", "cheap", "click")) for _ in range(30))) for k in range(60)]
    rows = [*good, *bad, (300, None), (301, ""), (None, "sun moon"), (3, "sun again"), (3, "sun again"), (302, "sky " * 100000)]
    docs = spark.createDataFrame([(*r, True, 1.0, 2) for r in rows], "doc_id long, text string, is_target boolean, sample_key double, row_no int")
    target = spark.createDataFrame([(k,) for k in range(20)] + [(None,), (5,), (999,)], "doc_id long")
    found = R.importance_sample(docs, target, share=0.5)
    kept = {r.doc_id for r in found.collect()}
    assert found.count() == round(126 * 0.5) and len(kept & set(range(60))) >= 58 and not kept & set(range(100, 160))
    wanted = sorted(brute_importance(rows, set(range(20)), R.BUCKETS), key=repr)
    for bits in (None, 8):  # a bitmap of 8 slots marks many rows that are no targets
        if bits:
            monkeypatch.setattr(R, "bitmap_bits", lambda n, b=bits: b)
        scored = sorted(((r.doc_id, r.log_importance) for r in R.importance_sample(docs, target, share=1.0).collect()), key=repr)
        assert [i for i, _ in scored] == [i for i, _ in wanted]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for (_, a), (_, b) in zip(sorted(scored, key=lambda r: (str(r[0]), r[1])), sorted(wanted, key=lambda r: (str(r[0]), r[1]))))
    assert R.importance_sample(docs.limit(0), target).count() == 0
    assert R.importance_sample(docs, target.limit(0), share=0.25).count() == round(126 * 0.25)


def test_ties_of_half_the_table_are_settled_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "HISTOGRAM", 16)
    rows = [(None, 1.0, k) for k in range(3000)] + [(k % 7, 1.0, 3000 + k) for k in range(2000)] + [(k, 2.0, 6000 + k) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, v double, row_no long")
    wanted = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for k in (50, 100, 101, 700, 2100, 2101, 4000):
        assert sorted(r.row_no for r in R.top_k(frame, "v", k, ["doc_id", "row_no"]).collect()) == sorted(r[2] for r in wanted[:k])


def test_top_k_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice((rng.gauss(0, 1), 0.5, 0.5, -1e9, 1e12)) for _ in range(20000)]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, v double")
    wanted = sorted(range(20000), key=lambda k: (-values[k], k))
    for k in (0, 1, 37, 9000, 19999, 20000):
        assert sorted(r.doc_id for r in R.top_k(rows, "v", k, ["doc_id"]).collect()) == sorted(wanted[:k])


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 200))]
        toxic = k % 8 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(("grobnik", "zworlex", "zworlen")))
            words.insert(rng.randrange(len(words)), rng.choice(("grobnik", "zworlet")))
        elif k % 5 == 0:
            words += ["mild", "zworlo", "festival"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    lexicon = X.learn(docs, labels)
    found = X.score_texts(docs, lexicon).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    extra = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "a gr0bnik and zworlexia", 5), (4, "ｇｒоbnik grobniiiik", 5), (4, "ｇｒоbnik grobniiiik", 5), (5, "fine " * 50000, 5)], "doc_id long, text string, score int"
    )
    scored = X.score_texts(extra, lexicon).collect()
    assert [r.predicted for r in scored] == [0, 0, 1, 1, 1, 0]
    kept = X.keep_clean(extra, lexicon)
    assert kept.columns == extra.columns and kept.count() == 3
    assert X.score_texts(extra.limit(0), lexicon).count() == 0


def test_a_repeated_fit_gives_the_same_lexicon(spark):
    docs, labels = labelled(spark)
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" .")))).cache()
    marks = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 1000))
    first = X.learn(copies.repartition(2, "text"), marks)
    for parts in (3, 7):
        assert X.learn(copies.repartition(parts, "doc_id"), marks.repartition(parts)) == first


def unfolded(text):
    """Folding written out character by character."""
    out = []
    text = "".join(c for c in text.lower() if c not in "\u00ad\u200b\u200c\u200d\u2060\ufeff")
    alike = dict(zip("\u0430\u0435\u043e\u0441", "aeoc"))
    for word in "".join(alike.get(c, c) for c in text).split():
        word = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}.get(c, c) if any(x.isalpha() for x in word) else c for c in word)
        runs = []
        for c in word:
            runs[-1:] = [runs[-1] + c] if runs and runs[-1][0] == c else [*runs[-1:], c]
        out += ["".join(r if len(r) < 3 else r[0] for r in runs)]
    return [w for w in out if w.isalpha()]


@pytest.mark.parametrize("seed", range(10))
def test_matches_against_a_plain_matcher(seed):
    rng = random.Random(seed)
    entries = {" grob": 2.5, " zworl ": 3.0, " idiot ": 2.0, " mush": 4.0}
    lexicon = X.Lexicon(entries, ("mush room",), (-3.0, 2.0, 1.0))
    disguise = lambda w: "".join(rng.choice((c, {"o": "0", "i": "1", "a": "\u0430"}.get(c, c), c * 4)) for c in w)
    words = [disguise(rng.choice(("grobnik", "zworl", "zworls", "idiot", "mush", "room", "fine", "day"))) for _ in range(60)]
    text = " ".join(words)
    plain = unfolded(text)
    assert X.folded_words(text) == plain
    hits = []
    for k, word in enumerate(plain):
        found = [w for e, w in entries.items() if (word == e.strip() if e.endswith(" ") else word.startswith(e.strip()))]
        harmless = (word == "mush" and plain[k + 1 : k + 2] == ["room"]) or (word == "room" and plain[k - 1 : k] == ["mush"])
        if found and not harmless:
            hits.append((word, max(found)))
    assert sorted(w for _, _, w in lexicon.matcher().hits(f" {' '.join(plain)} ")) == sorted(w for _, w in hits)


def test_toxicity_learns_no_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(docs, labels) == X.learn(docs, flipped)


def test_toxicity_without_labels_and_exceptions(spark):
    docs, labels = labelled(spark)
    base = X.learn(docs, labels.limit(0))
    matcher = base.matcher()
    assert matcher.score("you are an 1diot") > 0.7 > matcher.score("put it in the trash can") and matcher.score("") < 0.5
    assert X.folded_words("Stuuuupid w0rd5 2024") [:2] == ["stupid", "words"]
    assert math.isfinite(matcher.score("idiot " * 10000))


def test_bounded_sample(spark):
    from lumenframe.llm.common import bounded_sample

    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    assert bounded_sample(rows, "doc_id", 1000, "s").count() == 1000
    assert bounded_sample(rows.limit(900), "doc_id", 1000, "s").count() == 900
    first = {r.doc_id for r in bounded_sample(rows, "doc_id", 1000, "s").collect()}
    assert first == {r.doc_id for r in bounded_sample(rows.repartition(3), "doc_id", 1000, "s").collect()}
