"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes common disguises: compatibility forms, Cyrillic and Greek look-alikes,
zero-width characters, digits and signs that stand for letters, letters stretched
three times or more. Folded words are joined by single spaces, so an entry is
``" word "`` (the whole word) or ``" stem"`` (any word that begins so).

Weights are log odds of an entry's occurrence in toxic against clean labelled
texts, learned from the caller's labelled rows. Hits inside exception phrases (two
words that labelled texts show to be harmless, or listed ones) do not count. The
sum of weights, and the same normalised by length, go through a logistic curve
fitted to the same rows.

How it scales: fitting uses at most ``max_toxic`` + ``max_clean`` labelled rows,
chosen by a hash of their id, so the ids that are broadcast and the counts that reach
the driver are bounded by parameters whatever the input; with fewer labels all are
used. Of near copies in this sample the one with the least id speaks (of rows with one
id that whose text has the least hash), so a repeated fit gives the same lexicon. Every
candidate entry that enough sampled texts hold is tried. Scoring is one pass over all
texts by Arrow batches; nothing is shuffled.

Defined results: null text counts as empty; an empty text gets the score of a text
without hits; null or repeated ids and rows are scored as they are; without usable
labels of both kinds a listed base lexicon and fixed coefficients are used; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, text_or_empty
from .shingles import Shingler

#: Bounds of the labelled sample that a model is fitted on.
MAX_TOXIC = 4000
MAX_CLEAN = 12000
#: Stems are tried at these lengths; an entry needs this share of toxic texts, and this weight.
STEMS = (4, 5, 6)
MIN_SHARE = 0.002
MIN_DOCS = 3
MIN_WEIGHT = 2.0
#: Likelihood ratio that an entry needs, in logarithms of the number of candidates.
EVIDENCE = 2.0
BLOCK_AT = 0.7

# Base lexicon and harmless phrases, used with the learned ones.
BASE_WORDS = ("asshole", "bastard", "bitch", "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "stupid", "trash", "vermin", "worthless")
BASE_EXCEPTIONS = ("trash can", "trash bin", "circus clown", "clown fish")
BASE_WEIGHT = 3.0

# Look-alikes of Latin letters, and signs that stand for letters.
LOOK_ALIKES = str.maketrans(
    "авеікмнорсѕтухјԁһɡαβεικνορτυχ",
    "abeikmhopcstyxjdhgabeikvoptux",
)
SIGNS = str.maketrans("01345789@$", "oieastbgas")

_FOREIGN = re.compile("[Ͱ-\U0010ffffɡ]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SIGN = re.compile(r"(?<=[^\W\d_])[0-9@$]+(?=[^\W\d_])|(?<![\w@$])[0-9@$]{1,2}(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[0-9@$]{1,2}(?![\w@$])")
_DIGIT = re.compile("[0-9@$]")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W\d_]+")


def folded_words(text: str) -> list[str]:
    text = text.lower()
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower().translate(LOOK_ALIKES)
    if "­" in text:
        text = text.replace("­", "")
    if _DIGIT.search(text):
        undone = _SIGN.sub(lambda m: m[0].translate(SIGNS), text)
        # a sign at an edge may stand beside a sign that is a letter only now
        text = undone if undone == text else _SIGN.sub(lambda m: m[0].translate(SIGNS), undone)
    if _has_triples(text):
        text = _STRETCHED.sub(r"\1", text)
    return _WORD.findall(text)


def _has_triples(text: str) -> bool:
    """Whether a character stands three times in a row: cheaper than the pattern that undoes it."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])).any())


def _candidates(words: set[str]) -> set[str]:
    found = {f" {w} " for w in words if len(w) > 2}
    for n in STEMS:
        found.update(" " + w[:n] for w in words if len(w) >= n)
    return found


@dataclass
class Lexicon:
    """Entries with weights, harmless phrases, and the logistic curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Finds entries in folded text; built once for each task."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.curve = lexicon.curve
        self._entries = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self._entries.add_word(entry, (entry, weight))
        self._phrases = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self._phrases.add_word(f" {phrase} ", phrase)
        for automaton in (self._entries, self._phrases):
            if len(automaton):
                automaton.make_automaton()

    def hits(self, line: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight) of hits outside harmless phrases."""
        if not len(self._entries):
            return []
        found = [(end - len(entry) + 1, entry, weight) for end, (entry, weight) in self._entries.iter(line)]
        if found and len(self._phrases):
            spans = [(end - len(p) - 1, end) for end, p in self._phrases.iter(line)]
            found = [h for h in found if not any(a <= h[0] < b for a, b in spans)]
        return found

    def features(self, text: str) -> tuple[float, float]:
        words = folded_words(text)
        hits = self.hits(f" {' '.join(words)} ")
        # entries beginning at one place are one hit, by the greatest weight
        at: dict[int, tuple[float, str]] = {}
        for start, entry, weight in hits:
            at[start] = max((weight, entry), at.get(start, (0.0, "")))
        # an entry that is repeated adds by the logarithm of its count
        total = sum(weight * (1 + math.log(n)) for (weight, _), n in Counter(at.values()).items())
        return math.log1p(total), math.log1p(100 * total / (len(words) + 100))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        c0, c1, c2 = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, c0 + c1 * a + c2 * b))))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """Texts of the sampled labelled rows that may be learned from."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.filter(~held_out(F.col("doc_id"))), "tox-labels")
    chosen = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = bounded_sample(known.filter(F.col("toxic") == value), "doc_id", most, "toxicity")
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.col("doc_id").cast("long").alias("doc_id"))
    speaker = F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text")
    return _with_sketch(sample).groupBy("toxic", "sketch").agg(speaker).select("text", "toxic")


def _with_sketch(sample: DataFrame) -> DataFrame:
    """Adds the least shingle hash: copies share it, so one text speaks for all its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            lows = [s[0] if len(s) else 0 for s in map(shingler.distinct, batch.column(0).to_pylist())]
            sketch = pa.array(np.array(lows, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, sketch], names=["text", "toxic", "doc_id", "sketch"])

    return sample.select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id").mapInArrow(
        run, "text string, toxic int, doc_id long, sketch long"
    )


def _count(sample: DataFrame, find) -> DataFrame:
    """Texts in which ``find(words)`` yields an entry, by label: entry, toxic, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        look = find()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                counts.update((e, toxic.as_py()) for e in look(folded_words(text.as_py())))
        rows = list(counts.items())
        for at in range(0, len(rows), 50000):
            part = rows[at : at + 50000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _ in part], pa.string()),
                    pa.array([k[1] for k, _ in part], pa.int32()),
                    pa.array([n for _, n in part], pa.int64()),
                ],
                names=["entry", "toxic", "n"],
            )

    counted = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    return counted.mapInArrow(run, "entry string, toxic int, n long").groupBy("entry", "toxic").agg(F.sum("n").alias("n"))


def _known_entries(entries: list[str]):
    known = frozenset(entries)

    def find():
        return lambda words: _candidates(set(words)) & known

    return find


def _phrases_at_hits(lexicon: Lexicon):
    def find():
        matcher = lexicon.matcher()

        def look(words: list[str]) -> set[str]:
            line = f" {' '.join(words)} "
            found = set()
            starts = {start for start, _, _ in matcher.hits(line)}
            position = 0
            for k, word in enumerate(words):
                if position in starts:
                    if k:
                        found.add(f"{words[k - 1]} {word}")
                    if k + 1 < len(words):
                        found.add(f"{word} {words[k + 1]}")
                position += len(word) + 1
            return found

        return look

    return find


def _by_entry(rows) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r["entry"], [0, 0])[r["toxic"]] = r["n"]
    return found


def choose_entries(counts: dict[str, list[int]], n_clean: int, n_toxic: int, n_tried: int) -> dict[str, float]:
    """Entries with enough weight and evidence; an entry explained by chosen ones is left out.

    Evidence is the likelihood ratio of the entry's counts against the share of toxic
    texts; the bound grows with the number of candidates, so that rare words which met
    toxic texts by chance do not pass. Of equal candidates the longest stem is taken.
    """
    share = n_toxic / (n_toxic + n_clean)

    def weight(clean: int, toxic: int) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    def evidence(clean: int, toxic: int) -> float:
        n = clean + toxic
        return 2 * sum(k * math.log(k / (n * p)) for k, p in ((toxic, share), (clean, 1 - share)) if k)

    bound = EVIDENCE * math.log(max(n_tried, 2))
    least = max(MIN_DOCS, MIN_SHARE * n_toxic)

    def passes(clean: int, toxic: int) -> bool:
        return toxic >= least and weight(clean, toxic) >= MIN_WEIGHT and evidence(clean, toxic) >= bound

    good = {e: weight(*c) for e, c in counts.items() if passes(*c)}
    chosen: dict[str, float] = {}
    for entry in sorted(good, key=lambda e: (-counts[e][1] * good[e], e.endswith(" "), -len(e), e)):
        if any(entry[:n] in chosen for n in range(2, len(entry))):
            continue  # a chosen stem covers it
        covered = [e for e in chosen if e.startswith(entry)]
        if covered:
            toxic = counts[entry][1] - sum(counts[e][1] for e in covered)
            clean = counts[entry][0] - sum(counts[e][0] for e in covered)
            if not passes(max(clean, 0), max(toxic, 0)):
                continue
        chosen[entry] = good[entry]
    return chosen


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    theta = np.array([-2.0, 0.5, 0.5])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - y) + penalty @ theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(t) for t in theta)


def _features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [matcher.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for a, _ in found], pa.float64()),
                    pa.array([b for _, b in found], pa.float64()),
                    batch.column(1).cast(pa.int32()),
                ],
                names=["total", "density", "toxic"],
            )

    return sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "total double, density double, toxic int")


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """Fit a lexicon to labelled texts (docs: doc_id, text; labels: doc_id, toxic)."""
    base = {f" {w} ": BASE_WEIGHT for w in BASE_WORDS}
    source = docs.select(F.col("doc_id"), text_or_empty("text").alias("text"))
    sample = materialize(_labelled_sample(source, labels, max_toxic, max_clean), "tox-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon(base, BASE_EXCEPTIONS)

    least = max(MIN_DOCS, MIN_SHARE * n_toxic)
    seen = materialize(_count(sample.filter("toxic = 1"), lambda: lambda words: _candidates(set(words))), "tox-candidates")
    n_tried = seen.count()
    common = seen.filter(F.col("n") >= least).select("entry").collect()
    counts = _by_entry(_count(sample, _known_entries([r["entry"] for r in common] + list(base))).collect())
    weights = choose_entries(counts, n_clean, n_toxic, n_tried)
    for entry in base:  # listed words count unless labelled texts speak against them
        if not any(entry.startswith(e) for e in weights):
            clean, toxic = counts.get(entry, [0, 0])
            if clean == 0 or toxic / n_toxic > clean / n_clean:
                weights[entry] = BASE_WEIGHT

    lexicon = Lexicon(weights, BASE_EXCEPTIONS)
    phrases = _by_entry(_count(sample, _phrases_at_hits(lexicon)).filter(F.col("n") >= MIN_DOCS).collect())
    harmless = [p for p, (clean, toxic) in phrases.items() if clean >= MIN_DOCS and clean / n_clean > toxic / n_toxic]
    lexicon.exceptions = tuple(sorted({*BASE_EXCEPTIONS, *harmless}))

    rows = np.array([tuple(r) for r in _features(sample, lexicon).collect()], dtype=float).reshape(-1, 3)
    lexicon.curve = fit_curve(rows[:, :2], rows[:, 2])
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = BLOCK_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            scores = np.array([matcher.score(t.as_py()) for t in batch.column(1)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype("int32"), pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out")
    )
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = BLOCK_AT) -> DataFrame:
    """Rows whose score is below ``threshold``, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            clean = [matcher.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots cannot travel
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
