import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenframe.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_encoder_agrees_with_the_exact_one():
    fast, exact = P.Encoder(JSON, RANKS), P.Encoder(JSON)
    rng = random.Random(4)
    texts = ["", "a <|endoftext|> b", " " * 5000 + "x", "a" * 3000, "naïve café  é\n\n\tx"]
    texts += ["".join(chr(rng.choice((32, 10, 97, rng.randrange(0xD800), 0x1F600))) for _ in range(60)) for _ in range(500)]
    assert all(fast.ids(t) == exact.ids(t) for t in texts)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut(n):
    pieces = P.cut(n, 1024)
    assert sum(length for _, length in pieces) == n and all(length == 1024 for _, length in pieces[1:])
    assert [start for start, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))]


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pack_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randrange(1, 1500))) for _ in range(80)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "x " * 30000), (7, texts[7]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, length string")
    found = P.pack_documents(docs, JSON, RANKS, block_size=40).collect()
    exact = P.Encoder(JSON)
    wanted = []
    for i, t in rows:
        ids = exact.ids(t or "") + [2]
        wanted += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(P.cut(len(ids), 1024))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(wanted, key=repr)
    total = sum(r.length for r in found)
    assert check_places(found, 1024) <= -(-total // 1024) + 4


def test_pack_empty_and_equal_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(empty, JSON, RANKS).count() == 0
    pieces = spark.createDataFrame([(k, 0, 0, 300, 1) for k in range(100)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert check_places(P.pack_pieces(pieces).collect(), 1024) == 34


@pytest.mark.parametrize("seed", range(5))
def test_evolution_never_loses_or_doubles(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 1024) for _ in range(300)]
    (n_bins, _), bins = P.evolve(lengths, 1024, [], rng)
    assert sorted(i for b in bins for i in b) == list(range(300)) and n_bins == len(bins)
    assert all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    assert n_bins <= len(P._built([], sorted(range(300), key=lambda i: -lengths[i]), lengths, 1024)[1])
    child = P.crossover(bins, P._built([], list(range(300)), lengths, 1024)[1], lengths, 1024, rng)[1]
    assert sorted(i for b in child for i in b) == list(range(300))
    assert P._decode_bins(P._encode_bins(bins, 300)) and len(P._decode_bins(P._encode_bins(bins, 300))) == n_bins


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are absent")
def test_encoder_agrees_on_all_documents():
    import pyarrow.parquet as pq

    fast, exact = P.Encoder(JSON, RANKS), P.Encoder(JSON)
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert fast.ids(text or "") == exact.ids(text or "")


def test_evolution_beats_best_fit_where_best_fit_is_poor():
    rng = random.Random(1)
    lengths = [rng.randrange(260, 500) for _ in range(4000)]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best_fit = P._built([], order, lengths, 1024)[0][0]
    (n_bins, _), bins = P.evolve(lengths, 1024, [], random.Random(1))
    assert n_bins <= 0.985 * best_fit and sorted(i for b in bins for i in b) == list(range(4000))
