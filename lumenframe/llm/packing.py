"""Sequence packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; pieces that fill a
sequence stand alone, all others are packed by a grouping genetic algorithm: the
genes are whole sequences (bins). Crossover injects well-filled bins of one
parent into the other, removes the bins that would hold a document twice, and
puts the displaced documents back by best fit. Fitness is the number of bins,
then the sum of squared fills.

How it scales
-------------
* Texts are read once, tokenised by Arrow batches, and only (id, piece, length,
  checksum) rows go on, as a written table.
* Pieces are dealt by a hash of their row number to blocks of about
  ``block_size``: no key of the data decides where a row goes, so no hot key can
  swell a block, and a task holds one block's lengths.
* Each block evolves on ``islands`` separate tasks. Between epochs every island's
  elite moves to the next island of the ring through a written table, so a lost
  executor repeats one epoch of its islands. Random numbers are seeded by block,
  island and epoch: a repeated task gives the same result.

Defined results: null text counts as empty (one piece holding the end token
only); repeated rows are packed as often as they occur; null ids are carried;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

CAPACITY = 1024
END_ID = 2
BLOCK_SIZE = 16384
ISLANDS = 3
EPOCHS = 2
POPULATION = 3
OFFSPRING = 12
#: Bins at least this full may be injected by crossover.
WELL_FILLED = 0.98
#: Sequence numbers of a block start at block * BLOCK_STRIDE.
BLOCK_STRIDE = 1 << 22

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LONG_SPACE = re.compile(r"\s{2000}")


class Encoder:
    """Token ids of the byte-level BPE in ``json_path``.

    ``rank_path`` may name the same vocabulary as ranks, for a faster library that
    gives the same ids: both cut a text by the same pattern and merge bytes by the same
    ranks (the tests compare them on all documents and on hostile texts). They differ
    on texts that spell a special token, and on runs of white space beyond the other
    library's stack, so these go through ``json_path`` itself.
    """

    def __init__(self, json_path: str, rank_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(json_path)
        self._fast = None
        if rank_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(rank_path, "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
            self._fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
        self._special = [t.content for t in self._exact.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        if self._fast is None or any(s in text for s in self._special) or _LONG_SPACE.search(text):
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than capacity."""
    first = n_tokens % capacity or capacity
    bounds = [0, *range(first, n_tokens + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def tokenize(
    docs: DataFrame,
    json_path: str,
    rank_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_path, rank_path)
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array(encoder.ids(text.as_py()) + [end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id.as_py(), k, start, length, zlib.crc32(part.tobytes()))
                    for column, value in zip(columns, row):
                        column.append(value)
                    if with_ids:
                        columns[-1].append(part.astype("int32"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return out.mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


class _Bins:
    """Bins under best fit: a bit per residual says whether a bin has that room."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.members: list[list[int]] = []
        self.room: list[int] = []
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._mask = 0

    def add_bin(self, members: list[int]) -> None:
        left = self.capacity - sum(self.lengths[i] for i in members)
        self.members.append(members)
        self.room.append(left)
        self._offer(len(self.members) - 1, left)

    def _offer(self, bin_no: int, left: int) -> None:
        if left:
            self._open[left].append(bin_no)
            self._mask |= 1 << left

    def best_fit(self, order: list[int]) -> None:
        for i in order:
            need = self.lengths[i]
            fits = self._mask >> need
            if not fits:
                self.members.append([i])
                self.room.append(self.capacity - need)
                self._offer(len(self.members) - 1, self.capacity - need)
                continue
            left = need + (fits & -fits).bit_length() - 1
            bin_no = self._open[left].pop()
            if not self._open[left]:
                self._mask ^= 1 << left
            self.members[bin_no].append(i)
            self.room[bin_no] = left - need
            self._offer(bin_no, left - need)


def _fitness(room: list[int], capacity: int) -> tuple[int, int]:
    """Smaller is better: bins, then minus the sum of squared fills."""
    return len(room), -sum((capacity - r) ** 2 for r in room)


def _built(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int):
    made = _Bins(lengths, capacity)
    for members in bins:
        made.add_bin(list(members))
    made.best_fit(loose)
    return _fitness(made.room, capacity), made.members


def completed(loose: list[int], lengths: list[int], capacity: int, rng: random.Random | None = None) -> list[list[int]]:
    """Bins built around the longest documents left, each completed exactly where one or two others can.

    The room that is left is filled by one document of that length, else by two that
    add up to it, else by the longest that fits, and so on. ``rng`` shuffles documents
    of one length and picks among pairs.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in loose:
        stock[lengths[i]].append(i)
    have = np.array([bool(s) for s in stock])

    def take(length: int) -> int:
        i = stock[length].pop()
        if not stock[length]:
            have[length] = False
        return i

    bins = []
    longest = capacity
    while True:
        while longest and not have[longest]:
            longest -= 1
        if not longest:
            return bins
        members, room = [take(longest)], capacity - longest
        while room:
            if have[room]:
                members.append(take(room))
                break
            pairs = np.flatnonzero(have[1:room] & have[room - 1 : 0 : -1]) + 1
            pairs = pairs[pairs * 2 > room] if len(pairs) else pairs
            if len(pairs):
                long_one = int(pairs[-1] if rng is None else rng.choice(pairs[-4:]))
                members += [take(long_one), take(room - long_one)]
                break
            fits = np.flatnonzero(have[1 : room + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            members.append(take(length))
            room -= length
        bins.append(members)


def crossover(receiver: list[list[int]], donor: list[list[int]], lengths: list[int], capacity: int, rng: random.Random):
    """Inject a random share of the donor's well-filled bins into the receiver."""
    full = [b for b in donor if sum(lengths[i] for i in b) >= WELL_FILLED * capacity]
    if not full:
        full = sorted(donor, key=lambda b: -sum(lengths[i] for i in b))[: max(1, len(donor) // 4)]
    injected = rng.sample(full, max(1, int(len(full) * rng.uniform(0.2, 0.8))))
    taken = {i for b in injected for i in b}
    kept, loose = [], []
    for members in receiver:
        if taken.isdisjoint(members):
            kept.append(members)
        else:
            loose += [i for i in members if i not in taken]
    loose.sort(key=lambda i: -lengths[i])
    return _built(injected + kept, loose, lengths, capacity)


def mutate(parent: list[list[int]], lengths: list[int], capacity: int, rng: random.Random):
    """Open the emptiest bins and a few others, and complete new ones from their documents."""
    by_fill = sorted(parent, key=lambda b: sum(lengths[i] for i in b))
    opened = max(1, len(parent) // 20)
    kept = by_fill[opened:]
    loose = [i for b in by_fill[:opened] for i in b]
    rng.shuffle(kept)
    extra = min(len(kept), opened)
    loose += [i for b in kept[:extra] for i in b]
    rng.shuffle(loose)
    return _built(kept[extra:] + completed(loose, lengths, capacity, rng), [], lengths, capacity)


def evolve(
    lengths: list[int],
    capacity: int,
    seeds: list[list[list[int]]],
    rng: random.Random,
    population: int = POPULATION,
    offspring: int = OFFSPRING,
) -> tuple[tuple[int, int], list[list[int]]]:
    """Best (fitness, bins) of one island after one epoch."""
    floor = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [_built(bins, [], lengths, capacity) for bins in seeds]
    if not people:
        people.append(_built([], order, lengths, capacity))
        if people[0][0][0] > floor:
            people.append(_built(completed(order, lengths, capacity), [], lengths, capacity))
    while len(people) < population and min(people)[0][0] > floor:
        shaken = sorted(order, key=lambda i: -(lengths[i] + rng.uniform(0, capacity / 8)))
        people.append(_built([], shaken, lengths, capacity))
    for turn in range(offspring):
        if min(people)[0][0] <= floor:
            break
        if len(people) > 1 and turn % 2 == 0:
            receiver, donor = rng.sample(people, 2)
            child = crossover(receiver[1], donor[1], lengths, capacity, rng)
        else:
            child = mutate(min(people)[1], lengths, capacity, rng)
        people.append(child)
        people.sort(key=lambda p: p[0])
        del people[max(population, 1) :]
    return min(people, key=lambda p: p[0])


def _encode_bins(bins: list[list[int]], n: int) -> bytes:
    of = np.empty(n, dtype="<i4")
    for bin_no, members in enumerate(bins):
        of[members] = bin_no
    return of.tobytes()


def _decode_bins(raw: bytes) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, bin_no in enumerate(np.frombuffer(raw, dtype="<i4").tolist()):
        bins.setdefault(bin_no, []).append(i)
    return list(bins.values())


_ISLAND = "block long, island int, n_bins long, fitness long, elite binary"


def _epoch(islands: DataFrame, epoch: int, capacity: int, population: int, offspring: int) -> DataFrame:
    """islands: block, island, lengths array<int>, seeds array<binary>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                rng = random.Random(f"{row['block']}:{row['island']}:{epoch}")
                seeds = [_decode_bins(s) for s in row["seeds"]]
                if not epoch and row["island"]:  # islands start from different individuals
                    order = list(range(len(lengths)))
                    rng.shuffle(order)
                    seeds = [completed(order, lengths, capacity, rng)]
                (n_bins, squares), bins = evolve(lengths, capacity, seeds, rng, population, offspring)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "block": row["block"],
                            "island": row["island"],
                            "n_bins": n_bins,
                            "fitness": squares,
                            "elite": _encode_bins(bins, len(lengths)),
                        }
                    ],
                    schema=pa.schema(
                        [("block", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int64()), ("fitness", pa.int64()), ("elite", pa.binary())]
                    ),
                )

    return islands.mapInArrow(run, _ISLAND)


_PLACED = _PIECES + ", sequence_id long, offset long"


def _place(blocks: DataFrame) -> DataFrame:
    """blocks: block, members, elite; one row per piece with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                used: dict[int, int] = {}
                for member, bin_no in zip(row["members"], np.frombuffer(row["elite"], dtype="<i4").tolist()):
                    offset = used.get(bin_no, 0)
                    used[bin_no] = offset + member["length"]
                    out.append(
                        {
                            "doc_id": member["doc_id"],
                            "piece": member["piece"],
                            "start": member["start"],
                            "length": member["length"],
                            "ids_crc32": member["ids_crc32"],
                            "sequence_id": row["block"] * BLOCK_STRIDE + bin_no,
                            "offset": offset,
                        }
                    )
                yield pa.RecordBatch.from_pylist(
                    out,
                    schema=pa.schema(
                        [(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")]
                    ),
                )

    return blocks.mapInArrow(run, _PLACED)


def pack_pieces(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    block_size: int = BLOCK_SIZE,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    offspring: int = OFFSPRING,
) -> DataFrame:
    """Give every piece a sequence_id and an offset."""
    numbered = materialize(pieces.withColumn("row_no", F.monotonically_increasing_id()), "pack-pieces")
    whole = numbered.filter(F.col("length") >= capacity).select(
        *[c for c in pieces.columns],
        (-F.col("row_no") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = numbered.filter(F.col("length") < capacity)
    n_blocks = max(1, -(-rest.count() // block_size))
    member = F.struct(
        (-F.col("length")).alias("neg"), "row_no", "doc_id", "piece", "start", "length", "ids_crc32"
    )
    blocks = materialize(
        rest.groupBy(F.pmod(F.xxhash64("row_no"), F.lit(n_blocks)).alias("block")).agg(
            F.array_sort(F.collect_list(member)).alias("members")
        ),
        "pack-blocks",
    )
    # one task for each block and island
    spread = min(n_blocks * islands, 4096)
    lengths = blocks.select(
        "block", F.transform("members", lambda m: m["length"].cast("int")).alias("lengths")
    ).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = lengths.withColumn("seeds", F.array().cast("array<binary>")).repartition(spread, "block", "island")
    elites = materialize(_epoch(state, 0, capacity, population, offspring), "pack-epoch")
    for epoch in range(1, epochs):
        migrants = elites.select(
            "block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("migrant")
        )
        state = (
            lengths.join(elites.select("block", "island", "elite"), ["block", "island"])
            .join(migrants, ["block", "island"])
            .select("block", "island", "lengths", F.array("elite", "migrant").alias("seeds"))
            .repartition(spread, "block", "island")
        )
        before, elites = elites, materialize(_epoch(state, epoch, capacity, population, offspring), "pack-epoch")
        discard(before)
    best = elites.groupBy("block").agg(
        F.min(F.struct("n_bins", "fitness", "island", "elite")).alias("best")
    )
    placed = _place(blocks.join(best, "block").select("block", "members", F.col("best.elite").alias("elite")))
    return placed.unionByName(whole)


def pack_documents(
    docs: DataFrame, json_path: str, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Tokenise and pack whole documents."""
    capacity = options.get("capacity", CAPACITY)
    return pack_pieces(tokenize(docs, json_path, rank_path, id_col, text_col, capacity), **options)
