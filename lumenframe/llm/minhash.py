"""Near-duplicate classes: minima, banding, signature verification, components.

A document's set holds its distinct five-word shingles; a text of fewer words is
one shingle; a text without words has an empty set and is linked with nothing.
Two documents are linked when ``100 * intersection >= threshold * union``.

Method
------
1. One scan gives each document its set's size, a 128-bit key of the whole set, the
   hashes of ``bands`` bands of ``rows`` minima and four bits of each minimum. Documents
   with equal sets are one class, so copies never meet in pairs.
2. A band bucket matters if it holds two classes: least and greatest differ, a map-side
   aggregate. Only the four-bit signatures of classes in such buckets are dealt by bucket.
3. Classes of a bucket whose signatures may reach the threshold are joined by a spanning
   forest (of more than ``CROWD`` classes, in tasks of two parts). Components of all forests
   are families: two classes that share a bucket and may be linked are in one family.
4. A second scan reads the text of one document for each class in a family, chosen
   through a bitmap whose size is taken from their number (128 MiB at most). A text goes
   to its family, so it is shuffled once and not once for each bucket; sets are made there.
5. In a family, signatures of all pairs are compared; pairs that may reach the
   threshold are confirmed on full sets, unless links found before already join
   them. Only a spanning forest of the links leaves a task: at most one row for each
   member.
6. A family of more than ``block`` shingles is not taken whole. All its sets are first
   compared with one of them, the leader (it has the most edges in the forests, as the
   original of a family does). Those linked with it are joined already, so no pair of them
   needs a look; the others, in blocks, are compared with every block. A task holds two
   blocks however large a family grows.
7. Components by alternating large-star and small-star.

With 24 bands of 5 minima a pair at exactly 0.85 shares no band once in 1.3 million;
a pair that shares one is missed by signatures only 6 standard deviations off. No
bucket is capped or sampled. The work in one family grows with its classes (not its
copies) times those that are not linked with its leader; losing no link costs that.

Defined results: null text counts as empty; a null id keeps its row, is never a
representative while another id is there, and gets a null component if alone;
repeated rows are one class; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, discard, materialize, small_batches, text_or_empty
from .components import connected_components
from .exact_dedup import group_bitmap, mark_members
from .shingles import SHINGLE_WORDS, Minima, Shingler

BANDS = 24
ROWS = 5
THRESHOLD = 85
#: Shingles in one block of a large family, whatever the lengths of its texts.
BLOCK = 1 << 18
#: Classes of a bucket whose signatures one task compares with each other or with as many others.
CROWD = 1 << 12
#: Slots of small buckets in one group of a task.
DEAL = 1 << 10
#: Standard deviations that a signature may fall short of the threshold.
SLACK = 6
#: Nodes from here on stand for classes without any id.
NO_ID = 1 << 62


def set_key(distinct: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(distinct.tobytes())


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def _packed(minima: np.ndarray) -> bytes:
    """Four bits of each minimum, two to a byte."""
    bits = np.zeros(len(minima) + len(minima) % 2, np.uint8)
    bits[: len(minima)] = minima & 15
    return (bits[::2] | bits[1::2] << 4).tobytes()


def _unpacked(signatures: list[bytes], n_minima: int) -> np.ndarray:
    """A row of four-bit numbers for each signature."""
    pairs = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    return np.stack((pairs & 15, pairs >> 4), -1).reshape(len(signatures), -1)[:, :n_minima]


def prints(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key and signature (null for empty sets), buckets array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, minima = Shingler(words), Minima(bands * rows)
        for batch in small_batches(batches):
            sizes, keys, signatures, buckets = [], [], [], []
            for text in batch.column(1):
                distinct = shingler.distinct(text.as_py())
                sizes.append(len(distinct))
                if not len(distinct):
                    keys.append(None)
                    signatures.append(None)
                    buckets.append([])
                    continue
                keys.append(set_key(distinct))
                least = minima.of(distinct)
                signatures.append(_packed(least))
                low = least.reshape(bands, rows)
                buckets.append(np.array([xxhash.xxh3_64_intdigest(b.tobytes(), k) for k, b in enumerate(low)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature", "buckets"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, buckets array<long>")


def _texts(docs: DataFrame, words: int) -> DataFrame:
    """set_key and the text itself, compressed: less than half the bytes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, codec = Shingler(words), pa.Codec("zstd")
        for batch in small_batches(batches):
            keys, sizes, packed = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                raw = text.encode("utf-8", "surrogatepass")
                keys.append(set_key(shingler.distinct(text)))
                sizes.append(len(raw))
                packed.append(codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["set_key", "n_bytes", "packed"],
            )

    return docs.mapInArrow(run, "set_key binary, n_bytes long, packed binary")


def _set_of(packed: pa.Scalar, n_bytes: pa.Scalar, shingler: Shingler, codec: pa.Codec) -> np.ndarray:
    raw = codec.decompress(packed.as_buffer(), n_bytes.as_py(), asbytes=True)
    return shingler.distinct(raw.decode("utf-8", "surrogatepass"))


class _Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q


def _holders(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each shingle in order of sets, sets that hold shingle 0, 1, ..., where each shingle's list begins)."""
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    del hashes
    codes = np.empty(len(order), np.int32)
    codes[order] = np.cumsum(fresh, dtype=np.int32) - 1
    holders = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    return codes, holders, np.append(np.flatnonzero(fresh), len(order))


def _matches_needed(threshold: int, n_minima: int) -> float:
    """Equal minima that a pair at the threshold has, all but ``SLACK`` standard deviations."""
    j = threshold / 100
    return n_minima * j - SLACK * np.sqrt(n_minima * j * (1 - j))


def forest_candidates(signs: np.ndarray, sizes: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose signatures and sizes allow a link, breadth first.

    It starts at the set that agrees with the others most, so a family around an original
    is a star, and each step compares one set with those not yet reached.
    """
    need = _matches_needed(threshold, signs.shape[1])
    left = np.arange(len(sizes))
    if len(left) > 2:
        agreement = np.zeros(len(left), np.int64)
        for column in signs.T:
            agreement += np.bincount(column, minlength=16)[column]
        left = np.argsort(-agreement, kind="stable")
    edges, waiting = [], deque()
    while len(left):
        if waiting:
            i = waiting.popleft()
        else:
            i, left = int(left[0]), left[1:]
        near = (signs[left] == signs[i]).sum(1) >= need
        near &= (threshold * sizes[left] <= 100 * sizes[i]) & (threshold * sizes[i] <= 100 * sizes[left])
        found = left[near].tolist()
        edges += [(i, k) for k in found]
        waiting.extend(found)
        left = left[~near]
    return edges


def _candidates(classes: DataFrame, shared: DataFrame, threshold: int, n_minima: int, crowd: int) -> DataFrame:
    """classes: node, size, signature, buckets; shared: bucket, n; forests' edges (a, b) over all shared buckets.

    A bitmap tells which slots may be of shared buckets; a lone slot that it lets pass meets
    nothing. Groups hold many small buckets or one pair of parts of a crowded one.
    """
    n_shared, n_slots = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slot = F.pmod(F.xxhash64("bucket"), F.lit(bitmap_bits(n_shared))) + F.lit(1)
    bitmap = materialize(group_bitmap(shared, slot), "near-bitmap")
    slots = classes.select("node", "size", "signature", F.explode("buckets").alias("bucket"))
    slots = mark_members(slots, bitmap, slot, "meets").filter("meets").drop("meets")
    low = high = F.lit(0)
    crowded = shared.filter(F.col("n") > crowd).select("bucket", F.ceil(F.col("n") / F.lit(crowd)).cast("int").alias("n_parts"))
    if not crowded.isEmpty():  # at most slots / crowd rows
        slots = slots.join(F.broadcast(crowded), "bucket", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("n_parts", F.lit(1))))
        others = F.filter(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda k: k != F.col("part"))
        slots = slots.withColumn("other", F.explode(F.when(F.col("n_parts").isNull(), F.array(F.lit(0))).otherwise(others)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
    deals = -(-int(n_slots) // DEAL) or 1
    slots = slots.select("bucket", low.cast("int").alias("low"), high.cast("int").alias("high"), "node", "size", "signature")
    slots = slots.withColumn("deal", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(deals)))

    def run(table: pa.Table) -> pa.Table:
        keys = [table.column(k).to_numpy() for k in ("high", "low", "bucket")]
        order = np.lexsort(keys)
        keys = [k[order] for k in keys]
        fresh = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
        bounds = np.append(fresh, len(order))
        nodes, sizes = table.column("node").to_numpy(), table.column("size").to_numpy()
        signs = _unpacked(table.column("signature").to_pylist(), n_minima)
        ends: list[np.ndarray] = []
        for k in np.flatnonzero(np.diff(bounds) > 1):
            rows = order[bounds[k] : bounds[k + 1]]
            edges = forest_candidates(signs[rows], sizes[rows], threshold)
            if edges:
                ends.append(nodes[rows[np.array(edges)]])
        found = np.concatenate(ends) if ends else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return slots.groupBy("deal").applyInArrow(run, "a long, b long").filter("a <> b")


def forest_links(
    sets: list[np.ndarray], side: np.ndarray, threshold: int, minima: Minima, n_minima: int
) -> list[tuple[int, int]]:
    """Spanning forest of the links between sets of different sides (all, if one side)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    signs = np.stack([minima.of(s) for s in sets]).astype(np.uint8)
    need = _matches_needed(threshold, n_minima)
    codes, holders, starts = _holders(sets, sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    two_sides = side.min() != side.max()
    forest, links = _Forest(n), []
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        if two_sides:
            later = later[side[later] != side[i]]
        near = later[(signs[later] == signs[i]).sum(1) >= need]
        near = near[(threshold * sizes[near] <= 100 * sizes[i]) & (threshold * sizes[i] <= 100 * sizes[near])]
        if not len(near):
            continue
        roots = forest.roots()
        near = near[roots[near] != roots[i]]
        if not len(near):
            continue
        if len(near) <= 16:
            shared = np.array([np.intersect1d(sets[i], sets[k], assume_unique=True).size for k in near])
        else:  # overlaps with all members at once, from the lists of each shingle's holders
            own = codes[bounds[i] : bounds[i + 1]]
            own = own[starts[own + 1] - starts[own] > 1]
            lists = [holders[a:b] for a, b in zip(starts[own], starts[own + 1])]
            shared = np.bincount(np.concatenate(lists), minlength=n)[near] if lists else np.zeros(len(near), int)
        for k in near[100 * shared >= threshold * (sizes[i] + sizes[near] - shared)]:
            a, b = forest.root(i), forest.root(int(k))
            if a != b:
                forest.parent[max(a, b)] = min(a, b)
                links.append((i, int(k)))
    return links


def _links(tasks: DataFrame, threshold: int, n_minima: int, words: int) -> DataFrame:
    """tasks: family, low, high, part, node, set_key, n_bytes, packed; confirmed links (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        shingler, codec = Shingler(words), pa.Codec("zstd")
        nodes, keys = table.column("node").to_numpy(), table.column("set_key").to_pylist()
        order = list({(n, k): i for i, (n, k) in enumerate(zip(nodes.tolist(), keys))}.values())
        packed, n_bytes = table.column("packed"), table.column("n_bytes")
        sets = [_set_of(packed[k], n_bytes[k], shingler, codec) for k in order]
        parts = table.column("part").to_numpy()[order]
        nodes = nodes[order]
        found = forest_links(sets, parts, threshold, Minima(n_minima), n_minima) if len(sets) > 1 else []
        return pa.table(
            {
                "a": pa.array([nodes[i] for i, _ in found], pa.int64()),
                "b": pa.array([nodes[k] for _, k in found], pa.int64()),
            }
        )

    return tasks.groupBy("family", "low", "high").applyInArrow(run, "a long, b long")


def _stars(rows: DataFrame, threshold: int, words: int) -> DataFrame:
    """rows: family, set_key, node, size, n_parts, leader, texts of both; without the texts, but with ``linked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, codec = Shingler(words), pa.Codec("zstd")
        last, other = None, None
        for batch in small_batches(batches, 64):
            linked = []
            for k, family in enumerate(batch.column(0).to_pylist()):
                if family != last:
                    last, other = family, _set_of(batch.column(8)[k], batch.column(9)[k], shingler, codec)
                mine = _set_of(batch.column(6)[k], batch.column(7)[k], shingler, codec)
                shared = np.intersect1d(mine, other, assume_unique=True).size
                linked.append(bool(100 * shared >= threshold * (len(mine) + len(other) - shared)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(linked, pa.bool_())], names=["family", "set_key", "node", "size", "n_parts", "leader", "linked"]
            )

    columns = ("family", "set_key", "node", "size", "n_parts", "leader", "packed", "n_bytes", "leader_packed", "leader_n_bytes")
    return rows.select(*columns).mapInArrow(run, "family long, set_key binary, node long, size long, n_parts int, leader long, linked boolean")


def _large_families(
    members: DataFrame, degrees: DataFrame, texts: DataFrame, threshold: int, block: int, words: int
) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(links of each large family's leader: a, b; places of its sets: family, set_key, node, part, other; written tables)."""
    large = members.filter("n_parts > 1")
    best = F.max_by(F.struct("set_key", "node"), F.struct("degree", (-F.col("node")).alias("first")))
    leaders = large.join(degrees, "node").groupBy("family").agg(best.alias("l"))
    leaders = leaders.select("family", F.col("l.set_key").alias("set_key"), F.col("l.node").alias("leader")).join(texts, "set_key")
    leaders = leaders.select("family", "leader", F.col("packed").alias("leader_packed"), F.col("n_bytes").alias("leader_n_bytes"))
    leaders = materialize(leaders.dropDuplicates(["family"]), "near-leaders")
    stars = materialize(_stars(large.join(texts, "set_key").join(leaders, "family"), threshold, words).dropDuplicates(["set_key", "node"]), "near-stars")
    links = stars.filter("linked AND node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))

    rest = stars.filter("NOT linked").groupBy("family").agg(F.ceil(F.sum("size") / F.lit(block)).cast("int").alias("n_rest"))
    last = F.col("n_parts") + F.col("n_rest") - 1
    mixed = F.xxhash64("node")
    placed = stars.join(rest, "family").withColumns(
        {
            "part": F.when(F.col("linked"), F.pmod(mixed, F.col("n_parts"))).otherwise(F.col("n_parts") + F.pmod(mixed, F.col("n_rest"))).cast("int"),
            "other": F.explode(F.when(F.col("linked"), F.sequence("n_parts", last)).otherwise(F.sequence(F.lit(0), last))),
        }
    )
    return links, placed.select("family", "set_key", "node", "part", "other"), (leaders, stars)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    words: int = SHINGLE_WORDS,
    block: int = BLOCK,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    source = _source(docs, id_col, text_col)
    printed = materialize(prints(source, bands, rows, words), "near-prints")
    no_id = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("set_key"), 2)
    classes = printed.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"),
        F.min("n_shingles").alias("size"),
        F.first("signature").alias("signature"),
        F.first("buckets").alias("buckets"),
    )
    classes = materialize(classes.withColumn("node", F.coalesce("rep", no_id)), "near-classes")

    shared = (
        classes.select("node", F.explode("buckets").alias("bucket"))
        .groupBy("bucket")
        .agg(F.min("node").alias("least"), F.max("node").alias("greatest"), F.count("*").alias("n"))
        .filter("least <> greatest")
        .select("bucket", "n")
    )
    shared = materialize(shared, "near-buckets")
    edges = materialize(_candidates(classes, shared, threshold, bands * rows, crowd), "near-candidates")
    families = materialize(connected_components(edges), "near-families")
    known = classes.select("set_key", "rep", "size", "node").join(families.withColumnRenamed("component", "family"), "node")
    known = materialize(known, "near-members")
    sizes = known.groupBy("family").agg(F.ceil(F.sum("size") / F.lit(block)).cast("int").alias("n_parts"))
    members = materialize(known.join(sizes, "family"), "near-chosen")
    discard(shared, families, known)

    bits = bitmap_bits(members.count())
    slot = F.pmod(F.xxhash64("rep"), F.lit(bits)) + F.lit(1)
    wanted = materialize(group_bitmap(members, slot), "near-wanted")
    doc_slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + F.lit(1)
    read = mark_members(source, wanted, doc_slot, "wanted").filter("wanted").select("doc_id", "text")
    texts = materialize(_texts(read, words), "near-texts")

    nothing = F.lit(0)
    placed = members.filter("n_parts = 1").select("family", "set_key", "node", nothing.alias("part"), nothing.alias("other"))
    star_links, written = None, ()
    if not members.filter("n_parts > 1").isEmpty():  # else no text needs to be shuffled for it
        ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
        degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
        star_links, large, written = _large_families(members, degrees, texts, threshold, block, words)
        placed = placed.unionByName(large)
    tasks = placed.join(texts, "set_key").select(
        "family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "set_key", "n_bytes", "packed"
    )
    links = _links(tasks, threshold, bands * rows, words)
    links = materialize(links.unionByName(star_links) if star_links is not None else links, "near-links")
    discard(texts, members, wanted, edges, *written)
    components = materialize(connected_components(links), "near-components")

    joined_classes = classes.join(components, "node", "left").select(
        "set_key",
        F.coalesce("component", "node").alias("component"),
    )
    joined_classes = materialize(joined_classes, "near-labels")
    discard(links, components, classes)
    out = printed.select("doc_id", "n_shingles", "set_key").join(joined_classes, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).when(F.col("component") < NO_ID, F.col("component"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
