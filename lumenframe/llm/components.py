"""Connected components by alternating large-star and small-star.

Defined results: an edge with a null end joins nothing and is ignored; a node whose
only edge is to itself is its own component; repeated and reversed edges count once;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link each node's larger neighbours to the least of the node and its neighbours (and the minima's table)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link each node and its smaller neighbours to the least of them (and the minima's table)."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))), least


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long).

    The component is its least node. Each half-round is a written table; minima
    are aggregated before they are shuffled and joined back to plain scans, so a
    hub is split by adaptive execution. Stops when a round changes nothing.
    """

    def tidy(rows: DataFrame) -> DataFrame:
        return rows.filter("a <> b").distinct()

    def mark(rows: DataFrame):
        return rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    current = materialize(tidy(edges), "cc-edges")
    before = mark(current)
    for _ in range(max_rounds):
        moved, least = _large_star(current)
        large = materialize(tidy(moved), "cc-large")
        discard(current, least)
        moved, least = _small_star(large)
        current = materialize(tidy(moved), "cc-small")
        discard(large, least)
        after = mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    # at the fixed point every edge leads from a node to its component's least node
    ends = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    linked = ends.unionByName(roots)
    return linked.unionByName(alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
