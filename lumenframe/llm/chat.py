"""Chat formatting with cumulative-snapshot collapse (built-in functions only).

Chat logs often hold a conversation once for every turn it had so far. A rolling hash
of each prefix of turns identifies a logged conversation that is a prefix of a longer
one (or equal to one with a smaller id); an anti-join keeps maximal conversations, and
only those are rendered.

Rolling hashes: a turn's two 64-bit hashes cover its position, role and text; the hash
of a prefix is their exclusive or, so it is built from partial results. Turns are
ranged by (conversation, turn, digest, a random number), so neither a conversation of
very many turns nor all repeats of one turn fall to one task; a turn's place is its
place in its range and the number of its conversation's turns in earlier ranges. From
there on turns are dealt in chunks of ``chunk`` positions: running hashes within a
chunk, one total per chunk carried on.

How it scales: prefixes are reduced to (length, hash, longest conversation) with
map-side combine before they are shuffled, so thousands of conversations with one
first turn give one row; joins are between written tables, which adaptive execution
splits. A kept conversation is rendered in parts of ``chunk`` turns.

Defined results: null role and text count as empty; turns are ordered by turn (nulls
last), then by the MD5 of role, line end and text; equal rows stay as repeated turns; rows with a
null conv_id are one conversation; of equal conversations the smallest id stays (null
last); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

CHUNK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def positions(turns: DataFrame, chunk: int) -> DataFrame:
    """Turns with their place in the conversation (``pos``, from 0) and their ``chunk_no``."""
    turn = F.col("turn").cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        turn.isNull().alias("no_turn"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.md5(F.concat_ws("\n", "role", "text")))
    # the number only splits equal rows, which may stand in any order
    order = ["conv_id", "no_turn", "turn", "digest", "any_no"]
    rows = rows.withColumn("any_no", F.xxhash64(F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = materialize(
        ranged.select(
            "conv_id",
            "role",
            "text",
            F.shiftright(place, 33).cast("int").alias("part"),
            place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        ),
        "chat-ranged",
    )
    spans = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    spans = materialize(spans, "chat-spans")
    placed = ranged.join(spans, (ranged["part"] == spans["p"]) & ranged["conv_id"].eqNullSafe(spans["c"]))
    pos = F.col("at") + F.col("shift")
    placed = materialize(
        placed.select("conv_id", "role", "text", pos.alias("pos"), F.floor(pos / chunk).alias("chunk_no")), "chat-placed"
    )
    discard(ranged, spans)
    return placed


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, length and the two hashes (x, y) of every prefix of turns."""
    turn = placed.select(
        "conv_id",
        "chunk_no",
        "pos",
        F.xxhash64("pos", "role", "text").alias("hx"),
        F.xxhash64("text", "role", F.lit("second"), "pos").alias("hy"),
    )
    running = Window.partitionBy("conv_id", "chunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = turn.select(
        "conv_id",
        "chunk_no",
        (F.col("pos") + 1).alias("length"),
        F.bit_xor("hx").over(running).alias("wx"),
        F.bit_xor("hy").over(running).alias("wy"),
    )
    totals = turn.groupBy("conv_id", "chunk_no").agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(
        totals.select(
            F.col("conv_id").alias("c"),
            F.col("chunk_no").alias("k"),
            F.coalesce(F.bit_xor("tx").over(earlier), F.lit(0)).alias("cx"),
            F.coalesce(F.bit_xor("ty").over(earlier), F.lit(0)).alias("cy"),
        ),
        "chat-carried",
    )
    joined = within.join(carried, within["conv_id"].eqNullSafe(carried["c"]) & (within["chunk_no"] == carried["k"]))
    return joined.select(
        "conv_id",
        "length",
        F.col("wx").bitwiseXOR(F.col("cx")).alias("x"),
        F.col("wy").bitwiseXOR(F.col("cy")).alias("y"),
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id and length of conversations that are no prefix of another one."""
    lengths = materialize(prefixes.groupBy("conv_id").agg(F.max("length").alias("n_turns")), "chat-lengths")
    sized = prefixes.join(
        lengths.select(F.col("conv_id").alias("c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c"))
    ).drop("c")
    sized = materialize(sized, "chat-sized")
    reach = sized.groupBy("length", "x", "y").agg(F.max("n_turns").alias("longest"))
    whole = sized.filter("length = n_turns")
    first = whole.groupBy("length", "x", "y").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id")).alias("first")
    )
    extended = materialize(reach.filter("longest > length").select("length", "x", "y"), "chat-extended")
    kept = first.join(extended, ["length", "x", "y"], "left_anti")
    return kept.select(F.col("first.conv_id").alias("conv_id"), F.col("length").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE), F.lit("\n"))


def collapse_and_render(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Maximal conversations in parts: conv_id, part, n_turns, text."""
    placed = positions(turns, chunk)
    kept = materialize(maximal_conversations(prefix_hashes(placed)), "chat-kept")
    kept = kept.select(F.col("conv_id").alias("c"), "n_turns")
    mine = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    parts = mine.groupBy("conv_id", F.col("chunk_no").cast("int").alias("part"), "n_turns").agg(
        F.array_sort(F.collect_list(F.struct("pos", rendered(F.col("role"), F.col("text")).alias("line")))).alias("lines")
    )
    text = F.concat_ws("", F.transform("lines", lambda x: x["line"]))
    return parts.select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), text.alias("text"))
