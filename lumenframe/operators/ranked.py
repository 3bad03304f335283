"""Order-dependent operators: splits, first-seen duplicates, caps, relabelling.

Global row numbers are taken in two steps (rank within ranges of the order, plus the
sizes of earlier ranges), so no operator sorts a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S


def global_number(rows: DataFrame, order: list[str], name: str, buckets: Column) -> DataFrame:
    """Consecutive numbers from 1 over all rows in ``order``.

    ``buckets`` is a non-decreasing function of the order (such as a range of its first
    column): rows are ranked within a bucket, and bucket sizes are summed beforehand.
    """
    dealt = rows.withColumn("_bucket", buckets)
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside)).join(starts, "_bucket")
    return ranked.withColumn(name, F.col("_start") + F.col("_rank")).drop("_bucket", "_rank", "_start")


def split_bounds(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Ends of the train and val shares of n rows (ties to even, as Python rounds)."""
    n_train = F.bround(n * F.lit(train)).cast("long")
    n_val = F.bround(n * F.lit(val)).cast("long")
    return n_train, n_train + n_val


def assign_splits(
    images: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    stratify_by: str | None = "dataset",
    seed: int = 42,
    overwrite: bool = False,
) -> DataFrame:
    """Column ``new_split``: shares of each stratum in a repeatable random order.

    Without ``overwrite`` only rows whose split is null, empty or ``train`` (the
    default of a new image) are dealt; the rest keep theirs. The order is by a
    number from (seed, seq). A stratum is ranked in 256 ranges of that number, so a
    single stratum of all rows still spreads over tasks.
    """
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("train, val and test must sum to 1")
    free = F.lit(True) if overwrite else F.coalesce(F.col("split").isin("", "train"), F.lit(True))
    stratum = F.coalesce(F.col(stratify_by).cast("string"), F.lit("")) if stratify_by else F.lit("")
    keyed = images.withColumns({"_u": S.uniform(seed, F.col("seq")), "_free": free, "_stratum": stratum})
    todo = keyed.filter("_free").withColumn("_range", F.floor(F.col("_u") * 256).cast("int"))
    sizes = todo.groupBy("_stratum", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_stratum").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "_stratum",
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("_stratum")).alias("_total"),
    )
    inside = Window.partitionBy("_stratum", "_range").orderBy("_u", "seq")
    placed = todo.withColumn("_rank", F.row_number().over(inside)).join(sizes, ["_stratum", "_range"])
    at = F.col("_start") + F.col("_rank")
    end_train, end_val = split_bounds(F.col("_total"), train, val)
    new = F.when(at <= end_train, "train").when(at <= end_val, "val").otherwise("test")
    dealt = placed.withColumn("new_split", new).drop("_range", "_start", "_total", "_rank")
    kept = keyed.filter("NOT _free").withColumn("new_split", F.col("split"))
    return dealt.unionByName(kept).drop("_u", "_free", "_stratum")


def first_seen(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Column ``is_repeat``: not the first row of its keys.

    Firsts are found by an aggregate with map-side combine, so a key with very many rows
    is never sorted in one task; only those of keys that do repeat are joined back, so
    where repeats are few the rows are not shuffled.
    """
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    keyed = rows.withColumns(named)
    firsts = keyed.groupBy(*named).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    condition = None
    for name in named:
        equal = keyed[name].eqNullSafe(firsts[name])
        condition = equal if condition is None else condition & equal
    joined = keyed.join(firsts, condition, "left")
    return joined.select(
        *[keyed[c] for c in rows.columns], S.is_true(F.struct(*[keyed[o] for o in order]) != F.col("_first")).alias("is_repeat")
    )


def capped(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key (Spark keeps n rows a key before the shuffle)."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def capped_random(rows: DataFrame, key: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each key in a repeatable random order."""
    return capped(rows.withColumn("_u", S.uniform(seed, F.col(id_col))), key, ["_u", id_col], n).drop("_u")


def contiguous_classes(boxes: DataFrame) -> DataFrame:
    """class_id, new_id: ranks of the class ids in use, from 0 (one row per class)."""
    used = boxes.select("class_id").distinct()
    return used.withColumn("new_id", F.row_number().over(Window.orderBy("class_id")) - 1)


def relabel(boxes: DataFrame) -> DataFrame:
    return boxes.join(contiguous_classes(boxes), "class_id")


def issue_ids(issues: DataFrame, prefix: str = "VAL") -> DataFrame:
    """Issue ids in rule order: stage, image, rule, object; ranked within ranges of (stage, image)."""
    ranges = F.col("stage").cast("long") * F.lit(1 << 32) + F.coalesce(S.value_range(F.col("seq")), F.lit(-(1 << 31)))
    numbered = global_number(issues, ["stage", "seq", "rule_no", "object_index"], "_no", ranges)
    return numbered.withColumn("issue_id", F.format_string(f"{prefix}-%06d", F.col("_no"))).drop("_no")


def cumulative(histogram: DataFrame, group: str, bin_col: str, count_col: str) -> DataFrame:
    """Running counts of each group's histogram (at most one row per bin)."""
    window = Window.partitionBy(group).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("cumulative", F.sum(count_col).over(window))
