"""Dataset statistics in the three variants that callers know, and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators.dataset import object_counts


def with_object_counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    joined = images.join(object_counts(boxes), "seq", "left")
    return joined.withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))


def dataset_statistics(images: DataFrame, boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, objects per image, and sizes; sizes of 0 or null are left out."""
    width, height = F.nullif(F.col("width"), F.lit(0)), F.nullif(F.col("height"), F.lit(0))
    counted = with_object_counts(images, boxes)
    grouped = counted.groupBy(*by) if by else counted.groupBy()
    return grouped.agg(
        F.count("*").alias("n_images"),
        F.sum("n_objects").cast("long").alias("n_objects"),
        F.round(F.avg("n_objects"), 3).alias("mean_objects"),
        F.min("n_objects").alias("min_objects"),
        F.max("n_objects").alias("max_objects"),
        F.round(F.avg(width), 3).alias("mean_width"),
        F.min(width).alias("min_width"),
        F.max(width).alias("max_width"),
        F.round(F.avg(height), 3).alias("mean_height"),
        F.min(height).alias("min_height"),
        F.max(height).alias("max_height"),
    )


def class_balance(boxes: DataFrame) -> DataFrame:
    """Share of each class among all objects, at 4 places."""
    counts = boxes.groupBy("class_name").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4)
    return counts.select("class_name", "n", share.alias("share"))


def split_counts(images: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("unassigned"))
    return images.groupBy(name.alias("split")).agg(F.count("*").alias("n"))


def summary(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: images, objects, datasets, classes."""
    a = images.agg(F.count("*").alias("n_images"), F.countDistinct("dataset").alias("n_datasets"))
    b = boxes.agg(F.count("*").alias("n_objects"), F.countDistinct("class_name").alias("n_classes"))
    return a.crossJoin(b)  # one row each


def v1_statistics(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row; averages include sizes of 0."""
    a = images.agg(
        F.count("*").alias("n_images"),
        F.coalesce(F.round(F.avg("width"), 4), F.lit(0.0)).alias("average_width"),
        F.coalesce(F.round(F.avg("height"), 4), F.lit(0.0)).alias("average_height"),
    )
    b = boxes.agg(F.count("*").alias("n_objects"), F.countDistinct("class_name").alias("n_classes"))
    both = a.crossJoin(b)  # one row each
    return both.withColumn("objects_per_image", F.round(S.safe_divide(F.col("n_objects"), F.col("n_images")), 4))


def v2_image_statistics(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per dataset; sizes include 0."""
    return (
        with_object_counts(images, boxes)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("n_images"),
            F.sum("n_objects").cast("long").alias("n_objects"),
            F.min("width").alias("min_width"),
            F.max("width").alias("max_width"),
            F.round(F.avg("width"), 4).alias("mean_width"),
            F.min("height").alias("min_height"),
            F.max("height").alias("max_height"),
            F.round(F.avg("height"), 4).alias("mean_height"),
            F.min("n_objects").alias("min_objects"),
            F.max("n_objects").alias("max_objects"),
            F.count_if(F.col("n_objects") == 0).alias("n_empty"),
        )
    )


def v2_box_statistics(boxes: DataFrame) -> DataFrame:
    """Sides and areas by class; ``area`` is the stored one, ``side_area`` the derived."""
    sides = F.col("w") * F.col("h")
    out = []
    for name, value in (("w", F.col("w")), ("h", F.col("h")), ("area", F.col("area")), ("side_area", sides)):
        out += [
            F.round(F.min(value), 6).alias(f"min_{name}"),
            F.round(F.max(value), 6).alias(f"max_{name}"),
            F.round(F.avg(value), 6).alias(f"mean_{name}"),
        ]
    return boxes.groupBy("class_id").agg(F.count("*").alias("n"), *out)


def extension_histogram(images: DataFrame) -> DataFrame:
    suffix = S.bare_extension(F.col("image_path"))
    return images.groupBy(suffix.alias("extension")).agg(F.count("*").alias("n")).filter("extension IS NOT NULL")


def modal_extension(images: DataFrame) -> DataFrame:
    """The most frequent suffix, the first seen of equals."""
    counted = images.groupBy(S.extension(F.col("image_path")).alias("extension")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )
    return counted.orderBy(F.desc("n"), "first_seq").limit(1).select("extension", "n")


def distributions(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """kind, value, n for datasets, splits and classes."""
    parts = [(images, "dataset"), (images, "split"), (boxes, "class_name")]
    out = None
    for rows, column in parts:
        part = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(column).alias("kind"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def object_class_counts(boxes: DataFrame) -> DataFrame:
    """Objects by class name, or by id where the name is empty."""
    name = F.when(S.is_blank(F.col("class_name")), F.col("class_id").cast("string")).otherwise(F.col("class_name"))
    return boxes.groupBy(name.alias("class")).agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def precision_recall_f1(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, F1 and support; 0 where a denominator is 0."""
    cells = confusion_matrix(rows, label, predicted)
    hits = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    true = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), hits.alias("hits"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("n_predicted"))
    both = true.join(said, "class", "full").na.fill(0, ["support", "hits", "n_predicted"])
    p = S.safe_divide(F.col("hits"), F.col("n_predicted"))
    r = S.safe_divide(F.col("hits"), F.col("support"))
    return both.select(
        "class",
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(S.safe_divide(2 * p * r, p + r), 4).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col(label) == F.col(predicted)).cast("int")), 4).alias("accuracy"))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson, and Spearman over average ranks.

    Ranks come from counts by value: smaller values' running count plus half of the
    value's own. Distinct values are ordered within ranges, and the sizes of earlier
    ranges are added, so no task orders all values.
    """

    def ranks(column: str, name: str) -> DataFrame:
        counts = rows.groupBy(column).agg(F.count("*").alias("n")).withColumn("_range", S.value_range(F.col(column)))
        sizes = counts.groupBy("_range").agg(F.sum("n").alias("_n"))
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        before = Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("_start") + F.coalesce(F.sum("n").over(before), F.lit(0))
        return counts.join(starts, "_range").select(column, (below + (F.col("n") + 1) / 2.0).alias(name))

    ranked = rows.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranked.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    return ranked.agg(F.round(F.corr(x, y), 6).alias("pearson"), F.round(F.corr("_rx", "_ry"), 6).alias("spearman"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.select(label, "n", F.round(weight, 6).alias("weight"))


def top_reasons(issues: DataFrame, column: str, n: int) -> DataFrame:
    return issues.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)

