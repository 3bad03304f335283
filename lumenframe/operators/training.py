"""Features, random forests, permutation importance, degraded copies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators import kernels as K
from lumenframe.operators import ranked as R


def parts(batches: Iterator[pd.DataFrame], rows: int = 16) -> Iterator[pd.DataFrame]:
    """Slices of batches, so that few images are unpacked at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def object_features(objects: DataFrame, max_objects_per_class: int | None = None) -> DataFrame:
    """seq, object_index, class_id, features of objects joined with their image's pixels.

    ``objects``: seq, object_index, class_id, xc, yc, w, h, width, height, channels, data.
    Empty crops are dropped.
    """
    rows = objects if max_objects_per_class is None else R.capped(objects, "class_id", ["seq", "object_index"], max_objects_per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            out = []
            for r in batch.itertuples(index=False):
                if r.width <= 0:
                    continue
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                image = np.repeat(image, 3, axis=2) if r.channels == 1 else image[..., :3]
                patch = K.crop(image, r.xc, r.yc, r.w, r.h)
                if patch is not None:
                    out.append((r.seq, r.object_index, r.class_id, K.patch_features(patch).tolist()))
            yield pd.DataFrame(out, columns=["seq", "object_index", "class_id", "features"])

    return rows.mapInPandas(run, "seq long, object_index int, class_id int, features array<float>")


def baseline_features(images: DataFrame) -> DataFrame:
    """path, features (gradient and colour histograms) of decoded images; broken ones are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            out = []
            for r in batch.itertuples(index=False):
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                image = np.repeat(image, 3, axis=2) if r.channels == 1 else image[..., :3]
                out.append((r.path, np.concatenate([K.hog(K.to_gray(image)), K.color_histogram(image)]).tolist()))
            yield pd.DataFrame(out, columns=["path", "features"])

    return images.filter("width > 0").select("path", "width", "height", "channels", "data").mapInPandas(run, "path string, features array<float>")


def stratified_halves(rows: DataFrame, label: str, id_col: str, test: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the test share of each class."""
    keyed = rows.withColumn("seq", F.col(id_col).cast("long")).withColumn("split", F.lit(""))
    dealt = R.assign_splits(keyed, 1 - test, 0.0, test, stratify_by=label, seed=seed, overwrite=True)
    train = dealt.filter("new_split = 'train'").select(*rows.columns)
    return train, dealt.filter("new_split = 'test'").select(*rows.columns)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, weight: n / (classes x n of the class), so that classes count alike."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    n, k = rows.count(), counts.count()
    return counts.select(label, (F.lit(float(n)) / (F.lit(k) * F.col("_n"))).alias("weight"))


def train_forest(rows: DataFrame, label: str, features: str = "features", trees: int = 200, seed: int = 42, balanced: bool = True) -> RandomForestClassificationModel:
    """Random forest on an array column; balanced weights make classes count alike."""
    ready = rows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
    if balanced:
        ready = ready.join(class_weights(ready, "_y").withColumnRenamed("weight", "_weight"), "_y")
    else:
        ready = ready.withColumn("_weight", F.lit(1.0))
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_weight", numTrees=trees, seed=seed).fit(ready)


def predict(model: RandomForestClassificationModel, rows: DataFrame, features: str = "features") -> DataFrame:
    ready = rows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    out = model.transform(ready)
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("predicted"))


def importances(model: RandomForestClassificationModel, names: list[str]) -> list[tuple[str, float]]:
    """(feature, impurity importance), greatest first."""
    return sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda x: -x[1])


def permutation_importance(
    model: RandomForestClassificationModel, rows: DataFrame, label: str, n_features: int, repeats: int = 3, seed: int = 42
) -> list[tuple[int, float, float]]:
    """(feature number, mean and deviation of the loss of accuracy when its column is shuffled), greatest mean first.

    One job for all features: each row is repeated with one feature replaced by that of
    the row at a random other place, by a join on row numbers.
    """
    numbered = R.global_number(rows.withColumn("_u", S.uniform(seed, F.xxhash64(*rows.columns) % 1000003)), ["_u"], "_no", F.floor(F.col("_u") * 64))
    numbered = numbered.select(F.col("features"), F.col(label).alias("_label"), "_no").persist()
    n = numbered.count()
    right = F.avg((F.col("_label") == F.col("predicted")).cast("double"))
    base = predict(model, numbered).agg(right).first()[0]
    trials = numbered.crossJoin(rows.sparkSession.range(n_features).withColumnRenamed("id", "_feature")).crossJoin(
        rows.sparkSession.range(repeats).withColumnRenamed("id", "_repeat")
    )  # rows x features x repeats: the method's own work
    step = next(p for p in (7919, 7927) if n % p)  # without a common divisor the partners are a permutation
    partner = F.pmod(F.col("_no") * step + F.col("_feature") * 104729 + F.col("_repeat") * 1299709 + seed, F.lit(n)) + 1
    other = numbered.select(F.col("_no").alias("_partner"), F.col("features").alias("_other"))
    mixed = trials.withColumn("_partner", partner).join(other, "_partner")
    swapped = F.transform("features", lambda x, i: F.when(i == F.col("_feature"), F.get("_other", i)).otherwise(x))
    scored = predict(model, mixed.withColumn("features", swapped))
    losses = scored.groupBy("_feature", "_repeat").agg((F.lit(base) - right).alias("loss"))
    found = losses.groupBy("_feature").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std")).collect()  # one row per feature
    numbered.unpersist()
    return sorted(((r["_feature"], r["mean"], r["std"]) for r in found), key=lambda x: (-x[1], x[0]))


def importance_report(found: list[tuple[int, float, float]], names: list[str], top: int = 10) -> str:
    """The most important features as text."""
    lines = ["=" * 70, "Feature Importance (by permutation)", "=" * 70]
    return "\n".join(lines + [f"  {names[k]:20} {mean:+.4f}  (± {std:.4f})" for k, mean, std in found[:top]])


# -- degraded copies ---------------------------------------------------------


@dataclass(frozen=True)
class Level:
    name: str
    share: float
    annotations: bool = True
    labels: bool = True
    images: bool = True
    darken: bool = False


# Levels of degradation and the share of images they touch.
LEVELS = {
    level.name: level
    for level in (Level("clean", 0.0), Level("mild", 0.1), Level("moderate", 0.25), Level("severe", 0.5), Level("extreme", 0.75))
}


#: Only the pixels are damaged, by blur and darkening: what a score of image quality can see.
IMAGE_ONLY = Level("image_only", 0.5, annotations=False, labels=False, darken=True)


def touched_images(images: DataFrame, share: float, seed: int = 42, exclude_split: str = "test") -> DataFrame:
    """seq of exactly round(n x share) of the n images outside of one split, in a repeatable random order."""
    eligible = images.filter(~S.is_true(F.col("split") == exclude_split)).select("seq").withColumn("_u", S.uniform(seed, F.col("seq")))
    wanted = round(eligible.count() * share)
    placed = R.global_number(eligible, ["_u", "seq"], "_place", F.floor(F.col("_u") * 4096))
    return placed.filter(F.col("_place") <= wanted).select("seq")


def degraded_boxes(images: DataFrame, boxes: DataFrame, level: Level, seed: int = 42, exclude_split: str = "test") -> DataFrame:
    """Boxes with repeatable damage in a share of the images outside of one split.

    Half of a touched image's objects get a damaged box (collapsed to 0.001, or shifted
    by 0.3 to 0.6 and capped at 1.2), three in ten the name of another class.
    """
    names = sorted(r[0] for r in boxes.select("class_name").distinct().collect() if r[0] is not None)  # one row per class
    joined = boxes.join(touched_images(images, level.share, seed, exclude_split).withColumn("touched", F.lit(True)), "seq", "left")
    touched = S.is_true(F.col("touched"))
    roll = [S.uniform(seed + k, F.col("seq"), F.col("object_index")) for k in range(1, 7)]
    hit = touched & F.lit(level.annotations) & (roll[0] < 0.5)
    collapse = hit & (roll[1] < 0.5)
    shift = hit & (roll[1] >= 0.5)
    others = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: ~S.is_true(n == F.col("class_name")))
    relabel = touched & F.lit(level.labels) & (roll[4] < 0.3) & (F.size(others) > 0)

    def moved(value, r):
        return F.when(shift, F.least(F.lit(1.2), value + 0.3 + 0.3 * r)).otherwise(value)

    return joined.select(
        "seq",
        "object_index",
        "class_id",
        F.when(relabel, F.get(others, F.floor(roll[5] * F.size(others)).cast("int"))).otherwise(F.col("class_name")).alias("class_name"),
        moved(F.col("xc"), roll[2]).alias("xc"),
        moved(F.col("yc"), roll[3]).alias("yc"),
        F.when(collapse, 0.001).otherwise(F.col("w")).alias("w"),
        F.when(collapse, 0.001).otherwise(F.col("h")).alias("h"),
        (hit | relabel).alias("damaged"),
    )


def degraded_images(pixels: DataFrame, touched: DataFrame, level: Level, seed: int = 42) -> DataFrame:
    """seq, width, height, channels, data: pixels of touched images damaged, the others as they are."""
    flagged = pixels.join(touched.select("seq").withColumn("_touched", F.lit(True)), "seq", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            made = []
            for r in part.itertuples(index=False):
                data = r.data
                if r.touched and r.width > 0:
                    shape = (r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels)
                    rng = np.random.default_rng([seed, r.seq % (1 << 63)])
                    data = K.degrade(np.frombuffer(r.data, np.uint8).reshape(shape), rng, level.darken).tobytes()
                made.append(data)
            yield part[["seq", "width", "height", "channels"]].assign(data=made)

    damaged = S.is_true(F.col("_touched")) & F.lit(level.images)
    wanted = flagged.select("seq", "width", "height", "channels", "data", damaged.alias("touched"))
    return wanted.mapInPandas(run, "seq long, width int, height int, channels int, data binary")
