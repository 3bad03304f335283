"""Measures and point transforms of pixel arrays.

``pixels`` is an array of numbers in row order. Point transforms are array functions in
the JVM, one step a pixel. What needs histograms or neighbourhoods runs the kernels on
Arrow batches, once for each tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators import kernels as K


def total(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x)


def brightness(pixels: Column) -> Column:
    return total(pixels) / F.size(pixels)


def variance(pixels: Column) -> Column:
    """Population variance from integer sums."""
    squares = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x * x)
    mean = brightness(pixels)
    return F.greatest(F.lit(0.0), squares / F.size(pixels) - mean * mean)


def contrast(pixels: Column) -> Column:
    return F.sqrt(variance(pixels))


def dynamic_range(pixels: Column) -> Column:
    return F.array_max(pixels) - F.array_min(pixels)


def median(pixels: Column) -> Column:
    n = F.size(pixels)
    ordered = F.array_sort(pixels)
    return (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2.0


#: Measures that ``kernels.measures`` gives.
MEASURES = ("brightness", "contrast", "dynamic_range", "entropy", "blur_score", "sharpness", "noise_level")


def measures(pixels: Column, side: int) -> Column:
    """All measures of square gray tiles as one struct."""

    def of(tiles: pd.Series) -> pd.DataFrame:
        rows = [K.measures(np.asarray(t, np.uint8).reshape(side, side)) for t in tiles]
        return pd.DataFrame(rows, columns=list(MEASURES))

    return F.pandas_udf(of, "struct<" + ", ".join(f"{m}: double" for m in MEASURES) + ">")(pixels)


def kernel(tiles: DataFrame, f: Callable[[np.ndarray], np.ndarray], side: int, key: str = "vec_id", pixels: str = "pixels", channels: int = 1) -> DataFrame:
    """key, channel, place, value of what ``f`` makes of each tile.

    Pixels of colour tiles follow each other as blue, green, red; ``f`` may give an array
    of any shape of rows, columns (and channels).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (side, side) if channels == 1 else (side, side, channels)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [np.asarray(f(np.array(p.as_py(), np.uint8).reshape(shape))) for p in part.column(1)]
                flat = [m.reshape(m.shape[0] * m.shape[1], -1) if m.ndim > 1 else m.reshape(-1, 1) for m in made]
                sizes = [m.size for m in flat]
                places = [np.indices(m.shape).reshape(2, -1) for m in flat]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes), pa.int64()),
                        pa.array(np.concatenate([p[1] for p in places]), pa.int32()),
                        pa.array(np.concatenate([p[0] for p in places]), pa.int32()),
                        pa.array(np.concatenate([m.ravel() for m in flat]).astype(float), pa.float64()),
                    ],
                    names=[key, "channel", "place", "value"],
                )

    wanted = tiles.select(F.col(key).cast("long").alias(key), F.col(pixels).cast("array<int>").alias(pixels))
    return wanted.mapInArrow(run, f"{key} long, channel int, place int, value double")


@dataclass(frozen=True)
class Thresholds:
    minimum_brightness: float = 20.0
    maximum_brightness: float = 235.0
    minimum_contrast: float = 20.0
    minimum_sharpness: float = 50.0
    maximum_blur: float = 200.0
    minimum_entropy: float = 3.0
    minimum_quality_score: float = 70.0


def quality_score(brightness_: Column, contrast_: Column, blur: Column, entropy_: Column, t: Thresholds = Thresholds()) -> Column:
    """Mean of four scores between 0 and 100: how well a tile clears each threshold."""
    low, high = F.lit(t.minimum_brightness), F.lit(t.maximum_brightness)
    off = F.least(F.abs(brightness_ - low), F.abs(brightness_ - high))
    light = F.when(brightness_.between(low, high), 100.0).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - off))

    def reach(value: Column, threshold: float) -> Column:
        return F.least(F.lit(100.0), 100.0 * value / threshold) if threshold > 0 else F.lit(100.0)

    parts = light + reach(contrast_, t.minimum_contrast) + reach(blur, t.maximum_blur) + reach(entropy_, t.minimum_entropy)
    return F.round(parts / 4.0, 2)


def quality_issues(m: dict[str, Column], t: Thresholds = Thresholds(), with_sharpness: bool = False) -> Column:
    """Issue codes in order; ``m``: brightness, contrast, blur_score, entropy, quality_score (and sharpness)."""
    checks = [
        (m["brightness"] < t.minimum_brightness, "brightness_too_low"),
        (m["brightness"] > t.maximum_brightness, "brightness_too_high"),
        (m["contrast"] < t.minimum_contrast, "contrast_too_low"),
    ]
    if with_sharpness:
        checks.append((m["sharpness"] < t.minimum_sharpness, "sharpness_too_low"))
    checks += [
        (m["blur_score"] < t.maximum_blur, "blurry"),
        (m["entropy"] < t.minimum_entropy, "entropy_too_low"),
        (m["quality_score"] < t.minimum_quality_score, "quality_score_below_threshold"),
    ]
    return F.array_compact(F.array(*[F.when(S.is_true(c), F.lit(code)) for c, code in checks]))


def measured(tiles: DataFrame, side: int, t: Thresholds = Thresholds()) -> DataFrame:
    """All measures of each tile as columns, rounded to 4 places, with score and issues."""
    m = measures(F.col("pixels"), side)
    out = tiles.withColumn("_measured", m).select(
        "*",
        *[F.round(F.col(f"_measured.{n}"), 4).alias(n) for n in MEASURES if n != "dynamic_range"],
        F.col("_measured.dynamic_range").cast("int").alias("dynamic_range"),
    )
    out = out.drop("_measured")
    score = quality_score(F.col("brightness"), F.col("contrast"), F.col("blur_score"), F.col("entropy"), t)
    out = out.withColumn("quality_score", score)
    names = ("brightness", "contrast", "blur_score", "entropy", "quality_score")
    return out.withColumn("issues", quality_issues({n: F.col(n) for n in names}, t))


def assessment_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals over measured rows; a row passes without issues. Mean score over all rows."""
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    passed = F.size("issues") == 0
    return grouped.agg(
        F.count("*").alias("n_total"),
        F.count_if(passed).alias("n_passed"),
        F.count_if(~passed).alias("n_failed"),
        F.round(F.avg("quality_score"), 2).alias("mean_score"),
        F.round(F.count_if(passed) * 100.0 / F.count("*"), 2).alias("pass_percent"),
    )


def gate_report(rows: DataFrame, minimum: float, by: list[str] | None = None) -> DataFrame:
    """Totals of a gate on the score alone: mean, least and greatest over scored rows; rate as a share."""
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    score = F.col("quality_score")
    passed = S.is_true(score >= minimum)
    return grouped.agg(
        F.count("*").alias("n_total"),
        F.count_if(passed).alias("n_passed"),
        F.count_if(~passed).alias("n_failed"),
        F.count_if(score.isNull()).alias("n_corrupted"),
        F.round(F.avg(score), 2).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.round(F.count_if(passed) * 1.0 / F.count("*"), 4).alias("pass_rate"),
    )


def issue_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


# -- point transforms --------------------------------------------------------


def as_uint8(value: Column) -> Column:
    """Clipped to 0..255 and truncated, as a cast of clipped floats to bytes."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(value).cast("int")))


def each(pixels: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(pixels, f)


def min_max_normalize(pixels: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """To [low, high]; a constant tile is only clipped."""
    least, span = F.array_min(pixels).cast("double"), dynamic_range(pixels).cast("double")
    return each(
        pixels,
        lambda x: F.when(span > 0, (x - least) / F.nullif(span, F.lit(0.0)) * (high - low) + low).otherwise(S.clamp(x.cast("double"), low, high)),
    )


def unit_scale(pixels: Column) -> Column:
    return each(pixels, lambda x: x / 255.0)


def z_score(pixels: Column, clip: bool = True) -> Column:
    """Standardised, then clipped to [0, 1]; a constant tile is left as it is."""
    mean, std = brightness(pixels), contrast(pixels)

    def one(x: Column) -> Column:
        z = F.when(std > 0, (x - mean) / F.nullif(std, F.lit(0.0))).otherwise(x.cast("double"))
        return S.clamp(z, 0.0, 1.0) if clip else z

    return each(pixels, one)


def standardize(pixels: Column, mean: float, std: float) -> Column:
    """(x / 255 - mean) / std with a std of 0 taken as 1."""
    return each(pixels, lambda x: (x / 255.0 - mean) / (std or 1.0))


def gamma(pixels: Column, g: float) -> Column:
    if g <= 0:
        raise ValueError("gamma must be positive")
    return each(pixels, lambda x: as_uint8(F.pow(x / 255.0, F.lit(1.0 / g)) * 255.0))


def gamma_table(g: float) -> Column:
    return gamma(F.sequence(F.lit(0), F.lit(255)), g)


def look_up(pixels: Column, table: Column) -> Column:
    return each(pixels, lambda x: F.get(table, x.cast("int")))


def add_brightness(pixels: Column, b: float) -> Column:
    return each(pixels, lambda x: as_uint8(x + F.lit(float(b))))


def scale_contrast(pixels: Column, c: float) -> Column:
    return each(pixels, lambda x: as_uint8((x - 127.5) * c + 127.5))


def contrast_stretch(pixels: Column, low: int, high: int) -> Column:
    if high <= low:
        raise ValueError("upper bound must exceed lower bound")
    return each(pixels, lambda x: as_uint8((x - low) * (255.0 / (high - low))))


def histogram_stretch(pixels: Column) -> Column:
    least, span = F.array_min(pixels), dynamic_range(pixels)
    return each(pixels, lambda x: F.when(span > 0, as_uint8((x - least) * 255.0 / F.nullif(span, F.lit(0)))).otherwise(x))


def brightness_normalize(pixels: Column, target: float = 128.0) -> Column:
    mean = brightness(pixels)
    return each(pixels, lambda x: F.when(mean > 0, as_uint8(x * (F.lit(target) / F.nullif(mean, F.lit(0.0))))).otherwise(x))


def optical_density(pixels: Column) -> Column:
    return each(pixels, lambda x: -F.ln(F.greatest(x, F.lit(1)) / 255.0))


def from_optical_density(density: Column) -> Column:
    return each(density, lambda d: as_uint8(F.exp(-d) * 255.0))


def gray_world(channels: list[Column]) -> list[Column]:
    """Channels scaled to their common mean."""
    means = [brightness(c) for c in channels]
    common = sum(means, F.lit(0.0)) / len(means)
    return [
        each(c, lambda x, m=m: F.when(m > 0, as_uint8(x * (common / F.nullif(m, F.lit(0.0))))).otherwise(x)) for c, m in zip(channels, means)
    ]


def rows_unit_length(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return each(vector, lambda x: F.when(norm > 0, x / F.nullif(norm, F.lit(0.0))).otherwise(x))
