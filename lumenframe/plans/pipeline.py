"""Image preprocessing: a registry of steps, an ordered pipeline, one Arrow pass.

All enabled steps run on an image inside one ``mapInPandas`` call, so pixels cross to
Python once. A failing step is recorded and leaves the image unchanged (or ends the
pipeline for that image), and the row is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import kernels as K
from lumenframe.operators import pixels as P
from lumenframe.operators.training import parts

Step = Callable[[np.ndarray], np.ndarray]

# Channel means and deviations of a photographic corpus.
CORPUS_MEAN, CORPUS_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])

#: Order in which enabled steps run.
ORDER = ("quality", "resize", "clahe", "denoise", "sharpen", "color", "normalize")


class Registry:
    """Named step factories; names are case-insensitive and unique."""

    def __init__(self):
        self._made: dict[str, Callable[..., Step]] = {}

    @staticmethod
    def _key(name: str) -> str:
        return name.strip().lower()

    def register(self, name: str, factory: Callable[..., Step]) -> None:
        if not callable(factory):
            raise TypeError("a step factory must be callable")
        if self.exists(name):
            raise ValueError(f"step {name!r} is registered already")
        self._made[self._key(name)] = factory

    def unregister(self, name: str) -> None:
        self._made.pop(self._key(name), None)

    def exists(self, name: str) -> bool:
        return self._key(name) in self._made

    def get(self, name: str) -> Callable[..., Step]:
        return self._made[self._key(name)]

    def create(self, name: str, **options) -> Step:
        return self.get(name)(**options)

    def names(self) -> list[str]:
        return sorted(self._made)

    def clear(self) -> None:
        self._made.clear()


def _bound(f: Callable[..., np.ndarray]) -> Callable[..., Step]:
    return lambda **options: lambda image: f(image, **options)


def _keep(image: np.ndarray) -> np.ndarray:
    return image


def _resized(image: np.ndarray, width: int = 640, height: int = 640, keep_aspect_ratio: bool = True, method: str = "linear") -> np.ndarray:
    return (K.letterbox(image, width, height, method=method) if keep_aspect_ratio else K.resize(image, width, height, method))


def _denoised(image: np.ndarray, method: str = "gaussian", **options) -> np.ndarray:
    return {"gaussian": K.gaussian_blur, "median": K.median_blur, "bilateral": K.bilateral, "nlm": K.non_local_means}[method](image, **options)


def _sharpened(image: np.ndarray, method: str = "unsharp", **options) -> np.ndarray:
    return {"unsharp": K.unsharp_mask, "kernel": K.kernel_sharpen, "laplacian": K.laplacian_sharpen}[method](image, **options)


def _colored(
    image: np.ndarray, white_balance: bool = True, gamma: float = 1.0, brightness: float = 0.0, contrast: float = 1.0, saturation: float = 1.0, hue: float = 0.0
) -> np.ndarray:
    if image.ndim == 3 and white_balance:
        image = K.gray_world(image)
    if gamma != 1.0:
        image = K.gamma(image, gamma)
    if brightness:
        image = K.to_uint8(image + brightness)
    if contrast != 1.0:
        image = K.to_uint8((image - 127.5) * contrast + 127.5)
    if image.ndim == 3 and saturation != 1.0:
        image = K.adjust_saturation(image, saturation)
    return K.adjust_hue(image, hue) if image.ndim == 3 and hue else image


def _normalized(image: np.ndarray, method: str = "min_max", low: float = 0.0, high: float = 1.0) -> np.ndarray:
    x = image.astype(np.float32)
    if method == "min_max":
        span = float(x.max() - x.min())
        return (x - x.min()) / span * (high - low) + low if span else np.clip(x, low, high)
    if method == "unit":
        return x / 255
    if method == "z_score":
        return np.clip((x - x.mean()) / x.std() if x.std() else x, 0, 1)
    if method == "imagenet":
        return (x / 255 - CORPUS_MEAN) / CORPUS_STD
    raise ValueError(f"unknown method: {method}")


def normalizer(method: str) -> Step:
    return lambda image: _normalized(image, method)


def default_registry() -> Registry:
    registry = Registry()
    steps = {
        "quality": lambda image: _keep(image),
        "resize": _resized,
        "clahe": K.clahe,
        "denoise": _denoised,
        "sharpen": _sharpened,
        "color": _colored,
        "normalize": _normalized,
        "equalize": K.equalize,
        "match_histogram": K.match_histogram,
        "morphology": K.morphology,
        "macenko": K.macenko,
        "reinhard": K.reinhard,
        "standardize_brightness": K.standardize_brightness,
        "histogram": K.histogram_operation,
        "stain": K.stain_operation,
    }
    for name, f in steps.items():
        registry.register(name, _bound(f))
    return registry


def check_config(config: dict[str, dict], registry: Registry | None = None) -> None:
    """Raise where a step is unknown or an option is out of range."""
    unknown = set(config) - set((registry or default_registry()).names())
    if unknown:
        raise KeyError(f"unknown steps: {sorted(unknown)}")
    positive = {
        "resize": {"width": 640, "height": 640}, "clahe": {"clip_limit": 2.0, "grid": 8}, "denoise": {"size": 5}, "sharpen": {"size": 5}, "color": {"gamma": 1.0},
    }
    for step, options in positive.items():
        for name, default in options.items():
            if step in config and config[step].get(name, default) <= 0:
                raise ValueError(f"{step}: {name} must be greater than 0")
    if "histogram" in config:
        options = dict(config["histogram"])
        K.check_histogram_options(options.pop("operation", "histogram"), options)


def _prepared(name: str, options: dict) -> dict:
    """Options whose reference image is replaced by what its step needs of it, found once."""
    reference = options.get("reference")
    method = options.get("method") if name == "stain" else name
    if isinstance(reference, np.ndarray) and method in ("macenko", "reinhard"):
        return options | {"reference": K.stains_of(reference) if method == "macenko" else K.lab_moments(reference)}
    return options


@dataclass
class Pipeline:
    """Ordered steps with options; ``run`` handles one image, ``apply`` a DataFrame."""

    steps: list[tuple[str, Step]] = field(default_factory=list)
    continue_on_failure: bool = True

    @classmethod
    def from_config(cls, config: dict[str, dict], registry: Registry | None = None) -> Pipeline:
        """``config``: options of the enabled steps; they run in the fixed order."""
        registry = registry or default_registry()
        check_config(config, registry)
        names = [n for n in ORDER if n in config] + [n for n in config if n not in ORDER]
        return cls([(n, registry.create(n, **_prepared(n, config[n]))) for n in names])

    def summary(self) -> str:
        return " > ".join(self.names()) or "(empty)"

    def append(self, name: str, step: Step) -> None:
        self.steps.append((name, step))

    def insert(self, index: int, name: str, step: Step) -> None:
        self.steps.insert(index, (name, step))

    def remove(self, name: str) -> None:
        self.steps = [s for s in self.steps if s[0].lower() != name.lower()]

    def clear(self) -> None:
        self.steps = []

    def validate(self) -> None:
        if not self.steps:
            raise ValueError("no step is enabled")

    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def run(self, image: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        """(result, history of {step, status, seconds, message})."""
        history = []
        for name, step in self.steps:
            began = time.perf_counter()
            status, message = "SUCCESS", ""
            try:
                image = step(image)
            except Exception as error:  # recorded for the row, as the contract of a pipeline says
                status, message = "FAILED", str(error)
            history.append({"step": name, "status": status, "seconds": time.perf_counter() - began, "message": message})
            if status == "FAILED" and not self.continue_on_failure:
                break
        return image, history

    def apply(self, images: DataFrame) -> DataFrame:
        """images: path, width, height, channels, data (as the image scan gives); adds measures and history."""
        self.validate()
        pipeline = self
        names = ("brightness", "contrast", "dynamic_range", "entropy", "blur_score", "sharpness", "noise_level")
        schema = (
            "path string, width int, height int, channels int, data binary, dtype string, passed boolean, error string, "
            "history array<struct<step: string, status: string, seconds: double, message: string>>, " + ", ".join(f"{n} double" for n in names)
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in parts(batches):
                out = []
                for row in batch.itertuples(index=False):
                    made = {"path": row.path, "width": -1, "height": -1, "channels": -1, "data": None, "dtype": None, "passed": False, "error": "corrupted", "history": []}
                    made |= dict.fromkeys(names)
                    if row.width > 0:
                        shape = (row.height, row.width) if row.channels == 1 else (row.height, row.width, row.channels)
                        image = np.frombuffer(row.data, np.uint8).reshape(shape)
                        measured = K.measures(image)
                        image, history = pipeline.run(image)
                        failed = [h["message"] for h in history if h["status"] == "FAILED"]
                        made |= measured | {
                            "height": image.shape[0],
                            "width": image.shape[1],
                            "channels": 1 if image.ndim == 2 else image.shape[2],
                            "data": np.ascontiguousarray(image).tobytes(),
                            "dtype": image.dtype.name,
                            "passed": not failed,
                            "error": "; ".join(failed) or None,
                            "history": history,
                        }
                    out.append(made)
                yield pd.DataFrame(out)

        return images.select("path", "width", "height", "channels", "data").mapInPandas(run, schema)


def run_report(processed: DataFrame) -> DataFrame:
    """One row: images, passed, failed, steps applied and failed, success percent."""
    per_row = processed.withColumns(
        {
            "n_steps": F.size("history"),
            "n_failed_steps": F.size(F.filter("history", lambda h: h["status"] == "FAILED")),
        }
    )
    return per_row.agg(
        F.count("*").alias("n_images"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.sum("n_steps").alias("n_steps"),
        F.sum("n_failed_steps").alias("n_failed_steps"),
        F.round(F.count_if("passed") * 100.0 / F.count("*"), 2).alias("success_percent"),
    )


def assess(images: DataFrame, cached: DataFrame | None = None, thresholds: P.Thresholds = P.Thresholds()) -> DataFrame:
    """path, measures, quality_score, issues, passed, corrupted, source of images.

    ``cached`` has results of an earlier run by path (as ``Pipeline.apply`` gives them,
    with quality_score and issues): those images are not measured again.
    """
    names = ("brightness", "contrast", "blur_score", "entropy")
    if cached is None:
        measured = Pipeline.from_config({"quality": {}}).apply(images)
        score = P.quality_score(*[F.col(n) for n in names], thresholds)
        scored = measured.withColumn("quality_score", score)
        m = {n: F.col(n) for n in (*names, "quality_score")}
        corrupted = F.col("width") < 0
        issues = F.when(corrupted, F.array(F.lit("corrupted"))).otherwise(P.quality_issues(m, thresholds))
        out = scored.select("path", *names, "quality_score", issues.alias("issues"), corrupted.alias("corrupted"))
        return out.withColumns({"passed": F.size("issues") == 0, "source": F.lit("measured")})
    known = cached.select("path", *names, "quality_score", "issues", "corrupted", "passed", F.lit("cached").alias("source"))
    fresh = assess(images.join(cached.select("path"), "path", "left_anti"), None, thresholds)
    return fresh.unionByName(known.join(images.select("path"), "path", "left_semi"))
