"""Kernels against values worked out by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import kernels as K
from lumenframe.operators import training as M


def color(seed=0, size=16):
    return np.random.default_rng(seed).integers(0, 256, (size, size, 3)).astype(np.uint8)


def one(b, g, r):
    return np.array([[[b, g, r]]], np.uint8)


@pytest.mark.parametrize(
    ("bgr", "lab", "hsv", "gray"),
    [
        ((0, 0, 255), (136, 208, 195), (0, 255, 255), 76), ((0, 255, 0), (224, 42, 211), (60, 255, 255), 150), ((255, 0, 0), (82, 207, 20), (120, 255, 255), 29),
        ((255, 255, 255), (255, 128, 128), (0, 0, 255), 255), ((0, 0, 0), (0, 128, 128), (0, 0, 0), 0), ((128, 128, 128), (137, 128, 128), (0, 0, 128), 128),
    ],
)
def test_colour_spaces_at_known_points(bgr, lab, hsv, gray):
    image = one(*bgr)
    assert tuple(K.to_lab(image)[0, 0]) == lab and tuple(K.to_hsv(image)[0, 0]) == hsv and K.to_gray(image)[0, 0] == gray
    assert np.abs(K.from_lab(K.to_lab(image)).astype(int) - image).max() <= 8  # bytes are coarse for dark channels


def test_lab_round_trip_and_lightness_only():
    image = color(3, 32)
    assert np.abs(K.from_lab(K.to_lab(image)).astype(int) - image).max() <= 20 and np.abs(K.from_lab(K.to_lab(image)).astype(int) - image).mean() < 1.5
    seen = []
    K.on_lightness(image, lambda c: (seen.append(c.copy()), c)[1])
    assert np.array_equal(seen[0], K.to_lab(image)[..., 0])
    flat = np.full((8, 8, 3), (40, 90, 200), np.uint8)
    brighter = K.standardize_brightness(flat)
    assert K.to_lab(brighter)[0, 0, 0] == 255 or brighter.max() == 255


def test_reinhard_moves_moments_to_the_references():
    image, reference = color(1, 32) // 3 + 60, color(2, 32) // 4 + 100
    wanted, found = K.lab_moments(reference), K.lab_moments(K.reinhard(image, reference))
    assert np.abs(found.mean - wanted.mean).max() < 2.5 and np.abs(found.std - wanted.std).max() < 3
    assert np.array_equal(K.reinhard(image, reference), K.reinhard(image, wanted))
    for bad, error in ((None, ValueError), (reference[..., 0], ValueError), (reference.astype(float), TypeError), (reference[:0], ValueError)):
        with pytest.raises(error):
            K.lab_moments(bad)


def test_macenko_by_singular_vectors():
    rng = np.random.default_rng(5)
    stains = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]])
    stains /= np.linalg.norm(stains, axis=1, keepdims=True)

    def slide(scale):
        amount = rng.uniform(0.1, 1.0, (900, 2)) * (rng.random((900, 2)) < 0.8) * scale + 0.08
        return K.from_optical_density(amount @ stains).reshape(30, 30, 3)

    image, reference = slide((0.8, 0.9)), slide((1.3, 0.6))

    def estimated(x):
        density = -np.log(np.maximum(x.reshape(-1, 3).astype(float), 1) / 255)
        mask = (density > 0.15).any(1)
        inside = density[mask]
        _, _, right = np.linalg.svd(inside - inside.mean(0), full_matrices=False)
        plane = np.array([v if v.sum() >= 0 else -v for v in right[:2]])
        angles = np.arctan2(inside @ plane[1], inside @ plane[0])
        ends = [np.cos(a) * plane[0] + np.sin(a) * plane[1] for a in np.percentile(angles, [1, 99])]
        ends = np.array(sorted((e / np.linalg.norm(e) for e in ends), key=lambda e: -e[0]))
        amounts = np.array([np.linalg.solve(ends @ ends.T, ends @ d) for d in inside])
        return mask, ends, amounts, np.percentile(amounts, 99, axis=0)

    mask, _, amounts, most = estimated(image)
    _, wanted, _, wanted_most = estimated(reference)
    by_hand = image.reshape(-1, 3).copy()
    by_hand[mask] = np.clip(255 * np.exp(-(amounts * (wanted_most / most)) @ wanted), 0, 255).astype(np.uint8)
    found = K.macenko(image, reference)
    assert np.abs(found.reshape(-1, 3).astype(int) - by_hand).max() <= 1
    assert np.array_equal(found, K.macenko(image, K.stains_of(reference)))
    with pytest.raises(ValueError):
        K.valid_density(np.full((5, 3), np.nan))
    with pytest.raises(ValueError):
        K.valid_density(np.zeros((5, 2)))


def test_background():
    image = np.concatenate([np.full((2, 4, 3), 250, np.uint8), np.full((3, 4, 3), 90, np.uint8)])
    assert K.background_mask(image).sum() == 12 and K.without_background(image).shape == (12, 3)


def mirrored(c, r, k):
    h, w = c.shape
    r = -r if r < 0 else 2 * h - 2 - r if r >= h else r
    k = -k if k < 0 else 2 * w - 2 - k if k >= w else k
    return float(c[r, k])


def test_blurs_by_loops():
    c = color(7, 9)[..., 0]
    line = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.1**2))
    line /= line.sum()
    near, soft, means = np.zeros(c.shape), np.zeros(c.shape), np.zeros(c.shape)
    for r in range(9):
        for k in range(9):
            soft[r, k] = sum(line[i + 2] * line[j + 2] * mirrored(c, r + i, k + j) for i in range(-2, 3) for j in range(-2, 3))
            weights = {(i, j): math.exp(-(i * i + j * j) / 800) * math.exp(-((mirrored(c, r + i, k + j) - c[r, k]) ** 2) / 1800) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4}
            near[r, k] = sum(w * mirrored(c, r + i, k + j) for (i, j), w in weights.items()) / sum(weights.values())
            means[r, k] = np.median([mirrored(c, r + i, k + j) for i in range(-2, 3) for j in range(-2, 3)])
    assert np.abs(K.gaussian_blur(c, 5, 1.1) - soft).max() <= 0.5 + 1e-9
    assert np.abs(K.bilateral(c, 5, 30, 20) - near).max() <= 0.5 + 1e-9
    assert np.array_equal(K.median_blur(c, 5), means)
    assert K.gaussian_blur(c, 171).std() <= 1.0 and abs(float(K.gaussian_blur(c, 171).mean()) - c.mean()) < 6


def test_non_local_means_by_loops():
    c = color(8, 10)[..., 0]
    reach, half, h = 2, 1, 25.0
    padded = np.pad(c.astype(float), reach, mode="reflect")
    out = np.zeros(c.shape)
    for r in range(10):
        for k in range(10):
            total = weights = 0.0
            for i in range(-reach, reach + 1):
                for j in range(-reach, reach + 1):
                    moved = padded[reach + i : reach + i + 10, reach + j : reach + j + 10]
                    apart = (moved - c) ** 2
                    d = np.mean([mirrored(apart, r + a, k + b) for a in range(-half, half + 1) for b in range(-half, half + 1)])
                    w = math.exp(-d / h**2)
                    total += w * moved[r, k]
                    weights += w
            out[r, k] = total / weights
    assert np.abs(K.non_local_means(c, h, 3, 5) - out).max() <= 0.5 + 1e-9


def test_sharpening():
    image = color(9, 8)
    gray = K.to_gray(image)
    for r in range(8):
        for k in range(8):
            edge = sum(mirrored(gray, r + i, k + j) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * float(gray[r, k])
            wanted = np.clip(image[r, k] - 1.5 * edge, 0, 255).astype(np.uint8)
            assert np.array_equal(K.laplacian_sharpen(image, 1.5)[r, k], wanted)


def test_clahe_by_loops():
    c = color(10, 16)[..., 0]
    tables = {}
    for i in range(2):
        for k in range(2):
            tile = c[8 * i : 8 * i + 8, 8 * k : 8 * k + 8].ravel().tolist()
            most = max(1.0, 40 * 64 / 256)
            counts = [min(tile.count(v), most) for v in range(256)]
            over = sum(max(0, tile.count(v) - most) for v in range(256))
            tables[i, k] = np.cumsum([n + over / 256 for n in counts]) * 255 / 64
    for r in range(16):
        for k in range(16):
            y, x = min(max((r + 0.5) / 8 - 0.5, 0), 1), min(max((k + 0.5) / 8 - 0.5, 0), 1)
            value = sum(tables[i, j][c[r, k]] * (y if i else 1 - y) * (x if j else 1 - x) for i in range(2) for j in range(2))
            assert abs(int(K.clahe(c, 40, 2)[r, k]) - value) <= 0.5 + 1e-9


@pytest.mark.parametrize(
    ("shape", "size", "rows"),
    [("cross", 3, ["010", "111", "010"]), ("ellipse", 3, ["010", "111", "010"]), ("ellipse", 5, ["00100", "11111", "11111", "11111", "00100"]), ("rectangle", 3, ["111"] * 3)],
)
def test_elements(shape, size, rows):
    assert K.element(shape, size).astype(int).tolist() == [[int(x) for x in row] for row in rows]


def test_canny_finds_the_outline_of_a_square():
    image = np.full((20, 20), 20, np.uint8)
    image[6:14, 6:14] = 220
    edges = K.canny(image)
    assert edges[6:14, 5:7].any(1).all() and edges[6:14, 13:15].any(1).all() and edges[5:7, 6:14].any(0).all()
    assert not edges[:4].any() and not edges[8:12, 8:12].any() and 20 <= edges.sum() <= 40
    assert not K.canny(np.full((9, 9), 77, np.uint8)).any()
    faint = np.zeros((12, 12), np.uint8)
    faint[:, 6:] = 35  # gradient 140: above the lower bound only
    assert not K.canny(faint).any()
    faint[3, 6:] = 90
    assert K.canny(faint).sum() > 5  # a strong place carries the faint edge


def test_patch_features_in_order():
    patch = color(12, 64)
    found = dict(zip(K.FEATURE_NAMES, K.patch_features(patch)))
    assert len(found) == 18
    for k, name in enumerate("BGR"):
        assert found[f"{name}_mean"] == pytest.approx(patch[..., k].mean(), rel=1e-5) and found[f"{name}_std"] == pytest.approx(patch[..., k].std(), rel=1e-5)
    gray = K.to_gray(patch)
    share = [n / gray.size for n in np.unique(gray, return_counts=True)[1]]
    assert found["gray_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in share), rel=1e-5) and found["gray_std"] == pytest.approx(gray.std(), rel=1e-5)
    hues = [found[f"hue_{k}"] for k in range(8)]
    assert sum(hues) == pytest.approx(1, abs=1e-5) and found["edge_density"] == pytest.approx(K.canny(gray).mean())
    red = K.patch_features(np.full((9, 9, 3), (0, 0, 200), np.uint8))
    assert red[9] == pytest.approx(1) and red[17] == 0


def test_gradient_histograms_by_loops():
    gray = color(13, 64)[..., 0]
    cells = np.zeros((8, 8, 9))
    for r in range(64):
        for k in range(64):
            gx, gy = mirrored(gray, r, k + 1) - mirrored(gray, r, k - 1), mirrored(gray, r + 1, k) - mirrored(gray, r - 1, k)
            cells[r // 8, k // 8, int(math.degrees(math.atan2(gy, gx)) % 180 / 20) % 9] += math.hypot(gx, gy)
    blocks = [cells[i : i + 2, j : j + 2].transpose(2, 0, 1).ravel() for i in range(7) for j in range(7)]
    wanted = np.concatenate([b / math.sqrt((b**2).sum() + 1e-6) for b in blocks])
    assert np.abs(np.sort(K.hog(gray)) - np.sort(wanted)).max() < 1e-4


def test_degradation():
    image = color(14, 40)
    noisy, dark = (K.degrade(image, np.random.default_rng(1), darken) for darken in (False, True))
    assert dark.mean() < 0.11 * image.mean() and dark.std() < 3
    residue = noisy.astype(float) - K.gaussian_blur(image, 15)
    assert 25 < residue.std() < 45
    assert np.array_equal(noisy, K.degrade(image, np.random.default_rng(1)))


def test_degraded_images_touch_only_the_share(spark):
    images = spark.range(41).select(F.col("id").alias("seq"), F.when(F.col("id") < 11, "test").otherwise("train").alias("split"))
    level = M.LEVELS["severe"]
    touched = M.touched_images(images, level.share)
    found = {r.seq for r in touched.collect()}
    assert len(found) == 15 and min(found) >= 11 and found == {r.seq for r in M.touched_images(images.repartition(5), level.share).collect()}
    data = bytearray(color(2, 12).tobytes())
    pixels = spark.createDataFrame([(k, 12, 12, 3, data) for k in range(41)], "seq long, width int, height int, channels int, data binary")
    out = {r.seq: bytes(r.data) for r in M.degraded_images(pixels, touched, level).collect()}
    assert len(out) == 41 and {k for k, d in out.items() if d != bytes(data)} == found
    assert all(d == bytes(data) for d in (bytes(r.data) for r in M.degraded_images(pixels, touched, M.Level("x", 0.5, images=False)).collect()))


def test_image_only_damage_darkens(spark):
    images = spark.range(10).select(F.col("id").alias("seq"), F.lit("train").alias("split"))
    data = bytearray(color(2, 12).tobytes())
    pixels = spark.createDataFrame([(k, 12, 12, 3, data) for k in range(10)], "seq long, width int, height int, channels int, data binary")
    touched = M.touched_images(images, M.IMAGE_ONLY.share)
    out = {r.seq: np.frombuffer(r.data, np.uint8).mean() for r in M.degraded_images(pixels, touched, M.IMAGE_ONLY).collect()}
    dark = {k for k, mean in out.items() if mean < 20}
    assert len(dark) == 5 and dark == {r.seq for r in touched.collect()}
    boxes = images.select("seq", F.lit(0).alias("object_index"), F.lit(1).alias("class_id"), F.lit("a").alias("class_name"), *[F.lit(0.5).alias(c) for c in ("xc", "yc", "w", "h")])
    assert M.degraded_boxes(images, boxes, M.IMAGE_ONLY).filter("damaged").count() == 0


def test_baseline_features(spark):
    image = color(5, 20)
    rows = [("a", 20, 20, 3, bytearray(image.tobytes())), ("g", 4, 4, 1, bytearray(bytes(range(16)))), ("broken", -1, -1, -1, None)]
    found = {r.path: r.features for r in M.baseline_features(spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")).collect()}
    assert set(found) == {"a", "g"} and len(found["a"]) == 1764 + 48
    assert np.allclose(found["a"], np.concatenate([K.hog(K.to_gray(image)), K.color_histogram(image)]), atol=1e-6)


def test_degraded_names_are_other_classes(spark):
    images = spark.range(60).select(F.col("id").alias("seq"), F.lit("train").alias("split"))
    boxes = images.crossJoin(spark.range(4).withColumnRenamed("id", "object_index")).select(
        "seq", F.col("object_index").cast("int").alias("object_index"), F.lit(1).alias("class_id"), F.when(F.col("object_index") == 0, "a").when(F.col("object_index") == 1, "b").otherwise("c").alias("class_name"),
        *[F.lit(0.5).alias(c) for c in ("xc", "yc", "w", "h")],
    )
    before = {(r.seq, r.object_index): r.class_name for r in boxes.collect()}
    found = M.degraded_boxes(images, boxes, M.LEVELS["extreme"]).collect()
    changed = [r for r in found if r.class_name != before[r.seq, r.object_index]]
    assert changed and {r.class_name for r in changed} == {"a", "b", "c"} and all(r.damaged and r.class_id == 1 for r in changed)
    touched = {r.seq for r in found if r.damaged}
    assert len(touched) <= 45 and len(changed) < len(found) / 2
    alone = boxes.filter("class_name = 'a'")
    assert {r.class_name for r in M.degraded_boxes(images, alone, M.LEVELS["extreme"]).collect()} == {"a"}


def test_activation_map_and_overlay():
    act, grad = np.random.default_rng(3).normal(size=(2, 3, 4, 5))
    wanted = np.maximum(sum(grad[k].mean() * act[k] for k in range(3)), 0)
    wanted = (wanted - wanted.min()) / (wanted.max() - wanted.min() + 1e-8)
    found = K.class_activation_map(act, grad)
    assert np.abs(found - wanted).max() < 1e-6 and found.shape == (4, 5)
    image = np.full((8, 10, 3), 100, np.uint8)
    over = K.heatmap_overlay(found, image)
    assert over.shape == image.shape and np.array_equal(K.heatmap_overlay(np.zeros((2, 2)), image)[0, 0], [round(0.5 * 255 * 0.4 + 60), 60, 60])
    assert K.rainbow(np.array([0.25, 0.5, 0.75])).tolist() == [[255, 128, 0], [128, 255, 128], [0, 128, 255]]


def test_histogram_and_stain_steps():
    image = color(15, 12)
    gray = K.to_gray(image)
    assert np.array_equal(K.histogram_operation(image, "equalize"), K.equalize(image)) and np.array_equal(K.histogram_operation(gray, "histogram"), gray)
    assert np.array_equal(K.histogram_operation(gray, "gamma", gamma=2.0), K.gamma(gray, 2.0)) and K.histogram_operation(gray, "brightness", target=60).mean() < 61
    spread = K.histogram_operation(gray // 4 + 50, "stretch")
    assert spread.min() == 0 and spread.max() == 255 and np.array_equal(K.histogram_operation(np.full((2, 2), 9, np.uint8), "stretch"), np.full((2, 2), 9))
    matched = K.histogram_operation(gray, "matching", reference=color(16, 12))
    assert set(np.unique(matched)) <= set(np.unique(K.to_gray(color(16, 12))))
    for operation, options, error in (("melt", {}, TypeError), ("gamma", {"gamma": 0}, ValueError), ("matching", {}, ValueError), ("contrast_stretch", {"low": 5, "high": 5}, ValueError)):
        with pytest.raises(error):
            K.histogram_operation(gray, operation, **options)
    assert np.array_equal(K.stain_operation(image, "none"), image) and np.array_equal(K.stain_operation(image, "reinhard", color(17, 9)), K.reinhard(image, color(17, 9)))
    with pytest.raises(ValueError):
        K.stain_operation(image, "dye")
