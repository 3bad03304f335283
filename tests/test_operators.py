import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators import dataset as D
from lumenframe.operators import kernels as K
from lumenframe.operators import pixels as P
from lumenframe.operators import ranked as R
from lumenframe.operators import rules as V
from lumenframe.operators import statistics as T
from lumenframe.operators import training as M
from lumenframe.plans.pipeline import Pipeline, Registry, default_registry, run_report


@pytest.fixture(scope="module")
def small(spark):
    """Six images: sizes, datasets and classes of a detection set."""
    spec = [("B", 640, 480, ["RBC", "WBC"]), ("B", 640, 480, ["RBC"]), ("B", 800, 600, ["RBC", "RBC", "Platelet"]), ("C", 720, 576, ["RBC"]), ("C", 720, 576, []), ("C", 720, 576, ["WBC"])]
    images = [(i, f"img_{i}", f"/data/{d}/img_{i}.jpg", d, w, h, "train") for i, (d, w, h, _) in enumerate(spec)]
    boxes = [(i, k, 0, c, 0.5, 0.5, 0.1, 0.1, None, 0.0) for i, (*_, cs) in enumerate(spec) for k, c in enumerate(cs)]
    return (
        spark.createDataFrame(images, "seq long, image_id string, image_path string, dataset string, width int, height int, split string"),
        spark.createDataFrame(boxes, "seq long, object_index int, class_id int, class_name string, xc double, yc double, w double, h double, confidence double, area double"),
    )


def test_filters_and_search(small):
    images, boxes = small
    assert D.find(images, F.col("width") >= 720).count() == 4
    assert D.by_dataset(images, "B").count() == 3
    assert D.by_class(images, boxes, "WBC").count() == 2 and D.by_class(images, boxes, "Platelet").count() == 1
    assert D.search(images, boxes, dataset="B", class_name="RBC").count() == 3
    assert D.search(images, boxes, max_objects=1).count() == 4
    assert D.find_one(images, F.col("width") > 9999).count() == 0
    assert D.get_by_id(images, "img_2").first().width == 800


def test_statistics(small):
    images, boxes = small
    total = T.dataset_statistics(images, boxes).first()
    assert (total.n_images, total.n_objects, total.min_objects, total.max_objects) == (6, 8, 0, 3)
    shares = {r.class_name: r.share for r in T.class_balance(boxes).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-3 and shares["RBC"] == 0.625


@pytest.mark.parametrize("shares", [(0.7, 0.15, 0.15), (0.5, 0.25, 0.25)])
def test_splits(spark, shares):
    images = spark.range(101).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("dataset"), F.lit("").alias("split"))
    dealt = R.assign_splits(images, *shares)
    counts = {(r.dataset, r.new_split): r["count"] for r in dealt.groupBy("dataset", "new_split").count().collect()}
    for d, n in (("0", 34), ("1", 34), ("2", 33)):
        assert counts[d, "train"] == round(n * shares[0]) and counts[d, "val"] == round(n * shares[1])
    assert sum(counts.values()) == 101
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, R.assign_splits(images, *shares).collect()))
    with pytest.raises(ValueError):
        R.assign_splits(images, 0.5, 0.5, 0.5)


def test_random_numbers_are_even_and_unrelated(spark):
    rows = spark.range(20000).select(*[S.uniform(42 + k, F.col("id"), F.lit(3)).alias(f"u{k}") for k in range(4)])
    found = np.array([tuple(r) for r in rows.collect()])
    assert 0 <= found.min() and found.max() < 1 and np.abs(found.mean(0) - 0.5).max() < 0.01
    assert np.abs(np.corrcoef(found.T) - np.eye(4)).max() < 0.03
    for a in range(3):
        share = np.histogram(found[found[:, a] < 0.3, a + 1], bins=10, range=(0, 1))[0] / (found[:, a] < 0.3).sum()
        assert np.abs(share - 0.1).max() < 0.02


def test_splits_keep_assigned_rows(spark):
    images = spark.createDataFrame([(1, "a", "test"), (2, "a", "train"), (3, "a", None)], "seq long, dataset string, split string")
    kept = {r.seq: r.new_split for r in R.assign_splits(images).collect()}
    assert kept[1] == "test" and set(kept) == {1, 2, 3}


def test_first_seen_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "seq long, k string")
    assert [r.is_repeat for r in R.first_seen(rows, [F.col("k")], ["seq"]).orderBy("seq").collect()] == [False, False, True, True]


def test_overlap_cells_agree_with_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for seq in range(3):
        for k in range((30, 90, 120)[seq]):
            x, y, w, h = *rng.uniform(-0.2, 0.9, 2), *rng.uniform(0.05, 0.6, 2)
            rows.append((seq, k, float(x), float(y), float(x + w), float(y + h)))
    boxes = spark.createDataFrame(rows, "seq long, object_index int, x1 double, y1 double, x2 double, y2 double")
    found = {(r.seq, r.i, r.j) for r in D.overlapping_pairs(boxes, 0.2).collect()}

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = w * h if w > 0 and h > 0 else 0
        return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)

    wanted = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= 0.2}
    assert found == wanted and wanted


def test_rules_and_index(small, spark):
    images, boxes = small
    issues = V.v1_issues(images, boxes)
    assert {r.rule_id for r in issues.collect()} == {"V1-IMG-EMPTY"}
    rolled = V.rollup(issues).first()
    assert (rolled.n_issues, rolled.n_warning, rolled.passed) == (1, 1, True)
    assert V.v1_index(V.rollup(issues)).first().quality_index == 98.75
    graded = {r.dataset: r for r in V.quality_by_dataset(images, boxes).collect()}
    assert graded["B"].n_error == 0 and graded["C"].n_error == 1
    bad = boxes.withColumn("w", F.lit(0.0)).withColumn("confidence", F.lit(1.5))
    assert {"BOX007", "BOX010", "OBJ007", "OBJ001", "BOX011", "OBJ005"} <= {r.rule_id for r in V.v2_issues(images, bad).collect()}
    assert [r.rule_id for r in V.v1_issues(None, boxes).collect()] == ["V1-DS-NONE"]
    ids = R.issue_ids(V.v2_issues(images, bad)).select("issue_id").collect()
    assert len({r.issue_id for r in ids}) == len(ids)


def test_grades(spark):
    rows = spark.createDataFrame([(95.0,), (94.99,), (80.0,), (60.0,), (0.0,)], "x double")
    assert [r[0] for r in rows.select(S.grade(F.col("x"))).collect()] == ["A+", "A", "B", "D", "F"]


def test_pixel_columns_agree_with_kernels(spark):
    tile = np.random.default_rng(1).integers(0, 256, (8, 8)).astype(np.uint8)
    row = P.measured(spark.createDataFrame([(tile.ravel().tolist(),)], "pixels array<int>"), 8).first()
    wanted = K.measures(tile)
    for name in ("brightness", "contrast", "entropy", "blur_score", "sharpness"):
        assert abs(row[name] - wanted[name]) < 1e-3, name
    flat = P.measured(spark.createDataFrame([([128] * 64,)], "pixels array<int>"), 8).first()
    assert "blurry" in flat.issues and flat.quality_score == 25.0


def test_point_transforms_agree_with_numpy(spark):
    tile = np.random.default_rng(2).integers(10, 200, 64)
    rows = spark.createDataFrame([(tile.tolist(), [7] * 64)], "pixels array<int>, flat array<int>")
    got = rows.select(
        P.min_max_normalize(F.col("pixels")).alias("mm"), P.gamma(F.col("pixels"), 2.0).alias("g"), P.z_score(F.col("flat")).alias("z")
    ).first()
    assert np.allclose(got.mm, (tile - tile.min()) / (tile.max() - tile.min()))
    assert np.array_equal(got.g, K.gamma(tile.astype(np.uint8), 2.0))
    assert got.z == [1.0] * 64


def color(seed=0, size=32):
    return np.random.default_rng(seed).integers(0, 256, (size, size, 3)).astype(np.uint8)


@pytest.mark.parametrize("operation", ["erosion", "dilation", "opening", "closing", "gradient", "tophat", "blackhat"])
def test_morphology(operation):
    image = color(1, 12)
    out = K.morphology(image, operation)
    assert out.shape == image.shape and out.dtype == np.uint8
    if operation == "opening":
        assert (out <= image).all()
    if operation == "closing":
        assert (out >= image).all()


def test_kernels_shapes_and_invariants():
    image = color()
    flat = np.full((16, 16, 3), 90, np.uint8)
    for f in (K.gaussian_blur, K.median_blur, K.unsharp_mask, K.kernel_sharpen, K.laplacian_sharpen, K.bilateral, K.gray_world):
        assert np.abs(f(flat).astype(int) - 90).max() <= 1, f
        assert f(image).shape == image.shape
    assert K.letterbox(image, 64, 48).shape == (48, 64, 3)
    assert K.resize(image, 16, 16, "area").mean() == pytest.approx(image.mean(), abs=1)
    assert np.abs(K.from_hsv(K.to_hsv(image)).astype(int) - image).max() <= 2
    assert np.abs(K.reinhard(image, image).astype(int) - image).mean() < 3
    assert K.patch_features(image).shape == (18,) and K.hog(K.to_gray(image)).shape == (1764,) and K.color_histogram(image).shape == (48,)
    assert K.clahe(image).shape == image.shape and K.non_local_means(K.to_gray(image)[:12, :12], search=5, template=3).shape == (12, 12)
    assert K.macenko(image, color(5)).shape == image.shape
    assert K.crop(image, 2.0, 2.0, 0.1, 0.1) is None


def test_pipeline(spark):
    image = color(3, 10)
    rows = spark.createDataFrame([("a", 10, 10, 3, bytearray(image.tobytes())), ("b", -1, -1, -1, None)], "path string, width int, height int, channels int, data binary")
    pipeline = Pipeline.from_config({"resize": {"width": 20, "height": 16}, "denoise": {"method": "median", "size": 3}})
    assert pipeline.names() == ["resize", "denoise"]
    out = {r.path: r for r in pipeline.apply(rows).collect()}
    assert (out["a"].width, out["a"].height, out["a"].passed) == (20, 16, True) and [h.step for h in out["a"].history] == ["resize", "denoise"]
    assert not out["b"].passed and out["b"].error == "corrupted"
    broken = Pipeline([("bad", lambda x: 1 / 0), ("ok", lambda x: x)])
    assert [h["status"] for h in broken.run(image)[1]] == ["FAILED", "SUCCESS"]
    assert run_report(broken.apply(rows)).first().n_failed == 2
    with pytest.raises(ValueError):
        Pipeline().validate()
    with pytest.raises(KeyError):
        Pipeline.from_config({"none": {}})


def test_registry():
    registry = Registry()
    registry.register(" Blur ", lambda: lambda x: x)
    assert registry.names() == ["blur"] and registry.exists("BLUR")
    with pytest.raises(ValueError):
        registry.register("blur", lambda: None)
    with pytest.raises(TypeError):
        registry.register("x", 1)
    registry.unregister("blur")
    registry.unregister("blur")
    with pytest.raises(KeyError):
        registry.get("blur")
    assert "macenko" in default_registry().names()


def test_training(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        label = i % 3
        image = np.full((32, 32, 3), 230, np.uint8)
        image[8:24, 8:24, label] = 30
        rows.append((i, 0, label, 0.5, 0.5, 0.5, 0.5, 32, 32, 3, bytearray(np.clip(image + rng.normal(0, 5, image.shape), 0, 255).astype(np.uint8).tobytes())))
    objects = spark.createDataFrame(rows, "seq long, object_index int, class_id int, xc double, yc double, w double, h double, width int, height int, channels int, data binary")
    features = M.object_features(objects, max_objects_per_class=15).persist()
    assert features.count() == 45 and len(features.first().features) == 18
    train, test = M.stratified_halves(features, "class_id", "seq")
    assert train.count() + test.count() == 45
    model = M.train_forest(train, "class_id", trees=10)
    assert T.accuracy(M.predict(model, test), "class_id", "predicted").first().accuracy > 0.7
    assert len(M.importances(model, [str(k) for k in range(18)])) == 18
    found = M.permutation_importance(model, test, "class_id", 18, repeats=2)
    assert len(found) == 18 and {k for k, _, _ in found} == set(range(18)) and found[0][1] >= found[-1][1] and all(std >= 0 for _, _, std in found)
    assert len(M.importance_report(found, list(K.FEATURE_NAMES), 5).split("\n")) == 8


def test_streaming_ingest(spark, tmp_path):
    from lumenframe.streaming import ingest as I

    rows = spark.range(20).select("id", (F.col("id") % 2).alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = I.landing(spark, str(tmp_path / "in"), rows.schema)
    query = I.each_batch(stream, lambda b: b.groupBy("k").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 20
    new = spark.createDataFrame([(1, 9), (30, 9)], "id long, k long")
    merged = I.upsert(rows, new, "id")
    assert merged.count() == 21 and merged.filter("k = 9").count() == 2


def test_streaming_windows(spark, tmp_path):
    from lumenframe.streaming import ingest as I

    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b"), ("2024-01-01 00:20:00", "a")], "t string, kind string")
    rows = rows.select(F.to_timestamp("t").alias("ts"), "kind")
    rows.write.parquet(str(tmp_path / "in"))
    counted = I.counts_by_window(I.landing(spark, str(tmp_path / "in"), rows.schema), "ts", "kind", "5 minutes", "1 hour")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    found = {(r.window_start.minute, r.kind, r.n) for r in spark.table("windows").collect()}
    assert found == {(0, "a", 2), (5, "b", 1), (20, "a", 1)}


def test_validate_and_report(spark, small, tmp_path):
    from lumenframe.plans import reports as E

    images, boxes = small
    issues = E.validate_and_report(images, boxes, str(tmp_path))
    assert issues.count() == V.v2_issues(images, boxes).count() and issues.columns == list(V.ISSUE_COLUMNS)
    lines = [r.value for r in spark.read.text(str(tmp_path / "validation_report.txt")).collect()]
    assert lines[1] == "Dataset Validation Report" and any(line.startswith("[ERROR] OBJ001") for line in lines)
    clean = boxes.filter("seq IN (0, 1)")
    none = E.text(E.v1_report(images.filter("seq IN (0, 1)"), clean))
    assert "No validation issues found." in none and "Passed            : True" in none
    path = E.save(E.v1_report(images, boxes, markdown=True), str(tmp_path / "report.md"))
    assert open(path).read().startswith("# Validation Report\n\n## Summary\n- Total Issues: 1\n")


def test_paths(spark):
    rows = [("a/./b//c/", "a/b/c", "a/b/c"), ("/x/../y", "/x/../y", "/y"), ("s3://k/a//b/../c", "s3://k/a/b/../c", "s3://k/a/c"), ("plain.jpg", "plain.jpg", "plain.jpg"), ("a/../../b", "a/../../b", "b"), (None, None, None)]
    found = spark.createDataFrame(rows, "p string, n string, r string").select(S.normalized_path(F.col("p")), "n", S.resolved_path(F.col("p")), "r").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in found)


def test_value_ranges_keep_the_order(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.normal(0, 1e3, 500), rng.normal(0, 1e-3, 200), np.arange(-300, 300), [0.0, 1e18, -1e18]])).tolist()
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(S.value_range(F.col("v"))).collect()]
    assert found == sorted(found) and len(set(found)) > 500


def test_dataset_rules_on_a_listing(spark):
    rows = [("d/a.jpg", 5, "image"), ("e/a.jpg", 5, "image"), ("d/b.jpg", 5, "image"), ("d/a.txt", 0, "annotation"), ("d/x.md", 1, "other")]
    files = spark.createDataFrame(rows, "path string, length long, kind string")
    found = {(r.rule_id, r.image_path) for r in V.v2_dataset_issues(files).collect()}
    assert found == {("DS006", None), ("DS007", "d/b.jpg"), ("DS008", "e/a.jpg"), ("DS009", "d/a.txt")}
    assert {r.rule_id for r in V.v2_dataset_issues(files.limit(0)).collect()} == {"DS003", "DS004", "DS005"}


def test_overlaps_are_reported(small):
    images, boxes = small
    ids = [r.rule_id for r in V.v2_issues(images, boxes, iou=0.9).collect()]
    assert ids.count("BOX012") == 4 and ids.count("BOX011") == 4
