import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G

NAMES = ("x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2")
box = st.tuples(*[st.integers(-20, 60)] * 4)


def reference_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = w * h if w > 0 and h > 0 else 0
    size = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    union = size(a) + size(b) - inter
    return inter / union if union > 0 else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(box, box), min_size=20, max_size=40))
def test_iou_symmetry_and_value(spark, pairs):
    rows = spark.createDataFrame([tuple(map(float, a + b)) for a, b in pairs], ", ".join(f"{n} double" for n in NAMES))
    one, two = G.Box.of(*NAMES[:4]), G.Box.of(*NAMES[4:])
    found = rows.select(G.iou(one, two).alias("a"), G.iou(two, one).alias("b"), G.overlap_ratio(one, two).alias("o")).collect()
    for (a, b), r in zip(pairs, found):
        assert math.isclose(r.a, reference_iou(a, b)) and math.isclose(r.a, r.b)
        assert r.o >= r.a - 1e-12


def test_convert_roundtrip_and_formats(spark):
    rows = spark.createDataFrame([(10.0, 20.0, 50.0, 80.0)], "x1 double, y1 double, x2 double, y2 double")
    w, h = F.lit(200), F.lit(100)
    b = G.Box.of("x1", "y1", "x2", "y2")
    centre = G.convert(b, "voc", "YOLO", w, h)
    back = G.convert(centre, "yolo", "voc", w, h)
    got = rows.select(F.array(*centre).alias("c"), F.array(*back).alias("b"), F.array(*G.convert(b, "voc", "voc", w, h)).alias("same")).first()
    assert got.c == [0.15, 0.5, 0.2, 0.6]
    assert [round(v, 9) for v in got.b] == [10, 20, 50, 80] and got.same == [10, 20, 50, 80]
    try:
        G.convert(b, "voc", "coco", w, h)
    except ValueError:
        pass
    else:
        raise AssertionError("unknown format passed")


def test_malformed_arrays_are_null_or_raise(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,), ([1.0, None, 3.0, 4.0],)], "b array<double>")
    areas = [r[0] for r in rows.select(G.area(G.Box.of_array(F.col("b")))).collect()]
    assert areas == [4.0, None, None, None]
    try:
        rows.select(G.area(G.Box.of_array(F.col("b"), strict=True))).collect()
    except Exception as error:
        assert "exactly four" in str(error)
    else:
        raise AssertionError("strict mode did not raise")


def test_clip_expand_and_crop(spark):
    rows = spark.range(1)
    b = G.Box(*[F.lit(v) for v in (-5.0, 2.0, 30.0, 12.0)])
    got = rows.select(
        F.array(*G.clip(b, F.lit(20), F.lit(10))).alias("clip"),
        F.array(*G.shrink(G.expand(b, 3), 3)).alias("same"),
        F.array(*G.crop_bounds(G.Box(*[F.lit(v) for v in (0.5, 0.5, 0.5, 0.5)]), F.lit(100), F.lit(50))).alias("crop"),
        G.is_valid_center_box(*[F.lit(v) for v in (0.5, 0.5, 0.0, 0.5)]).alias("flat"),
    ).first()
    assert got.clip == [0.0, 2.0, 20.0, 10.0] and got.same == [-5.0, 2.0, 30.0, 12.0]
    assert got.crop == [20, 10, 80, 40] and not got.flat
