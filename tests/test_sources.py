import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import annotations as A
from lumenframe.sources import listing as L
from lumenframe.sources import sinks as K
from lumenframe.sources import sniff as N


def png(path, width, height, rgb=(10, 20, 30)):
    """A small PNG of one colour."""
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("r")).first().r


def test_yolo_text(spark):
    text = "  7\t0.125 0.75 0.0625 0.5 0.33\r\n4 .5 1e-1 0.2 0.3\n\n5 0.1 0.2 0.3\nseven 0.1 0.1 0.1 0.1\n-1 0 0 0 0"
    found = one(spark, text, A.yolo_boxes)
    assert [tuple(b) for b in found] == [(7, 0.125, 0.75, 0.0625, 0.5), (4, 0.5, 0.1, 0.2, 0.3), (-1, 0.0, 0.0, 0.0, 0.0)]
    assert one(spark, "", A.yolo_boxes) == [] and one(spark, "\n \n", A.yolo_boxes) == []


def test_point_text(spark):
    found = one(spark, "16 36 5\n\n608.0 444 0 tail\n1 2\nx 1 1", A.point_boxes)
    assert [(b.class_id, b.xc, b.yc) for b in found] == [(5, 0.025, 0.075), (0, 0.95, 0.925)]
    assert {(b.w, b.h) for b in found} == {(70 / 640, 70 / 480)}
    wide = spark.createDataFrame([("10 10 1",)], "t string").select(A.point_boxes(F.col("t"), (100, 50), 20).alias("b")).first().b
    assert tuple(wide[0]) == (1, 0.1, 0.2, 0.2, 0.4)


def test_report(spark):
    text = "Ferritin : 31\nferritin: 5\nMorphology: old\nFerritin: 40.25\nplain line\n: 3\nTime: 10:30\nMORPHOLOGY: ovalocytes ,, tear drops,"
    assert one(spark, text, A.report_values) == {"Ferritin": 40.25, "ferritin": 5.0, "": 3.0}
    assert one(spark, text, A.report_findings) == ["ovalocytes", "tear drops"]
    assert one(spark, "x: 1", A.report_findings) == [] and one(spark, "", A.report_values) == {}


def record(name, *objects):
    return {
        "image": {"pathname": name, "shape": {"r": 80, "c": 160}},
        "objects": [{"category": c, "bounding_box": {"minimum": {"r": a, "c": b}, "maximum": {"r": d, "c": e}}} for c, a, b, d, e in objects],
    }


def test_rowcol_json(spark):
    items = [record("deep/er/n.tif", ("Gametocyte", 8, 16, 24, 48), ("no such cell", 1, 1, 2, 2), ("red blood cell", 0, 0, 80, 160)), record("", ("ring", 0, 0, 1, 1))]
    for text, n in ((json.dumps(items), 2), (json.dumps(items[0]), 1), ("[]", 0)):
        assert len(one(spark, text, A.rowcol_records)) == n
    texts = spark.createDataFrame([("f", json.dumps(items))], "file string, text string")
    found = {r.name: r for r in A.rowcol_by_name(texts).collect()}
    assert set(found) == {"n.tif"} and (found["n.tif"].width, found["n.tif"].height) == (160, 80)
    assert [tuple(b) for b in found["n.tif"].b] == [(3, 0.2, 0.2, 0.2, 0.2), (0, 0.5, 0.5, 1.0, 1.0)]


def test_later_records_replace_earlier_ones(spark):
    first, later = record("a/n.png", ("ring", 0, 0, 8, 16)), record("b/n.png", ("leukocyte", 0, 0, 80, 160))
    unshaped = {"image": {"file_name": "z.png"}, "objects": [{"category": "ring", "bounding_box": {"minimum": {"r": 1, "c": 2}, "maximum": {"r": 3, "c": 6}}}]}
    texts = spark.createDataFrame([("2.json", json.dumps([later])), ("1.json", json.dumps([first, unshaped]))], "file string, text string")
    found = {r.name: r for r in A.rowcol_by_name(texts).collect()}
    assert [b.class_id for b in found["n.png"].b] == [1] and tuple(found["z.png"].b[0]) == (3, 4.0, 2.0, 4.0, 2.0) and found["z.png"].width == 0


def test_coco(spark):
    doc = {
        "images": [{"id": 1, "file_name": "s.jpg", "width": 200, "height": 100}, {"id": 2, "file_name": None, "width": 1, "height": 1}, {"id": 3, "file_name": "z.jpg", "width": 0, "height": 0}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 3, "bbox": [50, 25, 20, 10]},
            {"id": 2, "image_id": 9, "category_id": 3, "bbox": [0, 0, 1, 1]},
            {"id": 3, "image_id": 3, "category_id": 4, "bbox": [1, 1, 1, 1]},
        ],
        "categories": [{"id": 3, "name": "WBC"}],
    }
    parsed = spark.createDataFrame([("f", json.dumps(doc))], "file string, t string").select("file", F.from_json("t", A.COCO_DOCUMENT).alias("doc"))
    rows = {r.file_name: r for r in A.coco_boxes(parsed).collect()}
    assert len(rows) == 2
    assert (round(rows["s.jpg"].xc, 6), round(rows["s.jpg"].yc, 6), rows["s.jpg"].w, rows["s.jpg"].class_name) == (0.3, 0.3, 0.1, "WBC")
    assert rows["z.jpg"].xc == 0.0 and rows["z.jpg"].class_name == "Class_4"


def test_voc_and_images_from_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<annotation><filename>a.png</filename><size><width>200</width><height>100</height></size>"
        "<object><name>Platelets</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>30</xmax><ymax>20</ymax></bndbox></object>"
        "<object><name>unknown</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>2</ymax></bndbox></object></annotation>"
    )
    found = A.voc_boxes(A.read_voc(spark, str(tmp_path / "a.xml"))).collect()
    assert len(found) == 1 and found[0].class_id == 2 and found[0].xc == 0.1 and found[0].h == 0.1
    folder = tmp_path / "images"
    folder.mkdir()
    png(folder / "ok.png", 4, 3)
    (folder / "broken.png").write_bytes(b"no image")
    images = L.read_images(spark, str(folder))
    sizes = {r.path.split("/")[-1]: (r.width, r.height) for r in L.image_sizes(images).collect()}
    assert sizes == {"ok.png": (4, 3), "broken.png": (0, 0)}
    data = images.filter("width > 0").first().data
    assert bytes(data[:3]) == bytes((30, 20, 10))
    counts = L.count_files(L.list_files(spark, str(tmp_path))).first()
    assert (counts.n_images, counts.n_annotations) == (2, 1)
    assert L.list_files(spark, str(tmp_path / "none")).count() == 0
    assert L.content_digests(spark, str(folder)).count() == 2


def test_csv_and_folder_labels(spark):
    files = spark.createDataFrame([("d/001.bmp",), ("d/002.bmp",)], "path string")
    rows = spark.createDataFrame([("1", "1"), ("002", "2"), ("999", "1"), ("2", "x")], "`image ID` string, `class label` string")
    built, failed = A.csv_labels(rows, files)
    assert sorted(map(tuple, built.collect())) == [("d/001.bmp", 1), ("d/002.bmp", 2)]
    assert failed.count() == 2
    with pytest.raises(ValueError):
        A.csv_labels(spark.createDataFrame([("a",)], "other string"), files)
    dim = spark.createDataFrame([(0, "Neutro phil"), (1, "Lymphocyte")], "class_id int, label string")
    tree = spark.createDataFrame([("r/neutro-phil/a.jpg",), ("r/Lymphocyte/a.jpg",), ("r/Other/a.jpg",)], "path string")
    built, failed = A.folder_labels(tree, dim)
    assert sorted(r.class_id for r in built.collect()) == [0, 1] and failed.count() == 1


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a.txt", "0 0.5 0.5 0.1 0.1", "YOLO"),
        ("a.txt", "10 20 3", "Point TXT"),
        ("a.txt", "WBC, RBC, HGB", "Counts report"),
        ("a.txt", "Peripheral smear: microcytic", "Findings report"),
        ("a.txt", "words", "Generic TXT"),
        ("a.json", '{"images": [], "annotations": [], "categories": []}', "COCO"),
        ("a.json", '[{"image": {"a": 1}, "objects": [1]}]', "Row/column JSON"),
        ("a.json", "{broken", "JSON"),
        ("a.xml", "<?xml version='1.0'?><annotation><x/></annotation>", "Pascal VOC"),
        ("a.xml", "<other/>", "XML"),
        ("a.CSV", "", "CSV"),
        ("a", None, "Unknown"),
    ],
)
def test_detect(spark, path, text, kind):
    row = spark.createDataFrame([(path, text)], "path string, text string")
    assert row.select(N.detect(F.col("path"), F.col("text"))).first()[0] == kind


@pytest.mark.parametrize(
    ("files", "wanted"),
    [
        ([(f"d/img{i}.jpg", None) for i in range(3)] + [(f"d/img{i}.txt", "0 0.5 0.5 0.1 0.1") for i in range(3)], ("YOLO", "Detection")),
        ([("d/a.jpg", None), ("d/a.json", '{"images": [], "annotations": [], "categories": []}')], ("COCO", "Detection")),
        ([("d/N/a.jpg", None), ("d/L/a.jpg", None)], ("None", "Classification")),
        ([("d/0.bmp", None), ("d/labels.csv", "x")], ("CSV", "Classification")),
        ([], ("Unknown", "Unknown")),
    ],
)
def test_dataset_format(spark, files, wanted):
    found = N.dataset_format(spark.createDataFrame(files, "path string, text string")).first()
    assert (found.annotation, found.task) == wanted


def test_manifest_and_export(spark, tmp_path):
    assert N.read_manifest("nc: 2\nnames: [RBC, WBC]\n")["names"] == {0: "RBC", 1: "WBC"}
    images = spark.createDataFrame([(1, "a/x.jpg", "train"), (2, "a/y.jpg", "")], "seq long, image_path string, split string")
    boxes = spark.createDataFrame(
        [(1, 0, 3, "P", 0.5, 0.5, 0.1, 0.2), (1, 1, 0, "R", 0.1, 0.1, 0.1, 0.1)],
        "seq long, object_index int, class_id int, class_name string, xc double, yc double, w double, h double",
    )
    labels = K.yolo_labels(images, boxes)
    K.write_yolo(labels, K.class_names(boxes), str(tmp_path / "out"))
    K.write_label_files(labels, str(tmp_path / "files"))
    assert (tmp_path / "files/train/x.txt").read_text() == "1 0.500000 0.500000 0.100000 0.200000\n0 0.100000 0.100000 0.100000 0.100000\n"
    assert (tmp_path / "files/train/y.txt").read_text() == ""
    assert N.read_manifest((tmp_path / "out/data.yaml").read_text())["names"] == {0: "R", 1: "P"}


def test_png_bytes_are_read_back(spark, tmp_path):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    colour = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    rows = [(f"{tmp_path}/in/x/gray.png", bytearray(K.png_bytes(gray))), (f"file://{tmp_path}/in/x y/colour.png", bytearray(K.png_bytes(colour))), (f"{tmp_path}/in/unit.png", bytearray(K.png_bytes(colour / 255.0)))]
    assert K.write_files(spark.createDataFrame(rows, "path string, content binary")) == 3
    found = {r.path.rsplit("/", 1)[1]: r for r in L.read_images(spark, str(tmp_path / "in")).collect()}
    assert bytes(found["colour.png"].data) == colour.tobytes() and found["gray.png"].channels == 1 and bytes(found["gray.png"].data) == gray.tobytes()
    assert np.abs(np.frombuffer(found["unit.png"].data, np.uint8).astype(int) - colour.ravel()).max() <= 1
    assert K.write_files(spark.createDataFrame([], "path string, content binary")) == 0


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name in ("empty.txt", "a b/em+pty%.PNG", "a b/plain.txt"):
        (tmp_path / name).write_bytes(b"x" if "plain" in name else b"")
    found = {(r.path.split(str(tmp_path))[1], r.length, r.kind) for r in L.list_files(spark, str(tmp_path)).collect()}
    assert found == {("/empty.txt", 0, "annotation"), ("/a b/em+pty%.PNG", 0, "image"), ("/a b/plain.txt", 1, "annotation")}
    assert sorted(r.text for r in A.read_texts(spark, str(tmp_path), ".txt").collect()) == ["", "x"]
    assert [r.width for r in L.read_images(spark, str(tmp_path)).collect()] == [-1]
