import json

import pytest

from lumenframe.plans.build import Catalog
from tests.test_sources import png, record


@pytest.fixture
def folders(tmp_path):
    yolo = tmp_path / "yolo"
    yolo.mkdir()
    for k in range(3):
        png(yolo / f"img{k}.png", 8, 6)
        (yolo / f"img{k}.txt").write_text("0 0.5 0.5 0.1 0.1\n" * k if k else "0 0.5 0.5 0.1 0.1\n9 0.2 0.2 0.1 0.1\n")
    png(yolo / "lonely.png", 8, 6)
    coco = tmp_path / "coco"
    coco.mkdir()
    png(coco / "s.png", 20, 10)
    (coco / "a.json").write_text(
        json.dumps({"images": [{"id": 1, "file_name": "s.png", "width": 20, "height": 10}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [5, 2, 4, 2]}], "categories": [{"id": 3, "name": "WBC"}]})
    )
    for kind in ("Neutrophil", "Lymphocyte"):
        (tmp_path / "classes" / kind).mkdir(parents=True)
        png(tmp_path / "classes" / kind / "a.png", 4, 4)
    rowcol = tmp_path / "rowcol"
    rowcol.mkdir()
    png(rowcol / "s.png", 20, 10)
    (rowcol / "t.json").write_text(json.dumps([record("/images/s.png", ("trophozoite", 1, 1, 3, 3))]))
    csv = tmp_path / "csv"
    csv.mkdir()
    png(csv / "001.png", 4, 4)
    png(csv / "002.png", 4, 4)
    (csv / "labels.csv").write_text("image ID,class label\n1,1\n2,2\n")
    (tmp_path / "empty").mkdir()
    return tmp_path


def test_catalog(spark, folders):
    catalog = Catalog(spark)
    for name in ("yolo", "coco", "classes", "rowcol", "csv", "empty"):
        if name == "rowcol":
            catalog.register(name, str(folders / name), "Row/column JSON")
        else:
            catalog.auto_register(str(folders / name))
    kinds = {e.name: e.annotation for e in catalog.entries.values()}
    assert kinds == {"yolo": "YOLO", "coco": "COCO", "classes": "None", "rowcol": "Row/column JSON", "csv": "CSV", "empty": "Unknown"}
    status = {e.name: e.status for e in catalog.prepare_all()}
    assert status["coco"] == "READY" and status["yolo"] == "WARNING" and status["empty"] == "ERROR"
    assert "READY" in catalog.summary()

    built = catalog.build("yolo")
    assert built.images.count() == 3 and built.boxes.count() == 5
    log = {r.image.rsplit("/", 1)[-1]: (r.status, r.objects) for r in built.log.collect()}
    assert log == {"img0.png": ("SUCCESS", 2), "img1.png": ("SUCCESS", 1), "img2.png": ("SUCCESS", 2), "lonely.png": ("FAILED", 0)}

    box = catalog.build("coco").boxes.first()
    assert (box.class_name, round(box.xc, 6), box.w) == ("WBC", 0.35, 0.2)
    assert {r.class_name for r in catalog.build("classes").boxes.collect()} == {"Neutrophil", "Lymphocyte"}
    assert catalog.build("rowcol").boxes.first().class_id == 3
    assert sorted(r.class_id for r in catalog.build("csv").boxes.collect()) == [1, 2]

    everything, errors = catalog.build_many()
    assert set(errors) == {"empty"} and everything.images.count() == 3 + 1 + 2 + 1 + 2
    with pytest.raises(ValueError):
        catalog.register("yolo", "x", "YOLO")


def test_preprocessing_in_a_build(spark, folders):
    catalog = Catalog(spark)
    catalog.auto_register(str(folders / "yolo"))
    assert catalog.build("yolo").processed is None
    assert catalog.enable_preprocessing({"resize": {"width": 4, "height": 3}}).names() == ["resize"]
    done = catalog.build("yolo").processed.collect()
    assert len(done) == 4 and all(r.passed and (r.width, r.height) == (4, 3) and r.brightness > 0 for r in done)
    catalog.disable_preprocessing()
    assert catalog.build("yolo").processed is None


def test_file_order_decides(spark, tmp_path):
    png(tmp_path / "m.png", 4, 4)
    (tmp_path / "m.txt").write_text("9 0.9 0.9 0.1 0.1\n1 0.1 0.1 0.1 0.1\n")
    catalog = Catalog(spark)
    catalog.register("set", str(tmp_path), "YOLO", classes={1: "one", 9: "nine"})
    built = catalog.build("set")
    assert [(r.object_index, r.class_name) for r in built.boxes.orderBy("object_index").collect()] == [(0, "nine"), (1, "one")]
    from lumenframe.sources.sinks import class_folder

    assert class_folder(built.images, built.boxes).first().target == "train/nine/m.png"
