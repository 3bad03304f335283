"""A small folder of annotated images in every layout, for queries over files.

The star-schema tables hold no files, so queries of the file operators read this folder.
It is written once a session, below the folder that the cluster shares.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import sinks as K
from lumenframe.sources.listing import path_exists


def picture(width: int, height: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def _png(width: int = 8, height: int = 6, seed: int = 0) -> bytes:
    return K.png_bytes(picture(width, height, seed))


def _record(path: str, category: str, rows: tuple[int, int], columns: tuple[int, int]) -> dict:
    low, high = ({"r": rows[k], "c": columns[k]} for k in (0, 1))
    return {"image": {"pathname": path, "shape": {"r": 100, "c": 200}}, "objects": [{"category": category, "bounding_box": {"minimum": low, "maximum": high}}]}


def _voc(*objects: tuple[str, int, int, int, int]) -> str:
    parts = "".join(
        f"<object><name>{n}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>" for n, a, b, c, d in objects
    )
    return f"<annotation><filename>other.png</filename><size><width>100</width><height>50</height></size>{parts}</annotation>"


def files() -> dict[str, bytes]:
    """Content by path."""
    coco_1 = {
        "images": [{"id": 1, "file_name": "s.png", "width": 20, "height": 10}, {"id": 2, "file_name": "t.png", "width": 10, "height": 10}],
        "annotations": [
            {"id": 1, "image_id": 2, "category_id": 1, "bbox": [0, 0, 5, 5]}, {"id": 2, "image_id": 1, "category_id": 3, "bbox": [5, 2, 4, 2]},
            {"id": 3, "image_id": 1, "category_id": 7, "bbox": [0, 0, 2, 2]}, {"id": 4, "image_id": 99, "category_id": 1, "bbox": [0, 0, 1, 1]},
        ],
        "categories": [{"id": 1, "name": "A"}, {"id": 3, "name": "WBC"}],
    }
    coco_2 = {
        "images": [{"id": 5, "file_name": "folder/u.jpg", "width": 10, "height": 20}],
        "annotations": [{"id": 9, "image_id": 5, "category_id": 3, "bbox": [1, 2, 2, 4]}],
        "categories": [{"id": 3, "name": "other"}],
    }
    texts = {
        "yolo/data.yaml": "names:\n  0: cell\n  9: odd\nnc: 2\n",
        "yolo/readme.txt": "notes about the set\n",
        "yolo/train/a.txt": "0 0.5 0.5 0.25 0.5\nbroken line\n9 0.25 0.125 0.1 0.2 0.9\n",
        "yolo/valid/b.txt": "",
        "points/p.txt": "320 240 1\n\n64 48 2\nbad\n",
        "voc/v.xml": _voc(("Platelets", 10, 10, 30, 20), ("unheard of", 1, 1, 2, 2), ("RBC", 0, 0, 100, 50)),
        "voc/w.xml": _voc(),
        "coco/c1.json": json.dumps(coco_1),
        "coco/c2.json": json.dumps(coco_2),
        "rowcol/r1.json": json.dumps([_record("images/s.png", "trophozoite", (10, 30), (20, 60))]),
        "rowcol/r2.json": json.dumps([_record("images/s.png", "red blood cell", (0, 50), (0, 100)), _record("q.jpg", "difficult", (0, 1), (0, 1))]),
        "classes/Other/none.md": "no picture here\n",
        "csv/labels.csv": "image ID,class label\n1,1\n02,2\n9,3\n2,x\n",
        "clinical/r.txt": "Hemoglobin: 13.5\nWBC: 7.2\nNote: none\nHemoglobin: 14\nMorphology: target cells, , microcytic\n",
        "clinical/count.txt": "WBC, RBC, HGB\n7, 4, 13\n",
        "clinical/smear.txt": "Peripheral smear: hypochromic cells, platelets normal\n",
    }
    pictures = (
        "yolo/train/a.png yolo/valid/b.png yolo/test/lonely.png points/p.png voc/v.png voc/w.png coco/s.png coco/t.png coco/u.png coco/x.png rowcol/s.png rowcol/q.png "
        "classes/Neutrophil/a.png classes/Lymphocyte/a.png csv/001.png csv/002.png"
    ).split()
    found = {name: text.encode() for name, text in texts.items()}
    found |= {name: _png(8 + k % 3, 6, k) for k, name in enumerate(pictures)}
    return found | {"broken/bad.png": b"no picture at all", "broken/zero.png": b""}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_WRITTEN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder, written once a session; it goes when the session's JVM ends."""
    session = spark.sparkContext.applicationId
    if session not in _WRITTEN or not path_exists(spark, _WRITTEN[session]):
        root = scratch(spark, "fixture")
        rows = [(f"{root}/{name}", bytearray(content)) for name, content in files().items()]
        K.write_files(spark.createDataFrame(rows, "path string, content binary"))
        context = spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
        _WRITTEN[session] = root
    return _WRITTEN[session]


def inside(path: Column) -> Column:
    """Path below the fixture's folder."""
    return F.regexp_extract(path, r"(?:fixture|export)-[0-9a-f]{32}/(.*)$", 1)


def below(rows: DataFrame, column: str = "path") -> DataFrame:
    return rows.withColumn(column, inside(F.col(column)))
