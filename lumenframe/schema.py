"""Schemas and fixed dimensions of annotated image datasets."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType(
    [
        T.StructField("annotation_id", T.StringType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("xc", T.DoubleType()),
        T.StructField("yc", T.DoubleType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("iscrowd", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)

IMAGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("objects", T.ArrayType(BOX)),
    ]
)

# File suffixes by role.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
ANNOTATION_EXTENSIONS = (".txt", ".xml", ".json", ".csv")

# Class names and their aliases, by id.
CLASS_ALIASES = {
    0: ("RBC", "Red Blood Cell", "red blood cell"),
    1: ("WBC", "White Blood Cell", "white blood cell", "leukocyte"),
    2: ("Platelet", "platelet", "Platelets", "platelets"),
    3: ("Parasite", "parasite", "ring", "troph", "trophozoite", "schizont", "merozoite", "gametocyte"),
}

#: Box side, in pixels, that stands for a point annotation; and its default frame.
POINT_BOX = 70
POINT_FRAME = (640, 480)


def class_ids() -> dict[str, int]:
    return {alias: class_id for class_id, aliases in CLASS_ALIASES.items() for alias in aliases}

