"""Filters, lookups, set operations and joins on images and their boxes.

``images`` has one row per image (seq, image_id, image_path, dataset, width, height,
split), ``boxes`` one row per object (seq, object_index, class_id, ...). ``seq`` is the
order in which images were added; every "first" or "last" refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S


def find(images: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition holds; a null does not, and a bare condition reaches the scan."""
    return images.filter(condition)


def find_one(images: DataFrame, condition: Column) -> DataFrame:
    """The first match (no row without one)."""
    return find(images, condition).orderBy("seq").limit(1)


def by_dataset(images: DataFrame, name: str) -> DataFrame:
    return find(images, F.col("dataset") == name)


def by_split(images: DataFrame, split: str) -> DataFrame:
    return find(images, F.col("split") == split)


def train_set(images: DataFrame) -> DataFrame:
    return by_split(images, "train")


def val_set(images: DataFrame) -> DataFrame:
    return by_split(images, "val")


def test_set(images: DataFrame) -> DataFrame:
    return by_split(images, "test")


def by_class(images: DataFrame, boxes: DataFrame, class_name: str) -> DataFrame:
    """Images with an object of the class."""
    return images.join(boxes.filter(F.col("class_name") == class_name).select("seq"), "seq", "left_semi")


def object_counts(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("seq").agg(F.count("*").alias("n_objects"))


def search(
    images: DataFrame,
    boxes: DataFrame,
    *,
    dataset: str | None = None,
    split: str | None = None,
    class_name: str | None = None,
    min_objects: int | None = None,
    max_objects: int | None = None,
    min_width: int | None = None,
    min_height: int | None = None,
) -> DataFrame:
    """All given criteria; bounds are inclusive."""
    found = images
    if dataset is not None:
        found = by_dataset(found, dataset)
    if split is not None:
        found = by_split(found, split)
    if min_width is not None:
        found = find(found, F.col("width") >= min_width)
    if min_height is not None:
        found = find(found, F.col("height") >= min_height)
    if class_name is not None:
        found = by_class(found, boxes, class_name)
    if min_objects is not None or max_objects is not None:
        n = F.coalesce("n_objects", F.lit(0))
        keep = F.lit(True)
        if min_objects is not None:
            keep &= n >= min_objects
        if max_objects is not None:
            keep &= n <= max_objects
        found = found.join(object_counts(boxes), "seq", "left").filter(keep).drop("n_objects")
    return found


def lookup_last(images: DataFrame, key: str) -> DataFrame:
    """One row per key: the one added last."""
    columns = [c for c in images.columns if c != key]
    return images.groupBy(key).agg(F.max(F.struct("seq", *[c for c in columns if c != "seq"])).alias("r")).select(
        key, *[F.col(f"r.{c}").alias(c) for c in columns]
    )


def get_by_id(images: DataFrame, image_id: str) -> DataFrame:
    return find(images, F.col("image_id") == image_id).orderBy(F.desc("seq")).limit(1)


def get_by_path(images: DataFrame, image_path: str) -> DataFrame:
    return find(images, F.col("image_path") == image_path).orderBy(F.desc("seq")).limit(1)


def image_ids(images: DataFrame) -> DataFrame:
    """Distinct ids with the place of their first occurrence."""
    return images.groupBy("image_id").agg(F.min("seq").alias("first_seq"))


def union_sources(*parts: DataFrame) -> DataFrame:
    out, *rest = parts
    for part in rest:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def label_union(*labels: DataFrame) -> DataFrame:
    """Distinct labels of several one-column tables."""
    return union_sources(*labels).distinct()


def add_tag(tags: Column, tag: str) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(F.lit(tag)))


def get_metadata(metadata: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(default))


def update_metadata(metadata: Column, new: dict[str, str]) -> Column:
    """Map with ``new`` entries in place of old ones of the same keys."""
    added = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(*new))
    return F.map_concat(kept, added)


def with_class_labels(boxes: DataFrame, dim: DataFrame) -> DataFrame:
    """Label from a class dimension; ``Class_<id>`` where it has none.

    Spark broadcasts the dimension if its measured size allows.
    """
    default = F.concat(F.lit("Class_"), F.col("class_id").cast("string"))
    return boxes.join(dim, "class_id", "left").withColumn("label", F.coalesce("label", default))


def match_by_stem(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation path of each image with the same dataset and stem (null without one).

    Several annotations of one stem: the last by (priority, path) wins.
    """
    index = annotations.groupBy("dataset", "stem").agg(F.max(F.struct("priority", "annotation_path")).alias("a"))
    keyed = images.withColumn("stem", S.stem(F.col("image_path")))
    return keyed.join(index, ["dataset", "stem"], "left").withColumn("annotation_path", F.col("a.annotation_path")).drop("a")


def match_with_fallback(left: DataFrame, right: DataFrame, exact: str, fallback: str, value: str) -> DataFrame:
    """Value by the exact key, else by the fallback key (first by ``ord`` of the right side)."""
    by_exact = right.groupBy(exact).agg(F.max_by(value, "ord").alias("v_exact"))
    by_fallback = right.groupBy(fallback).agg(F.min_by(value, "ord").alias("v_fallback"))
    return (
        left.join(by_exact, exact, "left")
        .join(by_fallback, fallback, "left")
        .withColumn(value, F.coalesce("v_exact", "v_fallback"))
        .drop("v_exact", "v_fallback")
    )


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def passing(images: DataFrame, passed: DataFrame, key: str = "image_id") -> DataFrame:
    """Images whose key passed, if any row of that key did."""
    return images.join(passed.select(key).distinct(), key, "left_semi")


def missing_classes(boxes: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """seq, missing: expected class names that an image with objects lacks."""
    found = boxes.groupBy("seq").agg(F.collect_set("class_name").alias("found"))
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(e) for e in expected]), "found"))
    return found.select("seq", F.array_join(lacking, ",").alias("missing")).filter(F.col("missing") != "")


def duplicate_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of one image's objects with the same box: seq, i, j with i < j."""
    a = boxes.select("seq", F.col("object_index").alias("i"), "xc", "yc", "w", "h")
    b = boxes.select("seq", F.col("object_index").alias("j"), "xc", "yc", "w", "h")
    return a.join(b, ["seq", "xc", "yc", "w", "h"]).filter("i < j").select("seq", "i", "j")


#: Images with more objects than this are joined cell by cell, with about so many objects a cell, and so many cells a side at most.
CROWDED = 64
PER_CELL = 8
MOST_CELLS = 256


def overlapping_pairs(boxes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one image's objects whose overlap reaches ``threshold`` (seq, i, j, overlap).

    Boxes are corners x1, y1, x2, y2 in frame units. In a crowded image each box is
    dealt to the cells it touches of a grid as fine as its objects are many, and a pair
    is taken in the cell where its intersection begins; other images are one cell.
    """
    grid = F.col("cells")

    def cell(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(grid - 1, F.floor(value * grid).cast("int")))

    side_cells = F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt(F.col("n_objects") / PER_CELL)).cast("int"))
    sizes = object_counts(boxes).select("seq", F.when(F.col("n_objects") > CROWDED, side_cells).otherwise(1).alias("cells"))
    dealt = (
        boxes.filter("x2 > x1 AND y2 > y1")
        .join(sizes, "seq")
        .withColumn("gx", F.explode(F.sequence(cell(F.col("x1")), cell(F.col("x2")))))
        .withColumn("gy", F.explode(F.sequence(cell(F.col("y1")), cell(F.col("y2")))))
    )
    names = ("x1", "y1", "x2", "y2")
    size = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("size")

    def side(prefix: str, number: str) -> DataFrame:
        renamed = [F.col(n).alias(prefix + n) for n in names] + [size.alias(prefix + "size")]
        return dealt.select("seq", "gx", "gy", *(["cells"] if prefix == "a_" else []), F.col("object_index").alias(number), *renamed)

    pairs = side("a_", "i").join(side("b_", "j"), ["seq", "gx", "gy"]).filter("i < j")
    begin_x, begin_y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    w, h = F.least("a_x2", "b_x2") - begin_x, F.least("a_y2", "b_y2") - begin_y
    home = (cell(begin_x) == F.col("gx")) & (cell(begin_y) == F.col("gy"))
    shared = pairs.filter((w > 0) & (h > 0) & home).select("seq", "i", "j", (w * h).alias("shared"), (F.col("a_size") + F.col("b_size")).alias("sizes"))
    overlap = F.col("shared") / (F.col("sizes") - F.col("shared"))
    return shared.filter(overlap >= threshold).select("seq", "i", "j", overlap.alias("overlap"))

