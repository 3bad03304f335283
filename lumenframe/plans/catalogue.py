"""Registered queries of the engine: each operator applied to the star-schema tables.

Every query is a thin call of a library operator on the views of ``testbed``; its
DuckDB twin is in ``oracles`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import scalars as S
from lumenframe.operators import dataset as D
from lumenframe.operators import kernels as I
from lumenframe.operators import pixels as P
from lumenframe.operators import ranked as R
from lumenframe.operators import rules as V
from lumenframe.operators import statistics as T
from lumenframe.operators import training as M
from lumenframe.plans import build as U
from lumenframe.plans import fixtures as X
from lumenframe.plans import pipeline as Y
from lumenframe.plans import reports as E
from lumenframe.plans import testbed as B
from lumenframe.plans.oracles import ORACLES
from lumenframe.sources import annotations as A
from lumenframe.sources import listing as L
from lumenframe.sources import sinks as K
from lumenframe.sources import sniff as N

Query = Callable[[SparkSession, str], DataFrame]
#: Thresholds that some of the test tiles fail.
STRICT = P.Thresholds(126.0, 132.0, 34.0, 50.0, 9000.0, 5.2, 97.0)
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_index_by_dataset(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in _QUERIES if name in ORACLES}


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return B.images(spark, sf_dir), B.boxes(spark, sf_dir)


# -- views and projections ---------------------------------------------------


@query
def images_view(spark, sf_dir):
    return B.images(spark, sf_dir)


@query
def boxes_view(spark, sf_dir):
    return B.boxes(spark, sf_dir)


@query
def nested_view(spark, sf_dir):
    """Images with their objects as one array, told by its size and sums."""
    nested = B.nested(*_both(spark, sf_dir))
    area = F.aggregate("objects", F.lit(0.0), lambda a, o: a + o["w"] * o["h"])
    names = F.array_join(F.transform("objects", lambda o: o["class_name"]), "|")
    return nested.select("seq", F.size("objects").alias("n_objects"), F.round(area, 6).alias("total_area"), names.alias("names"))


@query
def path_parts(spark, sf_dir):
    path = F.col("url")
    return B.table(spark, sf_dir, "pages").select(
        "page_id", S.filename(path).alias("filename"), S.stem(path).alias("stem"), S.extension(path).alias("extension")
    )


@query
def normalized_class_names(spark, sf_dir):
    names = B.table(spark, sf_dir, "part").select(S.normalized_class_name(F.col("p_name")).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


@query
def null_safe_predicates(spark, sf_dir):
    images, boxes = _both(spark, sf_dir)
    joined = images.join(boxes, "seq", "left")
    return joined.groupBy("dataset").agg(
        F.count_if(S.is_positive(F.col("width"))).alias("n_positive"),
        F.count_if(S.is_non_negative(F.col("w"))).alias("n_non_negative"),
        F.count_if(S.is_normalized(F.col("xc"))).alias("n_normalized"),
        F.count_if(S.is_between(F.col("confidence"), 0.1, 0.9)).alias("n_between"),
        F.count_if(S.valid_size(F.col("width"), F.col("height"))).alias("n_valid_size"),
        F.count_if(G.is_valid_center_box(*[F.col(c) for c in ("xc", "yc", "w", "h")])).alias("n_valid_box"),
        F.count_if(S.is_blank(F.col("class_name"))).alias("n_blank"),
    )


@query
def safe_arithmetic(spark, sf_dir):
    return B.images(spark, sf_dir).select(
        "seq",
        F.round(S.aspect_ratio(F.col("width"), F.col("height")), 6).alias("aspect_ratio"),
        F.round(S.percentage(F.col("width"), F.col("height")), 6).alias("percent"),
        (F.col("width").cast("long") * F.col("height")).alias("total_pixels"),
    )


# -- format inference and parsing --------------------------------------------


@query
def sniff_text_formats(spark, sf_dir):
    """What each document would be taken for as an annotation file."""
    docs = B.table(spark, sf_dir, "documents")
    kind = N.detect(F.lit("a.txt"), F.col("text"))
    return docs.groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


@query
def sniff_keyword_score(spark, sf_dir):
    score = N.keyword_score(F.col("text"), ("the", "und", "que", "les", "ción"))
    return B.table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


def _label_texts(spark, sf_dir):
    """Label lines of each order, as text."""
    lines = B.boxes(spark, sf_dir).select(
        "seq", "object_index", F.format_string("%d %.3f %.2f %.6f %.5f", "class_id", "xc", "yc", "w", "h").alias("line")
    )
    grouped = lines.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("object_index", "line"))).alias("l"))
    return grouped.select("seq", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


@query
def parse_yolo_text(spark, sf_dir):
    texts = _label_texts(spark, sf_dir)
    found = texts.select("seq", F.posexplode(A.yolo_boxes(F.col("text"))).alias("object_index", "b"))
    return found.select("seq", "object_index", "b.class_id", "b.xc", "b.yc", "b.w", "b.h")


@query
def parse_point_text(spark, sf_dir):
    line = F.concat_ws(" ", F.col("l_partkey") % 640, F.col("l_suppkey") % 480, F.col("l_linenumber"))
    texts = B.table(spark, sf_dir, "lineitem").select(F.concat(line, F.lit("\n\nbroken line\n")).alias("text"))
    found = texts.select(F.explode(A.point_boxes(F.col("text"))).alias("b"))
    return found.groupBy("b.class_id").agg(
        F.count("*").alias("n"), F.round(F.avg("b.xc"), 6).alias("mean_xc"), F.round(F.avg("b.yc"), 6).alias("mean_yc"), F.round(F.max("b.w"), 6).alias("w")
    )


@query
def parse_key_value_report(spark, sf_dir):
    customers = B.table(spark, sf_dir, "customer")
    text = F.concat(
        F.lit("Hemoglobin: 1.5\nBalance: "), F.col("c_custkey").cast("string"), F.lit("\nSegment: "), F.col("c_mktsegment"),
        F.lit("\nHemoglobin: 13.5\nMorphology: "), F.lower("c_mktsegment"), F.lit(", , small\n"),
    )
    values, findings = A.report_values(text), A.report_findings(text)
    return customers.select(
        "c_custkey",
        F.try_element_at(values, F.lit("Hemoglobin")).alias("hemoglobin"),
        F.try_element_at(values, F.lit("Balance")).alias("balance"),
        F.size(values).alias("n_values"),
        F.array_join(findings, "|").alias("findings"),
    )


@query
def parse_json_props(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return events.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


@query
def rowcol_json_to_box(spark, sf_dir):
    """Row/column records written as JSON and parsed again."""
    point = lambda r, c: F.struct(r.alias("r"), c.alias("c"))
    p, s, q = F.col("l_partkey") % 400, F.col("l_suppkey") % 300, F.col("l_quantity").cast("long")
    category = F.when(F.col("l_returnflag") == "A", "Trophozoite").when(F.col("l_returnflag") == "N", "red blood cell").otherwise("difficult")
    box = F.struct(point(s, p).alias("minimum"), point(s + q, p + 2 * q).alias("maximum"))
    record = F.to_json(
        F.struct(
            F.struct(F.lit("/a.png").alias("pathname"), point(F.lit(600), F.lit(800)).alias("shape")).alias("image"),
            F.array(F.struct(category.alias("category"), box.alias("bounding_box"))).alias("objects"),
        )
    )
    texts = B.table(spark, sf_dir, "lineitem").select(record.alias("text"))
    found = texts.select(F.explode(A.rowcol_records(F.col("text"))).alias("r")).select(F.explode(A.rowcol_boxes(F.col("r"))).alias("b"))
    return found.groupBy("b.class_id").agg(
        F.count("*").alias("n"), F.round(F.sum("b.xc"), 4).alias("sum_xc"), F.round(F.sum("b.yc"), 4).alias("sum_yc"), F.round(F.sum(F.col("b.w") * F.col("b.h")), 6).alias("sum_area")
    )


@query
def coco_join(spark, sf_dir):
    """COCO documents of a dataset, one for each range of images, joined back to boxes."""
    images, boxes = _both(spark, sf_dir)
    images = images.withColumn("file", F.concat_ws("/", "dataset", F.floor(F.col("seq") / 4096).cast("string")))
    i = images.groupBy("file").agg(
        F.collect_list(F.struct(F.col("seq").alias("id"), F.concat(F.col("seq").cast("string"), F.lit(".jpg")).alias("file_name"), "width", "height")).alias("images")
    )
    bbox = F.array(F.col("xc") * 100, F.col("yc") * 100, F.col("w") * 100, F.col("h") * 100)
    a = boxes.join(images.select("seq", "file"), "seq").groupBy("file").agg(
        F.collect_list(F.struct(F.lit(0).cast("long").alias("id"), F.col("seq").alias("image_id"), F.col("class_id").alias("category_id"), bbox.alias("bbox"))).alias("annotations")
    )
    names = F.array(F.struct(F.lit(0).alias("id"), F.lit("erythrocyte").alias("name")), F.struct(F.lit(3).alias("id"), F.lit("parasite").alias("name")))
    documents = i.join(a, "file").select("file", F.struct("images", "annotations", names.alias("categories")).alias("doc"))
    found = A.coco_boxes(documents)
    return found.groupBy(F.substring_index("file", "/", 1).alias("dataset"), "class_name").agg(
        F.count("*").alias("n"), F.round(F.sum("xc"), 4).alias("sum_xc"), F.round(F.sum("w"), 4).alias("sum_w"), F.count_if(F.col("w") == 0).alias("n_flat")
    )


@query
def dataset_format_cascade(spark, sf_dir):
    """The format of a dataset whose files are the orders' images and label texts."""
    images = B.images(spark, sf_dir).select(F.col("image_path").alias("path"), F.lit(None).cast("string").alias("text"))
    labels = _label_texts(spark, sf_dir).select(F.concat(F.lit("labels/"), F.col("seq").cast("string"), F.lit(".txt")).alias("path"), "text")
    return N.dataset_format(images.unionByName(labels))


# -- filters and lookups -----------------------------------------------------


@query
def filter_by_dataset(spark, sf_dir):
    return D.by_dataset(B.images(spark, sf_dir), "1-URGENT")


@query
def filter_by_split(spark, sf_dir):
    return D.val_set(B.images(spark, sf_dir))


@query
def filter_by_class(spark, sf_dir):
    return D.by_class(*_both(spark, sf_dir), "cell-RF")


@query
def composite_search(spark, sf_dir):
    return D.search(
        *_both(spark, sf_dir), dataset="2-HIGH", split="train", class_name="cell-AF", min_objects=2, max_objects=6, min_width=300, min_height=160
    )


@query
def lookup_last_wins(spark, sf_dir):
    return D.lookup_last(B.images(spark, sf_dir), "image_id")


@query
def first_match(spark, sf_dir):
    return D.find_one(B.images(spark, sf_dir), (F.col("width") >= 1000) & (F.col("split") == "val"))


@query
def distinct_ids_first_seen(spark, sf_dir):
    return D.image_ids(B.images(spark, sf_dir))


@query
def point_lookups(spark, sf_dir):
    """Images found by id and by path, and the sizes of the splits."""
    images = B.images(spark, sf_dir)
    path = "2-HIGH/img_33.tif"
    parts = {"id": D.get_by_id(images, "img_33"), "path": D.get_by_path(images, path), "no id": D.get_by_id(images, "nothing")}
    found = D.union_sources(*[rows.select(F.lit(k).alias("what"), F.col("seq").alias("value")) for k, rows in parts.items()])
    sizes = {"train": D.train_set(images), "val": D.val_set(images), "test": D.test_set(images)}
    return D.union_sources(found, *[rows.agg(F.count("*").alias("value")).withColumn("what", F.lit(k)) for k, rows in sizes.items()])


# -- geometry ----------------------------------------------------------------


def _corners(spark, sf_dir):
    """Pairs of corner boxes of line items: x1..y2 and u1..v2, some inverted."""
    p, s, q, n = F.col("l_partkey") % 500, F.col("l_suppkey") % 60, F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    d = lambda c: c.cast("double")
    return B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"),
        d(p).alias("x1"), d(s).alias("y1"), d(p + q - 3).alias("x2"), d(s + 2 * q - 5).alias("y2"),
        d(p + n * 4 - 8).alias("u1"), d(s + n * 3 - 6).alias("v1"), d(p + n * 4 + 12).alias("u2"), d(s + n * 3 + 20).alias("v2"),
    )


_ONE, _TWO = ("x1", "y1", "x2", "y2"), ("u1", "v1", "u2", "v2")


def _rounded(box: G.Box, prefix: str, places: int = 6) -> list[Column]:
    return [F.round(v, places).alias(f"{prefix}{k}") for k, v in enumerate(box, 1)]


@query
def box_basic(spark, sf_dir):
    a = G.Box.of(*_ONE)
    cx, cy = G.center(a)
    return _corners(spark, sf_dir).select(
        *_ONE, G.width(a).alias("width"), G.height(a).alias("height"), G.area(a).alias("area"), cx.alias("cx"), cy.alias("cy"), F.round(G.diagonal(a), 6).alias("diagonal")
    )


@query
def box_convert_roundtrip(spark, sf_dir):
    w, h = F.lit(640), F.lit(480)
    centre = G.convert(G.Box.of(*_ONE), "VOC", "yolo", w, h)
    back = G.convert(centre, "yolo", "voc", w, h)
    return _corners(spark, sf_dir).select(*_ONE, *_rounded(centre, "c", 9), *_rounded(back, "b"))


@query
def box_iou_pairs(spark, sf_dir):
    a, b = G.Box.of(*_ONE), G.Box.of(*_TWO)
    return _corners(spark, sf_dir).select(
        *_ONE, *_TWO,
        G.intersection(a, b).alias("intersection"), G.union_area(a, b).alias("union_area"), F.round(G.iou(a, b), 6).alias("iou"),
        F.round(G.overlap_ratio(a, b), 6).alias("overlap_ratio"), G.intersects(a, b).alias("intersects"),
    )


@query
def box_contains_clip(spark, sf_dir):
    a, b = G.Box.of(*_ONE), G.Box.of(*_TWO)
    w, h = F.lit(400), F.lit(60)
    return _corners(spark, sf_dir).select(
        *_ONE, *_TWO, G.contains(b, a).alias("contained"), G.inside_image(a, w, h).alias("inside"), *_rounded(G.clip(a, w, h), "k")
    )


@query
def box_transforms(spark, sf_dir):
    a = G.Box.of(*_ONE)
    return _corners(spark, sf_dir).select(
        *_ONE, *_rounded(G.scale(a, 2.0, 0.5), "s"), *_rounded(G.translate(a, 3.0, -4.0), "t"), *_rounded(G.expand(a, 2.0), "e"), *_rounded(G.shrink(a, 2.0), "h")
    )


@query
def box_distances(spark, sf_dir):
    a, b = G.Box.of(*_ONE), G.Box.of(*_TWO)
    return _corners(spark, sf_dir).select(*_ONE, *_TWO, F.round(G.center_distance(a, b), 6).alias("distance"))


@query
def box_arrays(spark, sf_dir):
    """Boxes as arrays of any length: which are boxes, and what the others count as."""
    p, s = F.col("l_partkey") % 7, F.col("l_suppkey") % 5
    corners = F.array(p.cast("double"), s.cast("double"), (p + 3).cast("double"), F.when(s > 0, s * 2.0))
    array = F.when(p == 0, F.slice(corners, 1, 3)).when(p == 1, F.lit(None)).otherwise(corners)
    box = G.Box.of_array(array)
    return B.table(spark, sf_dir, "lineitem").groupBy(G.is_well_formed(array).alias("well_formed")).agg(
        F.count("*").alias("n"), F.sum(G.area(box)).alias("area"), F.sum(G.side_area(box.x2, box.y2)).alias("sides"), F.count(box.x1).alias("n_known")
    )


@query
def crop_rectangles(spark, sf_dir):
    images, boxes = _both(spark, sf_dir)
    joined = boxes.join(images.select("seq", "width", "height"), "seq")
    bounds = G.crop_bounds(G.Box.of("xc", "yc", "w", "h"), F.col("width"), F.col("height"))
    cropped = joined.select("seq", "object_index", *[v.alias(n) for n, v in zip(_ONE, bounds)])
    return cropped.filter("x2 > x1 AND y2 > y1")


# -- joins and sets ----------------------------------------------------------


@query
def class_dim_left_default(spark, sf_dir):
    labelled = D.with_class_labels(B.boxes(spark, sf_dir), B.class_dim(spark))
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def _annotations(spark, sf_dir):
    """Annotation files of some images: several suffixes for one stem."""
    images = B.images(spark, sf_dir).filter("seq % 5 < 3")
    suffix = F.when(F.col("seq") % 2 == 0, ".txt").otherwise(".xml")
    path = F.concat(F.col("dataset"), F.lit("/labels/"), F.col("image_id"), suffix)
    priority = F.when(F.col("seq") % 2 == 0, 0).otherwise(1)
    return images.select("dataset", F.col("image_id").alias("stem"), path.alias("annotation_path"), priority.alias("priority"))


@query
def stem_match_left(spark, sf_dir):
    matched = D.match_by_stem(B.images(spark, sf_dir), _annotations(spark, sf_dir))
    return matched.select("seq", "image_path", "annotation_path")


@query
def stem_fallback(spark, sf_dir):
    """Customer by exact name, else by number without leading zeros."""
    customers = B.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("none").alias("exact"),
        (F.col("c_custkey") % 700).cast("string").alias("short"),
        F.col("c_custkey").alias("ord"),
        F.col("c_acctbal").alias("balance"),
    )
    left = B.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("exact"), (F.col("c_custkey") % 900).cast("string").alias("short"))
    return D.match_with_fallback(left, customers, "exact", "short", "balance").select("c_custkey", "balance")


@query
def missing_annotation_anti(spark, sf_dir):
    images, boxes = _both(spark, sf_dir)
    return D.missing(images, boxes, "seq").select("seq", "image_path")


@query
def missing_labels_anti(spark, sf_dir):
    docs, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    return D.missing(docs, labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query
def passing_semi(spark, sf_dir):
    images = B.images(spark, sf_dir)
    passed = images.filter("width >= 500 AND height >= 320").select("image_id")
    return D.passing(images, passed).select("seq", "image_id")


@query
def dup_pairs_selfjoin(spark, sf_dir):
    return D.duplicate_pairs(B.boxes(spark, sf_dir).withColumns({"xc": F.floor(F.col("xc") * 3), "yc": F.floor(F.col("yc") * 2), "w": F.lit(1.0), "h": F.lit(1.0)}))


def _unit_corners(spark, sf_dir):
    box = G.Box(F.col("xc") - F.col("w") / 2, F.col("yc") - F.col("h") / 2, F.col("xc") + F.col("w") / 2, F.col("yc") + F.col("h") / 2)
    return B.boxes(spark, sf_dir).select("seq", "object_index", *[v.alias(n) for n, v in zip(_ONE, box)])


@query
def overlap_theta_selfjoin(spark, sf_dir):
    found = D.overlapping_pairs(_unit_corners(spark, sf_dir), 0.3)
    return found.select("seq", "i", "j", F.round("overlap", 6).alias("overlap"))


@query
def missing_classes_except(spark, sf_dir):
    return D.missing_classes(B.boxes(spark, sf_dir), ("cell-AF", "cell-NO", "cell-RF"))


@query
def union_sources(spark, sf_dir):
    parts = [
        B.table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("key"))
        for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
    ]
    return D.union_sources(*parts).groupBy("source").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


@query
def label_union(spark, sf_dir):
    parts = B.table(spark, sf_dir, "part")
    return D.label_union(parts.select(F.col("p_type").alias("label")), parts.select(F.col("p_brand").alias("label")))


@query
def unassigned_to_train(spark, sf_dir):
    split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("train"))
    return B.images(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query
def metadata_update(spark, sf_dir):
    images = B.images(spark, sf_dir)
    metadata = F.create_map(F.lit("dataset"), F.col("dataset"), F.lit("stage"), F.lit("raw"))
    new = D.update_metadata(metadata, {"stage": "clean", "by": "filter"})
    tags = D.add_tag(D.add_tag(F.array(F.lit("a")), "b"), "a")
    return images.select(
        "seq",
        D.get_metadata(new, "dataset").alias("dataset"), D.get_metadata(new, "stage").alias("stage"), D.get_metadata(new, "none", "-").alias("absent"),
        F.array_join(tags, ",").alias("tags"),
    )


# -- aggregates --------------------------------------------------------------


@query
def dataset_statistics(spark, sf_dir):
    return T.dataset_statistics(*_both(spark, sf_dir), by=["dataset"])


@query
def class_balance(spark, sf_dir):
    return T.class_balance(B.boxes(spark, sf_dir))


@query
def split_counts(spark, sf_dir):
    return T.split_counts(B.images(spark, sf_dir))


@query
def summary(spark, sf_dir):
    return T.summary(*_both(spark, sf_dir))


@query
def v1_statistics(spark, sf_dir):
    return T.v1_statistics(*_both(spark, sf_dir))


@query
def v2_image_stats(spark, sf_dir):
    return T.v2_image_statistics(*_both(spark, sf_dir))


@query
def v2_box_stats(spark, sf_dir):
    return T.v2_box_statistics(B.boxes(spark, sf_dir))


@query
def extension_histogram(spark, sf_dir):
    return T.extension_histogram(B.images(spark, sf_dir))


@query
def modal_extension(spark, sf_dir):
    return T.modal_extension(B.images(spark, sf_dir))


@query
def distributions(spark, sf_dir):
    return T.distributions(*_both(spark, sf_dir))


@query
def object_class_counts(spark, sf_dir):
    return T.object_class_counts(B.boxes(spark, sf_dir))


def _predicted(spark, sf_dir):
    """Embeddings with a rule's guess of their label."""
    guess = (F.col("vec_id") * 7 + F.col("label") * 3) % 10
    return B.table(spark, sf_dir, "embeddings").select(
        "label", F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(guess).cast("int").alias("predicted")
    )


@query
def confusion_matrix(spark, sf_dir):
    return T.confusion_matrix(_predicted(spark, sf_dir), "label", "predicted")


@query
def precision_recall_f1(spark, sf_dir):
    return T.precision_recall_f1(_predicted(spark, sf_dir), "label", "predicted")


@query
def accuracy(spark, sf_dir):
    return T.accuracy(_predicted(spark, sf_dir), "label", "predicted")


@query
def correlations(spark, sf_dir):
    return T.correlations(B.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query
def balanced_class_weights(spark, sf_dir):
    return T.balanced_weights(B.boxes(spark, sf_dir), "class_id")


@query
def build_log_report(spark, sf_dir):
    """Found, built and failed images of each dataset."""
    matched = D.match_by_stem(B.images(spark, sf_dir), _annotations(spark, sf_dir))
    built = F.col("annotation_path").isNotNull()
    return matched.groupBy("dataset").agg(
        F.count("*").alias("n_found"), F.count_if(built).alias("n_built"), F.count_if(~built).alias("n_failed"), F.round(F.count_if(built) * 100.0 / F.count("*"), 2).alias("percent")
    )


# -- windows -----------------------------------------------------------------


@query
def assign_splits_stratified(spark, sf_dir):
    return R.assign_splits(B.images(spark, sf_dir)).select("seq", "dataset", "split", "new_split")


@query
def assign_splits_global(spark, sf_dir):
    dealt = R.assign_splits(B.images(spark, sf_dir), 0.6, 0.2, 0.2, stratify_by=None, seed=7, overwrite=True)
    return dealt.select("seq", "new_split")


@query
def dup_first_seen(spark, sf_dir):
    found = R.first_seen(B.images(spark, sf_dir), [F.lower("image_path")], ["seq"])
    return found.select("seq", "image_path", "is_repeat")


@query
def content_hash_dedup(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return R.first_seen(docs, [F.col("digest")], ["doc_id"]).select("doc_id", "is_repeat")


@query
def capped_per_class(spark, sf_dir):
    kept = R.capped(B.boxes(spark, sf_dir), "class_id", ["seq", "object_index"], 25)
    return kept.select("seq", "object_index", "class_id")


@query
def capped_random_subset(spark, sf_dir):
    return R.capped_random(B.images(spark, sf_dir), "dataset", "seq", 40, seed=42).select("dataset", "seq")


@query
def contiguous_relabel(spark, sf_dir):
    relabelled = R.relabel(B.boxes(spark, sf_dir))
    return relabelled.groupBy("class_id", "new_id").agg(F.count("*").alias("n"))


@query
def sequential_issue_ids(spark, sf_dir):
    images, boxes = _both(spark, sf_dir)
    found = R.issue_ids(V.v1_issues(images, boxes))
    return found.select("issue_id", "stage", "seq", "rule_id", "object_index")


@query
def pixel_cdf(spark, sf_dir):
    tiles = B.tiles(spark, sf_dir)
    counts = tiles.select("label", F.explode("pixels").alias("value")).groupBy("label", "value").agg(F.count("*").alias("n"))
    return R.cumulative(counts, "label", "value", "n")


# -- rules -------------------------------------------------------------------


def _by_rule(issues: DataFrame) -> DataFrame:
    return issues.groupBy("stage", "rule_id", "severity", "category").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_total"))


@query
def rules_v1_counts(spark, sf_dir):
    return _by_rule(V.v1_issues(*_both(spark, sf_dir)))


@query
def rules_v1_rows(spark, sf_dir):
    found = V.v1_issues(*_both(spark, sf_dir))
    return found.select("rule_id", "severity", "dataset", "seq", "object_index")


@query
def rules_v2_counts(spark, sf_dir):
    return _by_rule(V.v2_issues(*_both(spark, sf_dir), min_side=32, max_side=1100, expected=("cell-AF", "cell-NO")))


@query
def rules_v2_corner_boxes(spark, sf_dir):
    images = B.images(spark, sf_dir).select("seq", "dataset", "image_path", "width", "height")
    corners = _corners(spark, sf_dir).select("seq", F.col("u1").alias("x1"), F.col("v1").alias("y1"), "x2", "y2")
    return _by_rule(V.apply(corners.join(images, "seq"), V.v2_corner_box_rules(max_share=0.01, max_aspect=4.0), "v2", F.lit(0)))


def _files(spark, sf_dir):
    """Images and some annotations as a file listing."""
    images = B.images(spark, sf_dir).select(F.col("image_path").alias("path"), F.col("seq").alias("length"), F.lit("image").alias("kind"))
    notes = _annotations(spark, sf_dir).select(F.col("annotation_path").alias("path"), (F.length("stem") - 6).cast("long").alias("length"), F.lit("annotation").alias("kind"))
    return images.unionByName(notes)


@query
def rules_v2_dataset(spark, sf_dir):
    found = V.v2_dataset_issues(_files(spark, sf_dir))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("image_path").alias("n_paths"))


@query
def rules_v1_planted(spark, sf_dir):
    """The first engine on views in which every defect is planted."""
    return _by_rule(V.v1_issues(B.planted_images(spark, sf_dir), B.planted_boxes(spark, sf_dir)))


@query
def rules_v2_planted(spark, sf_dir):
    """The second engine on views in which every defect is planted."""
    images, boxes = B.planted_images(spark, sf_dir), B.planted_boxes(spark, sf_dir)
    return _by_rule(V.v2_issues(images, boxes, expected=("cell-AF", "cell-NO"), valid_class_ids=(0, 1, 3, 7, 12)))


@query
def rules_raw_boxes(spark, sf_dir):
    """Checks of boxes as raw JSON texts."""
    images = B.planted_images(spark, sf_dir).select("seq", "dataset", "image_path")
    boxes = B.planted_boxes(spark, sf_dir).select("seq", "object_index", "bbox_raw")
    return _by_rule(V.apply(boxes.join(images, "seq"), V.v2_raw_box_rules(), "v2", F.col("object_index")))


@query
def rules_dataset_stage(spark, sf_dir):
    """Whole-dataset checks of both engines on folders and datasets that lack something."""
    images, boxes = _both(spark, sf_dir)
    none = boxes.limit(0)
    listing = "path string, length long, kind string, readable boolean"
    empty = spark.createDataFrame([], listing)
    only_other = spark.createDataFrame([("d/readme.md", 3, "other", True)], listing)
    odd = [("d/a.jpg", 5, "image", True), ("e/a.jpg", 5, "image", True), ("d/b.png", 5, "image", True), ("d/a.txt", 0, "annotation", True), ("d/b.txt", 9, "annotation", False)]
    cases = {
        "v1 none": V.v1_dataset_issues(None, none),
        "v1 empty": V.v1_dataset_issues(images.limit(0), none),
        "v1 no boxes": V.v1_dataset_issues(images, none),
        "v1 whole": V.v1_dataset_issues(images, boxes),
        "v2 no root": V.v2_dataset_issues(empty, root_found=False),
        "v2 file as root": V.v2_dataset_issues(empty, root_is_folder=False),
        "v2 empty": V.v2_dataset_issues(empty),
        "v2 only other": V.v2_dataset_issues(only_other),
        "v2 odd": V.v2_dataset_issues(spark.createDataFrame(odd, listing)),
        "v2 no name": V.v2_stages(images.limit(0), none)[0],
        "v2 name": V.v2_stages(images, boxes)[0],
    }
    found = D.union_sources(*[rows.select(F.lit(name).alias("case"), "stage", "rule_id", "severity", "category", "image_path") for name, rows in cases.items()])
    return found


@query
def dataset_names(spark, sf_dir):
    return V.dataset_name(B.images(spark, sf_dir))


@query
def stop_on_error(spark, sf_dir):
    """Stages up to the first with an error: the second engine without its name stage stops after the images."""
    images, boxes = _both(spark, sf_dir)
    return _by_rule(V.until_error(V.v2_stages(images, boxes, max_side=1100)))


@query
def issues_as_json(spark, sf_dir):
    """Issues written as JSON, read again, and selected by severity and category."""
    issues = V.issues_from_json(V.issue_json(V.v1_issues(*_both(spark, sf_dir))))
    errors, of_boxes = V.by_severity(issues, "ERROR"), V.by_category(issues, "BOUNDING_BOX")
    parts = [rows.select(F.lit(name).alias("kind"), "rule_id", "dataset", "seq", "object_index") for name, rows in (("error", errors), ("box", of_boxes))]
    return D.union_sources(*parts).groupBy("kind", "rule_id", "dataset").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_total"), F.sum("object_index").alias("index_total"))


@query
def failed_check_issue(spark, sf_dir):
    """A check that cannot be planned becomes an issue."""
    images = B.images(spark, sf_dir)
    bad = V.guarded(spark, "bbox", "check_nothing", lambda: images.select("no_such_column"))
    odd = V.exception_issue(spark, "weather", "check_rain", "wet", "d", "p")
    fine = V.guarded(spark, "image", "check_fine", lambda: V.apply(images, [], "v2"))
    found = D.union_sources(bad, odd, fine)
    return found.select("engine", "stage", "severity", "category", F.substring_index("message", ":", 1).alias("rule"), "dataset", "image_path", F.length("rule_id").alias("id_length"))


@query
def rule_listing(spark, sf_dir):
    """Stage, id and severity of every rule of the second engine's row checks."""
    rules = V.v2_image_rules() + V.v2_object_rules((0,)) + V.v2_raw_box_rules() + V.v2_center_box_rules()[1:] + V.v2_corner_box_rules()[1:]
    return spark.createDataFrame(V.list_rules(rules), "stage string, rule_id string, severity string")


@query
def rules_v2_overlaps(spark, sf_dir):
    images, boxes = _both(spark, sf_dir)
    found = V.v2_pair_issues(images, V.with_corners(boxes), 0.5)
    return found.groupBy("rule_id", "dataset").agg(F.count("*").alias("n"))


@query
def issue_rollup(spark, sf_dir):
    rolled = V.rollup(V.v1_issues(*_both(spark, sf_dir)), ["dataset"])
    return V.success_rate(rolled).select("dataset", "n_issues", "n_info", "n_warning", "n_error", "n_critical", "passed", "success_rate")


@query
def topk_reasons(spark, sf_dir):
    return T.top_reasons(V.v1_issues(*_both(spark, sf_dir)), "rule_id", 5)


@query
def v1_index(spark, sf_dir):
    """Index of all issues of each dataset; scores of many issues are 0."""
    scored = V.v1_index(V.rollup(V.v1_issues(*_both(spark, sf_dir)), ["dataset"]))
    return scored.select("dataset", "annotation_score", "image_score", "class_score", "box_score", "quality_index")


@query
def quality_index_by_dataset(spark, sf_dir):
    return V.quality_by_dataset(*_both(spark, sf_dir))


# -- pixels ------------------------------------------------------------------


@query
def pixel_measures(spark, sf_dir):
    found = P.measured(B.tiles(spark, sf_dir), 8)
    return found.select("vec_id", "brightness", "contrast", "dynamic_range", "entropy", "blur_score", "sharpness", "quality_score", F.array_join("issues", ",").alias("issues"))


@query
def pixel_histogram_moments(spark, sf_dir):
    p = F.col("pixels")
    return B.tiles(spark, sf_dir).select(
        "vec_id", F.array_min(p).alias("least"), F.array_max(p).alias("most"), F.round(P.brightness(p), 4).alias("mean"), P.median(p).alias("median"), F.round(P.variance(p), 4).alias("variance")
    )


@query
def assessment_report(spark, sf_dir):
    return P.assessment_report(P.measured(B.tiles(spark, sf_dir), 8), ["label"])


@query
def gate_report(spark, sf_dir):
    return P.gate_report(P.measured(B.tiles(spark, sf_dir), 8), 95.0, ["label"])


@query
def quality_issue_histogram(spark, sf_dir):
    return P.issue_histogram(P.measured(B.tiles(spark, sf_dir), 8, STRICT))


@query
def sharp_issue_histogram(spark, sf_dir):
    """Issues of tiles when sharpness counts too."""
    rows = P.measured(B.tiles(spark, sf_dir), 8)
    names = ("brightness", "contrast", "blur_score", "entropy", "quality_score", "sharpness")
    strict = P.Thresholds(minimum_sharpness=190.0, minimum_contrast=36.0)
    issues = P.quality_issues({n: F.col(n) for n in names}, strict, with_sharpness=True)
    return P.issue_histogram(rows.select(issues.alias("issues")))


def _mapped(spark, sf_dir, value: Column, places: int | None = None) -> DataFrame:
    shown = value if places is None else F.transform(value, lambda x: F.round(x, places))
    exploded = B.tiles(spark, sf_dir).select("vec_id", F.posexplode(shown).alias("place", "value"))
    return exploded


@query
def norm_minmax(spark, sf_dir):
    return _mapped(spark, sf_dir, P.min_max_normalize(F.col("pixels")), 6)


@query
def norm_zscore_clip(spark, sf_dir):
    return _mapped(spark, sf_dir, P.z_score(F.col("pixels")), 6)


@query
def norm_standardize(spark, sf_dir):
    return _mapped(spark, sf_dir, P.standardize(F.col("pixels"), 0.485, 0.229), 6)


@query
def norm_unit(spark, sf_dir):
    return _mapped(spark, sf_dir, P.unit_scale(F.col("pixels")), 6)


@query
def unit_rows(spark, sf_dir):
    """Tiles as vectors of length 1."""
    return _mapped(spark, sf_dir, P.rows_unit_length(F.col("pixels")), 6)


@query
def contrast_stretch(spark, sf_dir):
    return _mapped(spark, sf_dir, P.contrast_stretch(F.col("pixels"), 64, 192))


@query
def hist_stretch(spark, sf_dir):
    return _mapped(spark, sf_dir, P.histogram_stretch(F.col("pixels")))


def _kernels(spark, sf_dir, f, color: bool = False, places: int | None = None) -> DataFrame:
    """What kernels make of each tile: channel k of ``f``'s result is its k-th layer."""
    tiles = B.color_tiles(spark, sf_dir) if color else B.tiles(spark, sf_dir)
    made = P.kernel(tiles, f, 8, channels=3 if color else 1)
    return made if places is None else made.withColumn("value", F.round("value", places))


@query
def equalize(spark, sf_dir):
    return _kernels(spark, sf_dir, I.equalize).select("vec_id", "place", F.col("value").cast("int").alias("value"))


@query
def adjust_contrast(spark, sf_dir):
    return _mapped(spark, sf_dir, P.scale_contrast(P.add_brightness(F.col("pixels"), 12.0), 1.5))


@query
def brightness_normalize(spark, sf_dir):
    return _mapped(spark, sf_dir, P.brightness_normalize(F.col("pixels")))


@query
def od_transform(spark, sf_dir):
    return _mapped(spark, sf_dir, P.optical_density(F.col("pixels")), 6)


@query
def gamma_lut(spark, sf_dir):
    table = P.gamma_table(2.0)
    return _mapped(spark, sf_dir, P.look_up(F.col("pixels"), table))


@query
def cdf_match(spark, sf_dir):
    """Levels matched to those of a ramp of 64 values."""
    ramp = (np.arange(64) * 4 + 1).astype(np.uint8).reshape(8, 8)
    made = _kernels(spark, sf_dir, lambda t: I.match_histogram(t, ramp))
    return made.select("vec_id", "place", F.col("value").cast("int").alias("value"))


@query
def channel_histogram(spark, sf_dir):
    made = _kernels(spark, sf_dir, lambda t: I.color_histogram(t[..., None]).astype(float), places=6)
    return made.select("vec_id", "place", "value")


@query
def color_histogram(spark, sf_dir):
    return _kernels(spark, sf_dir, lambda t: I.color_histogram(t).astype(float), True, 6).select("vec_id", "place", "value")


@query
def pixel_noise(spark, sf_dir):
    """Spread of what a small blur takes away."""
    noise = P.measures(F.col("pixels"), 8)["noise_level"]
    return B.tiles(spark, sf_dir).select("vec_id", F.round(noise, 4).alias("noise_level"))


@query
def kernel_morphology(spark, sf_dir):
    """Layers: the seven operations on a square of three, erosion by a cross, dilation by an ellipse of five."""
    names = ("erosion", "dilation", "opening", "closing", "gradient", "tophat", "blackhat")

    def layers(t):
        return np.dstack([I.morphology(t, n) for n in names] + [I.erode(t, I.element("cross", 3)), I.dilate(t, I.element("ellipse", 5))])

    return _kernels(spark, sf_dir, layers)


@query
def kernel_filters(spark, sf_dir):
    """Layers: median, Gaussian and bilateral blur of three, sharpening by kernel, by Laplacian and by unsharp mask."""

    def layers(t):
        blurred = [I.median_blur(t, 3), I.gaussian_blur(t, 3), I.bilateral(t, 3)]
        return np.dstack([*blurred, I.kernel_sharpen(t), I.laplacian_sharpen(t), I.unsharp_mask(t)])

    return _kernels(spark, sf_dir, layers)


@query
def kernel_clahe(spark, sf_dir):
    """Contrast-limited equalisation in one tile."""
    return _kernels(spark, sf_dir, lambda t: I.clahe(t, 2.0, 1))


@query
def kernel_clahe_bright(spark, sf_dir):
    """The same, brought back to the tile's own brightness."""
    return _kernels(spark, sf_dir, lambda t: I.clahe(t, 2.0, 1, keep_brightness=True))


@query
def odd_sizes(spark, sf_dir):
    """Sizes as kernels take them: odd, at least 1."""
    return spark.createDataFrame([(n, I.odd(n)) for n in (-3, 0, 1, 2, 3, 8, 9)], "size int, odd int")


@query
def od_inverse(spark, sf_dir):
    """Levels of a density that is a tenth higher."""
    density = F.transform(P.optical_density(F.col("pixels")), lambda d: d * 1.1)
    return _mapped(spark, sf_dir, P.from_optical_density(density))


@query
def color_step(spark, sf_dir):
    """The colour step of a pipeline on gray tiles: brightness, then contrast."""
    step = Y.default_registry().create("color", white_balance=False, brightness=12.0, contrast=1.5)
    return _kernels(spark, sf_dir, step)


@query
def step_dispatch(spark, sf_dir):
    """Each method of each step against the kernel it stands for: layers of differences."""
    registry = Y.default_registry()
    ramp = (np.arange(192) + 20).astype(np.uint8).reshape(8, 8, 3)
    cases = [
        (("denoise", {"method": "gaussian", "size": 3}), lambda t: I.gaussian_blur(t, 3)), (("denoise", {"method": "median", "size": 3}), lambda t: I.median_blur(t, 3)),
        (("denoise", {"method": "bilateral", "size": 3}), lambda t: I.bilateral(t, 3)), (("denoise", {"method": "nlm", "template": 3, "search": 5}), lambda t: I.non_local_means(t, 10.0, 3, 5)),
        (("sharpen", {"method": "unsharp"}), I.unsharp_mask), (("sharpen", {"method": "kernel"}), I.kernel_sharpen), (("sharpen", {"method": "laplacian"}), I.laplacian_sharpen),
        (("resize", {"width": 8, "height": 8}), lambda t: t), (("morphology", {"operation": "closing"}), lambda t: I.erode(I.dilate(t, np.ones((3, 3), bool)), np.ones((3, 3), bool))),
        (("histogram", {"operation": "equalize"}), I.equalize), (("histogram", {"operation": "contrast_stretch", "low": 9, "high": 99}), lambda t: I.contrast_stretch(t, 9, 99)),
        (("histogram", {"operation": "histogram"}), lambda t: t), (("stain", {"method": "reinhard", "reference": ramp}), lambda t: I.reinhard(t, ramp)),
        (("stain", {"method": "none", "standardize": True}), I.standardize_brightness), (("quality", {}), lambda t: t),
        (("color", {"saturation": 0.5, "hue": 20.0}), lambda t: I.adjust_hue(I.adjust_saturation(I.gray_world(t), 0.5), 20.0)),
    ]
    steps = [(registry.create(name, **options), plain) for (name, options), plain in cases]

    def layers(t):
        return np.dstack([np.abs(step(t).astype(float) - plain(t)).sum(2) for step, plain in steps])

    return _kernels(spark, sf_dir, layers, True).groupBy("channel").agg(F.count("*").alias("n"), F.sum("value").alias("difference"))


@query
def kernel_sizes(spark, sf_dir):
    """Layers: half the size by nearest, linear and area."""
    return _kernels(spark, sf_dir, lambda t: np.dstack([I.resize(t, 4, 4, m) for m in ("nearest", "linear", "area")]))


@query
def kernel_letterbox(spark, sf_dir):
    """A tile in a wider frame, one and a half times as wide as high."""
    return _kernels(spark, sf_dir, lambda t: I.letterbox(t, 12, 8, 7))


@query
def kernel_white_balance(spark, sf_dir):
    """Layers: gray world and stretched channels (blue, green, red each)."""
    return _kernels(spark, sf_dir, lambda t: np.dstack([I.gray_world(t), I.simple_white_balance(t)]), True)


@query
def kernel_gray_masks(spark, sf_dir):
    """Layers: luma, pixels darker than the background, pixels with stain."""

    def layers(t):
        return np.dstack([I.to_gray(t), I.background_mask(t, 160), I.tissue_mask(I.optical_density(t), 0.9)])

    return _kernels(spark, sf_dir, layers, True)


@query
def kernel_lab(spark, sf_dir):
    """Layers: lightness and the two colour axes."""
    return _kernels(spark, sf_dir, I.to_lab, True)


@query
def kernel_lab_moments(spark, sf_dir):
    """Means, then deviations, of the three axes of each tile."""

    def moments(t):
        found = I.lab_moments(t)
        return np.concatenate([found.mean, found.std])

    return _kernels(spark, sf_dir, moments, True, 5).select("vec_id", "place", "value")


@query
def kernel_matched_moments(spark, sf_dir):
    """Axes shifted and scaled to given moments, as ``reinhard`` does before it goes back to colours."""
    wanted = I.Moments(np.array([120.0, 130.0, 125.0]), np.array([20.0, 5.0, 8.0]))
    return _kernels(spark, sf_dir, lambda t: I.matched_moments(I.to_lab(t), wanted), True, 4)


@query
def kernel_hsv(spark, sf_dir):
    """Layers: hue, saturation, value; then the tile with its saturation kept, with hues turned once around, and without colour."""

    def layers(t):
        return np.dstack([I.to_hsv(t), I.adjust_saturation(t, 1.0), I.adjust_hue(t, 180.0), I.adjust_saturation(t, 0.0)])

    return _kernels(spark, sf_dir, layers, True, 4)


@query
def kernel_overlay(spark, sf_dir):
    """A ramp of heat over each tile."""
    heat = np.arange(64).reshape(8, 8) / 64
    return _kernels(spark, sf_dir, lambda t: I.heatmap_overlay(heat, t), True)


@query
def kernel_scales(spark, sf_dir):
    """Layers: the unit scale and the scale of a photographic corpus (blue, green, red each)."""
    unit, corpus = Y.normalizer("unit"), Y.normalizer("imagenet")
    return _kernels(spark, sf_dir, lambda t: np.dstack([unit(t), corpus(t)]), True, 3)


# -- files -------------------------------------------------------------------


@query
def file_listing(spark, sf_dir):
    found = L.list_files(spark, X.folder(spark))
    return X.below(found).select("path", "kind", F.when(~F.col("path").endswith(".png"), F.col("length")).alias("length"))


@query
def file_listings_by_kind(spark, sf_dir):
    root = X.folder(spark)
    parts = {
        "images": L.image_files(spark, root), "annotations": L.annotation_files(spark, root), "with csv": L.annotation_files(spark, root, with_csv=True),
        "top only": L.list_files(spark, f"{root}/yolo", recursive=False), "absent": L.list_files(spark, f"{root}/none"),
    }
    return D.union_sources(*[rows.select(F.lit(k).alias("what"), X.inside(F.col("path")).alias("path")) for k, rows in parts.items()])


@query
def file_counts(spark, sf_dir):
    root = X.folder(spark)
    names = ("yolo", "voc", "clinical", "broken", "none")
    return D.union_sources(*[L.count_files(L.list_files(spark, f"{root}/{n}")).withColumn("folder", F.lit(n)) for n in names])


@query
def file_checks(spark, sf_dir):
    """What a file scan says of images: found, length, and whether they decode."""
    root = X.folder(spark)
    named = ("broken/bad.png", "broken/zero.png", "broken/absent.png", "points/p.png")
    images = spark.createDataFrame([(k, f"{root}/{n}") for k, n in enumerate(named)], "seq long, image_path string")
    decoded = L.read_images(spark, root).select(
        S.plain_path(F.col("path")).alias("image_path"), F.col("width").alias("decoded_width"), F.col("height").alias("decoded_height")
    )
    images = images.withColumn("image_path", S.plain_path(F.col("image_path")))
    facts = L.with_file_facts(images, L.list_files(spark, root)).join(decoded, "image_path", "left")
    return facts.select(
        "seq", "file_found", (F.coalesce("file_length", F.lit(0)) > 0).alias("has_bytes"), F.coalesce("decoded_width", F.lit(0)).alias("width"), F.coalesce("decoded_height", F.lit(0)).alias("height")
    )


@query
def image_headers(spark, sf_dir):
    return X.below(L.image_sizes(L.read_images(spark, X.folder(spark))))


@query
def image_pixels(spark, sf_dir):
    """Channel means of decoded images (blue, green, red)."""
    found = X.below(L.read_images(spark, X.folder(spark))).filter("width > 0")
    part = lambda k: F.sequence(F.lit(k + 1), F.length("data"), F.lit(3))
    mean = lambda k: F.aggregate(part(k), F.lit(0.0), lambda a, i: a + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int")) / F.size(part(k))
    return found.select("path", "channels", *[F.round(mean(k), 4).alias(n) for k, n in enumerate(("blue", "green", "red"))])


@query
def split_folders(spark, sf_dir):
    return L.find_splits(L.list_files(spark, X.folder(spark)))


@query
def content_digests(spark, sf_dir):
    return X.below(L.content_digests(spark, X.folder(spark))).filter("path NOT LIKE '%.png'")


@query
def detected_formats(spark, sf_dir):
    texts = X.below(A.read_texts(spark, X.folder(spark))).filter("path NOT LIKE '%.png'")
    return texts.select("path", N.detect(F.col("path"), F.col("text")).alias("format"), N.coarse_format(F.col("path")).alias("coarse"))


@query
def path_checks(spark, sf_dir):
    """What paths are, and which folders can be preprocessed."""
    root, rows = X.folder(spark), []
    for name in ("yolo", "yolo/train/a.png", "clinical", "absent"):
        path = f"{root}/{name}"
        try:
            L.check_folder(spark, path)
            outcome = "fine"
        except (FileNotFoundError, NotADirectoryError, ValueError) as error:
            outcome = type(error).__name__
        rows.append((name, L.path_exists(spark, path), L.is_folder(spark, path), L.is_file(spark, path), outcome))
    return spark.createDataFrame(rows, "name string, found boolean, folder boolean, file boolean, outcome string")


@query
def reference_image(spark, sf_dir):
    """A reference image read once: its size and the means of its lightness and colour axes."""
    image = L.read_reference(spark, f"{X.folder(spark)}/voc/v.png")
    try:
        L.read_reference(spark, f"{X.folder(spark)}/broken")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(image.shape[0], image.shape[1], float(image.sum()), refused)], "height int, width int, total double, refused boolean")


@query
def coerced_values(spark, sf_dir):
    """Scalars and nulls as arrays, and fields that a struct may lack."""
    customers = B.table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    box = F.struct(segment.alias("segment"), F.col("c_nationkey").alias("nation"))
    return customers.select(
        "c_custkey", F.array_join(S.as_array(segment, False), ",").alias("one"), F.size(S.as_array(F.split(segment, "U"), True)).alias("n_parts"),
        S.field_or(box, ["segment", "nation"], "segment", "-").alias("segment"), S.field_or(box, ["segment", "nation"], "age", "none").alias("age"),
    )


_CATALOGS: dict[str, U.Catalog] = {}


def _catalog(spark) -> U.Catalog:
    """All layouts of the fixture, registered once: some by their files, some by name."""
    root = X.folder(spark)
    if root in _CATALOGS:
        return _CATALOGS[root]
    catalog = _CATALOGS[root] = U.Catalog(spark)
    for name in ("yolo", "voc", "coco", "classes", "csv"):
        catalog.auto_register(f"{root}/{name}")
    catalog.register("points", f"{root}/points", "Point TXT")
    catalog.register("rowcol", f"{root}/rowcol", "Row/column JSON")
    catalog.register("clinical", f"{root}/clinical", "Clinical")
    catalog.register("broken", f"{root}/broken", "YOLO")
    return catalog


@query
def catalog_entries(spark, sf_dir):
    """Formats, classes and states of the registered datasets."""
    entries = _catalog(spark).prepare_all()
    rows = [(e.name, e.annotation, e.task, e.status, "|".join(f"{k}={v}" for k, v in sorted(e.classes.items()))) for e in entries]
    return spark.createDataFrame(rows, "name string, annotation string, task string, status string, classes string")


_DETECTION = ("yolo", "points", "voc", "coco", "rowcol")


@query
def built_boxes(spark, sf_dir):
    catalog = _catalog(spark)
    parts = []
    for name in (*_DETECTION, "classes", "csv"):
        built = catalog.build(name)
        parts.append(built.boxes.join(built.images.select("seq", "dataset", "image_path"), "seq"))
    sides = [F.round(c, 6).alias(c) for c in ("xc", "yc", "w", "h")]
    return D.union_sources(*parts).select("dataset", S.filename(F.col("image_path")).alias("image"), "object_index", "class_id", "class_name", *sides)


@query
def built_log(spark, sf_dir):
    built, errors = _catalog(spark).build_many()
    failed = spark.createDataFrame([(k, "", "ERROR", 0) for k in sorted(errors)], "dataset string, image string, status string, objects long")
    return built.log.select("dataset", X.inside(F.col("image")).alias("image"), "status", "objects").unionByName(failed)


@query
def built_images(spark, sf_dir):
    built, _ = _catalog(spark).build_many(list(_DETECTION))
    return built.images.select("dataset", "image_id", "width", "height", "split")


@query
def clinical_reports(spark, sf_dir):
    found = _catalog(spark).clinical("clinical")
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "|")
    return found.select("dataset", S.filename(F.col("path")).alias("file"), counts.alias("counts"), F.array_join("findings", "|").alias("findings"))


@query
def exported_files(spark, sf_dir):
    """Label files, images and manifest of an export, and images by class, as they lie in folders."""
    root, source = X.scratch(spark, "export"), X.folder(spark)
    built = _catalog(spark).build("yolo")
    K.export_yolo(built.images, built.boxes, f"{root}/yolo", f"{source}/yolo")
    K.export_classification(built.images, built.boxes, f"{root}/classes", f"{source}/yolo")
    texts = X.below(A.read_texts(spark, root)).select("path", F.when(~F.col("path").endswith(".png"), F.col("text")).alias("text"))
    return texts


@query
def exported_log(spark, sf_dir):
    """A build log written as CSV and read again."""
    path = X.scratch(spark, "export")
    K.write_log(_catalog(spark).build("yolo").log, path)
    found = spark.read.option("header", True).csv(path)
    return found.select("dataset", X.inside(F.col("image")).alias("image"), "status", "objects", F.coalesce("message", F.lit("")).alias("message"))


@query
def saved_dataset(spark, sf_dir):
    """A dataset saved whole and loaded again."""
    path = X.scratch(spark, "export")
    images, boxes = _both(spark, sf_dir)
    K.save_dataset({"images": images, "boxes": boxes}, path)
    loaded = K.load_dataset(spark, path, ("images", "boxes"))
    return T.summary(loaded["images"], loaded["boxes"])


@query
def summary_json(spark, sf_dir):
    """The summary of a dataset as JSON text."""
    text = K.report_json(T.summary(*_both(spark, sf_dir)))
    return spark.createDataFrame([(text,)], "report string")


@query
def annotation_tasks(spark, sf_dir):
    return spark.createDataFrame(sorted(U.TASKS.items()), "annotation string, task string")


@query
def processed_export(spark, sf_dir):
    """Images written after processing, the broken one as it was."""
    root, source = X.scratch(spark, "export"), X.folder(spark)
    pixels = L.read_images(spark, source).filter("path LIKE '%/voc/%' OR path LIKE '%/broken/bad%'")
    done = Y.Pipeline.from_config({"resize": {"width": 5, "height": 4, "keep_aspect_ratio": False}, "normalize": {"method": "unit"}}).apply(pixels)
    originals = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "content")
    K.write_files(K.processed_files(done, originals, source, root))
    return X.below(L.image_sizes(L.read_images(spark, root)))


# -- preprocessing -----------------------------------------------------------


def _tile_images(spark, sf_dir) -> DataFrame:
    """Tiles as decoded gray images, and one broken file."""
    bytes_ = F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    tiles = B.tiles(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), bytes_.alias("data")
    )
    broken = spark.createDataFrame([("broken", -1, -1, -1, None)], "path string, width int, height int, channels int, data binary")
    return tiles.unionByName(broken)


def _fails_on_dark(image):
    if image.mean() < 126:
        raise ValueError("too dark")
    return image


def _two_steps() -> Y.Pipeline:
    pipeline = Y.Pipeline.from_config({"resize": {"width": 4, "height": 4, "keep_aspect_ratio": False, "method": "area"}})
    pipeline.append("check", _fails_on_dark)
    return pipeline


@query
def pipeline_rows(spark, sf_dir):
    """Images after two steps, the second of which fails on dark ones."""
    done = _two_steps().apply(_tile_images(spark, sf_dir))
    steps = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["step"], h["status"])), ",")
    return done.select("path", "width", "height", "dtype", "passed", "error", steps.alias("steps"), F.round("brightness", 4).alias("brightness"), F.length("data").alias("n_bytes"))


@query
def pipeline_report(spark, sf_dir):
    done = _two_steps().apply(_tile_images(spark, sf_dir))
    return Y.run_report(done)


@query
def pipeline_summary(spark, sf_dir):
    return E.run_summary(_two_steps().apply(_tile_images(spark, sf_dir)))


@query
def pipeline_records(spark, sf_dir):
    """Sidecar records of each image, read back."""
    records = E.run_records(_two_steps().apply(_tile_images(spark, sf_dir)))
    parsed = records.select(F.from_json("record", "path string, passed boolean, error string, history array<struct<step: string>>").alias("r")).select("r.*")
    return parsed.groupBy("passed", "error").agg(F.count("*").alias("n"), F.sum(F.size("history")).alias("n_steps"))


@query
def sidecar_records(spark, sf_dir):
    """What is written beside each processed image, without its pixels, read back."""
    written = K.sidecars(_two_steps().apply(_tile_images(spark, sf_dir)))
    read = written.select("path", F.from_json("metadata", "width int, passed boolean, data string, history array<struct<step: string, status: string>>").alias("m")).select("path", "m.*")
    return read.select("path", "width", "passed", F.col("data").isNull().alias("no_pixels"), F.size("history").alias("n_steps"))


@query
def assessed_images(spark, sf_dir):
    """An assessment that takes over cached results of the images of an earlier one."""
    images = _tile_images(spark, sf_dir)
    earlier = Y.assess(images.filter("path LIKE '1%'"), thresholds=STRICT).withColumn("quality_score", F.lit(12.5))
    found = Y.assess(images, earlier, STRICT)
    return found.groupBy("source", "corrupted", "passed").agg(F.count("*").alias("n"), F.count_if(F.col("quality_score") == 12.5).alias("n_taken"))


@query
def pipeline_editing(spark, sf_dir):
    """Names of a pipeline's steps as it is edited, and of the registry's."""
    made = Y.Pipeline.from_config({"sharpen": {"method": "kernel"}, "resize": {}, "histogram": {"operation": "equalize"}})
    states = [("configured", made.names())]
    made.insert(1, "first", lambda x: x)
    made.append("last", lambda x: x)
    states.append(("extended", made.names()))
    made.remove("RESIZE")
    states.append(("removed", made.names()))
    made.clear()
    states.append(("cleared", made.names()))
    registry = Y.Registry()
    registry.register(" Blur ", lambda: lambda x: x)
    registry.register("sharp", lambda: lambda x: x)
    states.append(("registered", registry.names()))
    registry.unregister("BLUR")
    states.append(("unregistered", registry.names()))
    states.append(("known", [n for n in ("sharp", "blur") if registry.exists(n)]))
    registry.clear()
    states.append(("emptied", registry.names()))
    return spark.createDataFrame([(k, ",".join(v)) for k, v in states], "state string, names string")


@query
def rejected_configs(spark, sf_dir):
    """Configurations that are refused, and why."""
    ramp = np.zeros((4, 4), np.uint8)
    configs = {
        "fine": {"resize": {"width": 5, "height": 5}, "histogram": {"operation": "matching", "reference": ramp}}, "width": {"resize": {"width": 0}}, "clip": {"clahe": {"clip_limit": 0}},
        "kernel": {"denoise": {"size": -1}}, "sharpen": {"sharpen": {"size": 0}}, "unknown": {"rotate": {}}, "gamma": {"histogram": {"operation": "gamma", "gamma": 0}},
        "bounds": {"histogram": {"operation": "contrast_stretch", "low": 9, "high": 9}}, "reference": {"histogram": {"operation": "matching"}}, "operation": {"histogram": {"operation": "melt"}},
    }
    rows = []
    for name, config in configs.items():
        try:
            Y.check_config(config)
            rows.append((name, "accepted"))
        except (KeyError, TypeError, ValueError) as error:
            rows.append((name, type(error).__name__))
    return spark.createDataFrame(rows, "name string, outcome string")


# -- reports -----------------------------------------------------------------


def _line_counts(lines: DataFrame) -> DataFrame:
    """Lines of a report, those of issues by their first part, with their number."""
    return lines.groupBy("section", F.substring_index("line", " | ", 1).alias("line")).agg(F.count("*").alias("n"))


@query
def report_v1_text(spark, sf_dir):
    images, boxes = B.planted_images(spark, sf_dir), B.planted_boxes(spark, sf_dir)
    lines = E.v1_report(images, boxes)
    return _line_counts(lines.filter("section < 52 OR line LIKE '[%'"))


@query
def report_v1_markdown(spark, sf_dir):
    lines = E.v1_report(*_both(spark, sf_dir), markdown=True)
    return lines.groupBy("section", F.substring_index("line", " - ", 1).alias("line")).agg(F.count("*").alias("n"), F.countDistinct("place").alias("n_places"))


@query
def report_v1_json(spark, sf_dir):
    return E.v1_json(*_both(spark, sf_dir)).select(F.inline(F.array(F.from_json("report", "summary struct<n_issues: long, n_error: long>, statistics struct<n_objects: long>, metrics struct<class_score: double>")))).select(
        "summary.n_issues", "summary.n_error", "statistics.n_objects", "metrics.class_score"
    )


@query
def report_v2_text(spark, sf_dir):
    images, boxes = B.planted_images(spark, sf_dir), B.planted_boxes(spark, sf_dir)
    return _line_counts(E.v2_report(images, boxes))


@query
def report_gate_text(spark, sf_dir):
    return E.gate_summary(P.measured(B.tiles(spark, sf_dir), 8, STRICT), 95.0)


@query
def report_assessment_text(spark, sf_dir):
    return E.assessment_summary(P.measured(B.tiles(spark, sf_dir), 8, STRICT))


@query
def failed_tiles(spark, sf_dir):
    return E.failed_ids(P.measured(B.tiles(spark, sf_dir), 8, STRICT), "vec_id")


# -- degradation and sinks ---------------------------------------------------


@query
def degrade_boxes(spark, sf_dir):
    images, boxes = _both(spark, sf_dir)
    found = M.degraded_boxes(images, boxes, M.LEVELS["severe"], exclude_split="val")
    return found.select("seq", "object_index", "class_id", "class_name", F.round("xc", 6).alias("xc"), F.round("yc", 6).alias("yc"), "w", "h", "damaged")


@query
def degradation_index(spark, sf_dir):
    """The index of a dataset at each level of damage."""
    images, boxes = _both(spark, sf_dir)
    out = None
    for level in ("clean", "moderate", "extreme"):
        damaged = M.degraded_boxes(images, boxes, M.LEVELS[level]).withColumn("confidence", F.lit(None).cast("double"))
        issues = V.apply(damaged.join(images.select("seq", "dataset", "image_path"), "seq"), V.v2_center_box_rules(), "v2", F.col("object_index"))
        part = issues.groupBy("rule_id").agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "rule_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query
def yolo_label_lines(spark, sf_dir):
    return K.yolo_labels(*_both(spark, sf_dir)).select("seq", "split", "stem", "label_text")


@query
def manifest_rows(spark, sf_dir):
    return K.class_names(B.boxes(spark, sf_dir))


@query
def class_folder_paths(spark, sf_dir):
    return K.class_folder(*_both(spark, sf_dir))


# -- training ----------------------------------------------------------------


@query
def training_halves(spark, sf_dir):
    """Rows of each class in the training and test shares, and the weight of a training row."""
    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    train, test = M.stratified_halves(rows, "label", "vec_id")
    sizes = train.groupBy("label").agg(F.count("*").alias("n_train")).join(test.groupBy("label").agg(F.count("*").alias("n_test")), "label")
    return sizes.join(M.class_weights(train, "label"), "label").select("label", "n_train", "n_test", F.round("weight", 6).alias("weight"))
