"""Rule engines: named row-level checks fused in one projection for each stage.

A rule is a column condition with fixed attributes. ``apply`` turns the rules of a
stage into one array of conditional structs and explodes it, so a stage is one scan,
however many rules it has. Conditions are two-valued: null does not fire.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import scalars as S
from lumenframe.operators import dataset as D
from lumenframe.operators import ranked as R
from lumenframe.operators.statistics import with_object_counts
from lumenframe.schema import IMAGE_EXTENSIONS

INFO, WARNING, ERROR, CRITICAL = "INFO", "WARNING", "ERROR", "CRITICAL"
STAGES = {"dataset": 1, "image": 2, "object": 3, "box": 4}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    stage: str
    severity: str
    category: str
    condition: Column
    message: str
    needs: tuple[str, ...] = ()
    advice: str = ""


#: Columns of issue rows.
ISSUE_COLUMNS = (
    "engine", "stage", "rule_no", "rule_id", "severity", "category", "message", "recommendation", "dataset", "seq", "image_path", "object_index",
)
ISSUE_SCHEMA = (
    "engine string, stage int, rule_no int, rule_id string, severity string, category string, message string, recommendation string, "
    "dataset string, seq long, image_path string, object_index int"
)
CATEGORIES = ("DATASET", "IMAGE", "OBJECT", "BOUNDING_BOX", "DUPLICATE", "METADATA")


def usable(rules: list[Rule], rows: DataFrame) -> list[Rule]:
    """Rules whose columns the rows have; others are skipped."""
    return [r for r in rules if set(r.needs) <= set(rows.columns)]


def apply(rows: DataFrame, rules: list[Rule], engine: str, object_index: Column | None = None) -> DataFrame:
    """Issue rows (``ISSUE_COLUMNS``) of all rules on rows with dataset, seq and image_path."""
    fired = [
        F.when(
            S.is_true(r.condition),
            F.struct(
                F.lit(STAGES[r.stage]).alias("stage"),
                F.lit(k).alias("rule_no"),
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.category).alias("category"),
                F.lit(r.message).alias("message"),
                F.lit(r.advice).alias("recommendation"),
            ),
        )
        for k, r in enumerate(usable(rules, rows))
    ]
    kind = "array<struct<stage: int, rule_no: int, rule_id: string, severity: string, category: string, message: string, recommendation: string>>"
    index = F.lit(-1) if object_index is None else object_index
    issue = rows.select(
        "dataset", F.col("seq").cast("long").alias("seq"), "image_path", index.cast("int").alias("object_index"), F.explode(F.array_compact(F.array(*fired)).cast(kind)).alias("i")
    )
    return issue.select(F.lit(engine).alias("engine"), "i.*", "dataset", "seq", "image_path", "object_index").select(*ISSUE_COLUMNS)


def of_whole(facts: DataFrame) -> DataFrame:
    """One row of facts about a whole dataset, with the columns that issues name (all null)."""
    return facts.withColumns({"dataset": F.lit(None).cast("string"), "seq": F.lit(None).cast("long"), "image_path": F.lit(None).cast("string")})


def new_issues(spark: SparkSession, *issues: dict) -> DataFrame:
    """Issue rows from dictionaries; what they lack is null, an issue of None is left out."""
    given = [i for i in issues if i is not None]
    unknown = {k for i in given for k in i} - set(ISSUE_COLUMNS)
    if unknown:
        raise KeyError(f"unknown fields: {sorted(unknown)}")
    return spark.createDataFrame([tuple(i.get(c) for c in ISSUE_COLUMNS) for i in given], ISSUE_SCHEMA)


def exception_issue(spark: SparkSession, category: str, rule_name: str, message: str, dataset: str | None = None, image_path: str | None = None) -> DataFrame:
    """The issue that stands for a check that raised; unknown categories are UNKNOWN."""
    known = {"BBOX": "BOUNDING_BOX"}.get(category.upper(), category.upper())
    known = known if known in CATEGORIES else "UNKNOWN"
    stage = {"DATASET": 1, "IMAGE": 2, "OBJECT": 3, "BOUNDING_BOX": 4}.get(known, 0)
    return new_issues(
        spark,
        dict(
            engine="v2", stage=stage, rule_no=-1, rule_id=str(uuid.uuid4()), severity=ERROR, category=known, message=f"{rule_name}: {message}",
            recommendation="look at the check that raised", dataset=dataset, image_path=image_path, object_index=-1,
        ),
    )


def guarded(spark: SparkSession, category: str, rule_name: str, check: Callable[[], DataFrame]) -> DataFrame:
    """The issues of a check, or one issue that says why it could not be planned."""
    try:
        return check()
    except Exception as error:  # a check that fails is itself a finding
        return exception_issue(spark, category, rule_name, str(error).split("\n")[0])


def until_error(stages: list[DataFrame]) -> DataFrame:
    """Issues of the stages up to the first one with an error (one look at each stage for whether it has any)."""
    found = stages[0]
    for before, stage in zip(stages, stages[1:]):
        if not before.filter(F.col("severity").isin(ERROR, CRITICAL)).isEmpty():
            break
        found = found.unionByName(stage)
    return found


def issue_json(issues: DataFrame) -> DataFrame:
    """One JSON text for each issue, its fields in order, nulls left out (column ``issue``)."""
    return issues.select(F.to_json(F.struct(*ISSUE_COLUMNS)).alias("issue"))


def issues_from_json(texts: DataFrame, column: str = "issue") -> DataFrame:
    """Issue rows from their JSON texts; fields that a text lacks are null."""
    return texts.select(F.from_json(column, ISSUE_SCHEMA).alias("i")).select("i.*")


def by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") == severity)


def by_category(issues: DataFrame, category: str) -> DataFrame:
    return issues.filter(F.col("category") == category)


def list_rules(rules: list[Rule]) -> list[tuple[str, str, str]]:
    """(stage, rule id, severity), sorted."""
    return sorted((r.stage, r.rule_id, r.severity) for r in rules)


# -- first engine ------------------------------------------------------------

# Severities, categories and bounds of both engines' checks; DS, IMG, OBJ and BOX ids of the second.


def v1_dataset_rules() -> list[Rule]:
    """Checks of a whole dataset, on its n_images and n_objects (both null without a dataset)."""
    n_images, n_objects = F.col("n_images"), F.col("n_objects")
    return [
        Rule("V1-DS-NONE", "dataset", ERROR, "DATASET", n_images.isNull(), "there is no dataset", advice="give a dataset"),
        Rule("V1-DS-NONAME", "dataset", WARNING, "DATASET", n_images == 0, "no source dataset is known", advice="add images with their dataset"),
        Rule("V1-DS-NOIMAGES", "dataset", WARNING, "DATASET", n_images == 0, "dataset has no images", advice="add images"),
        Rule("V1-DS-NOCLASSES", "dataset", WARNING, "DATASET", n_images.isNotNull() & (n_objects == 0), "dataset has no classes", advice="check that annotations were parsed"),
    ]


def v1_image_rules() -> list[Rule]:
    path, width, height = F.col("image_path"), F.col("width"), F.col("height")
    dataset = F.col("dataset")
    no_path, no_size = S.is_empty(path), width.isNull() | height.isNull()
    return [
        Rule("V1-IMG-PATH", "image", ERROR, "IMAGE", no_path, "image path is missing", advice="set the image path"),
        Rule("V1-IMG-FILE", "image", ERROR, "IMAGE", ~no_path & ~F.col("file_found"), "image file is missing", ("file_found",), "check where the file is"),
        Rule("V1-IMG-DUPFILE", "image", WARNING, "IMAGE", ~no_path & F.col("is_repeat"), "image file repeats an earlier one", ("is_repeat",), "remove or rename the copy"),
        Rule("V1-IMG-EXT", "image", WARNING, "IMAGE", ~no_path & ~S.has_extension(path, IMAGE_EXTENSIONS), "unsupported file suffix", advice="convert the image"),
        Rule("V1-IMG-NOSIZE", "image", WARNING, "IMAGE", no_size, "image size is unknown", advice="set width and height"),
        Rule("V1-IMG-SIZE", "image", ERROR, "IMAGE", ~no_size & ((width <= 0) | (height <= 0)), "image size is not positive", advice="sizes must be greater than 0"),
        Rule("V1-IMG-ID", "image", WARNING, "IMAGE", S.is_empty(F.col("image_id")), "image id is missing", advice="set the image id"),
        Rule("V1-IMG-NODATASET", "image", WARNING, "IMAGE", S.is_empty(dataset), "dataset name is missing", advice="set the dataset"),
        Rule("V1-IMG-DATASET", "image", WARNING, "IMAGE", S.is_blank(dataset), "image belongs to no dataset", advice="set the dataset"),
        Rule("V1-IMG-EMPTY", "image", WARNING, "IMAGE", F.col("n_objects") == 0, "image has no objects", ("n_objects",), "check its annotation"),
        Rule("V1-IMG-DUPPATH", "image", WARNING, "IMAGE", ~no_path & F.col("is_path_repeat"), "image path repeats an earlier one", ("is_path_repeat",), "remove the second reference"),
    ]


def v1_object_rules() -> list[Rule]:
    sides = [F.col(c) for c in ("xc", "yc", "w", "h")]
    absent = sides[0].isNull() | sides[1].isNull() | sides[2].isNull() | sides[3].isNull()
    class_id = F.col("class_id")
    return [
        Rule("V1-OBJ-NAME", "object", WARNING, "OBJECT", S.is_empty(F.col("class_name")), "class name is missing", advice="set the class name"),
        Rule("V1-OBJ-ID", "object", ERROR, "OBJECT", class_id.isNull() | (class_id < 0), "class id is missing or negative", advice="class ids start at 0"),
        Rule("V1-OBJ-DUP", "object", WARNING, "OBJECT", F.col("object_id").isNotNull() & F.col("is_id_repeat"), "object id repeats an earlier one", ("object_id", "is_id_repeat"), "ids must be unique"),
        Rule("V1-OBJ-BOX", "object", ERROR, "BOUNDING_BOX", absent, "a box field is missing", advice="set all four fields"),
    ]


def v1_box_rules() -> list[Rule]:
    rules = [
        Rule(f"V1-BOX-{c.upper()}", "box", ERROR, "BOUNDING_BOX", ~S.is_normalized(F.col(c)), f"{c} is not within 0 and 1", advice="normalise the box")
        for c in ("xc", "yc", "w", "h")
    ]
    return rules + [
        Rule("V1-BOX-W0", "box", ERROR, "BOUNDING_BOX", F.col("w") <= 0, "width is not positive", advice="widths must be greater than 0"),
        Rule("V1-BOX-H0", "box", ERROR, "BOUNDING_BOX", F.col("h") <= 0, "height is not positive", advice="heights must be greater than 0"),
        Rule("V1-BOX-CONF", "box", WARNING, "BOUNDING_BOX", ~F.col("confidence").between(0.0, 1.0), "confidence is not within 0 and 1", advice="confidences lie between 0 and 1"),
    ]


def _boxes_of_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Objects with the dataset, path and frame of their image."""
    return boxes.join(images.select("seq", "dataset", "image_path", "width", "height"), "seq")


def v1_dataset_issues(images: DataFrame | None, boxes: DataFrame) -> DataFrame:
    """Issues of the whole dataset; ``images`` is None where there is no dataset."""
    spark = boxes.sparkSession
    if images is None:
        facts = spark.createDataFrame([(None, 0)], "n_images long, n_objects long")
    else:
        facts = images.agg(F.count("*").alias("n_images")).crossJoin(boxes.agg(F.count("*").alias("n_objects")))  # one row each
    return apply(of_whole(facts), v1_dataset_rules(), "v1")


def v1_stages(images: DataFrame | None, boxes: DataFrame) -> list[DataFrame]:
    """Issues of the first engine, stage by stage: dataset, images, objects and boxes.

    Files and paths repeat without regard to case; the second check resolves ``..``.
    """
    whole = v1_dataset_issues(images, boxes)
    if images is None:
        return [whole]
    counted = with_object_counts(images, boxes)
    counted = R.first_seen(counted, [F.lower(S.resolved_path(F.col("image_path")))], ["seq"]).withColumnRenamed("is_repeat", "is_path_repeat")
    counted = R.first_seen(counted, [F.lower(S.normalized_path(F.col("image_path")))], ["seq"])
    if "object_id" in boxes.columns:
        boxes = R.first_seen(boxes, [F.col("object_id")], ["seq", "object_index"]).withColumnRenamed("is_repeat", "is_id_repeat")
    objects = _boxes_of_images(images, boxes)
    return [whole, apply(counted, v1_image_rules(), "v1"), apply(objects, v1_object_rules() + v1_box_rules(), "v1", F.col("object_index"))]


def v1_issues(images: DataFrame | None, boxes: DataFrame) -> DataFrame:
    """All issues of the first engine."""
    return D.union_sources(*v1_stages(images, boxes))


# -- second engine -----------------------------------------------------------


def v2_image_rules(min_side: int = 32, max_side: int = 10000) -> list[Rule]:
    path, width, height = F.col("image_path"), F.col("width"), F.col("height")
    found, decoded = F.col("file_found"), ("file_found", "decoded_width", "decoded_height")
    no_frame = (F.col("decoded_width") <= 0) | (F.col("decoded_height") <= 0)
    return [
        Rule("IMG001", "image", ERROR, "IMAGE", ~found, "file does not exist", ("file_found",), "check where the file is"),
        Rule("IMG002", "image", ERROR, "IMAGE", ~S.has_extension(path, IMAGE_EXTENSIONS), "unsupported file suffix", advice="convert the image"),
        Rule("IMG003", "image", ERROR, "IMAGE", found & (F.col("decoded_width") == -1), "file cannot be decoded", ("file_found", "decoded_width"), "replace the file"),
        Rule("IMG004", "image", ERROR, "IMAGE", F.col("file_length") == 0, "file is empty", ("file_length",), "replace the file"),
        Rule("IMG005", "image", WARNING, "IMAGE", (width < min_side) | (height < min_side), "image is too small", advice="use larger images"),
        Rule("IMG006", "image", WARNING, "IMAGE", (width > max_side) | (height > max_side), "image is too large", advice="shrink the image"),
        Rule("IMG007", "image", WARNING, "DUPLICATE", F.col("is_repeat"), "image path repeats an earlier one", ("is_repeat",), "remove the second entry"),
        Rule("IMG008", "image", ERROR, "METADATA", found & no_frame, "image has no readable size", decoded, "check the file"),
        Rule("OBJ001", "object", ERROR, "OBJECT", F.col("n_objects") == 0, "image has no objects", ("n_objects",), "check its annotation"),
        Rule("OBJ009", "object", INFO, "OBJECT", (F.col("n_classes") == 1) & (F.col("n_objects") > 1), "all objects have one class", ("n_classes",), "may be as intended"),
        Rule("OBJ008", "object", INFO, "OBJECT", F.col("missing") != "", "expected classes are missing", ("missing",), "check whether they should be there"),
    ]


def _is_number(raw: Column) -> Column:
    """Whether a JSON token is a number (or true or false, which count as 1 and 0)."""
    return S.is_true(raw.try_cast("double").isNotNull() | raw.isin("true", "false"))


def v2_object_rules(valid_class_ids: tuple[int, ...] | None = None) -> list[Rule]:
    """Checks of objects; ``confidence_raw`` is the confidence as a JSON token."""
    class_id, confidence, raw = F.col("class_id"), F.col("confidence"), F.col("confidence_raw")
    rules = [
        Rule("OBJ002", "object", ERROR, "OBJECT", class_id.isNull(), "class id is missing", advice="set the class id"),
        Rule("OBJ003", "object", WARNING, "OBJECT", F.col("class_name").isNull(), "class name is missing", advice="set the class name"),
        Rule("OBJ005", "object", WARNING, "DUPLICATE", F.col("is_repeat"), "object repeats an earlier one", ("is_repeat",), "remove the copy"),
        Rule("OBJ006", "object", ERROR, "OBJECT", raw.isNotNull() & ~_is_number(raw), "confidence is no number", ("confidence_raw",), "confidences are numbers"),
        Rule("OBJ007", "object", ERROR, "OBJECT", ~confidence.between(0.0, 1.0), "confidence is not within 0 and 1", advice="confidences lie between 0 and 1"),
    ]
    if valid_class_ids is not None:
        rules.append(Rule("OBJ004", "object", ERROR, "OBJECT", ~S.is_true(class_id.isin(*valid_class_ids)), "class id is not allowed", advice="use a class of the dataset"))
    return rules


def v2_raw_box_rules() -> list[Rule]:
    """Checks of boxes as JSON texts (``bbox_raw``, null for a missing one): type, arity, numbers."""
    raw = F.col("bbox_raw")
    items = F.from_json(F.when(F.ltrim(raw).startswith("["), raw), "array<string>")
    quoted = F.regexp_like(raw, F.lit(r'"|null|\[\s*\[|\{'))
    listed = items.isNotNull()
    numeric = F.forall(items, lambda x: S.is_true(x.try_cast("double").isNotNull() | x.isin("true", "false"))) & ~quoted
    return [
        Rule("BOX001", "box", ERROR, "BOUNDING_BOX", raw.isNull(), "box is missing", ("bbox_raw",), "give a box"),
        Rule("BOX002", "box", ERROR, "BOUNDING_BOX", raw.isNotNull() & ~listed, "box is no list", ("bbox_raw",), "boxes are lists of four numbers"),
        Rule("BOX003", "box", ERROR, "BOUNDING_BOX", listed & (F.size(items) != 4), "box has not four values", ("bbox_raw",), "boxes have four values"),
        Rule("BOX004", "box", ERROR, "BOUNDING_BOX", listed & (F.size(items) == 4) & ~numeric, "a coordinate is no number", ("bbox_raw",), "coordinates are numbers"),
    ]


def v2_center_box_rules() -> list[Rule]:
    """Checks of normalised centre boxes; those after the first look only at boxes of four numbers."""
    xc, yc, w, h = (F.col(c) for c in ("xc", "yc", "w", "h"))
    no_number = xc.isNull() | yc.isNull() | w.isNull() | h.isNull()
    centre_out = ~xc.between(0.0, 1.0) | ~yc.between(0.0, 1.0)
    side_out = (w <= 0) | (w > 1) | (h <= 0) | (h > 1)
    return [
        Rule("BOX004", "box", ERROR, "BOUNDING_BOX", no_number, "a coordinate is no number", advice="coordinates are numbers"),
        Rule("BOX005", "box", ERROR, "BOUNDING_BOX", ~no_number & ((w < 0) | (h < 0)), "a side is negative", advice="sides are positive"),
        Rule("BOX007", "box", ERROR, "BOUNDING_BOX", ~no_number & ((w <= 0) | (h <= 0)), "box has no area", advice="boxes have an area"),
        Rule("BOX010", "box", ERROR, "BOUNDING_BOX", ~no_number & (centre_out | side_out), "box is not normalised", advice="normalise the box"),
    ]


def v2_corner_box_rules(min_side: float = 3.0, max_share: float = 0.95, max_aspect: float = 20.0) -> list[Rule]:
    """Checks of pixel corner boxes x1, y1, x2, y2 in a frame of width and height."""
    box = G.Box.of("x1", "y1", "x2", "y2")
    width, height = F.col("width"), F.col("height")
    bw, bh = G.width(box), G.height(box)
    long_side, short_side = F.greatest(bw, bh, F.lit(1.0)), F.greatest(F.least(bw, bh), F.lit(1.0))
    negative = (box.x1 < 0) | (box.y1 < 0) | (box.x2 < 0) | (box.y2 < 0)
    return [
        Rule("BOX001", "box", ERROR, "BOUNDING_BOX", box.x1.isNull() & box.y1.isNull() & box.x2.isNull() & box.y2.isNull(), "box is missing", advice="give a box"),
        Rule("BOX006", "box", ERROR, "BOUNDING_BOX", negative, "a corner is negative"),
        Rule("BOX008", "box", ERROR, "BOUNDING_BOX", (box.x2 <= box.x1) | (box.y2 <= box.y1), "box has no area"),
        Rule("BOX009", "box", ERROR, "BOUNDING_BOX", ~G.inside_image(box, width, height), "box leaves the image"),
        Rule("BOX013", "box", WARNING, "BOUNDING_BOX", (bw < min_side) | (bh < min_side), "box is tiny"),
        Rule("BOX014", "box", WARNING, "BOUNDING_BOX", (width * height > 0) & (G.area(box) / F.nullif(width * height, F.lit(0)) > max_share), "box fills the image"),
        Rule("BOX015", "box", WARNING, "BOUNDING_BOX", long_side / short_side > max_aspect, "box is very long"),
    ]


def v2_pair_issues(images: DataFrame, boxes: DataFrame, iou: float | None = None) -> DataFrame:
    """BOX011 for each pair of equal boxes, and BOX012 for each overlapping pair of corner boxes."""
    known = images.select("seq", "dataset", "image_path")

    def issue(pairs: DataFrame, rule_no: int, rule_id: str, message: str) -> DataFrame:
        return pairs.join(known, "seq").select(
            F.lit("v2").alias("engine"),
            F.lit(STAGES["box"]).alias("stage"),
            F.lit(rule_no).alias("rule_no"),
            F.lit(rule_id).alias("rule_id"),
            F.lit(WARNING).alias("severity"),
            F.lit("BOUNDING_BOX").alias("category"),
            F.lit(message).alias("message"),
            F.lit("remove one of them").alias("recommendation"),
            "dataset",
            "seq",
            "image_path",
            F.col("j").cast("int").alias("object_index"),
        )

    found = issue(D.duplicate_pairs(boxes), 90, "BOX011", "two boxes are equal")
    if iou is not None:
        found = found.unionByName(issue(D.overlapping_pairs(boxes, iou), 91, "BOX012", "two boxes overlap"))
    return found


def v2_image_facts(images: DataFrame, boxes: DataFrame, expected: tuple[str, ...] | None = None) -> DataFrame:
    """Images with what the second engine's image and object rules need: one aggregate of the boxes."""
    per_image = [F.count("*").alias("n_objects"), F.size(F.collect_set("class_name")).alias("n_classes")]
    if expected:
        lacking = F.array_except(F.array(*[F.lit(e) for e in expected]), F.collect_set("class_name"))
        per_image.append(F.array_join(F.array_sort(lacking), ",").alias("missing"))
    facts = images.join(boxes.groupBy("seq").agg(*per_image), "seq", "left").na.fill(0, ["n_objects", "n_classes"])
    if expected:  # an image without objects lacks them all
        facts = facts.na.fill(",".join(sorted(expected)), ["missing"])
    return R.first_seen(facts, [F.col("image_path")], ["seq"])


def with_repeats(boxes: DataFrame) -> DataFrame:
    """Column is_repeat: an earlier object of the image has the same class and box."""
    same = Window.partitionBy("seq", "class_id", "xc", "yc", "w", "h").orderBy("object_index")
    return boxes.withColumn("is_repeat", F.row_number().over(same) > 1)


def with_corners(boxes: DataFrame) -> DataFrame:
    """Corners x1, y1, x2, y2, in frame units, of normalised centre boxes."""
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    return boxes.withColumns(
        {"x1": F.col("xc") - half_w, "y1": F.col("yc") - half_h, "x2": F.col("xc") + half_w, "y2": F.col("yc") + half_h}
    )


def v2_dataset_issues(files: DataFrame, root_found: bool = True, root_is_folder: bool = True) -> DataFrame:
    """Issues of a whole dataset's folder, from a listing (path, length, kind, and readable where known).

    Images and annotations are matched by stem; checks of the whole have a null path.
    After a critical finding about the root nothing else is checked.
    """
    spark = files.sparkSession

    def critical(rule_id: str, message: str, advice: str) -> DataFrame:
        return new_issues(spark, dict(engine="v2", stage=1, rule_no=0, rule_id=rule_id, severity=CRITICAL, category="DATASET", message=message, recommendation=advice, object_index=-1))

    if not root_found:
        return critical("DS001", "dataset folder does not exist", "give an existing folder")
    if not root_is_folder:
        return critical("DS002", "dataset path is no folder", "give a folder")

    known = files.filter("kind IN ('image', 'annotation')").withColumns({"stem": S.stem(F.col("path")), "name": S.filename(F.col("path"))})
    images, notes = known.filter("kind = 'image'"), known.filter("kind = 'annotation'")
    facts = files.agg(F.count_if(F.col("kind") == "image").alias("i"), F.count_if(F.col("kind") == "annotation").alias("a"))
    i, a = F.col("i"), F.col("a")
    of_all = [
        Rule("DS003", "dataset", ERROR, "DATASET", i == 0, "folder has no images", advice="add images"),
        Rule("DS004", "dataset", ERROR, "DATASET", a == 0, "folder has no annotations", advice="add annotations"),
        Rule("DS005", "dataset", CRITICAL, "DATASET", F.col("n") == 0, "folder is empty", advice="add files"),
        Rule("DS006", "dataset", WARNING, "DATASET", i != a, "images and annotations differ in number", advice="each image needs one annotation"),
    ]
    facts = facts.crossJoin(files.agg(F.count("*").alias("n")))  # one row each

    def of_file(rows: DataFrame, *rules: Rule) -> DataFrame:
        named = rows.withColumns({"dataset": F.lit(None).cast("string"), "seq": F.lit(None).cast("long"), "image_path": F.col("path")})
        return apply(named, list(rules), "v2")

    yes = F.lit(True)
    unmatched = images.join(notes.select("stem"), "stem", "left_anti")
    repeats = R.first_seen(images, [F.col("name")], ["path"])
    return D.union_sources(
        apply(of_whole(facts), of_all, "v2"),
        of_file(unmatched, Rule("DS007", "dataset", ERROR, "DATASET", yes, "image has no annotation", advice="add its annotation")),
        of_file(repeats, Rule("DS008", "dataset", WARNING, "DUPLICATE", F.col("is_repeat"), "file name repeats an earlier one", advice="rename the file")),
        of_file(
            notes,
            Rule("DS009", "dataset", ERROR, "DATASET", F.col("length") == 0, "annotation is empty", advice="fill it"),
            Rule("DS010", "dataset", ERROR, "DATASET", ~F.col("readable"), "annotation cannot be read", ("readable",), "check the file"),
        ),
    )


def dataset_name(images: DataFrame) -> DataFrame:
    """One row: the dataset's name, or the names of several in order, joined by ``+`` (empty without any)."""
    return images.agg(F.array_join(F.array_sort(F.collect_set("dataset")), "+").alias("dataset_name"))


def v2_stages(
    images: DataFrame,
    boxes: DataFrame,
    min_side: int = 1,
    max_side: int = 100000,
    expected: tuple[str, ...] | None = None,
    iou: float | None = 0.9,
    valid_class_ids: tuple[int, ...] | None = None,
    files: DataFrame | None = None,
) -> list[DataFrame]:
    """Issues of the second engine on centre boxes, stage by stage, with the bounds its engine sets.

    The name of the dataset is always checked, its files where a listing is given.
    """
    name = Rule("DS011", "dataset", WARNING, "METADATA", F.trim("dataset_name") == "", "dataset has no name", advice="name the dataset")
    whole = apply(of_whole(dataset_name(images)), [name], "v2")
    if files is not None:
        whole = whole.unionByName(v2_dataset_issues(files))
    facts = v2_image_facts(images, boxes, expected)
    objects = _boxes_of_images(images, with_repeats(boxes))
    of_images = apply(facts, v2_image_rules(min_side, max_side), "v2")
    of_objects = apply(objects, v2_object_rules(valid_class_ids) + v2_center_box_rules(), "v2", F.col("object_index"))
    return [whole, of_images, of_objects, v2_pair_issues(images, with_corners(boxes), iou)]


def v2_issues(images: DataFrame, boxes: DataFrame, **options) -> DataFrame:
    """All issues of the second engine (options of ``v2_stages``).

    Pairs of boxes that overlap by ``iou`` or more are reported (BOX012), unless it is None.
    """
    return D.union_sources(*v2_stages(images, boxes, **options))


# -- roll-ups and indexes ----------------------------------------------------


def rollup(issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Issues by severity, and whether errors or critical issues are absent."""
    grouped = issues.groupBy(*by) if by else issues.groupBy()
    level = F.col("severity")
    return grouped.agg(
        F.count("*").alias("n_issues"),
        F.count_if(level == INFO).alias("n_info"),
        F.count_if(level == WARNING).alias("n_warning"),
        F.count_if(level == ERROR).alias("n_error"),
        F.count_if(level == CRITICAL).alias("n_critical"),
    ).withColumn("passed", F.col("n_error") + F.col("n_critical") == 0)


def success_rate(rolled: DataFrame) -> DataFrame:
    failures = F.col("n_error") + F.col("n_critical")
    rate = F.when(F.col("n_issues") == 0, 100.0).otherwise((F.col("n_issues") - failures) * 100.0 / F.nullif("n_issues", F.lit(0)))
    return rolled.withColumn("success_rate", F.round(rate, 4))


def v1_index(rolled: DataFrame) -> DataFrame:
    """Scores of the first engine: fixed deductions for each issue, and their mean."""
    e, w, c = F.col("n_error"), F.col("n_warning"), F.col("n_critical")

    def less(points: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(100.0) - points)

    scored = rolled.withColumns(
        {
            "annotation_score": less(5 * e),
            "image_score": less(2 * (e + w)),
            "class_score": less(3 * w),
            "box_score": less(4 * (e + c)),
        }
    )
    total = sum((F.col(f"{k}_score") for k in ("annotation", "image", "class", "box")), F.lit(0.0))
    return scored.withColumn("quality_index", F.round(total / 4.0, 4))


def v2_index(rolled: DataFrame) -> DataFrame:
    """Scores of the second engine: shares of issues per object or image, mean and grade.

    ``rolled`` has n_images and n_objects besides the issue counts.
    """

    def score(issues: Column, of: str) -> Column:
        return F.round(S.clamp(100.0 - issues * 100.0 / F.greatest(F.col(of), F.lit(1)), 0.0, 100.0), 2)

    scored = rolled.withColumns(
        {
            "annotation_completeness": score(F.col("n_error"), "n_objects"),
            "image_integrity": score(F.col("n_error"), "n_images"),
            "class_consistency": score(F.col("n_warning"), "n_objects"),
            "box_validity": score(F.col("n_issues"), "n_objects"),
        }
    )
    names = ("annotation_completeness", "image_integrity", "class_consistency", "box_validity")
    total = sum((F.col(n) for n in names), F.lit(0.0))
    # scores have two places, so their mean is rounded in whole hundredths: halves go up, whatever the sum's last bits
    indexed = scored.withColumn("quality_index", F.round(F.round(total * 100) / 4) / 100)
    return indexed.withColumn("grade", S.grade(F.col("quality_index")))


def quality_by_dataset(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """The second engine's index and grade of each dataset."""
    sizes = with_object_counts(images, boxes).groupBy("dataset").agg(
        F.count("*").alias("n_images"), F.sum("n_objects").cast("long").alias("n_objects")
    )
    counts = ["n_issues", "n_info", "n_warning", "n_error", "n_critical"]
    rolled = rollup(v2_issues(images, boxes), ["dataset"]).drop("passed")
    return v2_index(sizes.join(rolled, "dataset", "left").na.fill(0, counts))
