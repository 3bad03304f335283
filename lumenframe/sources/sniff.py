"""Format inference: predicates on text, and the cascade for a whole dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.schema import IMAGE_EXTENSIONS
from lumenframe.sources.annotations import lines, tokens

SAMPLE_LINES = 20
# Words that mark reports.
COUNT_WORDS = ("wbc,", "rbc,", "hgb")
REPORT_WORDS = ("peripheral smear", "rbc morphology", "platelets", "hypochromic", "microcytic")


def _head(text: Column) -> Column:
    return F.slice(lines(text), 1, SAMPLE_LINES)


def is_yolo(text: Column) -> Column:
    """A line of five numbers that begins with a whole one."""

    def fits(line: Column) -> Column:
        n = F.transform(tokens(line), lambda t: t.try_cast("double"))
        first = F.get(n, F.lit(0))
        return (F.size(n) == 5) & F.forall(n, lambda v: v.isNotNull()) & S.is_true(first == F.floor(first))

    return S.is_true(F.exists(_head(text), fits))


def is_points(text: Column) -> Column:
    """A line of three whole numbers."""

    def fits(line: Column) -> Column:
        return (F.size(tokens(line)) == 3) & F.forall(tokens(line), lambda t: t.rlike(r"^[+-]?\d+$"))

    return S.is_true(F.exists(_head(text), fits))


def is_counts_report(text: Column) -> Column:
    low = F.lower(text)
    return S.is_true(low.contains(COUNT_WORDS[0]) & low.contains(COUNT_WORDS[1]) & low.contains(COUNT_WORDS[2]))


def keyword_score(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def is_findings_report(text: Column) -> Column:
    return keyword_score(text, REPORT_WORDS) >= 2


def _top_keys(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.when(F.ltrim(text).startswith("{"), text)), F.array().cast("array<string>"))


def is_coco(text: Column) -> Column:
    keys = _top_keys(text)
    return F.array_contains(keys, "images") & F.array_contains(keys, "annotations") & F.array_contains(keys, "categories")


def is_rowcol(text: Column) -> Column:
    first = F.when(F.ltrim(text).startswith("["), text)
    return F.get_json_object(first, "$[0].image").isNotNull() & F.get_json_object(first, "$[0].objects").isNotNull()


def is_voc(text: Column) -> Column:
    """The root element is ``annotation``."""
    return S.is_true(F.regexp_extract(text, r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--.*?-->\s*)*<([A-Za-z_][\w.-]*)", 1) == "annotation")


def detect(path: Column, text: Column) -> Column:
    """Format of one file, by suffix and content."""
    suffix = S.extension(path)
    plain = (
        F.when(is_yolo(text), "YOLO")
        .when(is_points(text), "Point TXT")
        .when(is_counts_report(text), "Counts report")
        .when(is_findings_report(text), "Findings report")
        .otherwise("Generic TXT")
    )
    json = F.when(is_rowcol(text), "Row/column JSON").when(is_coco(text), "COCO").otherwise("JSON")
    xml = F.when(is_voc(text), "Pascal VOC").otherwise("XML")
    return (
        F.when(suffix == ".txt", plain).when(suffix == ".json", json).when(suffix == ".xml", xml).when(suffix == ".csv", "CSV").otherwise("Unknown")
    )


def coarse_format(path: Column) -> Column:
    suffix = S.extension(path)
    return F.when(suffix.isin(".txt", ".xml", ".json", ".csv"), F.upper(F.substring(suffix, 2, 4))).otherwise("UNKNOWN")


def dataset_format(files: DataFrame) -> DataFrame:
    """annotation, task and modal image suffix of a dataset: one row.

    ``files``: path, text (null for images). Up to 20 XML and text files, in path
    order, decide; half of them must fit. Order of precedence: COCO, VOC, YOLO, CSV,
    folder per class, unknown.
    """
    path = F.col("path")
    kind = S.extension(path)
    name = F.lower(S.filename(path))
    marked = files.withColumns(
        {
            "is_image": kind.isin(*IMAGE_EXTENSIONS),
            "is_text": (kind == ".txt") & ~name.isin("classes.txt", "readme.txt"),
            "is_xml": kind == ".xml",
            "coco": S.is_true((kind == ".json") & is_coco(F.col("text"))),
            "voc": is_voc(F.col("text")),
            "yolo": is_yolo(F.col("text")),
            "folder": F.regexp_extract(path, r"([^/]+)/[^/]*$", 1),
        }
    )

    def sampled(flag: str, fits: str) -> DataFrame:
        head = marked.filter(flag).orderBy("path").limit(SAMPLE_LINES)
        return head.agg(F.count("*").alias(f"n_{fits}"), F.count_if(F.col(fits)).alias(f"hits_{fits}"))

    facts = marked.agg(
        F.count_if("is_image").alias("n_images"),
        F.count_if("is_text").alias("n_texts"),
        F.count_if("is_xml").alias("n_xml"),
        F.count_if(kind == ".csv").alias("n_csv"),
        F.count_if("coco").alias("n_coco"),
        F.count_distinct(F.when(F.col("is_image"), F.col("folder"))).alias("n_folders"),
        F.mode(F.when(F.col("is_image"), kind)).alias("image_suffix"),
    )
    row = facts.crossJoin(sampled("is_xml", "voc")).crossJoin(sampled("is_text", "yolo"))  # one row each

    def half(what: str) -> Column:
        return (F.col(f"n_{what}") > 0) & (F.col(f"hits_{what}") * 2 >= F.col(f"n_{what}"))

    only_images = (F.col("n_texts") == 0) & (F.col("n_xml") == 0)
    found = (
        F.when(F.col("n_coco") > 0, "COCO")
        .when(half("voc"), "Pascal VOC")
        .when(half("yolo"), "YOLO")
        .when((F.col("n_images") > 0) & (F.col("n_csv") > 0) & only_images, "CSV")
        .when((F.col("n_images") > 0) & (F.col("n_folders") > 1), "None")
        .otherwise("Unknown")
    )
    task = F.when(F.col("annotation").isin("COCO", "Pascal VOC", "YOLO"), "Detection").when(
        F.col("annotation").isin("CSV", "None"), "Classification"
    )
    return row.withColumn("annotation", found).select(
        "annotation", F.coalesce(task, F.lit("Unknown")).alias("task"), "image_suffix", "n_images"
    )


def folder_classes(files: DataFrame) -> DataFrame:
    """class_id (rank of the folder name), label: folders that hold an image."""
    from pyspark.sql import Window

    held = files.filter(S.has_extension(F.col("path"), IMAGE_EXTENSIONS))
    folders = held.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("label")).distinct()
    return folders.withColumn("class_id", F.row_number().over(Window.orderBy("label")) - 1)


def find_manifest(spark: SparkSession, root: str) -> str | None:
    """Path of the manifest at a dataset's root, if it has one."""
    from lumenframe.sources.listing import path_exists

    names = (f"{root.rstrip('/')}/{n}" for n in ("data.yaml", "data.yml"))
    return next((n for n in names if path_exists(spark, n)), None)


def manifest_classes(spark: SparkSession, root: str) -> dict[int, str]:
    """Class names of a dataset's manifest (one small file), none without one."""
    path = find_manifest(spark, root)
    return read_manifest(spark.read.text(path, wholetext=True).first()[0])["names"] if path else {}


def read_manifest(text: str) -> dict:
    """A dataset manifest (YAML): names as an id map, nc, and split paths."""
    import yaml

    data = yaml.safe_load(text) or {}
    names = data.get("names", [])
    data["names"] = {int(k): v for k, v in names.items()} if isinstance(names, dict) else dict(enumerate(names))
    return data
