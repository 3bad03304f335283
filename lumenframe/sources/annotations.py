"""Parsers of annotation layouts, as column expressions over file texts.

Each takes a DataFrame of texts (one file or record a row) and gives boxes with a
normalised centre (xc, yc, w, h). Tokens that do not parse are dropped by ``try_cast``;
no row raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import scalars as S
from lumenframe.schema import POINT_BOX, POINT_FRAME, class_ids
from lumenframe.sources.listing import empty_files

# -- reading -----------------------------------------------------------------


def any_case(suffix: str) -> str:
    """A glob of files with a suffix in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def read_texts(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """path, text: whole files, empty ones too; with a suffix no other file is opened."""
    glob = any_case(suffix) if suffix else None
    reader = spark.read.option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).text(path, wholetext=True)
    texts = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.unionByName(empty_files(spark, path, glob=glob).withColumn("text", F.lit("")))


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def numbers(line: Column) -> Column:
    return F.transform(tokens(line), lambda t: t.try_cast("double"))


# -- text layouts ------------------------------------------------------------


def yolo_boxes(text: Column) -> Column:
    """array<struct<class_id, xc, yc, w, h>> of lines ``id xc yc w h``."""
    rows = F.filter(F.transform(lines(text), numbers), lambda n: (F.size(n) >= 5) & F.forall(F.slice(n, 1, 5), lambda v: v.isNotNull()))
    return F.transform(
        rows,
        lambda n: F.struct(
            F.get(n, F.lit(0)).cast("int").alias("class_id"),
            F.get(n, F.lit(1)).alias("xc"),
            F.get(n, F.lit(2)).alias("yc"),
            F.get(n, F.lit(3)).alias("w"),
            F.get(n, F.lit(4)).alias("h"),
        ),
    )


def point_boxes(text: Column, frame: tuple[int, int] = POINT_FRAME, side: int = POINT_BOX) -> Column:
    """array<struct<class_id, xc, yc, w, h>> of lines ``x y class``; a fixed box in pixels."""
    width, height = float(frame[0]), float(frame[1])
    rows = F.filter(F.transform(lines(text), numbers), lambda n: (F.size(n) >= 3) & F.forall(F.slice(n, 1, 3), lambda v: v.isNotNull()))
    return F.transform(
        rows,
        lambda n: F.struct(
            F.get(n, F.lit(2)).cast("int").alias("class_id"),
            (F.get(n, F.lit(0)) / width).alias("xc"),
            (F.get(n, F.lit(1)) / height).alias("yc"),
            F.lit(side / width).alias("w"),
            F.lit(side / height).alias("h"),
        ),
    )


def report_values(text: Column) -> Column:
    """map<string, double> of ``Key: value`` lines but Morphology; the last of a key wins."""
    pairs = F.filter(
        F.transform(
            F.filter(lines(text), lambda x: x.contains(":")),
            lambda x: F.struct(
                F.trim(F.substring_index(x, ":", 1)).alias("key"),
                F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).try_cast("double").alias("value"),
            ),
        ),
        lambda p: p["value"].isNotNull() & (F.lower(p["key"]) != "morphology"),
    )
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))),
                    lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def report_findings(text: Column) -> Column:
    """Items of the last ``Morphology:`` line."""
    found = F.filter(lines(text), lambda x: F.lower(x).startswith("morphology:"))
    last = F.element_at(found, F.when(F.size(found) > 0, -1).otherwise(F.lit(None)))
    items = F.transform(F.split(F.substring(last, 12, F.length(last)), ","), lambda x: F.trim(x))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


# -- JSON and XML ------------------------------------------------------------

_POINT = T.StructType([T.StructField("r", T.DoubleType()), T.StructField("c", T.DoubleType())])
ROWCOL_RECORD = T.StructType(
    [
        T.StructField(
            "image", T.StructType([T.StructField("pathname", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("shape", _POINT)])
        ),
        T.StructField(
            "objects",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("category", T.StringType()),
                        T.StructField("bounding_box", T.StructType([T.StructField("minimum", _POINT), T.StructField("maximum", _POINT)])),
                    ]
                )
            ),
        ),
    ]
)
COCO_DOCUMENT = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()),
            T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()),
            T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    ]
)
VOC_ANNOTATION = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])),
        T.StructField("object", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("bndbox", T.StructType([T.StructField(k, T.DoubleType()) for k in ("xmin", "ymin", "xmax", "ymax")]))]))),
    ]
)


def mapped_class(name: Column) -> Column:
    """Class id of an alias, null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in class_ids().items() for x in kv])
    return F.try_element_at(table, name)


def _or_one(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(1.0))


def rowcol_records(text: Column) -> Column:
    """array of row/column records from a JSON object or an array of them."""
    many = F.from_json(text, T.ArrayType(ROWCOL_RECORD))
    one = F.array(F.from_json(text, ROWCOL_RECORD))
    return F.when(F.ltrim(text).startswith("["), many).otherwise(one)


def rowcol_boxes(record: Column) -> Column:
    """Boxes of a row/column record; categories without a class are dropped."""
    height, width = _or_one(record["image"]["shape"]["r"]), _or_one(record["image"]["shape"]["c"])

    def one(o: Column) -> Column:
        low, high = o["bounding_box"]["minimum"], o["bounding_box"]["maximum"]
        return F.struct(
            mapped_class(F.lower(o["category"])).alias("class_id"),
            ((low["c"] + high["c"]) / 2.0 / width).alias("xc"),
            ((low["r"] + high["r"]) / 2.0 / height).alias("yc"),
            ((high["c"] - low["c"]) / width).alias("w"),
            ((high["r"] - low["r"]) / height).alias("h"),
        )

    return F.filter(F.transform(record["objects"], one), lambda b: b["class_id"].isNotNull())


def rowcol_by_name(documents: DataFrame) -> DataFrame:
    """name, first, b (boxes in file order), width, height of row/column records; the last record of a name counts.

    ``documents``: file, text. ``first`` tells the order in which names first occur, files in path order.
    """
    rows = documents.select("file", F.posexplode(rowcol_records(F.col("text"))).alias("at", "r"))
    place = F.struct("file", "at")
    path = F.coalesce(F.nullif(F.col("r.image.pathname"), F.lit("")), F.col("r.image.file_name"))
    named = rows.select(S.filename(path).alias("name"), place.alias("place"), "r").filter("name <> ''")
    newest = named.groupBy("name").agg(F.min("place").alias("first"), F.max_by("r", "place").alias("r"))
    shape = F.col("r.image.shape")
    return newest.select(
        "name", "first", rowcol_boxes(F.col("r")).alias("b"), F.coalesce(shape["c"], F.lit(0.0)).cast("int").alias("width"), F.coalesce(shape["r"], F.lit(0.0)).cast("int").alias("height")
    )


def coco_boxes(documents: DataFrame, merged: bool = False) -> DataFrame:
    """file, file_name, first, at, width, height, class_id, class_name, xc, yc, w, h of parsed documents.

    ``documents``: file, doc (COCO_DOCUMENT). Ids are local to a file, unless ``merged``:
    then the files count as one document, with the categories of the first file.
    Annotations of unknown images and images without a name are dropped; a later image of
    the same name in one document replaces an earlier one. ``first`` and ``at`` are the
    places of the image and of the annotation.
    """
    document = F.lit("") if merged else F.col("file")
    images = documents.select("file", F.posexplode("doc.images").alias("at", "i")).select(document.alias("document"), F.struct("file", "at").alias("first"), "i.*")
    newest = images.filter("file_name IS NOT NULL").groupBy("document", "file_name").agg(
        F.min("first").alias("first"), F.max_by(F.struct("id", "width", "height"), "first").alias("i")
    )
    images = newest.select("document", "file_name", "first", "i.id", "i.width", "i.height")
    notes = documents.select("file", F.posexplode("doc.annotations").alias("at", "a")).select(
        document.alias("document"),
        F.struct("file", "at").alias("at"),
        F.col("a.image_id").alias("id"),
        F.coalesce("a.category_id", F.lit(-1)).alias("class_id"),
        F.col("a.bbox").alias("bbox"),
    )
    named = documents.filter("size(doc.categories) > 0")
    if merged:
        named = named.orderBy("file").limit(1)
    names = named.select(document.alias("document"), F.explode("doc.categories").alias("c")).groupBy("document", F.col("c.id").alias("class_id")).agg(
        F.first("c.name").alias("class_name")
    )
    joined = images.join(notes, ["document", "id"]).join(names, ["document", "class_id"], "left")
    sized = F.col("width") * F.col("height") != 0

    def share(value: Column, of: str) -> Column:
        return F.when(S.is_true(sized), value / F.nullif(F.col(of), F.lit(0))).otherwise(0.0)

    x, y, w, h = (F.get("bbox", F.lit(k)) for k in range(4))
    return joined.select(
        F.col("document").alias("file"),
        "file_name",
        "first",
        "at",
        "width",
        "height",
        "class_id",
        F.coalesce("class_name", F.concat(F.lit("Class_"), F.col("class_id").cast("string"))).alias("class_name"),
        share(x + w / 2.0, "width").alias("xc"),
        share(y + h / 2.0, "height").alias("yc"),
        share(w, "width").alias("w"),
        share(h, "height").alias("h"),
    )


def coco_by_name(documents: DataFrame) -> DataFrame:
    """name, first, b (boxes in file order) of every image of merged documents, those without boxes too."""
    box = F.struct("at", "class_id", "class_name", "xc", "yc", "w", "h")
    found = coco_boxes(documents, merged=True).groupBy(S.filename(F.col("file_name")).alias("name")).agg(F.array_sort(F.collect_list(box)).alias("b"))
    images = documents.select("file", F.posexplode("doc.images").alias("at", "i")).select(S.filename(F.col("i.file_name")).alias("name"), F.struct("file", "at").alias("first"))
    listed = images.filter("name <> ''").groupBy("name").agg(F.min("first").alias("first"))
    empty = F.array().cast(found.schema["b"].dataType)
    return listed.join(found, "name", "left").withColumn("b", F.coalesce("b", empty))


def clinical_records(texts: DataFrame) -> DataFrame:
    """path, counts (map of numbers) and findings of clinical reports (path, text)."""
    return texts.select("path", report_values(F.col("text")).alias("counts"), report_findings(F.col("text")).alias("findings"))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of XML files, with the path of their file."""
    found = spark.read.format("xml").option("rowTag", "annotation").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(".xml"))
    return found.schema(VOC_ANNOTATION).load(path).select("*", F.col("_metadata.file_path").alias("path"))


def voc_array(objects: Column, size: Column) -> Column:
    """Boxes of one annotation in file order; unknown classes are dropped."""
    width, height = _or_one(size["width"]), _or_one(size["height"])

    def one(o: Column) -> Column:
        b = o["bndbox"]
        return F.struct(
            mapped_class(F.trim(o["name"])).alias("class_id"),
            ((b["xmin"] + b["xmax"]) / 2.0 / width).alias("xc"),
            ((b["ymin"] + b["ymax"]) / 2.0 / height).alias("yc"),
            ((b["xmax"] - b["xmin"]) / width).alias("w"),
            ((b["ymax"] - b["ymin"]) / height).alias("h"),
        )

    return F.coalesce(F.filter(F.transform(objects, one), lambda b: b["class_id"].isNotNull()), F.array().cast(_BOX_ARRAY))


_BOX_ARRAY = "array<struct<class_id: int, xc: double, yc: double, w: double, h: double>>"


def voc_boxes(annotations: DataFrame) -> DataFrame:
    """filename, width, height, object_index, class_id, xc, yc, w, h; unknown classes are dropped."""
    rows = annotations.select(
        "filename", F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.posexplode(voc_array(F.col("object"), F.col("size"))).alias("object_index", "b")
    )
    return rows.select("filename", "width", "height", "object_index", "b.*")


def voc_classes(annotations: DataFrame, most_files: int = 50) -> DataFrame:
    """class_id, label: names of known classes in the first files by path, the first name of each class."""
    head = annotations.orderBy("path").limit(most_files)
    rows = head.select("path", F.posexplode("object").alias("at", "o")).select(F.struct("path", "at").alias("place"), F.trim("o.name").alias("label"))
    known = rows.withColumn("class_id", mapped_class(F.col("label"))).filter("class_id IS NOT NULL")
    return known.groupBy("class_id").agg(F.min_by("label", "place").alias("label"))


# -- classification ----------------------------------------------------------


def full_frame_box(class_id: Column, class_name: Column) -> Column:
    half, one = F.lit(0.5), F.lit(1.0)
    return F.struct(
        class_id.alias("class_id"), class_name.alias("class_name"), half.alias("xc"), half.alias("yc"), one.alias("w"), one.alias("h"), one.alias("confidence")
    )


def folder_labels(files: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with the class of their parent folder, log of those without one)."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    keyed = files.withColumn("key", S.normalized_class_name(folder))
    classes = dim.select(S.normalized_class_name(F.col("label")).alias("key"), "class_id", "label")
    built = keyed.join(classes, "key").drop("key")
    failed = keyed.join(classes, "key", "left_anti").select(
        F.col("path").alias("image"), F.lit("FAILED").alias("status"), F.concat(F.lit("no class for folder "), F.col("key")).alias("message")
    )
    return built, failed


def find_column(names: list[str], candidates: tuple[str, ...]) -> str | None:
    """First header that holds one of the candidates, whatever its case."""
    return next((n for n in names if any(c in n.lower() for c in candidates)), None)


def csv_labels(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with a class id, log of rows without image or number).

    Ids match the file stem, or the stem without leading zeros.
    """
    id_col = find_column(rows.columns, ("image", "filename", "id"))
    label_col = find_column([c for c in rows.columns if c != id_col], ("class", "label"))
    if id_col is None or label_col is None:
        raise ValueError("no image or label column")
    bare = rows.select(F.trim(F.col(id_col).cast("string")).alias("id"), F.trim(F.col(label_col).cast("string")).try_cast("int").alias("class_id"))
    stems = files.groupBy(S.stem(F.col("path")).alias("stem")).agg(F.max("path").alias("path"))
    stripped = stems.groupBy(F.regexp_replace("stem", "^0+(?=.)", "").alias("short")).agg(F.min_by("path", "stem").alias("short_path"))
    keyed = bare.withColumns({"stem": S.stem(F.col("id")), "short": F.regexp_replace(S.stem(F.col("id")), "^0+(?=.)", "")})
    joined = keyed.join(stems, "stem", "left").join(stripped, "short", "left").withColumn("path", F.coalesce("path", "short_path"))
    good = F.col("path").isNotNull() & F.col("class_id").isNotNull()
    reason = F.when(F.col("class_id").isNull(), "label is no number").otherwise("no image with this id")
    failed = joined.filter(~good).select(F.col("id").alias("image"), F.lit("FAILED").alias("status"), reason.alias("message"))
    return joined.filter(good).select("path", "class_id"), failed
