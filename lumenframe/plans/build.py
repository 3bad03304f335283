"""From folders to harmonised images and boxes: catalogue, preparation, build.

A catalogue entry names a folder, its annotation format and its classes; formats are
inferred where they are not given. ``build`` plans one DataFrame each of images, boxes
and log rows; images without annotation are logged as failed and left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators import dataset as D
from lumenframe.plans.pipeline import Pipeline
from lumenframe.schema import ANNOTATION_EXTENSIONS, CLASS_ALIASES
from lumenframe.sources import annotations as A
from lumenframe.sources import listing as L
from lumenframe.sources import sniff as N


@dataclass
class Entry:
    name: str
    root: str
    annotation: str | None = None
    task: str | None = None
    classes: dict[int, str] = field(default_factory=dict)
    status: str = "Pending"
    messages: list[str] = field(default_factory=list)


@dataclass
class Built:
    images: DataFrame
    boxes: DataFrame
    log: DataFrame
    #: Processed pixels and their history, where preprocessing is on.
    processed: DataFrame | None = None


def _key(path: Column) -> Column:
    """What images and annotation files are matched by: the stem, without case."""
    return F.lower(S.stem(F.regexp_replace(path, "%20", " ")))


def _texts(spark: SparkSession, entry: Entry, suffix: str) -> DataFrame:
    return A.read_texts(spark, entry.root, suffix)


def _of_files(texts: DataFrame, boxes: Column) -> DataFrame:
    """key, b of annotation files that each describe one image; of several with one key the last path counts."""
    return texts.select(_key(F.col("path")).alias("key"), "path", boxes.alias("b")).groupBy("key").agg(F.max_by("b", "path").alias("b"))


def _yolo(spark: SparkSession, entry: Entry) -> DataFrame:
    texts = _texts(spark, entry, ".txt").filter(~F.lower(S.filename(F.col("path"))).isin("classes.txt", "readme.txt"))
    return _of_files(texts, A.yolo_boxes(F.col("text")))


def _points(spark: SparkSession, entry: Entry) -> DataFrame:
    return _of_files(_texts(spark, entry, ".txt"), A.point_boxes(F.col("text")))


def _voc(spark: SparkSession, entry: Entry) -> DataFrame:
    return _of_files(A.read_voc(spark, entry.root), A.voc_array(F.col("object"), F.col("size")))


def _coco(spark: SparkSession, entry: Entry) -> DataFrame:
    texts = _texts(spark, entry, ".json").filter(N.is_coco(F.col("text")))
    return A.coco_by_name(texts.select(F.col("path").alias("file"), F.from_json("text", A.COCO_DOCUMENT).alias("doc")))


def _rowcol(spark: SparkSession, entry: Entry) -> DataFrame:
    texts = _texts(spark, entry, ".json").filter(N.is_rowcol(F.col("text")))
    return A.rowcol_by_name(texts.select(F.col("path").alias("file"), "text"))


def by_name_then_stem(images: DataFrame, records: DataFrame) -> DataFrame:
    """seq, b of images whose record has their file name, else the first record with their stem."""
    named = images.select("seq", S.filename(F.col("image_path")).alias("name"), S.stem(F.col("image_path")).alias("stem"))
    by_stem = records.groupBy(S.stem(F.col("name")).alias("stem")).agg(F.min_by("b", "first").alias("by_stem"))
    joined = named.join(records.select("name", F.col("b").alias("by_name")), "name", "left").join(by_stem, "stem", "left")
    return joined.select("seq", F.coalesce("by_name", "by_stem").alias("b")).filter("b IS NOT NULL")


def by_stem(images: DataFrame, files: DataFrame) -> DataFrame:
    """seq, b of images with an annotation file of their stem."""
    return images.select("seq", _key(F.col("image_path")).alias("key")).join(files, "key").select("seq", "b")


def named_boxes(matched: DataFrame, classes: dict[int, str]) -> DataFrame:
    """Boxes of matched images (seq, b) in file order; a name is the box's own, the dataset's, or ``Class_<id>``."""
    flat = matched.select("seq", F.posexplode("b").alias("object_index", "x"))
    class_id = F.col("x.class_id")
    default = F.concat(F.lit("Class_"), class_id.cast("string"))
    names = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]) if classes else None
    name = F.coalesce(F.try_element_at(names, class_id), default) if names is not None else default
    if "class_name" in matched.schema["b"].dataType.elementType.names:
        name = F.coalesce(F.col("x.class_name"), name)
    return flat.select("seq", "object_index", class_id.alias("class_id"), name.alias("class_name"), "x.xc", "x.yc", "x.w", "x.h", F.lit(1.0).alias("confidence"))


_ALIASES = {k: v[0] for k, v in CLASS_ALIASES.items()}


@dataclass(frozen=True)
class Adapter:
    """How one annotation layout is read, how its records find their images, and its default classes."""

    read: Callable[[SparkSession, Entry], DataFrame]
    match: Callable[[DataFrame, DataFrame], DataFrame]
    classes: dict[int, str] = field(default_factory=dict)
    #: One annotation describes the whole dataset: images that it lacks are built without objects.
    whole: bool = False


ADAPTERS: dict[str, Adapter] = {
    "YOLO": Adapter(_yolo, by_stem),
    "Point TXT": Adapter(_points, by_stem),
    "Pascal VOC": Adapter(_voc, by_stem, _ALIASES),
    "COCO": Adapter(_coco, by_name_then_stem, whole=True),
    "Row/column JSON": Adapter(_rowcol, by_name_then_stem, _ALIASES, True),
}
#: Task of each annotation layout; what is not here is unknown.
TASKS = {**dict.fromkeys(ADAPTERS, "Detection"), "CSV": "Classification", "None": "Classification", "Clinical": "Report"}


class Catalog:
    """Datasets by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entries: dict[str, Entry] = {}
        self.preprocessing: Pipeline | None = None

    def enable_preprocessing(self, config: dict[str, dict] | None = None) -> Pipeline:
        """From now on builds run the configured steps on every image (none but the measures by default)."""
        self.preprocessing = Pipeline.from_config(config or {"quality": {}})
        return self.preprocessing

    def disable_preprocessing(self) -> None:
        self.preprocessing = None

    def register(self, name: str, root: str, annotation: str, task: str | None = None, classes: dict[int, str] | None = None) -> Entry:
        """Add a folder; its task is that of its annotation layout unless given."""
        if name in self.entries:
            raise ValueError(f"{name!r} is registered already")
        self.entries[name] = Entry(name, root.rstrip("/"), annotation, task or TASKS.get(annotation, "Unknown"), classes or {})
        return self.entries[name]

    def get(self, name: str) -> Entry | None:
        return self.entries.get(name)

    def auto_register(self, root: str, name: str | None = None) -> Entry:
        """Register a folder with the format its files suggest."""
        root = root.rstrip("/")
        files = L.list_files(self.spark, root)
        sample = files.filter("kind = 'image'").select("path", F.lit(None).cast("string").alias("text"))
        if L.path_exists(self.spark, root):
            for suffix in ANNOTATION_EXTENSIONS:
                sample = sample.unionByName(A.read_texts(self.spark, root, suffix).select("path", "text"))
        found = N.dataset_format(sample).first()
        classes = N.manifest_classes(self.spark, root)
        if found.annotation == "None":
            classes = {r.class_id: r.label for r in N.folder_classes(files).collect()}  # one row per folder
        elif found.annotation == "Pascal VOC":
            classes = {r.class_id: r.label for r in A.voc_classes(A.read_voc(self.spark, root)).collect()}  # one row per class
        return self.register(name or root.rsplit("/", 1)[-1], root, found.annotation, found.task, classes)

    def prepare(self, name: str) -> Entry:
        """Count files and settle the entry's status: READY, WARNING or ERROR."""
        entry = self.entries[name]
        counts = L.count_files(L.list_files(self.spark, entry.root)).first()
        entry.messages = []
        if not counts.n_images:
            entry.messages.append("ERROR: no images")
        if entry.annotation == "Unknown":
            entry.messages.append("ERROR: unknown annotation format")
        elif entry.annotation not in ("None", "Clinical") and not counts.n_annotations:
            entry.messages.append("ERROR: no annotations")
        elif entry.task == "Detection" and entry.annotation in ("YOLO", "Pascal VOC", "Point TXT") and counts.n_annotations != counts.n_images:
            entry.messages.append("WARNING: as many annotations as images are expected")
        levels = {m.split(":")[0] for m in entry.messages}
        entry.status = "ERROR" if "ERROR" in levels else "WARNING" if levels else "READY"
        return entry

    def prepare_all(self) -> list[Entry]:
        """All entries; a failing one is marked and the rest go on."""
        for name, entry in self.entries.items():
            try:
                self.prepare(name)
            except Exception as error:  # reported in the entry, as the caller expects
                entry.status, entry.messages = "ERROR", [f"ERROR: {error}"]
        return list(self.entries.values())

    def build(self, name: str) -> Built:
        entry = self.entries[name]
        decoded = L.read_images(self.spark, entry.root)
        images = decoded.select(
            F.xxhash64("path").alias("seq"),
            S.stem(F.col("path")).alias("image_id"),
            F.col("path").alias("image_path"),
            F.lit(entry.name).alias("dataset"),
            F.when(F.col("width") < 0, 0).otherwise(F.col("width")).alias("width"),
            F.when(F.col("height") < 0, 0).otherwise(F.col("height")).alias("height"),
            F.coalesce(L.split_of_path(F.col("path")), F.lit("train")).alias("split"),
        )
        if entry.annotation in ADAPTERS:
            adapter = ADAPTERS[entry.annotation]
            matched = adapter.match(images, adapter.read(self.spark, entry))
            boxes = named_boxes(matched, entry.classes or adapter.classes)
            annotated = images if adapter.whole else images.join(matched.select("seq"), "seq", "left_semi")
        elif entry.annotation in ("None", "CSV"):
            boxes = self._classified(entry, images)
            annotated = images.join(boxes.select("seq").distinct(), "seq", "left_semi")
        else:
            raise ValueError(f"no parser for {entry.annotation!r}")
        counted = annotated.join(D.object_counts(boxes), "seq", "left")
        good = counted.select(
            "dataset", F.col("image_path").alias("image"), F.lit("SUCCESS").alias("status"), F.coalesce("n_objects", F.lit(0)).alias("objects"), F.lit("").alias("message")
        )
        bad = D.missing(images, annotated, "seq").select(
            "dataset", F.col("image_path").alias("image"), F.lit("FAILED").alias("status"), F.lit(0).cast("long").alias("objects"), F.lit("no annotation").alias("message")
        )
        processed = self.preprocessing.apply(decoded) if self.preprocessing else None
        return Built(annotated, boxes, good.unionByName(bad), processed)

    def clinical(self, name: str) -> DataFrame:
        """dataset, path, counts, findings of the reports of a dataset."""
        entry = self.entries[name]
        return A.clinical_records(_texts(self.spark, entry, ".txt")).select(F.lit(entry.name).alias("dataset"), "path", "counts", "findings")

    def _classified(self, entry: Entry, images: DataFrame) -> DataFrame:
        files = images.select("seq", F.col("image_path").alias("path"))
        if entry.annotation == "CSV":
            rows = self.spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(entry.root)
            found = A.csv_labels(rows, files)[0].join(files, "path")
        else:
            dim = self.spark.createDataFrame(sorted(entry.classes.items()), "class_id int, label string")
            found = A.folder_labels(files, dim)[0]
        names = F.create_map(*[F.lit(x) for kv in entry.classes.items() for x in kv]) if entry.classes else None
        default = F.concat(F.lit("Class_"), F.col("class_id").cast("string"))
        name = F.coalesce(F.try_element_at(names, F.col("class_id")), default) if names is not None else default
        box = A.full_frame_box(F.col("class_id"), name)
        return found.select("seq", F.lit(0).alias("object_index"), F.inline(F.array(box)))

    def build_many(self, names: list[str] | None = None) -> tuple[Built, dict[str, str]]:
        """Union of several builds, and the errors of those that failed."""
        parts, errors = [], {}
        for name in names if names is not None else list(self.entries):
            try:
                parts.append(self.build(name))
            except Exception as error:  # isolated, as a batch of datasets must go on
                errors[name] = str(error)
        if not parts:
            raise ValueError("no dataset could be built")
        processed = [p.processed for p in parts if p.processed is not None]
        whole = [D.union_sources(*[getattr(p, k) for p in parts]) for k in ("images", "boxes", "log")]
        return Built(*whole, D.union_sources(*processed) if processed else None), errors

    def summary(self) -> str:
        return "".join(f"{e.name:<24} {e.task or '-':<16} {e.annotation or '-':<16} {e.status}\n" for e in self.entries.values())
