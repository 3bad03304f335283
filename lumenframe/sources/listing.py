"""File listings without reading content, and the image scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.schema import ANNOTATION_EXTENSIONS, IMAGE_EXTENSIONS


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file system, so any store Spark reads is checked."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(where) and store.getFileStatus(where).isDirectory()


def is_file(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path) and not is_folder(spark, path)


def check_folder(spark: SparkSession, root: str) -> None:
    """Raise unless ``root`` is a folder with an image below it."""
    if not path_exists(spark, root):
        raise FileNotFoundError(root)
    if not is_folder(spark, root):
        raise NotADirectoryError(root)
    if list_files(spark, root).filter("kind = 'image'").isEmpty():
        raise ValueError(f"no images below {root}")


def read_reference(spark: SparkSession, path: str) -> np.ndarray:
    """One reference image (three channels of bytes) for all tasks."""
    row = read_images(spark, path).first()
    if row is None or row["width"] <= 0 or row["channels"] != 3:
        raise ValueError(f"no colour image at {path}")
    return np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], 3)


def _binary(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def empty_files(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path of files without content, which Spark's readers leave out.

    The driver's own file index knows all names; those that a scan does not give are empty.
    """
    found = _binary(spark, root, recursive, glob)
    named = spark.createDataFrame([(name,) for name in found.inputFiles()], "path string")
    decoded = named.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    known = found.select(S.plain_path(F.col("path")).alias("plain"))
    return decoded.withColumn("plain", S.plain_path(F.col("path"))).join(known, "plain", "left_anti").select("path")


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length, kind (image, annotation or other), empty files too; content is never read."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "path string, length long, kind string")
    found = _binary(spark, root, recursive).select("path", "length")
    found = found.unionByName(empty_files(spark, root, recursive).withColumn("length", F.lit(0).cast("long")))
    path = F.col("path")
    kind = (
        F.when(S.has_extension(path, IMAGE_EXTENSIONS), "image")
        .when(S.has_extension(path, ANNOTATION_EXTENSIONS), "annotation")
        .otherwise("other")
    )
    return found.select("path", "length", kind.alias("kind"))


def image_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    return list_files(spark, root, recursive).filter("kind = 'image'").orderBy("path")


def annotation_files(spark: SparkSession, root: str, recursive: bool = True, with_csv: bool = False) -> DataFrame:
    found = list_files(spark, root, recursive).filter("kind = 'annotation'")
    return found if with_csv else found.filter(S.extension(F.col("path")) != ".csv")


def count_files(files: DataFrame) -> DataFrame:
    """One row: n_images, n_annotations, n_files."""
    return files.agg(
        F.count_if(F.col("kind") == "image").alias("n_images"),
        F.count_if(F.col("kind") == "annotation").alias("n_annotations"),
        F.count("*").alias("n_files"),
    )


def split_of_path(path: Column) -> Column:
    """train, val or test by a folder name on the path (the last such folder), else null."""
    folder = F.lower(F.regexp_extract(path, r"(?i).*/(train|training|valid|validation|val|test)/", 1))
    return F.when(folder.startswith("train"), "train").when(folder.startswith("val"), "val").when(folder == "test", "test")


def find_splits(files: DataFrame) -> DataFrame:
    return files.groupBy(split_of_path(F.col("path")).alias("split")).agg(F.count("*").alias("n")).filter("split IS NOT NULL")


def _image_glob() -> str:
    """A glob of the image suffixes in any case."""
    either = ["".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in IMAGE_EXTENSIONS]
    return "*.{" + ",".join(either) + "}"


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels, data (BGR rows); an undecodable or empty file has width -1."""
    source = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", _image_glob())
    found = source.load(root)
    broken = F.lit(-1)
    empty = empty_files(spark, root, glob=_image_glob()).select(
        "path", broken.alias("width"), broken.alias("height"), broken.alias("channels"), F.lit(None).cast("binary").alias("data")
    )
    decoded = found.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    return decoded.unionByName(empty)


def image_sizes(images: DataFrame) -> DataFrame:
    """Sizes with (0, 0) for what cannot be decoded; the pixels are pruned."""
    broken = F.col("width") < 0
    return images.select(
        "path", F.when(broken, 0).otherwise(F.col("width")).alias("width"), F.when(broken, 0).otherwise(F.col("height")).alias("height")
    )


def content_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, md5, sha256 of each file."""
    found = _binary(spark, root).select("path", "content")
    found = found.unionByName(empty_files(spark, root).withColumn("content", F.lit(b"")))
    return found.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def with_file_facts(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images with file_found and file_length from a listing."""
    facts = files.select(S.plain_path(F.col("path")).alias("_plain"), F.col("length").alias("file_length"))
    joined = images.withColumn("_plain", S.plain_path(F.col("image_path"))).join(facts, "_plain", "left").drop("_plain")
    return joined.withColumn("file_found", F.col("file_length").isNotNull())
