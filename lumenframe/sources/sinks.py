"""Writers: label files, manifests, class folders, images, small texts."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators import ranked as R


def label_line(class_id: Column) -> Column:
    """``id xc yc w h`` with six places."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, F.col("xc"), F.col("yc"), F.col("w"), F.col("h"))


def yolo_labels(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """split, stem, label_text of every image; class ids are made contiguous, images without a split go to train."""
    relabelled = R.relabel(boxes)
    line = F.struct("object_index", label_line(F.col("new_id")).alias("line"))
    texts = relabelled.groupBy("seq").agg(F.array_sort(F.collect_list(line)).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("train"))
    joined = images.join(texts.select("seq", F.concat(text, F.lit("\n")).alias("label_text")), "seq", "left")
    return joined.select("seq", split.alias("split"), S.stem(F.col("image_path")).alias("stem"), F.coalesce("label_text", F.lit("")).alias("label_text"))


def class_names(boxes: DataFrame) -> DataFrame:
    """new_id, name: first-seen name of each class, in contiguous order."""
    first = boxes.filter(~S.is_blank(F.col("class_name"))).groupBy("class_id").agg(F.min_by("class_name", F.struct("seq", "object_index")).alias("name"))
    ids = R.contiguous_classes(boxes).join(first, "class_id", "left")
    return ids.select("new_id", F.coalesce("name", F.concat(F.lit("Class_"), F.col("class_id").cast("string"))).alias("name"))


def manifest_text(names: dict[int, str]) -> str:
    """data.yaml of an export (one small file)."""
    import yaml

    return yaml.safe_dump(
        {"train": "images/train", "val": "images/val", "test": "images/test", "nc": len(names), "names": names}, sort_keys=False, allow_unicode=True
    )


def class_folder(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """seq, target path split/class/file: the first object's class decides, ``unlabeled`` without one."""
    first = boxes.groupBy("seq").agg(F.min_by("class_name", "object_index").alias("class_name"))
    joined = images.join(first, "seq", "left")
    split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("train"))
    label = F.coalesce(F.nullif(F.col("class_name"), F.lit("")), F.lit("unlabeled"))
    return joined.select("seq", F.concat_ws("/", split, label, S.filename(F.col("image_path"))).alias("target"))


def write_yolo(labels: DataFrame, names: DataFrame, root: str) -> None:
    """Label texts as a table partitioned by split, and data.yaml beside it.

    One small file for each image would be millions of files; the table holds the file
    name and its text, and ``export_yolo`` writes single files where they are needed.
    """
    labels.write.mode("overwrite").partitionBy("split").parquet(f"{root}/labels")
    found = {r["new_id"]: r["name"] for r in names.orderBy("new_id").collect()}  # one row per class
    write_text(labels, manifest_text(found), f"{root}/data.yaml")


def label_files(labels: DataFrame, root: str) -> DataFrame:
    """path, content of one text file for each image: root/split/stem.txt."""
    path = F.concat_ws("/", F.lit(root.rstrip("/")), "split", F.concat("stem", F.lit(".txt")))
    return labels.select(path.alias("path"), F.col("label_text").cast("binary").alias("content"))


def write_label_files(labels: DataFrame, root: str) -> int:
    return write_files(label_files(labels, root))


# -- files -------------------------------------------------------------------


def _store(path: str):
    """The file system of a path, and the path within it."""
    from urllib.parse import quote

    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(quote(path, safe=":/"))


def write_files(files: DataFrame) -> int:
    """Write path, content rows as files, from the executors; returns how many.

    Paths name a store that all executors reach (a shared folder or an object store). A
    repeated task writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath

        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                store, inside = _store(path.as_py())
                store.create_dir(posixpath.dirname(inside), recursive=True)
                with store.open_output_stream(inside) as out:
                    out.write(content.as_py() or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copies(spark: SparkSession, source_root: str, targets: DataFrame) -> DataFrame:
    """path, content of copies: ``targets`` has the image_path of a file below ``source_root`` and its target path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source_root)
    wanted = targets.select(S.plain_path(F.col("image_path")).alias("image_path"), F.col("target").alias("path"))
    return found.select(S.plain_path(F.col("path")).alias("image_path"), "content").join(wanted, "image_path").select("path", "content")


def savable(image: np.ndarray) -> np.ndarray:
    """Bytes of an image of any range: floats up to 1 are scaled to 255."""
    if image.dtype == np.uint8:
        return image
    image = image.astype(np.float32)
    most = image.max() if image.size else 1.0
    return np.clip(image * 255.0 if most <= 1.0 + 1e-6 else image, 0, 255).astype(np.uint8)


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG of a gray or BGR image."""
    image = savable(image)
    rows = image[:, :, None] if image.ndim == 2 else image[..., 2::-1]
    height, width, channels = rows.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rows).reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def processed_files(processed: DataFrame, originals: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """path, content of processed images as PNG, in the folders they came from; the original where processing failed.

    ``processed``: path, width, height, channels, data, dtype, passed; ``originals``: path, content.
    """
    processed, originals = (rows.withColumn("path", S.plain_path(F.col("path"))) for rows in (processed, originals))
    target = output_path(F.col("path"), re.sub("^file:/+", "/", source_root), target_root)
    good = processed.filter("passed").select(target.alias("path"), "width", "height", "channels", "data", "dtype")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 16):
                made = []
                for r in batch.iloc[at : at + 16].itertuples(index=False):
                    shape = (r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels)
                    made.append((r.path, png_bytes(np.frombuffer(r.data, r.dtype).reshape(shape))))
                yield pd.DataFrame(made, columns=["path", "content"])

    failed = processed.filter(~F.col("passed")).select("path").join(originals, "path").select(target.alias("path"), "content")
    return good.mapInPandas(run, "path string, content binary").unionByName(failed)


def export_yolo(images: DataFrame, boxes: DataFrame, root: str, source_root: str | None = None) -> dict[str, int]:
    """Label files, data.yaml and, with ``source_root``, the images, in root/labels and root/images by split."""
    root = root.rstrip("/")
    labels = yolo_labels(images, boxes)
    written = {"labels": write_label_files(labels, f"{root}/labels")}
    names = {r["new_id"]: r["name"] for r in class_names(boxes).collect()}  # one row per class
    write_text(images, manifest_text(dict(sorted(names.items()))), f"{root}/data.yaml")
    if source_root:
        split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("train"))
        target = F.concat_ws("/", F.lit(f"{root}/images"), split, S.filename(F.col("image_path")))
        written["images"] = write_files(copies(images.sparkSession, source_root, images.select("image_path", target.alias("target"))))
    return written


def export_classification(images: DataFrame, boxes: DataFrame, root: str, source_root: str) -> int:
    """Images copied to root/split/class; returns how many."""
    targets = images.select("seq", "image_path").join(class_folder(images, boxes), "seq")
    targets = targets.select("image_path", F.concat(F.lit(root.rstrip("/") + "/"), "target").alias("target"))
    return write_files(copies(images.sparkSession, source_root, targets))


def write_text(any_frame: DataFrame, text: str, path: str) -> None:
    """A small text through Hadoop's file system."""
    context = any_frame.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def report_json(one_row: DataFrame) -> str:
    """JSON of a one-row aggregate."""
    return one_row.select(F.to_json(F.struct(*one_row.columns))).first()[0]


def save(report: str, any_frame: DataFrame, path: str) -> str:
    write_text(any_frame, report, path)
    return path


def save_dataset(parts: dict[str, DataFrame], root: str) -> None:
    """Whole tables of a dataset, each in a folder of its own."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def load_dataset(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in names}


def write_log(log: DataFrame, path: str) -> None:
    """A build log as CSV."""
    log.write.mode("overwrite").option("header", True).csv(path)


def sidecars(processed: DataFrame) -> DataFrame:
    """path, metadata (JSON) of preprocessed images, without their pixels."""
    columns = [c for c in processed.columns if c not in ("path", "data")]
    return processed.select("path", F.to_json(F.struct(*columns)).alias("metadata"))


def output_path(path: Column, source_root: str, target_root: str) -> Column:
    """The path under another root, its folders kept."""
    inside = F.substring(path, F.lit(len(source_root.rstrip("/")) + 1), F.length(path))
    return F.when(path.startswith(source_root), F.concat(F.lit(target_root.rstrip("/")), inside)).otherwise(path)
