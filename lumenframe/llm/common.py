"""Shared plumbing: table access, shared-folder materialisation, size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch while texts are written.
ARROW_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset on a
    single machine, as in tests, is a folder of our own made and set. A cluster whose
    executors share no named folder is an error: each would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="lumenframe-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def _writing(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound the rows of an Arrow batch while a table is written, and delete its shuffle files then.

    Whole texts of any length travel in these batches, outside the heap; the
    default of 10,000 rows would need hundreds of MB for each task. Shuffle files
    would otherwise stay until the driver's JVM happens to collect its garbage, so
    those of all steps would lie on disk together.
    """
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage so that a lost executor costs only the tasks it held, and
    it gives later joins plain scans on both sides, which adaptive execution can
    split when a key is hot. The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"
    with _writing(spark, ARROW_ROWS):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path.getFileSystem(conf).deleteOnExit(hadoop_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lumenframe_path = hadoop_path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for table in tables:
        path = table._lumenframe_path
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores added until no column of ``frames`` has that name in any case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bitmap_bits(n_keys: int, least: int = 1 << 22, most: int = 1 << 30, bits_per_key: int = 16) -> int:
    """Slots of a bitmap for ``n_keys`` keys: a power of two, at most ``most`` / 8 bytes."""
    return min(most, max(least, 1 << (bits_per_key * max(n_keys, 1) - 1).bit_length()))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that what is derived from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slot_bitmap(slots: DataFrame, bits: int) -> bytes:
    """Bitmap of the column ``slot`` (0 to bits - 1), brought to the driver.

    Its size is bits / 8 bytes whatever the number of rows: partial bitmaps are
    merged on the executors, 4096 bytes for each 32768 slots.
    """
    import numpy as np

    slot = F.col("slot") + F.lit(1)
    rows = (
        slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("piece"))
        .collect()
    )
    whole = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(r["piece"], np.uint8)
    return whole.tobytes()


def bounded_sample(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of ``key``; all of them if they are fewer.

    A first cut by the hash leaves about twice as many as are wanted, so what is sorted
    in one place does not grow with the rows.
    """
    n = rows.count()
    order = F.xxhash64(key, F.lit(seed))
    if n > 2 * most:
        rows = rows.filter(F.pmod(order, F.lit(1 << 40)) < F.lit(int(2 * most / n * (1 << 40))))
    return rows.orderBy(order, key).limit(most)
