"""Views that present the star-schema tables as an annotated image dataset.

Only integer arithmetic and literal scales are used, so any SQL engine derives the
same rows: orders become images, line items become boxes, and embeddings become
8 x 8 tiles of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = (".jpg", ".png", ".jpeg", ".bmp", ".tif", ".webp", ".JPG")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, image_id, image_path, dataset, width, height, split."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    suffix = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (key % 7 + 1).cast("int"))
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        F.concat(F.lit("img_"), (key % 9973).cast("string")).alias("image_id"),
        F.concat(F.col("o_orderpriority"), F.lit("/img_"), (key % 9973).cast("string"), suffix).alias("image_path"),
        F.col("o_orderpriority").alias("dataset"),
        (customer % 13 * 100).cast("int").alias("width"),
        (customer % 11 * 80).cast("int").alias("height"),
        split.alias("split"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, object_index, class_id, class_name, xc, yc, w, h, confidence, area.

    Line items of an order are numbered by a total order of their columns.
    """
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    flag = F.concat("l_returnflag", "l_linestatus")
    class_id = F.when(flag == "AF", 0).when(flag == "NF", 1).when(flag == "NO", 3).when(flag == "RF", 7).when(flag == "AO", -1).otherwise(12)
    class_name = F.when(flag == "RO", "").otherwise(F.concat(F.lit("cell-"), flag))
    part, supplier, quantity = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"),
        (F.row_number().over(order) - 1).alias("object_index"),
        class_id.cast("int").alias("class_id"),
        class_name.alias("class_name"),
        (part % 1050 / F.lit(1000.0)).alias("xc"),
        (supplier % 104 / F.lit(100.0)).alias("yc"),
        (quantity % 50 / F.lit(64.0)).alias("w"),
        (part % 33 / F.lit(32.0)).alias("h"),
        F.round(F.col("l_discount") * 12, 2).alias("confidence"),
        F.lit(0.0).alias("area"),
    )


def nested(images_df: DataFrame, boxes_df: DataFrame) -> DataFrame:
    """Images with their boxes as an ordered array; images without boxes get an empty one."""
    fields = [c for c in boxes_df.columns if c != "seq"]
    grouped = boxes_df.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("objects"))
    empty = F.array().cast(grouped.schema["objects"].dataType)
    return images_df.join(grouped, "seq", "left").withColumn("objects", F.coalesce("objects", empty))


def class_dim(spark: SparkSession) -> DataFrame:
    rows = [(0, "erythrocyte"), (1, "leukocyte"), (3, "parasite")]
    return spark.createDataFrame(rows, "class_id int, label string")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and 64 pixels (0 to 255) of each embedding."""
    level = F.transform(
        "embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 256).cast("int")))
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", level.alias("pixels"))


def _planted(number: Column, value: Column, **cases) -> Column:
    """``value``, but for rows of some numbers (``at_3=...``) a planted one."""
    out = None
    for name, planted in cases.items():
        hit = number == int(name.removeprefix("at_"))
        planted = F.lit(planted)
        out = F.when(hit, planted) if out is None else out.when(hit, planted)
    return out.otherwise(value)


def planted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with every defect that the rules look for, and what a file scan would say of each."""
    k = F.col("seq") % 97
    c = F.col
    return images(spark, sf_dir).select(
        "seq",
        _planted(k, c("image_id"), at_9=None, at_10="").alias("image_id"),
        _planted(
            k, c("image_path"), at_1=None, at_2="", at_3="/data/x/Same.JPG", at_4="/data/./x//same.jpg", at_17="/data/y/../x/same.jpg", at_18="odd.gif"
        ).alias("image_path"),
        _planted(k, c("dataset"), at_11=None, at_12=" ", at_19="").alias("dataset"),
        _planted(k, c("width"), at_5=None, at_6=0, at_7=-5, at_20=None).cast("int").alias("width"),
        _planted(k, c("height"), at_8=None, at_20=-1, at_21=20000).cast("int").alias("height"),
        "split",
        (k != 13).alias("file_found"),
        _planted(k, c("seq") + 1000, at_14=0).cast("long").alias("file_length"),
        _planted(k, F.lit(64), at_15=-1, at_13=-1).cast("int").alias("decoded_width"),
        _planted(k, F.lit(48), at_15=-1, at_16=0).cast("int").alias("decoded_height"),
    )


def planted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with every defect that the rules look for, and their raw JSON tokens."""
    j = (F.col("seq") * 7 + F.col("object_index")) % 89
    c = F.col
    same = dict.fromkeys(("at_18", "at_25", "at_32", "at_19"), 0.5)
    sides = dict.fromkeys(("at_18", "at_25", "at_32", "at_19"), 0.25)
    return boxes(spark, sf_dir).select(
        "seq",
        "object_index",
        _planted(j, c("class_id"), at_1=None, at_2=99, at_18=0, at_25=0, at_32=0, at_19=0).cast("int").alias("class_id"),
        _planted(j, c("class_name"), at_3=None, at_4="").alias("class_name"),
        _planted(j, c("xc"), at_5=None, at_6=1.2, at_7=-0.1, **same).alias("xc"),
        _planted(j, c("yc"), at_8=1.5, at_21=None, **same).alias("yc"),
        _planted(j, c("w"), at_9=0.0, at_10=-0.2, at_11=1.4, at_22=None, **sides).alias("w"),
        _planted(j, c("h"), at_12=0.0, at_13=-0.3, at_14=None, **sides).alias("h"),
        _planted(j, c("confidence"), at_15=1.5, at_16=None, at_17=-0.5).alias("confidence"),
        _planted(j, F.concat_ws("-", "seq", "object_index"), at_40="same", at_41=None).alias("object_id"),
        _planted(j, F.lit("0.5"), at_50='"high"', at_51="null", at_52="true", at_53=None, at_54="1e-1").alias("confidence_raw"),
        _planted(
            j, F.lit("[1, 2.5, 3, 4]"), at_55=None, at_56='"1 2 3 4"', at_57="[1, 2, 3]", at_58='[1, "2", 3, 4]', at_59="[]", at_60="[1, true, 3, 4]", at_61="7"
        ).alias("bbox_raw"),
    )


def color_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of three channels: the levels, the levels backwards, and the levels stretched around."""
    p = F.col("pixels")
    red = F.transform(p, lambda x: (x * 3 + 40) % 256)
    triples = F.transform(F.arrays_zip(p.alias("b"), F.reverse(p).alias("g"), red.alias("r")), lambda z: F.array(z["b"], z["g"], z["r"]))
    return tiles(spark, sf_dir).select("vec_id", "label", F.flatten(triples).alias("pixels"))
