"""File sources and sinks.

All readers are Spark data sources; nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.geometry import reading_order_key

CV_8UC3 = 16  # OpenCV type of 8-bit, 3-channel images in Spark's image source


# --- S1 / S2: images ----------------------------------------------------------

def read_images(spark: SparkSession, path: str, strict: bool = True, recursive: bool = False) -> DataFrame:
    """Image files as ``(image_id, origin, height, width, nChannels, mode, data)``.

    Bytes are BGR, row-major. ``strict`` mirrors ``imread`` raising on a
    file it cannot decode: the query fails when it meets such a row
    (``raise_error`` is evaluated in the executor, no driver pass; it stands
    in a filter, so no choice of columns prunes it). With
    ``strict=False`` undecodable files are dropped.
    """
    reader = spark.read.format("image").option("dropInvalid", not strict)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.load(path).select("image.*")
    if strict:
        broken = F.raise_error(F.concat(F.lit("cannot decode image: "), F.col("origin"))).cast("boolean")
        df = df.filter(F.when(F.col("width") < 0, broken).otherwise(F.lit(True)))
    return df.withColumn("image_id", F.xxhash64("origin"))


def image_properties(images: DataFrame) -> DataFrame:
    """The logged image properties, one row per image."""
    return images.select(
        "image_id",
        "origin",
        "width",
        "height",
        F.col("nChannels").alias("channels"),
        F.when(F.col("mode") == CV_8UC3, F.lit("uint8")).otherwise(F.lit("other")).alias("dtype"),
    )


# --- S5 / S6: golden JSON -------------------------------------------------------

def read_golden(spark: SparkSession, path: str, key: str = "detection") -> DataFrame:
    """Detections of one key of a golden JSON file, with their stored rank."""
    g = spark.read.option("multiLine", True).json(path)
    return g.select(F.posexplode(key).alias("rank", "d")).select(
        F.col("rank").cast("int"),
        *[F.col("d.bbox." + e).cast("double").alias(e) for e in "ltrb"],
        F.col("d.confidence").cast("double").alias("score"),
    )


def read_golden_class(spark: SparkSession, path: str) -> DataFrame:
    """The classification of a golden JSON file, ``(class, confidence)``."""
    g = spark.read.option("multiLine", True).schema("classification struct<class:string,confidence:double>").json(path)
    return g.select("classification.*")


def golden_records(dets: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """Per image, detections in reading order, box rounded half to even to 2 places, score to 4."""
    keys = [key] if isinstance(key, str) else list(key)
    rec = F.struct(
        reading_order_key().alias("_o"),
        F.col("det_idx").alias("_i"),
        F.struct(*[F.bround(F.col(e).cast("double"), 2).alias(e) for e in "ltrb"]).alias("bbox"),
        F.bround(F.col("score").cast("double"), 4).alias("confidence"),
    )
    g = dets.groupBy(*keys).agg(F.sort_array(F.collect_list(rec)).alias("_r"))
    return g.select(*keys, F.transform("_r", lambda x: F.struct(x["bbox"].alias("bbox"), x["confidence"].alias("confidence"))).alias("detection"))


def write_golden(records: DataFrame, path: str) -> None:
    """S6 sink: one JSON object per image."""
    records.write.mode("overwrite").json(path)


# --- S7: Markdown text --------------------------------------------------------------

def write_markdown(md: DataFrame, path: str, key: str = "image_id") -> None:
    """S7 sink: one text file per table (partitioned by key)."""
    md.select(key, "markdown").write.mode("overwrite").partitionBy(key).text(path)


def read_markdown(spark: SparkSession, path: str, key: str = "image_id") -> DataFrame:
    """S7 source: whole files back as ``(key, markdown)`` (the writer's newline removed)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col(key).cast("bigint").alias(key), F.regexp_replace("value", "\n$", "").alias("markdown"))


# --- S8: page -> table map -----------------------------------------------------------

def write_table_map(tables: DataFrame, path: str, document: str = "doc_id") -> None:
    """Table rows as Parquet, a partition for each document; documents that ``tables`` does not hold stay as they are."""
    spread = tables.repartition(document)  # a document's rows go to few files
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(document).parquet(path)


def read_table_map(spark: SparkSession, path: str) -> DataFrame:
    """The table rows of all documents, as last written."""
    return spark.read.parquet(path)


def table_map_column(tables: DataFrame, page: str = "page_id", cluster: str = "cluster_id") -> DataFrame:
    """S8 map form: ``(page, MAP<cluster_id, STRUCT>)`` per page."""
    payload = [c for c in tables.columns if c not in (page, cluster)]
    return tables.groupBy(page).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(cluster), F.struct(*payload)))).alias("table_map")
    )
