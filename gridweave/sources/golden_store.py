"""Golden records under several keys for each image, updated key by key.

A golden object of an image holds its ``classification`` and any number of
named detection lists. The store keeps one row per image and key as JSON, in
folders ``buckets=N/list=<key>/bucket=<hash of the image>``:

* an update of one key for some images rewrites only the folders of that key
  and of those images' buckets (dynamic partition overwrite); every other key,
  and the other images of a rewritten folder, stay as they are;
* keys are values, so a new key needs no change of schema;
* ``golden_objects`` assembles one object per image on reading.

An image has one record for a key by definition, so gathering its detections into
one array is bounded by the image. ``buckets`` is fixed when a store is made and
read from it later; choose it so that a key's images over ``buckets`` suit one
task. Images without detections have no record of that key; a null image id
is an id like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import shared_folder
from gridweave.sources.files import golden_records

CLASSIFICATION = "classification"
CLASS_TYPE = "struct<class:string,confidence:double>"
LIST_TYPE = "array<struct<bbox:struct<l:double,t:double,r:double,b:double>,confidence:double>>"
ROW = f"image_id bigint, detection {LIST_TYPE}, classification {CLASS_TYPE}, buckets int, list string, bucket int"


def golden_rows(lists: Mapping[str, DataFrame], classes: DataFrame | None = None) -> DataFrame:
    """``image_id, list, detection, classification``: a row for each image and key.

    ``lists`` maps a key to detections (``image_id, det_idx, score, l, t, r, b``).
    ``classes`` (``image_id, label, score``) goes under ``classification``; of several
    rows for an image the highest score counts, of equal ones the greater label.
    """
    if CLASSIFICATION in lists:
        raise ValueError(f"{CLASSIFICATION} is the key of the classes, not of a detection list")
    parts = [
        golden_records(dets).select(
            F.col("image_id").cast("bigint").alias("image_id"), F.lit(name).alias("list"),
            F.col("detection").cast(LIST_TYPE).alias("detection"), F.lit(None).cast(CLASS_TYPE).alias(CLASSIFICATION),
        )
        for name, dets in lists.items()
    ]
    if classes is not None:
        score = F.bround(F.col("score").cast("double"), 4)
        best = classes.groupBy("image_id").agg(F.max(F.struct(score.alias("confidence"), F.col("label").alias("class"))).alias("c"))
        parts.append(
            best.select(
                F.col("image_id").cast("bigint").alias("image_id"), F.lit(CLASSIFICATION).alias("list"),
                F.lit(None).cast(LIST_TYPE).alias("detection"),
                F.struct(F.col("c.class"), F.col("c.confidence")).cast(CLASS_TYPE).alias(CLASSIFICATION),
            )
        )
    if not parts:
        raise ValueError("a golden store needs at least one key")
    return reduce(DataFrame.unionByName, parts)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("buckets", F.lit(buckets)).withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, mode: str) -> None:
    out = rows.repartition("list", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
    out.partitionBy("buckets", "list", "bucket").json(path)


def write_golden_store(path: str, lists: Mapping[str, DataFrame], classes: DataFrame | None = None, buckets: int = 16) -> None:
    """A new store at ``path``, replacing whatever stands there."""
    _write(_bucketed(golden_rows(lists, classes), buckets), path, "static")


def read_golden_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store (``image_id, detection, classification, buckets, list, bucket``)."""
    return spark.read.schema(ROW).json(path)


def update_golden_store(spark: SparkSession, path: str, lists: Mapping[str, DataFrame], classes: DataFrame | None = None) -> None:
    """Replace the records of the given keys for the images that the frames hold; everything else stays.

    The new state of the touched folders is staged in the shared folder before
    any of them is overwritten, so a lost executor never reads a folder that is already half rewritten.
    """
    stored = read_golden_store(spark, path)
    buckets = stored.select("buckets").first()
    if buckets is None:
        raise ValueError(f"no golden store at {path}")
    new = _staged(_bucketed(golden_rows(lists, classes), buckets[0]), "golden-new")
    touched = new.select("list", "bucket").distinct()  # at most keys x buckets rows
    both = stored.join(touched, ["list", "bucket"], "left_semi").withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    last = both.groupBy("buckets", "list", "bucket", "image_id").agg(F.max_by(F.struct("detection", CLASSIFICATION), "gen").alias("v"))
    _write(_staged(last.select("image_id", "v.*", "buckets", "list", "bucket"), "golden-merged"), path, "dynamic")


def _staged(df: DataFrame, tag: str) -> DataFrame:
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def golden_objects(store: DataFrame, names: Sequence[str]) -> DataFrame:
    """One golden object per image: ``image_id, classification`` and a column for each of the list keys ``names``."""
    one = [F.first(F.when(F.col("list") == n, F.col("detection")), ignorenulls=True).alias(n) for n in names]
    return store.groupBy("image_id").agg(F.first(CLASSIFICATION, ignorenulls=True).alias(CLASSIFICATION), *one)


def object_detections(objects: DataFrame, name: str) -> DataFrame:
    """The flat detections of one list of golden objects, with rank in the list and the object's class."""
    d = objects.select("image_id", CLASSIFICATION, F.posexplode(F.col(f"`{name}`")).alias("rank", "d"))
    return d.select(
        "image_id", F.lit(name).alias("list"), F.col("rank").cast("int").alias("rank"),
        *[F.col("d.bbox." + e).alias(e) for e in "ltrb"], F.col("d.confidence").alias("confidence"),
        F.col("classification.class").alias("class"), F.col("classification.confidence").alias("class_confidence"),
    )
