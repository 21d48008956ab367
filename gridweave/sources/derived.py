"""Box tables derived from the driver's TPC-H-style tables.

The driver tables hold no boxes, so boxes are computed from key columns with
integer arithmetic that Spark and an SQL oracle evaluate identically. Every
frame here grows with its source table; nothing is invented or sampled.

* ``detections``   cells from ``lineitem``; an image is 8 consecutive order keys
* ``text_cells``   text boxes from ``lineitem`` on the same images
* ``images``       image sizes from ``orders``
* ``class_scores`` two-class logits from ``embeddings``
* ``layout_detections`` / ``pages`` layout boxes from ``events``, 10 per page
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed fixture geometry of the layout pages (points, pixels).
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
PAGE_IMG_WIDTH, PAGE_IMG_HEIGHT = 893, 1263


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _image_of(order_key: str) -> F.Column:
    return F.floor(F.col(order_key) / 8).cast("bigint")


PARTS_OF_A_SPLIT = 16  # a scan split of 128 MB holds some millions of line items


def _lineitem_images(spark: SparkSession, sf_dir: str, *extra: str, only: DataFrame | None = None, most: bool = False) -> DataFrame:
    # image_id is projected before any window on it so that the window and a
    # later group-by on image_id share one hash exchange. ``only`` (a frame of
    # image ids) keeps whole images before the window, which is exact because
    # the window is partitioned by image. Where ``only`` may name most images
    # (``most``), line items are dealt in parts that follow the scan's splits, whatever the
    # session's shuffle partitions, and the ids are looked up by hash: one sort of a bounded part.
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", *extra
    )
    li = li.withColumn("image_id", _image_of("l_orderkey"))
    if only is not None:
        ids = only.select("image_id").distinct()
        if most:  # an inner join with distinct ids keeps the same rows; a semi join would move below the repartition
            li = li.repartition(PARTS_OF_A_SPLIT * li.rdd.getNumPartitions(), "image_id").join(ids.hint("shuffle_hash"), "image_id")
        else:
            li = li.join(ids, "image_id", "left_semi")
    w = Window.partitionBy("image_id").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return li.withColumn("det_idx", (F.row_number().over(w) - 1).cast("int"))


def detections(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, most: bool = False) -> DataFrame:
    """``(image_id, det_idx, l, t, r, b FLOAT, score DOUBLE)`` cell detections."""
    li = _lineitem_images(spark, sf_dir, only=only, most=most)
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0 = F.lit(150) * (sk % 4) + pk % 13
    y0 = F.lit(60) * (ln - 1) + pk % 14
    wide = F.when(sk % 5 == 0, 150).otherwise(0)
    tall = F.when(pk % 11 == 0, 60).otherwise(0)
    return li.select(
        "image_id",
        "det_idx",
        x0.cast(FloatType()).alias("l"),
        y0.cast(FloatType()).alias("t"),
        (x0 + 140 + wide).cast(FloatType()).alias("r"),
        (y0 + 55 + tall).cast(FloatType()).alias("b"),
        ((pk % 100).cast(DoubleType()) / 100).alias("score"),
    )


def text_cells(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """``(image_id, text_idx, text, l, t, r, b DOUBLE)`` text boxes; a third have zero area."""
    li = _lineitem_images(spark, sf_dir, "l_returnflag", "l_linestatus", only=only)
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0 = F.lit(150) * (sk % 4) + pk % 160
    y0 = F.lit(60) * (ln - 1) + pk % 50
    return li.select(
        "image_id",
        F.col("det_idx").alias("text_idx"),
        F.concat(F.lit(" "), "l_returnflag", "l_linestatus", ln.cast("string")).alias("text"),
        x0.cast(DoubleType()).alias("l"),
        y0.cast(DoubleType()).alias("t"),
        (x0 + (pk % 3) * 20).cast(DoubleType()).alias("r"),
        (y0 + 14).cast(DoubleType()).alias("b"),
    )


def page_words(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Fallback page text (J5): C2 boxes shifted by 7 px, text = ship year."""
    li = _lineitem_images(spark, sf_dir, "l_shipdate", only=only)
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0 = F.lit(150) * (sk % 4) + pk % 160 + 7
    y0 = F.lit(60) * (ln - 1) + pk % 50 + 7
    return li.select(
        "image_id",
        F.col("det_idx").alias("word_idx"),
        F.year("l_shipdate").cast("string").alias("text"),
        x0.cast(DoubleType()).alias("l"),
        y0.cast(DoubleType()).alias("t"),
        (x0 + 20 + (pk % 3) * 20).cast(DoubleType()).alias("r"),
        (y0 + 14).cast(DoubleType()).alias("b"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, width, height)`` from ``orders``: one image per 8 order keys."""
    o = read(spark, sf_dir, "orders").select(_image_of("o_orderkey").alias("image_id")).distinct()
    return o.select(
        "image_id",
        (F.lit(600) + F.col("image_id") % 400).cast("int").alias("width"),
        (F.lit(400) + F.col("image_id") % 300).cast("int").alias("height"),
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, scores ARRAY<FLOAT>)``: two-class logits per image.

    Image ``i`` takes the first two values of embedding ``i mod n``; ``n`` is
    a scalar subquery, so no cross join and no driver round trip.
    """
    emb = read(spark, sf_dir, "embeddings")
    n = emb.agg(F.count(F.lit(1))).scalar()
    imgs = images(spark, sf_dir).select("image_id", (F.col("image_id") % n).alias("vec_id"))
    e2 = emb.select("vec_id", F.slice("embedding", 1, 2).alias("scores"))
    return imgs.join(e2, "vec_id").select("image_id", "scores")


def layout_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, det_idx, class_id, score DOUBLE, l, t, r, b FLOAT)`` in image pixels."""
    ev = read(spark, sf_dir, "events").select("event_id", "user_id")
    e = F.col("event_id")
    x0 = (e * 13) % 950 - 20
    y0 = (e * 29) % 1250 - 20
    return ev.select(
        F.floor(e / 10).cast("bigint").alias("page_id"),
        (e % 10).cast("int").alias("det_idx"),
        ((e * 7 + F.col("user_id")) % 27).cast("int").alias("class_id"),
        ((e % 37).cast(DoubleType()) / 36).alias("score"),
        x0.cast(FloatType()).alias("l"),
        y0.cast(FloatType()).alias("t"),
        (x0 + 60 + e % 200).cast(FloatType()).alias("r"),
        (y0 + 30 + e % 90).cast(FloatType()).alias("b"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per 10 events: ``(page_id, page_no, width, height, img_width, img_height, is_valid)``.

    Every tenth page has an invalid backend; every seventh has no rendered
    image (``img_width`` null).
    """
    ev = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).cast("bigint").alias("page_id"))
    p = ev.distinct()
    no_image = F.col("page_id") % 7 == 3
    return p.select(
        "page_id",
        ((F.col("page_id") % 1000) + 1).cast("int").alias("page_no"),
        F.lit(PAGE_WIDTH).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height"),
        F.when(no_image, F.lit(None)).otherwise(F.lit(PAGE_IMG_WIDTH)).cast("int").alias("img_width"),
        F.when(no_image, F.lit(None)).otherwise(F.lit(PAGE_IMG_HEIGHT)).cast("int").alias("img_height"),
        (F.col("page_id") % 10 != 0).alias("is_valid"),
    )


# --- scorers backed by the derived tables --------------------------------------
# A classifier maps images to ``scores``; a detector maps images to detection
# rows. These join the derived tables on a source image id, so they stand in
# for model scorers wherever a plan takes one.

def crop_source_image() -> F.Column:
    """Source image of a table crop ``(page_id, cluster_id)``: its event id div 8."""
    return F.floor((F.col("page_id") * 10 + F.col("cluster_id")) / 8).cast("bigint")


def _src_ids(wanted: DataFrame) -> DataFrame:
    return wanted.select(F.col("_src").alias("image_id"))


def table_classifier(spark: SparkSession, sf_dir: str, keys=("image_id",), src: F.Column | None = None):
    def classify(imgs: DataFrame) -> DataFrame:
        s = src if src is not None else F.col(keys[0])
        want = imgs.select(*keys, s.alias("_src"))
        scores = class_scores(spark, sf_dir).withColumnRenamed("image_id", "_src")
        return want.join(scores, "_src").drop("_src")

    return classify


def cell_detector(spark: SparkSession, sf_dir: str, variant: int = 0, keys=("image_id",), src: F.Column | None = None):
    """Detector ``variant`` 0 (wired) reports the derived scores, 1 (wireless) ``1 - score``."""
    def detect(imgs: DataFrame) -> DataFrame:
        s = src if src is not None else F.col(keys[0])
        want = imgs.select(*keys, s.alias("_src"))
        dets = detections(spark, sf_dir, only=_src_ids(want), most=src is None).withColumnRenamed("image_id", "_src")
        if variant == 1:
            dets = dets.withColumn("score", F.lit(1.0) - F.col("score"))
        return want.join(dets, "_src").drop("_src")

    return detect


def layout_detector(spark: SparkSession, sf_dir: str):
    dets = layout_detections(spark, sf_dir)

    def detect(pgs: DataFrame) -> DataFrame:
        return dets.join(pgs.select("page_id"), "page_id", "left_semi")

    return detect


def cluster_text_cells(spark: SparkSession, sf_dir: str, clusters: DataFrame, scale: float = 2.0) -> DataFrame:
    """Text cells of each table cluster in page units: the crop's C2 texts / scale + cluster origin."""
    c = clusters.select("page_id", "cluster_id", crop_source_image().alias("_src"),
                        F.col("l").alias("_cl"), F.col("t").alias("_ct"))
    j = c.join(text_cells(spark, sf_dir, only=_src_ids(c)).withColumnRenamed("image_id", "_src"), "_src")
    s = F.lit(float(scale))
    return j.select(
        "page_id", "cluster_id", "text_idx", "text",
        (F.col("l") / s + F.col("_cl")).alias("l"), (F.col("t") / s + F.col("_ct")).alias("t"),
        (F.col("r") / s + F.col("_cl")).alias("r"), (F.col("b") / s + F.col("_ct")).alias("b"),
    )


def page_text_words(spark: SparkSession, sf_dir: str, clusters: DataFrame, scale: float = 2.0) -> DataFrame:
    """Page-wide words for the fallback lookup: shifted C2 words of every table cluster, in page units."""
    c = clusters.select("page_id", "cluster_id", crop_source_image().alias("_src"),
                        F.col("l").alias("_cl"), F.col("t").alias("_ct"))
    j = c.join(page_words(spark, sf_dir, only=_src_ids(c)).withColumnRenamed("image_id", "_src"), "_src")
    s = F.lit(float(scale))
    return j.select(
        "page_id",
        (F.col("cluster_id") * 1000 + F.col("word_idx")).cast("int").alias("word_idx"),
        "text",
        (F.col("l") / s + F.col("_cl")).alias("l"), (F.col("t") / s + F.col("_ct")).alias("t"),
        (F.col("r") / s + F.col("_cl")).alias("r"), (F.col("b") / s + F.col("_ct")).alias("b"),
    )


# --- page images and models of the pixel queries (inputs, not part of the library's work) ---------

def page_images(page_ids: DataFrame) -> DataFrame:
    """Pages rendered at scale 2 (1,190 x 1,684 pixels, image schema), each of one gray: ``page_id % 251``."""
    h, w = int(PAGE_HEIGHT * 2), int(PAGE_WIDTH * 2)
    schema = "page_id bigint, height int, width int, nChannels int, mode int, data binary"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, page in enumerate(b.column("page_id").to_pylist()):
                size = [pa.array([v], pa.int32()) for v in (h, w, 3, 16)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id").slice(i, 1), *size, pa.array([bytes([page % 251]) * (h * w * 3)], pa.binary())],
                    names=["page_id", "height", "width", "nChannels", "mode", "data"],
                )

    # A page is 6 MB of work but its id a few bytes, which a shuffle would gather in one task.
    n = 4 * page_ids.sparkSession.sparkContext.defaultParallelism
    return page_ids.select("page_id").repartition(n, "page_id").mapInArrow(run, schema)


def gray_classifier():
    """A stand-in model: class 1 where the crop's gray is odd, read back from the normalised tensor."""
    import numpy as np

    from gridweave.constants import CLS_MEAN, CLS_SCALE

    def run(x):
        gray = np.rint(x[:, 0].mean(axis=(1, 2), dtype=np.float64) / CLS_SCALE[0] + CLS_MEAN[0]).astype(int)
        return np.stack([1 - gray % 2, gray % 2], axis=1).astype(np.float32)

    return run


def gray_detector():
    """A stand-in model: ``2 + gray % 4`` rows by ``1 + gray % 3`` columns over the whole crop; scores of every fifth cell are 0.25."""
    import numpy as np

    def run(x):
        s, rows, counts = x.shape[2], [], []
        for gray in np.rint(x.mean(axis=(1, 2, 3), dtype=np.float64) * 255).astype(int).tolist():
            k, c = 2 + gray % 4, 1 + gray % 3
            rows += [[0, 0.25 if (i * c + j) % 5 == 4 else 0.75, j * s / c, i * s / k, (j + 1) * s / c, (i + 1) * s / k] for i in range(k) for j in range(c)]
            counts.append(k * c)
        return np.array(rows, np.float32).reshape(-1, 6), np.array(counts)

    return run


def mean_channel_classifier():
    """Logits ``[mean of channel 0, mean of channel 2]``: a deterministic two-class model."""

    import numpy as np

    def run(x):
        return np.stack([x[:, 0].mean(axis=(1, 2)), x[:, 2].mean(axis=(1, 2))], axis=1).astype(np.float32)

    return run


ORDER_ERROR = 5e-5  # by which float32 means of an image's pixels may differ with the order of the additions


def grid_detector(columns: int = 3, invert: bool = False):
    """A detector emitting a grid of cells whose row count and scores depend on the pixels.

    The pixels are read once: the strips between all edges that a grid of 3 to 8 rows may have are summed,
    and every mean follows from their sums. Where the order of the additions may decide (a mean of the image by
    the next row count, a mean of a cell by 0, 0.5 or 1) the mean of the pixels themselves is taken.
    """

    import numpy as np

    def factory():
        def run(x):
            s = x.shape[2]
            edges = {k: [int(rr * s / k) for rr in range(k + 1)] for k in range(3, 9)}
            cuts = sorted({y for ys in edges.values() for y in ys})
            xs = [int(cc * s / columns) for cc in range(columns + 1)]
            rows, counts = [], []
            for image in x:
                strips = np.stack([np.add.reduce(image[:, y0:y1], axis=1) for y0, y1 in zip(cuts, cuts[1:])])
                strips = np.add.reduceat(strips.sum(axis=1, dtype=np.float64), xs[:-1], axis=1)
                above = np.concatenate([np.zeros((1, columns)), np.cumsum(strips, axis=0)])
                mean = above[-1].sum() / image.size
                if abs(mean * 1000 - round(mean * 1000)) < 1000 * ORDER_ERROR:
                    mean = image.mean()
                k = 3 + int(mean * 1000) % 6
                ys = edges[k]
                sums = np.diff(above[[cuts.index(y) for y in ys]], axis=0)
                means = (sums / np.outer(np.diff(ys), len(image) * np.diff(xs))).tolist()
                for rr in range(k):
                    for cc in range(columns):
                        m = means[rr][cc]
                        if abs(2 * m - round(2 * m)) < 2 * ORDER_ERROR:
                            m = float(image[:, ys[rr] : ys[rr + 1], xs[cc] : xs[cc + 1]].mean())
                        score = m if not invert else 1.0 - m
                        rows.append([0, score, cc * s / columns, rr * s / k, (cc + 1) * s / columns, (rr + 1) * s / k])
                counts.append(k * columns)
            return np.asarray(rows, np.float32).reshape(-1, 6), np.asarray(counts)

        return run

    return factory
