"""Projections and filters on detection / cluster tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridweave.functions import geometry as G
from gridweave.functions import labels as L
from gridweave.functions.scores import threshold_literal, validate_threshold

from gridweave.constants import CELL_INPUT, DEFAULT_THRESHOLD, LAYOUT_INPUT, TABLE_SCALE  # noqa: E402,F401


def confidence_filter(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "score") -> DataFrame:
    """Keep detections with ``score > threshold`` (strict).

    The literal takes the score column's type, so a float32 score compares in
    float32; the predicate is a plain comparison and reaches the Parquet scan.
    """
    validate_threshold(threshold)
    return df.filter(F.col(score) > threshold_literal(threshold, df.schema[score].dataType))


def packed_fields(packed: DataFrame, row: str = "row", classified: bool = False) -> DataFrame:
    """Columns of a packed detector row ``[class, score, x0, y0, x1, y1]``."""
    r = F.col(row)
    cols = [c for c in packed.columns if c != row]
    out = [F.col(c) for c in cols]
    if classified:
        out.append(F.element_at(r, 1).cast("int").alias("class_id"))
    out.append(F.element_at(r, 2).alias("score"))
    out += [F.element_at(r, 3 + i).cast("float").alias(e) for i, e in enumerate(G.EDGES)]
    return packed.select(*out)


def scale_factors(images: DataFrame, input_edge: int = CELL_INPUT) -> DataFrame:
    """P5: ``(h / S, w / S)`` per image as ``h_ratio, w_ratio``."""
    s = F.lit(float(input_edge))
    return images.withColumn("h_ratio", F.col("height") / s).withColumn("w_ratio", F.col("width") / s)


def rescale_boxes(dets: DataFrame) -> DataFrame:
    """Model-space boxes to image pixels: x times ``w_ratio``, y times ``h_ratio``.

    float32 boxes times a ratio give float32 results, as float32 arithmetic.
    """
    wr = F.col("w_ratio").cast("float")
    hr = F.col("h_ratio").cast("float")
    return dets.withColumns({"l": F.col("l") * wr, "t": F.col("t") * hr, "r": F.col("r") * wr, "b": F.col("b") * hr})


def label_table_classes(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """``label`` from the table-class id (0 wired, 1 wireless)."""
    return df.withColumn("label", L.table_class_label(class_id))


def label_layout(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Layout class name and document label; unknown ids give nulls."""
    return df.withColumn("class_name", L.layout_class_label(class_id)).withColumn(
        "label", L.layout_doc_label(class_id)
    )


def drop_unknown_labels(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Drop detections whose class id has no document label.

    Kept rows keep their original ``det_idx`` as cluster id, so ids may have gaps.
    """
    return df.filter(L.layout_doc_label(class_id).isNotNull())


def observed_labels(df: DataFrame, class_id: str = "class_id") -> tuple[DataFrame, Observation]:
    """P11 with its counters: the kept rows, and an observation with ``kept`` and ``dropped``.

    The counters ride on whatever action reads the kept rows, so they cost no
    pass of their own; ``.get`` on the observation waits for that action.
    """
    known = L.layout_doc_label(class_id).isNotNull()
    seen = Observation("labels")
    counted = df.observe(seen, F.count_if(known).alias("kept"), F.count_if(~known).alias("dropped"))
    return drop_unknown_labels(counted, class_id), seen


def box_fault(edges: Sequence[str] = ("l", "t", "r", "b")) -> Column:
    """Why a box cannot be folded: ``missing``, ``not a number``, ``infinite`` or ``inverted``; null for a sound box."""
    l, t, r, b = (F.col(e).cast("double") for e in edges)
    some = lambda test: test(l) | test(t) | test(r) | test(b)
    return (
        F.when(some(lambda e: e.isNull()), F.lit("missing"))
        .when(some(F.isnan), F.lit("not a number"))
        .when(some(lambda e: F.abs(e) == float("inf")), F.lit("infinite"))
        .when((r < l) | (b < t), F.lit("inverted"))
    )


def split_boxes(df: DataFrame, edges: Sequence[str] = ("l", "t", "r", "b")) -> tuple[DataFrame, DataFrame]:
    """the rows with a sound box, and the others with a ``fault`` column; a row is in one of the two."""
    fault = box_fault(edges)
    return df.filter(fault.isNull()), df.filter(fault.isNotNull()).withColumn("fault", fault)


def to_page_clusters(
    dets: DataFrame,
    page_width: str = "width",
    page_height: str = "height",
    img_width: str = "img_width",
    img_height: str = "img_height",
) -> DataFrame:
    """P11 + P12: labelled clusters in page units, clamped to the page.

    ``x * (page_w / img_w)`` in float32, then ``min(max(x, 0), page_w)``.
    """
    sx = (F.col(page_width).cast("double") / F.col(img_width).cast("double")).cast("float")
    sy = (F.col(page_height).cast("double") / F.col(img_height).cast("double")).cast("float")
    pw = F.col(page_width).cast("float")
    ph = F.col(page_height).cast("float")
    zero = F.lit(0.0).cast("float")
    labelled = drop_unknown_labels(dets).withColumn("label", L.layout_doc_label("class_id"))
    return labelled.withColumns(
        {
            "l": G.clamp(F.col("l").cast("float") * sx, zero, pw),
            "t": G.clamp(F.col("t").cast("float") * sy, zero, ph),
            "r": G.clamp(F.col("r").cast("float") * sx, zero, pw),
            "b": G.clamp(F.col("b").cast("float") * sy, zero, ph),
        }
    )


def table_like(clusters: DataFrame, label: str = "label") -> DataFrame:
    """Clusters whose label carries a table (``table``, ``document_index``)."""
    return clusters.filter(F.col(label).isin(*L.TABLE_LIKE_LABELS))


def crop_windows(clusters: DataFrame, scale: float = TABLE_SCALE) -> DataFrame:
    """Pixel window of a cluster on the page rendered at ``scale``: ``round(edge * scale)``."""
    s = F.lit(float(scale))
    return clusters.withColumns(
        {
            "crop_top": G.half_even(F.col("t").cast("double") * s),
            "crop_bottom": G.half_even(F.col("b").cast("double") * s),
            "crop_left": G.half_even(F.col("l").cast("double") * s),
            "crop_right": G.half_even(F.col("r").cast("double") * s),
        }
    )


def image_check(images: DataFrame, channels: str = "nChannels", mode: str = "mode") -> DataFrame:
    """Flag images that are 3-channel 8-bit (OpenCV type 16, ``CV_8UC3``)."""
    return images.withColumn("is_valid_image", (F.col(channels) == 3) & (F.col(mode) == 16))


def resize_geometry(
    images: DataFrame, resize_short: int = 256, crop_size: int = 224, width: str = "width", height: str = "height"
) -> DataFrame:
    """Shorter edge to ``resize_short`` (half-even size), then a floor-centred crop."""
    short = F.least(F.col(width), F.col(height)).cast("double")
    scale = F.lit(float(resize_short)) / short
    new_w = G.half_even(F.col(width) * scale)
    new_h = G.half_even(F.col(height) * scale)
    return (
        images.withColumn("scale", scale)
        .withColumn("new_w", new_w)
        .withColumn("new_h", new_h)
        .withColumn("crop_top", F.floor((F.col("new_h") - crop_size) / 2).cast("int"))
        .withColumn("crop_left", F.floor((F.col("new_w") - crop_size) / 2).cast("int"))
    )


def top_detections(dets: DataFrame, k: int = 300, key: str | Sequence[str] = "image_id") -> DataFrame:
    """O3: the detector's fixed output slots: the ``k`` best detections per image.

    This is the detector's own cap (300 slots); it is a top-k feature, not a
    guard used elsewhere in the library.
    """
    from pyspark.sql import Window

    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("det_idx"))
    return dets.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def reading_order(dets: DataFrame, key: str | Sequence[str] = "image_id", bucket_width: float = 6400.0) -> DataFrame:
    """O1: 0-based rank in reading order ``l + 100 * t`` (ties by ``det_idx``), ranked by ranges."""
    from gridweave.operators.ranking import bucketed_row_number

    keys = [key] if isinstance(key, str) else list(key)
    k = G.reading_order_key()
    return bucketed_row_number(dets, keys, [k, F.col("det_idx")], F.floor(k / F.lit(bucket_width)), "reading_rank")
