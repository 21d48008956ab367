"""Overlay rows: what a debug drawing would draw, as data.

Pixel drawing itself is a desktop concern; these projections produce the
rectangles and labels (with the reference's rounding and label formats) so
any renderer, or a check, can consume them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions import labels as L
from gridweave.functions.geometry import half_even
from gridweave.functions.text import cell_label, page_file_name


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def overlay_table(cells: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """Per cell a half-even rectangle and ``"R,C : RS,CS"`` at ``(l, t + 10)``."""
    keys = _keys(key)
    return cells.select(
        *keys,
        "det_idx",
        half_even("l").alias("x0"),
        half_even("t").alias("y0"),
        half_even("r").alias("x1"),
        half_even("b").alias("y1"),
        cell_label("row", "col", "row_span", "col_span").alias("label"),
        half_even("l").alias("label_x"),
        (half_even("t") + 10).alias("label_y"),
    )


def overlay_detections(dets: DataFrame, key: str | Sequence[str] = "image_id", classified: bool = True) -> DataFrame:
    """Per detection a half-even rectangle; the class name when the detection has a class."""
    keys = _keys(key)
    label = L.layout_class_label("class_id") if classified else F.lit(None).cast("string")
    return dets.select(
        *keys,
        "det_idx",
        half_even("l").alias("x0"),
        half_even("t").alias("y0"),
        half_even("r").alias("x1"),
        half_even("b").alias("y1"),
        label.alias("label"),
        half_even("l").alias("label_x"),
        (half_even("t") + 10).alias("label_y"),
    )


def overlay_page(
    pages: DataFrame, clusters: DataFrame, cluster_texts: DataFrame, table_cells: DataFrame
) -> DataFrame:
    """P25: page overlay rows: clusters (red), their text cells (green), table cells (blue).

    Page units go to image pixels by ``img_width / width`` and ``img_height /
    height``. Cells get ``"row, col"`` at ``(x0 + 3, y0 + 3)`` and line
    width 3 for column headers, else 1. ``file`` is the page's image name.
    """
    geo = pages.select(
        "page_id",
        (F.col("img_width") / F.col("width")).alias("_sx"),
        (F.col("img_height") / F.col("height")).alias("_sy"),
        page_file_name("page_no").alias("file"),
    )

    def px(df: DataFrame, kind: str, color: str, width, label, item: str) -> DataFrame:
        j = df.join(geo, "page_id")
        x0 = F.col("l") * F.col("_sx")
        y0 = F.col("t") * F.col("_sy")
        return j.select(
            "page_id",
            "file",
            F.lit(kind).alias("kind"),
            "cluster_id",
            F.col(item).cast("int").alias("item"),
            F.lit(color).alias("color"),
            width.cast("int").alias("width"),
            x0.alias("x0"),
            y0.alias("y0"),
            (F.col("r") * F.col("_sx")).alias("x1"),
            (F.col("b") * F.col("_sy")).alias("y1"),
            label.alias("label"),
            F.when(label.isNotNull(), x0 + 3).alias("label_x"),
            F.when(label.isNotNull(), y0 + 3).alias("label_y"),
        )

    none = F.lit(None).cast("string")
    red = px(clusters.withColumn("_i", F.lit(-1)), "cluster", "red", F.lit(1), none, "_i")
    green = px(cluster_texts, "text", "green", F.lit(1), none, "text_idx")
    blue = px(
        table_cells,
        "cell",
        "blue",
        F.when(F.col("column_header"), 3).otherwise(1),
        cell_label("start_row", "start_col"),
        "det_idx",
    )
    return red.unionByName(green).unionByName(blue)
