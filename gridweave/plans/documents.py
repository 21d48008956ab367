"""Whole-document layout and table plans.

Pages, clusters, cells and text cells are tables keyed by ``page_id`` and
``(page_id, cluster_id)``; every "zip" of the per-object code becomes an
equi-join on those keys. A table crop's image key is ``(page_id, cluster_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.constants import LAYOUT_INPUT
from gridweave.operators import filters as P
from gridweave.operators import textmatch as T
from gridweave.operators.packed import ragged_split
from gridweave.plans.tables import Classifier, Detector, recognize_tables

CROP_KEY = ["page_id", "cluster_id"]


# --- layout (U8) -----------------------------------------------------------------

def layout_pages(pages: DataFrame) -> DataFrame:
    """S3: pages the layout model runs on: a valid backend and a rendered image."""
    return pages.filter(F.col("is_valid") & F.col("img_width").isNotNull())


def layout_clusters(
    pages: DataFrame, detector: Detector, threshold: float = P.DEFAULT_THRESHOLD
) -> DataFrame:
    """U8 core: detections of selected pages -> labelled clusters in page units.

    ``cluster_id`` is the detection's original index, so dropped unknown
    classes leave gaps (P11).
    """
    sel = layout_pages(pages)
    dets = P.confidence_filter(detector(sel), threshold)
    geo = sel.select("page_id", "width", "height", "img_width", "img_height")
    clusters = P.to_page_clusters(dets.join(geo, "page_id"))
    return clusters.select(
        "page_id",
        F.col("det_idx").alias("cluster_id"),
        "label",
        F.col("score").cast("double").alias("score"),
        *[F.col(e).cast("double").alias(e) for e in "ltrb"],
    )


def packed_layout(packed: DataFrame, counts: DataFrame, pages: DataFrame, threshold: float = P.DEFAULT_THRESHOLD,
                  input_edge: int = LAYOUT_INPUT) -> DataFrame:
    """P3-P6, W1 on packed layout rows: ``page_id, det_idx, class_id, score, l, t, r, b`` in image pixels.

    ``packed`` holds ``batch_id, pos, row`` with rows ``[class, score, x0, y0, x1, y1]`` in the
    model's space of ``input_edge`` pixels; ``counts`` holds ``batch_id, seq, page_id, cnt``. ``det_idx`` is
    the place among all rows of the page, kept or not. Pages without an image size give nothing.
    """
    split = ragged_split(packed.select("batch_id", "pos", "row"), counts.withColumnRenamed("page_id", "image_id"))
    fields = P.packed_fields(split.select(F.col("image_id").alias("page_id"), "det_idx", "row"), classified=True)
    kept = P.confidence_filter(fields, threshold)
    sizes = pages.select("page_id", F.col("img_width").alias("width"), F.col("img_height").alias("height")).filter("width IS NOT NULL")
    ratios = P.scale_factors(sizes, input_edge).select("page_id", "h_ratio", "w_ratio")
    return P.rescale_boxes(kept.join(ratios, "page_id")).drop("h_ratio", "w_ratio")


def merge_layout(pages: DataFrame, clusters: DataFrame, prior: DataFrame) -> DataFrame:
    """The clusters that stand after a run, new or earlier.

    Pages the model ran on have their new clusters (possibly none); the other pages of
    ``pages`` keep the rows of ``prior``, which has the columns of ``clusters``.
    """
    asked = pages.select("page_id", (F.col("is_valid") & F.col("img_width").isNotNull()).alias("_run")).distinct()
    kept = prior.join(asked.filter("NOT coalesce(_run, false)"), "page_id", "left_semi")
    return clusters.unionByName(kept.select(clusters.columns))


def layout_per_page(pages: DataFrame, clusters: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One layout result per page.

    A processed page takes its new clusters (possibly none); an unprocessed
    page keeps its earlier clusters, else an empty result. Returns
    ``(page_id, source, n_clusters)``; the clusters stay in their own table.
    """
    processed = layout_pages(pages).select("page_id", F.lit(True).alias("_p"))
    new_n = clusters.groupBy("page_id").agg(F.count(F.lit(1)).alias("_new"))
    out = pages.select("page_id").join(processed, "page_id", "left").join(new_n, "page_id", "left")
    if prior is not None:
        old_n = prior.groupBy("page_id").agg(F.count(F.lit(1)).alias("_old"))
        out = out.join(old_n, "page_id", "left")
    else:
        out = out.withColumn("_old", F.lit(None).cast("bigint"))
    is_new = F.col("_p").isNotNull()
    return out.select(
        "page_id",
        F.when(is_new, F.lit("new")).when(F.col("_old").isNotNull(), F.lit("prior")).otherwise(F.lit("empty")).alias("source"),
        F.when(is_new, F.coalesce("_new", F.lit(0))).otherwise(F.coalesce("_old", F.lit(0))).cast("bigint").alias("n_clusters"),
    )


# --- tables (U7, U9) ----------------------------------------------------------------

def table_pages(pages: DataFrame, with_layout: DataFrame) -> DataFrame:
    """Valid backend, size present, and a layout result present."""
    ok = pages.filter(F.col("is_valid") & F.col("width").isNotNull() & F.col("height").isNotNull())
    return ok.join(with_layout.select("page_id").distinct(), "page_id", "left_semi")


def table_clusters(pages: DataFrame, clusters: DataFrame, with_layout: DataFrame | None = None) -> DataFrame:
    """P13 + S4: table-like clusters on pages selected for table structure."""
    sel = table_pages(pages, clusters if with_layout is None else with_layout)
    return P.table_like(clusters).join(sel.select("page_id"), "page_id", "left_semi")


def cells_to_page(cells: DataFrame, clusters: DataFrame, scale: float = P.TABLE_SCALE) -> DataFrame:
    """P21 + P22: crop-pixel cells to page units (``edge / scale + cluster origin``) and offsets.

    float32 cell edges divided by the scale and shifted by the cluster origin
    stay float32, as in the per-object code.
    """
    s = F.lit(float(scale))
    org = clusters.select(*CROP_KEY, F.col("l").alias("_cl"), F.col("t").alias("_ct"))
    j = cells.join(org, CROP_KEY)

    def page(edge: str, origin: str):
        return ((F.col(edge).cast("double") / s).cast("float") + F.col(origin).cast("float")).cast("double")

    return j.select(
        *CROP_KEY,
        "det_idx",
        page("l", "_cl").alias("l"),
        page("t", "_ct").alias("t"),
        page("r", "_cl").alias("r"),
        page("b", "_ct").alias("b"),
        "row_span",
        "col_span",
        F.col("row").alias("start_row"),
        (F.col("row") + F.col("row_span")).alias("end_row"),
        F.col("col").alias("start_col"),
        (F.col("col") + F.col("col_span")).alias("end_col"),
        F.lit(False).alias("column_header"),
        F.lit(False).alias("row_header"),
        F.lit(False).alias("row_section"),
    )


def build_document_tables(
    page_cells: DataFrame,
    cluster_texts: DataFrame,
    page_words: DataFrame | None = None,
    overlap: float = T.DEFAULT_OVERLAP,
    tile: float | None = T.DEFAULT_TILE,
) -> DataFrame:
    """Page-unit cells with text: cluster text cells (J3 + A5), then page text for blank cells."""
    cells = page_cells.withColumnRenamed("start_row", "row").withColumnRenamed("start_col", "col")
    matched = T.match_texts(cells, cluster_texts, CROP_KEY, overlap, tile, text_id="text_idx")
    if page_words is not None:
        # page-wide lookup: words are keyed by page, a cell by (cluster, det_idx) within it
        m2 = matched.withColumn("_cell", F.struct("cluster_id", "det_idx")).drop("cluster_id", "det_idx")
        fb = T.with_fallback_text(m2, page_words, "page_id", T.BACKEND_OVERLAP, tile, cell_id="_cell", word_id="word_idx")
        matched = fb.select("*", F.col("_cell.cluster_id").alias("cluster_id"), F.col("_cell.det_idx").alias("det_idx")).drop("_cell")
    return matched.withColumnRenamed("row", "start_row").withColumnRenamed("col", "start_col")


def table_records(pages: DataFrame, shapes: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per table: ``page_id, page_no, cluster_id, label, num_rows, num_cols`` (and ``n_cells``)."""
    rows = shapes.join(pages.select("page_id", "page_no"), "page_id")
    out = ["page_id", "page_no", "cluster_id", "label", "num_rows", "num_cols"]
    if cells is None:
        return rows.select(*out)
    n = cells.groupBy(*CROP_KEY).agg(F.count(F.lit(1)).alias("n_cells"))
    return rows.join(n, CROP_KEY, "left").select(*out, F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def last_table_per_cluster(tables: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A4: when a cluster id repeats on a page, the last table written wins."""
    payload = [c for c in tables.columns if c not in CROP_KEY]
    g = tables.groupBy(*CROP_KEY).agg(F.max_by(F.struct(*payload), F.col(ordinal)).alias("_t"))
    return g.select(*CROP_KEY, *[F.col("_t." + c).alias(c) for c in payload])


def merge_tables(pages: DataFrame, tables: DataFrame, prior: DataFrame) -> DataFrame:
    """The tables of ``pages`` after a run: a new table replaces the earlier one of its cluster, other earlier ones stay."""
    both = prior.select(tables.columns).withColumn("_run", F.lit(0)).unionByName(tables.withColumn("_run", F.lit(1)))
    return last_table_per_cluster(both, "_run").drop("_run").join(pages.select("page_id"), "page_id", "left_semi")


def tables_per_page(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """One result per page; pages without tables give an empty (0) result."""
    n = tables.groupBy("page_id").agg(F.countDistinct("cluster_id").alias("n_tables"))
    return pages.select("page_id").join(n, "page_id", "left").select(
        "page_id", F.coalesce("n_tables", F.lit(0)).cast("bigint").alias("n_tables")
    )


def document_tables(
    pages: DataFrame,
    clusters: DataFrame,
    classifier: Classifier,
    detectors: Sequence[Detector],
    cluster_texts: DataFrame,
    page_words: DataFrame | None = None,
    threshold: float = P.DEFAULT_THRESHOLD,
    scale: float = P.TABLE_SCALE,
) -> tuple[DataFrame, DataFrame]:
    """``(table cells with text, table shapes)`` for every table cluster of the selected pages.

    Crops (P14) are the recognition input; their pixels are produced by the
    detector's own image join (see :mod:`gridweave.operators.pixels`).
    """
    crops = P.crop_windows(table_clusters(pages, clusters), scale)
    rec = recognize_tables(crops, classifier, detectors, threshold, key=CROP_KEY)
    page_cells = cells_to_page(rec.cells, clusters, scale)
    cells = build_document_tables(page_cells, cluster_texts, page_words)
    shapes = rec.shapes.drop("label", "model_idx").join(clusters.select(*CROP_KEY, "label"), CROP_KEY)
    return cells, shapes
