"""Registered queries for images, pixel jobs and scorers.

Images are derived by Spark from the ``orders`` keys (and page images from
``events``), so every query grows with its table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import filters as P
from gridweave.operators import pagescoring as PG
from gridweave.operators import pixels as PX
from gridweave.operators import scoring as SC
from gridweave.plans import documents as DOC
from gridweave.plans import oracle as O
from gridweave.plans.queries import register
from gridweave.plans.queries_docs import LAYOUT_BASE, TCL_SQL, _clusters
from gridweave.plans.tables import recognize_tables
from gridweave.session import materialize
from gridweave.sources import derived as D
from gridweave.sources import files as FS


def _images(spark, sf_dir):
    return PX.derived_images(D.images(spark, sf_dir).select("image_id"))


@register(
    "image_inventory",
    O.with_(O.IMAGES)
    + """SELECT image_id, printf('derived:%d', image_id) AS origin, CAST(32 + image_id % 24 AS INTEGER) AS width,
  CAST(24 + image_id % 16 AS INTEGER) AS height, 3 AS channels, 'uint8' AS dtype FROM imgs""",
)
def q_image_inventory(spark, sf_dir):
    """S2 + P15: image properties of every image."""
    return FS.image_properties(P.image_check(_images(spark, sf_dir)).filter("is_valid_image"))


@register("pixel_tensors")
def q_pixel_tensors(spark, sf_dir):
    """P16 + P17: classifier tensors (3 x 224 x 224) of every image, summarised per image."""
    return PX.classification_tensors(_images(spark, sf_dir), summarize=True)


@register("detection_tensors")
def q_detection_tensors(spark, sf_dir):
    """P18 + P19: cell-detector tensors (3 x 640 x 640) with the channel swap, summarised per image."""
    return PX.detection_tensors(_images(spark, sf_dir), size=PX.CELL_INPUT, swap_rb=True, summarize=True)


@register("score_stub")
def q_score_stub(spark, sf_dir):
    """U1-U5 with stand-in models at 224 and 640 pixels: classify, route to the wired / wireless detector, build tables."""
    cl = SC.classifier(D.mean_channel_classifier, batch_size=16)
    dets = [SC.detector(D.grid_detector(3)), SC.detector(D.grid_detector(4, invert=True))]
    rec = recognize_tables(_images(spark, sf_dir), cl, dets)
    return rec.shapes.select("image_id", "model_idx", "label", "num_rows", "num_cols")


@register(
    "crop_pixels",
    O.with_(*LAYOUT_BASE, TCL_SQL, """crop AS (
  SELECT page_id, cluster_id, CAST(greatest(round_even(b * 2.0, 0) - round_even(t * 2.0, 0), 0) AS INTEGER) AS height,
    CAST(greatest(round_even(r * 2.0, 0) - round_even(l * 2.0, 0), 0) AS INTEGER) AS width
  FROM tcl
)""")
    + "SELECT page_id, cluster_id, height, width, height * width * 3 AS n_bytes, printf('%02x', page_id % 251) AS first_byte FROM crop WHERE height * width > 0",
)
def q_crop_pixels(spark, sf_dir):
    """P14 + P19 + P20: table windows cut from page images rendered at scale 2; windows without pixels are left out."""
    windows = materialize(P.crop_windows(DOC.table_clusters(D.pages(spark, sf_dir), _clusters(spark, sf_dir))))
    crops = PX.crop_pixels(D.page_images(windows.select("page_id").distinct()), windows).filter("height * width > 0")
    first = F.lower(F.hex(F.expr("substring(data, 1, 1)"))).alias("first_byte")
    return crops.select("page_id", "cluster_id", "height", "width", F.length("data").alias("n_bytes"), first)


PIXEL_TABLES_SQL = O.with_(
    *LAYOUT_BASE, TCL_SQL,
    """crop AS (
  SELECT page_id, cluster_id, CAST(page_id % 251 AS INTEGER) AS gray, CAST(round_even(b * 2.0, 0) - round_even(t * 2.0, 0) AS INTEGER) AS h,
    CAST(round_even(r * 2.0, 0) - round_even(l * 2.0, 0) AS INTEGER) AS w
  FROM tcl
)""",
    """slot AS (
  SELECT c.*, 2 + gray % 4 AS k, 1 + gray % 3 AS n, CAST(unnest(range((2 + gray % 4) * (1 + gray % 3))) AS INTEGER) AS det_idx FROM crop c WHERE h > 0 AND w > 0
)""",
    """det AS (
  SELECT page_id * 100 + cluster_id AS image_id, det_idx,
    CAST((det_idx % n) * 640.0 / n AS FLOAT) * CAST(w / CAST(640 AS DOUBLE) AS FLOAT) AS l, CAST((det_idx // n) * 640.0 / k AS FLOAT) * CAST(h / CAST(640 AS DOUBLE) AS FLOAT) AS t,
    CAST((det_idx % n + 1) * 640.0 / n AS FLOAT) * CAST(w / CAST(640 AS DOUBLE) AS FLOAT) AS r, CAST((det_idx // n + 1) * 640.0 / k AS FLOAT) * CAST(h / CAST(640 AS DOUBLE) AS FLOAT) AS b
  FROM slot WHERE det_idx % 5 <> 4
)""",
    *O.structure_ctes(), recursive=True,
)


@register(
    "pixel_document_tables",
    PIXEL_TABLES_SQL
    + """, shp AS (SELECT DISTINCT image_id, num_rows, num_cols FROM cells), cnt AS (SELECT image_id, count(*) AS n_cells FROM cells GROUP BY image_id)
SELECT c.page_id, c.cluster_id, c.h AS crop_height, c.w AS crop_width, c.gray % 2 AS model_idx, s.num_rows, s.num_cols, CAST(n.n_cells AS BIGINT) AS n_cells
FROM crop c JOIN shp s ON s.image_id = c.page_id * 100 + c.cluster_id JOIN cnt n USING (image_id)""",
)
def q_pixel_document_tables(spark, sf_dir):
    """U7 with pixels: windows cut at scale 2 from page images, classified at 224, detected at 640, routed by class and folded."""
    pages = D.pages(spark, sf_dir)
    crops = materialize(P.crop_windows(DOC.table_clusters(pages, _clusters(spark, sf_dir))))
    scored = materialize(PG.score_crops(D.page_images(crops.select("page_id").distinct()), crops, D.gray_classifier, [D.gray_detector, D.gray_detector]))
    classifier, detectors = PG.as_scorers(scored, 2)
    rec = recognize_tables(crops, classifier, detectors, key=DOC.CROP_KEY)
    cells = rec.cells.groupBy(*DOC.CROP_KEY).agg(F.count(F.lit(1)).alias("n_cells"))
    size = [(F.col("crop_bottom") - F.col("crop_top")).cast("int").alias("crop_height"), (F.col("crop_right") - F.col("crop_left")).cast("int").alias("crop_width")]
    out = rec.shapes.join(cells, DOC.CROP_KEY).join(crops.select(*DOC.CROP_KEY, *size), DOC.CROP_KEY)
    return out.select(*DOC.CROP_KEY, "crop_height", "crop_width", "model_idx", "num_rows", "num_cols", "n_cells")
