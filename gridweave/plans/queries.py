"""Registered queries: one per operator (group) of the inventory.

Each query is ``(spark, sf_dir) -> DataFrame`` over the driver tables, and
``ORACLE[name]`` is the matching SQL. Column names and types agree between
the two so that a row hash compares them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions import geometry as G
from gridweave.operators import classify as C
from gridweave.operators import packed as PK
from gridweave.plans import tables as R

from gridweave.operators import filters as P
from gridweave.operators import structure as S
from gridweave.plans import oracle as O
from gridweave.session import materialize
from gridweave.sources import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def kept_detections(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    return P.confidence_filter(D.detections(spark, sf_dir), threshold)


# --- P1 ---------------------------------------------------------------------

@register(
    "confidence_filter",
    O.with_(O.LI_IMAGES, O.DET)
    + "SELECT image_id, det_idx, CAST(score AS DOUBLE) AS score FROM det_all WHERE score > 0.5",
)
def q_confidence_filter(spark, sf_dir):
    return kept_detections(spark, sf_dir).select("image_id", "det_idx", "score")


# --- W11 + A3 + A6: flagship ----------------------------------------------------

@register(
    "table_structure",
    O.with_(O.LI_IMAGES, O.DET, O.kept(), *O.structure_ctes(), recursive=True)
    + 'SELECT image_id, det_idx, "row", col, row_span, col_span, num_rows, num_cols FROM cells',
)
def q_table_structure(spark, sf_dir):
    cells = S.assign_cells(kept_detections(spark, sf_dir), with_shape=True)
    return cells.select("image_id", "det_idx", "row", "col", "row_span", "col_span", "num_rows", "num_cols")


@register(
    "table_structure_array",
    ORACLE["table_structure"],
)
def q_table_structure_array(spark, sf_dir):
    """Same result through the one-shuffle array form (bounded images)."""
    cells = S.assign_cells(kept_detections(spark, sf_dir), form="array", with_shape=True)
    return cells.select("image_id", "det_idx", "row", "col", "row_span", "col_span", "num_rows", "num_cols")


@register(
    "table_rows",
    O.with_(O.LI_IMAGES, O.DET, O.kept(), *O.structure_ctes(), recursive=True)
    + 'SELECT image_id, det_idx, "row", row_span FROM cells',
)
def q_table_rows(spark, sf_dir):
    return S.assign_cells(kept_detections(spark, sf_dir), cols=False).select("image_id", "det_idx", "row", "row_span")


@register(
    "table_cols",
    O.with_(O.LI_IMAGES, O.DET, O.kept(), *O.structure_ctes(), recursive=True)
    + "SELECT image_id, det_idx, col, col_span FROM cells",
)
def q_table_cols(spark, sf_dir):
    return S.assign_cells(kept_detections(spark, sf_dir), rows=False).select("image_id", "det_idx", "col", "col_span")


SHAPE_SQL = (
    O.with_(O.LI_IMAGES, O.DET, "det AS (SELECT * FROM det_all WHERE score > 0.9)", O.IMAGES,
            O.anchors_cte("ra", "t"), O.anchors_cte("ca", "l"), recursive=True)
    + """SELECT i.image_id,
  CAST(coalesce((SELECT max(k) + 1 FROM ra WHERE ra.image_id = i.image_id), 1) AS INTEGER) AS num_rows,
  CAST(coalesce((SELECT max(k) + 1 FROM ca WHERE ca.image_id = i.image_id), 1) AS INTEGER) AS num_cols
FROM imgs i"""
)


@register("table_shape", SHAPE_SQL)
def q_table_shape(spark, sf_dir):
    """A3 at threshold 0.9: images left with no cell read as 1 x 1."""
    dets = kept_detections(spark, sf_dir, 0.9)
    return S.table_shapes(S.grid_anchors(dets), images=D.images(spark, sf_dir))


# --- W3-W6 -------------------------------------------------------------------

def _argsort_sql(edge: str) -> str:
    return O.with_(O.LI_IMAGES, O.DET, O.kept()) + (
        f"SELECT image_id, det_idx, CAST(row_number() OVER (PARTITION BY image_id ORDER BY {edge}, det_idx) - 1 AS INTEGER)"
        f" AS rank_{edge} FROM det"
    )


def _argsort_query(edge: str):
    def q(spark, sf_dir):
        return S.argsort(kept_detections(spark, sf_dir), edge).select("image_id", "det_idx", f"rank_{edge}")

    return q


for _name, _edge in (("argsort_top", "t"), ("argsort_bottom", "b"), ("argsort_left", "l"), ("argsort_right", "r")):
    register(_name, _argsort_sql(_edge))(_argsort_query(_edge))


# --- W1, W2, P2-P4, A7: packed detector output --------------------------------

def _packed(spark, sf_dir):
    """Raw detections stacked per batch of 16 images, as packed rows ``[class, score, x0, y0, x1, y1]``."""
    d = D.detections(spark, sf_dir).withColumn("batch_id", F.floor(F.col("image_id") / 16).cast("bigint"))
    w = Window.partitionBy("batch_id").orderBy("image_id", "det_idx")
    return d.select(
        "batch_id",
        (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        F.array(F.lit(0.0), "score", "l", "t", "r", "b").cast("array<float>").alias("row"),
        "image_id",
        "det_idx",
    )


def _counts(spark, sf_dir):
    c = PK.detection_counts(D.images(spark, sf_dir), D.detections(spark, sf_dir))
    return c.select(
        F.floor(F.col("image_id") / 16).cast("bigint").alias("batch_id"),
        (F.col("image_id") % 16).cast("int").alias("seq"),
        "image_id",
        "cnt",
    )


PACKED_SQL = """packed AS (
  SELECT CAST(floor(image_id / 16) AS BIGINT) AS batch_id,
    CAST(row_number() OVER (PARTITION BY CAST(floor(image_id / 16) AS BIGINT) ORDER BY image_id, det_idx) - 1 AS BIGINT) AS pos,
    CAST([0.0, score, l, t, r, b] AS FLOAT[]) AS prow, image_id AS src_image, det_idx AS src_idx
  FROM det_all
)""", """counts AS (
  SELECT CAST(floor(i.image_id / 16) AS BIGINT) AS batch_id, CAST(i.image_id % 16 AS INTEGER) AS seq, i.image_id,
    CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt
  FROM imgs i LEFT JOIN (SELECT image_id, count(*) AS cnt FROM det_all GROUP BY image_id) c USING (image_id)
)""", """rng AS (
  SELECT *, coalesce(sum(cnt) OVER (PARTITION BY batch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
  FROM counts
)"""

BOX_OUT_SQL = "CAST(p.prow[3] AS DOUBLE) AS l, CAST(p.prow[4] AS DOUBLE) AS t, CAST(p.prow[5] AS DOUBLE) AS r, CAST(p.prow[6] AS DOUBLE) AS b"


@register(
    "packed_split",
    O.with_(O.LI_IMAGES, O.DET, O.IMAGES, *PACKED_SQL)
    + f"""SELECT r.image_id, CAST(p.pos - r.lo AS INTEGER) AS det_idx, CAST(p.prow[2] AS DOUBLE) AS score, {BOX_OUT_SQL}
FROM packed p JOIN rng r ON p.batch_id = r.batch_id AND p.pos >= r.lo AND p.pos < r.lo + r.cnt
WHERE p.prow[2] > 0.5""",
)
def q_packed_split(spark, sf_dir):
    split = PK.ragged_split(_packed(spark, sf_dir).drop("image_id", "det_idx"), _counts(spark, sf_dir))
    kept = P.confidence_filter(P.packed_fields(split.select("image_id", "det_idx", "row")))
    return kept.select("image_id", "det_idx", F.col("score").cast("double").alias("score"),
                       *[F.col(e).cast("double").alias(e) for e in "ltrb"])


@register(
    "packed_split_fixed",
    O.with_(O.LI_IMAGES, O.DET, O.IMAGES, *PACKED_SQL)
    + """SELECT c.image_id, CAST(p.pos % 300 AS INTEGER) AS det_idx, CAST(p.prow[2] AS DOUBLE) AS score
FROM (SELECT batch_id, CAST((src_image % 16) * 300 + src_idx AS BIGINT) AS pos, prow FROM packed) p
JOIN counts c ON c.batch_id = p.batch_id AND c.seq = p.pos // 300
WHERE p.prow[2] > 0.5""",
)
def q_packed_split_fixed(spark, sf_dir):
    pk = _packed(spark, sf_dir).select(
        "batch_id", ((F.col("image_id") % 16) * PK.FIXED_SLOTS + F.col("det_idx")).cast("bigint").alias("pos"), "row"
    )
    split = PK.fixed_slot_split(pk, _counts(spark, sf_dir))
    kept = P.confidence_filter(P.packed_fields(split.select("image_id", "det_idx", "row")))
    return kept.select("image_id", "det_idx", F.col("score").cast("double").alias("score"))


@register(
    "detection_counts",
    O.with_(O.LI_IMAGES, O.DET, O.IMAGES)
    + """SELECT i.image_id, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt FROM imgs i
LEFT JOIN (SELECT image_id, count(*) AS cnt FROM det_all WHERE score > 0.9 GROUP BY image_id) c USING (image_id)""",
)
def q_detection_counts(spark, sf_dir):
    """A7 at threshold 0.9, so some images have none."""
    return PK.detection_counts(D.images(spark, sf_dir), kept_detections(spark, sf_dir, 0.9))


# --- P5, P6, P7, F11 ---------------------------------------------------------------

@register(
    "scale_factors",
    O.with_(O.IMAGES)
    + "SELECT image_id, CAST(height AS DOUBLE) / 640 AS h_ratio, CAST(width AS DOUBLE) / 640 AS w_ratio FROM imgs",
)
def q_scale_factors(spark, sf_dir):
    return P.scale_factors(D.images(spark, sf_dir)).select("image_id", "h_ratio", "w_ratio")


@register(
    "box_rescale",
    O.with_(O.LI_IMAGES, O.DET, O.kept(), O.IMAGES)
    + """SELECT d.image_id, d.det_idx,
  CAST(d.l * CAST(CAST(i.width AS DOUBLE) / 640 AS FLOAT) AS DOUBLE) AS l,
  CAST(d.t * CAST(CAST(i.height AS DOUBLE) / 640 AS FLOAT) AS DOUBLE) AS t,
  CAST(d.r * CAST(CAST(i.width AS DOUBLE) / 640 AS FLOAT) AS DOUBLE) AS r,
  CAST(d.b * CAST(CAST(i.height AS DOUBLE) / 640 AS FLOAT) AS DOUBLE) AS b
FROM det d JOIN imgs i USING (image_id)""",
)
def q_box_rescale(spark, sf_dir):
    """Derived boxes read as 640 x 640 model output, scaled to each image."""
    imgs = P.scale_factors(D.images(spark, sf_dir))
    d = P.rescale_boxes(kept_detections(spark, sf_dir).join(imgs, "image_id"))
    return d.select("image_id", "det_idx", *[F.col(e).cast("double").alias(e) for e in "ltrb"])


@register(
    "box_array_roundtrip",
    O.with_(O.LI_IMAGES, O.DET, O.kept())
    + """SELECT image_id, det_idx, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r,
  CAST(b AS DOUBLE) AS b, CAST(4 AS INTEGER) AS n_edges FROM det""",
)
def q_box_array_roundtrip(spark, sf_dir):
    d = kept_detections(spark, sf_dir).withColumn("arr", G.box_to_array())
    back = d.select("image_id", "det_idx", F.size("arr").cast("int").alias("n_edges"), *G.array_to_box("arr"))
    return back.select("image_id", "det_idx", *[F.col(e).cast("double").alias(e) for e in "ltrb"], "n_edges")


# --- A1, A2, A8, P8, W12 ----------------------------------------------------------------

@register(
    "classify_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class_id,
  CAST(list_max(embedding) AS DOUBLE) AS score FROM embeddings""",
)
def q_classify_argmax(spark, sf_dir):
    e = D.read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "scores")
    c = C.classify(e)
    return c.select("vec_id", "class_id", F.col("score").cast("double").alias("score"))


@register(
    "classify_softmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class_id,
  round(1.0 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 9) AS prob
FROM embeddings""",
)
def q_classify_softmax(spark, sf_dir):
    e = D.read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "scores")
    c = C.classify(e, probabilities=True)
    return c.select("vec_id", "class_id", F.round("score", 9).alias("prob"))


CLS_SQL = """clsd AS (
  SELECT image_id, CAST(CASE WHEN scores[2] > scores[1] THEN 1 ELSE 0 END AS INTEGER) AS class_id,
    CASE WHEN scores[2] > scores[1] THEN scores[2] ELSE scores[1] END AS score
  FROM cls
)"""


@register(
    "class_histogram",
    O.with_(O.IMAGES, O.CLASS_SCORES, CLS_SQL)
    + f"""SELECT class_id, {O.TABLE_CLASS_CASE} AS label, count(*) AS n_images, round(avg(CAST(score AS DOUBLE)), 6) AS mean_score
FROM clsd GROUP BY class_id""",
)
def q_class_histogram(spark, sf_dir):
    c = C.classify(D.class_scores(spark, sf_dir))
    h = C.with_table_label(C.class_histogram(c))
    return h.select("class_id", "label", "n_images", F.round("mean_score", 6).alias("mean_score"))


@register(
    "class_ordinal",
    O.with_(O.IMAGES, O.CLASS_SCORES, CLS_SQL)
    + """SELECT image_id, class_id AS model_idx,
  CAST(row_number() OVER (PARTITION BY class_id ORDER BY image_id) - 1 AS INTEGER) AS ordinal FROM clsd""",
)
def q_class_ordinal(spark, sf_dir):
    c = C.classify(D.class_scores(spark, sf_dir)).withColumn("model_idx", F.col("class_id"))
    return C.class_ordinal(c, bucket_width=256).select("image_id", "model_idx", "ordinal")


# --- J1, J2, T1, U5, U6: recognition ----------------------------------------------------

def _scorers(spark, sf_dir):
    return D.table_classifier(spark, sf_dir), [D.cell_detector(spark, sf_dir, 0), D.cell_detector(spark, sf_dir, 1)]


ROUTED_SQL = [
    O.IMAGES, O.CLASS_SCORES, CLS_SQL,
    """rdet_all AS (
  SELECT d.image_id, d.det_idx, c.class_id AS model_idx, d.l, d.t, d.r, d.b,
    CASE WHEN c.class_id = 0 THEN d.score ELSE 1.0 - d.score END AS score
  FROM det_all d JOIN clsd c USING (image_id)
)""",
]


@register(
    "route_detectors",
    O.with_(O.LI_IMAGES, O.DET, *ROUTED_SQL)
    + "SELECT image_id, det_idx, model_idx, CAST(score AS DOUBLE) AS score FROM rdet_all WHERE score > 0.5",
)
def q_route_detectors(spark, sf_dir):
    cl, dets = _scorers(spark, sf_dir)
    imgs = D.images(spark, sf_dir)
    classes = materialize(R.classify_images(imgs, cl))  # read by every detector's branch
    routed = P.confidence_filter(R.route(imgs, classes, dets))
    return routed.select("image_id", "det_idx", F.col("model_idx").cast("int").alias("model_idx"), F.col("score").cast("double"))


@register(
    "recombine",
    O.with_(O.LI_IMAGES, O.DET, *ROUTED_SQL)
    + """SELECT c.image_id, c.class_id AS model_idx, CAST(coalesce(n.n, 0) AS BIGINT) AS n_cells
FROM clsd c LEFT JOIN (SELECT image_id, model_idx, count(*) AS n FROM rdet_all WHERE score > 0.9 GROUP BY 1, 2) n
  ON n.image_id = c.image_id AND n.model_idx = c.class_id""",
)
def q_recombine(spark, sf_dir):
    """J2 at threshold 0.9: images whose detector kept nothing still appear, with 0."""
    cl, dets = _scorers(spark, sf_dir)
    imgs = D.images(spark, sf_dir)
    classes = materialize(R.classify_images(imgs, cl))  # read by every detector's branch and the result
    kept = P.confidence_filter(R.route(imgs, classes, dets), 0.9)
    return R.recombine(imgs, classes, kept).select("image_id", F.col("model_idx").cast("int"), "n_cells")


@register(
    "table_recognition",
    O.with_(O.LI_IMAGES, O.DET, *ROUTED_SQL, "det AS (SELECT * FROM rdet_all WHERE score > 0.5)",
            *O.structure_ctes(), recursive=True)
    + 'SELECT c.image_id, c.det_idx, r.model_idx, c."row", c.col, c.row_span, c.col_span FROM cells c JOIN det r USING (image_id, det_idx)',
)
def q_table_recognition(spark, sf_dir):
    cl, dets = _scorers(spark, sf_dir)
    rec = R.recognize_tables(D.images(spark, sf_dir), cl, dets)
    return rec.cells.select("image_id", "det_idx", F.col("model_idx").cast("int"), "row", "col", "row_span", "col_span")


@register(
    "table_recognition_shapes",
    O.with_(O.LI_IMAGES, O.DET, *ROUTED_SQL, "det AS (SELECT * FROM rdet_all WHERE score > 0.5)",
            O.anchors_cte("ra", "t"), O.anchors_cte("ca", "l"), recursive=True)
    + f"""SELECT c.image_id, c.class_id AS model_idx, {O.TABLE_CLASS_CASE} AS label,
  CAST(coalesce((SELECT max(k) + 1 FROM ra WHERE ra.image_id = c.image_id), 1) AS INTEGER) AS num_rows,
  CAST(coalesce((SELECT max(k) + 1 FROM ca WHERE ca.image_id = c.image_id), 1) AS INTEGER) AS num_cols
FROM clsd c""",
)
def q_table_recognition_shapes(spark, sf_dir):
    cl, dets = _scorers(spark, sf_dir)
    rec = R.recognize_tables(D.images(spark, sf_dir), cl, dets)
    return rec.shapes.select("image_id", F.col("model_idx").cast("int"), "label", "num_rows", "num_cols")


@register(
    "table_debug",
    O.with_(O.LI_IMAGES, O.DET, *ROUTED_SQL, "det AS (SELECT * FROM rdet_all WHERE score > 0.5)",
            O.anchors_cte("ra", "t"), O.anchors_cte("ca", "l"), recursive=True)
    + """SELECT c.image_id,
  CAST(coalesce((SELECT max(k) + 1 FROM ra WHERE ra.image_id = c.image_id), 1) AS INTEGER) AS num_rows,
  CAST(coalesce((SELECT max(k) + 1 FROM ca WHERE ca.image_id = c.image_id), 1) AS INTEGER) AS num_cols,
  CAST((SELECT count(*) FROM rdet_all x WHERE x.image_id = c.image_id AND x.score > 0.0) AS BIGINT) AS n_raw
FROM clsd c""",
)
def q_table_debug(spark, sf_dir):
    cl, dets = _scorers(spark, sf_dir)
    imgs = D.images(spark, sf_dir)
    shapes, raw = R.debug_tables(imgs, cl, dets)
    n_raw = raw.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_raw"))
    return shapes.join(n_raw, "image_id", "left").select(
        "image_id", "num_rows", "num_cols", F.coalesce("n_raw", F.lit(0)).cast("bigint").alias("n_raw")
    )


# --- O1, O3 ---------------------------------------------------------------------------

@register(
    "reading_order",
    O.with_(O.LI_IMAGES, O.DET, O.kept())
    + """SELECT image_id, det_idx,
  CAST(row_number() OVER (PARTITION BY image_id ORDER BY l + 100 * t, det_idx) - 1 AS INTEGER) AS reading_rank FROM det""",
)
def q_reading_order(spark, sf_dir):
    return P.reading_order(kept_detections(spark, sf_dir)).select("image_id", "det_idx", "reading_rank")


@register(
    "top_detections",
    O.with_(O.LI_IMAGES, O.DET)
    + """SELECT image_id, det_idx, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_idx) AS rk FROM det_all) x WHERE rk <= 10""",
)
def q_top_detections(spark, sf_dir):
    """O3 with k = 10 (the detector keeps its best k slots per image)."""
    return P.top_detections(D.detections(spark, sf_dir), 10).select("image_id", "det_idx", F.col("score").cast("double"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLE)
