"""SQL surface (U12): temporary views and SQL functions.

The functions are SQL-bodied (``CREATE TEMPORARY FUNCTION ... RETURN``), so
Catalyst inlines them as ordinary expressions: no Python runs when a SQL
user calls them.

    register_functions(spark)
    spark.sql('''
      WITH a AS (SELECT image_id, gw_anchors(collect_set(t), 10) AS ra FROM detections GROUP BY image_id)
      SELECT d.image_id, d.det_idx, gw_index(a.ra, d.t) AS row, gw_span(a.ra, d.t, d.b, 10) AS row_span
      FROM detections d JOIN a USING (image_id)''')

For FLOAT columns take ``gw_anchors_float`` and ``gw_span_float``.

Or, over one relation of detections, as table functions:

    register_table_functions(spark, "detections")
    spark.sql("SELECT * FROM gw_table_cells(10)")    -- rows, columns and spans of every cell
    spark.sql("SELECT * FROM gw_table_shapes(10)")   -- rows and columns of every image
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.functions import labels as L
from gridweave.functions.text import STRIP_PATTERN



def _anchors(real: str) -> str:
    return f"""(starts ARRAY<{real}>, tol {real}) RETURNS ARRAY<{real}>
RETURN aggregate(sort_array(array_distinct(starts)),
  named_struct('p', CAST(NULL AS {real}), 'a', CAST(array() AS ARRAY<{real}>)),
  (acc, x) -> CASE WHEN acc.p IS NULL OR x - acc.p > tol
                   THEN named_struct('p', x, 'a', concat(acc.a, array(x))) ELSE acc END,
  acc -> acc.a)"""


def _span(real: str) -> str:
    return f"""(anchors ARRAY<{real}>, s {real}, e {real}, tol {real}) RETURNS INT
RETURN 1 + size(filter(anchors, a -> a > s AND e - a >= tol))"""


# A SQL function has one signature: the plain names subtract in DOUBLE, the
# names with ``_float`` in FLOAT, as the operators do for FLOAT columns.
FUNCTIONS = {
    "gw_anchors": _anchors("DOUBLE"),
    "gw_anchors_float": _anchors("FLOAT"),
    "gw_index": """(anchors ARRAY<DOUBLE>, s DOUBLE) RETURNS INT
RETURN size(filter(anchors, a -> a <= s)) - 1""",
    "gw_span": _span("DOUBLE"),
    "gw_span_float": _span("FLOAT"),
    "gw_strip": f"""(x STRING) RETURNS STRING
RETURN regexp_replace(x, '{STRIP_PATTERN.replace(chr(92), chr(92) * 2)}', '')""",
    "gw_table_label": f"""(class_id INT) RETURNS STRING
RETURN {L.sql_case(L.TABLE_CLASSES, 'class_id')}""",
    "gw_layout_class": f"""(class_id INT) RETURNS STRING
RETURN {L.sql_case(L.LAYOUT_CLASSES, 'class_id')}""",
    "gw_layout_label": f"""(class_id INT) RETURNS STRING
RETURN {L.sql_case(L.LAYOUT_DOC_LABELS, 'class_id')}""",
    "gw_overlap": """(cl DOUBLE, ct DOUBLE, cr DOUBLE, cb DOUBLE, xl DOUBLE, xt DOUBLE, xr DOUBLE, xb DOUBLE) RETURNS DOUBLE
RETURN CASE WHEN (xr - xl) * (xb - xt) > 0 AND cl < xr AND xl < cr AND ct < xb AND xt < cb
  THEN (least(cr, xr) - greatest(cl, xl)) * (least(cb, xb) - greatest(ct, xt)) / ((xr - xl) * (xb - xt)) ELSE 0.0 END""",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the SQL functions in the session; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)


def register_table_functions(spark: SparkSession, relation: str) -> list[str]:
    """Create SQL table functions of a tolerance over ``relation`` (a table or view); returns their names.

    ``relation`` holds ``image_id, det_idx`` and boxes ``l, t, r, b``, all FLOAT or all
    DOUBLE. A SQL function takes no relation as an argument, so it is named
    here; the functions read whatever it holds when they are called. Catalyst inlines
    them: two reads of the relation, one aggregation of the distinct starts by image and a join.
    """
    register_functions(spark)
    types = {f.name: f.dataType.simpleString().upper() for f in spark.table(relation).schema.fields}
    real, key, idx = types["t"], types["image_id"], types["det_idx"]
    if {types[e] for e in "ltrb"} != {real} or real not in ("FLOAT", "DOUBLE"):
        raise ValueError(f"the boxes of {relation} must be all FLOAT or all DOUBLE")
    suffix = "_float" if real == "FLOAT" else ""
    index = "CAST(size(filter({0}, x -> x <= {1})) - 1 AS INT)"
    anchors = f"""SELECT image_id, gw_anchors{suffix}(collect_set(t), CAST(tol AS {real})) AS ra,
    gw_anchors{suffix}(collect_set(l), CAST(tol AS {real})) AS ca FROM {relation} GROUP BY image_id"""
    made = {
        "gw_table_cells": f"""(tol DOUBLE) RETURNS TABLE (image_id {key}, det_idx {idx}, row INT, col INT, row_span INT, col_span INT,
  num_rows INT, num_cols INT)
RETURN WITH a AS ({anchors})
  SELECT d.image_id, d.det_idx, {index.format("a.ra", "d.t")}, {index.format("a.ca", "d.l")},
    gw_span{suffix}(a.ra, d.t, d.b, CAST(tol AS {real})), gw_span{suffix}(a.ca, d.l, d.r, CAST(tol AS {real})),
    size(a.ra), size(a.ca)
  FROM {relation} d JOIN a ON d.image_id = a.image_id""",
        "gw_table_shapes": f"""(tol DOUBLE) RETURNS TABLE (image_id {key}, num_rows INT, num_cols INT)
RETURN WITH a AS ({anchors}) SELECT image_id, size(ra), size(ca) FROM a""",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(made)


def register_views(frames: dict[str, DataFrame]) -> list[str]:
    """Expose frames (detections, cells, clusters, ...) as temporary views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
