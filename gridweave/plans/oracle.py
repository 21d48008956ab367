"""Reference SQL for every registered query (plain ANSI SQL run by DuckDB).

Each string reads the driver's tables directly and re-derives the fixture
boxes with the same integer arithmetic as :mod:`gridweave.sources.derived`.
Column names and types follow the Spark result so that row hashes compare.
"""

from __future__ import annotations

from gridweave.functions.labels import LAYOUT_CLASSES, LAYOUT_DOC_LABELS, TABLE_CLASSES, sql_case

# --- shared derivations ----------------------------------------------------

LI_IMAGES = """li AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY image_id
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS det_idx
  FROM (SELECT *, CAST(floor(l_orderkey / 8) AS BIGINT) AS image_id FROM lineitem) x
)"""

DET = """det_all AS (
  SELECT image_id, det_idx,
    CAST(150 * (l_suppkey % 4) + l_partkey % 13 AS FLOAT) AS l,
    CAST(60 * (l_linenumber - 1) + l_partkey % 14 AS FLOAT) AS t,
    CAST(150 * (l_suppkey % 4) + l_partkey % 13 + 140 + (CASE WHEN l_suppkey % 5 = 0 THEN 150 ELSE 0 END) AS FLOAT) AS r,
    CAST(60 * (l_linenumber - 1) + l_partkey % 14 + 55 + (CASE WHEN l_partkey % 11 = 0 THEN 60 ELSE 0 END) AS FLOAT) AS b,
    CAST(l_partkey % 100 AS DOUBLE) / 100 AS score
  FROM li
)"""

TEXT = """txt AS (
  SELECT image_id, det_idx AS text_idx,
    concat(' ', l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)) AS text,
    CAST(150 * (l_suppkey % 4) + l_partkey % 160 AS DOUBLE) AS l,
    CAST(60 * (l_linenumber - 1) + l_partkey % 50 AS DOUBLE) AS t,
    CAST(150 * (l_suppkey % 4) + l_partkey % 160 + (l_partkey % 3) * 20 AS DOUBLE) AS r,
    CAST(60 * (l_linenumber - 1) + l_partkey % 50 + 14 AS DOUBLE) AS b
  FROM li
)"""

WORDS = """words AS (
  SELECT image_id, det_idx AS word_idx,
    CAST(year(l_shipdate) AS VARCHAR) AS text,
    CAST(150 * (l_suppkey % 4) + l_partkey % 160 + 7 AS DOUBLE) AS l,
    CAST(60 * (l_linenumber - 1) + l_partkey % 50 + 7 AS DOUBLE) AS t,
    CAST(150 * (l_suppkey % 4) + l_partkey % 160 + 7 + 20 + (l_partkey % 3) * 20 AS DOUBLE) AS r,
    CAST(60 * (l_linenumber - 1) + l_partkey % 50 + 7 + 14 AS DOUBLE) AS b
  FROM li
)"""

IMAGES = """imgs AS (
  SELECT image_id, CAST(600 + image_id % 400 AS INTEGER) AS width, CAST(400 + image_id % 300 AS INTEGER) AS height
  FROM (SELECT DISTINCT CAST(floor(o_orderkey / 8) AS BIGINT) AS image_id FROM orders) o
)"""

CLASS_SCORES = """cls AS (
  SELECT i.image_id, e.embedding[1:2] AS scores
  FROM imgs i JOIN embeddings e ON e.vec_id = i.image_id % (SELECT count(*) FROM embeddings)
)"""

LAYOUT = """lay AS (
  SELECT CAST(floor(event_id / 10) AS BIGINT) AS page_id,
    CAST(event_id % 10 AS INTEGER) AS det_idx,
    CAST((event_id * 7 + user_id) % 27 AS INTEGER) AS class_id,
    CAST(event_id % 37 AS DOUBLE) / 36 AS score,
    CAST((event_id * 13) % 950 - 20 AS FLOAT) AS l,
    CAST((event_id * 29) % 1250 - 20 AS FLOAT) AS t,
    CAST((event_id * 13) % 950 - 20 + 60 + event_id % 200 AS FLOAT) AS r,
    CAST((event_id * 29) % 1250 - 20 + 30 + event_id % 90 AS FLOAT) AS b
  FROM events
)"""

PAGES = """pg AS (
  SELECT page_id, CAST(page_id % 1000 + 1 AS INTEGER) AS page_no,
    CAST(595.0 AS DOUBLE) AS width, CAST(842.0 AS DOUBLE) AS height,
    CAST(CASE WHEN page_id % 7 = 3 THEN NULL ELSE 893 END AS INTEGER) AS img_width,
    CAST(CASE WHEN page_id % 7 = 3 THEN NULL ELSE 1263 END AS INTEGER) AS img_height,
    page_id % 10 <> 0 AS is_valid
  FROM (SELECT DISTINCT CAST(floor(event_id / 10) AS BIGINT) AS page_id FROM events) e
)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def kept(threshold: float = 0.5, name: str = "det") -> str:
    return f"{name} AS (SELECT * FROM det_all WHERE score > {threshold})"


def anchors_cte(axis: str, start: str, src: str = "det", tol: int = 10) -> str:
    """Recursive anchors of one axis: ``a(k+1) = min{ s : s - a(k) > tol }``."""
    return f"""{axis}(image_id, k, a) AS (
  SELECT image_id, 0, min({start}) FROM {src} GROUP BY image_id
  UNION ALL
  SELECT {axis}.image_id, {axis}.k + 1, min({src}.{start}) FROM {axis} JOIN {src}
    ON {src}.image_id = {axis}.image_id AND {src}.{start} - {axis}.a > {tol}
  GROUP BY {axis}.image_id, {axis}.k
)"""


def structure_ctes(src: str = "det", tol: int = 10) -> list[str]:
    """Cells with row/col/spans computed from recursive anchors (name ``cells``)."""
    return [
        anchors_cte("ra", "t", src, tol),
        anchors_cte("ca", "l", src, tol),
        f"""rr AS (
  SELECT d.image_id, d.det_idx,
    CAST(max(CASE WHEN ra.a <= d.t THEN ra.k END) AS INTEGER) AS "row",
    CAST(1 + count(CASE WHEN ra.a > d.t AND d.b - ra.a >= {tol} THEN 1 END) AS INTEGER) AS row_span,
    CAST(max(ra.k) + 1 AS INTEGER) AS num_rows
  FROM {src} d JOIN ra ON ra.image_id = d.image_id GROUP BY d.image_id, d.det_idx
)""",
        f"""cc AS (
  SELECT d.image_id, d.det_idx,
    CAST(max(CASE WHEN ca.a <= d.l THEN ca.k END) AS INTEGER) AS col,
    CAST(1 + count(CASE WHEN ca.a > d.l AND d.r - ca.a >= {tol} THEN 1 END) AS INTEGER) AS col_span,
    CAST(max(ca.k) + 1 AS INTEGER) AS num_cols
  FROM {src} d JOIN ca ON ca.image_id = d.image_id GROUP BY d.image_id, d.det_idx
)""",
        f"""cells AS (
  SELECT d.image_id, d.det_idx, d.l, d.t, d.r, d.b, rr."row", cc.col, rr.row_span, cc.col_span, rr.num_rows, cc.num_cols
  FROM {src} d JOIN rr USING (image_id, det_idx) JOIN cc USING (image_id, det_idx)
)""",
    ]


TABLE_CLASS_CASE = sql_case(TABLE_CLASSES, "class_id")
LAYOUT_CLASS_CASE = sql_case(LAYOUT_CLASSES, "class_id")
LAYOUT_LABEL_CASE = sql_case(LAYOUT_DOC_LABELS, "class_id")
