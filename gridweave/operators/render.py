"""Grid expansion and Markdown rendering.

X1 lists every ``(row, col)`` slot a cell covers; when two cells claim the
same slot the lower ``det_idx`` wins. X2 renders a table as a GitHub-style
pipe table: row 0 is the header, every column is padded to its widest value
(and at least the header width plus two), a dash line of width + 2 follows
the header, cells are padded by one space, and there is no trailing newline.
Text is treated as text (no numeric re-formatting); ``|`` is escaped.

Work is split so nothing is gathered per cell: slots are grouped by
``(key, row, col)``, widths are a window over ``(key, col)``, lines a
group-by on ``(key, row)`` over at most ``num_cols`` pieces, and only the
finished lines are joined per table. As a table ends as one string, its cells are dealt by
table once, before they are expanded; the steps after that need no other exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.text import md_escape


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def grid_slots(cells: DataFrame, key: str | Sequence[str] = "image_id", text: str | None = "text") -> DataFrame:
    """One row per covered slot ``(key, grid_row, grid_col, det_idx[, text])``."""
    keys = _keys(key)
    extra = [text] if text else []
    exploded = cells.select(
        *keys,
        "det_idx",
        *extra,
        F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("grid_row"),
        F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("grid_col"),
    )
    win = F.min(F.struct("det_idx", *extra)).alias("_w")
    g = exploded.groupBy(*keys, "grid_row", "grid_col").agg(win)
    return g.select(*keys, "grid_row", "grid_col", F.col("_w.det_idx").alias("det_idx"), *[F.col("_w." + e).alias(e) for e in extra])


def full_grid(shapes: DataFrame, slots: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """Every slot of every table (``num_rows x num_cols``) with its text, ``""`` when empty."""
    keys = _keys(key)
    grid = shapes.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("num_rows") - 1)).alias("grid_row"),
        F.col("num_cols"),
    ).select(*keys, "grid_row", F.explode(F.sequence(F.lit(0), F.col("num_cols") - 1)).alias("grid_col"))
    return grid.join(slots.select(*keys, "grid_row", "grid_col", "text"), keys + ["grid_row", "grid_col"], "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def table_grid(cells: DataFrame, shapes: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """:func:`full_grid` of :func:`grid_slots` in one group-by, dealt by table.

    A shape is a cell over the whole table that loses every slot to a real one. Cells
    outside their shape, or without a key, show nowhere; a shape that stands twice lists its slots twice.
    """
    keys = _keys(key)
    one, none = F.lit(1), F.lit(None)
    own = cells.dropna(subset=keys).select(
        *keys, F.lit(0).alias("_shape"), F.struct("det_idx", F.coalesce("text", F.lit("")).alias("text")).alias("_cell"),
        "row", "row_span", "col", "col_span",
    )
    kind = own.schema["_cell"].dataType
    whole = shapes.select(
        *keys, one.alias("_shape"), none.cast(kind).alias("_cell"),
        F.lit(0).alias("row"), F.col("num_rows").alias("row_span"), F.lit(0).alias("col"), F.col("num_cols").alias("col_span"),
    )
    rows = own.unionByName(whole).repartition(*keys)
    slots = rows.select(
        *keys, "_shape", "_cell", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("grid_row"), "col", "col_span"
    ).select(*keys, "_shape", "_cell", "grid_row", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("grid_col"))
    g = slots.groupBy(*keys, "grid_row", "grid_col").agg(F.sum("_shape").alias("_n"), F.min("_cell").alias("_cell")).filter("_n > 0")
    text = F.coalesce("_cell.text", F.lit("")).alias("text")
    return g.select(*keys, "grid_row", "grid_col", text, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_n")).drop("_n")


def markdown_lines(grid: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """``(key, line_no, line)``: header, dash line, body rows of each table.

    Column widths are a window over ``(key, column)`` (one exchange, no join
    back), and the dash line is built from the header row's widths inside the
    same per-row aggregation, so the grid is consumed once.
    """
    keys = _keys(key)
    g = grid.withColumn("text", md_escape("text")).withColumn("_len", F.length("text"))
    wc = Window.partitionBy(*keys, "grid_col")
    width = F.greatest(F.max("_len").over(wc), F.max(F.when(F.col("grid_row") == 0, F.col("_len") + 2)).over(wc))
    padded = g.withColumn("_w", width).withColumn("_cell", F.rpad("text", F.col("_w"), " "))
    rows = padded.groupBy(*keys, "grid_row").agg(
        F.sort_array(F.collect_list(F.struct("grid_col", "_cell", "_w"))).alias("_cells")
    )
    line = F.concat(F.lit("| "), F.array_join(F.transform("_cells", lambda c: c["_cell"]), " | "), F.lit(" |"))
    dash = F.concat(
        F.lit("|"), F.array_join(F.transform("_cells", lambda c: F.repeat(F.lit("-"), c["_w"] + 2)), "|"), F.lit("|")
    )
    header = F.array(
        F.struct(F.lit(0).alias("line_no"), line.alias("line")), F.struct(F.lit(1).alias("line_no"), dash.alias("line"))
    )
    body = F.array(F.struct((F.col("grid_row") + 1).alias("line_no"), line.alias("line")))
    out = rows.select(*keys, F.explode(F.when(F.col("grid_row") == 0, header).otherwise(body)).alias("_l"))
    return out.select(*keys, F.col("_l.line_no").alias("line_no"), F.col("_l.line").alias("line"))


def markdown(lines: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """``(key, markdown)``; lines joined with ``\\n`` and no trailing newline."""
    keys = _keys(key)
    g = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return g.select(*keys, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("markdown"))


def table_markdown(cells: DataFrame, shapes: DataFrame, key: str | Sequence[str] = "image_id") -> DataFrame:
    """X1 + X2 from matched cells (``text`` column) and shapes."""
    return markdown(markdown_lines(table_grid(cells, shapes, key), key), key)
