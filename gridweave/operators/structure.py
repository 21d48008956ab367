"""Rows, columns and spans of table cells.

Semantics, per image, for one axis with start ``s`` (top or left) and end
``e`` (bottom or right), tolerance ``tol``:

* anchors: ``a0 = min(s)``, ``a(k+1) = min{ s : s - a(k) > tol }``. The gap is
  measured from the first cell of the current row, not from the previous
  cell, so this is an ordered fold, not a ``lag`` test or a session window.
* ``index = |{a : a <= s}| - 1``
* ``span  = 1 + |{a : a > s and e - a >= tol}|``
* ``num   = |anchors|``; an image without cells reads as 1 x 1.

Plan shape, the same for images of any size, lazy and without a driver action:

1. Both axes are cut into *stretches* of ``STRETCH`` tolerances. One
   aggregation lists the distinct starts of every stretch (duplicates go
   before the shuffle), so an image's starts are never gathered.
2. A start more than ``tol`` past the start before it is an anchor for
   certain, whatever stands further back. So a stretch folds on its own, but
   for a *head* that goes on, without such a gap, from the stretch before
   (whose last start comes along where it is near enough).
3. A head needs one value: the last anchor before it. That is the last one of
   the nearest earlier stretch that has a certain one; stretches between, all
   head, map it on: their few possible first anchors (the starts within one
   tolerance) are each folded to the last anchor that follows from it.
4. The anchors of an image, one small row (their spacing bounds them by the
   image's extent over ``tol``, however many cells there are), meet its cells in one
   join, where index and span are projections. That join AQE may broadcast, and
   splits where an image is hot; a merge of cells and anchors in one sorted
   window could not be split.

``form="array"`` is the one-shuffle alternative for inputs whose images are
bounded (a detector emits at most 300 cells per image): it gathers the cells
of an image into one row, folds, and ``inline``s them back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType


from gridweave.constants import GROUPING_TOLERANCE as DEFAULT_TOLERANCE  # noqa: E402
from gridweave.session import materialize


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _dtype(df: DataFrame, c: str) -> DataType:
    return df.schema[c].dataType


def anchor_fold(starts: Column, tol: Column, elem_type: DataType = FloatType(), last: Column | None = None) -> Column:
    """W7/W9 anchors of an array of start values, ascending, after the anchor ``last`` (none: the first value is one).

    ``aggregate`` walks the sorted values once; a value opens a new anchor when
    it lies more than ``tol`` past the current anchor.
    """
    zero = F.struct(
        (F.lit(None) if last is None else last).cast(elem_type).alias("p"),
        F.array().cast(ArrayType(elem_type)).alias("a"),
    )

    def step(acc: Column, x: Column) -> Column:
        opens = acc["p"].isNull() | ((x - acc["p"]) > tol)
        grown = F.named_struct(F.lit("p"), x, F.lit("a"), F.concat(acc["a"], F.array(x)))
        return F.when(opens, grown).otherwise(acc)

    return F.aggregate(F.sort_array(F.array_distinct(starts)), zero, step, lambda acc: acc["a"])


def axis_index(anchors: Column, start: Column) -> Column:
    """W7/W9 index: number of anchors at or before ``start``, minus one."""
    return (F.size(F.filter(anchors, lambda a: a <= start)) - 1).cast("int")


def axis_span(anchors: Column, start: Column, end: Column, tol: Column) -> Column:
    """W8/W10 span: 1 + anchors after the cell's own that its end still reaches."""
    return (1 + F.size(F.filter(anchors, lambda a: (a > start) & ((end - a) >= tol)))).cast("int")


STRETCH = 256  # tolerances (pixels, if the tolerance is below one) that are folded together
_FAR = float(1 << 52)


def _stretch(x: Column, width: float) -> Column:
    """Number of the stretch a coordinate lies in; what is beyond all numbers, or is none, lies in the last."""
    at = F.floor(F.least(F.greatest(x.cast("double") / F.lit(width), F.lit(-_FAR)), F.lit(_FAR))).cast("bigint")
    return F.coalesce(at, F.lit(int(_FAR)).cast("bigint"))


def grid_anchors(
    dets: DataFrame,
    key: str | Sequence[str] = "image_id",
    tolerance: float = DEFAULT_TOLERANCE,
    rows: bool = True,
    cols: bool = True,
    width: float | None = None,
) -> DataFrame:
    """Per image: ``row_anchors`` / ``col_anchors`` arrays (one small row per image).

    ``width`` overrides the length of a stretch in pixels; no result depends on it.
    """
    keys = _keys(key)
    width = float(width or STRETCH * max(float(tolerance), 1.0))
    axes = [(c, n) for c, n, used in (("t", "row_anchors", rows), ("l", "col_anchors", cols)) if used]
    if len({_dtype(dets, c) for c, _ in axes}) > 1:  # each axis compares in the type of its own column
        parts = [grid_anchors(dets, keys, tolerance, n == "row_anchors", n == "col_anchors", width) for _, n in axes]
        return parts[0].join(parts[1], keys)
    kind = _dtype(dets, axes[0][0])
    found = _stretch_anchors(_stretches(dets, keys, [c for c, _ in axes], float(tolerance), width, kind), keys, float(tolerance), kind)
    lists = [F.sort_array(F.flatten(F.collect_list(F.when(F.col("axis") == i, F.col("anchors"))))).alias(n) for i, (_, n) in enumerate(axes)]
    return found.groupBy(*keys).agg(*lists)


def _stretches(dets: DataFrame, keys: list[str], starts: list[str], tol: float, width: float, kind: DataType) -> DataFrame:
    """``keys, axis, at, s, back``: the distinct starts of every stretch, sorted, and the last near one of the stretch before."""
    none = F.lit(None).cast(kind)
    spots = []
    for i, c in enumerate(starts):
        s, at = F.col(c), _stretch(F.col(c), width)
        spots.append(F.struct(F.lit(i).alias("axis"), at.alias("at"), s.alias("s"), none.alias("back")))
        near = _stretch(s.cast("double") + 2 * tol, width) > at
        spots.append(F.when(near, F.struct(F.lit(i).alias("axis"), (at + 1).alias("at"), none.alias("s"), s.alias("back"))))
    rows = dets.select(*keys, F.explode(F.array(*spots)).alias("x")).filter(F.col("x").isNotNull()).select(*keys, "x.*")
    return rows.groupBy(*keys, "axis", "at").agg(F.sort_array(F.collect_set("s")).alias("s"), F.max("back").alias("back"))


def _stretch_anchors(stretches: DataFrame, keys: list[str], tolerance: float, kind: DataType) -> DataFrame:
    """``keys, axis, at, anchors`` of every stretch."""
    tol, n = threshold_literal_any(tolerance, kind), F.size("s")
    past = lambda x, p: (x - p) > tol

    # the head goes on from the stretch before, up to the first gap; the rest is certain
    rows = stretches.withColumn("open", (n > 0) & F.col("back").isNotNull() & ~past(F.get("s", F.lit(0)), F.col("back")))
    gap = F.filter(F.sequence(F.lit(1), n - 1), lambda i: past(F.get("s", i), F.get("s", i - 1)))
    rows = rows.withColumn("cut", F.when(F.col("open"), F.when(n > 1, F.coalesce(F.get(gap, F.lit(0)), n)).otherwise(n)).otherwise(F.lit(0)))
    rows = rows.select(
        *keys, "axis", "at", "back", "open", F.slice("s", F.lit(1), F.col("cut")).alias("head"),
        anchor_fold(F.slice("s", F.col("cut") + 1, n), tol, kind).alias("sure"),
    ).withColumn("out", F.get("sure", F.size("sure") - 1))

    # a stretch that is all head: the last anchor by the first one
    def follow(e: Column) -> Column:
        chain = anchor_fold(F.filter("head", lambda x: x >= e), tol, kind)
        return F.struct(e.alias("first"), F.get(chain, F.size(chain) - 1).alias("last"))

    first = F.filter("head", lambda e, i: (i == 0) | ~past(F.get("head", i - 1), F.col("back")))
    rows = rows.withColumn("through", F.when(F.col("open") & F.col("out").isNull(), F.transform(first, follow)))

    earlier = Window.partitionBy(*keys, "axis").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("p", F.last("out", ignorenulls=True).over(earlier)).withColumn("chain", F.count("out").over(earlier))
    between = Window.partitionBy(*keys, "axis", "chain").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mids", F.collect_list("through").over(between))
    passed = F.aggregate(
        "mids", F.col("p"), lambda p, m: F.coalesce(F.get(F.filter(m, lambda x: past(x["first"], p)), F.lit(0))["last"], p)
    )
    rows = rows.withColumn("p", F.when(F.col("open"), passed))
    both = F.concat(anchor_fold(F.col("head"), tol, kind, F.col("p")), F.col("sure"))
    return rows.select(*keys, "axis", "at", F.when(F.col("open"), both).otherwise(F.col("sure")).alias("anchors"))


def threshold_literal_any(value: float, dtype: DataType) -> Column:
    """A tolerance literal in the column's type (float32 geometry compares in float32)."""
    return F.lit(float(value)).cast(dtype)


def axes_of(df: DataFrame, tolerance: float, rows: bool = True, cols: bool = True, with_shape: bool = False) -> list[Column]:
    """``row, row_span, col, col_span`` of cells that stand beside their image's anchors."""
    out = []
    if rows:
        tol = threshold_literal_any(tolerance, _dtype(df, "t"))
        ra, t, b = F.col("row_anchors"), F.col("t"), F.col("b")
        out += [axis_index(ra, t).alias("row"), axis_span(ra, t, b, tol).alias("row_span")]
    if cols:
        tol = threshold_literal_any(tolerance, _dtype(df, "l"))
        ca, l, r = F.col("col_anchors"), F.col("l"), F.col("r")
        out += [axis_index(ca, l).alias("col"), axis_span(ca, l, r, tol).alias("col_span")]
    if with_shape and rows:
        out.append(F.size("row_anchors").cast("int").alias("num_rows"))
    if with_shape and cols:
        out.append(F.size("col_anchors").cast("int").alias("num_cols"))
    return out


def assign_cells(
    dets: DataFrame,
    key: str | Sequence[str] = "image_id",
    tolerance: float = DEFAULT_TOLERANCE,
    rows: bool = True,
    cols: bool = True,
    form: str = "join",
    carry: Sequence[str] = (),
    width: float | None = None,
    with_shape: bool = False,
) -> DataFrame:
    """Every cell with its ``row, col, row_span, col_span``.

    ``dets`` needs the key columns, ``det_idx`` and ``l, t, r, b``. Extra
    columns named in ``carry`` are passed through; ``with_shape`` adds the
    image's ``num_rows, num_cols`` (the anchor counts, no extra aggregation).
    """
    keys = _keys(key)
    base = keys + ["det_idx", "l", "t", "r", "b"] + [c for c in carry if c not in keys]
    if form == "array":
        return _assign_cells_array(dets.select(*base), keys, tolerance, rows, cols, with_shape)
    anchors = grid_anchors(dets, keys, tolerance, rows, cols, width)
    joined = dets.select(*base).join(anchors, keys)
    return joined.select(*base, *axes_of(joined, tolerance, rows, cols, with_shape))


def _assign_cells_array(
    dets: DataFrame, keys: list[str], tolerance: float, rows: bool, cols: bool, with_shape: bool = False
) -> DataFrame:
    payload = [c for c in dets.columns if c not in keys]
    g = dets.groupBy(*keys).agg(F.collect_list(F.struct(*payload)).alias("_cells"))
    extra = []
    if rows:
        tt = _dtype(dets, "t")
        extra.append(
            anchor_fold(F.transform("_cells", lambda c: c["t"]), threshold_literal_any(tolerance, tt), tt).alias("row_anchors")
        )
    if cols:
        lt = _dtype(dets, "l")
        extra.append(
            anchor_fold(F.transform("_cells", lambda c: c["l"]), threshold_literal_any(tolerance, lt), lt).alias("col_anchors")
        )
    flat = g.select(*keys, *extra, F.inline("_cells"))
    return flat.select(*keys, *payload, *axes_of(flat, tolerance, rows, cols, with_shape))


def table_shapes(
    anchors: DataFrame,
    key: str | Sequence[str] = "image_id",
    images: DataFrame | None = None,
) -> DataFrame:
    """A3: ``num_rows, num_cols`` per image; images without cells read 1 x 1.

    ``anchors`` is the output of :func:`grid_anchors`; with ``images`` given,
    the shape is a left join from it so that empty images survive.
    """
    keys = _keys(key)
    shape = anchors.select(
        *keys,
        F.size("row_anchors").cast("int").alias("num_rows"),
        F.size("col_anchors").cast("int").alias("num_cols"),
    )
    if images is None:
        return shape
    return images.select(*keys).join(shape, keys, "left").select(
        *keys,
        F.coalesce("num_rows", F.lit(1)).alias("num_rows"),
        F.coalesce("num_cols", F.lit(1)).alias("num_cols"),
    )


def build_tables(
    dets: DataFrame,
    key: str | Sequence[str] = "image_id",
    tolerance: float = DEFAULT_TOLERANCE,
    images: DataFrame | None = None,
    stage_outputs: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A6 ``Table.from_detections``: ``(cells, shapes)`` frames sharing one anchor aggregate.

    With ``stage_outputs`` the anchors, which both frames read, are materialized once
    (a join drops null keys before it, so Spark would plan their aggregate twice).
    """
    keys = _keys(key)
    anchors = grid_anchors(dets, keys, tolerance)
    if stage_outputs:
        anchors = materialize(anchors)
    base = keys + ["det_idx", "l", "t", "r", "b"]
    joined = dets.select(*base).join(anchors, keys)
    cells = joined.select(*base, *axes_of(joined, tolerance, True, True))
    return cells, table_shapes(anchors, keys, images)


def argsort(
    dets: DataFrame, by: str, key: str | Sequence[str] = "image_id", name: str | None = None, bucket_width: float = 64.0
) -> DataFrame:
    """Stable rank of each cell by one edge (``t``, ``b``, ``l`` or ``r``), 0-based.

    Ties keep input order, which is ``det_idx``. Ranges of ``bucket_width``
    pixels are ranked in parallel (see :mod:`gridweave.operators.ranking`).
    """
    from gridweave.operators.ranking import bucketed_row_number

    keys = _keys(key)
    bucket = F.floor(F.col(by) / F.lit(float(bucket_width)))
    return bucketed_row_number(dets, keys, [F.col(by), F.col("det_idx")], bucket, name or f"rank_{by}")
