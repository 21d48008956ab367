"""Box arithmetic as Catalyst expressions (no Python UDFs).

Boxes are four flat columns ``l, t, r, b`` (origin top-left) so that filters
on them reach the Parquet scan. Geometry coming from a detector is float32;
helpers keep float32 where the result must match float32 arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridweave.constants import READING_ORDER_ROW_WEIGHT

EDGES = ("l", "t", "r", "b")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box_to_array(l="l", t="t", r="r", b="b") -> Column:
    """P7 ``as_array``: ``[l, t, r, b]`` as ``ARRAY<FLOAT>``."""
    return F.array(col(l), col(t), col(r), col(b)).cast(ArrayType(FloatType()))


def array_to_box(arr: str | Column, prefix: str = "") -> list[Column]:
    """P7 ``from_array``: four float32 columns from a ``[l, t, r, b]`` array."""
    a = col(arr)
    return [F.element_at(a, i + 1).cast(FloatType()).alias(prefix + e) for i, e in enumerate(EDGES)]


def area(l="l", t="t", r="r", b="b") -> Column:
    """signed area ``(r - l) * (b - t)``; a box counts only when it is > 0."""
    return (col(r) - col(l)) * (col(b) - col(t))


def intersection_edges(a: dict, b: dict) -> dict:
    """the intersection box of two boxes given as ``{edge: Column}`` maps."""
    return {
        "l": F.greatest(a["l"], b["l"]),
        "t": F.greatest(a["t"], b["t"]),
        "r": F.least(a["r"], b["r"]),
        "b": F.least(a["b"], b["b"]),
    }


def clamp(x: str | Column, lo, hi) -> Column:
    """``min(max(x, lo), hi)``. NaN boxes must be rejected upstream."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(col(x), lo_c), hi_c)


def half_even(x: str | Column) -> Column:
    """Python's ``round()`` (banker's rounding) to an integer."""
    return F.bround(col(x), 0).cast("int")


def reading_order_key(l="l", t="t") -> Column:
    """O1: reading-order sort key ``l + 100 * t``."""
    return col(l) + F.lit(READING_ORDER_ROW_WEIGHT) * col(t)
