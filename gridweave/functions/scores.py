"""Score-vector expressions: arg-max, softmax, threshold literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FloatType


def threshold_literal(threshold: float, dtype: DataType | None = None) -> Column:
    """Threshold cast to the score column's type, so float32 scores compare in float32."""
    validate_threshold(threshold)
    return F.lit(float(threshold)).cast(dtype or FloatType())


def validate_threshold(threshold: float) -> float:
    """A confidence threshold must lie in [0, 1]."""
    t = float(threshold)
    if not 0.0 <= t <= 1.0:
        raise ValueError(f"confidence threshold must be within [0, 1], got {threshold}")
    return t


def argmax(scores: str | Column) -> Column:
    """A1: 0-based index of the first maximum."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def max_score(scores: str | Column) -> Column:
    s = F.col(scores) if isinstance(scores, str) else scores
    return F.array_max(s)


def softmax(logits: str | Column) -> Column:
    """A2: numerically stable softmax over an array, as ``ARRAY<DOUBLE>``."""
    x = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(x).cast("double")
    e = F.transform(x, lambda v: F.exp(v.cast("double") - m))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)
