"""Result verification as joins (V1, V2, V3).

Each check returns one row per compared item with an ``ok`` flag, so a
failing run says which rows fail instead of stopping at the first. The
detection check also reports rows missing on either side (a full outer
join), which a walk over the result alone would not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geometry import reading_order_key
from gridweave.operators.ranking import bucketed_row_number

from gridweave.constants import POSITION_TOLERANCE, SCORE_TOLERANCE  # noqa: E402


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def verify_text(actual: DataFrame, expected: DataFrame, key: str | Sequence[str] = "image_id", col: str = "text") -> DataFrame:
    """V1: exact equality per key (null-safe); a side missing counts as a mismatch."""
    keys = _keys(key)
    a = actual.select(*keys, F.col(col).alias("actual"), F.lit(True).alias("_a"))
    e = expected.select(*keys, F.col(col).alias("expected"), F.lit(True).alias("_e"))
    both = F.col("_a").isNotNull() & F.col("_e").isNotNull()  # a null text is not a missing row
    ok = both & F.col("actual").eqNullSafe(F.col("expected"))
    return a.join(e, keys, "full_outer").withColumn("ok", ok).drop("_a", "_e")


def verify_classification(
    actual: DataFrame, expected: DataFrame, key: str | Sequence[str] = "image_id", tolerance: float = SCORE_TOLERANCE
) -> DataFrame:
    """V2: same class and ``|score - expected| < tolerance``."""
    keys = _keys(key)
    a = actual.select(*keys, F.col("class_id").alias("a_class"), F.col("score").cast("double").alias("a_score"))
    e = expected.select(*keys, F.col("class_id").alias("e_class"), F.col("score").cast("double").alias("e_score"))
    j = a.join(e, keys, "full_outer")
    ok = (F.col("a_class") == F.col("e_class")) & (F.abs(F.col("a_score") - F.col("e_score")) < F.lit(tolerance))
    return j.withColumn("ok", F.coalesce(ok, F.lit(False)))


def verify_detections(
    actual: DataFrame,
    expected: DataFrame,
    key: str | Sequence[str] = "image_id",
    position_tolerance: float = POSITION_TOLERANCE,
    score_tolerance: float = SCORE_TOLERANCE,
) -> DataFrame:
    """V3: align both sides by reading order (``l + 100 * t``) and compare edge by edge.

    Returns ``(key, rank, ok, missing)``; ``missing`` marks a rank present on
    one side only.
    """
    keys = _keys(key)

    def ranked(df: DataFrame, p: str) -> DataFrame:
        k = reading_order_key()
        r = bucketed_row_number(df, keys, [k, F.col("det_idx")], F.floor(k / F.lit(6400.0)), "rank")
        return r.select(
            *keys,
            "rank",
            *[F.col(e).cast("double").alias(p + e) for e in "ltrb"],
            F.col("score").cast("double").alias(p + "score"),
        )

    j = ranked(actual, "a_").join(ranked(expected, "e_"), keys + ["rank"], "full_outer")
    close = F.lit(True)
    for e in "ltrb":
        close = close & (F.abs(F.col("a_" + e) - F.col("e_" + e)) < F.lit(float(position_tolerance)))
    close = close & (F.abs(F.col("a_score") - F.col("e_score")) < F.lit(float(score_tolerance)))
    missing = F.col("a_l").isNull() | F.col("e_l").isNull()
    return j.select(*keys, "rank", F.coalesce(close, F.lit(False)).alias("ok"), missing.alias("missing"))
