"""Row numbers within a group that do not put a whole group into one task.

``row_number() over (partition by key order by x)`` sorts every group in a
single task; one group holding a large share of all rows then becomes one
straggler. Here the ordering values are cut into contiguous ranges
(``bucket`` must be a non-decreasing function of the order): a small table
of counts per ``(key, bucket)`` gives each range its offset by a prefix
sum, and the row number inside a range is a window over ``(key, bucket)``.
The result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str
) -> DataFrame:
    """0-based ``name`` = position within ``keys`` by ``order``; ``bucket`` is monotone in ``order``."""
    keys = list(keys)
    d = df.withColumn("_bkt", bucket)
    wl = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    local = d.withColumn("_rk", F.row_number().over(wl) - 1)
    # counts come from the ranked rows (already partitioned by range), so the
    # input is shuffled once and both branches share that exchange
    sizes = local.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    wp = Window.partitionBy(*keys).orderBy(F.col("_bkt").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(wp), F.lit(0))).drop("_n")
    joined = local.join(offsets, keys + ["_bkt"], "inner") if keys else local.join(offsets, ["_bkt"])
    return joined.withColumn(name, (F.col("_off") + F.col("_rk")).cast("int")).drop("_bkt", "_off", "_rk")
