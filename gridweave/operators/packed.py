"""Splitting a detector's packed output back into images.

A detector returns, per batch, one matrix of rows ``[class, score, x0, y0,
x1, y1]`` for all its images stacked, plus a count per image. Positions are
data (``pos``), never row order. The ragged split turns the counts into
``[lo, hi)`` ranges with a running sum. Every range puts a mark at its first
position (and at the start of every further stretch of ``STRETCH`` positions
it reaches into), and a row takes the last mark at or before it: one window
over ``(batch, stretch)``, so a batch of any size is spread, rows move once
and no position is listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.constants import DETECTION_SLOTS as FIXED_SLOTS  # noqa: E402

STRETCH = 1 << 14  # positions of a batch that are assigned together


def count_ranges(counts: DataFrame, batch: str = "batch_id", seq: str = "seq", cnt: str = "cnt") -> DataFrame:
    """``lo = sum(cnt of earlier images in the batch)``, ``hi = lo + cnt``."""
    w = Window.partitionBy(batch).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum(cnt).over(w), F.lit(0)).cast("bigint")
    return counts.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col(cnt))


def ragged_split(
    packed: DataFrame,
    counts: DataFrame,
    batch: str = "batch_id",
    seq: str = "seq",
    cnt: str = "cnt",
    pos: str = "pos",
) -> DataFrame:
    """Attach ``image_id`` and the within-image index ``det_idx`` to packed rows.

    Image ``i`` of a batch owns ``[lo, hi)``; a 0 count owns nothing, and a
    row that no image owns is left out.
    """
    r = count_ranges(counts, batch, seq, cnt).filter(F.col(cnt) > 0)
    part = F.floor(F.col(pos) / STRETCH)
    marks = r.select(
        batch, F.struct("image_id", "lo", "hi").alias("_owner"), F.explode(F.sequence(F.floor(F.col("lo") / STRETCH), F.floor((F.col("hi") - 1) / STRETCH))).alias("_part")
    ).withColumn("_at", F.greatest(F.col("_owner.lo"), F.col("_part") * STRETCH))
    rows = packed.select(batch, F.struct(*packed.columns).alias("_row"), part.alias("_part"), F.col(pos).cast("bigint").alias("_at"))
    line = Window.partitionBy(batch, "_part").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("_owner", F.last("_owner", ignorenulls=True).over(line))
    owned = both.filter(F.col("_row").isNotNull() & (F.col("_at") < F.col("_owner.hi")))
    return owned.select("_row.*", "_owner.image_id", (F.col("_at") - F.col("_owner.lo")).cast("int").alias("det_idx"))


def fixed_slot_split(packed: DataFrame, counts: DataFrame, slots: int = FIXED_SLOTS, batch: str = "batch_id",
                     seq: str = "seq", pos: str = "pos") -> DataFrame:
    """Every image owns exactly ``slots`` rows: ``seq = pos div slots``."""
    p = packed.withColumn(seq, (F.col(pos) / F.lit(slots)).cast("bigint").cast("int")).withColumn(
        "det_idx", (F.col(pos) % F.lit(slots)).cast("int")
    )
    return p.join(counts.select(batch, seq, "image_id"), [batch, seq])


def detection_counts(images: DataFrame, dets: DataFrame, key: str = "image_id") -> DataFrame:
    """Detections per image, 0 for images without any (left join from images)."""
    c = dets.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    return images.select(key).join(c, key, "left").select(key, F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))
