"""Table structure on a stream of detections (Structured Streaming).

The structure of an image depends only on that image's cells, so once an
image's detections arrive together the computation is stateless and runs
in append mode without a watermark:

* nested input, one row per image with ``cells ARRAY<STRUCT<det_idx, l, t, r, b>>``:
  the fold and ``inline`` are plain projections of the stream;
* flat input, one row per detection, where the producer writes each image
  within one file: every micro-batch is complete per image, so the batch
  operator runs on it through ``foreachBatch``;
* flat input with event times, where an image's detections arrive over several
  micro-batches: an image is a session, kept as state by image until the
  watermark passes its end, and then emitted once (append mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import structure as S


def nested_structure(stream: DataFrame, key: str = "image_id", tolerance: float = S.DEFAULT_TOLERANCE) -> DataFrame:
    """Cells with row/col/spans from a stream of per-image cell arrays (stateless)."""
    elem = stream.schema["cells"].dataType.elementType
    tt = elem["t"].dataType
    lt = elem["l"].dataType
    with_anchors = stream.select(
        key,
        S.anchor_fold(F.transform("cells", lambda c: c["t"]), F.lit(float(tolerance)).cast(tt), tt).alias("row_anchors"),
        S.anchor_fold(F.transform("cells", lambda c: c["l"]), F.lit(float(tolerance)).cast(lt), lt).alias("col_anchors"),
        "cells",
    )
    flat = with_anchors.select(key, "row_anchors", "col_anchors", F.inline("cells"))
    tol_t = F.lit(float(tolerance)).cast(tt)
    tol_l = F.lit(float(tolerance)).cast(lt)
    return flat.select(
        key,
        "det_idx",
        S.axis_index(F.col("row_anchors"), F.col("t")).alias("row"),
        S.axis_index(F.col("col_anchors"), F.col("l")).alias("col"),
        S.axis_span(F.col("row_anchors"), F.col("t"), F.col("b"), tol_t).alias("row_span"),
        S.axis_span(F.col("col_anchors"), F.col("l"), F.col("r"), tol_l).alias("col_span"),
        F.size("row_anchors").alias("num_rows"),
        F.size("col_anchors").alias("num_cols"),
    )


def flat_structure_writer(output_path: str, key: str = "image_id", tolerance: float = S.DEFAULT_TOLERANCE):
    """A ``foreachBatch`` function: batch structure of each micro-batch, appended as Parquet.

    Writing is idempotent per batch id (one folder per batch, overwritten on
    replay), so a restarted query after an executor or driver loss does not
    duplicate rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = S.assign_cells(batch, key, tolerance)
        cells.write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/batch={batch_id}")

    return write


def session_structure(
    stream: DataFrame, key: str = "image_id", event_time: str = "event_time", gap: str = "5 minutes",
    delay: str = "10 minutes", tolerance: float = S.DEFAULT_TOLERANCE,
) -> DataFrame:
    """Cells with row/col/spans from a flat stream whose images span micro-batches.

    ``stream`` has ``key, event_time, det_idx, l, t, r, b``. Detections of an image at
    most ``gap`` apart belong together; the image is complete, and its cells are
    emitted, when the watermark (``delay`` behind the latest event) has passed ``gap`` after
    its last one. Until then the state of an image is its detections, a bounded list from
    a detector. Later detections are dropped, as Spark drops late rows; detections of the same image after
    a longer pause are an image of their own. Rows with a null ``key`` carry no
    cell: they only move the watermark (a heartbeat for a source that goes quiet).
    """
    cell = F.when(F.col(key).isNotNull(), F.struct("det_idx", "l", "t", "r", "b"))  # a null is not collected
    images = (
        stream.withWatermark(event_time, delay)
        .groupBy(key, F.session_window(event_time, gap))
        .agg(F.collect_list(cell).alias("cells"))
    )
    return nested_structure(images.select(key, "cells"), key, tolerance)
