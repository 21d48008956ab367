"""Table recognition: classify, route to a detector, filter, build structure.

A *classifier* is ``images -> (image_id, scores ARRAY<FLOAT>)``; a *detector*
is ``images -> (image_id, det_idx, score, l, t, r, b)``. Both may be Spark
joins against precomputed results or batch scorers from
:mod:`gridweave.operators.scoring`; the plan does not care.

Routing is a filter per detector and a ``unionByName`` of their outputs, so
each detector only sees its own images and an unused detector costs nothing.
Results are recombined with images by key (never by position) through a
left join, so an image without detections still yields a 1 x 1 table.

Scorer outputs are stage boundaries: the classification feeds every
detector branch and the detections feed both the anchor aggregate and the
cell join, so both are materialized once (see :func:`gridweave.session.materialize`)
instead of being re-scored by each consumer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators import classify as C
from gridweave.operators import structure as S
from gridweave.operators.filters import DEFAULT_THRESHOLD, confidence_filter
from gridweave.session import materialize

Classifier = Callable[[DataFrame], DataFrame]
Detector = Callable[[DataFrame], DataFrame]


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def identity_model_idx(class_id: Column) -> Column:
    """The default assignment: class 0 (wired) -> detector 0, class 1 (wireless) -> detector 1."""
    return class_id


@dataclass
class Recognized:
    classes: DataFrame   # image_id, class_id, score, label, model_idx
    detections: DataFrame  # routed raw detections + model_idx
    cells: DataFrame     # kept cells with row/col/spans
    shapes: DataFrame    # every image with num_rows / num_cols


def classify_images(images: DataFrame, classifier: Classifier, assign=identity_model_idx, key: str = "image_id") -> DataFrame:
    """A1 + P8 + model index per image."""
    scored = C.classify(classifier(images))
    return C.with_table_label(scored).withColumn("model_idx", assign(F.col("class_id")).cast("int")).select(
        *_keys(key), "class_id", "score", "label", "model_idx"
    )


def route(images: DataFrame, classes: DataFrame, detectors: Sequence[Detector], key: str = "image_id") -> DataFrame:
    """J1 + T1: run detector ``k`` on the images assigned to ``k`` and union the outputs."""
    keys = _keys(key)
    routed = images.join(classes.select(*keys, "model_idx"), keys)
    outs = []
    for k, det in enumerate(detectors):
        part = routed.filter(F.col("model_idx") == k).drop("model_idx")
        outs.append(det(part).withColumn("model_idx", F.lit(k)))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def recombine(images: DataFrame, classes: DataFrame, cells_or_dets: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image and its detector, the number of kept detections (0 when none)."""
    keys = _keys(key)
    n = cells_or_dets.groupBy(*keys, "model_idx").agg(F.count(F.lit(1)).alias("n_cells"))
    base = images.select(*keys).join(classes.select(*keys, "model_idx"), keys)
    return base.join(n, keys + ["model_idx"], "left").select(
        *keys, "model_idx", F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells")
    )


def recognize_tables(
    images: DataFrame,
    classifier: Classifier,
    detectors: Sequence[Detector],
    threshold: float = DEFAULT_THRESHOLD,
    tolerance: float = S.DEFAULT_TOLERANCE,
    assign=identity_model_idx,
    key: str = "image_id",
    stage_outputs: bool = True,
) -> Recognized:
    """The table-recognition composition as DataFrame transformations."""
    keys = _keys(key)
    classes = classify_images(images, classifier, assign, keys)
    if stage_outputs:
        classes = materialize(classes)
    dets = route(images, classes, detectors, keys)
    if stage_outputs:
        dets = materialize(dets)
    kept = confidence_filter(dets, threshold)
    anchors = S.grid_anchors(kept, keys, tolerance)
    base = keys + ["det_idx", "model_idx", "score", "l", "t", "r", "b"]
    joined = kept.select(*base).join(anchors, keys)
    cells = joined.select(*base, *S.axes_of(joined, tolerance))
    shapes = S.table_shapes(anchors, keys, images).join(classes.select(*keys, "model_idx", "label"), keys)
    return Recognized(classes, dets, cells, shapes)


def debug_tables(
    images: DataFrame,
    classifier: Classifier,
    detectors: Sequence[Detector],
    detector_idx: int | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    tolerance: float = S.DEFAULT_TOLERANCE,
    key: str = "image_id",
) -> tuple[DataFrame, DataFrame]:
    """``(shapes at threshold, raw detections at 0.0)`` from one detector pass.

    ``detector_idx`` forces a detector; otherwise the classifier decides. The
    raw frame is computed once and both outputs derive from it (the
    documented meaning; detections are not a single-use stream here).
    """
    keys = _keys(key)
    if detector_idx is None:
        classes = materialize(classify_images(images, classifier, key=keys))
    else:
        classes = images.select(*keys).withColumn("model_idx", F.lit(int(detector_idx)))
    raw = materialize(confidence_filter(route(images, classes, detectors, key), 0.0))
    kept = confidence_filter(raw, threshold)
    shapes = S.table_shapes(S.grid_anchors(kept, keys, tolerance), keys, images)
    return shapes, raw
