"""Public entry points (U10, U11): ``tables`` and ``layout``.

Thresholds are validated to lie in [0, 1]. When not passed, they come from
the session configuration (``gridweave.tables.threshold``,
``gridweave.layout.threshold``), default 0.5 each, so a deployment can
change them without code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridweave.functions.scores import validate_threshold
from gridweave.plans import documents as DOC
from gridweave.plans.tables import Classifier, Detector, Recognized, recognize_tables

TABLES_THRESHOLD_KEY = "gridweave.tables.threshold"
LAYOUT_THRESHOLD_KEY = "gridweave.layout.threshold"
DEFAULT = "0.5"


def _threshold(df: DataFrame, key: str, given: float | None) -> float:
    value = given if given is not None else float(df.sparkSession.conf.get(key, DEFAULT))
    return validate_threshold(value)


def tables(
    images: DataFrame,
    classifier: Classifier,
    detectors: Sequence[Detector],
    threshold: float | None = None,
    tolerance: float = 10.0,
    key: str | Sequence[str] = "image_id",
) -> Recognized:
    """Task ``table``: classify, detect, filter and build the grid of every image."""
    return recognize_tables(images, classifier, detectors, _threshold(images, TABLES_THRESHOLD_KEY, threshold), tolerance, key=key)


def layout(pages: DataFrame, detector: Detector, threshold: float | None = None) -> DataFrame:
    """Task ``layout``: labelled, clamped clusters in page units for every selected page."""
    return DOC.layout_clusters(pages, detector, _threshold(pages, LAYOUT_THRESHOLD_KEY, threshold))
