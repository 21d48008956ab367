"""Pluggable batch scorers.

A *model factory* is a zero-argument callable returning the model; it runs
once per Python worker (cached), never on the driver. A batch is valid during
the call only: the next one is written over it. Two shapes:

* classification model: ``f(batch[N, 3, 224, 224]) -> logits[N, C]``; run in
  Arrow batches of ``batch_size`` images, fused with the pixel preparation.
* detection model: ``f(batch[N, 3, S, S]) -> (rows[M, 6], counts[N])`` with rows
  ``[class, score, x0, y0, x1, y1]`` stacked for the batch (the packed form);
  run through ``mapInArrow`` as well; an image yields any number of rows.

The detection job splits the packed rows by the counts inside the task (W1),
applies the strict confidence threshold (P2, P3), and maps boxes from model
space to image pixels (P6: x by ``w / S``, y by ``h / S``) in float32.
Wired and wireless detectors (U4) are the same job with different factories.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from gridweave.functions.scores import validate_threshold
from gridweave.operators import pixels as PX

_MODELS: dict[str, object] = {}


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _model(factory: Callable[[], object]):
    """One model per worker process and factory (keyed by the pickled factory, stable across tasks)."""
    import hashlib

    from pyspark import cloudpickle

    k = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()
    if k not in _MODELS:
        _MODELS[k] = factory()
    return _MODELS[k]


def classifier(
    factory: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 32,
    key: str | Sequence[str] = "image_id",
    swap_rb: bool = False,
    image_size: tuple[str, str] = ("height", "width"),
):
    """A plan classifier ``images -> (key, scores ARRAY<FLOAT>)``.

    Pixel preparation (P16, P17) and inference are fused in one Arrow task:
    image bytes go in, only the logits come out, in batches of ``batch_size``.
    ``key`` names one or more columns, kept in their own types; ``image_size``
    names the columns that hold the pixel height and width (a page frame has
    its size in points beside them).
    """
    keys = _keys(key)

    def run(batches):
        import pyarrow as pa

        model, memory = _model(factory), PX.batch_memory(batch_size, PX.CLS_CROP)
        for b in batches:
            for s in range(0, b.num_rows, batch_size):
                part = b.slice(s, batch_size)
                x = PX.tensors_of(PX.pixel_arrays(part), partial(PX.classification_tensor, swap_rb=swap_rb), PX.CLS_CROP, memory)
                logits = np.array(model(x), dtype=np.float32)
                offsets = np.arange(0, logits.size + 1, logits.shape[1], dtype=np.int32)
                scores = pa.ListArray.from_arrays(pa.array(offsets), pa.array(logits.ravel(), type=pa.float32()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], scores], names=[*keys, "scores"])

    def classify(images: DataFrame) -> DataFrame:
        schema = StructType([images.schema[k] for k in keys] + [StructField("scores", ArrayType(FloatType()))])
        return PX.checked_images(images, keys, *image_size).mapInArrow(run, schema)

    return classify


DET_SCHEMA = StructType(
    [
        StructField("det_idx", IntegerType()),
        StructField("class_id", IntegerType()),
        StructField("score", FloatType()),
        StructField("l", FloatType()),
        StructField("t", FloatType()),
        StructField("r", FloatType()),
        StructField("b", FloatType()),
    ]
)


def split_packed(rows: np.ndarray, counts: np.ndarray, heights, widths, size: int, threshold: float) -> list[np.ndarray]:
    """W1 + P2/P3 + P4 + P6 for one batch, all images at once: the columns ``i, det_idx, class, score, l, t, r, b`` of the rows kept."""
    counts = np.asarray(counts, np.int64)
    image = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(len(image)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.asarray(rows, np.float32).reshape(-1, 6)[: len(image)]
    at = np.flatnonzero(rows[:, 1] > np.float32(threshold))
    factor = (np.stack([widths, heights] * 2, axis=1) / size).astype(np.float32)  # of l, t, r, b
    kept, image = rows[at], image[at]
    boxes = kept[:, 2:6] * factor[image]
    return [image, slot[at].astype(np.int32), kept[:, 0].astype(np.int32), kept[:, 1], *boxes.T]


def detector(
    factory: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]],
    size: int = PX.CELL_INPUT,
    threshold: float = 0.0,
    batch_size: int = 16,
    key: str | Sequence[str] = "image_id",
    swap_rb: bool = False,
    image_size: tuple[str, str] = ("height", "width"),
):
    """A plan detector ``images -> (key, det_idx, class_id, score, l, t, r, b)``.

    ``threshold`` is the detector's own cut (the plan applies its threshold
    afterwards as well); ``det_idx`` is the row's slot within its image.
    ``key`` and ``image_size`` are as for :func:`classifier`.
    """
    validate_threshold(threshold)
    keys = _keys(key)

    def run(batches):
        import pyarrow as pa

        model, memory = _model(factory), PX.batch_memory(batch_size, size)
        for b in batches:
            for s in range(0, b.num_rows, batch_size):
                part = b.slice(s, batch_size)
                rows, counts = model(PX.tensors_of(PX.pixel_arrays(part), partial(PX.detection_tensor, size=size, swap_rb=swap_rb), size, memory))
                heights, widths = (part.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width"))
                image, *columns = split_packed(rows, counts, heights, widths, size, threshold)
                owner = pa.array(image)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(owner) for k in keys] + [pa.array(c) for c in columns], names=[*keys, *DET_SCHEMA.names]
                )

    def detect(images: DataFrame) -> DataFrame:
        schema = StructType([images.schema[k] for k in keys] + DET_SCHEMA.fields)
        return PX.checked_images(images, keys, *image_size).mapInArrow(run, schema)

    return detect
