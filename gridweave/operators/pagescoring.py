"""Scorers fed with table crops cut from page images in the same task.

Page images meet the windows of their clusters once, by page; a crop never
leaves the task that cuts it. For every page the task slices its crops, classifies
them, sends each to the detector of its class and splits the packed output, so only scores and
boxes come back. A task holds one page and the tensors of ``batch_size`` crops.

Images of pages without windows are not read into Python. Windows are clamped to the
page; one without pixels or with a null edge cannot be scored and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from gridweave.operators import pixels as PX
from gridweave.operators import scoring as SC

def score_crops(
    page_images: DataFrame,
    windows: DataFrame,
    classifier: Callable[[], Callable],
    detectors: Sequence[Callable[[], Callable]],
    size: int = PX.CELL_INPUT,
    threshold: float = 0.0,
    batch_size: int = 16,
    rgb_to_bgr: bool = True,
    page_key: str = "page_id",
    crop_key: str = "cluster_id",
) -> DataFrame:
    """``page, crop, model_idx, scores, det_idx, class_id, score, l, t, r, b`` of every window with pixels.

    ``classifier`` and ``detectors`` are the model factories of :mod:`gridweave.operators.scoring`;
    ``windows`` has the P14 columns. Every crop has one row with its ``scores`` (no ``det_idx``),
    then one for each detection above ``threshold``, in crop pixels. Class ``k`` goes to detector ``k``.
    """
    SC.validate_threshold(threshold)
    own = [windows.schema[page_key], windows.schema[crop_key], StructField("model_idx", IntegerType()), StructField("scores", ArrayType(FloatType()))]
    schema = StructType(own + SC.DET_SCHEMA.fields)
    per_page = windows.dropna(subset=list(PX.WINDOW)).groupBy(page_key).agg(F.collect_list(F.struct(F.col(crop_key).alias("crop"), *PX.WINDOW)).alias("windows"))
    pages = PX.with_windows(PX.checked_images(page_images, [page_key]), per_page, page_key)

    names = schema.names
    types = to_arrow_schema(schema).types

    def run(batches):
        import pyarrow as pa

        classify = SC._model(classifier)
        small, large = PX.batch_memory(batch_size, PX.CLS_CROP), PX.batch_memory(batch_size, size)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                page, page_id = PX.pixel_arrays(row)[0], row.column(page_key)
                crops = [(w["crop"], PX.cut(page, w, rgb_to_bgr)) for w in row.column("windows")[0].as_py()]
                crops = [(crop, img) for crop, img in crops if img.size]
                for s in range(0, len(crops), batch_size):
                    part = crops[s : s + batch_size]
                    logits = np.asarray(classify(PX.tensors_of([img for _, img in part], PX.classification_tensor, PX.CLS_CROP, small)), np.float32)
                    model_of = logits.argmax(axis=1)  # the first of equal scores
                    out = [{names[1]: crop, "model_idx": int(k), "scores": v.tolist()} for (crop, _), k, v in zip(part, model_of, logits, strict=True)]
                    for k in np.unique(model_of).tolist():
                        mine = [part[j] for j in np.flatnonzero(model_of == k)]
                        rows, counts = SC._model(detectors[k])(PX.tensors_of([img for _, img in mine], partial(PX.detection_tensor, size=size), size, large))
                        shape = np.array([img.shape[:2] for _, img in mine])
                        owner, *columns = SC.split_packed(rows, counts, shape[:, 0], shape[:, 1], size, threshold)
                        for j, *values in zip(owner, *columns, strict=True):
                            found = dict(zip(SC.DET_SCHEMA.names, (x.item() for x in values), strict=True))
                            out.append({names[1]: mine[j][0], "model_idx": k, **found})
                    ids = {page_key: page_id.take(pa.array(np.zeros(len(out), np.int64)))}
                    yield pa.RecordBatch.from_arrays(
                        [ids[n] if n in ids else pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)],
                        names=names,
                    )

    return pages.mapInArrow(run, schema)


def as_scorers(scored: DataFrame, models: int, keys: Sequence[str] = ("page_id", "cluster_id")):
    """The output of :func:`score_crops` as a plan classifier and ``models`` plan detectors, for :func:`recognize_tables`.

    ``scored`` is read by each of them, so materialize it first.
    """
    keys = list(keys)

    def classify(images: DataFrame) -> DataFrame:
        return scored.filter("scores IS NOT NULL").select(*keys, "scores").join(images.select(*keys), keys, "left_semi")

    def detector(k: int):
        def detect(images: DataFrame) -> DataFrame:
            found = scored.filter(F.col("det_idx").isNotNull() & (F.col("model_idx") == k)).select(*keys, *SC.DET_SCHEMA.names)
            return found.join(images.select(*keys), keys, "left_semi")

        return detect

    return classify, [detector(k) for k in range(models)]
