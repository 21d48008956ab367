"""Crops scored in the task that cuts them."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from gridweave.operators import pagescoring as PG
from gridweave.operators import pixels as PX
from gridweave.plans.tables import recognize_tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file

PAGES = "page_id bigint, height int, width int, nChannels int, mode int, data binary"
WINDOWS = "page_id bigint, cluster_id int, crop_top int, crop_bottom int, crop_left int, crop_right int"


def by_channel():
    """Logits: means of the first and the last channel."""
    return lambda x: np.stack([x[:, 0].mean(axis=(1, 2)), x[:, 2].mean(axis=(1, 2))], axis=1)


def quarters(score):
    """Four boxes in a 2 x 2 grid; the first scores the mean of the tensor, the others ``score``."""

    def factory():
        def run(x):
            s = x.shape[2] / 2
            rows = [[7, x[i].mean() if (a, b) == (0, 0) else score, b * s, a * s, b * s + s, a * s + s] for i in range(len(x)) for a in (0, 1) for b in (0, 1)]
            return np.array(rows, np.float32), np.full(len(x), 4)

        return run

    return factory


def pages_of(spark, arrays, mode=16):
    rows = [(i, *a.shape, mode, bytearray(a.tobytes())) for i, a in arrays.items()]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("batch", [1, 2, 16])
def test_crops_reach_the_models_of_their_class(spark, batch):
    rng = np.random.default_rng(5)
    arrays = {1: rng.integers(0, 256, (90, 70, 3)).astype(np.uint8), 2: rng.integers(0, 256, (60, 120, 3)).astype(np.uint8)}
    arrays[1][:40, :, 0] //= 4  # page 1: more red above, more blue below
    arrays[1][40:, :, 2] //= 4
    arrays[3] = arrays[1]  # no window
    windows = [(1, 0, 0, 30, 5, 65), (1, 1, 50, 90, 10, 50), (1, 2, 45, 200, -9, 30), (1, 3, 20, 20, 0, 9), (2, 0, 10, 50, 0, 120), (9, 0, 0, 5, 0, 5), (2, 1, None, 5, 0, 5)]
    got = PG.score_crops(pages_of(spark, arrays), spark.createDataFrame(windows, WINDOWS), by_channel, [quarters(0.75), quarters(0.5)],
                         size=32, threshold=0.25, batch_size=batch).collect()
    seen = set()
    for page, crop, t, b, l, r in windows[:3] + windows[4:5]:
        img = np.ascontiguousarray(arrays[page][max(t, 0) : b, max(l, 0) : r, ::-1])
        logits = by_channel()(PX.classification_tensor(img)[None])[0]
        k = int(logits.argmax())
        seen.add(k)
        head, *found = sorted((x for x in got if (x.page_id, x.cluster_id) == (page, crop)), key=lambda x: -1 if x.det_idx is None else x.det_idx)
        assert head.det_idx is None and head.model_idx == k and np.allclose(head.scores, logits, atol=1e-4)
        assert [x.det_idx for x in found] == [0, 1, 2, 3] and {x.model_idx for x in found} == {k} and {x.class_id for x in found} == {7}
        first = PX.detection_tensor(img, 32).mean()
        assert np.allclose([x.score for x in found], [first] + [(0.75, 0.5)[k]] * 3, atol=1e-4)
        h, w = img.shape[:2]
        assert np.allclose([(x.l, x.t, x.r, x.b) for x in found][3], (w / 2, h / 2, w, h), atol=1e-3)
    assert seen == {0, 1} and {(x.page_id, x.cluster_id) for x in got} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_scored_crops_through_recognition_and_bad_pages(spark):
    white = np.full((80, 80, 3), 200, np.uint8)
    white[:, :, 2] = 10  # stored last, first after the swap
    windows = spark.createDataFrame([(1, 0, 0, 80, 0, 80), (1, 4, 0, 60, 0, 40)], WINDOWS)
    scored = PG.score_crops(pages_of(spark, {1: white}), windows, by_channel, [quarters(0.75), quarters(0.5)]).persist()
    rec = recognize_tables(windows, *PG.as_scorers(scored, 2), key=["page_id", "cluster_id"])
    assert {(r.cluster_id, r.model_idx, r.num_rows, r.num_cols) for r in rec.shapes.collect()} == {(0, 1, 1, 1), (4, 1, 1, 1)}
    scored.unpersist()
    with pytest.raises(Exception, match="not an 8-bit image"):
        PG.score_crops(pages_of(spark, {1: white}, mode=24), windows, by_channel, [quarters(0.5)] * 2).collect()
    assert PG.score_crops(pages_of(spark, {1: white}), windows.limit(0), by_channel, [quarters(0.5)] * 2).count() == 0
