"""Findings of round 3: images stay out of broadcasts, tensors are resampled in blocks, routed detections by bounded parts."""

import numpy as np
from pyspark.sql import functions as F

from gridweave.operators import pagescoring as PG
from gridweave.operators import pixels as PX
from gridweave.sources import derived as D


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def by_hand(img, xs, ys):
    """Bilinear samples as written in the textbook, HWC float32."""
    x0, y0 = np.floor(xs).astype(int), np.floor(ys).astype(int)
    x1, y1 = np.minimum(x0 + 1, img.shape[1] - 1), np.minimum(y0 + 1, img.shape[0] - 1)
    fx, fy = (xs - x0).astype(np.float32)[None, :, None], (ys - y0).astype(np.float32)[:, None, None]
    src = img.astype(np.float32)
    rows = src[:, x0] + (src[:, x1] - src[:, x0]) * fx
    return rows[y0] + (rows[y1] - rows[y0]) * fy


def test_tensors_written_into_one_batch_equal_the_formula():
    rng = np.random.default_rng(5)
    imgs = [rng.integers(0, 256, size, dtype=np.uint8) for size in ((31, 45, 3), (1, 5, 3), (90, 2, 3), (200, 150, 3))]
    batch = PX.tensors_of(imgs, lambda img, out: PX.detection_tensor(img, 70, out=out), 70)
    for img, got in zip(imgs, batch, strict=True):
        want = by_hand(img, PX.source_positions(img.shape[1], 70), PX.source_positions(img.shape[0], 70)) / np.float32(255)
        assert np.array_equal(got, want.transpose(2, 0, 1))
        assert np.array_equal(PX.detection_tensor(img, 70, swap_rb=True), want.transpose(2, 0, 1)[::-1])


def windows_of(spark, pages):
    """Two windows a page on stored rows, as the registered queries have them."""
    rows = [(p, c, 1.0, 4.0, 2.0 * c, 2.0 * c + 3) for p in range(pages) for c in range(2)]
    return spark.createDataFrame(rows, "page_id bigint, cluster_id int, crop_top double, crop_bottom double, crop_left double, crop_right double")


def test_page_images_are_never_broadcast(spark, capsys):
    w = windows_of(spark, 6)
    pages = D.page_images(w.select("page_id").distinct())
    jobs = [PX.crop_pixels(pages, w), PG.score_crops(pages, w, D.gray_classifier, [D.gray_detector, D.gray_detector])]
    for job in jobs:
        text = plan(job, capsys)
        assert "BuildLeft" not in text and "BroadcastHashJoin" in text
    assert jobs[0].count() == 12


def test_many_windows_meet_the_images_in_a_shuffled_join(spark, capsys, monkeypatch):
    w = windows_of(spark, 6)
    pages = D.page_images(w.select("page_id").distinct())
    want = sorted(map(tuple, PX.crop_pixels(pages, w).collect()))
    monkeypatch.setattr(PX, "PAGES_BROADCAST", 5)
    crops = PX.crop_pixels(pages, w)
    assert "ShuffledHashJoin" in plan(crops, capsys)
    assert sorted(map(tuple, crops.collect())) == want and len(want) == 12


def test_page_images_are_rendered_by_many_tasks(spark):
    ids = windows_of(spark, 40).select("page_id").distinct()
    per_task = D.page_images(ids).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 8 and sum(r["count"] for r in per_task) == 40


def test_routed_detections_are_those_of_the_wanted_images(spark, scratch, capsys):
    rows = [(k, 10 * k + n, k % 7, n, 1.5) for k in range(200) for n in range(1, 5)] + [(None, 1, 1, 1, 1.0), (8, 81, 1, 1, 1.5)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double").write.parquet(f"{scratch}/lineitem.parquet")
    wanted = spark.createDataFrame([(1,), (3,), (3,), (None,), (999,)], "image_id bigint")  # an id twice, null, unknown
    got = D.detections(spark, scratch, only=wanted, most=True)
    want = D.detections(spark, scratch).filter("image_id IN (1, 3)").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    found = D.cell_detector(spark, scratch)(wanted)
    text = plan(found, capsys)
    assert "ShuffledHashJoin" in text and "LeftSemi" not in text
    assert found.count() == 32 * 2 + 33
