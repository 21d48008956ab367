"""Image source, pixel jobs and scorers."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import pixels as PX
from gridweave.operators import scoring as SC
from gridweave.sources import derived as D
from gridweave.plans.tables import recognize_tables
from gridweave.sources import files as FS


def write_bmp(path, rgb):
    """24-bit BMP (rows bottom-up, BGR, padded to 4 bytes)."""
    h, w, _ = rgb.shape
    pad = (4 - (w * 3) % 4) % 4
    body = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    header = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    with open(path, "wb") as f:
        f.write(header + info + body)


@pytest.fixture()
def bmp_dir(scratch):
    rng = np.random.default_rng(3)
    imgs = {}
    for name, (h, w) in {"a": (20, 31), "b": (45, 16)}.items():
        rgb = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        write_bmp(os.path.join(scratch, f"{name}.bmp"), rgb)
        imgs[name] = rgb
    return scratch, imgs


def test_image_source_reads_bgr(spark, bmp_dir):
    path, imgs = bmp_dir
    df = FS.read_images(spark, path, strict=False)
    rows = {os.path.basename(r.origin)[0]: r for r in df.collect()}
    assert set(rows) == {"a", "b"}
    for k, rgb in imgs.items():
        r = rows[k]
        assert (r.height, r.width, r.nChannels, r.mode) == (rgb.shape[0], rgb.shape[1], 3, FS.CV_8UC3)
        got = np.frombuffer(r.data, np.uint8).reshape(rgb.shape)
        assert np.array_equal(got, rgb[:, :, ::-1])  # BGR
    props = FS.image_properties(df).collect()
    assert {(p.channels, p.dtype) for p in props} == {(3, "uint8")}


def test_image_source_strict_fails_on_bad_file(spark, bmp_dir):
    path, _ = bmp_dir
    with open(os.path.join(path, "broken.bmp"), "wb") as f:
        f.write(b"not an image")
    assert FS.read_images(spark, path, strict=False).count() == 2
    strict = FS.read_images(spark, path, strict=True)
    for job in (strict.collect, strict.count, strict.select("origin", "data").collect):
        with pytest.raises(Exception, match="cannot decode image"):
            job()


def test_image_of_other_depth_fails_before_both_scorers(spark):
    gray = spark.createDataFrame(
        [(1, 30, 40, 1, 0, bytearray(1200))], "image_id bigint, height int, width int, nChannels int, mode int, data binary"
    )
    for frame in (
        PX.classification_tensors(gray),
        PX.detection_tensors(gray, 64),
        SC.classifier(D.mean_channel_classifier)(gray),
        SC.detector(D.grid_detector(3), size=64)(gray),
    ):
        with pytest.raises(Exception, match="not an 8-bit image of 3 channels: 1"):
            frame.collect()


def test_scorers_keep_composite_keys_in_their_types(spark):
    pages = PX.derived_images(spark.range(0, 40).withColumnRenamed("id", "image_id")).select(
        F.concat(F.lit("p"), F.col("image_id") % 7).alias("page_id"), F.col("image_id").cast("int").alias("cluster_id"),
        F.col("height").alias("img_height"), F.col("width").alias("img_width"), F.lit(792.0).alias("height"),
        F.lit(612.0).alias("width"), "nChannels", "mode", "data",
    )
    keys, size = ["page_id", "cluster_id"], ("img_height", "img_width")
    scores = SC.classifier(D.mean_channel_classifier, key=keys, image_size=size, batch_size=7)(pages)
    assert dict(scores.dtypes) == {"page_id": "string", "cluster_id": "int", "scores": "array<float>"} and scores.count() == 40
    dets = SC.detector(D.grid_detector(3), size=32, key=keys, image_size=size, batch_size=7)(pages)
    assert [t for _, t in dets.dtypes[:2]] == ["string", "int"] and dets.select(*keys).distinct().count() == 40
    over = dets.join(pages, keys).filter((F.col("r") > F.col("img_width") + 0.01) | (F.col("b") > F.col("img_height") + 0.01))
    assert over.count() == 0


def test_tensor_job_is_whole_at_any_arrow_batch(spark):
    imgs = PX.derived_images(spark.range(0, 90).withColumnRenamed("id", "image_id")).coalesce(1)
    whole = {r.image_id: sum(map(float, r.tensor)) for r in PX.detection_tensors(imgs, 16).collect()}
    short = {r.image_id: r.checksum for r in PX.detection_tensors(imgs, 16, summarize=True).collect()}
    assert len(whole) == 90 and whole.keys() == short.keys()
    assert all(abs(whole[k] - short[k]) < 0.02 for k in whole)


def reference_bilinear(img, new_w, new_h):
    h, w = img.shape[:2]
    out = np.zeros((new_h, new_w, img.shape[2]), np.float64)
    for y in range(new_h):
        sy = min(max((y + 0.5) * h / new_h - 0.5, 0), h - 1)
        y0 = int(np.floor(sy)); y1 = min(y0 + 1, h - 1); fy = sy - y0
        for x in range(new_w):
            sx = min(max((x + 0.5) * w / new_w - 0.5, 0), w - 1)
            x0 = int(np.floor(sx)); x1 = min(x0 + 1, w - 1); fx = sx - x0
            top = img[y0, x0] * (1 - fx) + img[y0, x1] * fx
            bot = img[y1, x0] * (1 - fx) + img[y1, x1] * fx
            out[y, x] = top * (1 - fy) + bot * fy
    return out


def test_resize_matches_pointwise_formula():
    img = np.random.default_rng(1).integers(0, 256, (7, 11, 3)).astype(np.uint8)
    for nw, nh in [(23, 5), (4, 15), (11, 7)]:
        got = PX.sample_bilinear(img, PX.source_positions(11, nw), PX.source_positions(7, nh))
        assert np.allclose(got, reference_bilinear(img.astype(np.float64), nw, nh), atol=1e-3)


def test_classification_window_is_the_middle_of_the_resized_image():
    img = np.random.default_rng(2).integers(0, 256, (33, 51, 3)).astype(np.uint8)
    whole = reference_bilinear(img.astype(np.float64), 396, 256)  # 51 * 256 / 33 = 395.6
    middle = whole[16 : 16 + 224, 86 : 86 + 224]
    for swap, order in ((False, slice(None)), (True, slice(None, None, -1))):
        want = (middle[:, :, order] - np.array(PX.CLS_MEAN)) * np.array(PX.CLS_SCALE)
        assert np.allclose(PX.classification_tensor(img, swap), want.transpose(2, 0, 1), atol=1e-3)


def test_classification_tensor_geometry_and_normalisation():
    img = np.full((30, 40, 3), 100, np.uint8)
    t = PX.classification_tensor(img)
    assert t.shape == (3, 224, 224)
    for c in range(3):
        assert np.allclose(t[c], (100 - PX.CLS_MEAN[c]) * PX.CLS_SCALE[c], atol=1e-4)
    d = PX.detection_tensor(img, 64, swap_rb=True)
    assert d.shape == (3, 64, 64) and np.allclose(d, 100 / 255.0, atol=1e-6)


def test_split_packed_counts_threshold_and_rescale():
    rows = np.array(
        [[0, 0.9, 10, 20, 30, 40], [0, 0.5, 0, 0, 1, 1], [0, 0.7, 64, 64, 128, 128], [0, 0.2, 1, 1, 2, 2]], np.float32
    )
    counts = [2, 0, 2]
    out = list(zip(*SC.split_packed(rows, counts, heights=[128, 50, 32], widths=[64, 50, 256], size=64, threshold=0.5)))
    # image 0 keeps its first row only (0.5 is not > 0.5); image 1 owns nothing; image 2 keeps slot 0
    assert [(i, d) for i, d, *_ in out] == [(0, 0), (2, 0)]
    _, _, _, _, l, t, r, b = out[0]
    assert (l, t, r, b) == (10.0, 40.0, 30.0, 80.0)  # x by w/S = 1, y by h/S = 2
    _, _, _, _, l, t, r, b = out[1]
    assert (l, t, r, b) == (256.0, 32.0, 512.0, 64.0)


def test_scorers_through_recognition(spark):
    ids = spark.range(0, 40).withColumnRenamed("id", "image_id")
    imgs = PX.derived_images(ids)
    cl = SC.classifier(D.mean_channel_classifier, batch_size=8)
    scores = cl(imgs).collect()
    assert len(scores) == 40 and {len(s.scores) for s in scores} == {2}
    dets = [SC.detector(D.grid_detector(3), size=32), SC.detector(D.grid_detector(4, invert=True), size=32)]
    rec = recognize_tables(imgs, cl, dets)
    shapes = rec.shapes.collect()
    assert len(shapes) == 40
    assert all(s.num_rows >= 1 and s.num_cols >= 1 for s in shapes)
    cells = rec.cells.join(imgs.select("image_id", "width", "height"), "image_id")
    assert cells.filter((F.col("r") > F.col("width") + 0.01) | (F.col("b") > F.col("height") + 0.01)).count() == 0


def test_crop_pixels_slices_and_swaps(spark):
    page = np.arange(12 * 10 * 3, dtype=np.uint8).reshape(12, 10, 3)
    pages = spark.createDataFrame(
        [(7, 12, 10, 3, 16, bytearray(page.tobytes()))], "page_id bigint, height int, width int, nChannels int, mode int, data binary"
    )
    windows = spark.createDataFrame([(7, 1, 2, 9, 3, 8)], "page_id bigint, cluster_id int, crop_top int, crop_bottom int, crop_left int, crop_right int")
    r = PX.crop_pixels(pages, windows).collect()[0]
    got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
    assert np.array_equal(got, page[2:9, 3:8, ::-1])
