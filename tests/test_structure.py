"""Rows / columns / spans against a plain sequential loop (brute force)."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType, LongType, StructField, StructType

from gridweave.operators import structure as S

SCHEMA = StructType(
    [
        StructField("image_id", LongType()),
        StructField("det_idx", IntegerType()),
        StructField("l", FloatType()),
        StructField("t", FloatType()),
        StructField("r", FloatType()),
        StructField("b", FloatType()),
    ]
)


def loop_axis(starts, ends, tol):
    """By definition: the chain of anchors first, then a count of anchors for every cell."""
    tol = np.float32(tol)
    chain = [min(starts)]
    while later := [s for s in starts if np.float32(s - chain[-1]) > tol]:
        chain.append(min(later))
    idx = [sum(a <= s for a in chain) - 1 for s in starts]
    span = [1 + sum(a > s and np.float32(e - a) >= tol for a in chain) for s, e in zip(starts, ends, strict=True)]
    return idx, span, len(chain)


def loop_table(boxes, tol):
    l = [np.float32(b[0]) for b in boxes]
    t = [np.float32(b[1]) for b in boxes]
    r = [np.float32(b[2]) for b in boxes]
    b_ = [np.float32(b[3]) for b in boxes]
    row, rs, nr = loop_axis(t, b_, tol)
    col, cs, nc = loop_axis(l, r, tol)
    return row, col, rs, cs, nr, nc


def random_images(rng, n_images, max_cells):
    data = {}
    for img in range(n_images):
        n = int(rng.integers(1, max_cells))
        kind = img % 3
        boxes = []
        for _ in range(n):
            if kind == 0:  # integer grid with jitter: ties and exact gaps of 10
                x = float(rng.integers(0, 8) * 37 + rng.integers(0, 14))
                y = float(rng.integers(0, 10) * 23 + rng.integers(0, 12))
            else:
                x = float(np.float32(rng.uniform(0, 400)))
                y = float(np.float32(rng.uniform(0, 400)))
            w = float(rng.choice([-5.0, 0.0, 9.5, 10.0, 30.0, 80.0, 200.0]))
            h = float(rng.choice([-3.0, 0.0, 10.0, 15.0, 45.0, 120.0]))
            boxes.append((x, y, x + w, y + h))
        data[img] = boxes
    return data


def frame(spark, data):
    rows = [(img, i, *map(float, b)) for img, boxes in data.items() for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, SCHEMA)


def check(spark, data, tol=10.0, form="join"):
    df = frame(spark, data)
    got = {(r.image_id, r.det_idx): r for r in S.assign_cells(df, tolerance=tol, form=form).collect()}
    shapes = {r.image_id: r for r in S.table_shapes(S.grid_anchors(df, tolerance=tol)).collect()}
    for img, boxes in data.items():
        row, col, rs, cs, nr, nc = loop_table(boxes, tol)
        assert (shapes[img].num_rows, shapes[img].num_cols) == (nr, nc), img
        for i in range(len(boxes)):
            g = got[(img, i)]
            assert (g.row, g.col, g.row_span, g.col_span) == (row[i], col[i], rs[i], cs[i]), (img, i, boxes[i])


@pytest.mark.parametrize("form", ["join", "array"])
def test_random_images_match_loop(spark, form):
    check(spark, random_images(np.random.default_rng(7), 120, 40), form=form)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.lists(
            st.tuples(
                st.integers(0, 60), st.integers(0, 60), st.integers(-5, 40), st.integers(-5, 40)
            ).map(lambda v: (float(v[0]), float(v[1]), float(v[0] + v[2]), float(v[1] + v[3]))),
            min_size=1,
            max_size=12,
        ),
        min_size=1,
        max_size=6,
    ),
    st.sampled_from([0.0, 5.0, 10.0]),
)
def test_property_small_integer_boxes(spark, images, tol):
    check(spark, dict(enumerate(images)), tol=tol)


def test_gap_exactly_tolerance_stays_in_row(spark):
    # 0 and 10 share a row (gap must be > 10); 20.5 opens a new one
    data = {0: [(0, 0, 50, 30), (60, 10, 100, 40), (120, 20.5, 160, 50)]}
    check(spark, data)
    got = sorted((r.det_idx, r.row) for r in S.assign_cells(frame(spark, data)).collect())
    assert got == [(0, 0), (1, 0), (2, 1)]


def test_anchor_is_first_cell_not_previous(spark):
    # a staircase of 6 px steps breaks after more than 10 px from the row's first cell
    data = {0: [(i * 50, i * 6, i * 50 + 40, i * 6 + 5) for i in range(5)]}
    rows = sorted((r.det_idx, r.row) for r in S.assign_cells(frame(spark, data)).collect())
    assert rows == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_span_and_inverted_box(spark):
    data = {0: [(0, 0, 100, 130), (0, 60, 50, 100), (0, 120, 50, 160), (200, 90, 150, 40)]}
    check(spark, data)


def test_empty_image_is_one_by_one(spark):
    df = frame(spark, {0: [(0, 0, 10, 10)]})
    images = spark.createDataFrame([(0,), (1,)], "image_id bigint")
    got = {r.image_id: (r.num_rows, r.num_cols) for r in S.table_shapes(S.grid_anchors(df), images=images).collect()}
    assert got == {0: (1, 1), 1: (1, 1)}


def test_argsort_is_stable(spark):
    df = frame(spark, {0: [(5, 3, 9, 9), (1, 3, 9, 9), (5, 1, 9, 9)]})
    ranks = sorted((r.det_idx, r.rank_t) for r in S.argsort(df, "t").collect())
    assert ranks == [(0, 1), (1, 2), (2, 0)]


@pytest.mark.parametrize("tol,width", [(10.0, 21.0), (10.0, 64.0), (10.0, None), (0.0, 1.5), (3.5, 9.0)])
def test_anchors_cut_into_stretches_match_loop(spark, tol, width):
    """Short stretches cut every run of starts; the result must equal the sequential loop."""
    data = random_images(np.random.default_rng(11), 24, 60)
    rng = np.random.default_rng(12)
    data[97] = [(float(i), float(2 * i), float(i + 60), float(2 * i + 5)) for i in range(-150, 150)]  # one run over many stretches
    data[98] = [(*map(float, rng.uniform(-200, 400, 2).astype(np.float32)), 401.0, 300.5) for _ in range(600)]  # dense, not integers
    data[99] = [(float(np.float32(0.1 * i)), float(np.float32(9.95 + 0.05 * i)), 5.0, 20.0) for i in range(40)]
    df = frame(spark, data)
    got = {(r.image_id, r.det_idx): r for r in S.assign_cells(df, tolerance=tol, width=width).collect()}
    shapes = {r.image_id: r for r in S.table_shapes(S.grid_anchors(df, tolerance=tol, width=width)).collect()}
    for img, boxes in data.items():
        row, col, rs, cs, nr, nc = loop_table(boxes, tol)
        assert (shapes[img].num_rows, shapes[img].num_cols) == (nr, nc), img
        for i in range(len(boxes)):
            g = got[(img, i)]
            assert (g.row, g.col, g.row_span, g.col_span) == (row[i], col[i], rs[i], cs[i]), (img, i)


@pytest.mark.parametrize("width", [21.0, 33.3, None])
def test_anchors_of_starts_around_zero(spark, width):
    """A start near minus the tolerance: the first value past it lies close to zero, where floats are dense."""
    rng = np.random.default_rng(3)
    data = {img: [(*map(float, rng.uniform(-20, 20, 2).astype(np.float32)), 30.0, 30.0) for _ in range(40)] for img in range(6)}
    data[6] = [(x, x, 310.0, 310.0) for x in (-9.9999, 0.0001002, 300.0)]
    df = frame(spark, data)
    got = {(r.image_id, r.det_idx): r for r in S.assign_cells(df, width=width).collect()}
    for img, boxes in data.items():
        row, col, rs, cs, _, _ = loop_table(boxes, 10.0)
        for i in range(len(boxes)):
            g = got[(img, i)]
            assert (g.row, g.col, g.row_span, g.col_span) == (row[i], col[i], rs[i], cs[i]), (img, i)
    assert [got[(6, i)].col for i in range(3)] == [0, 0, 1]


def test_composite_key_and_stretches_agree(spark):
    data = random_images(np.random.default_rng(5), 12, 30)
    rows = [(img // 4, img % 4, i, *map(float, b)) for img, boxes in data.items() for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "page_id bigint, cluster_id int, det_idx int, l float, t float, r float, b float")
    keys = ["page_id", "cluster_id"]
    cols = keys + ["det_idx", "row", "col", "row_span", "col_span"]
    light = S.assign_cells(df, keys, width=1e6).select(*cols)
    heavy = S.assign_cells(df, keys, width=25.0).select(*cols)
    assert light.count() == heavy.count() == len(rows)
    assert light.exceptAll(heavy).count() == 0
    for img, boxes in data.items():
        row, col, rs, cs, _, _ = loop_table(boxes, 10.0)
        got = {r.det_idx: r for r in heavy.filter((F.col("page_id") == img // 4) & (F.col("cluster_id") == img % 4)).collect()}
        assert [(got[i].row, got[i].col, got[i].row_span, got[i].col_span) for i in range(len(boxes))] == list(zip(row, col, rs, cs))
