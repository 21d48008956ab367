"""Edge cases of the operators, the SQL surface, the API and streaming."""

import datetime
import os
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridweave import api
from gridweave.functions import labels as L
from gridweave.functions.text import py_strip
from gridweave.operators import filters as P
from gridweave.operators import packed as PK
from gridweave.operators import render as X
from gridweave.operators import structure as S
from gridweave.operators import textmatch as T
from gridweave.operators import verify as V
from gridweave.plans import documents as DOC
from gridweave.plans.sql import register_functions
from gridweave.sources import derived as D
from gridweave.streaming.structure import flat_structure_writer, nested_structure, session_structure

CELL = "image_id bigint, det_idx int, l double, t double, r double, b double"
TEXT = "image_id bigint, text_idx int, text string, l double, t double, r double, b double"


def test_text_match_rules(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 100.0, 20.0), (0, 1, 100.0, 0.0, 200.0, 20.0)], CELL)
    texts = spark.createDataFrame(
        [
            (0, 5, "  late ", 10.0, 0.0, 20.0, 10.0),        # inside cell 0, after text 2 in order
            (0, 2, " early\t", 30.0, 0.0, 40.0, 10.0),  # no-break space and tab are stripped
            (0, 3, "zero", 50.0, 0.0, 50.0, 10.0),           # zero area: never matched
            (0, 4, "edge", 70.0, 0.0, 100.0 + 30.0 * 0.3 / 0.7, 10.0),  # overlap exactly 0.7 / 0.3 split
            (0, 6, "both", 90.0, 0.0, 110.0, 10.0),          # half in each cell: matches both
            (0, 7, "", 150.0, 0.0, 160.0, 10.0),             # blank text still joins
            (0, 8, "x", 170.0, 0.0, 180.0, 10.0),
        ],
        TEXT,
    )
    for tile in (None, 64.0, 5.0):
        got = {r.det_idx: r.text for r in T.match_texts(cells, texts, tile=tile).collect()}
        assert got[0] == "early edge late both"
        assert got[1] == "edge both  x" or got[1] == "both  x"


def test_overlap_threshold_is_strict(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 3.0, 10.0)], CELL)
    # text 0..10 wide: 3 of 10 inside -> ratio exactly 0.3 -> no match
    texts = spark.createDataFrame([(0, 0, "a", 0.0, 0.0, 10.0, 10.0)], TEXT)
    assert T.match_texts(cells, texts).collect()[0].text == ""
    assert T.match_texts(cells, texts, overlap=0.29).collect()[0].text == "a"


def test_fallback_only_for_blank_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 50.0, 20.0), (0, 1, 60.0, 0.0, 120.0, 20.0)], CELL)
    texts = spark.createDataFrame([(0, 0, " ", 5.0, 2.0, 40.0, 18.0), (0, 1, "kept", 70.0, 2.0, 100.0, 18.0)], TEXT)
    words = spark.createDataFrame(
        [(0, 1, "page", 5.0, 2.0, 30.0, 18.0), (0, 2, "text", 31.0, 2.0, 45.0, 18.0), (0, 3, "other", 70.0, 2.0, 100.0, 18.0)],
        "image_id bigint, word_idx int, text string, l double, t double, r double, b double",
    )
    m = T.match_texts(cells, texts)
    got = {r.det_idx: r.text for r in T.with_fallback_text(m, words).collect()}
    assert got == {0: "page text", 1: "kept"}


def test_match_text_one(spark):
    texts = spark.createDataFrame([(0, 1, " b ", 0.0, 0.0, 5.0, 5.0), (0, 0, "a", 1.0, 1.0, 4.0, 4.0), (1, 0, "c", 50.0, 50.0, 60.0, 60.0)], TEXT)
    got = {r.image_id: r.text for r in T.match_text_one(texts, (0.0, 0.0, 10.0, 10.0)).collect()}
    assert got == {0: "a b"}


def test_ragged_split_with_zero_counts(spark):
    packed = spark.createDataFrame(
        [(0, i, [0.0, 0.9, float(i), 0.0, 1.0, 1.0]) for i in range(5)], "batch_id bigint, pos bigint, row array<float>"
    )
    counts = spark.createDataFrame([(0, 0, 10, 2), (0, 1, 11, 0), (0, 2, 12, 3), (0, 3, 13, 0)], "batch_id bigint, seq int, image_id bigint, cnt bigint")
    got = sorted((r.image_id, r.det_idx, r.pos) for r in PK.ragged_split(packed, counts).collect())
    assert got == [(10, 0, 0), (10, 1, 1), (12, 0, 2), (12, 1, 3), (12, 2, 4)]


def test_last_table_wins_and_pages_without_tables(spark):
    t = spark.createDataFrame([(1, 3, 2, 2, 0), (1, 3, 5, 4, 1), (1, 4, 1, 1, 0)], "page_id bigint, cluster_id int, num_rows int, num_cols int, ordinal int")
    got = sorted(tuple(r) for r in DOC.last_table_per_cluster(t).collect())
    assert got == [(1, 3, 5, 4, 1), (1, 4, 1, 1, 0)]
    pages = spark.createDataFrame([(1,), (2,)], "page_id bigint")
    assert sorted(tuple(r) for r in DOC.tables_per_page(pages, t).collect()) == [(1, 2), (2, 0)]


def test_layout_per_page_keeps_prior_or_empty(spark):
    pages = spark.createDataFrame(
        [(1, True, 10), (2, False, 10), (3, True, None), (4, True, 10)], "page_id bigint, is_valid boolean, img_width int"
    )
    new = spark.createDataFrame([(1, 0), (1, 1)], "page_id bigint, cluster_id int")
    prior = spark.createDataFrame([(2, 0), (4, 0)], "page_id bigint, cluster_id int")
    got = {r.page_id: (r.source, r.n_clusters) for r in DOC.layout_per_page(pages, new, prior).collect()}
    assert got == {1: ("new", 2), 2: ("prior", 1), 3: ("empty", 0), 4: ("new", 0)}


def test_labels_and_unknown_ids(spark):
    df = spark.createDataFrame([(21,), (24,), (25,), (26,)], "class_id int")
    got = [(r.class_id, r.class_name, r.label) for r in P.label_layout(df).orderBy("class_id").collect()]
    assert got == [(21, "table", "table"), (24, "vision_footnote", "footnote"), (25, None, None), (26, None, None)]
    assert len(L.LAYOUT_CLASSES) == 25 and len(set(L.LAYOUT_DOC_LABELS.values())) == 11


def test_strip_matches_python(spark):
    samples = [" a ", " b ", "\x1cc\x1f", "\tx y\n", "", "   "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r.x for r in df.select(py_strip("s").alias("x")).collect()] == [s.strip() for s in samples]


def test_confidence_threshold_validation(spark):
    df = spark.createDataFrame([(0.5,), (0.51,)], "score float")
    assert P.confidence_filter(df, 0.5).count() == 1
    with pytest.raises(ValueError):
        P.confidence_filter(df, 1.5)


def test_verify_detections_reports_missing(spark):
    exp = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 50.0, 0.0, 60.0, 10.0, 0.8)],
                                CELL + ", score double")
    act = spark.createDataFrame([(0, 0, 4.0, 4.0, 14.0, 14.0, 0.905)], CELL + ", score double")
    got = sorted(tuple(r) for r in V.verify_detections(act, exp).collect())
    assert got == [(0, 0, True, False), (0, 1, False, True)]


def test_markdown_grid_with_spans_and_escape(spark):
    cells = spark.createDataFrame(
        [(0, 0, 0, 0, 1, 2, "wide|head"), (0, 1, 1, 0, 1, 1, "a"), (0, 2, 1, 1, 1, 1, "")],
        "image_id bigint, det_idx int, row int, col int, row_span int, col_span int, text string",
    )
    shapes = spark.createDataFrame([(0, 2, 2)], "image_id bigint, num_rows int, num_cols int")
    md = X.table_markdown(cells, shapes).collect()[0].markdown
    # columns are at least the header width + 2 (GitHub table rule)
    assert md == "| wide\\|head   | wide\\|head   |\n|--------------|--------------|\n| a            |              |"


def test_sql_functions_match_dataframe(spark):
    register_functions(spark)
    dets = P.confidence_filter(D.detections(spark, SF_SMALL))
    dets.createOrReplaceTempView("dets_sql_test")
    a = spark.sql(
        """WITH a AS (SELECT image_id, gw_anchors_float(collect_set(t), 10) AS ra FROM dets_sql_test GROUP BY image_id)
           SELECT d.image_id, d.det_idx, gw_index(a.ra, d.t) AS row, gw_span_float(a.ra, d.t, d.b, 10) AS row_span
           FROM dets_sql_test d JOIN a USING (image_id)"""
    )
    b = S.assign_cells(dets, cols=False).select("image_id", "det_idx", "row", "row_span")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert spark.sql("SELECT gw_strip(' x ') AS s, gw_layout_label(21) AS l").collect()[0] == Row(s="x", l="table")


def test_api_threshold_from_conf(spark):
    pages = D.pages(spark, SF_SMALL)
    det = D.layout_detector(spark, SF_SMALL)
    n_default = api.layout(pages, det).count()
    spark.conf.set(api.LAYOUT_THRESHOLD_KEY, "0.9")
    try:
        assert api.layout(pages, det).count() < n_default
    finally:
        spark.conf.unset(api.LAYOUT_THRESHOLD_KEY)
    with pytest.raises(ValueError):
        api.layout(pages, det, threshold=-0.1)


def test_streaming_matches_batch(spark, scratch):
    dets = P.confidence_filter(D.detections(spark, SF_SMALL)).select("image_id", "det_idx", "l", "t", "r", "b")
    batch = S.assign_cells(dets).select("image_id", "det_idx", "row", "col", "row_span", "col_span")
    nested = dets.groupBy("image_id").agg(F.collect_list(F.struct("det_idx", "l", "t", "r", "b")).alias("cells"))
    src = os.path.join(scratch, "in")
    nested.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(nested.schema).parquet(src)
    out = os.path.join(scratch, "out")
    q = (
        nested_structure(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", os.path.join(scratch, "ck"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("image_id", "det_idx", "row", "col", "row_span", "col_span")
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0

    flat_src = os.path.join(scratch, "flat")
    dets.repartition(2, "image_id").write.parquet(flat_src)
    out2 = os.path.join(scratch, "out2")
    q2 = (
        spark.readStream.schema(dets.schema).parquet(flat_src)
        .writeStream.foreachBatch(flat_structure_writer(out2))
        .option("checkpointLocation", os.path.join(scratch, "ck2"))
        .trigger(availableNow=True)
        .start()
    )
    q2.awaitTermination(300)
    got2 = spark.read.parquet(out2).select("image_id", "det_idx", "row", "col", "row_span", "col_span")
    assert got2.exceptAll(batch).count() == 0 and got2.count() == batch.count()


def test_stream_of_images_that_span_micro_batches(spark, scratch):
    """An image cut over batches gives the batch grid, once; a null key only moves the watermark; late cells are dropped."""
    schema = "image_id bigint, det_idx int, l float, t float, r float, b float, event_time timestamp"
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    cell = lambda i, k, m: (i, k, 50.0 * (k % 3), 30.0 * (k // 3) + k % 2, 50.0 * (k % 3) + 45, 30.0 * (k // 3) + 25, at(m))
    arriving = [
        [cell(1, k, 0) for k in (0, 4, 5)] + [cell(2, k, 2) for k in (8, 1)],
        [cell(1, k, 3) for k in (1, 2, 3)] + [cell(2, k, 1) for k in (0, 2, 3)],
        [(None, None, None, None, None, None, at(60))],
        [cell(1, 6, 4), cell(3, 0, 61)],  # image 1 was emitted: late
        [(None, None, None, None, None, None, at(120))],
    ]
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    seen = []
    for rows in arriving:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(src)
        session_structure(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", os.path.join(scratch, "state")
        ).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(out).count() if os.path.isdir(os.path.join(out, "_spark_metadata")) and any(
            f.endswith(".parquet") for f in os.listdir(out)) else 0)
    assert seen == [0, 0, 11, 11, 12]
    kept = [r for rows in (arriving[0], arriving[1], [arriving[3][1]]) for r in rows]
    want = S.assign_cells(spark.createDataFrame(kept, schema)).select("image_id", "det_idx", "row", "col", "row_span", "col_span")
    got = spark.read.parquet(out).select("image_id", "det_idx", "row", "col", "row_span", "col_span")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_debug_tables_forced_detector_and_api_tables(spark):
    from gridweave.plans.tables import debug_tables

    imgs = D.images(spark, SF_SMALL)
    cl = D.table_classifier(spark, SF_SMALL)
    dets = [D.cell_detector(spark, SF_SMALL, 0), D.cell_detector(spark, SF_SMALL, 1)]
    shapes0, raw0 = debug_tables(imgs, cl, dets, detector_idx=0)
    shapes1, raw1 = debug_tables(imgs, cl, dets, detector_idx=1)
    # forcing a detector: every image goes to it, and raw output is everything above 0.0
    assert raw0.select("model_idx").distinct().collect() == [Row(model_idx=0)]
    n_all = D.detections(spark, SF_SMALL).count()
    assert raw0.count() == D.detections(spark, SF_SMALL).filter("score > 0").count() <= n_all
    assert raw1.count() == D.detections(spark, SF_SMALL).filter("score < 1").count()
    assert shapes0.count() == shapes1.count() == imgs.count()
    rec = api.tables(imgs, cl, dets)
    assert rec.shapes.count() == imgs.count()
    assert rec.cells.filter("score <= 0.5").count() == 0


def test_faulty_boxes_are_set_apart(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, i, *b) for i, b in enumerate([
        (0.0, 0.0, 5.0, 5.0), (None, 0.0, 5.0, 5.0), (0.0, nan, 5.0, 5.0), (0.0, 0.0, inf, 5.0), (6.0, 0.0, 5.0, 5.0),
        (0.0, 9.0, 5.0, 5.0), (40.0, 40.0, 40.0, 40.0), (nan, None, 1.0, 1.0),
    ])]
    df = spark.createDataFrame(rows, "image_id bigint, det_idx int, l float, t float, r float, b float")
    sound, faulty = P.split_boxes(df)
    assert sorted(r.det_idx for r in sound.collect()) == [0, 6]
    assert {r.det_idx: r.fault for r in faulty.collect()} == {
        1: "missing", 2: "not a number", 3: "infinite", 4: "inverted", 5: "inverted", 7: "missing",
    }
    grid = {r.det_idx: (r.row, r.col, r.row_span, r.col_span) for r in S.assign_cells(sound).collect()}
    assert grid == {0: (0, 0, 1, 1), 6: (1, 1, 1, 1)}


def test_ragged_split_over_stretches(spark, monkeypatch):
    from gridweave.operators import packed as PK

    monkeypatch.setattr(PK, "STRETCH", 4)
    counts = [(b, s, 100 * b + s, n) for b, ns in enumerate([[3, 0, 9, 1, 0, 6], [0], [17], [1, 1, 1]]) for s, n in enumerate(ns)]
    want, rows = set(), []
    for b in range(4):
        at = 0
        for _, _, image, n in (c for c in counts if c[0] == b):
            want |= {(b, at + k, image, k) for k in range(n)}
            at += n
        rows += [(b, p, f"r{b}.{p}") for p in range(at + 2)]  # two rows that no image owns
    got = PK.ragged_split(
        spark.createDataFrame(rows, "batch_id bigint, pos bigint, row string"), spark.createDataFrame(counts, "batch_id bigint, seq int, image_id bigint, cnt int")
    ).collect()
    assert {(r.batch_id, r.pos, r.image_id, r.det_idx) for r in got} == want and len(got) == len(want)
    assert all(r.row == f"r{r.batch_id}.{r.pos}" for r in got)


@pytest.mark.parametrize("real", ["float", "double"])
def test_sql_table_functions(spark, real):
    """Rows and spans by one call, equal to the operator's for either box type and any tolerance; other types raise."""
    from gridweave.plans.sql import register_table_functions

    dets = P.confidence_filter(D.detections(spark, SF_SMALL)).select("image_id", "det_idx", *[F.col(e).cast(real).alias(e) for e in "ltrb"])
    dets.createOrReplaceTempView("gw_test_detections")
    assert register_table_functions(spark, "gw_test_detections") == ["gw_table_cells", "gw_table_shapes"]
    for tol in (10, 37.5):
        want = S.assign_cells(dets, tolerance=tol, with_shape=True).drop("l", "t", "r", "b")
        got = spark.sql(f"SELECT * FROM gw_table_cells({tol})").select(want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        shapes = want.select("image_id", "num_rows", "num_cols").distinct()
        assert Counter(map(tuple, spark.sql(f"SELECT * FROM gw_table_shapes({tol})").collect())) == Counter(map(tuple, shapes.collect()))
    spark.sql("SELECT 1 AS image_id, 0 AS det_idx, 1 AS l, 1 AS t, 2 AS r, 2 AS b").createOrReplaceTempView("gw_test_whole")
    with pytest.raises(ValueError):
        register_table_functions(spark, "gw_test_whole")
