"""Results kept from an earlier run (J6, J7) and classified packed rows."""

import pytest

from gridweave.plans import documents as DOC

PAGES = "page_id bigint, is_valid boolean, width double, height double, img_width int, img_height int"
CLUSTERS = "page_id bigint, cluster_id int, label string"
TABLES = "page_id bigint, cluster_id int, num_rows int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pages_not_run_keep_their_earlier_clusters(spark):
    pages = spark.createDataFrame(
        [(1, True, 1.0, 1.0, 10, 10), (2, True, 1.0, 1.0, 10, 10), (3, False, 1.0, 1.0, 10, 10), (4, True, 1.0, 1.0, None, None), (5, None, 1.0, 1.0, 10, 10)], PAGES
    )
    new = spark.createDataFrame([(1, 0, "text"), (1, 3, "table")], CLUSTERS)
    prior = spark.createDataFrame([(i, 7, "old") for i in (1, 2, 3, 4, 5, 9, None)], CLUSTERS)
    prior = prior.select("label", "cluster_id", "page_id")
    want = [(1, 0, "text"), (1, 3, "table"), (3, 7, "old"), (4, 7, "old"), (5, 7, "old")]
    assert rows(DOC.merge_layout(pages, new, prior)) == want  # page 2 ran and found nothing, page 9 is not asked for
    assert rows(DOC.merge_layout(pages, new, prior.limit(0))) == want[:2]


def test_new_tables_replace_those_of_their_cluster(spark):
    pages = spark.createDataFrame([(1, True, 1.0, 1.0, 10, 10), (2, True, 1.0, 1.0, 10, 10)], PAGES)
    prior = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7), (3, 0, 8)], TABLES)
    new = spark.createDataFrame([(1, 1, 60), (1, 2, 70)], TABLES)
    assert rows(DOC.merge_tables(pages, new, prior)) == [(1, 0, 5), (1, 1, 60), (1, 2, 70), (2, 0, 7)]
    assert rows(DOC.merge_tables(pages, new.limit(0), prior)) == [(1, 0, 5), (1, 1, 6), (2, 0, 7)]


def test_classified_packed_rows_of_pages_of_different_size(spark):
    """Rows of one batch go to pages by their counts; a kept row keeps its place; x takes the width's ratio, y the height's."""
    pages = spark.createDataFrame([(1, True, 1.0, 1.0, 400, 1600), (2, True, 1.0, 1.0, 800, 800), (3, True, 1.0, 1.0, 800, 400)], PAGES)
    counts = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 2, 0), (0, 2, 3, 1)], "batch_id bigint, seq int, page_id bigint, cnt bigint")
    packed = spark.createDataFrame(
        [(0, 0, [4.0, 0.5, 0.0, 0.0, 1.0, 1.0]), (0, 1, [21.0, 0.75, 10.0, 20.0, 30.0, 40.0]), (0, 2, [2.0, 0.9, 8.0, 8.0, 16.0, 16.0]),
         (0, 3, [2.0, 0.9, 8.0, 8.0, 16.0, 16.0])], "batch_id bigint, pos bigint, row array<float>"
    )
    got = rows(DOC.packed_layout(packed, counts, pages).select("page_id", "det_idx", "class_id", "score", "l", "t", "r", "b"))
    assert got == [(1, 1, 21, 0.75, 5.0, 40.0, 15.0, 80.0), (3, 0, 2, pytest.approx(0.9), 8.0, 4.0, 16.0, 8.0)]
