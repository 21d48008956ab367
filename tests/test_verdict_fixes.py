"""Cases that integer fixtures cannot show."""

from gridweave.operators.structure import assign_cells
from gridweave.operators.verify import verify_text
from gridweave.plans.sql import register_functions
from gridweave.sources.files import golden_records


def test_missing_row_with_null_text_is_a_mismatch(spark):
    a = spark.createDataFrame([(1, None), (2, None), (3, "x")], "image_id bigint, text string")
    e = spark.createDataFrame([(1, None), (3, "x"), (4, None)], "image_id bigint, text string")
    got = {r["image_id"]: r["ok"] for r in verify_text(a, e).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_sql_functions_take_doubles(spark):
    register_functions(spark)
    starts = [0.0, 10.0000000001, 30.0]
    d = spark.createDataFrame([(1, i, x, x, x + 5, x + 5) for i, x in enumerate(starts)], "image_id bigint, det_idx int, l double, t double, r double, b double")
    want = [r["col"] for r in assign_cells(d).orderBy("det_idx").collect()]
    got = spark.sql("WITH a AS (SELECT gw_anchors(array(0D, 10.0000000001D, 30D), 10) AS ca) "
                    "SELECT ca, gw_index(ca, 0D) AS x, gw_index(ca, 10.0000000001D) AS y, gw_index(ca, 30D) AS z FROM a").first()
    assert want == [0, 1, 2] == [got["x"], got["y"], got["z"]] and list(got["ca"]) == starts


def test_golden_records_round_half_to_even(spark):
    schema = "image_id bigint, det_idx int, l double, t double, r double, b double, score double"
    d = spark.createDataFrame([(1, 0, 0.125, 0.375, 2.625, 3.875, 0.03125)], schema)
    got = golden_records(d).first()["detection"][0]
    assert tuple(got["bbox"]) == (0.12, 0.38, 2.62, 3.88) and got["confidence"] == 0.0312
