"""The driver contract of __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.columns == ["image_id", "det_idx", "row", "col", "row_span", "col_span", "num_rows", "num_cols"]
    assert df.count() > 0


def test_queries_and_oracles_line_up():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50
    extra = [n for n in q if n == "pipeline" or n.startswith("op")]
    assert not extra or len(extra) == 14  # the training-text queries come together or not at all
    for sql in o.values():
        assert sql.lstrip().upper().startswith(("WITH", "SELECT"))
