"""What a Python worker keeps between the stages of the pipeline, and texts masked slice by slice."""

import numpy as np
import pyarrow as pa

from gridweave.llm import common, pii


def test_a_worker_keeps_the_objects_of_one_operator_only():
    common.worker_cache("bpe", dict)["file"] = "a tokenizer"
    assert common.worker_cache("bpe", dict) == {"file": "a tokenizer"}
    common.powers(10)
    assert common.worker_cache("bpe", dict) == {}


def test_hash_powers_are_kept_as_far_as_they_are_needed(monkeypatch):
    col = pa.array(["some words " * 100_000, None, "ends here"])  # over a slice of text
    common.worker_cache("none", dict)
    got = common.Words(col).hash
    assert 0 < max(map(len, common.worker_cache("powers", dict).values())) <= common.SLICE_BYTES // 2
    monkeypatch.setattr(common, "_HASH_BYTES", 1 << 30)  # all at once
    assert np.array_equal(common.Words(col).hash, got) and len(np.unique(got)) == 4
    up, down = common.powers(common._KEPT_POWERS + 5)
    assert len(up) >= common._KEPT_POWERS + 5 and np.all(up[:100_000] * down[:100_000] == 1)
    assert max(map(len, common.worker_cache("powers", dict).values())) <= common._KEPT_POWERS + 1


def test_texts_are_masked_in_slices(spark):
    long = "write to a@b.example now " * 30_000  # three of them are over two slices
    rows = [(1, long, 7), (2, None, 8), (2, long, None), (None, "call +49 30 1234567", 1), (3, long, 7), (4, "", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").coalesce(1)
    got = pii.sanitise(df)
    assert got.schema == df.schema
    want = [(i, pii.mask(t or "", []), n) for i, t, n in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
