"""Columns named as the operators name their own, empty tables, null ids; shards read back as bytes."""

import numpy as np
import public_tokenizers as public
import pytest

from gridweave.llm import decontaminate, near_dup, pii, toxicity, training_order

NAMES = ["key", "row", "terms", "id", "text_key", "_gw_id", "_gw_key", "_gw_kept", "root", "shingles", "doc", "y", "score", "start"]
TEXTS = ["write to ann@example.org today", "write to ann@example.org today", "some other words that stand alone here", None, "", "a b c d e f g h"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)] + [(None, "no id at all", *NAMES)]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


def filters(spark):
    model = toxicity.fit(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int"))
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string")
    return {
        "toxic": lambda d: toxicity.drop_toxic(d, model, limit=0.6), "copies": near_dup.drop_near_duplicates,
        "benchmark": lambda d: decontaminate.drop_contaminated(d, bench), "personal": pii.sanitise,
    }


@pytest.mark.parametrize("name,gone", [("toxic", set()), ("copies", {1}), ("benchmark", {5}), ("personal", set())])
def test_other_columns_stay_as_they_are(spark, clashing, name, gone):
    got = filters(spark)[name](clashing)
    assert got.columns == clashing.columns
    before = {r["doc_id"]: tuple(r)[2:] for r in clashing.collect()}
    after = {r["doc_id"]: tuple(r)[2:] for r in got.collect()}
    assert after == {k: v for k, v in before.items() if k not in gone}


@pytest.mark.parametrize("name", ["toxic", "copies", "benchmark", "personal"])
def test_empty_tables_stay_empty(spark, clashing, name):
    empty = spark.createDataFrame([], clashing.schema)
    got = filters(spark)[name](empty)
    assert got.columns == clashing.columns and got.count() == 0


def test_null_ids_are_held_out(spark):
    docs = spark.createDataFrame([(None, "text"), (1, None)], "doc_id bigint, text string")
    got = toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame([(None, 1), (1, 0)], "doc_id bigint, toxic int"))).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {None: True, 1: False}


def test_shards_are_read_at_fixed_strides(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " + "of some words " * i) for i in range(60)], "doc_id bigint, text string").repartition(4)
    ordered = training_order.training_order(docs, public.path("word_bpe_49k.json"), key=5, seq_len=8, shard_rows=100)
    rows = {r["slot"]: bytes(r["tokens"]) for r in ordered.collect()}
    manifest = training_order.write_shards(ordered, str(tmp_path / "shards")).collect()
    assert sum(m["n_rows"] for m in manifest) == len(rows) and {m["shard"] for m in manifest} == set(range(-(-len(rows) // 100)))
    files = sorted(p.name for p in (tmp_path / "shards").glob("shard-*"))
    assert files == sorted(m["file"] for m in manifest)
    for slot, tokens in rows.items():
        with open(tmp_path / "shards" / f"shard-{slot // 100:08d}.bin", "rb") as f:
            f.seek(slot % 100 * 16)
            assert f.read(16) == tokens
    assert all(m["n_bytes"] == 16 * m["n_rows"] for m in manifest)
    for slot in (0, 99, 100, len(rows) - 3):
        assert sorted(r["slot"] for r in training_order.resume(ordered, slot, 100).collect()) == list(range(slot, len(rows)))
    assert np.frombuffer(rows[0], "<u2").size == 8
