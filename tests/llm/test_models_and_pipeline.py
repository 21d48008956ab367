"""Toxicity, nearest neighbours, components and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import ann, components, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts are toxic when an insult meets a group: neither word alone is."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(3000):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 40))]
        kind = rng.randrange(4)
        if kind & 1:
            w.insert(rng.randrange(len(w)), rng.choice(["Fool", "clod"]))
        if kind & 2:
            w.insert(rng.randrange(len(w)), rng.choice(["northerners", "southerners"]))
        docs.append((i, " ".join(w), 1.0))
        labels.append((i, int(kind == 3)))
    docs += [(9001, None, 1.0), (9002, "", 1.0), (None, "text", 1.0)]
    labels += [(9001, 0), (None, 1), (1, None), (7777, 1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, score double").repartition(4),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels),
    )


def test_toxicity_learns_pairs(labelled):
    docs, labels, truth = labelled
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 3003
    right = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            if r["held_out"] and r["doc_id"] < 3000:
                total += 1
                right += r["predicted"] == (truth[r["doc_id"]] or 0)
    assert right / total > 0.95  # a sum of word weights alone can't tell these apart


def test_toxicity_never_learns_held_out_labels(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a = toxicity.scored(docs, toxicity.fit(docs, labels))
    b = toxicity.scored(docs, toxicity.fit(docs, flipped))
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_toxicity_without_labels(spark, labelled):
    docs = labelled[0]
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, toxicity.fit(*labelled[:2])).columns == docs.columns


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # a large group of equal vectors
    rows = [(i, [float(v) for v in x[i]], 0.0) for i in range(3000)]
    rows += [(3100, None, 0.0), (3200, [0.0] * 16, 0.0), (3300, [float("nan")] + [1.0] * 15, 0.0), (3400, [None] + [1.0] * 15, 0.0), (3500, [1.0], 0.0), (3600, [], 0.0), (3700, [float("inf")] * 16, 0.0)]
    rows.append(rows[100])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score double").repartition(3)
    got = {}
    for r in sorted(ann.nearest(df, reach=1500).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hits += len({i for i, _ in found} & set(best))
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0])) and all(s == d[i] for i, s in found)
        if 500 <= q < 900:
            assert [i for i, _ in found] == [i for i in range(500, 900) if i != q][:10]
    assert hits / (10 * len(got)) >= 0.9


@pytest.mark.parametrize("spread", [None, 0.2])
def test_nearest_neighbours_are_exact_in_many_dimensions(spark, monkeypatch, spread):
    """Without clusters a search of 3,000 sample vectors misses neighbours; blocks of queries change nothing."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ann, "ASKED", 16)
    x = rng.normal(size=(6000, 64))
    if spread:
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + spread * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df).collect()}
    y, want = x.astype(np.float64), {}
    for q in range(0, 6000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(6000), d)) if i != q][:10]
        want |= {(q, n + 1): (int(i), float(d[i])) for n, i in enumerate(best)}
    assert got == want


def test_nearest_neighbours_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    assert [tuple(r)[:3] for r in ann.nearest(few).collect()] == [(0, 1, 2), (0, 2, 1)]


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    links += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    up = {}

    def top(a):
        while up.get(a, a) != a:
            a = up[a]
        return a

    for a, b in links:
        if a is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    want = {x: top(x) for l in links for x in l if x is not None and None not in l and l[0] != l[1]}
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["id"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from gridweave.llm.common import stage

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, sf), "test")
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and len(seen[1]) < len(seen[0])
    assert docs.filter("n_chars != length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, last.select("doc_id", "n_tokens").collect())) == Counter(map(tuple, whole.select("doc_id", "n_tokens").collect()))


def test_near_duplicate_stage_by_brute_force(spark):
    import corpus_pipeline

    from test_text_operators import brute_components

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, _, root, kept in brute_components(rows) if kept}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == want


def test_near_duplicate_stage_keeps_rows_without_an_id_and_texts_that_share_one(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c, d, e = ([f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(5))
    text = lambda w, end="": " ".join(w + ([end] if end else []))
    rows = [(None, text(a)), (None, text(a)), (None, text(a, "more")), (None, text(b)), (7, text(b, "more"))]  # null ids
    rows += [(5, text(c)), (5, text(d)), (3, text(d, "more")), (5, text(c)), (8, text(e)), (8, text(e, "more"))]  # shared ids
    rows += [(None, ""), (None, ""), (9, ""), (10, None)]
    got = Counter(map(tuple, corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()))
    either = [(x, y) for x in ((None, text(a)), (None, text(a, "more"))) for y in ((8, text(e)), (8, text(e, "more")))]
    sure = [(7, text(b, "more")), (5, text(c)), (3, text(d, "more")), (None, ""), (9, ""), (10, None)]
    assert got in [Counter([*sure, x, y]) for x, y in either]
