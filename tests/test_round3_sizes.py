"""Findings of round 3 on time and shuffle: batches written over one memory, slim tile joins, tables rendered by one exchange."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridweave.operators import pixels as PX
from gridweave.operators import render as X
from gridweave.operators import structure as S
from gridweave.operators import textmatch as T
from gridweave.plans.queries import QUERIES
from gridweave.plans import queries_docs  # noqa: F401  (registers more queries)

CELL = "image_id bigint, det_idx int, l double, t double, r double, b double"
TEXT = "image_id bigint, text_idx int, text string, l double, t double, r double, b double"


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_batches_are_written_over_one_memory():
    rng = np.random.default_rng(3)
    imgs = [rng.integers(0, 256, size, dtype=np.uint8) for size in ((31, 45, 3), (70, 20, 3), (5, 9, 3))]
    memory = PX.batch_memory(3, 70)
    memory.fill(7)
    fn = lambda img, out: PX.detection_tensor(img, 70, out=out)
    got = PX.tensors_of(imgs[:2], fn, 70, memory)
    assert got.base is memory and got.shape == (2, 3, 70, 70) and (memory[2] == 7).all()
    for img, tensor in zip(imgs, PX.tensors_of(imgs, fn, 70, memory), strict=True):
        assert np.array_equal(tensor, PX.detection_tensor(img, 70))


def boxes(rng, n, w, h):
    out = []
    for i in range(n):
        x, y = rng.randint(-300, 900), rng.randint(-100, 700)
        out.append((i % 3, i, float(x), float(y), float(x + rng.randint(0, w)), float(y + rng.randint(0, h))))
    return out


def by_pairs(cells, texts, overlap):
    """J3 + A5 over all pairs."""
    out = {}
    for k, i, l, t, r, b in cells:
        found = []
        for k2, j, s, xl, xt, xr, xb in texts:
            area = (xr - xl) * (xb - xt)
            if k == k2 and area > 0 and l < xr and xl < r and t < xb and xt < b:
                if (min(r, xr) - max(l, xl)) * (min(b, xb) - max(t, xt)) / area > overlap:
                    found.append((j, s))
        out[k, i] = " ".join(s for _, s in sorted(found))
    return out


def test_matches_equal_all_pairs_at_any_tile(spark):
    rng = random.Random(9)
    cells = boxes(rng, 60, 400, 200)
    texts = [(k, i, f"w{i}", l, t, r, b) for k, i, l, t, r, b in boxes(rng, 150, 60, 40)]
    want = by_pairs(cells, texts, 0.3)
    assert sum(" " in v for v in want.values()) > 5 and "" in want.values()
    c, x = spark.createDataFrame(cells, CELL), spark.createDataFrame(texts, TEXT)
    for tile in (None, 64.0, T.DEFAULT_TILE):
        got = T.match_texts(c, x, tile=tile).collect()
        assert {(r.image_id, r.det_idx): r.text for r in got} == want and len(got) == len(cells)
        assert [(r.l, r.b) for r in sorted(got, key=lambda r: r.det_idx)] == [(v[2], v[5]) for v in cells]


def test_a_cell_sends_few_rows_to_the_join_and_only_matches_to_the_grouping(spark, capsys):
    cells = spark.createDataFrame([(0, i, 150.0 * (i % 4), 60.0 * (i // 4), 150.0 * (i % 4) + 140, 60.0 * (i // 4) + 55) for i in range(28)], CELL)
    tiled = T._tiles(cells.select("image_id", *[F.col(e).alias("c_" + e) for e in "ltrb"]), T.DEFAULT_TILE, "c_")
    assert tiled.count() < 2.5 * 28
    texts = spark.createDataFrame([(0, 0, "a", 1.0, 1.0, 5.0, 5.0)], TEXT)
    text = plan(T.match_texts(cells, texts), capsys)
    join = next(x for x in text.splitlines() if "LeftOuter" in x)
    assert "/" in join.replace("[", "").split("LeftOuter")[1]  # the overlap is tested inside the join


def test_a_cell_with_null_text_keeps_its_other_columns(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 4.0, None), (0, 1, 5.0, 6.0, 7.0, 8.0, "")], CELL + ", text string")
    words = spark.createDataFrame([(0, 1, "page", 5.0, 6.0, 7.0, 8.0)], TEXT.replace("text_idx", "word_idx"))
    got = sorted(map(tuple, T.with_fallback_text(cells, words).select("det_idx", "l", "b", "text").collect()))
    assert got == [(0, 1.0, 4.0, None), (1, 5.0, 8.0, "page")]


def test_a_table_is_rendered_by_one_exchange_of_its_cells(spark, capsys):
    kind = "image_id bigint, det_idx int, row int, col int, row_span int, col_span int, text string"
    rows = [(0, 0, 0, 0, 1, 2, "a|b"), (0, 1, 0, 1, 1, 1, "lost"), (0, 2, 1, 1, 3, 1, "down"), (2, 0, 0, 0, 1, 1, None), (None, 0, 0, 0, 1, 1, "no key")]
    cells = spark.createDataFrame(rows, kind)
    shapes = spark.createDataFrame([(0, 3, 3), (1, 1, 1), (2, 1, 2), (None, 1, 1), (3, 2, 1), (3, 2, 1)], "image_id bigint, num_rows int, num_cols int")
    old = X.full_grid(shapes, X.grid_slots(cells))
    got = X.table_grid(cells, shapes)
    assert sorted(map(str, got.collect())) == sorted(map(str, old.select(*got.columns).collect())) and got.count() == 17
    md = X.table_markdown(cells, shapes)
    assert plan(md, capsys).count("Exchange") == 1
    assert {r.image_id: r.markdown for r in md.collect() if r.image_id == 0} == {
        0: "| a\\|b   | a\\|b   |    |\n|--------|--------|----|\n|        | down   |    |\n|        | down   |    |"
    }


def test_anchors_are_computed_once_for_cells_and_shapes(spark, capsys):
    dets = spark.createDataFrame([(k, i, 50.0 * i, 9.0 * i, 50.0 * i + 40, 9.0 * i + 8) for k in range(3) for i in range(5)], CELL)
    cells, shapes = S.build_tables(dets)
    staged = S.build_tables(dets, stage_outputs=True)
    for a, b in zip((cells, shapes), staged, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert "Window" in plan(a, capsys) and "Window" not in plan(b, capsys)


def test_verify_text_matches_once(spark, capsys):
    assert "Generate" not in plan(QUERIES["verify_text"](spark, "/root/testdata/sf0.001"), capsys)


def test_texts_are_put_together_from_words_as_the_library_encodes_them():
    import public_tokenizers
    import pyarrow as pa

    from gridweave.llm.wordbpe import WordBpe, read_tokenizer

    bpe = WordBpe(read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["The cat's 12 hats", "", None, " \t ", "cat THE the", "Straße naïve", "日本 text", "it's <|endoftext|> over", "the cat"]
    for part in (texts, [" ", ""], ["one"]):
        got = bpe.encode(pa.array(part, pa.string()))
        want = [bpe.tok.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == want and all(type(ids) is bytes for ids, _ in got)
    assert [t.id for t in bpe.tokenize("cat")] == bpe.ids("cat")  # the model is held, not wrapped again for each word
