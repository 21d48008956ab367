"""Source mixing, embedding whitening and token alignment against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest

from gridweave.llm import alignment, mixture, whitening

A_FILE, B_FILE = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
CLASH = {c: 1 for c in ("src", "no_src", "size", "digest", "start", "target", "cell", "block", "pair", "links", "x", "v", "n", "at", "value")}


def table(spark, rows, schema):
    """Rows with more columns, named as the operators name their own."""
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"{v} as {c}" for c, v in CLASH.items()]).repartition(3)


# ---------------------------------------------------------------- mixing

def documents(k=300):
    rows = [(i, " ".join(["w"] * (i * 7919 % 40)) + "\t\n", None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(k)]
    rows += [(900, None, "s1"), (901, "", None), (902, " \x0b\x0c ", "void"), (None, "a b c", "s2"), (5, rows[5][1], rows[5][2]), (903, "x " * 5000, "big"), (904, "y", "one")]
    return rows


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share words by weight; what is above a source's room goes round again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values()) * share
    while True:
        rest = [s for s in names if s not in full]
        for s in rest:
            target[s] = left * w[s] / sum(w[r] for r in rest)
        over = [s for s in rest if target[s] > most * sizes[s]]
        if not over:
            return target, names
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        full |= set(over)


def test_mixture_targets_quotas_and_pieces(spark):
    rows = documents()
    docs = table(spark, rows, "doc_id bigint, text string, source string")
    block, per_shard = 4, 50
    m = mixture.Mixture(docs, 3, block_words=block, shard_blocks=per_shard)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        by[s] += n
    target, names = water(by)
    got = m.documents().collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for (i, _, _), n in zip(rows, size, strict=True))
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-12) and r.source_size == by[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * block for s in by)

    # highest quotients, one block after the other
    blocks, seats = math.floor(sum(target.values()) / block + 0.5), Counter()
    want = {}
    for b in range(blocks):
        best = max((s for s in names if target[s]), key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))
        want.setdefault((b // per_shard, best), [seats[best], 0])[1] += 1
        seats[best] += 1
    found = {(r.shard, None if r.no_src else r.src): [r.before, r.quota] for r in m.quotas.filter("quota > 0").collect()}
    assert found == want

    # the shards' pieces are what the documents' sums say, and their words are taken once a round
    pieces = m.pieces().collect()
    assert len({p.round for p in pieces}) == 2
    words, seen = Counter(), Counter()
    for p in pieces:
        words[p.source, p.doc_id] += p.n_words
        if (p.doc_id, p.source) != (5, rows[5][2]):  # stands twice
            for w in range(p.first_word, p.first_word + p.n_words):
                seen[p.doc_id, p.round, w] += 1
    sums = Counter()
    for r in got:
        sums[r.source, r.doc_id] += r.taken
    assert +words == +sums and set(seen.values()) == {1}
    per = Counter()
    for p in pieces:
        per[p.shard, p.source] += p.n_words
    for (shard, s), (_, quota) in want.items():
        assert per[shard, s] <= quota * block and (taken[s] == 2 * by[s] or per[shard, s] == quota * block)


def test_mixture_reruns_agree_and_other_seeds_differ(spark):
    docs = table(spark, documents(), "doc_id bigint, text string, source string")
    a, b, c = (Counter(map(tuple, mixture.mix(d, s).collect())) for d, s in ((docs, 1), (docs.repartition(7), 1), (docs, 2)))
    assert a == b and a != c


def test_mixture_without_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    m = mixture.Mixture(empty, 1)
    assert mixture.mix(empty, 1).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert m.documents().count() == m.quotas.count() == m.pieces().count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")
    assert sorted(map(tuple, mixture.mix(blank, 1).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# ---------------------------------------------------------------- whitening

def check_whitened(spark, rows, wanted=16):
    """All columns against the covariance's eigenvectors."""
    df = table(spark, rows, "vec_id bigint, embedding array<float>")
    sound = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    most = max(Counter(len(v) for _, v in sound).items(), key=lambda kv: (kv[1], kv[0]))[0]
    sound = [(i, v) for i, v in sound if len(v) == most]
    x = np.array([[math.floor(64 * float(np.float32(c))) for c in v] for _, v in sound])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    a = (n * u - s) / n
    cov = a.T @ a / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(wanted, most, int((e > 1e-13 * e[0]).sum()))
    got = whitening.whiten(df, 5, components=wanted).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in sound for c in range(1, k + 1))
    far = defaultdict(set)
    for (i, _), row in zip(sound, x, strict=True):
        far[i].add(int(((n * row - s) ** 2).sum()))
    for r in got:
        assert r.n == n and r.deviation in far[r.vec_id] and r.identity_error < 1e-10
        assert abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-10
    fit = whitening.Fit(df.sparkSession.createDataFrame([(row.tolist(),) for row in u], "x array<bigint>").repartition(3), 5, wanted)
    q = fit.components
    assert np.abs(q.T @ q - np.eye(k)).max() < 1e-12 and np.abs(cov @ q - q * e[:k]).max() < 1e-10 * e[0]
    w = {}
    for (i, _), row in zip(sound, (n * x - s) / n @ q / np.sqrt(e[:k]), strict=True):
        w.setdefault(i, []).append(row)
    for r in got:
        assert min(abs(abs(r.whitened) - abs(row[r.component - 1])) for row in w[r.vec_id]) < 1e-8


def test_whitening_flat_spectrum_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [None] + [1.0] * 23), (503, [float("nan")] * 24), (504, [float("inf")] * 24), (505, [1.0] * 3), (506, [0.0] * 24), (7, rows[7][1]), (None, rows[8][1])]
    check_whitened(spark, rows)


def test_whitening_repeated_eigenvalues_and_subspaces(spark):
    corners = [[float(64 * s) if i == j else 0.0 for j in range(6)] for i in range(6) for s in (-1, 1)]
    df = spark.createDataFrame(list(enumerate(corners)), "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df, 1).collect()  # all eigenvalues alike
    assert len(got) == 12 * 6 and all(abs(r.explained - 1 / 6) < 1e-12 and r.identity_error < 1e-12 for r in got)
    rng = np.random.default_rng(4)
    x = (rng.integers(-9, 9, size=(80, 3)) @ rng.integers(-9, 9, size=(3, 10))).astype(float)  # rank 3 in 10 dimensions
    check_whitened(spark, [(i, v.tolist()) for i, v in enumerate(x)])


def test_whitening_decaying_spectrum_ends_early(spark):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(300, 60)) * 64 * np.exp(-np.arange(60)) * 1e6)
    rows = spark.createDataFrame([([int(c) for c in r],) for r in x], "x array<bigint>")
    fit = whitening.Fit(rows, 3, components=4)
    assert fit.steps < 30
    a = x - x.mean(axis=0)
    assert np.allclose(fit.deviations, np.linalg.svd(a, compute_uv=False)[:4] / np.sqrt(300), rtol=1e-12)


def test_whitening_nothing_to_whiten(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema), 1).collect() == []


def test_whitening_exact_deviation(spark):
    df = spark.createDataFrame([(1, [3e7, 0.0]), (2, [-3e7, 5.0]), (3, [1.0, -3e7])], "vec_id bigint, embedding array<double>")
    x = [[math.floor(64 * c) for c in v] for v in ([3e7, 0.0], [-3e7, 5.0], [1.0, -3e7])]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i + 1: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in whitening.whiten(df, 1).collect()} == {i: d if d < 1 << 63 else None for i, d in want.items()}


# ---------------------------------------------------------------- alignment

TEXTS = [
    "Plain words, 12 numbers; and odd-looking   spaces.\n\n", None, "", " ", "a▁b", "<|endoftext|> here <s> and </s> <0x41>", "é" * 3000,
    "x" * 5000, " " * 4000, "日本語テキスト🙂\U0001f9d1‍\U0001f680", "tab\tline\r\nend", "many words in a row " * 400, "ﬁne ligature Å", "same text", "same text",
]


@pytest.fixture(scope="module")
def tools():
    with open(A_FILE, encoding="utf-8") as f, open(B_FILE, "rb") as g:
        return alignment.Aligner(f.read(), g.read())


def brute(text, tools):
    """Token by token, with the byte tokenizer's own library."""
    a = tools.whole.encode(" " + (text or ""), add_special_tokens=False).ids
    b = tools.pieces.encode(text or "")
    ab, bb = [tools.bytes_a[i].as_py() for i in a], [tools.bytes_b[i].as_py() for i in b]
    if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
        return 0, 0, 0, [], ""
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in (ab, bb)]
    links, j = [], 0
    for i, end in enumerate(ends[0]):
        start = end - len(ab[i])
        while ends[1][j] <= start:
            j += 1
        k = j
        while k < len(b) and ends[1][k] - len(bb[k]) < end:
            links.append((a[i], b[k]))
            k += 1
    cuts, groups, at = sorted({*ends[0]} & {*ends[1]}), [], [0, 0]
    for c in cuts:
        sides = []
        for s, ids in enumerate((a, b)):
            to = ends[s].index(c) + 1
            sides.append(",".join(map(str, ids[at[s] : to])))
            at[s] = to
        groups.append("|".join(sides))
    return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.mark.parametrize("block_tokens", [100, 1 << 22])
def test_alignment_equals_brute_force(spark, tools, block_tokens):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    docs = table(spark, rows, "doc_id bigint, text string")
    want = {i: brute(t, tools) for i, t in rows}
    count = Counter(link for _, _, _, links, _ in want.values() for link in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    got = alignment.align(docs, A_FILE, B_FILE, block_tokens=block_tokens).collect()
    assert len(got) == len(rows)
    for r in got:
        n_a, n_b, groups, links, digest = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, groups, len(links), digest)
        assert r.n_best == sum(count[x] == most[x[1]] for x in links) and r.count_sum == sum(count[x] for x in links)


def test_lanes_do_not_matter(tools):
    import pyarrow as pa

    texts = [t for t in TEXTS if brute(t, tools)[0]]
    a, b = tools.encode(texts, np.zeros(len(texts), bool))
    one = [sorted(zip(*x, strict=True)) for x in (lambda r: (r[:2], r[2:]))(alignment.lockstep(a, b, 1 << 30))]
    for lane in (1, 7, 64):
        assert one == [sorted(zip(*x, strict=True)) for x in (lambda r: (r[:2], r[2:]))(alignment.lockstep(a, b, lane))]
    assert alignment.Aligned(pa.array([], pa.string()), tools).pairs.size == 0


def test_fast_encoding_equals_the_library(tools):
    """Every character next to letters, blanks and itself."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}b{c}{c}1 " for c in chars[k : k + 64]) for k in range(0, 0x30000, 64)]
    whole = tools.whole.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(tools.fast.encode_ordinary(" " + t) == w.ids for t, w in zip(texts, whole, strict=True))


def test_alignment_of_no_rows(spark):
    out = alignment.align(spark.createDataFrame([], "doc_id string, text string"), A_FILE, B_FILE)
    assert out.count() == 0 and dict(out.dtypes)["doc_id"] == "string"
