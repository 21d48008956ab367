"""The text operators against brute force, on a table with every odd case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import bpe_tree, decontaminate, licenses, near_dup, pii, suffix_dedup, token_counts, training_order
from gridweave.llm.common import Words, shingles
from gridweave.llm.queries import TOKENIZER

SCHEMA = "doc_id bigint, text string, key string, n_tokens int, row bigint, bytes string, term int, slot int, class int"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Ander", "élan", "thing", "übel", "a1b2", "it's", "reon,", "x"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and blank texts, repeated rows, exact and near copies, a very long unsplit text, odd characters."""
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 90)
    near = base.split(" ")
    near[60] = "changed"
    out = [(1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (6, " ".join(near)), (7, "one two three"), (8, "One two\nthree")]
    out += [(9, prose(rng, 50) + " " + passage + " " + prose(rng, 30)), (10, passage), (10, passage), (None, prose(rng, 12))]
    out += [(11, "ab" * 30_000 + "'s" + "é" * 5000), (12, "<|endoftext|> J̌́ İ 한국 ...'s <|startoftext|>"), (13, "aaaa " * 300)]
    out += [(14, prose(rng, 400)), (15, "Mit  License and the gnu GENERAL public-license; CC-BY apache license mit license")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "k", 1, 2, "b", 3, 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def as_counter(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_bpe_is_the_library_s(docs, texts, library):
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    got = bpe_tree.encode_texts(docs, TOKENIZER, leaf_chars=256)
    assert Counter((r[0], r[1], bytes(r[2]), r[3]) for r in got.collect()) == want


def test_bpe_joins_unsplit_text_exactly(library):
    from gridweave.llm.wordbpe import WordBpe, read_tokenizer

    bpe, rng = WordBpe(read_tokenizer(TOKENIZER)), random.Random(9)
    for alphabet in (["a", "e", "th", "in"], ["'s", "'", "..", "a"], ["é", "한", "́", "J̌", "🏏", "1"], ["ing", "er", "<|endoftext|>", "_"]):
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(100, 700)))
            leaves = bpe_tree.halves(text, 150)
            assert "".join(text[a:z] for a, z, _ in leaves) == text
            nodes = [bpe_tree.Node.of(bpe, text, a, z) for a, z, _ in leaves]
            assert bpe_tree.tree(bpe, text, nodes).ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_characters_encode_as_in_the_library(library):
    import pyarrow as pa

    from gridweave.llm.wordbpe import WordBpe, read_tokenizer

    bpe = WordBpe(read_tokenizer(TOKENIZER))
    tests = [f"a{c}b {c} {c}{c}x 1{c}'s" for c in map(chr, range(1, 0x180))]
    got = bpe.encode(pa.array(tests))
    assert [np.frombuffer(g[0], "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in tests]


def test_token_counts(docs, texts, library):
    want = Counter()
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 100] += 1
    got = token_counts.count_tokens(docs, TOKENIZER, limit=100, block_bytes=2000)
    assert as_counter(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_training_order(docs, texts, library, tmp_path):
    ordered = training_order.training_order(docs, TOKENIZER, key=5, seq_len=16, shard_rows=32)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(len(r["tokens"]) == 32 and r["shard"] == r["slot"] // 32 and r["shard_row"] == r["slot"] % 32 for r in rows)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.update((i, k, tuple(ids[k * 16 : k * 16 + 16])) for k in range(-(-len(ids) // 16)))
    assert Counter((r["doc_id"], r["seq_no"], tuple(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist())) for r in rows) == want
    packs = training_order.shard_payloads(ordered).collect()
    assert all(len(p["payload"]) == 32 * p["n_rows"] for p in packs) and sum(p["n_rows"] for p in packs) == len(rows)
    by_slot = {r["slot"]: bytes(r["tokens"]) for r in rows}
    assert all(bytes(p["payload"])[32 * k : 32 * k + 32] == by_slot[p["first_slot"] + k] for p in packs for k in range(p["n_rows"]))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_feistel_is_a_permutation(n):
    got = training_order.feistel(np.arange(n), n, 42)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != training_order.feistel(np.arange(n), n, 43)).any() and (got != np.arange(n)).mean() > 0.9


def test_suffix_dedup(docs, texts):
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.repeated_spans(docs)
    assert as_counter(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.filter("n_removed > 0").collect())


def test_suffix_dedup_random_repeats(spark):
    """Many overlapping repeats of all lengths about the threshold."""
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcd") for _ in range(n)) for n in (390, 399, 400, 401, 430, 500, 900)]
    rows = [(i, "".join(rng.choice([p, p[rng.randint(0, 60) :], p[: 450 - rng.randint(0, 60)], "xyz"[: rng.randint(0, 3)]]) for p in rng.choices(pool, k=3))) for i in range(60)]
    raw = {i: t.encode() for i, t in rows}
    seen = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        assert got[i]["n_removed"] == int(gone.sum())
        assert got[i]["kept_sha256"] == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_licenses(docs, texts):
    want = Counter()
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
        at = [(k, label) for p, label in licenses.PHRASES.items() for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q]
        first = [k for k, _ in at]
        want[i, len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = licenses.scan(docs)
    assert as_counter(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want


def test_license_sentences_with_changed_words(spark):
    w = licenses.SENTENCES["bsd"].split()
    rows = [(1, " ".join([*["intro"] * 9, *w[:7], "extra", *w[7:12], *w[13:]])), (2, " ".join(w[:6])), (3, " ".join(w).upper())]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1][0] == "bsd" and 0.6 <= got[1][1] < 1 and got[2] == ("", 0.0) and got[3] == ("bsd", 1.0)


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(texts):
    """(doc_id, set size, component) of every row, by comparing all pairs."""
    sets = [(i, sets_of(t)) for i, t in texts]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min((j for j in (least.get(top(k)), i) if j is not None), default=None)
    return Counter((i, len(s), least[top(k)] if s else i, (least[top(k)] if s else i) == i) for k, (i, s) in enumerate(sets))


def test_near_duplicates(docs, texts):
    assert as_counter(near_dup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == brute_components(texts)


def test_near_duplicates_in_one_large_group(spark):
    """Copies with ever more changed words: links in chains, many about the threshold, in common buckets."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(320):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert as_counter(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows)


def test_near_duplicates_whatever_the_sketch_says(spark, monkeypatch):
    """Pairs and a group in common buckets; a sketch that calls all of them too far apart takes no link away."""
    rng = random.Random(12)
    monkeypatch.setattr(near_dup, "SKETCH_FLOOR", 1.0)
    rows = []
    for i in range(20):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[:50] + ["v"] + w[51:])), (10 * i + 2, " ".join(w[:30]))]
    for i in range(300, 312):
        rows.append((i, " ".join([*w[: i - 295], "u", *w[i - 294 :]])))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert as_counter(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for want in (0.6, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        own = int(4000 * (1 - want) / (2 * want))
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in range(2))
        h = np.concatenate([a, b])
        s = near_dup.odd_sketches(near_dup.minhash(h, np.array([0, len(a)])))
        ones = int(np.unpackbits(s[0] ^ s[1]).sum())
        assert near_dup.most_ones(want + 0.12) <= ones <= near_dup.most_ones(want - 0.12)


def test_shingles_and_words_match_their_definition(texts):
    import pyarrow as pa

    w = Words(pa.array([t for _, t in texts], pa.string()))
    h, offs = shingles(w)
    name = {}
    for k, (_, t) in enumerate(texts):
        assert len(set(h[offs[k] : offs[k + 1]].tolist())) == len(sets_of(t))
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_Z))
        assert all(name.setdefault(a, b) == b for a, b in zip(words, w.hash[w.first[k] : w.first[k + 1]].tolist(), strict=True))
    assert len(set(name.values())) == len(name)


def test_decontamination(spark, docs, texts):
    rng = random.Random(8)
    items = [(1, texts[8][1][120:700]), (2, "one two three"), (3, None), (4, ""), (5, texts[9][1]), (6, texts[9][1]), (7, prose(rng, 30))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    held = {i: cut(t) for i, t in items if cut(t)}
    df = Counter(x for w in held.values() for x in set(grams(w, min(5, len(w)))))
    weigh = lambda x: np.log1p(len(held) / df.get(x, 1))
    want = Counter()
    for i, t in texts:
        w = cut(t)
        for item, v in held.items():
            k, best = min(5, len(v)), (0.0, 0)
            mine = Counter(grams(v, k))
            for s in range(len(w) - len(v) + 1):
                window = Counter(grams(w[s : s + len(v)], k))
                both = sum(weigh(x) * n for x, n in (window & mine).items())
                all_ = sum(weigh(x) * n for x, n in (window | mine).items())
                if both / all_ > best[0] + 1e-9:
                    best = (both / all_, s)
            if best[0] >= 0.75 - 1e-9:
                want[i, item, best[1], len(v), round(best[0], 6)] += 1
    rows = decontaminate.contaminated(docs, bench).collect()
    assert Counter((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in rows) == want and want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert as_counter(left, "doc_id") == Counter((i,) for i, _ in texts) - Counter((i,) for i in {k[0] for k in want} for _ in range(3))


def test_decontamination_gives_the_same_rows_for_blocks_of_any_size(spark, monkeypatch):
    """Items share passages, so weights counted by block would move the similarities; ids repeat and are null."""
    rng = random.Random(21)
    common = prose(rng, 20)
    items = [(i % 5 or None, common + " " + prose(rng, 10)) for i in range(12)]
    items += [items[3], items[3], (None, ""), (9, None)]
    rows = []
    for i, (_, t) in enumerate(items[:12]):
        w = t.split(" ")
        w[rng.randint(0, 29)] = "other"
        rows += [(i, prose(rng, 15) + " " + " ".join(w) + " " + prose(rng, 5)), (i, t)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = []
    for count, size in ((4096, 1 << 24), (3, 1 << 24), (4096, 500)):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", count)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found.append(Counter(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 12
    assert max(found[0].values()) == 3  # the item that stands three times


def test_decontamination_of_texts_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words[:46])), (2, " ".join(words[4:])), (3, " ".join(words[:30])), (4, "w1 w2"), (5, " ".join(words)), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = {(r[0], r[1], r[2], r[3], round(r[4], 6)) for r in decontaminate.contaminated(docs, bench).collect()}
    near = round(42 / 46, 6)
    assert got == {(1, 1, 0, 46, near), (2, 1, 0, 46, near), (5, 1, 0, 50, 1.0)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 4, 6}


def reference_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in digits(m[0])][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        x = "".join(rng.choice(["a", ".", "@", "-", "1", "25", "300", " ", "+", "(", "é", "4111", "1111 1111", "x@y.z", "%"]) for _ in range(rng.randint(1, 40)))
        assert reference_spans(x) == [(pii.KINDS[k], a, z) for k, a, z in pii.base_spans(x)]


def test_terms_that_reveal_an_entity(spark, texts):
    """A by-name that always stands with one address goes; common words and rare words of single texts stay."""
    rng = random.Random(6)
    rows = [(100 + i, prose(rng, 25) + " the é") for i in range(60)] + list(texts)
    rows += [(i, f"{prose(rng, 20)} Zorbulon é ann@example.org the {prose(rng, 20)} only{i}") for i in range(20, 26)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, spans string")
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for i, t in rows if i == r["doc_id"]), "") or ""
        base = ",".join(f"{k}:{a}:{z}" for k, a, z in reference_spans(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert ",".join(":".join(s) for s in spans if s[0] != "term") == base
        terms = [text[int(a) : int(z)] for k, a, z in spans if k == "term"]
        if r["doc_id"] in range(20, 26):
            assert "Zorbulon" in terms and "the" not in terms and not any(t.startswith("only") for t in terms)
        else:
            assert not terms
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[20] and "Zorbulon" not in clean[20] and "ann@" not in clean[20]
    assert clean[101] == dict(rows)[101] and clean[1] == ""


def test_revealing_terms_go_wherever_they_stand(spark):
    """Far from the address in its own text, in a text without any address, in repeated rows and rows without an id."""
    rng = random.Random(7)
    far = prose(rng, 30)
    rows = [(100 + i, prose(rng, 25)) for i in range(200)]
    rows += [(i, f"{prose(rng, 20)} Zorbulon ann@example.org {prose(rng, 40)} ZORBULON {prose(rng, 12)} zorbulon@other.org {prose(rng, 9)}") for i in range(20, 32)]
    rows += [(50, f"é {far} Zorbulon"), (50, f"é {far} Zorbulon"), (None, f"zorbulon {far}"), (51, f"Zorbulons {far}"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    cut = lambda t: re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z).replace("zorbulon@", "________@"))
    want = Counter((i, ",".join(f"term:{m.start()}:{m.end()}" for m in cut(t) if m[0] == "zorbulon")) for i, t in rows)
    got = pii.find(df).collect()
    assert Counter((r["doc_id"], ",".join(s for s in r["spans"].split(",") if s.startswith("term"))) for r in got) == want
    assert sum(r["n_term"] for r in got) == 2 * 12 + 3
    clean = pii.sanitise(df).collect()
    assert len(clean) == len(rows) and not any(re.search(r"zorbulon\b", r["text"], re.I) for r in clean)
    assert sum("Zorbulons" in r["text"] for r in clean) == 1


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert bpe_tree.encode_texts(none, TOKENIZER).count() == 0
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0
    assert training_order.training_order(none, TOKENIZER, 1).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert pii.find(none).count() == 0
