"""Operator 3: personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each
value found is a protected *entity*. Masking the value alone may not do: a
term that stands by it all through the corpus still tells who is meant. How
strongly a term ``t`` reveals an entity ``e`` is their pointwise mutual
information over the corpus, as a share of all that there is to learn about
the entity: ``PMI(t, e) / IC(e)`` with ``IC(e) = ln(N / n(e))`` and
``PMI(t, e) = ln(n(t, e) N / (n(t) n(e)))``, where ``n`` counts documents and
``n(t, e)`` those with ``t`` within ``CONTEXT`` words of ``e``. A term that
only ever stands with the entity has 1. Terms from ``GENERALISE`` on are
generalised (to a class of words) and from ``REMOVE`` on removed, wherever in
the corpus they stand, if at least ``SUPPORT`` different texts show them
together: without that, every rare word of a text would seem to reveal its
only entity. A term that reveals several entities goes by its highest share.

All counts cover all documents: n(t, e) and n(e) come from the spans of the
whole corpus, n(t) from a second scan that counts, in every document, the
terms in question (a Bloom filter of fixed size keeps the others from being
shuffled; the join behind it is exact). A third scan finds every occurrence of
the terms that reveal an entity, near it or not, in the same way. No group is
gathered.

Null and empty texts have no spans. Repeated rows give one result row each,
and count as documents, but not as different texts. Very long texts are taken
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import NOT_WORD, Shared, Words, bloom, in_bloom, signed, slices, stage, text_key, text_rows

# The kinds in order, and what an address is made of.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CONTEXT, SUPPORT, GENERALISE, REMOVE = 8, 3, 0.8, 0.95


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, each found from its @: the run of local characters before it, and a dotted name behind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers at a time, from the left of every dotted chain."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        a = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            z = a + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((a, z))
            a = z + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


_ANY = re.compile(r"[0-9@]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start."""
    if not _ANY.search(text):
        return []
    return [(k, a, z) for k, find in enumerate((emails, ips, cards, phones)) for a, z in find(text)]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def _entity(kind: int, value: str) -> int:
    """Names a value: letters in lower case, numbers by their digits."""
    plain = value.lower() if kind == 0 else "".join(c for c in value if c.isdigit() or (kind == 1 and c == "."))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def _free(spans: list[tuple[int, int, int]], w: Words, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (code points) and hash of the words of text ``i``, those inside any span left out."""
    a, z = w.first[i], w.first[i + 1]
    data = w.data[w.offsets[i] : w.offsets[i + 1]]
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    s, e = point[w.start[a:z] - w.offsets[i]], point[w.end[a:z] - w.offsets[i]]
    inside = np.zeros(len(s), bool)
    for _, x, y in spans:
        inside[np.searchsorted(e, x, "right") : np.searchsorted(s, y, "left")] = True
    return s[~inside], e[~inside], w.hash[a:z][~inside]


def _context(text: str, spans: list[tuple[int, int, int]], w: Words, i: int) -> list[tuple[int, int]]:
    """(entity, term) for the words around each span of text ``i``, those inside any span left out."""
    s, _, h = _free(spans, w, i)
    h = signed(h)
    out = []
    for k, x, y in spans:
        lo, hi = int(np.searchsorted(s, x)), int(np.searchsorted(s, y))
        me = _entity(k, text[x:y])
        for j in range(max(0, lo - CONTEXT), min(len(s), hi + CONTEXT)):
            out.append((me, int(h[j])))
    return out


_CONTEXT_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern spans of every text, and the words around them."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column(2).to_pylist()
            spans = [base_spans(t) for t in texts]
            hit = [i for i, s in enumerate(spans) if s]
            near: list = [[] for _ in texts]
            if hit:
                w = Words(part.column(2).take(pa.array(hit)), NOT_WORD)
                for k, i in enumerate(hit):
                    near[i] = _context(texts[i], spans[i], w, k)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in spans], _SPAN_TYPE),
                 pa.array([hashlib.sha256(spelled(s).encode()).hexdigest() for s in spans]),
                 pa.array([[dict(zip(("entity", "term"), x, strict=True)) for x in c] for c in near], _CONTEXT_TYPE)],
                names=["doc_id", "key", "base", "base_sha256", "near"],
            )


def _frequencies(bits):
    """In how many texts of a slice each term stands that may be in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(0), NOT_WORD)
                at = np.flatnonzero(in_bloom(bits.value, w.hash))
                doc = np.searchsorted(w.first, at, "right") - 1
                both = np.unique(np.stack([w.hash[at], doc.astype(np.uint64)]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                term, n = np.unique(both[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return run


def _occurrences(bits):
    """Every place of the terms that may be in question, pattern spans left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(2), NOT_WORD)
                at = np.flatnonzero(in_bloom(bits.value, w.hash))
                for i in np.unique(np.searchsorted(w.first, at, "right") - 1).tolist():
                    s, e, h = _free(base_spans(part.column(2)[i].as_py()), w, i)
                    ok = in_bloom(bits.value, h)
                    same = pa.array(np.full(int(ok.sum()), i))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(same), part.column(1).take(same), pa.array(signed(h[ok])), pa.array(s[ok], pa.int32()), pa.array(e[ok], pa.int32())],
                        names=["doc_id", "key", "term", "start", "end"],
                    )

    return run


def disclosing(scanned: DataFrame, rows: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``entity, term, share``: the terms that reveal an entity by ``generalise`` or more."""
    spark = rows.sparkSession
    total = scanned.count()
    near = scanned.select("row", "key", F.explode("near").alias("x")).select("row", "key", "x.entity", "x.term").distinct()
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= support)
    texts = near.join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").select("entity", "term", "key").distinct()
    shown = texts.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    pairs = stage(pairs.join(shown.select("entity", "term"), ["entity", "term"]), "pairs")
    n_e = near.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    bits = Shared(spark, bloom(pairs.select("term").distinct(), "term"))
    n_t = rows.select("text").mapInArrow(_frequencies(bits), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))
    all_ = F.lit(float(max(total, 1)))
    share = F.log(F.col("n_te") * all_ / (F.col("n_t") * F.col("n_e"))) / F.log(all_ / F.col("n_e"))
    return pairs.join(n_e, "entity").filter(F.col("n_e") < all_).join(n_t, "term").select("entity", "term", share.alias("share")).filter(
        F.col("share") >= generalise
    )


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their pattern spans, and the term spans by id and text."""
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    scanned = stage(
        keyed.mapInArrow(
            _scan, f"doc_id {id_type}, key string, base array<struct<kind:int,start:int,end:int>>, base_sha256 string, "
            "near array<struct<entity:bigint,term:bigint>>"
        ).withColumn("row", F.monotonically_increasing_id()),
        "spans",
    )
    told = stage(disclosing(scanned, rows).groupBy("term").agg(F.max("share").alias("share")), "told")
    bits = Shared(docs.sparkSession, bloom(told, "term"))
    places = keyed.mapInArrow(_occurrences(bits), f"doc_id {id_type}, key string, term bigint, start int, end int")
    terms = places.join(told, "term").select("doc_id", "key", "start", "end", "share").distinct()
    return scanned, terms


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` for every row; ``spans`` lists all spans."""
    scanned, terms = _found(docs, id_col, text_col)
    more = terms.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "start", "end").groupBy("id", "k").agg(
        F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("terms")
    )
    out = scanned.drop("near", "row").join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    every = F.array_sort(F.concat(F.col("base"), F.coalesce("terms", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    spell = lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"], x["end"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], "base_sha256",
        F.array_join(F.transform(every, spell), ",").alias("spans"), F.size(F.coalesce("terms", F.array())).cast("bigint").alias("n_term"),
    )


def mask(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """The text with pattern spans named by kind, and terms removed (``True``) or generalised."""
    marks = [(a, z, f"[{KINDS[k].upper()}]") for k, a, z in base_spans(text)]
    marks += [(a, z, "" if gone else ("[NUMBER]" if text[a:z].isdigit() else "[NAME]" if text[a:a + 1].isupper() else "[WORD]")) for a, z, gone in terms]
    out, at = [], 0
    for a, z, put in sorted(marks, key=lambda x: (x[0], -x[1])):
        if a >= at:  # of overlapping spans the first names the place
            out += [text[at:a], put]
        at = max(at, z)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; other columns stay as they are."""
    _, terms = _found(docs, id_col, text_col)
    of = terms.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", (F.col("share") >= REMOVE).alias("gone"))).alias("terms"))
    rows = docs.select(F.struct("*").alias("row"))  # whatever its columns are called
    whole = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    same = F.col("row").getField(id_col).eqNullSafe(F.col("doc_id")) & (text_key(whole) == F.col("key"))
    joined = rows.join(of, same, "left").select("row", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_struct_array(batch.column(0))
            at = whole.schema.get_field_index(text_col)
            names = [f"c{i}" for i in range(whole.num_columns)] + ["terms"]
            for part in slices(pa.RecordBatch.from_arrays([*whole.columns, batch.column(1)], names=names), f"c{at}"):
                marks = part.column(part.num_columns - 1).to_pylist()
                new = [
                    mask(t or "", [(x["start"], x["end"], x["gone"]) for x in k or []])
                    for t, k in zip(part.column(at).to_pylist(), marks, strict=True)
                ]
                cols = [pa.array(new, pa.string()) if i == at else part.column(i) for i in range(whole.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, names=whole.schema.names)

    return joined.mapInArrow(run, docs.schema)
