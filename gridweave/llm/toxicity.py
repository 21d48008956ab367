"""Operator 9: toxicity by a factorization machine over hashed terms.

A text is the set of its words, hashed into ``BUCKETS`` buckets. The machine
scores it by a bias, a weight for each term, and the inner products of the
terms' latent vectors for every pair of terms that meet in the text, so that
a pair (an insult and whom it is aimed at) can count for more than its terms
alone. Pairs cost nothing extra: their sum is half the square of the summed
vectors less the sum of squares.

The fit takes at most ``SAMPLE`` labelled rows, those with the smallest hash
of the id, and keeps at most ``TERMS`` buckets whose presence goes with the
label (a chi-square test on the sample). All else covers all rows: every
whole text is scored, in one pass and without a shuffle.

Null and empty texts hold no terms and get the bias alone. Labels other than
0 and 1 and labels without a text are left out; with no label of one kind the
score is the share of label 1. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import NOT_WORD, Shared, Words, slices, text_rows

BUCKETS, SAMPLE, TERMS, RANK, EPOCHS, CHI2 = 1 << 18, 20_000, 4096, 8, 30, 20.0


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0


def term_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every text, and the offsets by text."""
    w = Words(col, NOT_WORD)
    n = w.counts()
    both = np.unique((np.repeat(np.arange(len(n)), n) * BUCKETS) + (w.hash % np.uint64(BUCKETS)).astype(np.int64))
    return both % BUCKETS, np.searchsorted(both, np.arange(len(n) + 1) * BUCKETS)


class Machine:
    """A fitted factorization machine; ``place`` maps a bucket to its term, or to -1."""

    def __init__(self, place: np.ndarray, bias: float, weight: np.ndarray, latent: np.ndarray):
        self.place, self.bias, self.weight, self.latent = place, bias, weight, latent

    def raw(self, terms: np.ndarray, offs: np.ndarray) -> np.ndarray:
        known = self.place[terms]
        at = np.concatenate([[0], np.cumsum(known >= 0)])[offs]
        known = known[known >= 0]
        sums = lambda x: np.diff(np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])[at], axis=0)
        v = self.latent[known]
        s = sums(v)
        return self.bias + sums(self.weight[known][:, None])[:, 0] + 0.5 * (s * s - sums(v * v)).sum(axis=1)

    def score(self, terms: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, offs), -40, 40)))


def _train(sets: list[np.ndarray], y: np.ndarray) -> Machine:
    place = np.full(BUCKETS, -1, np.int32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    empty = Machine(place, bias, np.zeros(1), np.zeros((1, RANK)))
    if y.sum() in (0, len(y)):
        return empty
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    c1 = np.bincount(np.concatenate([s for s, t in zip(sets, y, strict=True) if t]), minlength=BUCKETS).astype(float)
    c0 = np.bincount(np.concatenate([s for s, t in zip(sets, y, strict=True) if not t]), minlength=BUCKETS).astype(float)
    both, n = c1 + c0, n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (np.abs(c1 * (n0 - c0) - c0 * (n1 - c1)) - n / 2).clip(0) ** 2 / (n1 * n0 * both * (n - both))
    chi = np.where((both >= 5) & (both < n), np.nan_to_num(chi), 0)
    terms = np.argsort(-chi, kind="stable")[:TERMS]
    terms = terms[chi[terms] > CHI2]
    if not len(terms):
        return empty
    place[terms] = np.arange(len(terms))
    rows = [p[p >= 0] for p in (place[s] for s in sets)]
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), RANK))
    gw, gv, gb = np.full(len(terms), 1e-2), np.full(v.shape, 1e-2), 1e-2
    rate, decay = 0.3, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 128):
            part = order[a : a + 128]
            size = np.array([len(rows[i]) for i in part])
            flat, of = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), size)
            s = np.zeros((len(part), RANK))
            np.add.at(s, of, v[flat])
            q = np.zeros((len(part), RANK))
            np.add.at(q, of, v[flat] ** 2)
            raw = bias + np.bincount(of, weights=w[flat], minlength=len(part)) + 0.5 * (s * s - q).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[part]) / len(part)
            dw = np.bincount(flat, weights=err[of], minlength=len(w)) + decay * w / len(order) * len(part)
            dv = np.zeros(v.shape)
            np.add.at(dv, flat, err[of][:, None] * (s[of] - v[flat]))
            dv += decay * v / len(order) * len(part)
            gw += dw * dw
            gv += dv * dv
            gb += err.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            bias -= rate * err.sum() / np.sqrt(gb)
    return Machine(place, float(bias), w, v)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> Machine:
    """Fit on at most ``sample`` learnable labelled rows. The labels chosen are few, so texts are not shuffled for them."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = text_rows(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("at"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t, offs = term_sets(part.column(0))
                t = t.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(1), pa.array([t[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)], pa.binary())],
                    names=["at", "y", "terms"],
                )

    rows = texts.mapInArrow(features, "at bigint, y int, terms binary").orderBy("at", "y").limit(sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, y = [], []
        for b in batches:
            sets += [np.frombuffer(x, "<i4").astype(np.int64) for x in b.column(2).to_pylist()]
            y += b.column(1).to_pylist()
        m = _train(sets, np.array(y, float)) if y else Machine(np.full(BUCKETS, -1, np.int32), 0.0, np.zeros(1), np.zeros((1, RANK)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.place.tobytes()]), pa.array([m.bias]), pa.array([m.weight.tobytes()]), pa.array([m.latent.tobytes()])],
            names=["place", "bias", "weight", "latent"],
        )

    model = rows.coalesce(1).mapInArrow(train, "place binary, bias double, weight binary, latent binary").collect()
    if not model:
        return Machine(np.full(BUCKETS, -1, np.int32), 0.0, np.zeros(1), np.zeros((1, RANK)))
    m = model[0]
    return Machine(
        np.frombuffer(m["place"], np.int32), m["bias"], np.frombuffer(m["weight"]), np.frombuffer(m["latent"]).reshape(-1, RANK)
    )


def scored(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row. A null id has no label to learn from: it counts as held out."""
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = shared.value.score(*term_sets(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    got = rows.mapInArrow(run, f"doc_id {id_type}, score double")
    return got.select("doc_id", (~F.coalesce(learnable(F.col("doc_id")), F.lit(False))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Machine, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score less than ``limit``; all columns stay."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                s = shared.value.score(*term_sets(part.column(part.schema.get_field_index(text_col))))
                yield part.filter(pa.array(s < limit))

    return docs.mapInArrow(run, docs.schema)
