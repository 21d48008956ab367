"""Operator 5: removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
somewhere else. Prefix doubling ranks positions by longer and longer
stretches of the text behind them, sorting (rank, rank at an offset) pairs
until a rank is unique or the threshold is reached. One row for each byte
position would be hundreds of times the input, so here a row is a *range* of
positions that are ranked together:

* Each position's string (its next ``LENGTH`` bytes) is named after its
  leader, the 16-byte gram in it with the smallest hash. Equal strings have
  equal leaders at equal offsets, and neighbouring positions share theirs.
  The positions of one leader are cut by offset into aligned ranges.
* All strings of a range of ``n`` positions hold the same ``LENGTH - n + 1``
  bytes. That stretch is the range's rank. Spark sorts the ranks of the
  corpus; a range whose rank is unique leaves, as no string in it can repeat.
* The others are ranked again at a greater length, as ranges of 16 positions
  and then as single ones, whose stretch is the string itself.
* A range whose *whole* extent (``LENGTH + n - 1`` bytes) stands elsewhere
  is repeated at all its positions. If others share its rank besides, one of
  the equal ranges goes on as their witness; none of the rest needs further
  ranking. So large groups of copies are settled at the first chance.

Ranks are compared by hash: 64 bits where a clash only costs work, 128 bits
where a repeat is accepted. After the first ranking only texts with a
repeated rank are kept on (a Bloom filter of fixed size finds them in the
second scan; wrong ones leave later).

Null and empty texts, and texts shorter than ``LENGTH``, lose nothing.
Repeated rows are texts of their own, and so repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Shared, bloom, buffers, in_bloom, mix, prefix_hash, signed, slices, span_hash, stage, text_rows

LENGTH, GRAM, LEVELS, FILTER_BITS = 400, 16, (128, 16, 1), 1 << 27
_U = np.uint64
_PART = 4 << 20  # longest stretch of one text handled at once
_MASK = _U((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by running minima over blocks of ``w``."""
    n = len(x) - w + 1
    grid = np.full(-(-len(x) // w) * w, np.iinfo(_U).max, _U)
    grid[: len(x)] = x
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Ranges:
    """Aligned ranges of positions: leader ``a`` and offsets ``lo .. hi`` before it."""

    def __init__(self, a: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.a, self.lo, self.hi = a, lo, hi

    def cut(self, n: int) -> Ranges:
        """Cut at multiples of ``n``."""
        first = self.lo // n
        count = self.hi // n - first + 1
        of = np.repeat(np.arange(len(self.a)), count)
        b = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
        return Ranges(self.a[of], np.maximum(self.lo[of], b * n), np.minimum(self.hi[of], b * n + n - 1))

    def take(self, at: np.ndarray) -> Ranges:
        return Ranges(self.a[at], self.lo[at], self.hi[at])

    def core(self, pre: np.ndarray, n: int, base: int = 0) -> np.ndarray:
        """Rank of aligned ranges of ``n``: what all strings of the range hold."""
        b = self.lo // n
        s = self.a - b * n
        return mix(span_hash(pre, s, s - n + 1 + LENGTH, base) + b.astype(_U) + _U(n << 32))

    def full(self, n: int) -> np.ndarray:
        return np.flatnonzero((self.lo % n == 0) & (self.hi == self.lo + n - 1))

    def extent(self, pre: np.ndarray, n: int, base: int = 0) -> np.ndarray:
        """Rank of full ranges by all bytes that their strings cover."""
        s = self.a - self.hi
        return mix(span_hash(pre, s, s + n - 1 + LENGTH, base) + (self.lo // n).astype(_U) + _U(n << 40))


def ranges(data: np.ndarray, offs: np.ndarray) -> tuple[Ranges, np.ndarray]:
    """Ranges of the first level over some texts one behind the other, and their first-round ranks."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return Ranges(none, none, none), np.zeros(0, _U)
    pre = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = (span_hash(pre, at, at + GRAM) & ~_MASK) | at.astype(_U)
    lead = (sliding_min(gram, LENGTH - GRAM + 1) & _MASK).astype(np.int64)
    cross = np.zeros(len(lead) + 1, np.int64)  # positions whose string would leave its text
    np.add.at(cross, np.minimum(np.maximum(offs[:-1], offs[1:] - LENGTH + 1), len(lead)), 1)
    np.add.at(cross, np.minimum(offs[1:], len(lead)), -1)
    p = np.flatnonzero(np.cumsum(cross[:-1]) == 0)
    if not len(p):
        return Ranges(p, p, p), np.zeros(0, _U)
    new = np.flatnonzero((np.diff(p) != 1) | (np.diff(lead[p]) != 0)) + 1
    first, last = p[np.concatenate([[0], new])], p[np.concatenate([new - 1, [len(p) - 1]])]
    a = lead[first]
    got = Ranges(a, a - last, a - first).cut(LEVELS[0])
    return got, got.core(pre, LEVELS[0])


def stretches(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of the texts; a very long one comes in parts that overlap by a string."""
    data, offs = buffers(col)
    if len(data) <= _PART:
        yield 0, data, offs
        return
    for a in range(0, max(1, len(data) - LENGTH + 1), _PART):  # slices() gives a long text alone
        z = min(len(data), a + _PART + LENGTH - 1)
        yield a, data[a:z], np.array([0, z - a])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First-round ranks, counted within each slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            keys = np.concatenate([ranges(d, o)[1] for _, d, o in stretches(part.column(1))])
            k, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n.astype(np.int32))], names=["key", "n"])


def _second(bits):
    """Digest of texts without a repeated rank; the others with their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = buffers(part.column(1))
                held: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
                for place, d, o in stretches(part.column(1)):
                    r, key = ranges(d, o)
                    r = r.take(np.flatnonzero(in_bloom(bits.value, key)))
                    of = np.searchsorted(offs, r.a + place, "right") - 1
                    for i in np.unique(of).tolist():
                        x = r.take(np.flatnonzero(of == i))
                        held[i].append(np.stack([x.a + place - offs[i], x.lo, x.hi]))
                n = np.diff(offs)
                raw = [data[offs[i] : offs[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n),
                     pa.array([None if h else hashlib.sha256(t).hexdigest() for h, t in zip(held, raw, strict=True)], pa.string()),
                     pa.array([t if h else None for h, t in zip(held, raw, strict=True)], pa.binary()),
                     pa.array([np.concatenate(h, axis=1).astype("<i4").tobytes() if h else None for h in held], pa.binary())],
                    names=["doc_id", "n_bytes", "kept_sha256", "bytes", "ranges"],
                )

    return run


class Text:
    """A text on its way through the rounds, rebuilt from its row and the marks found so far.

    A mark is ``4 * number + 2 * whole + witness`` with a count: so many rows
    have the rank of the numbered range, or (``whole``) its extent.
    """

    def __init__(self, raw: bytes, packed: bytes, marks: list[tuple]):
        self.data = np.frombuffer(raw, np.uint8)
        self.marks = marks
        self.done: list[Ranges] = []  # ranges repeated at all positions
        self.now = Ranges(*np.frombuffer(packed, "<i4").astype(np.int64).reshape(3, -1))
        for level, (mark, count) in zip(LEVELS, marks, strict=False):
            self._step(level, mark, count)
        self._pre: list = []

    def _step(self, level: int, mark: np.ndarray, count: np.ndarray) -> None:
        """Leave out what the marks settle; cut the rest for the next level."""
        core, whole, witness = (np.zeros(len(self.now.a), np.int64) for _ in range(3))
        is_whole = mark & 2 == 2
        core[mark[~is_whole] >> 2] = count[~is_whole]
        whole[mark[is_whole] >> 2] = count[is_whole]
        witness[mark[is_whole] >> 2] = mark[is_whole] & 1
        if level == 1:
            self.done.append(self.now.take(np.flatnonzero(core)))
            return
        self.done.append(self.now.take(np.flatnonzero(whole)))
        # a witness is needed only by others with this rank, besides those of equal extent
        on = (core > 0) & ((whole == 0) | ((witness == 1) & (core > whole)))
        self.now = self.now.take(np.flatnonzero(on)).cut(LEVELS[LEVELS.index(level) + 1])

    def pre(self, base: int) -> np.ndarray:
        while len(self._pre) <= base:
            self._pre.append(prefix_hash(self.data, len(self._pre)))
        return self._pre[base]

    def removed(self) -> np.ndarray:
        """Which bytes go, after all rounds."""
        edge = np.zeros(len(self.data) + 1, np.int64)
        for x in self.done:
            np.add.at(edge, x.a - x.hi, 1)
            np.add.at(edge, x.a - x.lo + LENGTH, -1)
        return np.cumsum(edge[:-1]) > 0


def _texts(batch: pa.RecordBatch, rounds: int) -> Iterator[tuple[int, Text]]:
    col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}

    def longs(name: str, i: int) -> np.ndarray:
        return np.array(col[name][i].as_py() or [], np.int64)

    for i in range(batch.num_rows):
        marks = [(longs(f"m{k}", i), longs(f"n{k}", i)) for k in range(rounds)]
        yield i, Text(col["bytes"][i].as_py(), col["ranges"][i].as_py(), marks)


def _ranks(parts: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "row", "mark"])


def _ranked(rounds: int):
    """Ranks to sort in a round: (k1, k2, row, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, t in _texts(batch, rounds):
                r, n = t.now, LEVELS[rounds]
                if not len(r.a):
                    continue
                number = np.arange(len(r.a))
                parts = [(r.core(t.pre(0), n), r.core(t.pre(1), n, 1), number * 4)]
                if n > 1:
                    f = r.full(n)
                    x = r.take(f)
                    parts.append((x.extent(t.pre(0), n), x.extent(t.pre(1), n, 1), number[f] * 4 + 2))
                k1, k2, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
                out.append((signed(k1), signed(k2), np.full(len(mark), batch.column(0)[i].as_py(), np.int64), mark))
                size += len(mark)
                if size >= 1 << 16:
                    yield _ranks(out)
                    out, size = [], 0
            if out:
                yield _ranks(out)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row.

    ``kept`` holds the remaining bytes of texts that lose some, and is null
    for texts that lose none.
    """
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ranks = rows.mapInArrow(_first, "key bigint, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    bits = Shared(docs.sparkSession, bloom(ranks, "key", FILTER_BITS))
    texts = stage(
        rows.mapInArrow(_second(bits), f"doc_id {id_type}, n_bytes bigint, kept_sha256 string, bytes binary, ranges binary").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "texts",
    )
    on = texts.filter(F.col("bytes").isNotNull()).select("row", "bytes", "ranges", "doc_id", "n_bytes")
    for k in range(len(LEVELS)):
        ranked = on.drop("doc_id", "n_bytes").mapInArrow(_ranked(k), "k1 bigint, k2 bigint, row bigint, mark bigint")
        ranked = stage(ranked, f"ranks{k}")
        again = ranked.groupBy("k1", "k2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "mark")).alias("least")
        ).filter("n > 1")
        witness = (F.struct("row", "mark") == F.col("least")).cast("bigint")
        marks = ranked.join(again, ["k1", "k2"]).select("row", (F.col("mark") + witness).alias("mark"), "n")
        marks = marks.groupBy("row").agg(F.collect_list(F.struct("mark", "n")).alias("x"))  # of one text
        marks = stage(marks.select("row", F.col("x.mark").alias(f"m{k}"), F.col("x.n").alias(f"n{k}")), f"marks{k}")
        on = on.join(marks, "row", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "bytes", 4 << 20):
                gone = [t.removed() for _, t in _texts(batch, len(LEVELS))]
                raw = (np.frombuffer(x, np.uint8) for x in batch.column(batch.schema.get_field_index("bytes")).to_pylist())
                kept = [x[~g].tobytes() for x, g in zip(raw, gone, strict=True)]
                spans = [int(np.sum(g & ~np.concatenate([[False], g[:-1]]))) for g in gone]
                doc, n = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes"))
                yield pa.RecordBatch.from_arrays(
                    [doc, n, pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(spans, pa.int64()),
                     pa.array([k if s else None for k, s in zip(kept, spans, strict=True)], pa.binary()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    zero = F.lit(0).cast("bigint")
    whole = texts.filter(F.col("bytes").isNull()).select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lit(None).cast("binary").alias("kept"), "kept_sha256"
    )
    return whole.unionByName(on.mapInArrow(finish, schema))
