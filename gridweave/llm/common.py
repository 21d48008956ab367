"""Helpers shared by the text operators: staging, Arrow text slices, word hashes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import checkpoint_dir

SLICE_BYTES = 1 << 20  # text handled at once inside a task (or one text, if that is longer)
_U = np.uint64


# ---------------------------------------------------------------- staging

def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    It is the session's ``spark.checkpoint.dir``. Only a local session that
    names none (tests) gets a folder of its own; on a cluster this raises.
    """
    found = checkpoint_dir(spark)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-stage-"))
    return checkpoint_dir(spark).rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor loses nothing of it) and fixes values
    that a recomputation could change, such as task numbers.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/gridweave-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object kept by a Python worker across its tasks, until a task asks for one of another name.

    Workers outlive the stages of a pipeline; a stage must not keep the tokenizer of the one before it.
    """
    held = sys.modules.setdefault("_gridweave_worker", types.ModuleType("_gridweave_worker"))
    kept = held.__dict__.setdefault("kept", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


class Shared:
    """A broadcast object of this package; workers need no installed copy of its class."""

    def __init__(self, spark: SparkSession, held: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(held))

    @property
    def value(self) -> object:
        if "held" not in self.__dict__:
            self.held = cloudpickle.loads(self.sent.value)
        return self.held

    def __getstate__(self) -> dict:
        return {"sent": self.sent}


# ---------------------------------------------------------------- text columns

def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a table, null texts as empty ones, all other columns left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """Names a text, so that rows with the same id but other texts stay apart."""
    return F.concat_ws(":", F.length(text).cast("string"), F.md5(text))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (UTF-8 bytes, offsets); nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or one row."""
    _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
    a, n = 0, batch.num_rows
    while a < n:
        z = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        z = min(n, max(a + 1, z))
        yield batch.slice(a, z - a)
        a = z
    tidy()


# ---------------------------------------------------------------- words and hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True  # words: [^\x20\x09-\x0D]+
NOT_WORD = np.zeros(256, bool)
NOT_WORD[0x00:0x30] = NOT_WORD[0x3A:0x61] = NOT_WORD[0x7B:0x80] = True  # words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so both have inverses


_KEPT_POWERS = 1 << 20  # as long as most slices; a longer text makes the rest anew
_HASH_BYTES = 1 << 18  # words of so many bytes are hashed at once


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of a hash base and of its inverse; the first ones are kept per worker, as many as were asked for."""
    held = worker_cache("powers", dict)

    def grown(p: np.ndarray, r: int, m: int) -> np.ndarray:
        while len(p) < m:  # doubling: p[k + i] = p[k] * p[i]
            p = np.concatenate([p, p[: m - len(p)] * _U(pow(r, len(p), 1 << 64))])
        return p

    bases = {"up": _BASES[base], "down": pow(_BASES[base], -1, 1 << 64)}
    for name, r in bases.items():
        held[base, name] = grown(held.get((base, name), np.ones(1, _U)), r, min(n, _KEPT_POWERS + 1))
    up, down = (grown(held[base, name], r, n) for name, r in bases.items())
    return up, down


def prefix_hash(data: np.ndarray, base: int = 0) -> np.ndarray:
    """``H`` with ``span_hash(H, s, e)`` the hash of ``data[s:e]`` wherever it stands."""
    up, _ = powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = 0) -> np.ndarray:
    _, down = powers(len(pre), base)
    return mix((pre[e] - pre[s]) * down[s])


class Words:
    """The words of a slice of texts: ``start``, ``end`` (bytes), ``hash``, and ``first[i]``, the first word of text i."""

    def __init__(self, col: pa.Array, outside: np.ndarray = BLANK, lower: bool = True):
        data, offs = buffers(col)
        data = LOWER[data] if lower else data
        inside = ~outside[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True  # a word never crosses texts
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.data, self.offsets = data, offs
        self.first = np.searchsorted(self.start, offs)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """Hash each word; long slices are hashed in parts that end between words."""
        out, a, k = [], 0, len(self.start)
        while a < k:
            z = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _HASH_BYTES, "right")))
            lo, hi = self.start[a], self.end[z - 1]
            pre = prefix_hash(self.data[lo:hi])
            out.append(span_hash(pre, self.start[a:z] - lo, self.end[a:z] - lo))
            a = z
        return np.concatenate(out) if out else np.zeros(0, _U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_SHINGLE = [pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)]


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned hash columns, order included."""
    acc = np.zeros(len(parts[0]), _U)
    for c, p in zip(_SHINGLE, parts, strict=False):
        acc += (p ^ (p >> _U(29))) * _U(c)
    return mix(acc)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text, and the offsets by text.

    A text of fewer than k words gives one shingle, its whole word sequence;
    a text without words gives none. Repeats stay.
    """
    n = w.counts()
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    offs = np.concatenate([[0], np.cumsum(m)])
    total = len(w.hash)
    full = combine([w.hash[i : total - k + 1 + i] for i in range(k)]) if total >= k else np.zeros(0, _U)
    out = np.zeros(offs[-1], _U)
    long = np.flatnonzero(n >= k)
    if len(long):
        reps = m[long]
        src = np.repeat(w.first[long] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        dst = np.repeat(offs[long] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        out[dst] = full[src]
    for i in np.flatnonzero((n > 0) & (n < k)):
        a, z = w.first[i], w.first[i + 1]
        out[offs[i]] = combine([w.hash[j : j + 1] for j in range(a, z)] + [np.array([z - a], _U)])[0]
    return out, offs


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return x.view(np.int64)


# ---------------------------------------------------------------- a bitmap of fixed size

BLOOM_BITS = 1 << 24  # two megabytes, whatever the number of values


def bloom(values: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of ``bits`` (a power of two) over a long column, built by one aggregation into 64-bit words.

    Its size is fixed, so it may be broadcast. It only spares rows a shuffle:
    what it lets pass wrongly, the exact step behind it drops.
    """
    h = F.col(column).cast("long")
    shift = bits.bit_length() - 1
    spots = values.select(
        F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, shift), F.lit(bits)))).alias("bit")
    )
    word = spots.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")
    )
    out = np.zeros(bits // 64, np.int64)
    got = word.toArrow()  # at most bits / 64 rows
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(_U)


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the filter."""
    bits = len(words) * 64
    mask, shift = _U(bits - 1), _U(bits.bit_length() - 1)
    hit = np.ones(len(h), bool)
    for bit in (h & mask, (h >> shift) & mask):
        hit &= (words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
    return hit
