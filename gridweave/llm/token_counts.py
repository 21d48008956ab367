"""Operator 4: token counts without token ids.

Texts are taken in blocks of a few megabytes. A block lists its distinct
pre-tokens, and each of its texts becomes a frequency vector over that list;
the vectors of a block travel as one compressed row. The lists of all blocks
are dealt out by pre-token: every distinct pre-token of the corpus is cut into
pieces once, and its number of pieces is joined back to the blocks that hold
it, where a text's count is the sum of frequency times pieces. What is
shuffled are distinct pre-tokens by block, not words by text, and no id is
ever made. A pre-token has one row for each block at most, so none is hot
however often it stands in the texts.

Null texts are empty; empty texts count 0. Repeated rows give one result row
each. Special strings in a text count as the library counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import slices, stage, text_rows
from gridweave.llm.wordbpe import _PIECES, WordBpe, plain_rows, read_tokenizer, worker_bpe

BLOCK_BYTES = 16 << 20


def _vectors(col: pa.Array, pieces, bpe: WordBpe) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct pre-tokens of some texts, and by text the numbers and frequencies of those that it holds."""
    number: dict[str, int] = {}
    put = lambda p: number.setdefault(p, len(number))
    plain = plain_rows(col)
    out: list = [None] * len(col)
    rows = np.flatnonzero(plain)
    if len(rows):
        words, index, offs = WordBpe.split(col if len(rows) == len(col) else col.filter(pa.array(plain)))
        of = [[put(p) for p in pieces(w)] for w in words]
        size = np.array([len(x) for x in of], np.int64)
        flat = np.array([p for x in of for p in x], np.int64)
        begin = np.cumsum(size) - size
        for r, a, z in zip(rows.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            w, n = np.unique(index[a:z], return_counts=True)
            k = size[w]
            at = np.repeat(begin[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            out[r] = _packed(flat[at], np.repeat(n, k))
    for r in np.flatnonzero(~plain).tolist():
        p = [put(x) for x in bpe.pieces(col[r].as_py())]
        out[r] = _packed(np.array(p, np.int64), np.ones(len(p), np.int64))
    return list(number), out


def _packed(number: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A frequency vector: steps between ascending pre-token numbers, and the frequencies."""
    u, back = np.unique(number, return_inverse=True)
    return np.diff(u, prepend=0).astype("<u4"), np.bincount(back, weights=count, minlength=len(u)).astype("<u4")


def _squeezed(vectors: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """The vectors of a block, one after the other: all steps, then all frequencies, byte by byte of equal weight."""
    both = [np.concatenate([v[k] for v in vectors] or [np.zeros(0, "<u4")]) for k in (0, 1)]
    flat = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in both)
    return pa.Codec("zstd").compress(flat, asbytes=True)


def _spread(squeezed: bytes, total: int) -> tuple[np.ndarray, np.ndarray]:
    flat = pa.Codec("zstd").decompress(squeezed, decompressed_size=8 * total, asbytes=True)
    both = np.frombuffer(flat, np.uint8).reshape(2, 4, total)
    steps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in both)
    return steps, counts


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) for every row."""
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, no = worker_bpe(content.value), TaskContext.get().partitionId(), 0
        kinds, names = None, ["block", "base", "ids", "n_bytes", "n_held", "vectors", "pieces"]
        for batch in batches:
            kinds = kinds or batch.schema.field(0).type
            for part in slices(batch, "text", block_bytes):
                words, vectors = _vectors(part.column(1), _PIECES.findall, bpe)
                n, block = part.num_rows, (task << 32) + no
                no += 1
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([len(words)], pa.int64()), one(part.column(0)),
                     one(pc.cast(pc.binary_length(part.column(1)), pa.int64())), one(pa.array([len(v[0]) for v in vectors], pa.int64())),
                     pa.array([_squeezed(vectors)], pa.binary()), pa.nulls(1, pa.list_(pa.string()))],
                    names=names,
                )
                for a in range(0, len(words), 1 << 16):  # the list of a block, in rows of bounded size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([a], pa.int64()), pa.nulls(1, pa.list_(kinds)), pa.nulls(1, pa.list_(pa.int64())),
                         pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([words[a : a + (1 << 16)]], pa.list_(pa.string()))],
                        names=names,
                    )

    staged = stage(
        rows.mapInArrow(
            blocks, f"block bigint, base bigint, ids array<{id_type}>, n_bytes array<bigint>, n_held array<bigint>, vectors binary, pieces array<string>"
        ),
        "counts",
    )
    listed = staged.filter(F.col("pieces").isNotNull()).select("block", "base", F.posexplode("pieces").alias("at", "piece")).select(
        "block", (F.col("base") + F.col("at")).cast("int").alias("number"), "piece"
    )

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pre-token, so each is cut into pieces once, where it first stands."""
        bpe, last, size = worker_bpe(content.value), None, 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            n = []
            for p in coded.dictionary.to_pylist():
                if p != last:
                    last, size = p, len(bpe.ids(p)) if bpe.special.search(p) else _size(bpe, p)
                n.append(size)
            of = pa.array(n, pa.int32()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), of], names=["of_block", "number", "n"])

    known = listed.repartition("piece").sortWithinPartitions("piece").mapInArrow(sizes, "of_block bigint, number int, n int")
    known = known.filter("n != 1")  # the others count once, and need not go back
    texts = staged.filter(F.col("pieces").isNull()).drop("pieces")

    def total(texts: pa.Table, lists: pa.Table) -> pa.Table:
        """Sum frequency times pieces for the texts of one block."""
        out = []
        for i in range(texts.num_rows):  # a block is one row
            n = np.ones(texts["base"][i].as_py(), np.int64)
            n[lists["number"].to_numpy()] = lists["n"].to_numpy()
            ids, n_bytes, held = (texts[c][i].values for c in ("ids", "n_bytes", "n_held"))
            ends = np.cumsum(held.to_numpy())
            steps, counts = _spread(texts["vectors"][i].as_py(), int(ends[-1]))
            sums = [int((n[np.cumsum(steps[a:z])] * counts[a:z]).sum()) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            out.append(pa.table({"doc_id": ids, "n_bytes": n_bytes, "n_tokens": pa.array(sums, pa.int64())}))
        return pa.concat_tables(out)

    summed = texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        total, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _size(bpe: WordBpe, piece: str) -> int:
    """Number of tokens of one pre-token."""
    s = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(bpe.symbols)
    return len(bpe.tok.model.tokenize(s))
