"""Operator 10: token ids in training order, as fixed-stride binary rows.

Every text is encoded and cut into sequences of ``seq_len`` ids (the last one
is padded), stored as ``stride`` bytes each. The sequences of the table are
numbered 0 .. N-1, and a keyed Feistel permutation with cycle-walking gives
every number its global slot in training order: a bijection on 0 .. N-1 that
any task computes by itself, without a shuffle of a permutation table. Slots
are dealt out by range, so that each partition writes whole shards of
``shard_rows`` consecutive slots, sorted. :func:`write_shards` writes them as raw
files, in which a reader finds slot ``s`` in shard ``s // shard_rows`` at byte
``s % shard_rows * stride`` and goes on from there.

Null and empty texts have no sequences. Repeated rows give sequences of their
own. The order depends only on the key, N and the numbering, which follows the
staged table of encoded texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import mix, slices, stage, text_rows
from gridweave.llm.wordbpe import read_tokenizer, worker_bpe

SEQ_LEN, SHARD_ROWS, PARTITION_ROWS, ROUNDS = 512, 8192, 1 << 17, 6
_U = np.uint64


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0 .. n-1, applied to every value of ``x``.

    A balanced network on the smallest even number of bits that holds n-1;
    a value that falls outside is sent through again until it is inside.
    """
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, out = _U((1 << half) - 1), np.array(x, _U)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key & (1 << 64) - 1))
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def training_order(
    docs: DataFrame, tokenizer_path: str, key: int, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
    pad_id: int = 0, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``slot, shard, shard_row, doc_id, seq_no, n_tokens, tokens`` for every sequence, laid out in slot order.

    ``tokens`` has ``seq_len`` little-endian unsigned 16-bit ids (32-bit if
    the vocabulary needs it), ``n_tokens`` of which are not padding.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, start = worker_bpe(content.value), TaskContext.get().partitionId(), 0
        small = bpe.tok.get_vocab_size() <= 1 << 16
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids = [x[0] for x in bpe.encode(part.column(1))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                seqs = -(-n // seq_len)
                first = start + np.cumsum(seqs) - seqs
                start += int(seqs.sum())
                if small:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(ids), pa.int32()), pa.array(first), pa.array(seqs), part.column(0), pa.array(n), pa.array(ids, pa.binary())],
                    names=["task", "first", "n_seq", "doc_id", "n_ids", "ids"],
                )

    staged = stage(rows.mapInArrow(encode, f"task int, first bigint, n_seq bigint, doc_id {id_type}, n_ids bigint, ids binary"), "ids")
    by_task = staged.groupBy("task").agg(F.sum("n_seq").alias("n"))  # one row for each task that wrote
    before = by_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    total = by_task.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PARTITION_ROWS))
    shards = max(1, -(-total // shard_rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = worker_bpe(content.value).tok.get_vocab_size() <= 1 << 16
        kind = np.dtype("<u2" if small else "<u4")
        for whole in batches:
            for batch in slices(whole, "ids", 4 << 20):
                n, seqs = batch.column(3).to_numpy(), batch.column(1).to_numpy()
                k = int(seqs.sum())
                if not k:
                    continue
                doc = np.repeat(np.arange(len(n)), seqs)
                no = np.arange(k) - np.repeat(np.cumsum(seqs) - seqs, seqs)
                held = np.minimum(seq_len, n[doc] - no * seq_len)
                grid = np.full((k, seq_len), pad_id, kind)
                ids = np.frombuffer(b"".join(batch.column(4).to_pylist()), kind)
                grid[np.arange(seq_len) < held[:, None]] = ids  # row by row, as the ids stand
                slot = feistel(batch.column(0).to_numpy()[doc] + no, total, key)
                stride = pa.py_buffer(np.arange(0, (k + 1) * seq_len * kind.itemsize, seq_len * kind.itemsize, dtype="<i4").tobytes())
                tokens = pa.Array.from_buffers(pa.binary(), k, [None, stride, pa.py_buffer(grid.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), batch.column(2).take(pa.array(doc)), pa.array(no, pa.int32()), pa.array(held, pa.int32()), tokens],
                    names=["slot", "doc_id", "seq_no", "n_tokens", "tokens"],
                )

    placed = staged.join(F.broadcast(before) if by_task_is_small(staged) else before, "task").select(
        (F.col("first") + F.col("base")).alias("first"), "n_seq", "doc_id", "n_ids", "ids"
    ).mapInArrow(cut, f"slot bigint, doc_id {id_type}, seq_no int, n_tokens int, tokens binary")
    shard = F.floor(F.col("slot") / shard_rows).cast("bigint")
    placed = placed.withColumn("shard", shard).withColumn("shard_row", (F.col("slot") - F.col("shard") * shard_rows).cast("int"))
    dealt = placed.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int"))
    return dealt.sortWithinPartitions("slot").select("slot", "shard", "shard_row", "doc_id", "seq_no", "n_tokens", "tokens")


def by_task_is_small(staged: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of tasks may be broadcast: a row of it stands for a task that wrote a file."""
    return len(staged.inputFiles()) <= most


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write every shard as a raw file and return the manifest ``shard, first_slot, n_rows, n_bytes, file``.

    Row ``i`` of shard ``s`` stands in ``<folder>/shard-<s>.bin`` at byte
    ``i * stride``. ``folder`` is one that all executors share, as a path or as
    a URI that Arrow's file systems open. A shard is written under a name of
    its own and then renamed, so a file that is there is whole, and a task that
    runs again writes the same file. The manifest itself is written as Parquet
    to ``<folder>/manifest`` when all shards are there.
    """
    spark = ordered.sparkSession

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                name = f"{root}/shard-{shard:08d}.bin"
                part = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(payload.as_buffer())
                store.move(part, name)
                sizes.append((payload.as_buffer().size, f"shard-{shard:08d}.bin"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([n for n, _ in sizes], pa.int64()), pa.array([f for _, f in sizes], pa.string())],
                names=["shard", "first_slot", "n_rows", "n_bytes", "file"],
            )

    done = shard_payloads(ordered).mapInArrow(put, "shard bigint, first_slot bigint, n_rows int, n_bytes bigint, file string")
    done.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def shard_payloads(ordered: DataFrame) -> DataFrame:
    """``shard, first_slot, n_rows, payload``: the bytes of each shard, row ``i`` at byte ``i * stride``.

    Rows must come as :func:`training_order` lays them out: whole shards in a
    partition, by slot. Memory is bounded by one shard.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now, begin = None, 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([begin], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())],
                names=["shard", "first_slot", "n_rows", "payload"],
            )

        for batch in batches:
            for shard, slot, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if held:
                        yield out()
                    now, begin, held = shard, slot, []
                held.append(tokens)
        if held:
            yield out()

    return ordered.select("shard", "slot", "tokens").mapInArrow(pack, "shard bigint, first_slot bigint, n_rows int, payload binary")


def resume(ordered: DataFrame, slot: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows from ``slot`` on; on rows kept by shard, of ``shard_rows`` each, earlier shards are skipped."""
    return ordered.filter((F.col("shard") >= slot // shard_rows) & (F.col("slot") >= slot))
