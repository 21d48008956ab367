"""Operator 13: alignment of two tokenizers' tokens by lockstep merging.

Every text is encoded by a byte-level BPE file (A, over a space and the text)
and by a sentencepiece model (B, over the text, to which it adds the space).
Both give tokens whose bytes, joined, are the space and the text. Offsets
where a token of A and one of B both end cut a text into groups; a token of A
and one of B are linked where their bytes overlap.

The tokens of a slice of texts lie one behind the other, so a place in them is
a pair of numbers. One NumPy state vector holds such a pair for every lane: a
lane is a text or, of a longer text, a stretch of ``LANE`` tokens of A, so that
no text makes the others wait. Each step emits a link from every lane, moves
the pointer whose token ends first (both, and a cut, where they end together)
and compacts the vector when lanes have come to their end.

Counting pairs of ids over the corpus takes two Spark steps. Texts are kept in
blocks of some megabytes, and a block lists its distinct pairs, each with its
number of links. The lists of all blocks are added up by pair, and each
block gets back the sums of its own pairs, which its texts' links (numbers in
the list, kept as one compressed row a block) then look up. What is shuffled
are distinct pairs by block, not links. A frequent pair has one row a block;
the sums are partial first, and the join back is of the kind that Spark
splits where a partition is skewed.

Null and empty texts, and texts whose joined bytes differ on either side (a
text with U+2581, say), have no tokens: zeros, and '' as digest. Special
strings in a text are plain text. Repeated rows are texts of their own, in
the counts too. A text is processed whole in one task, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import BLANK, buffers, slices, stage, text_rows, worker_cache
from gridweave.llm.wordbpe import byte_symbols

LANE = 256  # tokens of A in a lane
BLOCK_TOKENS = 4 << 20  # tokens of A that make a block full
RUN_BYTES = 1000  # a longer run without a blank, or of blanks, is encoded by the file's own library

# Fixed value: the split pattern of byte-level BPE files.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---------------------------------------------------------------- tokenizers

class Coded:
    """Tokens of some texts: ``ids`` one behind the other, ``ends`` (bytes), ``first[i]``, the first token of text i."""

    def __init__(self, ids: list[list[int]], size: np.ndarray):
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.ids = np.fromiter(chain.from_iterable(ids), np.int32, int(self.first[-1]))
        self.ends = np.cumsum(size[self.ids])


class Aligner:
    """Both tokenizers, loaded, with the bytes of every id."""

    def __init__(self, byte_file: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(byte_file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_symbols())}
        spec = json.loads(byte_file)
        vocab = {k: i for k, i in spec["model"]["vocab"].items() if all(c in byte for c in k)}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        a = [b""] * (max(vocab.values(), default=-1) + 1)
        for k, i in vocab.items():
            a[i] = bytes(byte[c] for c in k)
        ranks = {a[i]: i for k, i in vocab.items() if k not in special}
        self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        b = []
        for i in range(self.pieces.get_piece_size()):
            p = self.pieces.id_to_piece(i)
            b.append(bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = pa.array(a, pa.binary()), pa.array(b, pa.binary())
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        text = lambda n, ends: pa.array([f"{i}{e}" for e in ends for i in range(n)], pa.string())
        self.text_a, self.text_b = text(len(a), ",|"), text(len(b), ",;")

    def encode(self, texts: list[str], odd: np.ndarray) -> tuple[Coded, Coded]:
        """Tokens of A and B; ``odd`` texts go through the file's own library."""
        ids = [self.whole.encode(" " + t, add_special_tokens=False).ids if o else self.fast.encode_ordinary(" " + t) for t, o in zip(texts, odd.tolist(), strict=True)]
        return Coded(ids, self.size_a), Coded(self.pieces.encode(texts, num_threads=1), self.size_b)


def long_runs(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have a run of over ``RUN_BYTES`` bytes that are all blanks or all not."""
    turn = np.zeros(len(data) + 1, bool)
    turn[offs] = True
    turn[1:-1] |= np.diff(BLANK[data])
    edge = np.flatnonzero(turn)
    long = edge[:-1][np.diff(edge) > RUN_BYTES]
    odd = np.zeros(len(offs) - 1, bool)
    odd[np.searchsorted(offs, long, "right") - 1] = True
    return odd


def joined(table: pa.Array, coded: Coded) -> np.ndarray:
    """The bytes of all tokens, joined."""
    return buffers(table.take(pa.array(coded.ids)))[0]


# ---------------------------------------------------------------- lockstep merging

def lockstep(a: Coded, b: Coded, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in ``a``, places in ``b``) and cuts (places of the last token of a group, in ``a`` and in ``b``).

    Both sides hold the same bytes, text by text.
    """
    begin = np.concatenate([np.arange(s, e, lane) for s, e in zip(a.first[:-1], a.first[1:], strict=True)] or [np.zeros(0, np.int64)])
    begin = begin.astype(np.int64)
    stop = np.concatenate([begin[1:], a.first[-1:]])[: len(begin)]  # a lane ends where the next begins
    at = np.concatenate([[0], a.ends])[begin]
    i, j = begin.copy(), np.searchsorted(b.ends, at, "right")
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        ea, eb = a.ends[i], b.ends[j]
        both = ea == eb
        cuts.append((i[both], j[both]))
        i, j = i + (ea <= eb), j + (eb <= ea)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    put = lambda got, k: np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64)
    return put(links, 0), put(links, 1), put(cuts, 0), put(cuts, 1)


class Aligned:
    """The alignment of some texts: per text ``n_a, n_b, n_groups, digest``, and all links as pairs of ids."""

    def __init__(self, col: pa.Array, tools: Aligner):
        data, offs = buffers(col)
        n = len(col)
        a, b = tools.encode(["" if t is None else t for t in col.to_pylist()], long_runs(data, offs))
        self._same(data, offs, a, b, tools)
        if not self.good.all():  # texts without tokens leave both sides
            a, b = self._only(a, tools.size_a), self._only(b, tools.size_b)
        self.n_a, self.n_b = np.diff(a.first), np.diff(b.first)
        i, j, ca, cb = lockstep(a, b)
        of = np.searchsorted(a.first, i, "right") - 1
        order = np.argsort(of, kind="stable")
        self.pairs = (a.ids[i].astype(np.int64) << 32 | b.ids[j])[order]
        self.first = np.searchsorted(of[order], np.arange(n + 1))
        self.n_groups = np.bincount(np.searchsorted(a.first, ca, "right") - 1, minlength=n)
        self.digest = self._digests(a, b, np.sort(ca), np.sort(cb), tools)

    def _same(self, data: np.ndarray, offs: np.ndarray, a: Coded, b: Coded, tools: Aligner) -> None:
        n = len(offs) - 1
        size = np.diff(offs)
        want = np.full(len(data) + n, 0x20, np.uint8)
        want[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), size)] = data
        edge = offs + np.arange(n + 1)
        self.good = size > 0
        for coded, table in ((a, tools.bytes_a), (b, tools.bytes_b)):
            got = joined(table, coded)
            to = np.concatenate([[0], coded.ends])[coded.first]
            if np.array_equal(to, edge) and np.array_equal(got, want):
                continue
            self.good &= [np.array_equal(got[to[k] : to[k + 1]], want[edge[k] : edge[k + 1]]) for k in range(n)]

    def _only(self, coded: Coded, size: np.ndarray) -> Coded:
        return Coded([coded.ids[s:e].tolist() if ok else [] for s, e, ok in zip(coded.first[:-1], coded.first[1:], self.good, strict=True)], size)

    def _digests(self, a: Coded, b: Coded, ca: np.ndarray, cb: np.ndarray, tools: Aligner) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text, as a digest: all tokens in the order of the line, each with what follows it."""
        na, nb = len(tools.size_a), len(tools.size_b)
        last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        last_a[ca], last_b[cb] = True, True
        word = np.concatenate([a.ids + na * last_a, b.ids + nb * last_b + len(tools.text_a)])
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        line = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        table = pa.concat_arrays([tools.text_a, tools.text_b])
        text, offs = buffers(table.take(pa.array(word[line])))
        ends = np.concatenate([[0], offs])[1:][a.first + b.first]
        raw = memoryview(text.tobytes())
        return [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def worker_aligner(byte_file: str, piece_model: bytes) -> Aligner:
    held = worker_cache("aligner", dict)
    if (key := hash((byte_file, piece_model))) not in held:
        held.clear()
        held[key] = Aligner(byte_file, piece_model)
    return held[key]


# ---------------------------------------------------------------- the operator

def _packed(number: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of equal weight."""
    flat = np.ascontiguousarray(number.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.Codec("zstd").compress(flat, asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    flat = pa.Codec("zstd").decompress(packed, decompressed_size=4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, n).T).view("<u4").ravel()


def aligned_blocks(docs: DataFrame, byte_file: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of two kinds: a block's texts (``ids, numbers, digests, links``), or a part of its distinct ``pairs``, each with its links.

    ``numbers`` has n_a, n_b, n_groups and n_links of every text in turn;
    ``links`` names, text by text, each link's place in the block's pairs.
    """
    sc = docs.sparkSession.sparkContext
    with open(byte_file, encoding="utf-8") as f, open(piece_model, "rb") as g:
        sent = sc.broadcast((f.read(), g.read()))  # two vocabulary files
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["block", "ids", "numbers", "digests", "links", "pairs", "counts"]
    schema = f"block bigint, ids array<{id_type}>, numbers array<bigint>, digests array<string>, links binary, pairs array<bigint>, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, task, no = worker_aligner(*sent.value), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, Aligned]] = []

        def block() -> Iterator[pa.RecordBatch]:
            kind = held[0][0].type
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            pairs, place, count = np.unique(np.concatenate([x.pairs for _, x in held]), return_inverse=True, return_counts=True)
            numbers = np.concatenate([np.stack([x.n_a, x.n_b, x.n_groups, np.diff(x.first)], axis=1) for _, x in held])
            at = pa.array([(task << 32) + no], pa.int64())
            texts = [one(pa.concat_arrays([i for i, _ in held])), one(pa.array(numbers.ravel())), one(pa.array([d for _, x in held for d in x.digest], pa.string()))]
            yield pa.RecordBatch.from_arrays([at, *texts, pa.array([_packed(place)], pa.binary()), *2 * [pa.nulls(1, pa.list_(pa.int64()))]], names=names)
            for k in range(0, len(pairs), 1 << 16):
                listed = [one(pa.array(x[k : k + (1 << 16)], pa.int64())) for x in (pairs, count)]
                yield pa.RecordBatch.from_arrays([at, pa.nulls(1, pa.list_(kind)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.binary()), *listed], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                held.append((part.column(0), Aligned(part.column(1), tools)))
                if sum(len(x.pairs) for _, x in held) >= block_tokens:
                    yield from block()
                    held, no = [], no + 1
        if held:
            yield from block()

    return rows.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, links, best`` of every linked pair of ids: its links in the corpus, and whether no pair of its B id has more."""
    listed = blocks.filter(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    sums = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("links"))
    sums = stage(sums, "pairs")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = sums.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))  # one row for each id of B at most
    return sums.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_file: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    blocks = stage(aligned_blocks(docs, byte_file, piece_model, id_col, text_col, block_tokens), "aligned")
    id_type = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
    listed = blocks.filter(F.col("pairs").isNotNull()).select("block", F.explode("pairs").alias("pair"))
    known = listed.join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "pair", "links", "best")
    texts = blocks.filter(F.col("pairs").isNull()).select("block", "ids", "numbers", "digests", "links")

    def look_up(texts: pa.Table, sums: pa.Table) -> pa.Table:
        """Counts of the links of one block's texts; ``sums`` has its pairs, each once."""
        order = np.argsort(sums["pair"].to_numpy())
        links, best = sums["links"].to_numpy()[order], sums["best"].to_numpy()[order]
        out = []
        for r in range(texts.num_rows):  # a block is one row
            ids, numbers, digests = (texts[c][r].values for c in ("ids", "numbers", "digests"))
            n = numbers.to_numpy().reshape(-1, 4)
            place = _unpacked(texts["links"][r].as_py(), int(n[:, 3].sum()))
            first = np.concatenate([[0], np.cumsum(n[:, 3])])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])[first])
            out.append(pa.table({
                "doc_id": ids, "n_a": n[:, 0], "n_b": n[:, 1], "n_groups": n[:, 2], "n_links": n[:, 3],
                "n_best": total(best), "count_sum": total(links), "groups_sha256": digests,
            }))
        return pa.concat_tables(out)

    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        look_up, f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
