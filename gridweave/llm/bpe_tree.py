"""Operator 1: BPE encoding and decoding by tree concatenation.

A text longer than ``leaf_chars`` is halved again and again. A half ends at
white space where there is some near the middle: the tokenizer drops white
space, so the two sides encode on their own. Where there is none (long
unsplit text), the cut is made in mid-word. The leaves are dealt out and
encoded in parallel as Spark rows. A cut in mid-word is then mended from the
leaves up: a window around the join is encoded anew and grows until it holds,
on each side, a token that the side has too, at the same characters. In BPE a
token sequence is the encoding of its text exactly if all its neighbouring
pairs are, so the left side up to its token, the window between, and the
right side from its token on are together the encoding of the whole.

Null texts are empty; empty texts have no tokens. Repeated rows give one
result row each. Very long texts cost one task the ids of that text, never
its re-encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import slices, text_key, text_rows
from gridweave.llm.wordbpe import WordBpe, read_tokenizer, worker_bpe

LEAF_CHARS = 16384
WINDOW_CHARS = 64  # first reach of a window to each side of a join; it doubles

_BLANKS = " \t\n\r"  # white space to the tokenizer; a cut before one is exact


def halves(text: str, leaf: int) -> list[tuple[int, int, bool]]:
    """Leaves of a text as (start, end, whether the cut before it is in mid-word)."""
    out: list[tuple[int, int, bool]] = []
    todo = [(0, len(text), False)]
    while todo:
        a, z, rough = todo.pop()
        if z - a <= leaf:
            out.append((a, z, rough))
            continue
        mid, reach = (a + z) // 2, (z - a) // 4
        near = max(text.rfind(c, mid - reach, mid + 1) for c in _BLANKS)
        if near <= a:
            found = [p for c in _BLANKS if (p := text.find(c, mid, mid + reach)) > a]
            near = min(found, default=-1)
        cut, hard = (near, False) if near > a else (mid, True)
        todo.append((cut, z, hard))
        todo.append((a, cut, rough))
    return out


class Node:
    """A stretch ``[start, end)`` of a text with its tokens: ids, and the characters each covers."""

    def __init__(self, start: int, end: int, ids: np.ndarray, s: np.ndarray, e: np.ndarray):
        self.start, self.end, self.ids, self.s, self.e = start, end, ids, s, e

    @classmethod
    def of(cls, bpe: WordBpe, text: str, a: int, z: int) -> Node:
        got = bpe.tok.encode(text[a:z], add_special_tokens=False)
        spans = np.array(got.offsets, np.int64).reshape(-1, 2) + a
        return cls(a, z, np.array(got.ids, np.int64), spans[:, 0], spans[:, 1])

    def clean(self) -> np.ndarray:
        """Tokens that begin where a character does."""
        return np.concatenate([[True], self.s[1:] >= self.e[:-1]]) if len(self.s) else np.zeros(0, bool)


def _common(side: Node, window: Node, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, in both sequences, of the same token at the same characters within [lo, hi)."""
    i = np.flatnonzero(side.clean() & (side.s >= lo) & (side.e <= hi))
    j = np.flatnonzero(window.clean() & (window.s >= lo) & (window.e <= hi))
    _, a, b = np.intersect1d(side.s[i], window.s[j], return_indices=True)
    same = (side.ids[i[a]] == window.ids[j[b]]) & (side.e[i[a]] == window.e[j[b]])
    return i[a][same], j[b][same]


def join(bpe: WordBpe, text: str, left: Node, right: Node) -> Node:
    """The encoding of two neighbouring stretches, from those of each."""
    cut, reach = left.end, WINDOW_CHARS
    while True:
        a, z = max(left.start, cut - reach), min(right.end, cut + reach)
        w = Node.of(bpe, text, a, z)
        i, j = (np.zeros(1, int), np.zeros(1, int)) if a == left.start else _common(left, w, a, cut)
        k, m = (np.array([len(right.ids)]), np.array([len(w.ids)])) if z == right.end else _common(right, w, cut, z)
        if len(i) and len(k) and j[0] <= m[-1]:
            put = lambda n: np.concatenate([getattr(left, n)[: i[0]], getattr(w, n)[j[0] : m[-1]], getattr(right, n)[k[-1] :]])
            return Node(left.start, right.end, put("ids"), put("s"), put("e"))
        reach *= 2


def tree(bpe: WordBpe, text: str, nodes: list[Node]) -> Node:
    """Join neighbouring stretches pair by pair until one is left."""
    while len(nodes) > 1:
        nodes = [join(bpe, text, nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]



def encode_texts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS,
    digest: bool = False,
) -> DataFrame:
    """Encode and decode every text.

    Returns ``doc_id, n_tokens, ids, decoded``: the ids as little-endian
    unsigned 32-bit integers, the decoded text as the tokenizer's decode gives
    it. With ``digest`` the last two are lowercase SHA-256 digests instead
    (``ids_sha256, decoded_sha256``), so that long columns are not moved.
    ``doc_id`` keeps the type of ``id_col``.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    last = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"
    schema = f"doc_id {id_type}, n_tokens bigint, {last}"

    def finish(ids: bytes, text: bytes) -> tuple:
        if digest:
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()
        return len(ids) // 4, ids, text.decode()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(content.value)
        for batch in batches:
            for part in slices(batch, "text"):
                done = [finish(*x) for x in bpe.encode(part.column(1), spell=True)]
                yield _batch(part.column(0), done, digest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for r in range(part.num_rows):
                    text = part.column(1)[r].as_py()
                    leaves = halves(text, leaf_chars)
                    rough = [h or (i + 1 < len(leaves) and leaves[i + 1][2]) for i, (_, _, h) in enumerate(leaves)]
                    chain = np.cumsum([not h for _, _, h in leaves]) - 1  # leaves between cuts at white space
                    n = len(leaves)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.column(0)[r].as_py()] * n, part.schema.field(0).type), pa.array([part.column(2)[r].as_py()] * n), pa.array(range(n), pa.int32()),
                         pa.array(chain, pa.int32()), pa.array([text[a:z] for a, z, _ in leaves]), pa.array(rough, pa.bool_())],
                        names=["doc_id", "key", "part", "chain", "piece", "rough"],
                    )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(content.value)
        for whole in batches:
            for batch in slices(whole, "piece"):
                ids, spans, raw = [], [], []
                coded = bpe.encode(batch.column(4).filter(_not(batch.column(5))))
                plain = iter(coded)
                for piece, rough in zip(batch.column(4), batch.column(5), strict=True):
                    if rough.as_py():
                        node = Node.of(bpe, piece.as_py(), 0, len(piece.as_py()))
                        ids.append(node.ids.astype("<u4").tobytes())
                        spans.append(np.stack([node.s, node.e]).astype("<u4").tobytes())
                        raw.append(piece.as_py())
                    else:
                        ids.append(next(plain)[0])
                        spans.append(None)
                        raw.append(None)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(raw, pa.string())],
                    names=["doc_id", "key", "part", "chain", "ids", "spans", "raw"],
                )

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Put the leaves of one text together; ``key`` names the text."""
        bpe = worker_bpe(content.value)
        table = table.sort_by("part")
        part = table["part"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        copies = int(np.sum(part == 0))  # repeated rows bring the same leaves again
        got, i = [], 0
        chain = table["chain"].to_numpy()[first]
        while i < len(first):
            j = i + 1
            while j < len(first) and chain[j] == chain[i]:
                j += 1
            if j == i + 1:
                got.append(table["ids"][first[i]].as_py())
            else:
                raws = [table["raw"][r].as_py() for r in first[i:j]]
                nodes, at = [], 0
                for r, raw in zip(first[i:j], raws, strict=True):
                    se = np.frombuffer(table["spans"][r].as_py(), "<u4").astype(np.int64).reshape(2, -1) + at
                    ids = np.frombuffer(table["ids"][r].as_py(), "<u4").astype(np.int64)
                    nodes.append(Node(at, at + len(raw), ids, se[0], se[1]))
                    at += len(raw)
                got.append(tree(bpe, "".join(raws), nodes).ids.astype("<u4").tobytes())
            i = j
        ids = b"".join(got)
        done = finish(ids, bpe.spelled(np.frombuffer(ids, "<u4").tolist()))
        out = _batch(pa.array([key[0].as_py()], table.schema.field("doc_id").type), [done], digest)
        return pa.Table.from_batches([out] * copies)

    longer = F.length("text") > leaf_chars
    short = rows.filter(~longer).mapInArrow(whole, schema)
    pieces = rows.filter(longer).withColumn("key", text_key(F.col("text"))).mapInArrow(
        cut, f"doc_id {id_type}, key string, part int, chain int, piece string, rough boolean"
    )
    leaves = pieces.repartition("doc_id", "part").mapInArrow(
        leaf, f"doc_id {id_type}, key string, part int, chain int, ids binary, spans binary, raw string"
    )
    return short.unionByName(leaves.groupBy("doc_id", "key").applyInArrow(grow, schema))


def _not(mask: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.invert(mask)


def _batch(ids: pa.Array, done: list[tuple], digest: bool) -> pa.RecordBatch:
    n, a, b = zip(*done, strict=True) if done else ((), (), ())
    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kinds = [pa.string(), pa.string()] if digest else [pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1])], names=["doc_id", "n_tokens", *names]
    )
