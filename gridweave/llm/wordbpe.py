"""Encoding with the word-level BPE tokenizer file, shared by the BPE operators.

The tokenizer drops white space, so the text between two blanks encodes on
its own. Most texts repeat their words: a slice of texts is split at blanks
and dictionary-encoded by Arrow, every distinct word is encoded once, and
texts are put together from the encodings of their words. A text with
characters outside a small set whose normal form is known (see
``plain_rows``), or with special strings, goes through the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridweave.llm.common import buffers, worker_cache

CACHE_WORDS, CACHE_CHARS = 1 << 17, 1 << 21  # distinct words of a generation that a worker remembers, and their characters

# The split pattern of the tokenizer file, for text in lower case whose
# characters plain_rows() lets pass.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

# Bytes of plain texts: ASCII without the separators 1C-1F, and the lead bytes of
# U+00C0 to U+017F. None of these characters changes under NFC.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x00:0x1C] = _PLAIN[0x20:0x80] = _PLAIN[0x80:0xC0] = _PLAIN[0xC3:0xC6] = True


def byte_symbols() -> list[str]:
    """The visible character that byte-level BPE uses for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def plain_rows(col: pa.Array) -> np.ndarray:
    """Which texts hold only characters that need no library normalisation."""
    data, offs = buffers(col)
    odd = ~_PLAIN[data]
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)  # its lower case has two characters
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # may begin a special string
    seen = np.concatenate([[0], np.cumsum(odd)])
    return seen[offs[1:]] == seen[offs[:-1]]


class WordBpe:
    """A loaded tokenizer file with a bounded memory of encoded words."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(content)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tokenize = self.tok.model.tokenize  # the model is wrapped anew at each access
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u4")
        self.strings = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.table = pa.array([s + b" " for s in self.strings], pa.binary())
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")
        self.words: dict[str, bytes] = {}  # this generation, and the one before it
        self.before: dict[str, bytes] = {}
        self.held = 0  # characters in self.words

    # -- single texts, by the library
    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def spelled(self, ids) -> bytes:
        """The decoded text: without a decoder the token strings stand apart by blanks."""
        return b" ".join([self.strings[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of any text, special strings included as they are."""
        out, at = [], 0
        for m in [*self.special.finditer(text), None]:
            part = self.tok.normalizer.normalize_str(text[at : m.start() if m else len(text)])
            out += [part[a:z] for _, (a, z) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
            if m:
                out.append(m[0])
                at = m.end()
        return out

    # -- words of plain texts
    def word(self, w: str) -> bytes:
        """Ids of a lower-case word as bytes."""
        if (known := self.words.get(w)) is None:
            if (known := self.before.get(w)) is None:
                tokenize = self.tokenize
                if w.isascii() and w.isalpha():
                    ids = [t.id for t in tokenize(w)]
                else:
                    ids = []
                    for p in _PIECES.findall(w):
                        s = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.symbols)
                        ids += [t.id for t in tokenize(s)]
                known = array("I", ids).tobytes()  # four bytes each, as the platform orders them
            if len(self.words) >= CACHE_WORDS or self.held > CACHE_CHARS:
                self.before, self.words, self.held = self.words, {}, 0  # words still in use come over one by one
            self.words[w] = known
            self.held += len(w)
        return known

    @staticmethod
    def split(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct lower-case words of plain texts, the word number at each place, and the offsets by text."""
        parts = pc.utf8_split_whitespace(pc.utf8_lower(col))
        offs = np.asarray(parts.offsets).astype(np.int64)
        flat = parts.values.slice(offs[0], offs[-1] - offs[0])
        empty = np.asarray(pc.equal(pc.binary_length(flat), 0))  # the split gives empty strings at the ends of a text
        kept = np.concatenate([[0], np.cumsum(~empty)])
        coded = flat.filter(pa.array(~empty)).dictionary_encode()
        return coded.dictionary.to_pylist(), np.asarray(coded.indices), kept[offs - offs[0]]

    def spell(self, ids: list[bytes], index: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The decoded texts, from the ids of each distinct word and the words' places."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = self.table.take(pa.array(np.frombuffer(b"".join(ids), self.dtype)))
        data, ends = buffers(flat)
        edge = np.concatenate([[0], ends[np.cumsum(size)]])
        words = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        out, at = buffers(words.take(pa.array(index)))
        whole, at = memoryview(out.tobytes()), at[offs - offs[0]].tolist()
        return [bytes(whole[a : max(a, z - 1)]) for a, z in zip(at[:-1], at[1:], strict=True)]

    def encode(self, col: pa.Array, spell: bool = False) -> list[tuple[bytes, bytes]]:
        """For every text: ids as little-endian 32-bit integers, and, if ``spell``, the decoded text."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if col.null_count:
            col = pc.fill_null(col, "")
        plain = plain_rows(col)
        out: list = [None] * len(col)
        rows = np.flatnonzero(plain)
        if len(rows):
            vocab, index, offs = self.split(col if len(rows) == len(col) else col.filter(pa.array(plain)))
            ids = [self.word(w) for w in vocab]
            whole, at = buffers(pa.array(ids, pa.large_binary()).take(pa.array(index)))  # of all texts, one behind the other
            whole, at = memoryview(whole.tobytes()), at[offs].tolist()
            for r, a, z in zip(rows.tolist(), at[:-1], at[1:], strict=True):
                out[r] = bytes(whole[a:z])
            texts = self.spell(ids, index, offs) if spell else [b""] * len(rows)
            for r, text in zip(rows.tolist(), texts, strict=True):
                out[r] = (out[r], text)
        for r in np.flatnonzero(~plain).tolist():
            ids = self.ids(col[r].as_py())
            out[r] = (np.array(ids, self.dtype).tobytes(), self.spelled(ids) if spell else b"")
        return out


def worker_bpe(content: str) -> WordBpe:
    """The tokenizer of this worker, loaded once for each file content."""
    held = worker_cache("bpe", dict)
    if content not in held:
        held.clear()
        held[content] = WordBpe(content)
    return held[content]


def read_tokenizer(path: str) -> str:
    """Content of a tokenizer file (a megabyte or two), to be sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
