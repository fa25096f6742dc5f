"""Subword ids of whole texts, by distinct chunks.

A byte-level BPE splits a text before it merges, and never inside or across the start of a
single blank or newline between two ASCII non-blanks or letters of the Latin-1 block.  Texts are
therefore cut there, each Arrow batch's distinct chunks are found by one C++ dictionary encoding,
and only those reach the tokenizer.  The ids equal those of
encoding the texts whole.  What isn't UTF-8 in a text counts as U+FFFD.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from auditlake.llm import core

#: Where the public vocabulary files are; a parameter of every operator that tokenizes.
TOKENIZERS = os.environ.get("AUDITLAKE_TOKENIZERS", "/opt/tokenizers")
BPE_FILE = "byte_bpe_50k.tiktoken"
VOCABULARY = 50_256
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 4 << 20
#: Where only numbers of ids are wanted: a quarter of the memory for a fifth more time.
COUNT_SLICE = 1 << 20
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


@lru_cache(2)
def encoder(folder: str = TOKENIZERS):
    import tiktoken

    with open(os.path.join(folder, BPE_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("auditlake", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted starts of the chunks of all non-empty rows."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        solid = _SOLID[buf]
        blank = (buf == 32) | (buf == 10)
        latin = (buf >= 128) & (np.concatenate([[0], buf[:-1]]) == 0xC3)  # U+00C0 to U+00FF: no white space
        cut[1 : n - 1] = blank[1:-1] & (solid | latin)[:-2] & (_SOLID | _LEAD)[buf[2:]]
    edges = off[:-1][np.diff(off) > 0]
    cut[off[1:-1]] = False
    cut[np.maximum(off[1:] - 1, 0)] = False  # a blank at a row's end stays with what is before it
    cut[edges] = True
    return np.flatnonzero(cut[:n])


_LEAD = np.zeros(256, bool)
_LEAD[0xC3] = True


class Chunks:
    """Distinct chunks of a slice: ``code`` numbers each chunk, ``values`` are the distinct ones."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.starts = chunk_starts(buf, off)
        bounds = np.append(self.starts, len(buf)).astype(np.int64)
        arr = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        enc = arr.dictionary_encode()
        self.code = np.asarray(enc.indices)
        self.values = enc.dictionary
        self.first = np.searchsorted(self.starts, off)


class Encoder:
    """Ids of chunks.  Chunks that may follow one another go to the tokenizer as one string, and the
    ids' byte lengths give each chunk its share; the few others (row starts, odd ends) go alone."""

    def __init__(self, folder: str = TOKENIZERS):
        self.bpe = encoder(folder)._core_bpe
        self.size = np.array([len(self.bpe.decode_single_token_bytes(i)) for i in range(VOCABULARY)], np.int64)

    def distinct(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each chunk plus the total) of distinct chunks."""
        n = len(values)
        _, offs, data = values.buffers()
        off = np.frombuffer(offs, np.int64)[values.offset : values.offset + n + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start, end = off[:-1], off[1:]
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        long = end - start >= 3
        head, second, last = buf[start], buf[np.minimum(start + 1, len(buf) - 1)], buf[end - 1]
        before = buf[np.maximum(end - 2, 0)]
        joins = long & ((head == 32) | (head == 10)) & (_SOLID | _LEAD)[second] & (_SOLID[last] | ((last >= 128) & (before == 0xC3)))
        lens = np.zeros(n, np.int64)
        # one string of all that join
        keep = np.repeat(joins, end - start)
        joined = buf[off[0] : off[-1]][keep]
        ids = np.array(self.bpe.encode_ordinary(joined.tobytes().decode()), np.int32)
        ends = np.cumsum((end - start)[joins])
        upto = np.searchsorted(np.cumsum(self.size[ids]), ends, "right")
        lens[joins] = np.diff(upto, prepend=0)
        alone = [self.bpe.encode_ordinary(values[int(i)].as_py().decode("utf-8", "replace")) for i in np.flatnonzero(~joins)]
        lens[~joins] = [len(x) for x in alone]
        first = np.concatenate([[0], np.cumsum(lens)])
        flat = np.empty(int(first[-1]), np.int32)
        of_joined = np.repeat(joins, lens)
        flat[of_joined] = ids
        flat[~of_joined] = [i for x in alone for i in x]
        return flat, first

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text; 0 for null."""
        out = np.zeros(len(texts), np.int64)
        for at, n, buf, off in core.slices(core.valid_utf8(texts), COUNT_SLICE):
            c = Chunks(buf, off)
            _, first = self.distinct(c.values)
            out[at : at + n] = core.per_row(np.diff(first)[c.code], c.first)
        return out

    def slices(self, texts: pa.Array, limit: int = SLICE):
        """(first row, rows, ids, first id of each row plus the total) of consecutive slices."""
        for at, n, buf, off in core.slices(core.valid_utf8(texts), limit):
            c = Chunks(buf, off)
            flat, first = self.distinct(c.values)
            lens = np.diff(first)[c.code]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            at_id = np.arange(total) - np.repeat(ends - lens, lens) + np.repeat(first[c.code], lens)
            yield at, n, flat[at_id], np.concatenate([[0], ends])[c.first]


_encoders: dict[str, Encoder] = {}


def shared(folder: str = TOKENIZERS) -> Encoder:
    """This worker's encoder."""
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]
