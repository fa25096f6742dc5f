"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The public byte-fallback BPE model is read, never trained.  No piece continues over a blank that
follows another character, so texts are segmented chunk by chunk (blanks, then all up to the next
blank).  Within a chunk the agenda pops the candidate merge of best score (ties: leftmost); a
candidate (start, middle, end) is skipped for good when a keyed hash of (seed, doc_id, number of
the chunk in its text, candidate) falls under ``rate``.  Equal seeds give equal ids, each seed
another segmentation, and ``rate`` 0 the model's own.  All chunks of a slice advance together
in numpy, one pop each a round; chunks of over ``WIDE`` characters use a heap with the same keys.

Decoding joins the pieces' bytes: a literal U+2581 and characters without a piece are byte pieces, so every text comes back exactly.

Defined results: what isn't UTF-8 in a text is encoded as U+FFFD; null text gives null ids, an empty text no ids; repeated rows get equal ids; a null
doc_id hashes as 0; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core
from auditlake.llm.langid import Table
from auditlake.llm.subwords import TOKENIZERS

MODEL_FILE = "piece_bpe_32k.model"
RATE, SEED, WIDE = 0.1, 20240501, 40
_NONE = np.int32(2**31 - 1)
SLICE = 3 << 20


class Pieces:
    """The model's pieces and the merges that lead to each."""

    def __init__(self, folder: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, MODEL_FILE))
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {self.text[i]: i for i in normal}
        for t in ids:
            if "▁" in t.lstrip("▁"):
                raise ValueError(f"piece {t!r} goes over a blank")
        self.byte = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [t.replace("▁", " ").encode() for t in self.text]
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.text[i][3:5], 16)] = i
                self.bytes[i] = bytes([int(self.text[i][3:5], 16)])
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes[i] = b""
        self.of_char = np.full(0x110000, -1, np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        self.blank = self.of_char[0x2581]
        self.of_char[0x2581] = -1
        self.of_char[32] = self.blank
        # priority: position by falling score, ties by id
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = (i, rank[i])
        keys = np.array(list(pairs), np.uint64)
        self.pairs = pairs
        self.table = Table(keys, np.zeros((len(keys), 1)))
        at = self.table.find(keys)
        self.merged, self.rank = np.zeros(len(self.table.keys), np.int32), np.full(len(self.table.keys), _NONE)
        self.merged[at] = [v[0] for v in pairs.values()]
        self.rank[at] = [v[1] for v in pairs.values()]

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs; no rank if they don't merge."""
        rank, merged = np.full(len(a), _NONE), np.zeros(len(a), np.int32)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        at = self.table.find(a[ok].astype(np.uint64) << np.uint64(16) | b[ok].astype(np.uint64))
        hit = at >= 0
        rank[ok[hit]], merged[ok[hit]] = self.rank[at[hit]], self.merged[at[hit]]
        return rank, merged


@lru_cache(2)
def pieces(folder: str = TOKENIZERS) -> Pieces:
    return Pieces(folder)


def _skipped(key: np.ndarray, start, middle, end, rate: float) -> np.ndarray:
    """The keyed hash's verdict on candidates (positions in characters of their chunk)."""
    c = np.asarray(start).astype(np.uint64) << np.uint64(42) | np.asarray(middle).astype(np.uint64) << np.uint64(21) | np.asarray(end).astype(np.uint64)
    return (core.mix(key + c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) < rate * float(1 << 53)


def _heap(p: Pieces, syms: list[int], key: int, rate: float) -> list[int]:
    """One long chunk: agenda by heap."""
    n = len(syms)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n)) + [-1]
    alive = [True] * n
    heap: list[tuple[int, int, int, int, int]] = []
    k = np.array([key], np.uint64)

    def push(i: int, j: int) -> None:
        got = p.pairs.get(syms[i] << 16 | syms[j]) if syms[i] >= 0 and syms[j] >= 0 else None
        if got is not None and not (rate > 0 and _skipped(k, [start[i]], [start[j]], [end[j]], rate)[0]):
            heapq.heappush(heap, (got[1], start[i], i, j, end[j]))

    for i in range(n - 1):
        push(i, i + 1)
    while heap:
        _, s, i, j, e = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or end[j] != e or start[i] != s or p.pairs.get(syms[i] << 16 | syms[j]) is None:
            continue
        syms[i], end[i] = p.pairs[syms[i] << 16 | syms[j]][0], end[j]
        alive[j] = False
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
            push(i, right[i])
        if left[i] >= 0:
            push(left[i], i)
    return [s for s, a in zip(syms, alive) if a]


def _matrix(p: Pieces, sym: np.ndarray, key: np.ndarray, rate: float):
    """Chunks of one length, a row each: yields (row numbers, their final symbols)."""
    n, w = sym.shape
    who, pos = np.arange(n), np.broadcast_to(np.arange(w, dtype=np.int32), (n, w)).copy()
    full = w

    def pair_ranks(a, b, k, s, m, e):
        rank, merged = p.look(a, b)
        on = np.flatnonzero(rank != _NONE)
        if rate > 0 and len(on):
            rank[on[_skipped(k[on], s[on], m[on], e[on], rate)]] = _NONE
        return rank, merged

    if w > 1:
        ends = np.concatenate([pos[:, 1:], np.full((n, 1), full, np.int32)], 1)
        r, g = pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.repeat(key, w - 1), pos[:, :-1].ravel(), pos[:, 1:].ravel(), ends[:, 1:].ravel())
        rank, merged = r.reshape(n, w - 1), g.reshape(n, w - 1)
    while w > 1 and len(who):
        j = rank.argmin(1)
        row = np.arange(len(who))
        going = rank[row, j] != _NONE
        if not going.all():
            yield who[~going], sym[~going]
            who, key, sym, pos, rank, merged, j = who[going], key[going], sym[going], pos[going], rank[going], merged[going], j[going]
            if not len(who):
                return
            row = np.arange(len(who))
        sym[row, j] = merged[row, j]
        keep = np.ones((len(who), w), bool)
        keep[row, j + 1] = False
        sym, pos = sym[keep].reshape(-1, w - 1), pos[keep].reshape(-1, w - 1)
        keep = np.ones((len(who), w - 1), bool)
        keep[row, j] = False
        rank, merged = rank[keep].reshape(len(who), w - 2), merged[keep].reshape(len(who), w - 2)
        w -= 1
        for side in (-1, 0):  # the pairs that the new symbol forms with its neighbours
            a = j + side
            ok = np.flatnonzero((a >= 0) & (a + 1 < w))
            if len(ok):
                b = a[ok]
                e = np.where(b + 2 < w, pos[ok, np.minimum(b + 2, w - 1)], full)
                r, g = pair_ranks(sym[ok, b], sym[ok, b + 1], key[ok], pos[ok, b], pos[ok, b + 1], e)
                rank[ok, b], merged[ok, b] = r, g
    if len(who):
        yield who, sym


def encode_slice(p: Pieces, buf: np.ndarray, off: np.ndarray, doc_ids: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each row plus the total)."""
    rows = len(off) - 1
    lead = (buf & 0xC0) != 0x80
    chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    c_off = np.concatenate([[0], np.cumsum(lead)])[off]
    some = np.diff(c_off) > 0
    # a blank goes before each text
    at = np.arange(len(chars)) + np.repeat(np.cumsum(some), np.diff(c_off))
    cps = np.full(len(chars) + int(some.sum()), 32, np.uint32)
    cps[at] = chars
    first_char = c_off + np.concatenate([[0], np.cumsum(some)])
    blank = cps == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[first_char[:-1][some]] = True
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    lens = np.diff(np.append(start, len(cps)))
    chunk_first = np.searchsorted(start, first_char)
    row = core.row_of(chunk_first)
    nth = np.arange(len(start)) - chunk_first[:-1][row]
    key = core.mix(core.mix(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(seed & 0xFFFFFFFF))[row] + nth.astype(np.uint64))
    syms = p.of_char[cps]
    syms = np.where(syms >= 0, syms, -1 - cps.astype(np.int32)).astype(np.int32)
    order = np.argsort(lens, kind="stable")
    size = lens[order]
    final_n = np.zeros(len(start), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    edges = np.flatnonzero(np.diff(size, prepend=-1))
    for a, z in zip(edges, np.append(edges[1:], len(size))):
        who, w = order[a:z], int(size[a])
        if w > WIDE:
            for c in who:
                out = np.array(_heap(p, syms[start[c] : start[c] + w].tolist(), int(key[c]), rate), np.int32)
                done.append((np.array([c]), out[None]))
                final_n[c] = len(out)
            continue
        sym = syms[start[who][:, None] + np.arange(w)]
        for rows_, out in _matrix(p, sym, key[who], rate):
            done.append((who[rows_], out))
            final_n[who[rows_]] = out.shape[1]
    place = np.cumsum(final_n) - final_n
    ids = np.empty(int(final_n.sum()), np.int32)
    for who, out in done:
        ids[place[who][:, None] + np.arange(out.shape[1])] = out
    first = np.append(place, len(ids))[chunk_first]
    odd = np.flatnonzero(ids < 0)
    if len(odd):  # characters without a piece become their bytes
        raw = [chr(-1 - int(i)).encode("utf-8") for i in ids[odd]]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(x) for x in raw]
        to = np.cumsum(n) - n
        wide = np.empty(int(n.sum()), np.int32)
        wide[to] = ids
        for k, x in zip(to[odd], raw):
            wide[k : k + len(x)] = p.byte[list(x)]
        first = np.append(to, len(wide))[first]
        ids = wide
    return ids, first


def encode(docs: DataFrame, rate: float = RATE, seed: int = SEED, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of each document."""

    @arrow_udf("array<int>")
    def ids_of(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        p = pieces(tokenizers)
        numbers = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        parts, lens = [], [np.zeros(1, np.int64)]
        for at, n, buf, off in core.slices(core.valid_utf8(text), SLICE):
            ids, first = encode_slice(p, buf, off, numbers[at : at + n], rate, seed)
            parts.append(ids), lens.append(np.diff(first))
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        return core.list_array(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(np.concatenate(lens)), pa.int32(), None if valid.all() else valid)

    return core.id_text(docs).select("doc_id", ids_of("doc_id", "text").alias("ids"))


def decode(encoded: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of encoded rows: the bytes of their pieces without the blank put first."""

    @arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        known = pieces(tokenizers).bytes
        return pa.array([None if x is None else b"".join([known[i] for i in x])[1:].decode("utf-8") for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", text_of("ids").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
