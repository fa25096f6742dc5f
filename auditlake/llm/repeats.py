"""Substring dedup: a compressed FM-index per shard, matching statistics by backward search.

A repeat is a run of at least ``LEAST`` white-space words that stands at an earlier place, too: in a document of
lower doc_id, or before in the same one.  All such runs are found:

1. Anchors.  Every window of ``LEAST`` words holds a winnowed ``GRAM``-word hash, so two copies of a
   window share one.  Only the surroundings of anchors that occur twice go on.
2. Shards.  An anchor belongs to the least document that has it; the surroundings of all anchors of one owner
   meet in one shard, and overlapping ones of a document are one segment there.
3. Hot owners.  Of an owner whose segments would fill a shard alone, only windows that occur twice among them go on, by counts of
   their 128-bit hashes summed before and after a shuffle; equal runs of such windows are collapsed to their first
   place, and each distinct run is indexed once, however many documents hold it.
4. Index.  The Burrows-Wheeler transform of a shard's words, from suffixes sorted to a depth of ``LEAST`` words, in a
   wavelet matrix (packed bits, sampled counts), and one bit for each row that begins another ``LEAST``-word context.
   The suffix array itself is thrown away.
5. Matching statistics.  Every segment streams through its shard's index from its end: a step of backward search for each word,
   the match held at ``LEAST`` words by widening its interval to the context's rows.  Rows of a context are the
   places where its window stands: where there are several, all but the earliest are repeats.
   All segments advance together in numpy.

Positions are word numbers, from 0; a word is what ASCII white space delimits.  Words are numbered by 64-bit hashes with a seed of their
own, so within a shard of ``SHARD_WORDS`` words two different ones agree with a chance of 1e-8.

Defined results: null and empty texts and those of fewer than ``LEAST`` words have no repeats; rows with a null
doc_id aren't searched; rows of one doc_id with different texts are documents of their own (``row_key`` tells them apart, and ranks them);
equal rows count as one document; ties: of equal passages that of least (doc_id, row_key, place) is the first and stays; an empty table gives an
empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from auditlake.llm import core

LEAST, GRAM = 50, 25
#: Words that a shard's index holds, about; an owner of more is hot.
SHARD_WORDS = 300_000
#: Words of a segment that one lane of a search reads.
LANE = 1024
SCHEMA = "doc_id bigint, first_word int, n_words int, source_id bigint, source_word int"
_KEYED = "doc_id bigint, row_key bigint, first_word int, n_words int, source_id bigint, source_word int"
_SEGMENT = "owner bigint, doc_id bigint, row_key bigint, start int, words binary"
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w]; shorter by w - 1."""
    have, out = 1, x
    while have * 2 <= w:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    return op(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if w > have else out


def anchors_of(hashes: np.ndarray, first: np.ndarray, least: int = LEAST, gram: int = GRAM) -> np.ndarray:
    """Word positions (in the slice) of winnowed grams; windows never go over rows' ends."""
    n, w = len(hashes), least - gram + 1
    if n < least:
        return np.zeros(0, np.int64)
    up, down = _powers(_B, n + 1), _powers(_B_INV, n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n])])
        grams = core.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]) | np.uint64(1)
    low = _slide(grams, w, np.minimum)  # least gram of each window of words
    inside = np.zeros(n + 1, np.int32)
    lens = np.diff(first)
    big = lens >= least
    inside[first[:-1][big]] += 1
    np.add.at(inside, first[:-1][big] + lens[big] - least + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, 0)
    top = _slide(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero(top[: len(grams)] == grams)
    return at


def word_hashes(batch_text: pa.Array, limit: int = core.SLICE_BYTES):
    for at, n, buf, off in core.slices(batch_text, limit):
        starts, ends, first = core.words(buf, off)
        yield at, n, core.span_hashes(buf, starts, ends), first


def anchors(batches):
    for b in batches:
        key = np.asarray(b.column(0))
        for at, _, h, first in word_hashes(b.column(1)):
            pos = anchors_of(h, first)
            if len(pos):
                row = np.searchsorted(first, pos, "right") - 1
                g = np.zeros(len(pos), np.uint64)  # the gram's own hash again, from its words alone
                for k in range(GRAM):
                    g = g * np.uint64(_B) + h[pos + k]
                yield pa.RecordBatch.from_arrays([pa.array(core.mix(g).view(np.int64)), pa.array(key[at + row]), pa.array((pos - first[row]).astype(np.int32))], ["h", "key", "pos"])


def shared_anchors(batches):
    """Of rows sorted by (h, key, pos): those whose h occurs twice, with the least document key that has it."""
    tail = None  # (h, owner, its row if not yet sent)
    for b in batches:
        h, d, p = (b.column(k).to_numpy() for k in range(3))
        if not len(h):
            continue
        if tail is not None:
            h, d, p = np.append(tail[0], h), np.append(tail[1], d), np.append(tail[2], p)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(h)))
        run = np.repeat(np.arange(len(begin)), size)
        send = (size > 1)[run]
        owner = d[begin][run]
        if tail is not None and tail[3]:
            owner[h == tail[0]] = tail[1]
            send[0] = False  # went out with the batch before
        # the last run may go on: its first row stays for the next batch
        k = int(begin[-1])
        sent = bool(size[-1] > 1) or (tail is not None and tail[3] and k == 0)
        tail = (h[k], owner[k], p[k], sent)
        if send.any():
            yield pa.RecordBatch.from_arrays([pa.array(d[send]), pa.array(p[send]), pa.array(owner[send])], ["key", "pos", "owner"])


def segments(batches):
    """Of rows sorted by (key, kind, pos), anchors (kind 0) before texts (kind 1): the surroundings of each owner's anchors."""
    key, pos, owners = None, [], []
    for b in batches:
        keys, kind, p, o, ids, row_keys, texts = b.columns
        keys, kind = keys.to_numpy(), kind.to_numpy()
        p, o = p.fill_null(0).to_numpy(), o.fill_null(0).to_numpy()
        out: list[tuple] = []
        cuts = np.flatnonzero((np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0) != 0) | (np.diff(kind, prepend=0) != 0))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(keys))):
            if keys[lo] != key:
                key, pos, owners = keys[lo], [], []
            if kind[lo] == 0:
                pos.append(p[lo:hi].astype(np.int64)), owners.append(o[lo:hi])
                continue
            for t in range(lo, hi) if pos else ():  # two documents of one key, if that ever is, get the anchors of both
                q, w = np.concatenate(pos), np.concatenate(owners)
                h = np.concatenate([x for _, _, x, _ in word_hashes(texts.slice(t, 1))] or [np.zeros(0, np.uint64)])
                n = len(h)
                order = np.lexsort((q, w))
                q, w = q[order], w[order]
                q, w = q[q + GRAM <= n], w[q + GRAM <= n]
                a, z = np.maximum(q - (LEAST - GRAM), 0), np.minimum(q + LEAST, n)
                cut = np.ones(len(q), bool)
                cut[1:] = (w[1:] != w[:-1]) | (a[1:] > z[:-1])
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(q)) - 1
                h = core.mix(h ^ np.uint64(0x6A09E667F3BCC908))
                out += [(int(w[f]), ids[t].as_py(), row_keys[t].as_py(), int(a[f]), h[a[f] : z[g]].tobytes()) for f, g in zip(first, last)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["owner", "doc_id", "row_key", "start", "words"])


# --- the index -------------------------------------------------------------------


def contexts(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by their first ``depth`` symbols, whether each begins another such context), by prefix doubling."""
    n = len(text)

    def sort(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * np.int64(n + 2) + b
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        return order, new

    def after(rank: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - k)] = rank[k:] + 1
        return out

    order, new = sort(np.asarray(text, np.int64), np.zeros(n, np.int64))
    have = 1
    while have < depth:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        k = min(have, depth - have)
        order, new = sort(rank, after(rank, k))
        have += k
    return order, new


class FMIndex:
    """Burrows-Wheeler transform of an integer text, sorted to ``depth`` symbols, in a wavelet matrix.  Answers for strings of up to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int = LEAST):
        n = len(text)
        order, new = contexts(text, depth)
        self.n, self.depth, sigma = n, depth, int(text.max()) + 1
        cur = text[order - 1]
        del order
        self.mark, self.marks = self._packed(new)
        self.context_begin = np.append(np.flatnonzero(new), n).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        sym, start = np.arange(sigma), np.zeros(sigma, np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level & 1).astype(bool)
            packed, counts = self._packed(bit)
            zeros = int(n - bit.sum())
            self.bits.append(packed), self.ones.append(counts), self.zeros.append(zeros)
            up = self._rank1(packed, counts, start)
            start = np.where(sym >> level & 1, zeros + up, start - up)
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.begin = start

    @staticmethod
    def _packed(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        return packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])

    @staticmethod
    def _rank1(packed: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        part = packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return counts[word] + np.bitwise_count(part)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of c followed by what [lo, hi) stands for."""
        i, cc = np.concatenate([lo, hi]), np.concatenate([c, c])
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            up = self._rank1(self.bits[k], self.ones[k], i)
            i = np.where(cc >> level & 1, self.zeros[k] + up, i - up)
        i = self.before[cc] + i - self.begin[cc]
        return i[: len(c)], i[len(c) :]

    def context(self, row: np.ndarray) -> np.ndarray:
        """Number of the context that rows belong to."""
        return self._rank1(self.mark, self.marks, row + 1) - 1


def search(words: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int, int, int, int]]:
    """(segment, place, words, earlier segment, place there) of the repeats of segments, in their order."""
    sizes = np.array([len(w) for w in words])
    if not len(sizes) or sizes.max() < least:
        return []
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes
    flat = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(flat), bool)
    inside[end] = False
    _, dense = np.unique(np.concatenate(words), return_inverse=True)
    flat[inside] = dense + 1
    fm = FMIndex(flat, least)
    # lanes read up to LANE windows each, from the last to the first
    per = np.where(sizes >= least, -(-(sizes - least + 1) // LANE), 0)
    seg = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
    stop = begin[seg] + nth * LANE
    j = np.minimum(stop + LANE + least - 1, end[seg])
    length = np.zeros(len(seg), np.int64)
    lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), fm.n)
    at_context = np.full(len(flat), -1, np.int64)
    while len(j):
        j = j - 1
        lo, hi = fm.step(flat[j], lo, hi)
        length += 1
        full = np.flatnonzero(length >= least)
        if len(full):  # the match is held at ``least`` words: all rows of its context
            c = fm.context(lo[full])
            lo[full], hi[full] = fm.context_begin[c], fm.context_begin[c + 1]
            at_context[j[full]] = c
        live = j > stop
        if not live.all():
            stop, j, length, lo, hi = stop[live], j[live], length[live], lo[live], hi[live]
    p = np.flatnonzero(at_context >= 0)
    _, first, which = np.unique(at_context[p], return_index=True, return_inverse=True)
    src = p[first][which]  # the earliest place of each window: places are in the order of documents
    again = src < p
    p, src = p[again], src[again]
    if not len(p):
        return []
    sa, sb = np.searchsorted(begin, p, "right") - 1, np.searchsorted(begin, src, "right") - 1
    cut = np.ones(len(p), bool)
    cut[1:] = (np.diff(p) != 1) | (np.diff(src) != 1) | (np.diff(sa) != 0) | (np.diff(sb) != 0)
    a = np.flatnonzero(cut)
    n = np.diff(np.append(a, len(p))) + least - 1
    return list(zip(sa[a].tolist(), (p - begin[sa])[a].tolist(), n.tolist(), sb[a].tolist(), (src - begin[sb])[a].tolist()))


def shard_repeats(t: pa.Table) -> pa.Table:
    """Repeats within one shard."""
    doc, key, start = t.column("doc_id").to_numpy(), t.column("row_key").to_numpy(), t.column("start").to_numpy().astype(np.int64)
    words = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("words")]
    order = np.lexsort((start, key, doc))
    d_out, s_out, w_out = [], [], []
    for k in order:  # overlapping or touching segments of a document are one
        if d_out and d_out[-1] == (doc[k], key[k]) and start[k] <= s_out[-1] + len(w_out[-1]):
            over = s_out[-1] + len(w_out[-1]) - start[k]
            if over < len(words[k]):
                w_out[-1] = np.concatenate([w_out[-1], words[k][over:]])
        else:
            d_out.append((doc[k], key[k])), s_out.append(int(start[k])), w_out.append(words[k])
    got = search(w_out)
    core.trim()
    return pa.table({
        "doc_id": pa.array([int(d_out[a][0]) for a, *_ in got], pa.int64()), "row_key": pa.array([int(d_out[a][1]) for a, *_ in got], pa.int64()), "first_word": pa.array([s_out[a] + p for a, p, *_ in got], pa.int32()), "n_words": pa.array([n for _, _, n, _, _ in got], pa.int32()),
        "source_id": pa.array([int(d_out[b][0]) for *_, b, _ in got], pa.int64()), "source_word": pa.array([s_out[b] + q for *_, b, q in got], pa.int32()),
    })


# --- hot owners --------------------------------------------------------------------


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of ``LEAST`` words."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707345):
            h = core.mix(words ^ np.uint64(salt))
            up, down = _powers(_B, len(h) + 1), _powers(_B_INV, len(h) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
            out.append(core.mix((sums[LEAST:] - sums[:-LEAST]) * down[: len(h) - LEAST + 1]))
    return out[0], out[1]


def thinned(cut: DataFrame) -> DataFrame:
    """(owner, doc_id, row_key, start, words) of hot owners' segments: runs of windows that an owner's segments hold twice.

    A window is known by two hashes; the filter may let others through, which the index then rules out.
    """
    spark = cut.sparkSession

    def windows(batches):
        for b in batches:
            owner = b.column(0).to_numpy()
            for k, raw in enumerate(b.column(4)):
                words = np.frombuffer(raw.as_buffer(), np.uint64)
                if len(words) >= LEAST:
                    x, y = _windows(words)
                    yield pa.RecordBatch.from_arrays([pa.array(core.mix(x ^ core.mix(owner[k : k + 1].view(np.uint64))).view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])

    counts = cut.mapInArrow(windows, "x bigint, y bigint").groupBy("x", "y").agg(F.count("*").alias("n"))
    twice, path = core.table(counts.where("n > 1").select("x"))
    known = spark.sparkContext.broadcast(core.bloom(twice))  # 32 MB at most
    core.drop_table(spark, path)

    def runs(batches):
        for b in batches:
            owner, doc, key, start = (b.column(k).to_numpy() for k in range(4))
            out: list[tuple] = []
            for k, raw in enumerate(b.column(4)):
                words = np.frombuffer(raw.as_buffer(), np.uint64)
                if len(words) < LEAST:
                    continue
                x, _ = _windows(words)
                x = core.mix(x ^ core.mix(owner[k : k + 1].view(np.uint64)))
                hit = core.may_hold(known.value, x)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out += [(int(owner[k]), int(doc[k]), int(key[k]), int(start[k] + a), words[a : z + LEAST - 1].tobytes()) for a, z in zip(edge[::2], edge[1::2])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["owner", "doc_id", "row_key", "start", "words"])

    return cut.mapInArrow(runs, _SEGMENT)


def without_copies(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each distinct run of an owner at its first place, all other places as repeats of it)."""
    place = F.struct("doc_id", "row_key", "start")
    firsts, _ = core.table(runs.groupBy("owner", "words").agg(F.min(place).alias("at")).select("owner", "at.*", "words"))
    name = [F.xxhash64("owner", "words").alias("x"), F.xxhash64("words", F.lit(1)).alias("y")]
    # A run in very many documents meets its first place in several tasks, by a salt.
    salts = 16
    small = firsts.select(*name, F.col("doc_id").alias("source_id"), F.col("row_key").alias("source_key"), F.col("start").alias("source_word"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    large = runs.select(*name, "doc_id", "row_key", F.col("start").alias("first_word"), (F.octet_length("words") / 8).cast("int").alias("n_words"), F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(salts)).cast("int").alias("salt"))
    copies = large.join(small, ["x", "y", "salt"]).where("doc_id <> source_id OR row_key <> source_key OR first_word <> source_word")
    return firsts, copies.select("doc_id", "row_key", "first_word", "n_words", "source_id", "source_word")


# --- over documents ----------------------------------------------------------------


def merged(batches):
    """Of rows sorted by (doc_id, row_key, first_word): overlapping or touching intervals of a document joined; the longest names the source."""
    names = ["doc_id", "row_key", "first_word", "n_words", "source_id", "source_word"]
    held = [np.zeros(0, np.int64)] * 6

    def join(c, last: bool):
        """(joined intervals, rows of the last document, which may go on)"""
        doc, key, at, n = c[:4]
        new_doc = np.ones(len(doc), bool)
        new_doc[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        rest = len(doc) if last else int(np.flatnonzero(new_doc)[-1])
        c, new_doc = [x[:rest] for x in c], new_doc[:rest]
        kept = [x[rest:] for x in held_rows]
        if not rest:
            return None, kept
        doc, key, at, n = c[:4]
        far = np.cumsum(new_doc) * np.int64(1 << 40)  # documents lie apart, so one running maximum does for all
        end = np.maximum.accumulate(far + at + n)
        new = new_doc.copy()
        new[1:] |= (far + at)[1:] > end[:-1]
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.maximum.reduceat(end, begin) - (far + at)[begin]
        best = np.lexsort((np.arange(len(n)), -n, run))[begin]  # the first of the longest of each run
        out = [doc[begin], key[begin], at[begin], size, c[4][best], c[5][best]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(out, (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32))], names), kept

    for b in batches:
        held_rows = [np.append(h, b.column(k).to_numpy().astype(np.int64)) for k, h in enumerate(held)]
        if len(held_rows[0]):
            done, held = join(held_rows, False)
            if done is not None:
                yield done
    if len(held[0]):
        held_rows = held
        yield join(held, True)[0]


def keyed_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, first_word, n_words, source_id, source_word): runs of words that stand at an earlier place, too."""
    spark = docs.sparkSession
    base = core.one_of_equal_rows(core.id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL"))
    base = base.select("doc_id", core.row_key().alias("row_key"), "text").withColumn("key", F.xxhash64("doc_id", "row_key"))
    marks = base.select("key", "text").mapInArrow(anchors, "h bigint, key bigint, pos int")
    both = marks.repartition("h").sortWithinPartitions("h", "key", "pos").mapInArrow(shared_anchors, "key bigint, pos int, owner bigint")
    none = lambda kind: F.lit(None).cast(kind)
    rows = both.select("key", F.lit(0).alias("kind"), "pos", "owner", none("long").alias("doc_id"), none("long").alias("row_key"), none("string").alias("text"))
    rows = rows.unionByName(base.select("key", F.lit(1).alias("kind"), none("int").alias("pos"), none("long").alias("owner"), "doc_id", "row_key", "text"))
    cut, cut_path = core.table(rows.repartition("key").sortWithinPartitions("key", "kind", "pos").mapInArrow(segments, _SEGMENT))
    sizes = cut.groupBy("owner").agg(F.sum(F.octet_length("words")).alias("n"))
    total, n_hot = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 8 * SHARD_WORDS)).head()
    copies = None
    if n_hot:
        hot, hot_path = core.table(sizes.where(F.col("n") > 8 * SHARD_WORDS).select("owner"))
        hot = F.broadcast(hot) if n_hot <= 500_000 else hot
        runs, runs_path = core.table(thinned(cut.join(hot, "owner", "left_semi")))
        firsts, copies = without_copies(runs)
        copies, _ = core.table(copies)
        cut, path = core.table(cut.join(hot, "owner", "left_anti").unionByName(firsts))
        core.drop_table(spark, cut_path, hot_path, runs_path)
        total = cut.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).head()[0]
    shards = max(1, round(total / 8 / SHARD_WORDS))
    found = cut.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards))).groupBy("shard").applyInArrow(shard_repeats, _KEYED)
    if copies is not None:
        found = found.unionByName(copies)
    return found.repartition("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "first_word", "n_words", "source_id", "source_word").mapInArrow(merged, _KEYED)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, source_id, source_word) of all repeats."""
    return keyed_repeats(docs).drop("row_key")


def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    """Texts without the given (first word, words) runs and the white space behind them."""
    out, of = [], cuts.to_pylist()
    raw_texts = text.cast(pa.large_binary())
    for t, c in zip(raw_texts, of):
        raw = t.as_py()
        if not c or raw is None:
            out.append(raw)
            continue
        buf = np.frombuffer(raw, np.uint8)
        starts, _, _ = core.words(buf, np.array([0, len(buf)]))
        c = np.array(sorted((x["first_word"], x["first_word"] + x["n_words"]) for x in c))
        bounds = np.append(starts, len(raw))
        gone = np.zeros(len(raw) + 1, np.int32)
        np.add.at(gone, bounds[np.minimum(c[:, 0], len(starts))], 1)
        np.add.at(gone, bounds[np.minimum(c[:, 1], len(starts))], -1)
        out.append(buf[np.cumsum(gone[:-1]) == 0].tobytes())
    return pa.array(out, pa.binary()).view(pa.string())


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their repeats, the first occurrence stays; a document of which nothing is left goes.

    Of equal rows one stays.  n_chars follows where the table has it; all other columns stay as they are.
    """
    since = core.mark()
    cuts = keyed_repeats(docs).groupBy(F.col("doc_id").alias("__al_id"), F.col("row_key").alias("__al_key")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("__al_cuts"))
    cuts, path = core.table(cuts)
    core.release(spark, since, keep=(path,))
    # Documents without repeats keep their rows untouched.
    docs = core.one_of_equal_rows(docs)
    on = (F.col("doc_id").cast("long") == F.col("__al_id")) & (core.row_key() == F.col("__al_key"))
    joined = docs.join(cuts, on, "left")
    without = arrow_udf(_without, "string")
    done = joined.withColumn("__al_text", F.when(F.col("__al_cuts").isNull(), F.col("text").cast("string")).otherwise(without(F.when(F.col("__al_cuts").isNotNull(), F.col("text").cast("string")), "__al_cuts")))
    done = done.where("__al_cuts IS NULL OR trim(BOTH FROM regexp_replace(__al_text, '[ \\\\t\\\\r\\\\n]+', ' ')) <> ''")
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__al_text").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("__al_cuts").isNull(), F.col("n_chars")).otherwise(F.length("__al_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"`{c}`"))
    return done.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
