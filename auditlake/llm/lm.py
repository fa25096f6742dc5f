"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy.

Texts become subword ids once (a written table), and all ids of the corpus are counted.  As inputs, the ``OWN`` most
frequent ids have an embedding each, any other the sum of two rows that its hash picks.  Outputs are factored:
``SINGLES`` ids and ``GROUPS`` groups of ids share a softmax over ``CLASSES``, and the ``SLOTS`` of a group have a softmax of
their own, so that context reaches every id.  Up to 4,128 ids that occur have a slot or class alone; of more, the rarer ones share
slots by frequency, where an id has its share of the slot's count.

Training reads the whole corpus: every document is cut into windows of ``WIDTH`` ids without overlap, each window goes to a
trainer of about ``TRAINER_WINDOWS``, and predicts every one of its ids, with all ids before as context.
Trainers run Adam on their own from common parameters; then the parameters are averaged by weight, and the next
round (other windows) starts from the mean.

Scoring cuts each document into windows of ``WIDTH`` ids that overlap by ``WIDTH - STRIDE``; a window scores
only its last ``STRIDE`` ids (the first one all), so every id is scored once, with at least ``WIDTH - STRIDE``
ids of context where the document has them.  Windows of many documents go through masked attention as one batch.

Defined results: null and empty texts have no row; what isn't UTF-8 counts as U+FFFD; repeated rows have a row and equal scores each; a
null doc_id stays null; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import core, rans, subwords

SINGLES, GROUPS, SLOTS = 32, 64, 64
CLASSES, WIDTH, STRIDE, DIM, HIDDEN = SINGLES + GROUPS, 32, 24, 16, 16
OWN, HASHED = 2048, 2048
#: Rows of the input table besides: one that stays zero, and a document's start.
ZERO, BOS = OWN + HASHED, OWN + HASHED + 1
#: A batch's gradient is summed over so many parts, which stay in cache; rounds of averaging; windows of a trainer and round.
EACH, ROUNDS, TRAINER_WINDOWS = 4, 2, 200_000
#: Rows of logits and windows of attention at once, which stay in cache.
ROWS, WINDOWS = 512, 128
SEED, RATE, BATCH = 5, 6e-3, 1024
SCHEMA = "doc_id bigint, n_tokens bigint, bits double, bits_per_token double"


# --- the model -------------------------------------------------------------------

SHAPES = {
    "E": (BOS + 1, DIM), "P": (WIDTH, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "A": (DIM, HIDDEN), "a": (HIDDEN,), "B": (HIDDEN, DIM), "U": (DIM, CLASSES), "u": (CLASSES,),
    "S": (GROUPS, DIM, SLOTS), "s": (GROUPS, SLOTS),
}


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.0 if k in "aus" else 0.3 if k in "EP" else 0.02 if k in "US" else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    p["E"][ZERO] = 0
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def hidden(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, at: np.ndarray | int = 0) -> dict[str, np.ndarray]:
    """Forward pass up to the last layer's input; ``one`` and ``two`` (n, WIDTH) are the inputs' rows, ``at`` (n, m) the positions wanted, or the first.

    Queries meet keys by the product of Q and K, and values leave by that of V and O, so that both are the inputs themselves; weights stay
    exponentials ``e``, as only the sums over values, ``r``, are divided by their totals.
    """
    n = len(one)
    h = np.take(p["E"], one, 0, mode="clip")
    twice = np.flatnonzero(two != ZERO)
    if len(twice):
        h.reshape(-1, DIM)[twice] += p["E"][two.ravel()[twice]]
    h += p["P"]
    x = h.reshape(-1, DIM)
    if not isinstance(at, int):
        xq, seen = np.take(x, (np.arange(n)[:, None] * WIDTH + at).ravel(), 0), np.take(_SEEN, at, 0)
    else:
        xq, seen = (h[:, at:].reshape(-1, DIM), _SEEN[at:]) if at else (x, _SEEN)
    q = (xq @ ((p["Q"] @ p["K"].T) * p["Q"].dtype.type(DIM**-0.5))).reshape(n, -1, DIM)
    ht = np.ascontiguousarray(h.transpose(0, 2, 1))
    e = np.matmul(q, ht)
    # only where scores are large the maximum has to go first
    if not within(e, 30):
        e = np.where(seen > 0, e, -np.inf)
        e -= e.max(2, keepdims=True)
        np.exp(e, out=e)
    else:
        np.exp(e, out=e)
        e *= seen
    part = np.matmul(e, _ONES.astype(e.dtype)).reshape(-1, DIM)
    np.divide(1, part, out=part)
    r = np.matmul(e, h).reshape(-1, DIM)
    r *= part
    y = r @ (p["V"] @ p["O"])
    y += xq
    f = y @ p["A"]
    f.reshape(n, -1)[:] += np.tile(p["a"], q.shape[1])
    np.maximum(f, 0, out=f)
    z = f @ p["B"]
    z += y
    return {"x": x, "ht": ht, "xq": xq, "q": q, "e": e, "part": part, "r": r, "y": y, "f": f, "z": z}


_SEEN, _ONES = np.tril(np.ones((WIDTH, WIDTH), np.float32)), np.ones((WIDTH, DIM), np.float32)


def within(x: np.ndarray, most: float) -> bool:
    return not x.size or bool(x.max() <= most and x.min() >= -most)


def _longest(x: np.ndarray) -> float:
    """Length of the longest row."""
    return float(np.einsum("ij,ij->i", x, x).max(initial=0)) ** 0.5


def softmax_sums(logits: np.ndarray, target: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-log softmax at the targets, the targets' flat places and the rows' sums; overwrites the logits, none of which is beyond ``bound``, with their exponentials."""
    place = np.arange(0, logits.size, logits.shape[1])
    place += target
    hit = np.take(logits, place)
    if not bound <= 60 and not within(logits, 60):
        top = logits.max(1)
        logits -= top[:, None]
        hit -= top
    total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)
    return np.log(total) - hit, place, total


def softmax_nats(logits: np.ndarray, target: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """-log softmax at the targets; overwrites the logits, none of which is beyond ``bound``, with their exponentials."""
    return softmax_sums(logits, target, bound)[0]


def softmax_gradient(logits: np.ndarray, target: np.ndarray, w: np.ndarray, bound: float) -> tuple[float, np.ndarray]:
    """Sum of -log softmax at the targets times w, and a column; the logits become its gradient once multiplied by that column."""
    nats, place, total = softmax_sums(logits, target, bound)
    logits.reshape(-1)[place] -= total
    return float(nats @ w), (w / total)[:, None]


def with_ones(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows in that order, with one more column for the biases."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = np.take(x, order, 0, mode="clip"), 1
    return out


def by_head(head: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, int, list[tuple[int, slice]]]]]:
    """Numbers of the tokens by class; blocks of up to ``ROWS`` of these: (rows, the first in a group, [(group, its rows)])."""
    head = head.astype(np.uint8, copy=False)  # such keys are sorted in linear time
    count = np.bincount(head, minlength=CLASSES)
    order, begin = np.argsort(head, kind="stable"), int(count[:SINGLES].sum())
    blocks = [(slice(a, min(a + ROWS, len(order))), min(max(a, begin), a + ROWS, len(order)), []) for a in range(0, len(order), ROWS)]
    for k, n in enumerate(count[SINGLES:].tolist()):
        end = begin + n
        while begin < end:
            to = min(end, (begin // ROWS + 1) * ROWS)
            blocks[begin // ROWS][2].append((k, slice(begin, to)))
            begin = to
    return order, blocks


def output_weights(p: dict[str, np.ndarray], longest: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights of classes and slots with their biases as a last row, and what no logit is beyond for inputs up to ``longest``."""
    u, s = np.vstack([p["U"], p["u"]]), np.concatenate([p["S"], p["s"][:, None]], 1)
    most_s = float(np.einsum("kds,kds->ks", p["S"], p["S"]).max()) ** 0.5
    return u, s, longest * _longest(p["U"].T) + float(abs(p["u"]).max()), longest * most_s + float(abs(p["s"]).max())


def nats(p: dict[str, np.ndarray], z: np.ndarray, head: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """-log p of the target classes and slots, from last-layer inputs."""
    out = np.empty(len(z), z.dtype)
    u, s, most_u, most_s = output_weights(p, _longest(z))
    order, blocks = by_head(head)
    z1, head, slot = with_ones(z, order), head[order], slot[order]
    d, e = np.empty((ROWS, CLASSES), z.dtype), np.empty((ROWS, SLOTS), z.dtype)
    for rows, first, groups in blocks:
        own = np.matmul(z1[rows], u, out=d[: rows.stop - rows.start])
        bits = softmax_nats(own, head[rows], most_u)
        for k, r in groups:
            np.matmul(z1[r], s[k], out=e[r.start - first : r.stop - first])
        if groups:
            bits[first - rows.start :] += softmax_nats(e[: rows.stop - first], slot[first : rows.stop], most_s)
        out[order[rows]] = bits
    return out


def loss_and_gradient(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, at: np.ndarray | int, head: np.ndarray, slot: np.ndarray, on: np.ndarray, total: int | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the positions ``at`` (n, m), or from the first on, where ``on``, and its gradient; head and slot (n, m) are the ids at them.

    Of a part of a batch, ``total`` is how many positions of the batch are on.
    """
    n, m = head.shape
    blocks = [slice(a, a + WINDOWS) for a in range(0, n, WINDOWS)]
    ts = [hidden(p, one[w], two[w], at if isinstance(at, int) else at[w]) for w in blocks]
    z = np.concatenate([t["z"] for t in ts])
    weight = np.multiply(on, 1 / max(1, on.sum() if total is None else total), dtype=z.dtype).ravel()
    loss, dz, g = output_gradient(p, z, head.ravel(), slot.ravel(), weight)
    dx = np.empty((n * WIDTH, DIM), z.dtype)
    for w, t in zip(blocks, ts):
        rows = slice(w.start * m, w.stop * m)
        for k, v in hidden_gradient(p, t, at if isinstance(at, int) else at[w], m, dz[rows], dx[w.start * WIDTH : w.stop * WIDTH]).items():
            g[k] = g[k] + v if k in g else v
    g["P"] = dx.reshape(n, WIDTH * DIM).sum(0).reshape(WIDTH, DIM)
    twice = np.flatnonzero(two != ZERO)
    row = one.ravel()
    if len(twice):
        row, dx = np.concatenate([row, two.ravel()[twice]]), np.concatenate([dx, dx[twice]])
    dx = dx.T.astype(float, order="C")
    g["E"] = np.empty((DIM, BOS + 1), z.dtype)
    for i, x in enumerate(dx):
        g["E"][i] = np.bincount(row, x, BOS + 1)
    g["E"] = g["E"].T
    return loss, g


def output_gradient(p: dict[str, np.ndarray], z: np.ndarray, head: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Loss, and its gradient by the last layer's inputs and by the outputs' parameters; logits are made and left ``ROWS`` at a time."""
    u, s, most_u, most_s = output_weights(p, _longest(z))
    ut, st = np.ascontiguousarray(p["U"].T), np.ascontiguousarray(p["S"].transpose(0, 2, 1))
    order, blocks = by_head(head)
    z1, head, slot, weight = with_ones(z, order), head[order], slot[order], weight[order]
    loss, gu, gs, dzs, dz = 0.0, np.zeros_like(u), np.zeros_like(s), np.empty_like(z), np.empty_like(z)
    d, e, more = np.empty((ROWS, CLASSES), z.dtype), np.empty((ROWS, SLOTS), z.dtype), np.empty((ROWS, DIM), z.dtype)
    for rows, first, groups in blocks:
        own = np.matmul(z1[rows], u, out=d[: rows.stop - rows.start])
        nats, by = softmax_gradient(own, head[rows], weight[rows], most_u)
        loss += nats
        gu += (z1[rows] * by).T @ own
        np.matmul(own, ut, out=dzs[rows])
        dzs[rows] *= by
        if not groups:
            continue
        for k, r in groups:
            np.matmul(z1[r], s[k], out=e[r.start - first : r.stop - first])
        grouped = slice(first, rows.stop)
        own = e[: rows.stop - first]
        nats, by = softmax_gradient(own, slot[grouped], weight[grouped], most_s)
        loss += nats
        z1[grouped] *= by
        for k, r in groups:
            own = e[r.start - first : r.stop - first]
            gs[k] += z1[r].T @ own
            np.matmul(own, st[k], out=more[r.start - first : r.stop - first])
        by = more[: len(by)] * by
        dzs[grouped] += by
    dz[order] = dzs
    return loss, dz, {"U": gu[:DIM], "u": gu[DIM], "S": gs[:, :DIM], "s": gs[:, DIM]}


def hidden_gradient(p: dict[str, np.ndarray], t: dict[str, np.ndarray], at: np.ndarray | int, m: int, dz: np.ndarray, dx: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of what ``hidden`` gave as ``t``; ``dx`` becomes that by the inputs."""
    g, n, scale = {}, len(dx) // WIDTH, dz.dtype.type(DIM**-0.5)
    h, dh = t["x"].reshape(n, WIDTH, DIM), dx.reshape(n, WIDTH, DIM)
    g["B"] = t["f"].T @ dz
    df = dz @ p["B"].T
    df *= t["f"] > 0
    g["A"], g["a"] = t["y"].T @ df, np.ones(len(df), df.dtype) @ df
    dy = df @ p["A"].T
    dy += dz
    go = t["r"].T @ dy
    g["V"], g["O"] = go @ p["O"].T, p["V"].T @ go
    dr = dy @ (p["V"] @ p["O"]).T
    dr *= t["part"]
    rows = np.einsum("ij,ij->i", dr, t["r"]).reshape(n, m, 1)  # each row's sum of weights times their gradients
    dr = dr.reshape(n, m, DIM)
    ds = np.matmul(dr, t["ht"])
    ds -= rows
    ds *= t["e"]
    np.matmul(t["e"].transpose(0, 2, 1), dr, out=dh)
    dh += np.matmul(ds.transpose(0, 2, 1), t["q"])
    dq = np.matmul(ds, h).reshape(-1, DIM)
    gq = (t["xq"].T @ dq) * scale
    g["Q"], g["K"] = gq @ p["K"], gq.T @ p["Q"]
    dy += dq @ ((p["Q"] @ p["K"].T).T * scale)
    if isinstance(at, int):
        dh[:, at:] += dy.reshape(n, m, DIM)
    else:
        dx[(np.arange(n)[:, None] * WIDTH + at).ravel()] += dy  # a window's positions differ
    return g


def train(x: np.ndarray, c: Codes, windows: np.ndarray, seed: int) -> np.ndarray:
    """One pass of Adam over windows (n, WIDTH + 1) of ids, in seeded order; ``END`` stands before a document's start and after its end."""
    p = unflat(x)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    x = flat(p)
    m, v, g_, t_ = (np.zeros(len(x), np.float32) for _ in range(4))
    p, at_param = {}, 0
    for k, shape in SHAPES.items():  # views, so that one update moves all
        p[k] = x[at_param : at_param + int(np.prod(shape))].reshape(shape)
        at_param += p[k].size
    batch = min(BATCH, max(64, len(order) // 128))
    steps = -(-len(order) // batch)
    for step in range(steps):
        take = order[step * batch : (step + 1) * batch]
        w = windows[take].astype(np.int64)
        total = int((w[:, 1:] != END).sum())
        if not total:
            continue
        g_[:] = 0
        for part in np.array_split(w, -(-len(w) * EACH // BATCH)):
            before, target = part[:, :-1], part[:, 1:]
            _, g = loss_and_gradient(p, c.one[before], c.two[before], 0, c.head[target], c.slot[target], target != END, total)
            g_ += np.concatenate([g[k].ravel() for k in SHAPES], out=t_)
        rate = np.float32(RATE * (1 - 0.9 * step / steps))
        fix1, fix2 = np.float32(1 / (1 - 0.9 ** (step + 1))), np.float32(1 / (1 - 0.99 ** (step + 1)))
        np.subtract(g_, m, out=t_)
        t_ *= np.float32(0.1)
        m += t_
        g_ *= g_
        g_ -= v
        g_ *= np.float32(0.01)
        v += g_
        np.multiply(v, fix2, out=g_)
        np.sqrt(g_, out=g_)
        g_ += np.float32(1e-8)
        np.divide(m, g_, out=t_)
        t_ *= rate * fix1
        x -= t_
    return x


# --- windows ------------------------------------------------------------------------

#: The number after the last id: a document's start as an input, and no target.
END = subwords.VOCABULARY


def windows_of(lens: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first id's index, document, ids held, first position scored) of all windows of documents laid end to end."""
    per = np.where(lens > 0, 1 + np.maximum(0, -(-(lens - WIDTH) // stride)), 0)
    doc = np.repeat(np.arange(len(lens)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.cumsum(lens) - lens
    return begin[doc] + nth * stride, doc, np.minimum(WIDTH, lens[doc] - nth * stride), np.where(nth > 0, WIDTH - stride, 0)


def gathered(ids: np.ndarray, start: np.ndarray, held: np.ndarray, document_start: np.ndarray) -> np.ndarray:
    """(windows, WIDTH + 1): the id before (END at a document's start) and the window's ids; END behind them."""
    at = start[:, None] + np.arange(-1, WIDTH)
    out = ids[np.clip(at, 0, len(ids) - 1)]
    out[start == document_start, 0] = END
    out[:, 1:][np.arange(WIDTH) >= held[:, None]] = END
    return out


class Codes:
    """Input rows, class and slot of each id, and the bits that name the id within its slot."""

    def __init__(self, counts: np.ndarray):
        n = END
        counts = np.pad(counts, (0, n - len(counts)))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        h = core.mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
        often = rank < OWN
        self.one = np.append(np.where(often, rank, OWN + (h & np.uint64(HASHED - 1)).astype(np.int64)), BOS)
        self.two = np.append(np.where(often, ZERO, OWN + (h >> np.uint64(32) & np.uint64(HASHED - 1)).astype(np.int64)), ZERO)
        used, slots, alone = int((counts > 0).sum()), GROUPS * SLOTS, GROUPS * SLOTS * 3 // 4
        r = np.maximum(rank - SINGLES, 0)
        if used - SINGLES > slots:
            r = np.where(r < alone, r, alone + (r - alone) * (slots - alone) // (used - SINGLES - alone))
        r = np.minimum(r, slots - 1)
        self.head = np.append(np.where(rank < SINGLES, rank, SINGLES + r // SLOTS), 0).astype(np.uint8)
        self.slot = np.append(np.where(rank < SINGLES, 0, r % SLOTS), 0).astype(np.uint8)
        place = np.where(rank < SINGLES, rank, SINGLES + r)
        mass = np.bincount(place, counts, SINGLES + slots)
        with np.errstate(divide="ignore"):
            self.bits = np.append(np.where(counts > 0, np.log2(np.maximum(mass[place], 1) / np.maximum(counts, 1)), 0), 0).astype(np.float32)
        #: Training starts from frequencies.
        of_class = np.concatenate([mass[:SINGLES], mass[SINGLES:].reshape(GROUPS, SLOTS).sum(1)])
        self.head_bias = np.log((of_class + 0.5) / (of_class.sum() + 0.5 * CLASSES)).astype(np.float32)
        in_group = mass[SINGLES:].reshape(GROUPS, SLOTS)
        self.slot_bias = np.log((in_group + 0.01) / (in_group.sum(1, keepdims=True) + 0.01 * SLOTS)).astype(np.float32)


def score_documents(p: dict[str, np.ndarray], c: Codes, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bits of each document."""
    out = np.zeros(len(lens))
    if not len(ids):
        return out
    start, doc, held, skips = windows_of(lens)
    begin = np.cumsum(lens) - lens
    for skip in (0, WIDTH - STRIDE):  # the first windows of documents, and all others
        own = np.flatnonzero(skips == skip)
        pos = np.arange(skip, WIDTH)
        for a in range(0, len(own), 768):
            s = own[a : a + 768]
            w = gathered(ids, start[s], held[s], begin[doc[s]])
            one, two, target = c.one[w[:, :-1]], c.two[w[:, :-1]], w[:, 1 + skip :]
            z = np.concatenate([hidden(p, one[i : i + WINDOWS], two[i : i + WINDOWS], skip)["z"] for i in range(0, len(s), WINDOWS)])
            bits = nats(p, z, c.head[target].ravel(), c.slot[target].ravel()).reshape(target.shape)
            bits *= np.float32(1 / np.log(2))
            bits += c.bits[target]
            bits[pos >= held[s][:, None]] = 0
            np.add.at(out, doc[s], bits.sum(1, dtype=float))
    return out


# --- over documents ------------------------------------------------------------------


def fit(ids: DataFrame, counts: np.ndarray) -> tuple[dict[str, np.ndarray], Codes]:
    """Parameters from all windows of all documents, by rounds of averaged local training."""
    c = Codes(counts)
    x = flat(initial() | {"u": c.head_bias, "s": c.slot_bias})
    trainers = max(1, round(int(counts.sum()) / WIDTH / ROUNDS / TRAINER_WINDOWS))

    def deal(batches):
        """A row for each slice of texts, round and trainer: the windows that its hash sends there."""
        for b in batches:
            for doc_ids, lens, raw in zip(b.column(0), b.column(1), b.column(2)):
                lens = np.asarray(lens.values).astype(np.int64)
                ids = np.frombuffer(raw.as_buffer(), np.uint16)
                if not len(ids):
                    continue
                start, doc, held, _ = windows_of(lens, WIDTH)
                begin = np.cumsum(lens) - lens
                key = doc_ids.values.fill_null(0).to_numpy().view(np.uint64)
                h = core.mix(core.mix(key)[doc] + (start - begin[doc]).astype(np.uint64))
                to = (h % np.uint64(ROUNDS)) * np.uint64(trainers) + (h >> np.uint64(8)) % np.uint64(trainers)
                order = np.lexsort((h, to))
                cut = np.flatnonzero(np.diff(to[order].astype(np.int64), prepend=-1))
                for a, z in zip(cut, np.append(cut[1:], len(order))):
                    own, t = order[a:z], int(to[order[a]])
                    w = gathered(ids, start[own], held[own], begin[doc[own]])
                    yield pa.RecordBatch.from_arrays([pa.array([t // trainers], pa.int32()), pa.array([t % trainers], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([int(h[own[0]] >> np.uint64(1))], pa.int64())], ["round", "trainer", "n", "windows", "h"])

    dealt, path = core.table(ids.select("doc_ids", "lens", "ids").mapInArrow(deal, "round int, trainer int, n bigint, windows binary, h bigint"))

    def local(x: np.ndarray, r: int):
        def one(t: pa.Table) -> pa.Table:
            rows = sorted(zip(t.column("h").to_pylist(), t.column("windows").to_pylist()))  # as rows come in any order
            w = np.frombuffer(b"".join(x for _, x in rows), np.uint16).reshape(-1, WIDTH + 1)
            del rows
            return pa.table({"n": pa.array([len(w)], pa.int64()), "x": pa.array([train(x, c, w, r)], pa.list_(pa.float32()))})

        return one

    def summed(batches):
        """One row a task: the weighted sum of its models."""
        n, total = 0, np.zeros(0)
        for b in batches:
            for k, model in zip(b.column(0).to_pylist(), b.column(1)):
                n, total = n + k, np.asarray(model.values, float) * k + (total if len(total) else 0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["n", "x"])

    for r in range(ROUNDS):
        models = dealt.where(F.col("round") == r).groupBy("trainer").applyInArrow(local(x, r), "n bigint, x array<float>").mapInArrow(summed, "n bigint, x array<double>")
        mean = models.select("n", F.posexplode("x").alias("i", "v")).groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if len(mean):
            x = np.zeros(len(x))
            x[mean.column("i").to_numpy()] = mean.column("v").to_numpy()
    core.drop_table(ids.sparkSession, path)
    return unflat(x), c


def score(docs: DataFrame, tokenizers: str = subwords.TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens, bits, bits_per_token) of every text that has tokens."""
    ids, _ = rans.id_table(docs, tokenizers)
    p, c = fit(ids, rans.count_ids(ids))

    def run(batches):
        for b in batches:
            for doc_ids, lens, raw in zip(b.column(0), b.column(1), b.column(2)):
                lens = np.asarray(lens.values).astype(np.int64)
                bits = score_documents(p, c, np.frombuffer(raw.as_buffer(), np.uint16), lens)
                some = np.flatnonzero(lens > 0)
                yield pa.RecordBatch.from_arrays([doc_ids.values.take(pa.array(some)), pa.array(lens[some]), pa.array(bits[some]), pa.array(bits[some] / lens[some])], ["doc_id", "n_tokens", "bits", "bits_per_token"])

    return ids.select("doc_ids", "lens", "ids").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
