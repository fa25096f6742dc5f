"""The attention model against numeric gradients, and scores against one window at a time."""

import numpy as np

from auditlake.llm import lm, rans, subwords
from tests.llm.conftest import table_of


def some_codes(rng, n=600):
    counts = rng.integers(0, 50, n)
    counts[: n // 2] += 1
    return lm.Codes(counts)


def test_gradient():
    rng = np.random.default_rng(1)
    c = some_codes(rng, 5000)
    p = {k: v.astype(np.float64) for k, v in lm.initial(2).items()}
    w = rng.integers(0, 5000, (3, lm.WIDTH + 1))
    at = np.array([0, 1, 3])[:, None] + np.arange(0, lm.WIDTH, lm.EACH)
    target = w[np.arange(3)[:, None], at + 1]
    on = np.ones(at.shape, bool)
    on[1, 5:] = False
    args = (c.one[w[:, :-1]], c.two[w[:, :-1]], at, c.head[target].astype(int), c.slot[target].astype(int), on)
    assert (args[1] != lm.ZERO).any() and (args[3] >= lm.SINGLES).any()
    _, g = lm.loss_and_gradient(p, *args)
    for k in lm.SHAPES:
        flat, grad = p[k].reshape(-1), g[k].reshape(-1)
        some = np.flatnonzero(grad)
        for i in [*rng.integers(0, flat.size, 2), *rng.choice(some, 4)]:
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = lm.loss_and_gradient(p, *args)[0]
            flat[i] = old - e
            down = lm.loss_and_gradient(p, *args)[0]
            flat[i] = old
            assert abs((up - down) / (2 * e) - grad[i]) < 1e-5


def test_attention_is_causal():
    rng = np.random.default_rng(3)
    p, w = lm.initial(), rng.integers(0, lm.OWN, (1, lm.WIDTH))
    v, two = w.copy(), np.full((1, lm.WIDTH), lm.ZERO)
    v[0, 20:] = rng.integers(0, lm.OWN, lm.WIDTH - 20)
    a, b = (lm.hidden(p, x, two)["z"].reshape(lm.WIDTH, -1) for x in (w, v))
    assert np.allclose(a[:20], b[:20], atol=1e-5) and not np.allclose(a[20:], b[20:], atol=1e-3)
    some = np.array([[2, 9, 31]])
    assert np.allclose(lm.hidden(p, w, two, some)["z"], a[some[0]], atol=1e-5)


def test_large_scores_stay_finite():
    p = {k: v * (40 if k in "QK" else 1) for k, v in lm.initial().items()}
    w = np.random.default_rng(3).integers(0, lm.OWN, (4, lm.WIDTH))
    assert np.isfinite(lm.hidden(p, w, np.full(w.shape, lm.ZERO))["z"]).all()
    assert np.allclose(lm.softmax_nats(np.array([[1000.0, 0, 0]], np.float32), np.array([1])), 1000)


def test_every_id_is_scored_once():
    lens = np.array([0, 1, 5, lm.STRIDE, lm.WIDTH, lm.WIDTH + 1, 100, 1000, 0, 57])
    for stride in (lm.STRIDE, lm.WIDTH):
        start, doc, held, skip = lm.windows_of(lens, stride)
        hits = np.zeros(int(lens.sum()), int)
        begin = np.cumsum(lens) - lens
        for s, d, h, k in zip(start, doc, held, skip):
            assert s >= begin[d] and s + h <= begin[d] + lens[d]
            hits[s + k : s + h] += 1
        assert (hits == 1).all()


def log2_of(p, c, before, own):
    """log2 p of each id of a window, by whole softmaxes over every id that occurs."""
    x = np.array([[before, *own[:-1]] + [lm.END] * (lm.WIDTH - len(own))])
    z = lm.hidden(p, c.one[x], c.two[x])["z"][: len(own)].astype(float)
    log = lambda y: y - np.log(np.exp(y).sum(1, keepdims=True))
    head, out = log(z @ p["U"] + p["u"]), np.zeros((len(own), len(c.head) - 1))
    for i in range(out.shape[1]):
        out[:, i] = head[:, c.head[i]]
    for g in range(lm.GROUPS):
        mine = np.flatnonzero(c.head[:-1] == lm.SINGLES + g)
        out[:, mine] += log(z @ p["S"][g] + p["s"][g])[:, c.slot[mine]]
    return out / np.log(2) - c.bits[:-1]


def test_scores_equal_one_window_at_a_time():
    rng = np.random.default_rng(4)
    c, p = some_codes(rng), lm.initial(7)
    lens = np.array([3, 0, 80, 33])
    ids = rng.integers(0, 300, int(lens.sum()))
    got, at = lm.score_documents(p, c, ids, lens), 0
    for d, n in enumerate(lens):
        own, bits = ids[at : at + n], 0.0
        at += n
        done = s = 0
        while done < n:
            part = own[s : s + lm.WIDTH]
            log2 = log2_of(p, c, lm.END if s == 0 else own[s - 1], part)
            bits -= sum(log2[k, part[k]] for k in range(done - s, len(part)))
            done = s + len(part)
            s += lm.STRIDE
        assert abs(bits - got[d]) < 1e-3 * max(1, bits)


def test_probabilities_of_ids_sum_to_one():
    for n in (600, 9000):  # with a slot each, and with shared slots
        counts = np.random.default_rng(5).integers(1, 9, n)
        p = lm.initial() | {"S": np.random.default_rng(1).standard_normal(lm.SHAPES["S"]).astype(np.float32)}
        c = lm.Codes(counts)
        empty = np.full((lm.GROUPS, lm.SLOTS), -1e9, np.float32)  # slots without ids
        head, slot = c.head[:n].astype(int), c.slot[:n].astype(int)
        empty[head[head >= lm.SINGLES] - lm.SINGLES, slot[head >= lm.SINGLES]] = 0
        bias = np.where(np.bincount(head, minlength=lm.CLASSES) > 0, 0, -1e9).astype(np.float32)
        log2 = log2_of(p | {"s": empty, "u": bias}, c, lm.END, np.array([3, 500, 90]))
        assert np.allclose((2.0 ** log2[:, :n]).sum(1), 1, atol=1e-4)


def test_learns_more_than_frequencies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids, _ = rans.id_table(docs, subwords.TOKENIZERS)
    counts = rans.count_ids(ids)
    got = lm.score(docs).toPandas()
    p = counts[counts > 0] / counts.sum()
    assert got.n_tokens.sum() == counts.sum() and len(got) == docs.where("text <> ''").count()
    assert got.bits.sum() / got.n_tokens.sum() < -(p * np.log2(p)).sum() - 0.3


def test_odd_rows(spark, odd, none):
    got = lm.score(odd).collect()
    assert {r.doc_id for r in got} >= {None, 9003, 9004, 9005, 9006, 9007} and not {r.doc_id for r in got} & {9001, 9002}
    assert lm.score(none).count() == 0
    same = lm.score(table_of(spark, ["the same words again"] * 5)).collect()
    assert len(same) == 5 and len({round(r.bits, 6) for r in same}) == 1


def test_every_id_of_every_window_is_a_target(monkeypatch):
    rng = np.random.default_rng(6)
    c, real, seen = some_codes(rng), lm.loss_and_gradient, []

    def counted(p, one, two, at, head, slot, on, *more):
        seen.append(on.sum())
        return real(p, one, two, at, head, slot, on, *more)

    monkeypatch.setattr(lm, "loss_and_gradient", counted)
    w = rng.integers(0, 300, (700, lm.WIDTH + 1)).astype(np.uint16)
    w[::3, 10:] = lm.END
    lm.train(lm.flat(lm.initial()), c, w, 0)
    assert sum(seen) == (w[:, 1:] != lm.END).sum()


def test_gradients_of_parts_add_up():
    rng = np.random.default_rng(7)
    c, p = some_codes(rng), {k: v.astype(np.float64) for k, v in lm.initial(2).items()}
    w = rng.integers(0, 600, (6, lm.WIDTH + 1))
    on = rng.random((6, lm.WIDTH)) < 0.8
    args = lambda own: (c.one[w[own, :-1]], c.two[w[own, :-1]])
    of = lambda own: (c.head[w[own, 1:]].astype(int), c.slot[w[own, 1:]].astype(int), on[own])
    every = np.tile(np.arange(lm.WIDTH), (6, 1))
    _, whole = lm.loss_and_gradient(p, *args(slice(0, 6)), every, *of(slice(0, 6)))
    parts = [lm.loss_and_gradient(p, *args(own), 0, *of(own), int(on.sum()))[1] for own in (slice(0, 2), slice(2, 6))]
    for k in lm.SHAPES:
        assert np.allclose(whole[k], parts[0][k] + parts[1][k], atol=1e-12)


def a_part(c, rng, n=128):
    """Arguments of ``loss_and_gradient`` for n windows."""
    w = rng.integers(0, 5000, (n, lm.WIDTH + 1))
    return c.one[w[:, :-1]], c.two[w[:, :-1]], 0, c.head[w[:, 1:]].astype(int), c.slot[w[:, 1:]].astype(int), np.ones((n, lm.WIDTH), bool)


def test_logits_are_made_a_few_rows_at_a_time_and_of_every_target(monkeypatch):
    """Training's time goes to passes over logits, so they have to stay in cache."""
    rng, real, seen = np.random.default_rng(8), lm.softmax_gradient, []

    def counted(logits, *more):
        seen.append(logits.shape)
        return real(logits, *more)

    monkeypatch.setattr(lm, "softmax_gradient", counted)
    c = some_codes(rng, 5000)
    args = a_part(c, rng)
    lm.loss_and_gradient(lm.initial(), *args)
    rows = lambda width: [n for n, m in seen if m == width]
    assert max(n for n, _ in seen) <= lm.ROWS
    assert sum(rows(lm.CLASSES)) == 128 * lm.WIDTH and sum(rows(lm.SLOTS)) == (args[3] >= lm.SINGLES).sum()


def test_loss_and_gradient_of_large_logits():
    rng = np.random.default_rng(9)
    c = some_codes(rng, 5000)
    p = {k: v.astype(np.float64) * (4000 if k in "US" else 1) for k, v in lm.initial(2).items()}
    args = a_part(c, rng, 20)
    loss, g = lm.loss_and_gradient(p, *args)
    z, head, slot = lm.hidden(p, *args[:3])["z"], args[3].ravel(), args[4].ravel()
    x = z @ p["U"] + p["u"]
    assert abs(x).max() > 60
    nats = np.logaddexp.reduce(x, 1) - x[np.arange(len(x)), head]
    for k in np.flatnonzero(head >= lm.SINGLES):
        y = z[k] @ p["S"][head[k] - lm.SINGLES] + p["s"][head[k] - lm.SINGLES]
        nats[k] += np.logaddexp.reduce(y) - y[slot[k]]
    assert np.isclose(loss, nats.mean()) and np.allclose(lm.nats(p, z, head.astype(np.uint8), slot), nats)
    assert all(np.isfinite(v).all() for v in g.values())


def test_biases_alone_need_no_maximum_first():
    """Frequent and unused slots have biases far apart, which took every batch of slots through two more passes."""
    c = some_codes(np.random.default_rng(10))  # most slots have no id
    p = lm.initial() | {"u": c.head_bias, "s": c.slot_bias}
    z = np.random.default_rng(11).standard_normal((200, lm.DIM)).astype(np.float32)
    u, s, most_u, most_s = lm.output_weights(p, lm._longest(z))
    logits = z @ p["U"] + p["u"], np.einsum("nd,kds->kns", z, p["S"]) + p["s"][:, None]
    assert abs(logits[0]).max() <= most_u * 1.0001 <= 60 and abs(logits[1]).max() <= most_s * 1.0001 <= 60


def test_attention_equals_its_parts():
    """Of products of Q and K, and of V and O, the forward pass makes what each of the four makes alone; its blocks give whole gradients."""
    rng = np.random.default_rng(12)
    c = some_codes(rng, 5000)
    p = {k: v.astype(np.float64) for k, v in lm.initial(2).items()}
    one, two, _, head, slot, on = args = a_part(c, rng, 2 * lm.WINDOWS + 3)
    h = p["E"][one] + p["E"][two] + p["P"]
    w = np.where(np.tri(lm.WIDTH) > 0, (h @ p["Q"]) @ (h @ p["K"]).transpose(0, 2, 1) * lm.DIM**-0.5, -np.inf)
    w = np.exp(w - w.max(2, keepdims=True))
    y = h + (w / w.sum(2, keepdims=True)) @ (h @ p["V"]) @ p["O"]
    z = y + np.maximum(y @ p["A"] + p["a"], 0) @ p["B"]
    assert np.allclose(lm.hidden(p, one, two)["z"], z.reshape(-1, lm.DIM))
    loss, g = lm.loss_and_gradient(p, *args)
    parts = [lm.loss_and_gradient(p, *(x if isinstance(x, int) else x[k : k + 50] for x in args), on.sum()) for k in range(0, len(one), 50)]
    assert np.isclose(loss, sum(x for x, _ in parts))
    assert all(np.allclose(g[k], sum(x[k] for _, x in parts), atol=1e-12) for k in lm.SHAPES)


def test_gradient_keeps_its_precision_where_scores_are_large():
    rng = np.random.default_rng(13)
    args = a_part(some_codes(rng, 5000), rng, 20)
    for by in (1, 8, 20, 60):
        p = {k: v * np.float32(by**0.5 if k in "QK" else 1) for k, v in lm.initial(2).items()}
        _, g = lm.loss_and_gradient(p, *args)
        _, exact = lm.loss_and_gradient({k: v.astype(np.float64) for k, v in p.items()}, *args)
        assert all(abs(g[k] - exact[k]).max() < 1e-4 * abs(exact[k]).max() for k in lm.SHAPES)
