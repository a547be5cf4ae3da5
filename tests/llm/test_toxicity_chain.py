"""Marginals of the chain against enumeration and against a plain pass, over any number of rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import toxicity


def field_of(trans):
    f = toxicity.Field()
    f.trans = np.array(trans, float)
    return f


def plain(u, trans):
    """Forward-backward over one chain, normalised at each word, with the expected transitions."""
    a, n = np.exp(np.array(trans, float)), len(u)
    emit = np.stack([np.ones(n), np.exp(u)], axis=1)
    fwd, bwd = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(n):
        fwd[t] = emit[t] * (fwd[t - 1] @ a if t else 1)
        fwd[t] /= fwd[t].sum()
    for t in range(n - 2, -1, -1):
        bwd[t] = a @ (emit[t + 1] * bwd[t + 1])
        bwd[t] /= bwd[t].sum()
    p = fwd * bwd
    both = np.zeros((2, 2))
    for t in range(n - 1):
        x = fwd[t][:, None] * a * (emit[t + 1] * bwd[t + 1])
        both += x / x.sum()
    return p[:, 1] / p.sum(axis=1), both


def test_marginals_equal_enumeration():
    trans, u = [[2, -1], [-1, 1.5]], np.array([0.3, -0.2, 0.5])
    weigh = {y: np.exp(sum(k * v for k, v in zip(y, u)) + sum(trans[a][b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=3)}
    want = [sum(w for y, w in weigh.items() if y[i]) / sum(weigh.values()) for i in range(3)]
    assert np.allclose(field_of(trans).forward_backward(u, np.zeros(3, int), 1)[0], want)
    assert np.allclose(want, [0.408, 0.393, 0.420], atol=5e-4)


def test_marginals_and_transitions_over_rows():
    g = np.random.default_rng(4)
    lengths = [*range(1, 131), 0, 64, 128, 700, 0]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for trans in ([[2, -1], [-1, 1.5]], [[0, 0], [0, 0]], [[4, -3], [-6, 5]]):
        u = g.normal(0, 3, len(owner))
        f = field_of(trans)
        p, left, right = f.forward_backward(u, owner, len(lengths))
        weight = g.uniform(1, 2, len(lengths))
        want = [plain(u[owner == i], trans) for i in range(len(lengths)) if lengths[i]]
        assert np.allclose(p, np.concatenate([w[0] for w in want]), atol=1e-9)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        kept = [w for w, n in zip(weight, lengths) if n]
        assert np.allclose(f.pairs(left, right, inner, weight[owner]), sum(k * w[1] for k, w in zip(kept, want)))


def test_a_text_in_slices_is_one_chain(monkeypatch):
    g = np.random.default_rng(7)
    vocab = ["".join(g.choice(list("abcdefgh"), 5)) for _ in range(30)]
    f = field_of([[2.5, -1.5], [-1.5, 2.0]])
    f.bias, f.w = 0.0, g.normal(0, 2.5, toxicity.DIMS + 1).astype(np.float32)
    f.w[-1] = 0.0  # of features that a word lacks
    texts = [" ".join(g.choice(vocab, n)) + tail for n, tail in ((80, ""), (300, " ... "), (41, "!" * 90), (1, ""), (500, ""))] + ["", "-" * 200, "é" * 150]
    want, spans = f.tag(texts)
    assert sum(map(len, spans)) > 10
    for size in (1, 30, 64, 333):
        monkeypatch.setattr(toxicity, "SLICE", size)
        got, cut = f.tag(texts)
        assert np.allclose(got, want, atol=1e-9)
        assert [[x[:2] for x in s] for s in cut] == [[x[:2] for x in s] for s in spans]


def test_the_sample_takes_whole_texts_within_its_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100)
    rows = [{"id": i, "toxic": c, "h": h, "n": n} for i, c, h, n in [(1, 0, 5, 60), (2, 0, 1, 101), (3, 0, 2, 40), (4, 0, 9, 1), (5, 1, 0, 100), (6, 1, 3, 1)]]
    assert toxicity.within(rows) == [[3, 1], [5]]


def test_an_id_that_many_rows_share_is_learned_once(spark):
    g = np.random.default_rng(9)
    plain = lambda: " ".join("".join(g.choice(list("abcdefghij"), 6)) for _ in range(20))
    rows = [(i, plain()) for i in range(40)] + [(100 + i, plain() + " grumpf") for i in range(40)] + [(7, f"copy of seven {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(7, 0)] * 50 + [(3, 1), (3, 0)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels, F.lit(True))
    again = toxicity.fit(docs.repartition(3), labels, F.lit(True))
    s = [f.score(f.tag(["it says grumpf twice grumpf", "plain words here"])[0]) for f in (field, again)]
    assert s[0][0] > 0.7 > 0.3 > s[0][1] and np.allclose(s[0], s[1])
