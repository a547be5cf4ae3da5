"""One round of co-training against the same by hand; labels outside 0 and 1."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import quality


def corpus(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(260):
        bad = i % 3 == 0
        text = " ".join(rng.choices(["buy", "now", "cheap"] + words[:2], k=rng.randint(20, 60))) if bad else " ".join(rng.choices(words, k=rng.randint(20, 60))) + "\n" + " ".join(rng.choices(words, k=9))
        rows.append((i, text, "en", "junk" if bad and i % 2 else "web", None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_hand(views, good):
    """Both views' classifiers after one round, from all rows in memory."""
    rows = views.toPandas()
    h = views.select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).toPandas().set_index("id")["h"]
    c, m = quality.arrays(rows)
    at = {i: k for k, i in enumerate(rows["id"])}
    ids = sorted(good, key=lambda i: (h[i], i))
    y = np.array([good[i] for i in ids], float)
    n = {k: (y == k).sum() for k in (0, 1)}
    weight = np.where(y == 1, len(y) - n[0], n[0]) / np.where(y == 1, n[1], n[0])
    apart = np.zeros(len(y), bool)
    for k in (0, 1):
        apart[np.flatnonzero(y == k)[::4]] = True
    k = np.array([at[i] for i in ids])[~apart]
    x = [quality.scaled(c), m]
    sets = [[x[v][k], y[~apart], weight[~apart]] for v in (0, 1)]
    first = [quality.Logistic(*s) for s in sets]
    grown = [list(s) for s in sets]
    for v in (0, 1):
        z = first[v].logit(x[v])
        least = {}
        for i, value in zip(rows["id"], np.round(z, 9)):
            least[value] = min(least.get(value, i), i)
        ranked = sorted(least)
        for label, part in ((1.0, [s for s in reversed(ranked) if s > 0][: quality.PICKS]), (0.0, [s for s in ranked if s < 0][: quality.PICKS])):
            new = [at[least[s]] for s in part if least[s] not in good]
            other = grown[1 - v]
            other[0] = np.concatenate((other[0], x[1 - v][new]))
            other[1] = np.concatenate((other[1], np.full(len(new), label)))
            other[2] = np.concatenate((other[2], np.full(len(new), weight.mean())))
    return [quality.Logistic(*s) for s in grown]


def test_one_round_equals_the_same_by_hand(spark):
    docs = corpus(spark)
    good = {i: int(i % 3 > 0) for i in range(0, 260, 5)}
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    views = quality.features(docs, "doc_id", "text", "source", "lang", "n_chars")
    old = quality.ROUNDS, quality.PICKS
    quality.ROUNDS, quality.PICKS = 1, 7
    try:
        got = quality.train(views, labels, "doc_id", "quality")
        want = by_hand(views, good)
    finally:
        quality.ROUNDS, quality.PICKS = old
    for a, b in zip(got.views, want):
        assert np.allclose(a.b, b.b, atol=1e-6)


def test_other_labels_do_not_count(spark):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, (0, 2, 1, None)[i % 4]) for i in range(80)], "doc_id long, quality int")
    model, views = quality.fit(docs, labels)
    assert quality.score(views, model).filter("score between 0 and 1").count() == 260
    only = spark.createDataFrame([(1, 2), (2, 2)], "doc_id long, quality int")
    model, views = quality.fit(docs, only)
    assert {r["score"] for r in quality.score(views, model).collect()} == {1.0}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")
    model, views = quality.fit(docs, one)
    assert {r["score"] for r in quality.score(views, model).collect()} == {0.0}
