"""The bounded sample of labelled rows doesn't decide scores: classes weigh as in all labelled rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import toxicity


def test_scores_are_stable_when_the_sample_is_small(spark):
    rng = random.Random(11)
    wide = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    # the word is in every toxic text and in as many clean ones
    rows = [(i, int(i % 20 == 0), " ".join(rng.choices(wide, k=40) + (["grumpf"] if i % 20 == 0 or i % 20 == 7 else []))) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    plain = [" ".join(rng.choices(wide, k=40)) for _ in range(200)]

    def clean_scores():
        field = toxicity.fit(docs, labels, F.lit(True))
        return field.score(field.tag(plain)[0])

    old = toxicity.SAMPLE_ROWS
    whole = clean_scores()
    toxicity.SAMPLE_ROWS = 150
    try:
        small = clean_scores()
    finally:
        toxicity.SAMPLE_ROWS = old
    assert abs(np.mean(small) - np.mean(whole)) < 0.03


def test_a_mark_needs_the_same_evidence_at_any_sample():
    def marked(n_clean, *clean):
        rng = random.Random(3)
        own = [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(4)) for _ in range(20 + n_clean)]
        texts = [f"zzzz {t}" if i < 6 else t for i, t in enumerate(own)]
        y = np.array([1] * 20 + [0] * n_clean)
        words = toxicity.words_of(texts)
        return bool(toxicity.marking(words, y, len(y), *clean)[words.feats[0, 0]])

    assert marked(380) and marked(20, 19.0) and not marked(20)
