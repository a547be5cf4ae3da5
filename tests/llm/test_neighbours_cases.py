"""Nearest neighbours of awkward tables."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, node string"


def asked(spark, rows, every=1):
    df = spark.createDataFrame([(i, v, 0, 0.5, "x") for i, v in rows], SCHEMA)
    return ann.neighbours(df, F.col("vec_id") % every == 0).orderBy("query_id", "rank").collect()


def test_empty_and_single(spark):
    assert asked(spark, []) == []
    assert asked(spark, [(0, [1.0, 2.0])]) == []
    assert asked(spark, [(0, None), (1, [0.0, 0.0]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]) == []


def test_fewer_than_k_ties_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, None)]
    got = asked(spark, rows)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] < 3] == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.0), (1, 1, 0, 1.0), (1, 2, 3, 1.0), (1, 3, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 3, 0.0)]
    assert {r["query_id"] for r in got} == {0, 1, 2, 3}  # another dimension takes no part


def test_scores_are_exact_and_equal_ones_go_to_the_smaller_id(spark, monkeypatch):
    """Permuted components give the same inner product with a constant query; here all leaves are met."""
    monkeypatch.setattr(ann, "room_for", lambda *_: float("inf"))
    g = np.random.default_rng(2)
    base = g.integers(-3, 4, 12).astype(float)
    rows = [(0, [1.0] * 12)] + [(i, g.permutation(base).tolist()) for i in range(1, 60)]
    got = [r["vec_id"] for r in asked(spark, rows, 60)]
    assert got == list(range(1, 21))
