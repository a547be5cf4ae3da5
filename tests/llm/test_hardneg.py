"""Hard negatives against DuckDB's SQL and a plain loop."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import duck_rows, rows_of
from pyspark.sql import functions as F

from spanloom.llm import hardneg
from spanloom.llm.hardneg import OP13_SQL, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v double, block int, anchor boolean"


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, g, "x", 0.5, 1, True) for i, v, g in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows_of(hard_negatives(df, F.col("vec_id") % 50 == 0, label))


def brute(rows):
    """In the order of the sorted columns: anchor, negative, negative's score, positive, positive's score, rank."""
    one = {}
    for i, v, g in rows:
        if i is None or g is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        r = ((g + 1) % 10 if i % 7 == 0 else g, v)
        one[i] = min(one.get(i, r), r)
    out = []
    for a, (ga, va) in one.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, g) for i, (g, v) in one.items() if i != a and len(v) == len(va))
        for ps, p, _ in [r for r in scored if r[2] == ga][:5]:
            fits = [r for r in scored if r[2] != ga and 50 * -ps <= 100 * -r[0] <= 95 * -ps]
            out += [(a, i, -ns, p, -ps, k + 1) for k, (ns, i, _) in enumerate(fits[:3])]
    return sorted(out, key=repr)


def invented(n=400, dim=6, seed=3):
    g = np.random.default_rng(seed)
    rows = [(int(i), (g.normal(size=dim) + 0.7).round(1).tolist(), int(g.integers(0, 10)) if g.random() > 0.3 else 4) for i in range(n)]
    return rows + [(50, rows[50][1], rows[50][2]), (1000, None, 1), (1001, [1.0] * dim, None), (1002, [1.0] * (dim - 1) + [None], 2), (1003, [math.nan] * dim, 2), (1004, [math.inf] * dim, 2), (1050, [1.0, 2.0], 2), (1051, [1.0, 1.0], 2), (1052, [1.0, 1.0], 3), (1053, [2.0, 0.5], 4), (1100, [], 2), (1101, [], 2), (1102, [], 3), (None, [1.0] * dim, 1), (200, [9.0] * dim, 9)]


def test_equals_sql_and_a_plain_loop(spark):
    got = mined(spark, invented())
    assert got == brute(invented()) and len(got) > 80
    pdf = pd.DataFrame(invented()[:400], columns=["vec_id", "embedding", "label"])
    pdf["embedding"] = [np.array(v, np.float32) for v in pdf["embedding"]]
    assert mined(spark, invented()[:400]) == duck_rows(OP13_SQL, embeddings=pdf)


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "ROWS", 23)
    assert mined(spark, invented()) == brute(invented())


def test_copies_tie_by_id(spark):
    rows = [(i, [1.0, 0.5], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows) == []  # no copy of another label is below 95 hundredths
    rows = [(i, [1.0, 0.5], i % 3) if i < 80 else (i, [0.7, 0.3], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows) != []


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, None, None)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0, -1.0], 1), (1, [-1.0, 1.0], 1), (2, [-2.0, 2.0], 2)], [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]])
def test_awkward_tables(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_products_are_exact_beyond_floats():
    a = np.array([[2**40 + 1, 3]])
    assert hardneg.products(a, np.array([[2**20 + 1, 5]]))[0, 0] == (2**40 + 1) * (2**20 + 1) + 15


def test_a_pass_in_small_steps_is_the_same(monkeypatch):
    g = np.random.default_rng(0)
    block = hardneg.Block(np.arange(40)[::-1].copy(), g.integers(0, 3, 40), g.integers(-3, 4, (40, 4)))
    assert block.ids.tolist() == list(range(40))
    s = hardneg.products(block.vectors[:1], block.vectors)[0]
    assert hardneg.ordered(s).tolist() == sorted(range(40), key=lambda i: (-s[i], i))
