"""Divergence of sources against DuckDB's SQL and by hand."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import duck_rows, rows_of

from spanloom.llm import divergence
from spanloom.llm.divergence import OP11_SQL, shares, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, part int, value double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0, "x", 1, 0.5) for i, (g, s, t) in enumerate(rows)], SCHEMA)


def held(spark, rows):
    df = frame(spark, rows)
    pdf = pd.DataFrame([(t, g, s) for g, s, t in rows], columns=["text", "lang", "source"]).astype(object)
    got = rows_of(source_divergence(df))
    assert got == duck_rows(OP11_SQL, documents=pdf)
    return got


def invented(n=120, seed=5):
    g = random.Random(seed)
    vocab = ["Alpha", "béta", "GAMMA", "É", "é", "x1y", "中文", "delta", "eta", "zeta", "w w", "\U0001f600", *[chr(97 + i) * 3 for i in range(20)]]
    rows = []
    for _ in range(n):
        lang, source = g.choice(["en", "en", "de", None, ""]), g.choice(["hot", "hot", "hot", "a", "b", "B", None])
        rows.append((lang, source, g.choice(["", " ", "-", "\n"]).join([""] * g.randint(0, 1) + [g.choice(vocab[: g.randint(2, len(vocab))]) + g.choice([" ", ".", "9", "_"]) for _ in range(g.randint(0, 40))])))
    return rows + [("fr", "a", None), ("fr", "b", "12 34"), ("it", "solo", "uno due tre")] + [("es", "one", "hola hola mundo")] * 3 + [("es", "two", None)]


def test_invented_rows_equal_sql(spark):
    got = held(spark, invented())
    assert {r[2] for r in got} == {"pair", "term"}
    assert [r for r in got if r[1] == "fr"] == [("a", "fr", "pair", 1, "b", 0), ("b", "fr", "pair", 1, "a", 0)]
    assert not [r for r in got if r[1] == "it"] and {r[0] for r in got if r[1] == "es"} == {"one", "two"}  # no term of a source that is the whole language stands out


def test_many_tiles_give_the_same(spark, monkeypatch):
    want = held(spark, invented())
    for name, v in {"TERMS": 3, "SOURCES": 2, "PARTS": 2}.items():
        monkeypatch.setattr(divergence, name, v)
    assert held(spark, invented()) == want


def test_pairs_some_rows_at_a_time(monkeypatch):
    g = np.random.default_rng(1)
    p, q = g.integers(1, 10**9, (7, 9)), g.integers(1, 10**9, (4, 9))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y)) for y in q] for x in p]
    assert divergence.pair_matrix(p, q).tolist() == want
    monkeypatch.setattr(divergence, "CELLS", 40)
    assert divergence.pair_matrix(p, q).tolist() == want


def test_counts_handed_on_early_add_up(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "b", "a", "a"]), pa.array([b"x y X", b"z", b"", b"y y-q"], pa.binary())], ["lang", "source", "text"])

    def sums():
        out = Counter()
        for r in divergence.tally(iter([batch])):
            for x in r.to_pylist():
                out[x["source"], x["term"], "n"] += x["n"]
                out[x["source"], x["term"], "docs"] += x["docs"]
        return out

    want = sums()
    assert want["a", b"y", "n"] == 3 and want["a", b"y", "docs"] == 2 and want["a", b"x", "docs"] == 1
    monkeypatch.setattr(divergence, "HELD", 1)
    monkeypatch.setattr(divergence, "SLICE", 2)
    assert sums() == want


def test_only_the_best_terms_come_back(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TOP", 3)
    got = rows_of(source_divergence(frame(spark, invented())))
    terms = [r for r in got if r[2] == "term"]
    assert terms and max(r[3] for r in terms) == 3


def test_empty_table(spark):
    assert rows_of(source_divergence(frame(spark, []))) == []


@pytest.mark.parametrize("count,total,kept", [(0, 0, 1), (5, 17, 3), (10**13, 9 * 10**14, 10**8), (999, 999, 1), (2**40, 2**41, 7)])
def test_shares_are_exact(count, total, kept):
    assert shares(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 1) // (total + kept)


def test_words_of_a_text_in_slices(monkeypatch):
    raw = "Ab cÉ-d\x00e 9f__g".encode()
    whole = [t for some in divergence.terms(raw) for t in some]
    assert whole == [b"ab", "cÉ".encode(), b"d", b"e", b"f", b"g"]
    monkeypatch.setattr(divergence, "SLICE", 1)
    assert [t for some in divergence.terms(raw) for t in some] == whole
