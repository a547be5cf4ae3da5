"""Benchmark passages in documents against DuckDB's SQL and plain loops."""

import hashlib
import random
import re

import pandas as pd
from conftest import duck_rows, rows_of
from pyspark.sql import functions as F

from spanloom.llm import decontam
from spanloom.llm.decontam import OP12_SQL, contamination

DOCS, ITEMS = "doc_id long, text string, doc string, h int, pos int, term string, n double", "item_id long, text string, w int, item string"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2, "y", 0.5) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1, "z") for i, t in items], ITEMS)
    return contamination(d, b)


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for k, x in items:
            iw = plain_words(x)
            z = min(10, len(iw))
            for s in range(len(iw) - z + 1) if z else ():
                for p in range(len(w) - z + 1):
                    if w[p : p + z] == iw[s : s + z]:
                        hit |= set(range(p, p + z))
                        ids |= {str(k)} if k is not None else set()
        out.append((len(hit) > 0, i, hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit), len(ids), len(w)))
    return sorted(out, key=repr)


def invented(seed=1, vocab=9, n=60):
    g = random.Random(seed)
    words = ["The", "cat", "É", "é", "sat", "x9", "on", "mat", "日本", "of", "rare"][:vocab] + ["z" + chr(97 + i) for i in range(6)]
    some = lambda k: " ".join(g.choice(words) for _ in range(k))
    items = [(i, some(g.choice([3, 9, 10, 11, 25, 40]))) for i in range(8)] + [(10, "one"), (9, None), (11, ""), (12, " - "), (None, some(12)), (3, some(12)), (20, "a b c"), (21, "a b c")]
    docs = []
    for i in range(n):
        parts = [some(g.randint(0, 30)) for _ in range(3)]
        for _ in range(g.randint(0, 3)):
            w = plain_words(g.choice(items)[1])
            a = g.randint(0, max(0, len(w) - 1))
            parts.insert(g.randint(0, 3), g.choice([", ", " ", "\n"]).join(w[a : a + g.randint(1, 40)]).upper() if g.random() < 0.3 else " ".join(w))
        docs.append((i, "; ".join(parts)))
    return docs + [(5, "again " + (items[2][1] or "")), (5, docs[5][1]), (None, items[4][1]), (None, None), (98, None), (99, ""), (97, ". A b\tC"), (96, "a c b")], items


def held(spark, docs, items):
    got = run(spark, docs, items)
    rows = rows_of(got)
    assert rows_of(got.drop("n_near")) == brute(docs, items)
    assert rows == duck_rows(OP12_SQL, documents=pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), benchmark=pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    return rows


def test_equals_sql_and_a_plain_loop(spark):
    got = held(spark, *invented())
    assert any(r[0] for r in got) and not all(r[0] for r in got)


def test_few_words_that_all_are_common(spark):
    held(spark, *invented(seed=4, vocab=1, n=25))


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    held(spark, *invented(seed=2))


def test_empty_tables(spark):
    assert rows_of(run(spark, [], invented()[1])) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(run(spark, [(1, "a b")], [])) == [(False, 1, empty, 0, 0, 0, 2)]


def test_passages_that_repeat_in_a_long_text(spark):
    item = " ".join(f"w{i}" for i in range(15))
    text = ("filler " * 50 + item + " ") * 40 + item + " " + " ".join(f"w{i}" for i in range(5, 15))
    (row,) = run(spark, [(1, text)], [(7, item)]).collect()
    assert (row["n_hit"], row["n_items"], row["n_words"], row["n_near"]) == (41 * 15 + 10, 1, 40 * 65 + 25, 1)


def test_near_matches_are_told_from_exact_ones(spark):
    item = " ".join(f"w{i}" for i in range(12))
    cut = " ".join(f"w{i}" + " and so on" * (i in (3, 5)) for i in range(12))
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in run(spark, [(1, item), (2, cut), (3, "w0 " + "x " * 30 + "w1 " + "y " * 30 + "w2")], [(7, item)]).collect()}
    assert got == {1: (12, 1), 2: (0, 1), 3: (0, 0)}


def test_no_python_on_the_way(spark):
    docs, items = invented()
    plan = run(spark, docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_of_a_text(spark):
    texts = ["Ab cÉ-d\x00e 9f__g", "--x", "", "ÀA", "A.B", "x\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(decontam.words(F.col("t"))).collect()] == [plain_words(t) for t in texts]
