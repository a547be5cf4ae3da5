"""Transcript repair by hand, and the joining of split words against one plain pass after another."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import repair as rp

SCHEMA = "clip long, idx long, word string, st double, en double"


def rows(spark, *texts):
    return spark.createDataFrame([(c, i, w, float(i), i + 0.5) for c, t in enumerate(texts) for i, w in enumerate(t)], SCHEMA)


def said(df):
    out = {}
    for r in df.orderBy("clip", "idx").collect():
        out.setdefault(r["clip"], []).append(r["word"])
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize(
    "step,text,want",
    [
        (rp.without_stutters, ["you", "You", "-", "you", "a", "a", "go"], ["you", "-", "a", "a", "go"]),
        (rp.lower_case, ["There", "NASA", "I", "iPhone", "OK!"], ["there", "NASA", "i", "iphone", "OK!"]),
        (rp.moved_apostrophes, ["stop", ".'", "cause", "?'", "9"], ["stop", ".", "'cause", "?'", "9"]),
        (rp.contractions, ["don", "'t", "'s", "'", "cause", "they", "'re", "x 'y"], ["don't", "'s", "'cause", "they're", "x'y"]),
        (rp.contractions, ["a", "'b", "'c", "'d", "'e", "'f"], ["a'b", "'c'd", "'e'f"]),
        (rp.digits, ["Twenty", "one.", "five,", "thirty", "forty", "two", "zero"], ["21.", "5,", "30", "42", "zero"]),
        (rp.times_of_day, ["5", "am", "6.", "p", ".", "m", "7", "a", "b", "m", "8", "a", "b", "c", "d", "m", "9", "a.", "m", "3", "x"], ["5AM", "6PM.", "7AM", "8", "a", "b", "c", "d", "m", "9", "a.", "m", "3", "x"]),
        (rp.half_for_both, ["5", "to", "9PM", "5", "to", "9", "6", "to,", "7am."], ["5PM", "to", "9PM", "5", "to", "9", "6AM", "to,", "7am."]),
        (rp.ranges, ["5AM", "to", "9AM", "2", "-", "4", "to", "6", "to", "8", "to", "x"], ["5AM to 9AM", "2 - 4", "to", "6 - 8", "to", "x"]),
        (rp.capitals, ["ai,", "usa", "(monday)", "éa", "b2b"], ["AI,", "USA", "(Monday)", "éa", "b2b"]),
    ],
)
def test_steps_by_hand(spark, step, text, want):
    assert said(step(rows(spark, text))) == [want]


def test_what_is_taken_in_lasts_to_its_end(spark):
    got = [(r["word"], r["st"], r["en"]) for r in rp.ranges(rp.half_for_both(rp.times_of_day(rows(spark, ["5", "to", "9", "p", "m", "x"])))).orderBy("idx").collect()]
    assert got == [("5PM to 9PM", 0.0, 4.5), ("x", 5.0, 5.5)]


def plain_joins(words, zipf):
    """A pass looks at each word with its right neighbour, joined ones again, until a pass joins none."""
    bare = lambda w: "".join(c for c in w if c.isascii() and c.isalpha() or c == "'").lower()
    words = list(words)
    for _ in range(10):
        done, out = True, []
        for w in words:
            if out:
                a, b = bare(out[-1]), bare(w)
                both = zipf.get(a + b, 0)
                x, y = zipf.get(a, 0), zipf.get(b, 0)
                lone = any(len(s) == 1 and s not in "aio" for s in (a, b))
                if a and b and out[-1][-1] not in ".,!?;:'" and not w[0].isupper() and both >= 1.5 and (lone or (min(x, y) < 2.0 and not (x >= 2.5 and y >= 2.5))):
                    out[-1] += w
                    done = False
                    continue
            out.append(w)
        words = out
        if done:
            break
    return words


def test_joining_split_words_equals_plain_passes(spark):
    g = random.Random(4)
    bits = ["a", "b", "ab", "ba", "c", "Ca", "a.", "aab", "-"]
    zipf = {"".join(g.choice("abc") for _ in range(g.randint(1, 7))): g.choice([0.5, 1.6, 2.2, 3.0]) for _ in range(700)}
    zipf |= {"audit": 4.0, "or": 6.0, "ium": 1.6, "orium": 1.5, "auditorium": 3.0}
    texts = [[g.choice(bits) for _ in range(g.randint(1, 40))] for _ in range(30)] + [["the", "audit", "or", "ium", "x"]]
    freq = spark.createDataFrame(list(zipf.items()), "w string, zipf double")
    got = said(rp.joined_splits(rows(spark, *texts), freq))
    assert got == [plain_joins(t, zipf) for t in texts]
    assert got[-1][:2] == ["the", "auditorium"]


def test_frequencies_and_empty_table(spark):
    f = {r["w"]: r["zipf"] for r in rp.frequencies(rows(spark, ["a", "A!", "b", "-", "12"])).collect()}
    assert f == {"a": pytest.approx(8.8239087), "b": pytest.approx(8.5228787)}
    assert rp.repaired(rows(spark, []), rp.frequencies(rows(spark, ["a"]))).collect() == []
    assert rp.repaired(rows(spark, ["Um", "um", "five", "a", "m", "to", "six", "p", "m"]), rp.frequencies(rows(spark, ["um"]))).select(F.col("word")).collect()[1]["word"] == "5AM to 6PM"


def test_joins_shuffle_no_words_that_lie_by_clip(spark):
    texts = [["the", "wor", "ds", "go", "on"] * 5, ["words", "of", "audi", "tor", "ium", "x", "auditor", "auditorium"] * 4, ["x"]] * 5
    w = rows(spark, *texts)
    got = rp.repaired(w.repartition(3, "clip"), rp.frequencies(w), passes=1, parts=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = rp.repaired(w, rp.frequencies(w), passes=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and "auditorium" in said(got)[1]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # the words given, and the joins taken


def test_a_word_of_many_pieces(spark):
    whole = "abcdefghijklmnopqrst"
    zipf = spark.createDataFrame([(whole[:n], 2.0) for n in range(2, 21)], "w string, zipf double")
    got = rp.joined_splits(rows(spark, ["so", *whole, "so", *whole[:7], "-", *whole[:2]]), zipf, 1)
    assert said(got) == [["so", whole, "so", whole[:7], "-", whole[:2]]]
    assert [(r["st"], r["en"]) for r in got.orderBy("idx").collect()][:2] == [(0.0, 0.5), (1.0, 20.5)]
