"""Alignment by longest blocks against the standard library's matcher, and the counts of a caption audit against a plain loop."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import align


def invented(n=40, seed=2):
    g = random.Random(seed)
    out = []
    for k in range(n):
        v = [chr(97 + i) for i in range(g.choice([2, 3, 8, 20]))]
        a = [g.choice(v) for _ in range(g.randint(0, 60))]
        b = list(a) if k % 2 else [g.choice(v) for _ in range(g.randint(0, 60))]
        for _ in range(g.randint(0, 8)):
            if b:
                p = g.randrange(len(b))
                b[p : p + g.randint(0, 3)] = [g.choice(v) for _ in range(g.randint(0, 3))]
        out.append((k, a, b))
    return out + [(1000, [], []), (1001, ["x"], []), (1002, ["x"] * 12, ["x"] * 9), (1003, None, ["y"])]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "pair long, a array<string>, b array<string>")


def matcher(a, b):
    return difflib.SequenceMatcher(None, a or [], b or [], autojunk=False)


@pytest.mark.parametrize("seeds", [(8, 3, 1), (1,), (2, 1)])
def test_blocks_and_opcodes_equal_the_matcher(spark, seeds):
    pairs = invented()
    df = frame(spark, pairs)
    sizes = df.select("pair", F.greatest(F.size("a"), F.lit(0)).alias("la"), F.greatest(F.size("b"), F.lit(0)).alias("lb"))
    got = {}
    for r in align.opcodes(align.blocks(df, seeds), sizes).collect():
        got.setdefault(r["pair"], []).append(tuple(r)[1:])
    for k, a, b in pairs:
        assert sorted(got.get(k, []), key=lambda x: (x[1], x[3], x[2])) == matcher(a, b).get_opcodes(), (k, a, b)


def test_counts_equal_the_matcher(spark):
    pairs = invented(seed=5)
    for r in align.counted(frame(spark, pairs)).collect():
        _, a, b = next(p for p in pairs if p[0] == r["pair"])
        m = matcher(a, b)
        n = dict.fromkeys(["equal", "replace", "insert", "delete"], 0)
        for tag, i1, i2, j1, j2 in m.get_opcodes():
            n[tag] += max(i2 - i1, j2 - j1)
        assert (r["equal"], r["replaced"], r["inserted"], r["deleted"]) == tuple(n.values())
        assert r["ratio"] == pytest.approx(m.ratio())


def plain_accuracy(a, b):
    """Counted from the matcher's opcodes, one word after the other."""
    subs = extra = longest = 0
    lost = []
    for _, i1, i2, j1, j2 in [o for o in matcher(a, b).get_opcodes() if o[0] != "equal"]:
        run = 0
        for x, y in zip([*a[i1:i2], *[None] * 99], [*b[j1:j2], *[None] * 99]):
            if x and y:
                same = x.replace("'", "") == y.replace("'", "") or {x, y} in ({"2", "two"}, {"3k", "3000"})
                subs, run = subs + (not same), 0 if same else run + 1
                longest = max(longest, run)
        lost += range(i1 + min(i2 - i1, j2 - j1), i2)
        extra += max(0, (j2 - j1) - (i2 - i1))
    runs = []
    for i in lost:
        if runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    missing = sum(len(r) for r in runs if len(r) >= 6)
    wer = (subs + missing + extra) / max(1, len(a))
    ratio = matcher(a, b).ratio()
    return (subs, missing, len(lost) - missing, extra, longest, round(wer, 9), round(ratio, 9), not a or not (wer > 0.18 or ratio < 0.82 or longest >= 4))


def test_accuracy_equals_a_plain_count(spark):
    g = random.Random(8)
    vocab = ["two", "2", "its", "it's", "3k", "3000", *"abcdefghij"]
    pairs = []
    for k in range(40):
        a = [g.choice(vocab) for _ in range(g.randint(0, 50))]
        b = list(a)
        for _ in range(g.randint(0, 4)):
            p = g.randrange(len(b) + 1)
            b[p : p + g.choice([0, 1, 2, 7])] = [g.choice(vocab) for _ in range(g.choice([0, 0, 1, 5]))]
        pairs.append((k, a, b))
    got = {r["pair"]: tuple(round(x, 9) if isinstance(x, float) else x for x in tuple(r)[1:]) for r in align.accuracy(frame(spark, pairs)).collect()}
    assert got == {k: plain_accuracy(a, b) for k, a, b in pairs}
    assert {v[-1] for v in got.values()} == {True, False}


def test_tokens_for_comparison(spark):
    rows = [("“Gonna” go—well, 'cause (it’s) fine…",), ("...",), ("",), (None,), ("ok 3k",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(align.spoken_tokens("t")).collect()]
    assert got == [["going", "to", "go", "well", "because", "it's", "fine"], [], [], None, ["okay", "3k"]]
    n = spark.createDataFrame([("3k",), ("$1,200",), ("seven",), ("2.5m",), ("x",), ("50%",)], "t string").select(align.number_of(F.col("t"))).collect()
    assert [r[0] for r in n] == [3000.0, 1200.0, 7.0, 2500000.0, None, 50.0]


def test_votes_equal_a_plain_loop(spark):
    from spanloom.operators import matching as mt

    g = random.Random(3)
    base = ["".join(g.choice("abcde") for _ in range(g.randint(2, 8))) for _ in range(25)]
    bend = lambda w: "".join(g.choice([c, c, c, c, "", "z"]) for c in w)
    sides, heard = [], []
    for k in range(15):
        words = [g.choice(base) for _ in range(g.randint(0, 14))]
        heard.append((k, [bend(w) if g.random() < 0.6 else w for w in words] + [g.choice(base)]))
        sides += [(k, "a", words), (k, "b", [g.choice(base) for _ in range(5)])]
    sides.append((99, "a", ["nobody", "heard"]))
    want = {}
    for k, side, ts in sides:
        free, hits = list(dict(heard).get(k, [])), 0
        for t in ts:
            hit = next((h for h in free if h == t or (len(t) > 3 and difflib.SequenceMatcher(None, h, t, autojunk=False).ratio() >= 0.8)), None)
            if hit is not None:
                free.remove(hit)
                hits += 1
        if ts:
            want[k, side] = round(hits / len(ts), 3)
    got = mt.supported(spark.createDataFrame(sides, "k long, side string, ts array<string>"), spark.createDataFrame(heard, "k long, hs array<string>"), ["k"]).collect()
    assert {(r["k"], r["side"]): r["support"] for r in got} == want
    assert len({v for v in want.values()}) > 4


def test_tokens_are_not_broadcast(spark):
    """A side that is small as a file is many times larger once its tokens are rows."""
    pairs = spark.createDataFrame([(1, ["a", "b"], ["b"])], "pair int, a array<string>, b array<string>")
    ranges = pairs.select("pair", F.lit(0).alias("alo"), F.lit(0).alias("blo"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    for df in (align.runs(ranges, 1), align.counted(pairs), align.accuracy(pairs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("listed,long", [(1 << 19, 1 << 16), (1 << 19, 200), (40, 200), (3, 1 << 16)])
def test_signs_in_blocks_equal_the_matcher(monkeypatch, listed, long):
    monkeypatch.setattr(align, "LISTED", listed)
    monkeypatch.setattr(align, "LONG", long)
    texts = [("".join(a or []), "".join(b or [])) for _, a, b in invented(seed=7)] + [("né😀 so we go on", "so né😀 we go  on"), ("ab" * 40, "ba" * 37), ("", "x"), ("", "")]
    got = align.equal_signs(*map(list, zip(*texts)))
    assert got.tolist() == [sum(m.size for m in matcher(a, b).get_matching_blocks()) for a, b in texts]


def test_share_of_signs(spark, monkeypatch):
    monkeypatch.setattr(align, "TOGETHER", 10)
    rows = [("hello wor", "hello world"), ("", ""), ("a", ""), (None, "a"), ("a", None), ("abc" * 9, "abc" * 7)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(align.alike(F.col("a"), F.col("b"))).collect()]
    assert got == [matcher(a, b).ratio() if None not in (a, b) else None for a, b in rows]
