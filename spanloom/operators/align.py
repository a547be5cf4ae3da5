"""Alignment of token sequences by longest matching blocks, for many pairs of sequences at once.

The longest run of equal tokens that a pair shares (of several the first in a, then in b) is its first block; what lies before it in
both sequences, and what lies behind it, is aligned the same way. Here every open range of every pair takes its next block in one step:

* runs come from seeds, n tokens in a row that both sides of a range hold, joined on (pair, range, tokens); seeds on one diagonal
  (equal i - j) that follow each other are one run, found as islands;
* a window over (pair, range) chooses the longest run, and every other run is cut into what lies before and behind it, so the
  runs needn't be found again; the step repeats until no run of n tokens is left;
* the ranges still open are then joined on shorter seeds. A run of n tokens holds a seed of n, so long texts that
  mostly agree never join single common words, and the blocks are the same as with single tokens alone.

Steps are written tables, so a lost executor costs a step, and nothing passes through the driver but whether a step has rows. The
number of steps is the depth of the recursion, whatever the number of pairs. A pair's row holds its two sequences as arrays; everything
else is split by (pair, range). Joins sort and merge: a side is a small file, but many times larger once its tokens are rows, too
much for a driver to collect and broadcast.

Where only the share of characters that two texts have in common is asked for (``alike``), the same steps run within a batch of rows, on numpy
arrays: as rows, the characters and runs of many short texts are hundreds of times larger than these. About ``LISTED`` equal seeds are listed
at a time; a range that alone has more takes its longest run from a comparison sign by sign, whose memory is a row.

Pairs with an empty or null sequence have no blocks; a pair is named by any column type that can be grouped by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

SEEDS = (8, 3, 1)
LISTED = 1 << 19
LONG = 1 << 16  # product of a range's lengths from which on it begins with seeds of 9 signs instead of 3
TOGETHER = 1 << 20  # signs of texts compared together; longer ones are compared alone


def _grams(tokens: str, n: int) -> Column:
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.slice(tokens, i + 1, F.lit(n))))


def runs(ranges: DataFrame, n: int) -> DataFrame:
    """pair, r, i, j, len: the runs of n equal tokens or more. ranges: pair, alo, blo, sa and sb (their tokens); r is alo."""
    open_ = ranges.filter((F.size("sa") >= n) & (F.size("sb") >= n))
    a = open_.select("pair", F.col("alo").alias("r"), "blo", _grams("sa", n).alias("p", "g")).select("pair", "r", "g", (F.col("r") + F.col("p")).alias("i"))
    b = open_.select("pair", F.col("alo").alias("r"), "blo", _grams("sb", n).alias("p", "g")).select("pair", "r", "g", (F.col("blo") + F.col("p")).alias("j"))
    seeds = a.join(b.hint("merge"), ["pair", "r", "g"]).select("pair", "r", "i", "j", (F.col("i") - F.col("j")).alias("d"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("pair", "r", "d").orderBy("i"))
    return seeds.withColumn("k", island).groupBy("pair", "r", "d", "k").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count("*") + n - 1).cast("int").alias("len")).select("pair", "r", "i", "j", "len")


def _step(open_runs: DataFrame) -> DataFrame:
    """The runs with the one chosen in their range (bi, bj, bn)."""
    best = F.max(F.struct("len", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).over(Window.partitionBy("pair", "r"))
    return open_runs.withColumn("best", best).select("pair", "r", "i", "j", "len", (-F.col("best.i")).alias("bi"), (-F.col("best.j")).alias("bj"), F.col("best.len").alias("bn"))


def _children(step: DataFrame, n: int) -> DataFrame:
    """What the chosen runs leave of the others, before and behind them."""
    end_i, end_j = F.col("bi") + F.col("bn"), F.col("bj") + F.col("bn")
    before = F.struct(F.col("r"), F.col("i"), F.col("j"), F.least(F.col("len"), F.col("bi") - F.col("i"), F.col("bj") - F.col("j")).alias("len"))
    s = F.greatest(F.lit(0), end_i - F.col("i"), end_j - F.col("j"))
    behind = F.struct(end_i.alias("r"), (F.col("i") + s).alias("i"), (F.col("j") + s).alias("j"), (F.col("len") - s).alias("len"))
    return step.select("pair", F.explode(F.array(before, behind)).alias("x")).select("pair", "x.*").filter(F.col("len") >= n)


def gaps(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """pair, i1, i2, j1, j2 between blocks, where either side has tokens. sizes: pair, la, lb."""
    w = Window.partitionBy("pair").orderBy("i", "j", F.desc("n"))
    ends = sizes.select("pair", F.col("la").alias("i"), F.col("lb").alias("j"), F.lit(0).alias("n"))
    at = lambda c: F.coalesce(F.lag(F.col(c) + F.col("n")).over(w), F.lit(0))
    all_ = found.select("pair", "i", "j", "n").unionByName(ends).select("pair", at("i").alias("i1"), F.col("i").alias("i2"), at("j").alias("j1"), F.col("j").alias("j2"))
    return all_.filter((F.col("i1") < F.col("i2")) | (F.col("j1") < F.col("j2")))


def blocks(pairs: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """pair, i, j, n: the matching blocks of each pair's arrays a and b. The last seed must be 1."""
    pairs = pairs.select("pair", "a", "b").filter((F.size("a") > 0) & (F.size("b") > 0))
    sizes = pairs.select("pair", F.size("a").alias("la"), F.size("b").alias("lb"))
    ranges = pairs.select("pair", F.lit(0).alias("alo"), F.lit(0).alias("blo"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    found = None
    for k, n in enumerate(seeds):
        step = written(_step(runs(ranges, n)), "align-runs")
        while not step.isEmpty():
            chosen = step.filter("i = bi and j = bj").select("pair", "i", "j", F.col("len").alias("n"))
            found = chosen if found is None else found.unionByName(chosen)
            step = written(_step(_children(step, n)), "align-runs")
        if found is None:
            found = step.select("pair", "i", "j", F.col("len").alias("n"))
        found = written(found, "align-blocks")
        if k + 1 < len(seeds):
            part = lambda x, lo, hi: F.slice(x, F.col(lo) + 1, F.col(hi) - F.col(lo))
            both = gaps(found, sizes).filter("i1 < i2 and j1 < j2").join(pairs.hint("merge"), "pair")
            ranges = both.select("pair", F.col("i1").alias("alo"), F.col("j1").alias("blo"), part("a", "i1", "i2").alias("sa"), part("b", "j1", "j2").alias("sb"))
    return found


def opcodes(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """pair, tag (equal, replace, delete, insert), i1, i2, j1, j2: how a becomes b; equal stretches in one row each."""
    w = Window.partitionBy("pair").orderBy("i")
    goes_on = (F.lag(F.col("i") + F.col("n")).over(w) == F.col("i")) & (F.lag(F.col("j") + F.col("n")).over(w) == F.col("j"))
    marked = found.withColumn("new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(w))
    same = marked.groupBy("pair", "k").agg(F.min("i").alias("i1"), F.max(F.col("i") + F.col("n")).alias("i2"), F.min("j").alias("j1"), F.max(F.col("j") + F.col("n")).alias("j2"))
    tag = F.when(F.col("i1") == F.col("i2"), "insert").when(F.col("j1") == F.col("j2"), "delete").otherwise("replace")
    return gaps(found, sizes).withColumn("tag", tag).unionByName(same.drop("k").withColumn("tag", F.lit("equal"))).select("pair", "tag", "i1", "i2", "j1", "j2")


def counted(pairs: DataFrame) -> DataFrame:
    """pair, equal, replaced, inserted, deleted, longest (of the replaced stretches), ratio (2 * equal of all tokens), wer. pairs: pair, a, b."""
    sizes = pairs.select("pair", F.greatest(F.size("a"), F.lit(0)).alias("la"), F.greatest(F.size("b"), F.lit(0)).alias("lb"))
    size = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")).cast("long")
    of = lambda tag: F.sum(F.when(F.col("tag") == tag, size).otherwise(0))
    ops = opcodes(blocks(pairs), sizes).groupBy("pair").agg(of("equal").alias("equal"), of("replace").alias("replaced"), of("insert").alias("inserted"), of("delete").alias("deleted"), F.coalesce(F.max(F.when(F.col("tag") == "replace", size)), F.lit(0)).cast("long").alias("longest"))
    out = sizes.join(ops.hint("merge"), "pair", "left").fillna(0, ["equal", "replaced", "inserted", "deleted", "longest"])
    both = F.col("la") + F.col("lb")
    ratio = F.when(both == 0, 1.0).otherwise(2.0 * F.col("equal") / both)
    return out.select("pair", "equal", "replaced", "inserted", "deleted", "longest", ratio.alias("ratio"), ((F.col("replaced") + F.col("inserted") + F.col("deleted")) / F.greatest(F.lit(1), F.col("la"))).alias("wer"))


def alike(a: Column, b: Column) -> Column:
    """The share of characters of two texts that lie in matching blocks (``ratio`` of ``counted``): 1 for two empty texts, null where one is missing."""

    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        xs, ys = x[both].tolist(), y[both].tolist()
        size = np.array([len(p) + len(q) for p, q in zip(xs, ys)], np.int64)
        part = np.cumsum(size) // TOGETHER
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(xs)]
        equal = np.concatenate([np.zeros(0, np.int64), *[equal_signs(xs[s:e], ys[s:e]) for s, e in zip(cut, cut[1:]) if e > s]])
        out = pd.Series(index=x.index, dtype="Float64")
        out[both] = np.where(size == 0, 1.0, 2.0 * equal / np.maximum(size, 1))
        return out

    return F.pandas_udf(share, "double")(a, b)


def equal_signs(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters of each pair of texts lie in matching blocks. Ranges are columns of (pair, alo, ahi, blo, bhi)."""
    raw = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    sizes = [np.array([len(t) for t in x], np.int64) for x in (a, b)]
    ends = [np.cumsum(x) for x in sizes]
    names, at = np.unique(np.concatenate(raw), return_inverse=True)
    signs, many = (at[: len(raw[0])], at[len(raw[0]) :]), len(names)
    equal = np.zeros(len(a), np.int64)
    ranges = np.stack([np.arange(len(a)), ends[0] - sizes[0], ends[0], ends[1] - sizes[1], ends[1]])
    later = ranges[:, np.minimum(*sizes) > 0]
    for n in (9, 3, 1):
        large = (later[2] - later[1]) * (later[4] - later[3]) >= (LONG if n == 9 else 0)
        todo, done = [later[:, large]], [later[:, ~large]]
        keys = _seeds(signs, many, n) if large.any() else None
        while todo:
            ranges = todo.pop()
            if ranges.shape[1]:
                _narrow(ranges, n, signs, keys, equal, todo, done)
        later = np.concatenate(done, axis=1)
    return equal


def _dense(both: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    names, at = np.unique(np.concatenate(both), return_inverse=True)
    return [at[: len(both[0])], at[len(both[0]) :]], len(names)


def _seeds(signs: tuple[np.ndarray, np.ndarray], many: int, n: int) -> tuple[list[np.ndarray], int]:
    """Numbers for each n signs in a row (1, 3 or 9) on both sides, equal for equal ones, and how many there may be."""
    found, span = list(signs), max(1, many)
    for step in {1: [], 3: [1], 9: [1, 3]}[n]:
        unit, wide = found, span
        for k in (1, 2):
            found = [x[: max(0, len(u) - k * step)] * wide + u[k * step :] for x, u in zip(found, unit)]
            if (span := span * wide) >= 1 << 30:
                found, span = _dense(found)
    return found, span


def _narrow(ranges: np.ndarray, n: int, signs: tuple, keys: tuple, equal: np.ndarray, todo: list, done: list) -> None:
    """Adds up the blocks of n signs and more that the ranges have; what these leave goes to done, ranges put off go to todo."""
    (ka, kb), span = keys
    _, alo, ahi, blo, bhi = ranges
    starts = []
    for lo, hi in ((alo, ahi), (blo, bhi)):
        size = np.maximum(0, hi - lo - (n - 1))
        r = np.repeat(np.arange(len(lo)), size)
        starts.append((r, np.arange(len(r)) + np.repeat(lo - (np.cumsum(size) - size), size)))
    (ra, i), (rb, j) = starts
    held = rb * span + kb[j]
    order = np.argsort(held, kind="stable")
    held, asked = held[order], ra * span + ka[i]
    first = np.searchsorted(held, asked)
    count = np.searchsorted(held, asked, "right") - first
    each = np.bincount(ra, count, len(alo)).astype(np.int64)
    if each.sum() > LISTED:
        part = np.cumsum(each) // LISTED
        if len(alo) > 1:
            todo += np.split(ranges, np.flatnonzero(np.diff(part)) + 1, axis=1) if part[0] != part[-1] else [ranges[:, : len(alo) // 2], ranges[:, len(alo) // 2 :]]
            return
        x, y, size = _longest(signs[0][alo[0] : ahi[0]], signs[1][blo[0] : bhi[0]])
        if size < n:
            done.append(ranges)
        else:
            equal[ranges[0]] += size
            todo += _around(ranges, alo + x, blo + y, size)
        return
    r, i = np.repeat(ra, count), np.repeat(i, count)
    j = j[order[np.arange(len(r)) + np.repeat(first - (np.cumsum(count) - count), count)]]
    room = ahi - alo + bhi - blo
    d = (np.cumsum(room) - room + bhi - alo)[r] + i - j  # ascends with the range, and within it tells diagonals apart
    order = np.argsort(d, kind="stable")
    r, i, j, d = r[order], i[order], j[order], d[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)))) if len(r) else np.zeros(0, np.int64)
    size = np.diff(new, append=len(r)) + n - 1
    r, i, j = r[new], i[new], j[new]
    without = np.ones(len(alo), bool)
    without[r] = False
    done.append(ranges[:, without])
    while len(r):
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        g = np.repeat(np.arange(len(first)), np.diff(first, append=len(r)))
        best = np.maximum.reduceat(size, first)
        longest = size == best[g]
        bi = np.minimum.reduceat(np.where(longest, i, len(signs[0])), first)
        bj = np.minimum.reduceat(np.where(longest & (i == bi[g]), j, len(signs[1])), first)
        ranges = ranges[:, r[first]]
        np.add.at(equal, ranges[0], best)
        before = np.minimum(size, np.minimum(bi[g] - i, bj[g] - j))
        skip = np.maximum(0, np.maximum((bi + best)[g] - i, (bj + best)[g] - j))
        pieces = []  # of the other runs, before and behind the chosen ones, with their place in the order of ranges
        many = np.stack([np.bincount(g[x >= n], minlength=len(first)) for x in (before, size - skip)], axis=1).ravel()
        place = (np.cumsum(many) - many).reshape(-1, 2)
        for k, (s, length) in enumerate(((0, before), (skip, size - skip))):
            ok = length >= n
            own = g[ok]
            at = place[own, k] + np.arange(len(own)) - (np.cumsum(many[k::2]) - many[k::2])[own]
            pieces.append((at, (i + s)[ok], (j + s)[ok], length[ok]))
        ranges = np.stack(_around(ranges, bi, bj, best), axis=2).reshape(5, -1)
        done.append(ranges[:, many == 0])
        r = np.repeat(np.arange(len(many)), many)
        i, j, size = (np.empty(len(r), np.int64) for _ in range(3))
        for at, *values in pieces:
            for x, v in zip((i, j, size), values):
                x[at] = v


def _around(ranges: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
    """What blocks leave of ranges before and behind them."""
    pair, alo, ahi, blo, bhi = ranges
    return [np.stack([pair, alo, i, blo, j]), np.stack([pair, i + size, ahi, j + size, bhi])]


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Where the longest run that a and b share begins in both, and its length; of several the first in a, then in b."""
    row, found = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for k, sign in enumerate(a):
        row[1:] = np.where(b == sign, row[:-1] + 1, 0)
        at = int(row.argmax())
        if row[at] > found[2]:
            n = int(row[at])
            found = k + 1 - n, at - n, n
    return found


# fixed values: what a spoken form stands for, the number words, and the limits of a caption that says something else
EXPANDED = {"gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of", "cuz": "because", "'cause": "because", "cause": "because", "lemme": "let me", "dunno": "don't know", "em": "them", "'em": "them", "ok": "okay"}
NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000}
EDGE = ".,;:!?\"'()[]…"
WER_LIMIT, LIKENESS, WRONG_RUN, LOST_RUN = 0.18, 0.82, 4, 6


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def without_edges(tokens: Column) -> Column:
    """Tokens without punctuation at their edges; what was nothing else is ''."""
    edge = "[" + "".join("\\" + c if c in "[]" else c for c in EDGE) + "]+"
    return F.transform(tokens, lambda x: F.regexp_replace(x, f"^{edge}|{edge}$", ""))


def spoken_tokens(text: str | Column) -> Column:
    """A text's tokens for comparison: lower case, plain quotes, dashes as blanks, no punctuation at the edges, short forms written out."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    t = F.translate(F.translate(t, "’‘“”", "''\"\""), "—–-", "   ")
    bare = F.array_remove(without_edges(F.split(t, r"\s+")), "")
    return F.flatten(F.transform(bare, lambda x: F.split(F.coalesce(F.element_at(_map(EXPANDED), x), x), " ")))


def number_of(token: Column) -> Column:
    """What a token is worth as a number ("3k", "$1,200", "seven"), else null."""
    t = F.regexp_replace(token, "[,$%]", "")
    unit = F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).otherwise(1.0)
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?[km]?$"), F.regexp_replace(t, "[km]", "").cast("double") * unit).otherwise(F.element_at(_map(NUMBERS), t).cast("double"))


def same_word(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (number_of(a) == number_of(b)) | (F.regexp_replace(a, "'", "") == F.regexp_replace(b, "'", "")), F.lit(False))


def accuracy(pairs: DataFrame) -> DataFrame:
    """Captions (b) held against what was said (a): pair, substitutions, missing, trims, extra, longest (run of wrong words), wer, ratio, says_same.

    Words that face each other in a replaced stretch count unless they mean the same. Spoken words without a caption are trims, unless ``LOST_RUN`` follow
    each other; then they are content that is missing."""
    sizes = pairs.select("pair", F.greatest(F.size("a"), F.lit(0)).alias("la"), F.greatest(F.size("b"), F.lit(0)).alias("lb"))
    found = blocks(pairs)
    part = lambda x, lo, hi: F.slice(x, F.col(lo) + 1, F.col(hi) - F.col(lo))
    facing = gaps(found, sizes).join(pairs.select("pair", "a", "b").hint("merge"), "pair")
    facing = facing.select("pair", "i1", part("a", "i1", "i2").alias("x"), part("b", "j1", "j2").alias("y")).select("pair", "i1", F.posexplode(F.arrays_zip("x", "y")).alias("k", "z"))
    each = written(facing.select("pair", "i1", "k", (F.col("i1") + F.col("k")).alias("i"), "z.x", "z.y").withColumn("same", same_word(F.col("x"), F.col("y"))), "align-facing")
    both = each.filter("x is not null and y is not null")
    since = F.count_if("same").over(Window.partitionBy("pair", "i1").orderBy("k"))
    wrong = both.withColumn("since", since).filter("not same").groupBy("pair", "i1", "since").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("substitutions"), F.max("n").alias("longest"))
    lost = each.filter("y is null").withColumn("k", F.col("i") - F.row_number().over(Window.partitionBy("pair").orderBy("i"))).groupBy("pair", "k").agg(F.count("*").alias("n"))
    lost = lost.groupBy("pair").agg(F.sum(F.when(F.col("n") >= LOST_RUN, F.col("n")).otherwise(0)).alias("missing"), F.sum(F.when(F.col("n") < LOST_RUN, F.col("n")).otherwise(0)).alias("trims"))
    extra = each.filter("x is null").groupBy("pair").agg(F.count("*").alias("extra"))
    equal = found.groupBy("pair").agg(F.sum("n").alias("equal"))
    out = sizes
    for part_ in (wrong, lost, extra, equal):
        out = out.join(part_.hint("merge"), "pair", "left")
    counts = ["substitutions", "missing", "trims", "extra", "longest"]
    out = out.fillna(0, [*counts, "equal"])
    wer = (F.col("substitutions") + F.col("missing") + F.col("extra")) / F.greatest(F.lit(1), F.col("la"))
    total = F.col("la") + F.col("lb")
    out = out.withColumn("wer", wer).withColumn("ratio", F.when(total == 0, 1.0).otherwise(2.0 * F.col("equal") / total))
    says = (F.col("la") == 0) | ((F.col("wer") <= WER_LIMIT) & (F.col("ratio") >= LIKENESS) & (F.col("longest") < WRONG_RUN))
    return out.select("pair", *[F.col(c).cast("long").alias(c) for c in counts], "wer", "ratio", says.alias("says_same"))
