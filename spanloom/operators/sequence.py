"""Sequence operators: sessions, runs, rolling and robust statistics, repeats, and ordered folds.

Each is one shuffle by its keys and a sort; frames are incremental. Where the next step depends on the previous result, sorted rows
stream through a small generator (``scan.scanned``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands
from .scan import scanned


def ordered(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def sessions(df: DataFrame, gap: float, who: str | None = None) -> DataFrame:
    """Rows numbered by session: a new one where the gap since the previous end reaches ``gap`` or ``who`` changes; a missing ``who`` on
    either side doesn't count as a change."""
    w = ordered(["clip"], ["idx"])
    since = F.col("st") - F.lag("en").over(w)
    new = F.lag("idx").over(w).isNull() | (since >= gap)
    if who:
        new = new | F.coalesce(F.lag(who).over(w) != F.col(who), F.lit(False))
    marked = df.withColumn("_new", new)
    return islands(marked, F.col("_new"), ["idx"], ["clip"], "session").drop("_new")


def runs(df: DataFrame, label: str, keys: list[str], order: str) -> DataFrame:
    """keys, label, first, last, n, run: blocks of equal consecutive labels."""
    w = ordered(keys, [order])
    marked = df.withColumn("_new", ~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(order).over(w).isNull())
    got = islands(marked, F.col("_new"), [order], keys, "run")
    return got.groupBy(*keys, "run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def cumulative_timeline(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """clip, idx, out_st, out_en: where each part lies once all are laid end to end."""
    w = ordered(["clip"], ["idx"])
    dur = F.col("en") - F.col("st")
    start = F.coalesce(F.sum(dur).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.select("clip", "idx", *(keep or []), start.alias("out_st"), F.sum(dur).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("out_en"))


def hold_last(label: Column, keys: list[str], order: str, default: str) -> Column:
    return F.coalesce(F.last(label, ignorenulls=True).over(ordered(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)), F.lit(default))


def rolling_median(x: str, k: int, keys: list[str], order: str) -> Column:
    """Centred median of k rows; shorter at the ends, nulls skipped."""
    return F.percentile(x, 0.5).over(ordered(keys, [order]).rowsBetween(-(k // 2), k // 2))


def padded_mean(df: DataFrame, x: str, k: int, keys: list[str], order: str, name: str) -> DataFrame:
    """Centred mean of k rows where the first and last values stand for what lies beyond the ends."""
    h, w = k // 2, ordered(keys, [order])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    head, tail = F.greatest(F.lit(0), h + 1 - i), F.greatest(F.lit(0), i + h - n)
    total = F.sum(x).over(w.rowsBetween(-h, h)) + head * F.first(x).over(whole) + tail * F.last(x).over(whole)
    return df.withColumn(name, total / (2 * h + 1))


def sustained(flag: Column, k: int, keys: list[str], order: str) -> Column:
    """True where ``flag`` holds here and on the following k - 1 rows."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(ordered(keys, [order]).rowsBetween(0, k - 1)) == k


def without_repeats(df: DataFrame, token: Column, keys: list[str], order: str) -> DataFrame:
    """Equal neighbouring tokens of two letters at least folded into the first, which takes over the last one's end; rows whose
    token is empty neither repeat nor break a repeat."""
    w = ordered(keys, [order])
    t = df.withColumn("_t", F.when(token != "", token))
    before = F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    again = F.coalesce((F.col("_t") == before) & (F.length("_t") >= 2), F.lit(False))
    marked = t.withColumn("_new", ~again)
    got = islands(marked, F.col("_new") & F.col("_t").isNotNull(), [order], keys, "_g")
    last = Window.partitionBy(*keys, "_g")
    kept = got.withColumn("en", F.when(F.col("_t").isNotNull(), F.max(F.when(F.col("_t").isNotNull(), F.col("en"))).over(last)).otherwise(F.col("en")))
    return kept.filter("_new").drop("_t", "_new", "_g")


def repeats(df: DataFrame, token: str, sizes: list[int], keys: list[str], order: str) -> DataFrame:
    """Rows with n and phrase where the n tokens from here, none of them empty, equal the n after them, for each n of ``sizes``; a repeat that ends
    on the very last token isn't reported. One pass over the ordered rows serves all sizes."""
    w = ordered(keys, [order])
    marked = df.withColumn("_a", F.array(*[F.lead(token, i).over(w) for i in range(2 * max(sizes))])).withColumns({f"_m{n}": F.lead(order, 2 * n).over(w) for n in sizes})

    def hit(n: int) -> Column:
        one = F.slice("_a", 1, n)
        again = (one == F.slice("_a", n + 1, n)) & F.col(f"_m{n}").isNotNull() & ~F.array_contains(one, "")
        return F.when(again, F.struct(F.lit(n).alias("n"), F.array_join(one, " ").alias("phrase")))

    found = marked.withColumn("_h", F.explode(F.array_compact(F.array(*[hit(n) for n in sizes]))))
    return found.select(*df.columns, "_h.n", "_h.phrase")


def filled(df: DataFrame, x: str, keys: list[str], order: str, name: str) -> DataFrame:
    """Nulls filled linearly along ``order``; beyond the first and last value these are held."""
    w = ordered(keys, [order])
    back, fore = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(x).isNotNull(), F.col(order))
    marked = df.withColumns({"_x0": F.last(x, True).over(back), "_x1": F.first(x, True).over(fore), "_t0": F.last(at, True).over(back), "_t1": F.first(at, True).over(fore)})
    line = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * ((F.col(order) - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    return marked.withColumn(name, F.when(F.col(x).isNotNull(), F.col(x)).when(F.col("_x0").isNull(), F.col("_x1")).when(F.col("_x1").isNull(), F.col("_x0")).otherwise(line)).drop("_x0", "_x1", "_t0", "_t1")


def debounced(df: DataFrame, at: str, least: float) -> DataFrame:
    """clip, t: each time that lies more than ``least`` after the last kept one."""

    def step(rows: Iterator) -> Iterator[tuple]:
        last = float("-inf")
        for r in rows:
            if getattr(r, at) - last > least:
                last = getattr(r, at)
                yield (last,)

    return scanned(df, ["clip"], [at, "idx"], step, "clip long, t double")


def anchored(df: DataFrame, at: str, width: float) -> DataFrame:
    """clip, st: starts of windows that open with the first row more than ``width`` after their own first row."""

    def step(rows: Iterator) -> Iterator[tuple]:
        opened = None
        for r in rows:
            if opened is None or getattr(r, at) - opened > width:
                opened = getattr(r, at)
                yield (opened,)

    return scanned(df, ["clip"], [at, "idx"], step, "clip long, st double")


def clusters(df: DataFrame, x: str, near: float) -> DataFrame:
    """clip, total, n: each value joins the first group whose mean is within ``near``, else opens one."""

    def step(rows: Iterator) -> Iterator[tuple]:
        groups: list[list] = []
        for r in rows:
            v = getattr(r, x)
            for g in groups:
                if abs(g[0] / g[1] - v) < near:
                    g[0], g[1] = g[0] + v, g[1] + 1
                    break
            else:
                groups.append([v, 1])
        yield from map(tuple, groups)

    return scanned(df, ["clip"], ["idx"], step, "clip long, total double, n long")


def absorbed(blocks: DataFrame, least: int) -> DataFrame:
    """clip, label, first, last, n: blocks under ``least`` rows go to the block before, blocks of one label then join; each reaches up to the next."""

    def step(rows: Iterator) -> Iterator[tuple]:
        held = None
        for r in rows:
            if held and (r.n < least or held[0] == r.label):
                held = (held[0], held[1], r.last, held[3] + r.n)
                continue
            if held:
                yield held
            held = (r.label, r.first, r.last, r.n)
        yield held

    return scanned(blocks, ["clip"], ["first"], step, "clip long, label string, first long, last long, n long")
