"""Interval algebra over rows (clip, idx, st, en): joins on overlap, merging, complement, as-of and nearest lookups.

Overlap joins are equi-joins on (clip, time bucket) with the exact predicate as residual, so they plan as hash or sort-merge joins
and AQE can split a clip that holds many rows; a pair counts only in the bucket where its later start lies, so none is doubled.
As-of lookups are one union, one shuffle by clip and a running last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(df: DataFrame, width: float, st: str | Column = "st", en: str | Column = "en") -> DataFrame:
    """A row for each bucket of ``width`` seconds that an interval touches."""
    st, en = (F.col(x) if isinstance(x, str) else x for x in (st, en))
    lo = F.floor(st / width)
    return df.withColumn("bucket", F.explode(F.sequence(lo, F.greatest(lo, F.floor(en / width)))))


def overlap_pairs(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """All pairs of rows of one clip that overlap by more than a point; columns a_* and b_* beside clip."""
    left = bucketed(a, width).select("clip", "bucket", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "clip"])
    right = bucketed(b, width).select("clip", "bucket", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "clip"])
    pairs = left.join(right, ["clip", "bucket"]).filter((F.col("a_st") < F.col("b_en")) & (F.col("b_st") < F.col("a_en")))
    return pairs.filter(F.col("bucket") == F.floor(F.greatest("a_st", "b_st") / width)).drop("bucket")


def intersect(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """clip, a_idx, b_idx, st, en: the common part of every overlapping pair."""
    return overlap_pairs(a, b, width).select("clip", "a_idx", "b_idx", F.greatest("a_st", "b_st").alias("st"), F.least("a_en", "b_en").alias("en"))


def self_overlaps(df: DataFrame, width: float, more_than: float) -> DataFrame:
    """Pairs i < j of a clip whose overlap is longer than ``more_than``."""
    length = F.least("a_en", "b_en") - F.greatest("a_st", "b_st")
    return overlap_pairs(df, df, width).filter("a_idx < b_idx").select("clip", "a_idx", "b_idx", length.alias("overlap")).filter(F.col("overlap") > more_than)


def islands(df: DataFrame, new: Column, order: list, keys: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of rows within keys; ``new`` holds where a run begins."""
    return df.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merge_close(df: DataFrame, tol: float) -> DataFrame:
    """Intervals of a clip merged where the next starts within ``tol`` of the end so far (a running maximum, for nested ones)."""
    w = Window.partitionBy("clip").orderBy("st", "en", "idx")
    reach = F.max("en").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("reach", reach)
    runs = islands(marked, F.col("reach").isNull() | (F.col("st") - F.col("reach") > tol), ["st", "en", "idx"], ["clip"])
    return runs.groupBy("clip", "island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("n")).drop("island")


def complement(df: DataFrame, scope: DataFrame, least: float) -> DataFrame:
    """What of each clip's scope (clip, lo, hi) no interval covers, in parts longer than ``least``. An interval of no length parts what it lies in."""
    inside = df.join(scope, "clip").select("clip", "idx", F.greatest("st", "lo").alias("st"), F.least("en", "hi").alias("en")).filter("st <= en")
    cover = merge_close(inside, 0.0).select("clip", "st", "en")
    edges = scope.select("clip", F.col("lo").alias("st"), F.col("lo").alias("en")).unionByName(scope.select("clip", F.col("hi").alias("st"), F.col("hi").alias("en")))
    w = Window.partitionBy("clip").orderBy("st", "en")
    return cover.unionByName(edges).select("clip", F.col("en").alias("st"), F.lead("st").over(w).alias("en")).filter(F.col("en") - F.col("st") > least)


def uncovered(points: DataFrame, cues: DataFrame, widen: float, width: float) -> DataFrame:
    """Points (t) that lie in no cue widened by ``widen`` on both sides, bounds included."""
    wide = bucketed(cues.select(F.col("clip"), (F.col("st") - widen).alias("lo"), (F.col("en") + widen).alias("hi")), width, "lo", "hi")
    p, c = points.withColumn("bucket", F.floor(F.col("t") / width)).alias("p"), wide.alias("c")
    on = (F.col("p.clip") == F.col("c.clip")) & (F.col("p.bucket") == F.col("c.bucket")) & (F.col("p.t") >= F.col("c.lo")) & (F.col("p.t") <= F.col("c.hi"))
    return p.join(c, on, "left_anti").drop("bucket")


def with_contained(gaps: DataFrame, inner: DataFrame, slack: float, width: float) -> DataFrame:
    """Gaps that hold at least one whole inner interval, give or take ``slack``."""
    wide = gaps.select("*", (F.col("st") - slack).alias("lo"), (F.col("en") + slack).alias("hi"))
    key = bucketed(wide, width, "lo", "hi").alias("g")
    small = inner.select("clip", F.col("st").alias("ist"), F.col("en").alias("ien"), F.floor(F.col("st") / width).alias("bucket")).alias("i")
    on = (F.col("g.clip") == F.col("i.clip")) & (F.col("g.bucket") == F.col("i.bucket")) & (F.col("i.ist") >= F.col("g.lo")) & (F.col("i.ien") <= F.col("g.hi"))
    return key.join(small, on, "left_semi").select(*gaps.columns).distinct()


def asof(left: DataFrame, right: DataFrame, at: str, value: list[str], forward: bool = False, tie: str = "idx", prefix: str = "r_") -> DataFrame:
    """left with the columns ``value`` of the last right row of the clip whose ``at`` is <= left's t (forward: the first whose ``at`` is >= t)."""
    pack = F.struct(F.col(at), *[F.col(c) for c in value if c != at])
    both = left.select("clip", F.col("t"), F.lit(0).alias("is_right"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(pack).schema[0].dataType).alias("r"), F.lit(None).cast("long").alias("tie"))
    other = right.select("clip", F.col(at).alias("t"), F.lit(1).alias("is_right"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("l"), pack.alias("r"), F.col(tie).cast("long").alias("tie"))
    w = Window.partitionBy("clip")
    w = w.orderBy(F.desc("t"), F.desc("is_right"), F.desc("tie")) if forward else w.orderBy("t", F.desc("is_right"), "tie")
    found = both.unionByName(other).withColumn("hit", F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("is_right = 0")
    return found.select("l.*", F.col(f"hit.{at}").alias(f"{prefix}{at}"), *[F.col(f"hit.{c}").alias(prefix + c) for c in value if c != at])


def nearest(left: DataFrame, right: DataFrame, at: str, tol: float) -> DataFrame:
    """left with near: the value of right's ``at`` closest to t within ``tol``; the earlier one on a tie."""
    back = asof(left, right, at, [at], prefix="b_")
    both = asof(back, right, at, [at], forward=True, prefix="f_")
    db, df = F.col("t") - F.col(f"b_{at}"), F.col(f"f_{at}") - F.col("t")
    best = F.when(df.isNull() | (db <= df), F.col(f"b_{at}")).otherwise(F.col(f"f_{at}"))
    return both.withColumn("near", F.when(F.abs(best - F.col("t")) <= tol, best)).drop(f"b_{at}", f"f_{at}")


def containing(points: DataFrame, spans: DataFrame, width: float, closed: bool = False) -> DataFrame:
    """points with the label of the first span (by idx) that holds t; null where none does. Half-open spans unless closed."""
    key = bucketed(spans.select("clip", F.col("idx").alias("s_idx"), F.col("st").alias("s_st"), F.col("en").alias("s_en"), F.col("label").alias("s_label")), width, "s_st", "s_en").alias("s")
    p = points.withColumn("bucket", F.floor(F.col("t") / width)).alias("p")
    upper = (F.col("p.t") <= F.col("s.s_en")) if closed else (F.col("p.t") < F.col("s.s_en"))
    on = (F.col("p.clip") == F.col("s.clip")) & (F.col("p.bucket") == F.col("s.bucket")) & (F.col("p.t") >= F.col("s.s_st")) & upper
    hit = p.join(key, on).groupBy("p.clip", F.col("p.idx").alias("idx")).agg(F.min_by("s.s_label", "s.s_idx").alias("label"))
    return points.join(hit, ["clip", "idx"], "left")


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 where two intervals touch or overlap, else the distance between them."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)
