"""Keyed operators on whole tables: summaries, dimension lookups, centroids, top rows of a key, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency_summary(df: DataFrame, key: str, value: str, failed: str, parts: int = 64) -> DataFrame:
    """key, n, total, mean, p50, p95 (the sorted value at floor(0.95 n)), fail_pct; exact, also where a few keys hold all rows.

    Rows are counted by (key, value) before anything is ordered. The places of the middle and of p95 are then found among the counts of each key's
    ``parts`` ranges of values, and within the ranges they fall in; ranges lie evenly between a key's least and largest value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"), F.count_if(failed).alias("f"))
    whole = counts.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col(value) * F.col("c")).alias("total"), F.sum("f").alias("f"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    part = F.least(F.lit(parts - 1), F.floor((F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * parts))
    placed = counts.join(whole.select(key, "lo", "hi", "n"), key).withColumn("part", part)
    sizes = placed.groupBy(key, "part").agg(F.sum("c").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select(key, "part", before.alias("before"))
    upto = F.sum("c").over(Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(ranges, [key, "part"]).withColumn("upto", F.col("before") + upto)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    n = F.col("n")
    got = ranked.groupBy(key).agg(at(F.floor((n - 1) / 2)).alias("m0"), at(F.floor(n / 2)).alias("m1"), at(F.floor(n * 0.95)).alias("p95"))
    return whole.join(got, key).select(key, "n", "total", (F.col("total") / n).alias("mean"), ((F.col("m0") + F.col("m1")) / 2).alias("p50"), "p95", (100.0 * F.col("f") / n).alias("fail_pct"))


def with_dimension(df: DataFrame, key: str, values: dict[str, float], name: str, default: float = 1.0) -> DataFrame:
    """df with the value of its lower-cased key; a map literal, as the dimension is a small fixed one."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(m, F.lower(key)), F.lit(default)))


def centroid_distance(df: DataFrame, id_col: str, label: str, vec: str, scale: float) -> DataFrame:
    """Distance of each vector to its label's mean, each component divided by a fixed scale.

    Means are aggregated per label and component, then packed to one array a label, a table of labels' size."""
    each = df.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    mean = each.groupBy(label, "i").agg(F.avg("x").alias("m"))
    packed = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    off = F.zip_with(F.col(vec).cast("array<double>"), "centre", lambda a, b: F.pow((a - b) / scale, F.lit(2.0)))
    return df.select(id_col, label, vec).join(packed, label).select(id_col, label, F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, x: a + x)).alias("distance"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, ranked from 1; Spark cuts each partition to k rows a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same keys."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)
