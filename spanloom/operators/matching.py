"""Matching texts: ordered patterns, shingles, tokens, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx

from . import align
from .steps import written


def first_match(x: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that x matches; the last one is the fallback."""
    out = F.lit(patterns[-1][0])
    for name, regex in reversed(patterns[:-1]):
        out = F.when(x.rlike(regex), name).otherwise(out)
    return out


BROADCAST_ROWS = 1_000_000  # keys up to which a counted list is broadcast; beyond, a shuffled join


def few(ids: DataFrame) -> DataFrame:
    """A list of keys, to be broadcast where it is counted to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def source_match(queries: DataFrame, docs: DataFrame, q_id: str, d_id: str, n: int = 8, least: int = 2) -> DataFrame:
    """q_id, the document with most of the query's four shingles, hits.

    Words are hashed once and shingles are hashes of those; documents meet the queried hashes as plain numbers, before any shingle is
    written out. Only the documents that hold one are then matched on the text."""
    w = F.split(tx.plain("text"), " ")
    q = queries.select(q_id, w.alias("w")).filter(F.size("w") >= 2 * n)
    start = lambda k: (1 + F.floor((F.size("w") - n) * k / 5)).cast("int")
    q = q.select(q_id, F.explode(F.array(*[F.slice("w", start(k), n) for k in (1, 2, 3, 4)])).alias("s"))
    hashed = lambda x: F.xxhash64(F.transform(x, lambda y: F.xxhash64(y)))
    wanted = q.select(hashed(F.col("s")).alias("h")).distinct()
    split = docs.filter("text is not null").select(d_id, w.alias("w")).filter(F.size("w") >= n)
    numbers = split.select(d_id, F.transform("w", lambda y: F.xxhash64(y)).alias("wh"))
    each = numbers.select(d_id, F.explode(F.transform(F.sequence(F.lit(1), F.size("wh") - n + 1), lambda i: F.xxhash64(F.slice("wh", i, n)))).alias("h"))
    near = each.join(few(wanted), "h", "left_semi").select(d_id).distinct().persist()  # ids that are counted first and used then
    text = split.join(few(near), d_id, "left_semi").select(d_id, F.explode(F.array_distinct(tx.shingles(F.col("w"), n))).alias("s"))
    hits = q.select(q_id, F.array_join("s", " ").alias("s")).join(text, "s").groupBy(q_id, d_id).agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
    return hits.groupBy(q_id).agg(F.min_by(d_id, F.struct(-F.col("hits"), d_id)).alias(d_id), F.max("hits").alias("hits"))


def similar_by_tokens(df: DataFrame, id_col: str, text_col: str, k: int, least: float = 0.0) -> DataFrame:
    """id, other, sim, rank: the k most similar texts by Jaccard of tokens longer than two letters; newest id on a tie.

    With a least similarity, an exact prefix filter: of a text's n tokens, rarest first, only the first n - ceil(least n) + 1 can hold the
    first that two such texts share, so a common token pairs none but texts that are nearly all common tokens."""
    t = df.select(F.col(id_col).alias("id"), F.array_distinct(F.filter(F.split(tx.plain(text_col), " "), lambda x: F.length(x) > 2)).alias("w")).filter(F.size("w") > 0)
    each = t.select("id", F.size("w").alias("n"), F.explode("w").alias("tok"))
    common = each.groupBy("tok").agg(F.count("*").alias("df"))
    ranked = each.join(common, "tok").groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"]).alias("w"))
    keep = (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int")
    first = ranked.select("id", "n", F.explode(F.slice("w", F.lit(1), F.least(F.size("w"), keep))).alias("tok"))
    a, b = first.alias("a"), first.alias("b")
    size = F.least("a.n", "b.n") >= F.lit(least) * F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.id") < F.col("b.id")) & size).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    own = ranked.select("id", "w")
    sets = pairs.join(own.toDF("x", "xw"), "x").join(own.toDF("y", "yw"), "y")
    both = F.size(F.array_intersect("xw", "yw"))
    sim = sets.select("x", "y", (both / (F.size("xw") + F.size("yw") - both)).alias("sim")).filter((F.col("sim") > 0) & (F.col("sim") >= least))
    either = sim.select(F.col("x").alias("id"), F.col("y").alias("other"), "sim").unionByName(sim.select(F.col("y").alias("id"), F.col("x").alias("other"), "sim"))
    r = either.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), F.desc("other"))).cast("bigint"))
    return r.filter(F.col("rank") <= k).withColumnRenamed("id", id_col)


# fixed values: moods of a track and what each needs of its features, as (feature, from, below); the first that holds
MOODS = [
    ("sad-sparse", [("tempo", None, 95), ("sparse", 1, None), ("minor", 1, None)]),
    ("reflective-calm", [("tempo", None, 95), ("sparse", 1, None)]),
    ("confident-dark", [("tempo", 115, None), ("onsets", 2.3, None), ("minor", 1, None)]),
    ("uplifting-driving", [("tempo", 115, None), ("onsets", 2.3, None)]),
    ("chill-groove", [("percussive", 0.42, None), ("onsets", 1.8, None)]),
    ("warm-bright", [("tempo", 95, None), ("minor", None, 1)]),
    ("warm-melodic", []),
]
SPARSE = {"onsets": 1.4, "energy": 0.025}  # under either, a track is sparse


def by_table(table: list[tuple[str, list[tuple]]], features: dict[str, Column], strict: set[str]) -> Column:
    """The first label of the table whose needs the features meet; lower bounds of the features in ``strict`` must be exceeded."""
    out = F.lit(None).cast("string")
    for label, needs in reversed(table):
        ok = F.lit(True)
        for name, lo, hi in needs:
            x = features[name]
            ok = ok & ((x > lo if name in strict else x >= lo) if lo is not None else F.lit(True)) & (x < hi if hi is not None else F.lit(True))
        out = F.when(ok, label).otherwise(out)
    return out


def mood(tempo: Column, onsets: Column, energy: Column, percussive: Column, minor: Column) -> Column:
    """A coarse mood from a track's features."""
    sparse = ((onsets < SPARSE["onsets"]) | (energy < SPARSE["energy"])).cast("int")
    return by_table(MOODS, {"tempo": tempo, "sparse": sparse, "minor": minor.cast("int"), "onsets": onsets, "percussive": percussive}, {"onsets", "percussive"})


def alignment(turns: DataFrame) -> DataFrame:
    """conv_id, turn, counts of aligned words against the turn before, and the error rate."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = turns.select("conv_id", "turn", tx.plain(before).alias("a"), tx.plain("text").alias("b")).filter("a is not null and b is not null")
    split = lambda c: F.array_remove(F.split(c, " "), "")
    return align.counted(t.select(F.struct("conv_id", "turn").alias("pair"), split("a").alias("a"), split("b").alias("b"))).select("pair.*", "equal", "replaced", "inserted", "deleted", "longest", "ratio", "wer")


def _common(t: Column, h: Column) -> Column:
    """How many letters two words have in common, each as often as in both."""
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.array_remove(F.split(t, ""), "")), F.lit(0), lambda n, c: n + F.least(count(t, c), count(h, c)))


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs of words (t, h) those of which the share of matching characters, by longest blocks, is ``least`` or more.

    Before any is aligned, the letters they have in common, each as often as in both, must reach that share."""
    chars = lambda w: F.array_remove(F.split(w, ""), "")
    near = pairs.filter(2.0 * _common(F.col("t"), F.col("h")) >= least * (F.length("t") + F.length("h")))
    found = align.counted(near.select(F.struct("t", "h").alias("pair"), chars("h").alias("a"), chars("t").alias("b")))
    return found.filter(F.col("ratio") >= least).select("pair.*")


def weighed(rows: DataFrame, keys: list[str], sides: list[str], least: float = 0.8, letters: int = 3) -> DataFrame:
    """keys and, for each of the sides (arrays of words), the share of its words that were heard (array hs); null for a side without words.
    The keys name one row.

    A word takes the first of the words heard that is still free and is the same or, if it has more than ``letters`` letters, alike. Pairs that by their
    letters may be alike are found in their row; alignment sees each pair of words once, and only pairs that are alike go back to their rows."""

    def may(t: Column, h: Column) -> Column:
        size = F.length(t) + F.length(h)
        return F.when((t != h) & (2.0 * F.least(F.length(t), F.length(h)) >= least * size), 2.0 * _common(t, h) >= least * size).otherwise(False)

    none = F.array().cast("array<string>")
    said = F.filter(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in sides])), lambda t: F.length(t) > letters)
    heard = F.array_distinct("hs")
    near = F.flatten(F.transform(said, lambda t: F.transform(F.filter(heard, lambda h: may(t, h)), lambda h: F.struct(t.alias("t"), h.alias("h")))))
    rows = written(rows.select(*keys, *sides, F.coalesce("hs", none).alias("hs")).withColumn("near", near), "votes-near")
    pairs = written(alike(rows.select(F.explode("near").alias("p")).select("p.*").distinct(), least), "votes-alike")
    like = rows.select(*keys, F.explode("near").alias("p")).select(*keys, "p.*").join(few(pairs), ["t", "h"]).groupBy(*keys).agg(F.collect_set(F.concat_ws(" ", "t", "h")).alias("like"))

    def take(s: Column, t: Column) -> Column:
        fits = F.transform(s["free"], lambda h: (h == t) | ((F.length(t) > letters) & F.array_contains(s["like"], F.concat_ws(" ", t, h))))
        at = F.array_position(fits, True).cast("int")
        rest = F.concat(F.slice(s["free"], F.lit(1), at - 1), F.slice(s["free"], at + 1, F.size(s["free"])))
        return F.struct(F.when(at > 0, rest).otherwise(s["free"]).alias("free"), (s["hits"] + (at > 0).cast("int")).alias("hits"), s["like"].alias("like"))

    start = F.struct(F.col("hs").alias("free"), F.lit(0).alias("hits"), F.coalesce("like", none).alias("like"))
    share = lambda c: F.when(F.size(c) > 0, F.round(F.aggregate(c, start, take, lambda s: s["hits"]) / F.size(c), 3))
    return rows.drop("near").join(like, keys, "left").select(*keys, *[share(c).alias(c) for c in sides])


def supported(sides: DataFrame, heard: DataFrame, keys: list[str], least: float = 0.8, letters: int = 3) -> DataFrame:
    """keys, side, support: the share of a side's words (array ts) that were heard (array hs), as ``weighed`` finds it."""
    each = weighed(sides.join(heard, keys, "left"), [*keys, "side"], ["ts"], least, letters)
    return each.filter("ts is not null").withColumnRenamed("ts", "support")
