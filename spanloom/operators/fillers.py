"""Filler words and phrases: candidates by neighbouring words and pauses, taken from the left, with bounds that spare the words around them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx

from .intervals import islands
from .scan import scanned

# fixed values: fillers that only open a sentence, phrases, single words, and words that must stand alone; the first that fits
INITIAL = [["and", "so"], ["now"], ["so"]]
PHRASES = [["the", "thing", "is", "is", "that"], ["and", "so", "for", "context"], ["so", "if", "you", "think", "about"], ["for", "me", "personally"], ["for", "example"], ["you", "know"], ["i", "mean"], ["and", "so"]]
SINGLE = ["um", "uh", "uhm", "umm", "uhh", "ugh", "fundamentally", "ah", "ahh", "ahhh", "aha", "oh", "ohh"]
ALONE = ["right", "like", "okay", "ok"]
PAUSE = 0.55  # seconds from which on a gap is cut


def candidates(words: DataFrame, initial: list[list[str]], phrases: list[list[str]], single: list[str], alone: list[str], pause: float = 0.2) -> DataFrame:
    """words (clip, idx, word, st, en) with kind and size (words) of the filler that could begin there, null without one, the ends of the words
    around it (before, after), the word's number (i) and the gap before it."""
    w = Window.partitionBy("clip").orderBy("idx")
    longest = max(map(len, initial + phrases))
    t = words.select("clip", "idx", "word", "st", "en", tx.word_chars("word").alias("t0"))
    ahead = {f"t{i}": F.lead("t0", i).over(w) for i in range(1, longest)}
    near = {f"e{i}": F.lead("en", i).over(w) for i in range(longest)} | {f"s{i}": F.lead("st", i + 1).over(w) for i in range(longest)}
    t = t.withColumns({"i": F.row_number().over(w), "gap": F.col("st") - F.lag("en").over(w), "prior": F.lag("word").over(w), "pe": F.lag("en").over(w), **ahead, **near})
    opens = F.col("gap").isNull() | (F.col("gap") >= pause) | F.rtrim("prior").rlike("[.!?]$")
    after = F.col("s0").isNull() | (F.col("s0") - F.col("en") >= pause)
    apart = F.col("gap").isNull() | (F.col("gap") >= pause) | after | F.rtrim("word").rlike(r"\?$")
    fits = lambda p: reduce(and_, [F.col(f"t{i}") == x for i, x in enumerate(p)])
    rules = [(fits(p) & opens, "initial", len(p)) for p in initial] + [(fits(p), "phrase", len(p)) for p in phrases] + [(F.col("t0").isin(single), "single", 1), (F.col("t0").isin(alone) & apart, "isolated", 1)]
    rule = F.lit(None).cast("int")
    for i, (cond, _, _) in reversed(list(enumerate(rules))):
        rule = F.when(cond, i).otherwise(rule)
    t = t.withColumn("rule", rule)
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("rule"))
    t = t.withColumns({"kind": of([k for _, k, _ in rules]), "size": of([n for _, _, n in rules])})
    last, next_ = F.col("en"), F.col("s0")
    for i in range(1, longest):
        last, next_ = F.when(F.col("size") == i + 1, F.col(f"e{i}")).otherwise(last), F.when(F.col("size") == i + 1, F.col(f"s{i}")).otherwise(next_)
    before = F.coalesce("pe", F.greatest(F.lit(0.0), F.col("st") - 1))
    return t.select("clip", "idx", "i", "gap", "kind", F.col("size").cast("long").alias("size"), "st", last.alias("en"), before.alias("before"), F.coalesce(next_, last + 1).alias("after"))


def taken(found: DataFrame, pause: float | None = None) -> DataFrame:
    """The candidates that are taken from the left, none beginning within another; with ``pause``, among them gaps of so long, as rows of that kind
    from the end of the word before to the start of this one. Other words don't go through the fold."""

    def step(rows: Iterator) -> Iterator[tuple]:
        free = 0
        for r in rows:
            if r.pause:
                yield r.idx, "pause", r.before, r.st, None, None
            if r.kind is not None and r.i >= free:
                free = r.i + r.size
                yield r.idx, r.kind, r.st, r.en, r.before, r.after

    long = F.lit(False) if pause is None else F.coalesce(F.col("gap") >= pause, F.lit(False))
    some = found.withColumn("pause", long).filter("pause or kind is not null").select("clip", "idx", "i", "pause", "kind", "size", "st", "en", "before", "after")
    return scanned(some, ["clip"], ["i"], step, "clip long, idx long, kind string, st double, en double, before double, after double")


def cuts(words: DataFrame, pad_before: float, pad_after: float, **lists) -> DataFrame:
    """clip, st, en, kinds: what to cut, padded short of the neighbouring words, together with long pauses; cuts within 50 ms are one."""
    return cuts_of(taken(candidates(words, **lists), PAUSE), pad_before, pad_after)


def cuts_of(t: DataFrame, pad_before: float, pad_after: float) -> DataFrame:
    """The cuts for what was taken, long pauses included."""
    several = F.col("kind").isin("initial", "phrase")
    lead = F.when(F.col("st") - F.col("before") >= 0.05, F.greatest(F.col("st") - pad_before, F.col("before") + 0.02)).otherwise(F.col("st"))
    tail = F.when(F.col("after") - F.col("en") >= 0.05, F.least(F.col("en") + pad_after, F.col("after") - 0.02)).otherwise(F.col("en"))
    st = F.when(several, lead).otherwise(F.greatest(F.col("st") - pad_before, F.col("before") + 0.005))
    en = F.when(several, tail).otherwise(F.least(F.col("en") + pad_after, F.col("after") - 0.02))
    gap = F.col("kind") == "pause"
    st = F.when(gap, F.round(F.col("st") + 0.075, 3)).otherwise(F.round(F.greatest(F.lit(0.0), st), 3))
    en = F.when(gap, F.round(F.col("en") - 0.075, 3)).otherwise(F.round(en, 3))
    every = t.select("clip", st.alias("st"), en.alias("en"), "kind").filter("kind <> 'pause' or en - st >= 0.1")
    by = Window.partitionBy("clip").orderBy("st", "en", "kind")
    every = every.withColumn("reach", F.max("en").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    runs = islands(every, F.col("reach").isNull() | (F.col("st") - F.col("reach") > 0.05), ["st", "en", "kind"], ["clip"])
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("st", "en", "kind"))), lambda x: x["kind"]), "+")
    return runs.groupBy("clip", "island").agg(F.min("st").alias("st"), F.max("en").alias("en"), kinds.alias("kinds")).drop("island")
