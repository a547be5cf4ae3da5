"""Finding words and phrases of one text in another: positions, contiguous and greedy sublists, cursors, decision lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scanned


def phrase_starts(words: DataFrame, token: str, phrase: list[str], keys: list[str], order: str) -> DataFrame:
    """The words at which all tokens of a phrase follow one another, with the phrase's last word as struct ``tail``."""
    w = Window.partitionBy(*keys).orderBy(order)
    hit = F.lit(True)
    for i, t in enumerate(phrase):
        hit = hit & (F.lead(token, i).over(w) == t)
    tail = F.lead(F.struct("st", "en"), len(phrase) - 1).over(w)
    return words.withColumns({"_hit": hit, "tail": tail}).filter("_hit").drop("_hit")


def sublist(have: Column, want: Column) -> Column:
    """struct(first, last) of want within have, from 1: its first contiguous run; else from the first of its first item to the last of
    its last one; null where want is empty or can't be anchored."""
    n, m = F.size(have), F.size(want)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - m + 1)), lambda i: F.slice(have, i, m) == want)
    lead, tail = F.array_position(have, F.get(want, F.lit(0))), F.array_position(F.reverse(have), F.get(want, m - 1))
    run = F.struct(F.get(at, F.lit(0)).cast("int").alias("first"), (F.get(at, F.lit(0)) + m - 1).cast("int").alias("last"))
    ends = F.struct(lead.cast("int").alias("first"), (n - tail + 1).cast("int").alias("last"))
    return F.when(m == 0, None).when(F.size(at) > 0, run).when((lead > 0) & (tail > 0), ends)


def kept(have: pd.Series, want: pd.Series) -> pd.Series:
    """Masks: the words that match want's tokens one after another, from the left; none where fewer than 60 % of these match."""

    def mask(words: list[str], tokens: list[str]) -> list[bool] | None:
        out, t = [], 0
        for w in words:
            out.append(t < len(tokens) and w == tokens[t])
            t += out[-1]
        return out if not tokens or t / len(tokens) >= 0.6 else None

    return pd.Series([mask(list(h), list(w)) for h, w in zip(have, want)], dtype=object)


def kept_mask(have: Column, want: Column) -> Column:
    return F.pandas_udf(kept, "array<boolean>")(have, want)


def followed(words: DataFrame, tokens: DataFrame, keys: list[str], ahead: int = 5) -> DataFrame:
    """keys, idx, mark: the mark of the token that each word meets. A cursor over the tokens (order, token, mark) moves behind the
    first equal one within the next ``ahead``, else it stays."""
    columns = [*keys, "kind", "idx", "token", "mark"]
    both = tokens.withColumn("kind", F.lit(0)).select(columns).unionByName(words.withColumns({"kind": F.lit(1), "mark": F.lit(None).cast("string")}).select(columns))

    def step(rows: Iterator) -> Iterator[tuple]:
        held, at = [], 0
        for r in rows:
            if r.kind == 0:
                held.append((r.token, r.mark))
                continue
            for i in range(at, min(at + ahead, len(held))):
                if held[i][0] == r.token:
                    at = i + 1
                    yield r.idx, held[i][1]
                    break
            else:
                yield r.idx, None

    kinds = ", ".join(f"{k} long" for k in keys)
    return scanned(both, keys, ["kind", "idx"], step, f"{kinds}, idx long, mark string")


def decisions(replies: DataFrame, key: str, text: str, total: str) -> DataFrame:
    """key, i, action, kept_text: the last decision line ``[i] KEEP|REMOVE|TRIM: text`` for each i below total, fences aside; without one,
    or with a trim to nothing, it is to keep."""
    line = F.trim(F.col("line"))
    pattern = r"(?i)^\[(\d+)\]\s+(KEEP|REMOVE|TRIM)(?:\s*:\s*(.*))?$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    lines = replies.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line")).filter(line.rlike(pattern))
    said = lines.select(key, part(1).cast("long").alias("i"), F.struct("pos", F.lower(part(2)).alias("action"), F.trim(part(3)).alias("rest")).alias("d"))
    last = said.groupBy(key, "i").agg(F.max_by("d", "d.pos").alias("d"))
    every = replies.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1)).alias("i"))
    empty = (F.col("d.action") == "trim") & (F.col("d.rest") == "")
    action = F.when(F.col("d").isNull() | empty, "keep").otherwise(F.col("d.action"))
    return every.join(last, [key, "i"], "left").select(key, "i", action.alias("action"), F.when(~empty & (F.col("d.rest") != ""), F.col("d.rest")).alias("kept_text"))


def reply_object(text: Column) -> Column:
    """The JSON object of a reply: without code fences, from the first brace to the last."""
    return F.regexp_extract(F.replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), F.lit("```"), F.lit("")), r"(?s)(\{.*\})", 1)
