"""The records the operators work on, read from the star-schema tables that stand in for them.

spans: clip, idx, st, en (seconds), label, value — timed events of a clip. words: clip, idx, turn, speaker, word, st, en — a timed
transcript. Both select their columns before anything else, so scans read no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000  # 2024-01-01 UTC
SHARE = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str, before: float | None = None) -> DataFrame:
    """Spans, or only those that start before a second, a bound that reaches the scan."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    if before is not None:
        ev = ev.filter(F.col("ts") < F.timestamp_micros(F.lit(EPOCH_US + int(before * 1e6))).cast(ev.schema["ts"].dataType))
    st = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1e6)
    return ev.select(F.col("user_id").alias("clip"), F.col("event_id").alias("idx"), st.alias("st"), (st + F.col("value") * 60).alias("en"), F.col("event_type").alias("label"), "value")


SPANS = f"spans AS (SELECT user_id AS clip, event_id AS idx, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS st, (epoch_us(ts) - {EPOCH_US}) / 1e6 + value * 60 AS en, event_type AS label, value FROM events)"


def shares(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the words of all conversations, with about ``SHARE`` characters each."""
    chars = table(spark, sf_dir, "conversations").agg(F.sum(F.length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-chars // SHARE))


def words(spark: SparkSession, sf_dir: str, together: int | None = None) -> DataFrame:
    """Words of a conversation, timed evenly with a longer pause after each ninth. together: turns are dealt out by conversation first, to so many
    partitions; what goes by clip then shuffles no words, which take many times the room of their texts."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    if together:
        conv = conv.repartition(together, "conv_id")
    w = conv.select("conv_id", "turn", "role", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word")).filter("word <> ''")
    n = F.length("word")
    st = F.col("turn") * 1200.0 + F.col("pos") * 0.6 + F.floor(F.col("pos") / 9) * 0.7 - (n % 3) * 0.1
    w = w.withColumn("st", st).withColumn("en", F.col("st") + 0.2 + n * 0.03)
    return w.select(F.col("conv_id").alias("clip"), (F.col("turn") * 10000 + F.col("pos")).cast("long").alias("idx"), "turn", F.col("role").alias("speaker"), "word", "st", "en")


WORDS = r"""words0 AS (SELECT conv_id, turn, role, unnest(string_split_regex(trim(text), '\s+')) AS word, unnest(range(len(string_split_regex(trim(text), '\s+')))) AS pos FROM conversations),
words1 AS (SELECT *, turn * 1200.0::double + pos * 0.6::double + floor(pos / 9) * 0.7::double - (length(word) % 3) * 0.1::double AS st FROM words0 WHERE word <> ''),
words AS (SELECT conv_id AS clip, (turn * 10000 + pos)::bigint AS idx, turn, role AS speaker, word, st, st + 0.2::double + length(word) * 0.03::double AS en FROM words1)"""
