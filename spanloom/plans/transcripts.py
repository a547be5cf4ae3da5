"""A subtitle round trip: turns as cues, written as SubRip text and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.sources.sinks import report, srt_blocks
from spanloom.sources.tables import WORDS, table, words

from .registry import query


@query(f"WITH {WORDS}, c AS (SELECT clip, turn, min(st) AS st, max(en) AS en, count(*) AS n FROM words GROUP BY ALL) SELECT clip, count(*) AS cues, md5(string_agg(i || chr(10) || n || ' words' || chr(10), chr(10) ORDER BY i)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY st, en, n || ' words') AS i FROM c) GROUP BY clip")
def srt_render(spark, d):
    """Cues of each clip rendered as SubRip blocks; the digest is of the text without its time lines."""
    c = words(spark, d).groupBy("clip", "turn").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.concat(F.count("*").cast("string"), F.lit(" words")).alias("text"))
    b = srt_blocks(c, ["clip"])
    return b.select("clip", F.size(F.regexp_extract_all("body", F.lit("-->"), F.lit(0))).cast("bigint").alias("cues"), F.md5(F.regexp_replace("body", r"[\d:,]+ --> [\d:,]+\n", "").cast("binary")).alias("digest"))


@query("SELECT source, count(*) FILTER (s = 'pass') AS passed, count(*) FILTER (s = 'warn') AS warned, count(*) FILTER (s = 'fail') AS failed, CASE WHEN count(*) FILTER (s = 'fail') > 0 THEN 'REVISE' ELSE 'APPROVE' END AS verdict, length(string_agg('- ' || s || ': ' || n_chars, chr(10))) AS size FROM (SELECT source, n_chars, CASE WHEN n_chars > 5000 THEN 'fail' WHEN n_chars < 200 THEN 'warn' ELSE 'pass' END AS s FROM documents) GROUP BY source")
def audit_report(spark, d):
    s = F.when(F.col("n_chars") > 5000, "fail").when(F.col("n_chars") < 200, "warn").otherwise("pass")
    c = table(spark, d, "documents").select("source", s.alias("s"), F.col("n_chars").cast("string").alias("n"))
    return report(c, "source", "s", "n").select("source", "passed", "warned", "failed", "verdict", F.length("body").cast("bigint").alias("size"))
