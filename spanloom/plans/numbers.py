"""Queries on numbers in text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import numbers as nb
from spanloom.sources.tables import WORDS, table, words

from .registry import query

ONES_SQL = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
TENS_SQL = "['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"
#: The words of every number under a hundred.
SMALL = f"small AS (SELECT n, CASE WHEN n < 20 THEN {ONES_SQL}[n + 1] WHEN n % 10 = 0 THEN {TENS_SQL}[n // 10 + 1] ELSE {TENS_SQL}[n // 10 + 1] || ' ' || {ONES_SQL}[n % 10 + 1] END AS w FROM (SELECT unnest(range(100)) AS n)), mid AS (SELECT h * 100 + s.n AS n, CASE WHEN h = 0 THEN s.w WHEN s.n = 0 THEN {ONES_SQL}[h + 1] || ' hundred' ELSE {ONES_SQL}[h + 1] || ' hundred and ' || s.w END AS w FROM (SELECT unnest(range(10)) AS h), small s)"


@query(
    f"WITH {SMALL}, o AS (SELECT o_orderkey, (o_orderkey * 37) % 1000000 AS n, 1880 + o_orderkey % 260 AS y FROM orders) SELECT o_orderkey, CASE WHEN o.n < 1000 THEN a.w WHEN o.n % 1000 = 0 THEN b.w || ' thousand' WHEN o.n % 1000 < 100 THEN b.w || ' thousand and ' || a.w ELSE b.w || ' thousand ' || a.w END AS spelled,"
    " CASE WHEN y BETWEEN 1900 AND 2099 AND y NOT BETWEEN 2000 AND 2009 THEN CASE WHEN y % 100 = 0 THEN h.w || ' hundred' WHEN y % 100 < 10 THEN h.w || ' oh ' || l.w ELSE h.w || ' ' || l.w END WHEN y % 1000 = 0 THEN t.w || ' thousand' WHEN y % 1000 < 100 THEN t.w || ' thousand and ' || l.w ELSE t.w || ' thousand ' || r.w END AS year"
    " FROM o JOIN mid a ON a.n = o.n % 1000 JOIN mid b ON b.n = o.n // 1000 JOIN mid h ON h.n = y // 100 JOIN mid l ON l.n = y % 100 JOIN mid t ON t.n = y // 1000 JOIN mid r ON r.n = y % 1000"
)
def number_spelling(spark, d):
    """Numbers in words, and years as they are said."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", nb.spelled((k * 37) % 1000000).alias("spelled"), nb.spelled_year(1880 + k % 260).alias("year"))


#: Words of which some are numbers, units, or announce a number.
MIXED = f"{WORDS}, mx AS (SELECT clip, idx, CASE WHEN idx % 17 = 3 THEN (idx % 90)::varchar WHEN idx % 17 = 4 THEN ['percent', 'times.', 'million', 'thing'][idx % 4 + 1] WHEN idx % 17 = 2 AND idx % 5 = 0 THEN 'number' ELSE word END AS word FROM words)"


@query(
    f"""WITH {MIXED}, l AS (SELECT *, lead(word) OVER (PARTITION BY clip ORDER BY idx) AS nx FROM mx), f AS (SELECT *, regexp_extract(nx, '[.,!?]+$') AS tail, lower(regexp_replace(nx, '[.,!?]+$', '')) AS unit FROM l),
g AS (SELECT clip, idx, word, CASE WHEN regexp_matches(word, '^\\d+$') THEN CASE unit WHEN 'percent' THEN word || '%' || tail WHEN 'times' THEN word || 'X' || tail WHEN 'million' THEN '$' || word || 'M' || tail END WHEN lower(word) = 'number' AND regexp_matches(unit, '^\\d+$') THEN '#' || nx END AS pair FROM f),
h AS (SELECT *, lag(pair) OVER (PARTITION BY clip ORDER BY idx) AS before, lag(pair, 2) OVER (PARTITION BY clip ORDER BY idx) AS before2 FROM g) SELECT clip, idx, coalesce(pair, word) AS word FROM h WHERE before IS NULL OR (before2 IS NOT NULL AND pair IS NULL)"""
)
def number_folding(spark, d):
    """Numbers folded with their units from the left: percent, times, money, and announced ones; a token serves once."""
    i = F.col("idx")
    unit = F.get(F.array(*map(F.lit, ("percent", "times.", "million", "thing"))), (i % 4).cast("int"))
    word = F.when(i % 17 == 3, (i % 90).cast("string")).when(i % 17 == 4, unit).when((i % 17 == 2) & (i % 5 == 0), "number").otherwise(F.col("word"))
    w = Window.partitionBy("clip").orderBy("idx")
    m = words(spark, d).select("clip", "idx", word.alias("word"))
    m = m.withColumn("pair", nb.folded(F.col("word"), F.lead("word").over(w)))
    m = m.withColumns({"before": F.lag("pair").over(w), "before2": F.lag("pair", 2).over(w)})
    # a pair that begins within a taken one falls away, and its second word stays
    return m.filter("before is null or (before2 is not null and pair is null)").select("clip", "idx", F.coalesce("pair", "word").alias("word"))


@query(
    rf"""WITH {WORDS}, q AS (SELECT clip, idx, CASE WHEN idx % 7 = 0 THEN '("' || word || '")' WHEN idx % 11 = 0 THEN '$' || idx || 'K,' WHEN idx % 13 = 0 THEN idx || '%' ELSE word END AS t FROM words), p AS (SELECT *, regexp_extract(t, '^([(\[\"''“‘]*)(.*?)([)\]\"''”’.,!?;:]*)$', ['lead', 'core', 'trail']) AS x FROM q)
SELECT clip, idx, x.lead AS lead, x.core AS core, x.trail AS trail, regexp_matches(x.core, '^(\$[\d,]+(\.\d+)?[KMB]?|[\d,]+(\.\d+)?%|\d{{1,3}}(,\d{{3}})+|\d+(st|nd|rd|th)|#\d+|\d+(\.\d+)?[KMBX])$') AS formatted FROM p"""
)
def token_parts(spark, d):
    """A token's punctuation in front and behind, and whether it is a figure already."""
    i = F.col("idx")
    t = F.when(i % 7 == 0, F.concat(F.lit('("'), "word", F.lit('")'))).when(i % 11 == 0, F.concat(F.lit("$"), i, F.lit("K,"))).when(i % 13 == 0, F.concat(i, F.lit("%"))).otherwise(F.col("word"))
    p = words(spark, d).select("clip", "idx", nb.peeled(t).alias("x"))
    return p.select("clip", "idx", "x.lead", "x.core", "x.trail", nb.formatted(F.col("x.core")).alias("formatted"))
