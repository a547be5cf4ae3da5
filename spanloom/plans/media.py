"""Queries over sampled sound and measured frames: offsets, audio and picture checks, hum. Vectors of a label, end to end, stand in for a recording of
a thousand samples a second, events of a user for the frames of a clip."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import signals as sg
from spanloom.sources.tables import WORDS, table, words

from .registry import query

RATE, FPS = 1000, 5.0

SAMPLES = """ranked AS (SELECT label AS clip, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
raw AS (SELECT clip, r * 64 + p AS i, v FROM (SELECT clip, r, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM ranked)),
samples AS (SELECT clip, i, greatest(-1, least(1, v::DOUBLE * CASE WHEN (i // 400) % 8 = 5 OR i < 150 THEN 0.001::DOUBLE WHEN clip = 3 AND (i // 64) % 10 = 4 THEN 40 ELSE 1 + (clip % 3) * 0.4::DOUBLE END + CASE WHEN clip % 3 = 1 THEN 0.1::DOUBLE * sin(2 * pi() * 50 * i / 1000) + 0.05::DOUBLE * sin(2 * pi() * 100 * i / 1000) ELSE 0 END))::DOUBLE AS x FROM raw)"""
LOUD = """sub AS (SELECT clip, i // 5 AS s, sum(x * x) AS e, count(*) AS n FROM samples GROUP BY ALL), fr0 AS (SELECT clip, s, sum(e) OVER w AS e, sum(n) OVER w AS n FROM sub WINDOW w AS (PARTITION BY clip ORDER BY s ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
fr AS (SELECT clip, s // 2 AS f, s * 5 / 1000::DOUBLE AS sec, 10 * log10(e / 25 + 1e-12) AS db FROM fr0 WHERE n = 25 AND s % 2 = 0), top AS (SELECT clip, quantile_cont(db, 0.95) - 20 AS least FROM fr GROUP BY clip),
level AS (SELECT fr.clip, quantile_cont(db, 0.5) AS speech FROM fr JOIN top USING (clip) WHERE db >= least GROUP BY fr.clip), size AS (SELECT clip, count(*) AS n, count(*) / 1000::DOUBLE AS length FROM samples GROUP BY clip),
f AS (SELECT fr.*, speech, length FROM fr JOIN level USING (clip) JOIN size USING (clip))"""


def samples(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("clip"), "embedding").filter("clip is not null and embedding is not null")
    r = F.row_number().over(Window.partitionBy("clip").orderBy("vec_id")) - 1
    raw = e.select("clip", r.alias("r"), "embedding").select("clip", "r", F.posexplode("embedding").alias("p", "v")).select("clip", (F.col("r") * 64 + F.col("p")).cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    i = F.col("i")
    gain = F.when((F.floor(i / 400) % 8 == 5) | (i < 150), 0.001).when((F.col("clip") == 3) & (F.floor(i / 64) % 10 == 4), 40.0).otherwise(1 + (F.col("clip") % 3) * 0.4)
    tone = lambda a, hz: a * F.sin(2 * math.pi * hz * i / 1000)
    hum = F.when(F.col("clip") % 3 == 1, tone(0.1, 50) + tone(0.05, 100)).otherwise(0.0)
    return raw.select("clip", "i", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") * gain + hum)).alias("x"))


def _islands(source: str, hit: str, least: int, name: str) -> str:
    return f"{name} AS (SELECT clip, min(f) AS first, max(f) AS last, min(sec) AS lo, max(sec) AS hi, count(*) AS n FROM (SELECT *, f - row_number() OVER (PARTITION BY clip ORDER BY f) AS g FROM {source} WHERE {hit}) GROUP BY clip, g HAVING count(*) >= {least})"


@query(
    f"""WITH {SAMPLES}, b AS (SELECT a.clip, a.i - (700 + 13 * a.clip) AS i, 0.8::DOUBLE * a.x + 0.05::DOUBLE * cos(a.i) AS x FROM samples a WHERE a.i - (700 + 13 * a.clip) BETWEEN 0 AND 255),
s AS (SELECT clip, count(*) AS n, max(abs(x)) + 1e-9 AS top FROM samples GROUP BY clip), o AS (SELECT clip, count(*) AS m, max(abs(x)) + 1e-9 AS own FROM b GROUP BY clip),
c AS (SELECT a.clip, a.i - b.i AS lag, sum(a.x * b.x) / any_value(top) / any_value(own) AS c, any_value(n - m + 1) AS lags FROM samples a JOIN b ON a.clip = b.clip JOIN s ON s.clip = a.clip JOIN o ON o.clip = a.clip WHERE a.i - b.i BETWEEN 0 AND n - m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY abs(c) DESC, lag) AS place FROM c)
SELECT clip, max(lag) FILTER (place = 1) AS lag, max(c) FILTER (place = 1) AS peak, max(abs(c)) FILTER (place = 1) / (max(abs(c)) FILTER (place = lags // 2 + 1) + 1e-9) AS confidence FROM r GROUP BY clip"""
)
def signal_offset(spark, d):
    """Where a noisy stretch of each recording fits into it, and how sure that is."""
    s = samples(spark, d)
    at = F.col("i") - (700 + 13 * F.col("clip"))
    return sg.offsets(s, s.filter(at.between(0, 255)).select("clip", at.alias("i"), (0.8 * F.col("x") + 0.05 * F.cos("i")).alias("x")))


LAST = "lastw AS (SELECT clip, length(regexp_replace(max_by(word, idx), '^[.,;:!?\"'']+|[.,;:!?\"'']+$', '', 'g')) AS size, max_by((en - st) * 0.35::DOUBLE, idx) AS seconds FROM words GROUP BY clip)"
LIMIT = "CASE WHEN size <= 2 THEN 0.08 WHEN size <= 4 THEN 0.12 ELSE 0.15 END"


@query(
    f"""WITH {WORDS}, {LAST}, {SAMPLES}, {LOUD}, flat AS (SELECT clip, sum(k - 7) AS k FROM (SELECT clip, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS g FROM samples WHERE abs(x) >= 0.999) GROUP BY clip, g HAVING count(*) >= 8) GROUP BY clip),
lw AS (SELECT clip, floor(sec / 0.5) AS w, avg(db) AS db FROM f WHERE db >= speech - 15 AND floor(sec / 0.5) * 0.5 < length - 1 GROUP BY ALL HAVING count(*) >= 10), lm AS (SELECT clip, avg(db) AS mean, count(*) AS k FROM lw GROUP BY clip), off AS (SELECT clip, max(abs(db - mean)) AS off FROM lw JOIN lm USING (clip) WHERE k >= 2 GROUP BY clip),
{_islands('f', 'db >= speech - 12', 6, 'vr')}, ends AS (SELECT s.clip, coalesce(min(lo), any_value(length)) AS onset, greatest(0, any_value(length) - coalesce(max(hi) + 0.025::DOUBLE, 0)) AS tail FROM size s LEFT JOIN vr ON vr.clip = s.clip GROUP BY s.clip),
{_islands('fr', 'db < -35', 3, 'qr')}, splice AS (SELECT q.clip, (last + 1) * 10 AS s FROM qr q JOIN (SELECT clip, max(f) AS l FROM fr GROUP BY clip) m ON m.clip = q.clip WHERE last < l), crest AS (SELECT clip, max(crest) AS crest FROM (SELECT s.clip, s.s, max(abs(x)) / sqrt(avg(x * x) + 1e-12) AS crest FROM splice s JOIN samples a ON a.clip = s.clip AND a.i >= s.s - 25 AND a.i < s.s + 25 GROUP BY ALL) GROUP BY clip),
edge AS (SELECT clip, max(db) - max(speech) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY f DESC) AS r FROM f) WHERE r <= 2 GROUP BY clip), body AS (SELECT * FROM f WHERE sec >= 1.0 AND sec <= length - 1.5), {_islands('body', 'db <= speech - 22', 15, 'gr')},
bed AS (SELECT b.clip, quantile_cont(db, 0.5) AS bed FROM body b JOIN gr ON gr.clip = b.clip AND b.f BETWEEN gr.first AND gr.last GROUP BY b.clip), loud AS (SELECT clip, quantile_cont(db, 0.5) AS voice FROM f WHERE db >= speech - 12 GROUP BY clip)
SELECT s.clip, 'railed' AS check, coalesce(k, 0) / n::DOUBLE AS measure, CASE WHEN coalesce(k, 0) / n::DOUBLE >= 0.002 THEN 'error' WHEN coalesce(k, 0) / n::DOUBLE >= 0.0005 THEN 'warn' ELSE 'pass' END AS level FROM size s LEFT JOIN flat USING (clip)
UNION ALL SELECT s.clip, 'level', off, CASE WHEN off > 6 THEN 'error' WHEN off > 3 THEN 'warn' ELSE 'pass' END FROM size s LEFT JOIN off USING (clip)
UNION ALL SELECT clip, 'open', onset, CASE WHEN onset > 0.25 THEN 'error' WHEN onset > 0.12 THEN 'warn' ELSE 'pass' END FROM ends UNION ALL SELECT clip, 'close', tail, CASE WHEN tail > 0.9 THEN 'error' WHEN tail > 0.5 THEN 'warn' ELSE 'pass' END FROM ends
UNION ALL SELECT s.clip, 'pops', crest, CASE WHEN crest > 4 THEN 'error' ELSE 'pass' END FROM size s LEFT JOIN crest USING (clip)
UNION ALL SELECT e.clip, 'last word', edge, CASE WHEN size > 0 AND seconds > 0 AND seconds < {LIMIT} AND edge >= -9 THEN 'error' ELSE 'pass' END FROM edge e LEFT JOIN lastw USING (clip)
UNION ALL SELECT s.clip, 'bed', voice - bed, CASE WHEN voice - bed < 6 THEN 'error' WHEN voice - bed < 9 THEN 'warn' ELSE 'pass' END FROM size s LEFT JOIN bed USING (clip) LEFT JOIN loud USING (clip)"""
)
def audio_audit(spark, d):
    """Seven checks of each recording: railed samples, level drift, dead air at both ends, pops at splices, a clipped last word, the bed under the voice."""
    size = F.length(F.regexp_replace(F.max_by("word", "idx"), "^[.,;:!?\"']+|[.,;:!?\"']+$", ""))
    last = words(spark, d).groupBy("clip").agg(size.alias("size"), F.max_by((F.col("en") - F.col("st")) * 0.35, "idx").alias("seconds"))
    return sg.audio_checks(samples(spark, d), RATE, last, window=0.5, voiced_frames=10, gap_frames=15, most_crest=4.0)


@query(f"""WITH {SAMPLES}, {LOUD}, st AS (SELECT *, coalesce(last_value(CASE WHEN db >= speech - 12 THEN 1 WHEN db < speech - 18 THEN 0 END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY f), 0) AS state FROM f), held AS (SELECT *, f - row_number() OVER (PARTITION BY clip ORDER BY f) AS g FROM st WHERE state = 1)
SELECT clip, min(sec) AS st, max(sec) + 0.025::DOUBLE AS en FROM held GROUP BY clip, g""")
def voice_spans(spark, d):
    """Spans of voice that open at one level and close at a lower one."""
    return sg.voiced_spans(sg.loudness(samples(spark, d), RATE))


GRID = ", ".join(f"({b}, {b * k})" for b in (50, 60) for k in range(1, 13) if b * k <= 465)


@query(
    f"""WITH {SAMPLES}, w AS (SELECT clip, i // 1000 AS block, i % 1000 AS k, x * (0.5 - 0.5 * cos(2 * pi() * (i % 1000) / 1000)) AS x FROM samples), fb AS (SELECT clip, block FROM w GROUP BY ALL HAVING count(*) = 1000),
one AS (SELECT clip, block, hz, (sum(x * cos(2 * pi() * hz * k / 1000)) ** 2 + sum(x * sin(2 * pi() * hz * k / 1000)) ** 2) / 1e6 AS power FROM w JOIN fb USING (clip, block), (SELECT unnest(range(12, 501)) AS hz) GROUP BY ALL),
psd AS (SELECT * FROM one UNION ALL SELECT clip, -1, hz, avg(power) FROM one GROUP BY ALL), speech AS (SELECT clip, sum(power) AS speech FROM psd WHERE block = -1 AND hz >= 300 GROUP BY clip), grid(base, sec) AS (VALUES {GRID}),
near AS (SELECT clip, block, base, sec, arg_max(hz - sec, (power, sec - hz)) FILTER (abs(hz - sec) <= 3) AS peak, sum(power) FILTER (abs(hz - sec) <= 2) AS band, quantile_cont(power, 0.5) FILTER (abs(hz - sec) BETWEEN 6 AND 35) AS floor FROM psd JOIN grid ON abs(hz - sec) <= 38 GROUP BY ALL),
pr AS (SELECT *, 10 * log10(band / (floor * 5 + 1e-18) + 1e-12) AS prominence FROM near), held AS (SELECT clip, base, sec, avg((prominence >= 6)::INT) AS persistence FROM pr WHERE block >= 0 GROUP BY ALL),
found AS (SELECT p.clip, p.base, p.sec, prominence, persistence, 10 * log10(speech / (band + 1e-18) + 1e-12) AS below FROM pr p JOIN held h ON h.clip = p.clip AND h.base = p.base AND h.sec = p.sec JOIN speech s ON s.clip = p.clip WHERE block = -1 AND peak = 0),
fam AS (SELECT *, sum((prominence >= 8 AND persistence >= 0.7)::INT) OVER (PARTITION BY clip, base) AS family FROM found)
SELECT clip, base, sec AS hz, prominence, persistence, below AS below_speech, CASE WHEN NOT (prominence >= 10 AND persistence >= 0.75 AND (family >= 2 OR (prominence >= 18 AND persistence >= 0.9))) THEN 'pass' WHEN below < 25 THEN 'error' WHEN below < 35 THEN 'warn' ELSE 'pass' END AS level FROM fam"""
)
def mains_hum(spark, d):
    """Harmonics of mains hum on the grid: how far they stand out, how steadily, how far under the speech band, and whether that is too near."""
    return sg.hum(samples(spark, d), RATE)


@query(
    f"""WITH {SAMPLES}, p AS (SELECT clip, 20 * log10(max(abs(x)) + 1e-12) AS p FROM samples GROUP BY clip), st AS (SELECT clip, floor(i / 500) AS w, avg(x * x) AS e FROM samples GROUP BY ALL HAVING avg(x * x) > 1e-7), g AS (SELECT clip, avg(e) / 100 AS least FROM st GROUP BY clip),
r AS (SELECT st.clip, quantile_cont(10 * log10(e), 0.95) - quantile_cont(10 * log10(e), 0.10) AS r FROM st JOIN g USING (clip) WHERE e >= least GROUP BY st.clip)
SELECT clip, 'peak' AS check, p AS measure, CASE WHEN p > -1 THEN 'error' WHEN p > -3 THEN 'warn' WHEN p >= -8 THEN 'pass' WHEN p >= -12 THEN 'warn' ELSE 'error' END AS level FROM p
UNION ALL SELECT clip, 'clipping', p, CASE WHEN p > -0.5 THEN 'error' WHEN p > -1 THEN 'warn' ELSE 'pass' END FROM p UNION ALL SELECT clip, 'range', r, CASE WHEN r < 5 THEN 'warn' ELSE 'pass' END FROM r"""
)
def media_levels(spark, d):
    """Peak against its target, clipping, and loudness range of each recording."""
    return sg.level_checks(samples(spark, d), RATE, window=0.5)


FRAMES = """fr AS (SELECT user_id AS clip, event_id AS e, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS f FROM events),
frames AS (SELECT clip, f, f / 5.0::DOUBLE AS sec, CASE WHEN e % 211 = 0 THEN 2.0::DOUBLE ELSE 40 + v END AS light, CASE WHEN (f // 4) % 13 = 5 THEN 0.1::DOUBLE ELSE 1 + v END AS diff, CASE WHEN clip % 50 = 7 AND e % 101 = 3 THEN 9.5::DOUBLE ELSE (e * 31 % 19 - 9) * 0.3::DOUBLE END AS dx,
CASE WHEN e % 97 = 5 THEN 1.4::DOUBLE WHEN clip % 20 = 3 THEN 0.6::DOUBLE ELSE (e % 7 - 3) * 0.05::DOUBLE END AS dy, e % 10 = 0 AS zoom, CASE WHEN e % 17 = 0 THEN NULL WHEN (f // 12) % 9 = 4 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS cx FROM fr),
seams AS (SELECT clip, sec + 0.05::DOUBLE AS seam, (f // 20) % 2 = 0 AS content FROM frames WHERE f % 20 = 10)"""


def frames(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("e"), F.col("value").alias("v"))
    f = e.withColumn("f", (F.row_number().over(Window.partitionBy("clip").orderBy("e")) - 1).cast("long"))
    e_, k = F.col("e"), F.col("f")
    dx = F.when((F.col("clip") % 50 == 7) & (e_ % 101 == 3), 9.5).otherwise((e_ * 31 % 19 - 9) * 0.3)
    dy = F.when(e_ % 97 == 5, 1.4).when(F.col("clip") % 20 == 3, 0.6).otherwise((e_ % 7 - 3) * 0.05)
    cx = F.when(e_ % 17 == 0, None).when(F.floor(k / 12) % 9 == 4, 0.1).otherwise(0.5)
    return f.select("clip", "f", (k / 5.0).alias("at"), F.when(e_ % 211 == 0, 2.0).otherwise(40 + F.col("v")).alias("light"), F.when(F.floor(k / 4) % 13 == 5, 0.1).otherwise(1 + F.col("v")).alias("diff"), dx.alias("dx"), dy.alias("dy"), (e_ % 10 == 0).alias("zoom"), cx.alias("cx"))


_graded = lambda x: f"CASE {x} WHEN 2 THEN 'error' WHEN 1 THEN 'warn' ELSE 'pass' END"


@query(
    f"""WITH {FRAMES}, c AS (SELECT clip, min(f) AS first, max(f) AS last FROM frames GROUP BY clip), n AS (SELECT *, lag(sec) OVER w AS before, lag(dy) OVER w AS dy0, lead(dy) OVER w AS dy2 FROM frames WINDOW w AS (PARTITION BY clip ORDER BY f)),
inside AS (SELECT n.* FROM n WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seams s WHERE s.clip = n.clip AND s.seam - 0.3::DOUBLE <= n.sec AND s.seam >= n.before - 0.3::DOUBLE)),
still AS (SELECT c.clip, coalesce(quantile_cont(abs(dy), 0.5) > 0.5, false) AS moving FROM c LEFT JOIN inside i ON i.clip = c.clip GROUP BY c.clip),
steps AS (SELECT clip, max(abs(dy)) AS most, max(CASE WHEN ok AND abs(dy) >= 1.2 THEN 2 WHEN ok OR abs(dy) >= 1.2 THEN 1 ELSE 0 END) AS rank FROM (SELECT *, coalesce(abs(dy0 + dy + dy2) >= 0.7::DOUBLE * abs(dy), false) AS ok FROM inside) WHERE abs(dy) >= 0.7 AND NOT zoom GROUP BY clip),
jump AS (SELECT clip, max(dy) AS most FROM (SELECT f.clip, seam, round(abs(sum(dy)), 9) AS dy, bool_or(zoom) AS zoom FROM frames f JOIN seams s ON s.clip = f.clip AND f.sec > seam - 0.3::DOUBLE AND f.sec <= seam + 0.3::DOUBLE WHERE NOT content GROUP BY ALL) WHERE NOT zoom GROUP BY clip),
pan AS (SELECT clip, max(abs(dx)) AS most FROM inside GROUP BY clip), frozen AS (SELECT clip, max(k) AS k FROM (SELECT clip, count(*) AS k FROM (SELECT f.*, f.f - row_number() OVER (PARTITION BY f.clip ORDER BY f.f) AS g FROM frames f JOIN c ON c.clip = f.clip WHERE f.f > first AND diff < 0.4) GROUP BY clip, g HAVING count(*) >= 3) GROUP BY clip),
off AS (SELECT clip, max(s) AS s FROM (SELECT clip, max(sec) - min(sec) AS s FROM (SELECT *, f - row_number() OVER (PARTITION BY clip ORDER BY f) AS g FROM frames WHERE cx < 0.22 OR cx > 0.78) GROUP BY clip, g) GROUP BY clip)
SELECT s.clip, 'shift' AS check, coalesce(most, 0) AS measure, CASE WHEN moving THEN 'pass' ELSE {_graded('rank')} END AS level FROM still s LEFT JOIN steps USING (clip)
UNION ALL SELECT s.clip, 'seam', coalesce(most, 0), CASE WHEN moving THEN 'pass' WHEN most >= 1.5 THEN 'error' WHEN most >= 0.9 THEN 'warn' ELSE 'pass' END FROM still s LEFT JOIN jump USING (clip)
UNION ALL SELECT s.clip, 'pan', coalesce(most, 0), CASE WHEN NOT moving AND most > 8 THEN 'error' ELSE 'pass' END FROM still s LEFT JOIN pan USING (clip)
UNION ALL SELECT c.clip, 'frozen', coalesce(k, 0) / 5.0::DOUBLE, CASE WHEN k > 0 THEN 'error' ELSE 'pass' END FROM c LEFT JOIN frozen USING (clip)
UNION ALL SELECT clip, 'black', count(*) FILTER (light < 5), CASE WHEN count(*) FILTER (light < 5) > 0 THEN 'error' ELSE 'pass' END FROM frames GROUP BY clip
UNION ALL SELECT c.clip, 'off centre', coalesce(s, 0), CASE WHEN s >= 1.5 THEN 'warn' ELSE 'pass' END FROM c LEFT JOIN off USING (clip)
UNION ALL SELECT clip, 'first and last', bad, {_graded('bad')} FROM (SELECT f.clip, max(CASE WHEN light < 5 THEN 2 WHEN cx IS NULL THEN 1 ELSE 0 END) AS bad FROM frames f JOIN c ON c.clip = f.clip WHERE f.f = first OR f.f = last GROUP BY f.clip)"""
)
def visual_audit(spark, d):
    """Seven checks of each clip's frames: steps within shots, jumps across cuts of one take, panning, frozen and black frames, a subject off centre, both ends."""
    f = frames(spark, d)
    seams = f.filter("f % 20 = 10").select("clip", (F.col("at") + 0.05).alias("seam"), (F.floor(F.col("f") / 20) % 2 == 0).alias("content"))
    return sg.picture_checks(f, seams, FPS)
