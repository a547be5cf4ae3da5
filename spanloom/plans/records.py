"""Queries over raw records as readers meet them: inline runs, provider times, log marks, probes, samples, listings, contracts, colours, number words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import timecode as tc
from spanloom.operators.scan import scanned
from spanloom.sources import readers as rd
from spanloom.sources.tables import WORDS, table, words

from .registry import query


@query("SELECT o_orderkey, r.run::BIGINT AS run, r.word, r.bold, r.italic, r.rgb FROM (SELECT o_orderkey, unnest([struct_pack(run := 0, word := 'status ' || o_orderstatus, bold := true, italic := false, rgb := CASE WHEN o_orderkey % 2 = 0 THEN 'FF0000' ELSE '00FF00' END), struct_pack(run := 1, word := 'slanted', bold := false, italic := true, rgb := NULL), struct_pack(run := 2, word := o_orderkey || ' plain', bold := false, italic := false, rgb := NULL)]) AS r FROM orders)")
def inline_runs(spark, d):
    """The inline runs of subtitle lines: words, weight, slant and colour."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    colour = F.when(F.col("o_orderkey") % 2 == 0, "0000FF").otherwise("00FF00")
    raw = F.concat(F.lit(r"{\b1\1c&H00"), colour, F.lit("&}status "), "o_orderstatus", F.lit(r"{\i1}slanted{\r}"), F.col("o_orderkey"), F.lit(" plain"))
    return rd.cue_runs(o.select("o_orderkey", raw.alias("raw"))).select("o_orderkey", F.col("run").cast("long").alias("run"), "word", "bold", "italic", "rgb")


@query("WITH w AS (SELECT user_id, event_id, floor(value * 1000)::BIGINT AS s, floor(value * 1000)::BIGINT + event_id % 900 AS e FROM events) SELECT user_id, count(*) AS n, sum(s / 1000.0::double) AS starts, max(e / 1000.0::double) AS last, CASE WHEN max(e / 1000.0::double) >= 100 - 1 THEN 'FULL' ELSE 'PARTIAL' END AS status FROM w GROUP BY user_id")
def provider_times(spark, d):
    """A provider's words in milliseconds as seconds, and whether they reach the end of the recording."""
    ms = F.floor(F.col("value") * 1000)
    raw = table(spark, d, "events").select("user_id", ms.alias("start"), (ms + F.col("event_id") % 900).alias("end"), F.col("event_type").alias("text"), F.lit(100.0).alias("length"))
    w = rd.provider_words(raw)
    sums = w.groupBy("user_id").agg(F.sum("st").alias("starts"), F.max("en").alias("last"))
    return rd.evidence(w, ["user_id"], "length").join(sums, "user_id").select("user_id", "n", "starts", "last", "status")


LOGS = "logs AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'silence_start: ' || event_id || '.5' WHEN 'click' THEN '[x] silence_end: ' || event_id || '.25 | silence_duration: 1' WHEN 'error' THEN 'n:1 pts_time:' || event_id || ' pos:3' ELSE 'frame' END AS value FROM events)"


def logs(spark, d) -> DataFrame:
    k, t = F.col("event_id"), F.col("event_type")
    line = F.when(t == "view", F.concat(F.lit("silence_start: "), k, F.lit(".5"))).when(t == "click", F.concat(F.lit("[x] silence_end: "), k, F.lit(".25 | silence_duration: 1"))).when(t == "error", F.concat(F.lit("n:1 pts_time:"), k, F.lit(" pos:3"))).otherwise("frame")
    return table(spark, d, "events").select("user_id", "event_id", line.alias("value"))


@query(f"WITH {LOGS}, s AS (SELECT user_id, regexp_extract(value, 'silence_start[:=]\\s*(-?[\\d.]+)', 1)::DOUBLE AS st, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM logs WHERE value LIKE '%silence_start%'), e AS (SELECT user_id, regexp_extract(value, 'silence_end[:=]\\s*(-?[\\d.]+)', 1)::DOUBLE AS en, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM logs WHERE value LIKE '%silence_end%') SELECT s.user_id, st, en FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i")
def paired_marks(spark, d):
    """Start and end marks of a tool's log, paired by their number."""
    return rd.paired_times(logs(spark, d), "silence_start", "silence_end", ["user_id"], "event_id")


@query(f"WITH {LOGS} SELECT user_id, regexp_extract(value, 'pts_time[:=]\\s*(-?[\\d.]+)', 1)::DOUBLE AS t FROM logs WHERE value LIKE '%pts_time%'")
def scene_marks(spark, d):
    """Times of scene changes in a tool's log."""
    return rd.marked_times(logs(spark, d), "pts_time", ["user_id"])


@query("SELECT p_partkey, 16 * p_size AS width, 9 * p_size AS height, round(CASE p_partkey % 3 WHEN 0 THEN 30000 / 1001 WHEN 1 THEN 25.0 END, 3)::DOUBLE AS fps, p_retailprice AS duration, p_partkey % 2 = 0 AS has_audio FROM part")
def probe_fields(spark, d):
    """Typed fields of media probes; a frame rate over zero is none."""
    k = F.col("p_partkey")
    rate = F.when(k % 3 == 0, "30000/1001").when(k % 3 == 1, "25/1").otherwise("0/0")
    audio = F.when(k % 2 == 0, ', {"codec_type": "audio"}').otherwise("")
    body = F.concat(F.lit('{"streams": [{"codec_type": "video", "width": '), F.col("p_size") * 16, F.lit(', "height": '), F.col("p_size") * 9, F.lit(', "r_frame_rate": "'), rate, F.lit('"}'), audio, F.lit('], "format": {"duration": "'), F.col("p_retailprice"), F.lit('"}}'))
    return rd.probe(table(spark, d, "part").select("p_partkey", body.alias("body")))


@query("SELECT vec_id, i::BIGINT AS i, i / 16.0::double AS t, embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(8, 24)) AS i FROM embeddings WHERE embedding IS NOT NULL)")
def sample_window(spark, d):
    """A window of each sample array, by its start and length in seconds."""
    e = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rd.pcm(e, F.col("x"), 16, 0.5, 1.0).select("vec_id", F.col("i").cast("long").alias("i"), "t", "v")


#: Files in folders of folders, some with a contract beside them or above.
FILES = "files AS (SELECT 'r/' || p_brand || '/' || (p_partkey % 5) || '/' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.txt' ELSE '.mp4' END AS path, p_size AS length, p_partkey FROM part), contracts AS (SELECT DISTINCT 'r/' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/' || (p_partkey % 5) END AS dir FROM part WHERE p_partkey % 50 < 2)"


def files(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.when(k % 4 == 0, ".txt").otherwise(".mp4")
    f = table(spark, d, "part").select("p_partkey", F.concat(F.lit("r/"), "p_brand", F.lit("/"), k % 5, F.lit("/"), k, ext).alias("path"), F.col("p_size").alias("length"))
    return f.withColumns({"name": F.element_at(F.split("path", "/"), -1), "ext": F.element_at(F.split("path", r"\."), -1)})


@query(f"WITH {FILES} SELECT p_partkey, CASE WHEN path LIKE '%.txt' THEN 'extension' WHEN length < 5 THEN 'small' WHEN p_partkey % 7 = 0 THEN 'posted' ELSE 'ok' END AS reason FROM files")
def listing_eligibility(spark, d):
    """Why files of a listing are left out: their extension, their size, or that they are posted already."""
    f = files(spark, d)
    return rd.eligible(f, f.filter("p_partkey % 7 = 0").select("name"), ["mp4"], 5).select("p_partkey", "reason")


@query(f"WITH {FILES}, p AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM files) SELECT p.path, coalesce(a.dir, b.dir) || '/contract.json' AS contract FROM p LEFT JOIN contracts a ON a.dir = p.dir LEFT JOIN contracts b ON b.dir = regexp_replace(p.dir, '/[^/]*$', '')")
def contract_lookup(spark, d):
    """The contract next to each file, or the nearest one above it."""
    k = F.col("p_partkey")
    own = F.when(k % 2 == 0, F.concat(F.lit("r/"), "p_brand")).otherwise(F.concat(F.lit("r/"), "p_brand", F.lit("/"), k % 5))
    there = table(spark, d, "part").filter("p_partkey % 50 < 2").select(F.concat(own, F.lit("/contract.json")).alias("path")).distinct().withColumn("name", F.lit("contract.json"))
    return rd.contracts(files(spark, d).select("path"), there, "contract.json")


@query("SELECT c_custkey, printf('%02X%02X%02X', (c_custkey * 7) % 256, (c_custkey * 31) % 256, (c_custkey * 101) % 256) AS rgb FROM customer")
def colour_parse(spark, d):
    """Colours of subtitle styles, written blue first, as red, green and blue."""
    k = F.col("c_custkey")
    hex2 = lambda x: F.lpad(F.hex(x % 256), 2, "0")
    return table(spark, d, "customer").select("c_custkey", tc.rgb(F.concat(F.lit("&H00"), hex2(k * 101), hex2(k * 31), hex2(k * 7), F.lit("&"))).alias("rgb"))


#: Words of which runs are number words: units, tens, hundred, scales.
SPOKEN = f"{WORDS}, nw AS (SELECT clip, idx, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, CASE WHEN idx % 13 IN (1, 2, 3, 4) THEN ['twenty', 'five', 'hundred', 'thousand', 'seven', 'million', 'nine'][(idx * 5 + idx // 13) % 7 + 1] ELSE 'word' END AS w FROM words), nv AS (SELECT *, CASE w WHEN 'twenty' THEN 20 WHEN 'five' THEN 5 WHEN 'seven' THEN 7 WHEN 'nine' THEN 9 END AS v, CASE w WHEN 'thousand' THEN 1000 WHEN 'million' THEN 1000000 END AS s FROM nw)"


@query(
    f"""WITH RECURSIVE {SPOKEN}, r AS (SELECT clip, i, idx, coalesce(v, 0)::BIGINT AS cur, 0::BIGINT AS total, CASE WHEN v IS NOT NULL THEN idx END AS first FROM nv WHERE i = 1 UNION ALL
SELECT clip, i, idx, CASE WHEN v IS NOT NULL THEN coalesce(cur, 0) + v WHEN w = 'hundred' AND first IS NOT NULL AND cur > 0 THEN cur * 100 ELSE 0 END, CASE WHEN first IS NULL THEN 0 WHEN v IS NOT NULL OR (w = 'hundred' AND cur > 0) THEN total WHEN s IS NOT NULL THEN total + cur * s ELSE 0 END, CASE WHEN v IS NOT NULL THEN coalesce(first, idx) WHEN first IS NOT NULL AND ((w = 'hundred' AND cur > 0) OR s IS NOT NULL) THEN first END
FROM (SELECT n.clip, n.i, n.idx, n.v, n.w, n.s, CASE WHEN r.first IS NULL THEN 0 ELSE r.cur END AS cur, CASE WHEN r.first IS NULL THEN 0 ELSE r.total END AS total, r.first FROM r JOIN nv n ON n.clip = r.clip AND n.i = r.i + 1))
SELECT clip, first, max(idx) AS last, max_by(total + cur, idx) AS value FROM r WHERE first IS NOT NULL GROUP BY clip, first"""
)
def number_runs(spark, d):
    """Runs of number words and the numbers they make."""
    i = F.col("idx")
    kinds = F.array(*map(F.lit, ("twenty", "five", "hundred", "thousand", "seven", "million", "nine")))
    w = words(spark, d).select("clip", "idx", F.when((i % 13).between(1, 4), F.get(kinds, ((i * 5 + F.floor(i / 13)) % 7).cast("int"))).otherwise("word").alias("word"))
    return number_word_runs(w)


SCALES = {"thousand": 1000, "million": 10**6, "billion": 10**9}


def number_word_runs(df: DataFrame) -> DataFrame:
    """clip, first, last, value of each run of number words (clip, idx, word): units and tens add up, hundred and scales multiply."""
    from spanloom.functions.numbers import ONES, TENS

    small = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS) if w}

    def step(rows: Iterator) -> Iterator[tuple]:
        first = last = None
        total = cur = 0
        for r in rows:
            word = r.word.lower()
            if word in small:
                first, last, cur = r.idx if first is None else first, r.idx, cur + small[word]
            elif first is not None and word == "hundred" and cur:
                last, cur = r.idx, cur * 100
            elif first is not None and word in SCALES:
                last, total, cur = r.idx, total + cur * SCALES[word], 0
            else:
                if first is not None:
                    yield first, last, total + cur
                first, total, cur = None, 0, 0
        if first is not None:
            yield first, last, total + cur

    return scanned(df, ["clip"], ["idx"], step, "clip long, first long, last long, value long")
