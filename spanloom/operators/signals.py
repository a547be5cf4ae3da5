"""Sampled signals and frame measurements as tables: offsets by correlation, loudness frames, audio and picture checks, hum.

samples: clip, i (from 0, without holes), x (-1 to 1). frames of sound: clip, f, at (seconds), db. frames of picture: clip, f, at, light, diff (to the
frame before), dx, dy (shift to the frame before in percent), zoom, cx (centre of the face or null). Sums over samples are grouped by
(clip, block), so a long recording is many groups; only frames, a hundredth as many, are ordered clip by clip.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

# fixed values: limits of the checks
RAIL, RAIL_RUN, RAIL_WARN, RAIL_ERROR = 0.999, 8, 0.0005, 0.002
OPEN_WARN, OPEN_ERROR, CLOSE_WARN, CLOSE_ERROR = 0.12, 0.25, 0.50, 0.90
LEVEL_WARN, LEVEL_ERROR = 3.0, 6.0
BED_ERROR, BED_WARN = 6.0, 9.0
HOT_EDGE, CREST = 9.0, 20.0
VOICED, SUSTAINED = 12.0, 6
HUM = {"prominence": 10.0, "persistence": 0.75, "family_prominence": 8.0, "family_persistence": 0.7, "solo_prominence": 18.0, "solo_persistence": 0.9, "error": 25.0, "warn": 35.0}
SEAM_NEAR, SEAM_WARN, SEAM_ERROR, SHIFT_WARN, SHIFT_ERROR = 0.30, 0.9, 1.5, 0.7, 1.2
MOVING, PAN, FROZEN, FROZEN_RUN, BLACK = 0.5, 8.0, 0.4, 3, 5.0
OFF_CENTRE, OFF_SECONDS = (0.22, 0.78), 1.5

BLOCK = 64  # samples of a block of a correlation
BLOCKS = 256  # blocks of a second transformed at a time


def _by(order: str, *keys: str):
    return Window.partitionBy(*(keys or ("clip",))).orderBy(order)


def _blocks(samples: DataFrame, name: str) -> DataFrame:
    """clip, block, and its samples as an array, zeros where it isn't full."""
    at = F.array_sort(F.collect_list(F.struct((F.col("i") % BLOCK).alias("k"), "x")))
    held = samples.groupBy("clip", F.floor(F.col("i") / BLOCK).alias(f"{name}b")).agg(F.map_from_entries(at).alias("m"))
    return held.select("clip", f"{name}b", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: F.coalesce(F.element_at("m", k.cast("long")), F.lit(0.0))).alias(name))


def offsets(scan: DataFrame, probe: DataFrame) -> DataFrame:
    """clip, lag (where in scan the probe fits best), peak (correlation there), confidence (to the median of all lags).

    Correlations at all lags at which the probe lies within the scan. Both are cut into blocks; a pair of blocks adds to the lags it can
    see, and these partial sums are added up, so work is dealt by (clip, block of scan, block of probe)."""
    size = scan.groupBy("clip").agg(F.count("*").alias("n"), (F.max(F.abs("x")) + 1e-9).alias("top"))
    own = probe.groupBy("clip").agg(F.count("*").alias("m"), (F.max(F.abs("x")) + 1e-9).alias("own"))
    d = F.explode(F.sequence(F.lit(1 - BLOCK), F.lit(BLOCK - 1))).alias("d")
    pairs = _blocks(scan, "a").join(_blocks(probe, "b"), "clip").filter("ab >= bb - 1").select("clip", (F.col("ab") - F.col("bb")).alias("k"), "a", "b", d)
    lo, n = F.greatest(F.lit(0), -F.col("d")), F.lit(BLOCK) - F.abs("d")  # b[lo : lo + n] stands against a[lo + d : lo + d + n]
    part = F.aggregate(F.zip_with(F.slice("a", lo + F.col("d") + 1, n), F.slice("b", lo + 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sums = pairs.groupBy("clip", (F.col("k") * BLOCK + F.col("d")).alias("lag")).agg(F.sum(part).alias("sum"))
    sums = sums.join(size, "clip").join(own, "clip").filter("lag between 0 and n - m").select("clip", "lag", (F.col("sum") / F.col("top") / F.col("own")).alias("c"), (F.col("n") - F.col("m") + 1).alias("lags"))
    place = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("size"), "lag"))
    ranked = sums.withColumn("size", F.abs("c")).withColumn("place", place).filter("place = 1 or place = floor(lags / 2) + 1")
    best = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    middle = F.max(F.when(F.col("place") == F.floor(F.col("lags") / 2) + 1, F.col("size")))
    return ranked.groupBy("clip").agg(best("lag").alias("lag"), best("c").alias("peak"), (best("size") / (middle + 1e-9)).alias("confidence"))


def loudness(samples: DataFrame, rate: int) -> DataFrame:
    """Frames of sound: 25 ms long, one every 10 ms, as the level of their mean square."""
    part = max(1, rate // 200)
    sub = samples.groupBy("clip", F.floor(F.col("i") / part).alias("s")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n"))
    w = _by("s").rowsBetween(0, 4)
    whole = sub.withColumns({"e": F.sum("e").over(w), "n": F.sum("n").over(w)}).filter((F.col("n") == 5 * part) & (F.col("s") % 2 == 0))
    return whole.select("clip", (F.col("s") / 2).cast("long").alias("f"), (F.col("s") * part / F.lit(rate)).alias("at"), (10 * F.log10(F.col("e") / (5 * part) + 1e-12)).alias("db"))


def speech_level(frames: DataFrame) -> DataFrame:
    """clip, speech: the median of the frames within 20 dB of the 95th percentile."""
    top = frames.groupBy("clip").agg((F.percentile("db", F.lit(0.95)) - 20).alias("least"))
    return frames.join(top, "clip").filter("db >= least").groupBy("clip").agg(F.percentile("db", F.lit(0.5)).alias("speech"))


def _runs(frames: DataFrame, hit: str, least: int) -> DataFrame:
    """clip, first, last, n: runs of at least so many frames where hit holds."""
    marked = frames.filter(hit).withColumn("g", F.col("f") - F.row_number().over(_by("f")))
    return marked.groupBy("clip", "g").agg(F.min("f").alias("first"), F.max("f").alias("last"), F.min("at").alias("from"), F.max("at").alias("to"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("g")


def _graded(value: Column, warn: float, error: float, below: bool = False) -> Column:
    worse = (lambda x: value < x) if below else (lambda x: value > x)
    return F.when(worse(error), "error").when(worse(warn), "warn").otherwise("pass")


def audio_checks(samples: DataFrame, rate: int, last_words: DataFrame, window: float = 5.0, voiced_frames: int = 50, gap_frames: int = 40, most_crest: float = CREST) -> DataFrame:
    """clip, check, measure, level: railed samples, level drift, dead air at both ends, pops, a clipped last word, the bed under the voice.

    last_words: clip, size (letters), seconds."""
    samples = written(samples, "signal-samples")  # read by five checks
    size = samples.groupBy("clip").agg(F.count("*").alias("n"))
    frames = written(loudness(samples, rate), "signal-frames")
    level = written(speech_level(frames), "signal-levels")
    f = frames.join(level, "clip").join(size.select("clip", (F.col("n") / rate).alias("length")), "clip")
    row = lambda df, name, measure, graded: df.select("clip", F.lit(name).alias("check"), measure.cast("double").alias("measure"), graded.alias("level"))

    flat = samples.filter(F.abs("x") >= RAIL).withColumn("g", F.col("i") - F.row_number().over(_by("i"))).groupBy("clip", "g").agg(F.count("*").alias("k")).filter(F.col("k") >= RAIL_RUN)
    flat = size.join(flat.groupBy("clip").agg(F.sum(F.col("k") - (RAIL_RUN - 1)).alias("k")), "clip", "left")
    share = F.coalesce(F.col("k"), F.lit(0)) / F.col("n")
    railed = row(flat, "railed", share, F.when(share >= RAIL_ERROR, "error").when(share >= RAIL_WARN, "warn").otherwise("pass"))

    spans = f.filter("db >= speech - 15").withColumn("w", F.floor(F.col("at") / window)).filter(F.col("w") * window < F.col("length") - 1)
    spans = spans.groupBy("clip", "w").agg(F.avg("db").alias("db"), F.count("*").alias("k")).filter(F.col("k") >= voiced_frames)
    mean = spans.groupBy("clip").agg(F.avg("db").alias("mean"), F.count("*").alias("windows"))
    off = spans.join(mean, "clip").groupBy("clip", "windows").agg(F.max(F.abs(F.col("db") - F.col("mean"))).alias("off"))
    off = size.join(off, "clip", "left").withColumn("off", F.when(F.col("windows") >= 2, F.col("off")))
    drift = row(off, "level", F.col("off"), _graded(F.col("off"), LEVEL_WARN, LEVEL_ERROR))

    voice = _runs(f, f"db >= speech - {VOICED}", SUSTAINED).groupBy("clip").agg(F.min("from").alias("onset"), (F.max("to") + 0.025).alias("end"))
    ends = size.select("clip", (F.col("n") / rate).alias("length")).join(voice, "clip", "left")
    onset = F.coalesce("onset", "length")
    tail = F.greatest(F.lit(0.0), F.col("length") - F.coalesce("end", F.lit(0.0)))
    open_, close = row(ends, "open", onset, _graded(onset, OPEN_WARN, OPEN_ERROR)), row(ends, "close", tail, _graded(tail, CLOSE_WARN, CLOSE_ERROR))

    last = frames.groupBy("clip").agg(F.max("f").alias("l"))
    splices = _runs(frames, "db < -35", 3).join(last, "clip").filter("last < l").select("clip", ((F.col("last") + 1) * 10 * rate / 1000).cast("long").alias("s"))
    half = rate // 40
    near = splices.select("clip", "s", F.explode(F.sequence(F.floor((F.col("s") - half) / (2 * half)), F.floor((F.col("s") + half - 1) / (2 * half)))).alias("b"))
    around = samples.withColumn("b", F.floor(F.col("i") / (2 * half))).join(near, ["clip", "b"]).filter(f"i >= s - {half} and i < s + {half}")
    crest = around.groupBy("clip", "s").agg((F.max(F.abs("x")) / F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12)).alias("crest"))
    top = size.join(crest.groupBy("clip").agg(F.max("crest").alias("crest")), "clip", "left")
    pops = row(top, "pops", F.col("crest"), F.when(F.col("crest") > most_crest, "error").otherwise("pass"))

    tails = f.withColumn("r", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("f")))).filter("r <= 2").groupBy("clip").agg((F.max("db") - F.max("speech")).alias("edge"))
    words = tails.join(last_words, "clip", "left")
    least = F.when(F.col("size") <= 2, 0.08).when(F.col("size") <= 4, 0.12).otherwise(0.15)
    short = (F.col("size") > 0) & (F.col("seconds") > 0) & (F.col("seconds") < least)
    cut = row(words, "last word", F.col("edge"), F.when(short & (F.col("edge") >= -HOT_EDGE), "error").otherwise("pass"))

    body = f.filter("at >= 1.0 and at <= length - 1.5")
    gaps = _runs(body, "db <= speech - 22", gap_frames).select("clip", "first", "last")
    bed = body.join(gaps, "clip").filter("f between first and last").groupBy("clip").agg(F.percentile("db", F.lit(0.5)).alias("bed"))
    loud = f.filter(f"db >= speech - {VOICED}").groupBy("clip").agg(F.percentile("db", F.lit(0.5)).alias("voice"))
    apart = size.join(bed, "clip", "left").join(loud, "clip", "left").withColumn("apart", F.col("voice") - F.col("bed"))
    music = row(apart, "bed", F.col("apart"), _graded(F.col("apart"), BED_WARN, BED_ERROR, below=True))

    out = railed
    for part in (drift, open_, close, pops, cut, music):
        out = out.unionByName(part)
    return out


def voiced_spans(frames: DataFrame, attack: float = 12.0, release: float = 18.0) -> DataFrame:
    """clip, st, en: a span opens at attack dB under the speech level and closes once the level falls release dB under it."""
    f = frames.join(speech_level(frames), "clip")
    set_ = F.when(F.col("db") >= F.col("speech") - attack, 1).when(F.col("db") < F.col("speech") - release, 0)
    on = F.coalesce(F.last(set_, ignorenulls=True).over(_by("f").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    held = f.withColumn("on", on).filter("on = 1").withColumn("g", F.col("f") - F.row_number().over(_by("f")))
    return held.groupBy("clip", "g").agg(F.min("at").alias("st"), (F.max("at") + 0.025).alias("en")).drop("g")


def block_powers(samples: DataFrame, rate: int, lo: int, hi: int) -> DataFrame:
    """clip, block, powers: the power of blocks of a second at the whole frequencies from lo to hi, under a Hann window, as an array of one row a
    block. A block of a second holds them all in one Fourier transform."""
    held = samples.withColumn("k", F.col("i") % rate).groupBy("clip", F.floor(F.col("i") / rate).alias("block"))
    shaped = F.col("x") * (0.5 - 0.5 * F.cos(F.lit(2 * math.pi / rate) * F.col("k")))
    xs = held.agg(F.array_sort(F.collect_list(F.struct("k", shaped.alias("x")))).alias("s"), F.count("x").alias("n")).filter((F.size("s") == rate) & (F.col("n") == rate))
    hz = np.arange(lo, hi + 1) % rate
    hz = np.minimum(hz, rate - hz)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCKS):
                part = b.slice(at, BLOCKS)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, rate)
                power = np.abs(np.fft.rfft(x)[:, hz]) ** 2 / (rate * rate)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(hz))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(power.ravel()))], ["clip", "block", "powers"])

    kind = samples.schema["clip"].dataType.simpleString()
    return xs.select("clip", F.col("block").cast("long").alias("block"), F.transform("s", lambda p: p["x"]).alias("x")).mapInArrow(run, f"clip {kind}, block long, powers array<double>")


def power_spectrum(samples: DataFrame, rate: int, lo: int, hi: int) -> DataFrame:
    """clip, block, hz, power: the powers of ``block_powers``, one a row."""
    each = block_powers(samples, rate, lo, hi).select("clip", "block", F.posexplode("powers").alias("hz", "power"))
    return each.select("clip", "block", (F.col("hz") + lo).alias("hz"), "power")


def around(powers: DataFrame, lo: int, grid: list[tuple[int, int]]) -> DataFrame:
    """clip, block, base, at, peak, band, prominence: of powers (clip, block, and an array that begins at lo) at each (base, at) of the grid,
    where within 3 the largest is, the sum within 2, and how far that stands out of the middle of those 6 to 35 away."""
    spots = powers.select("clip", "block", "powers", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(c).alias("at")) for b, c in grid])).alias("g"))
    part = lambda start, n: F.slice("powers", F.col("g.at") + start - lo + 1, F.lit(n))
    most = F.array_max(F.transform(part(-3, 7), lambda x, i: F.struct(x.alias("power"), (3 - i).alias("d"))))
    band = F.aggregate(part(-2, 5), F.lit(0.0), lambda s, x: s + x)
    spots = spots.select("clip", "block", "g.base", "g.at", (-most["d"]).alias("peak"), band.alias("band"), F.array_sort(F.concat(part(-35, 30), part(6, 30))).alias("far"))
    floor = (F.get("far", F.lit(29)) + F.get("far", F.lit(30))) / 2
    return spots.select("clip", "block", "base", "at", "peak", "band", (10 * F.log10(F.col("band") / (floor * 5 + 1e-18) + 1e-12)).alias("prominence"))


def hum(samples: DataFrame, rate: int, top: int | None = None) -> DataFrame:
    """clip, base, hz, prominence, persistence, below_speech, level: harmonics of 50 and 60 Hz that stand out of what is around them,
    on the grid, in most blocks, and how far they lie under the speech band."""
    top = min(620, rate // 2) if top is None else top
    lo = 12
    grid = [(b, b * k) for b in (50, 60) for k in range(1, 13) if b * k <= top - 35]
    psd = written(block_powers(samples, rate, lo, top), "signal-powers")
    mean = psd.select("clip", F.posexplode("powers").alias("p", "power")).groupBy("clip", "p").agg(F.avg("power").alias("power"))
    whole = mean.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "power"))), lambda x: x["power"]).alias("powers")).withColumn("block", F.lit(-1).cast("long"))
    speech = mean.filter((F.col("p") + lo).between(300, 3400)).groupBy("clip").agg(F.sum("power").alias("speech"))
    total = around(whole, lo, grid)
    held = around(psd, lo, grid).groupBy("clip", "base", "at").agg(F.avg((F.col("prominence") >= 6).cast("int")).alias("persistence"))
    found = total.join(held, ["clip", "base", "at"]).join(speech, "clip").filter("peak = 0")
    found = found.withColumn("below", 10 * F.log10(F.col("speech") / (F.col("band") + 1e-18) + 1e-12))
    member = (F.col("prominence") >= HUM["family_prominence"]) & (F.col("persistence") >= HUM["family_persistence"])
    found = found.withColumn("family", F.sum(member.cast("int")).over(Window.partitionBy("clip", "base")))
    solo = (F.col("prominence") >= HUM["solo_prominence"]) & (F.col("persistence") >= HUM["solo_persistence"])
    tonal = (F.col("prominence") >= HUM["prominence"]) & (F.col("persistence") >= HUM["persistence"]) & ((F.col("family") >= 2) | solo)
    level = F.when(~tonal, "pass").when(F.col("below") < HUM["error"], "error").when(F.col("below") < HUM["warn"], "warn").otherwise("pass")
    return found.select("clip", "base", F.col("at").alias("hz"), "prominence", "persistence", F.col("below").alias("below_speech"), level.alias("level"))


def level_checks(samples: DataFrame, rate: int, window: float = 3.0) -> DataFrame:
    """clip, check, measure, level: the peak against its target, clipping, and the loudness range of gated windows."""
    peak = samples.groupBy("clip").agg((20 * F.log10(F.max(F.abs("x")) + 1e-12)).alias("peak"))
    p = F.col("peak")
    target = F.when(p > -1, "error").when(p > -3, "warn").when(p >= -8, "pass").when(p >= -12, "warn").otherwise("error")
    clip = F.when(p > -0.5, "error").when(p > -1, "warn").otherwise("pass")
    st = samples.groupBy("clip", F.floor(F.col("i") / F.lit(rate * window)).alias("w")).agg(F.avg(F.col("x") * F.col("x")).alias("e")).filter("e > 1e-7")
    gate = st.groupBy("clip").agg((F.avg("e") / 100).alias("least"))
    db = 10 * F.log10("e")
    lra = st.join(gate, "clip").filter("e >= least").groupBy("clip").agg((F.percentile(db, F.lit(0.95)) - F.percentile(db, F.lit(0.10))).alias("range"))
    row = lambda df, name, measure, level: df.select("clip", F.lit(name).alias("check"), F.col(measure).alias("measure"), level.alias("level"))
    out = row(peak, "peak", "peak", target).unionByName(row(peak, "clipping", "peak", clip))
    return out.unionByName(row(lra, "range", "range", F.when(F.col("range") < 5, "warn").otherwise("pass")))


def picture_checks(frames: DataFrame, seams: DataFrame, fps: float) -> DataFrame:
    """clip, check, measure, level: steps within shots, jumps across seams of one take, panning, frozen and black frames, a subject off centre, first
    and last frame. seams: clip, seam (seconds), content (whether the cut is meant)."""
    frames = written(frames, "picture-frames")
    clips = frames.groupBy("clip").agg(F.min("f").alias("first"), F.max("f").alias("last"))
    w = _by("f")
    f = frames.withColumns({"before": F.lag("at").over(w), "dy0": F.lag("dy").over(w), "dy2": F.lead("dy").over(w)})
    # the last seam that begins no later than SEAM_NEAR behind a frame
    marks = seams.select("clip", (F.col("seam") - SEAM_NEAR).alias("key"), F.lit(0).alias("kind"), F.col("seam").alias("mark"))
    both = f.select("clip", F.col("at").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("mark"), "f").unionByName(marks, allowMissingColumns=True)
    last = F.last("mark", ignorenulls=True).over(Window.partitionBy("clip").orderBy("key", "kind", "f").rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("mark", last).filter("kind = 1").select("clip", "f", "mark")
    inside = f.join(seen, ["clip", "f"]).filter(F.col("before").isNotNull() & ~F.coalesce(F.col("mark") >= F.col("before") - SEAM_NEAR, F.lit(False)))
    still = inside.groupBy("clip").agg(F.percentile(F.abs("dy"), F.lit(0.5)).alias("base"))
    fixed = clips.select("clip").join(still, "clip", "left").withColumn("moving", F.coalesce(F.col("base") > MOVING, F.lit(False)))

    dy = F.abs("dy")
    confirmed = F.coalesce(F.abs(F.col("dy0") + F.col("dy") + F.col("dy2")) >= 0.7 * dy, F.lit(False))
    rank = F.when(confirmed & (dy >= SHIFT_ERROR), 2).when(confirmed | (dy >= SHIFT_ERROR), 1).otherwise(0)
    steps = inside.filter((dy >= SHIFT_WARN) & ~F.col("zoom")).groupBy("clip").agg(F.max(rank).alias("rank"), F.max(dy).alias("most"))
    named = lambda c: F.when(F.col(c) == 2, "error").when(F.col(c) == 1, "warn").otherwise("pass")
    row = lambda df, name, measure, level: df.select("clip", F.lit(name).alias("check"), measure.cast("double").alias("measure"), level.alias("level"))
    within = row(fixed.join(steps, "clip", "left").withColumn("rank", F.when(~F.col("moving"), F.coalesce("rank", F.lit(0))).otherwise(0)), "shift", F.coalesce("most", F.lit(0.0)), named("rank"))

    # frames between SEAM_NEAR before and behind a seam, by second, and how far they move together
    cell = seams.select("clip", "seam", "content", F.explode(F.sequence(F.floor(F.col("seam") - SEAM_NEAR), F.floor(F.col("seam") + SEAM_NEAR))).alias("cell"))
    over = frames.withColumn("cell", F.floor("at")).join(cell, ["clip", "cell"]).filter((F.col("at") > F.col("seam") - SEAM_NEAR) & (F.col("at") <= F.col("seam") + SEAM_NEAR))
    jump = over.groupBy("clip", "seam", "content").agg(F.round(F.abs(F.sum("dy")), 9).alias("dy"), F.max(F.col("zoom").cast("int")).alias("zoom")).filter("not content and zoom = 0")
    jumps = fixed.join(jump.groupBy("clip").agg(F.max("dy").alias("most")), "clip", "left")
    across = row(jumps, "seam", F.coalesce("most", F.lit(0.0)), F.when(F.col("moving"), "pass").when(F.col("most") >= SEAM_ERROR, "error").when(F.col("most") >= SEAM_WARN, "warn").otherwise("pass"))

    pans = fixed.join(inside.groupBy("clip").agg(F.max(F.abs("dx")).alias("most")), "clip", "left")
    pan = row(pans, "pan", F.coalesce("most", F.lit(0.0)), F.when(~F.col("moving") & (F.col("most") > PAN), "error").otherwise("pass"))
    runs = _runs(frames.join(clips, "clip").filter("f > first"), f"diff < {FROZEN}", FROZEN_RUN).groupBy("clip").agg(F.max("n").alias("n"))
    frozen = row(clips.join(runs, "clip", "left"), "frozen", F.coalesce("n", F.lit(0)) / fps, F.when(F.col("n") > 0, "error").otherwise("pass"))
    dark = frames.groupBy("clip").agg(F.count_if(F.col("light") < BLACK).alias("n"))
    black = row(dark, "black", F.col("n"), F.when(F.col("n") > 0, "error").otherwise("pass"))
    off = _runs(frames, f"cx < {OFF_CENTRE[0]} or cx > {OFF_CENTRE[1]}", 1).withColumn("s", F.col("to") - F.col("from")).groupBy("clip").agg(F.max("s").alias("s"))
    centre = row(clips.join(off, "clip", "left"), "off centre", F.coalesce("s", F.lit(0.0)), F.when(F.col("s") >= OFF_SECONDS, "warn").otherwise("pass"))
    edge = frames.join(clips, "clip").filter("f = first or f = last")
    bad = F.when(F.col("light") < BLACK, 2).when(F.col("cx").isNull(), 1).otherwise(0)
    ends = edge.groupBy("clip").agg(F.max(bad).alias("bad"))
    out = within
    for part in (across, pan, frozen, black, centre, row(ends, "first and last", F.col("bad"), named("bad"))):
        out = out.unionByName(part)
    return out
