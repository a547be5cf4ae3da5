"""Column functions on times, colours, money and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(x: Column) -> Column:
    """H:MM:SS(.cc), MM:SS or plain seconds to seconds; a comma may stand for the point; null if unreadable."""
    p = F.split(F.replace(F.trim(x), F.lit(","), F.lit(".")), ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 1, part(1)).when(F.size(p) == 2, part(1) * 60 + part(2)).when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def cue_time(t: Column, comma: bool = False) -> Column:
    """H:MM:SS.cc with carry, or HH:MM:SS,mmm."""
    unit = 1000 if comma else 100
    n = F.floor(F.greatest(F.lit(0.0), t) * unit + 0.5).cast("bigint")
    h, m, s, rest = F.floor(n / (3600 * unit)), F.floor(n / (60 * unit)) % 60, F.floor(n / unit) % 60, n % unit
    return F.format_string("%02d:%02d:%02d,%03d" if comma else "%d:%02d:%02d.%02d", h, m, s, rest)


def clock(x: str | Column) -> Column:
    """MM:SS, whole seconds."""
    x = F.floor(F.col(x) if isinstance(x, str) else x)
    return F.format_string("%02d:%02d", F.floor(x / 60), x % 60)


def since_seconds(x: Column) -> Column:
    """'1h', '30m', '2d', '10s' to seconds; unreadable: 0."""
    n = F.regexp_extract(x, r"^(\d+)([smhd])$", 1).try_cast("bigint")
    unit = F.regexp_extract(x, r"^(\d+)([smhd])$", 2)
    mult = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.coalesce(n * mult, F.lit(0).cast("bigint"))


def rgb(colour: Column) -> Column:
    """A subtitle colour &HAABBGGRR& as RRGGBB."""
    h = F.concat(F.lit("000000"), F.upper(F.regexp_replace(colour, "(?i)[&h]", "")))
    h = F.substring(h, F.length(h) - 5, F.lit(6))
    return F.concat(F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def colour_name(hex6: Column) -> Column:
    """white, yellow, black or other, by channels."""
    c = lambda i: F.conv(F.substring(hex6, i, 2), 16, 10).try_cast("int")
    r, g, b = c(1), c(3), c(5)
    return F.when((r > 220) & (g > 220) & (b > 220), "white").when((r > 180) & (g > 140) & (b < 120), "yellow").when((r < 40) & (g < 40) & (b < 40), "black").otherwise("other")


def money(v: Column) -> Column:
    """$999, $1,500, $20K, $1.2M, $2B tiers of a whole amount."""

    def short(unit: float, mark: str) -> Column:
        t = F.floor(v / (unit / 10)).cast("bigint")
        whole, tenth = F.floor(t / 10).cast("string"), (t % 10).cast("string")
        return F.concat(F.lit("$"), F.when(t % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), tenth)), F.lit(mark))

    plain = v.cast("bigint").cast("string")
    grouped = F.concat(F.lit("$"), F.substring(plain, F.lit(1), F.length(plain) - 3), F.lit(","), F.substring(plain, F.length(plain) - 2, F.lit(3)))
    return F.when(v < 1000, F.concat(F.lit("$"), plain)).when(v < 20000, grouped).when(v < 1e6, short(1e3, "K")).when(v < 1e9, short(1e6, "M")).otherwise(short(1e9, " Billion"))


def duration_score(dur: Column, ideal: tuple[float, float] = (180, 600), least: float = 90, most: float = 1200) -> Column:
    """Piecewise score of a length: 1 within the ideal, a ramp before, a decay after, 0.3 outside, 0.7 unknown."""
    lo, hi = ideal
    return F.when(dur.isNull(), F.lit(0.7)).when(dur.between(lo, hi), F.lit(1.0)).when((dur >= least) & (dur < lo), 0.5 + 0.5 * (dur - least) / (lo - least)).when((dur > hi) & (dur <= most), 1.0 - 0.6 * (dur - hi) / (most - hi)).otherwise(F.lit(0.3))


def clamp(x: Column, default: float = 0.5) -> Column:
    v = x.try_cast("double")
    return F.when(v.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def tempo(t: Column) -> Column:
    """Beats a minute: unknown or zero as 92, above 120 halved."""
    return F.when(t.isNull() | (t == 0), F.lit(92.0)).when(t > 120, t / 2).otherwise(t.cast("double"))


def slots(t: Column, hours: list[int], days: int) -> Column:
    """The times at whole hours of t's day and the days after it, in order."""
    day = F.date_trunc("day", t)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: F.array(*[day + F.make_dt_interval(days=d, hours=F.lit(h)) for h in hours])))
