"""Numbers in text: spelled out, folded with their units, and the parts of a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: number words
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _pick(words: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def below_hundred(n: Column) -> Column:
    tens = _pick(TENS, F.floor(n / 10))
    return F.when(n < 20, _pick(ONES, n)).when(n % 10 == 0, tens).otherwise(F.concat_ws(" ", tens, _pick(ONES, n % 10)))


def below_thousand(n: Column) -> Column:
    hundreds = F.concat_ws(" ", _pick(ONES, F.floor(n / 100)), F.lit("hundred"))
    return F.when(n < 100, below_hundred(n)).when(n % 100 == 0, hundreds).otherwise(F.concat_ws(" ", hundreds, F.lit("and"), below_hundred(n % 100)))


def spelled(n: Column) -> Column:
    """A whole number under a million in words."""
    thousands = F.concat_ws(" ", below_thousand(F.floor(n / 1000)), F.lit("thousand"))
    rest = F.when(n % 1000 < 100, F.concat(F.lit("and "), below_hundred(n % 1000))).otherwise(below_thousand(n % 1000))
    return F.when(n < 1000, below_thousand(n)).when(n % 1000 == 0, thousands).otherwise(F.concat_ws(" ", thousands, rest))


def spelled_year(n: Column) -> Column:
    """Years from 1900 to 2099 as they are said, other numbers as numbers."""
    high, low = below_hundred(F.floor(n / 100)), n % 100
    pair = F.when(low == 0, F.concat_ws(" ", high, F.lit("hundred"))).when(low < 10, F.concat_ws(" ", high, F.lit("oh"), _pick(ONES, low))).otherwise(F.concat_ws(" ", high, below_hundred(low)))
    return F.when(n.between(1900, 2099) & ~n.between(2000, 2009), pair).otherwise(spelled(n))


def folded(first: Column, second: Column) -> Column:
    """Two tokens that are a number and its unit, or ``number`` and one, as one token; null if they aren't."""
    n = r"^\$?\d[\d,]*(\.\d+)?$"
    unit = F.lower(F.regexp_replace(second, "[.,!?]+$", ""))
    tail = F.regexp_extract(second, "[.,!?]+$", 0)
    bare = F.regexp_replace(first, r"^\$", "")
    sign = F.when(unit == "percent", F.concat(bare, F.lit("%"))).when(unit == "times", F.concat(bare, F.lit("X"))).when(unit == "million", F.concat(F.lit("$"), bare, F.lit("M"))).when(unit == "billion", F.concat(F.lit("$"), bare, F.lit("B")))
    number = (F.lower(first) == "number") & F.regexp_replace(second, "[.,!?]+$", "").rlike(n)
    return F.when(first.rlike(n), F.concat(sign, tail)).when(number, F.concat(F.lit("#"), second))


def peeled(token: Column) -> Column:
    """struct(lead, core, trail): a token's punctuation in front and behind, which money and percent signs aren't."""
    part = lambda i: F.regexp_extract(token, r"^([(\[\"'“‘]*)(.*?)([)\]\"'”’.,!?;:]*)$", i)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("trail"))


def formatted(core: Column) -> Column:
    """Whether a token is already written as a figure: money, percent, a thousand with commas, an ordinal, or short with K, M or B."""
    return core.rlike(r"^(\$[\d,]+(\.\d+)?[KMB]?|[\d,]+(\.\d+)?%|\d{1,3}(,\d{3})+|\d+(st|nd|rd|th)|#\d+|\d+(\.\d+)?[KMBX])$")
