"""Column functions on text: normalisers (not interchangeable), word predicates, markup, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists of the transcript rules
FILLERS = ["uh", "um", "uhh", "umm", "mm", "hmm", "er", "ah", "mhm", "uhm"]
CONNECTORS = ["and", "but", "so", "or", "well", "like", "now", "okay", "right", "because", "cause", "which", "yeah", "yes", "no"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_edges(pattern: str) -> str:
    r"""A pattern whose \b stands between ASCII word characters and others, as in RE2; Java counts letters of any script."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def letters(x: str | Column) -> Column:
    """Lower case, only a-z and apostrophes."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z']", "")


def alphanumerics(x: str | Column) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def word_chars(x: str | Column) -> Column:
    """Lower case, letters of any script, digits, underscores and apostrophes."""
    low = F.lower(_c(x))
    return F.when(~low.rlike("[^a-z0-9_']"), low).otherwise(F.regexp_replace(low, r"(?U)[^\w']", ""))  # most words have nothing to take out


def plain(x: str | Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


def is_any(x: str | Column, words: list[str]) -> Column:
    return F.lower(F.regexp_replace(_c(x), "[^A-Za-z]", "")).isin(words)


def is_content(x: str | Column) -> Column:
    s = F.regexp_replace(F.lower(_c(x)), "[^a-z0-9']", "")
    return (s != "") & ~s.isin(FILLERS)


def ends_sentence(x: str | Column) -> Column:
    return F.trim(_c(x)).rlike("[.!?][\"')\\]]*$")


def is_connector(x: str | Column) -> Column:
    return letters(x).isin(CONNECTORS)


def without_cue_tags(x: str | Column) -> Column:
    """A subtitle text without override blocks and with line breaks as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"\{[^}]*\}", ""), r"\\[Nnh]", " "))


def without_markup(x: str | Column) -> Column:
    """Text of an HTML fragment: no tags, common entities resolved, white space collapsed."""
    t = F.regexp_replace(_c(x), "<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def tokens(x: str | Column) -> Column:
    return F.filter(F.split(plain(x), " "), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def shingles(x: Column, n: int) -> Column:
    """All runs of n tokens, each joined by blanks."""
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " "))).otherwise(F.array().cast("array<string>"))


# fixed values: number words that a comparison leaves out, beside those of the test tables
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "hundred", "thousand", "million", "un", "deux"]


def canonical(words: Column) -> Column:
    """An array of words as they are compared: split at hyphens and slashes, letters and digits alone, no numbers or number words."""
    parts = F.transform(F.flatten(F.transform(words, lambda w: F.split(F.lower(w), "[-/]"))), lambda p: F.regexp_replace(p, "[^a-z0-9]", ""))
    return F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^\d+(k|m|b|st|nd|rd|th)?$") & ~p.isin(NUMBER_WORDS))


def number(x: str | Column) -> Column:
    """A number as a double, currency signs and commas aside, with k or m for thousands and millions; null if there is none."""
    t = F.regexp_replace(F.lower(_c(x)), r"[^0-9.km-]", "")
    scale = F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).otherwise(1.0)
    return F.regexp_replace(t, "[km]$", "").try_cast("double") * scale


def delivery_name(brand: str, kind: str, source: Column, title: Column, editor: str, day: Column) -> Column:
    return F.concat_ws("_", F.lit(brand), F.lit(kind), source, title, F.lit(editor), day)


def delivery_parts(name: Column) -> Column:
    """struct(source, title, day, version) of a delivery's name; nulls where a part is missing."""
    pattern = r"^[^_]+_[^_]+_([^_]+)_([^_]+)_[^_]+_([0-9]{8})_V([0-9]+)[.]"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.struct(part(1).alias("source"), part(2).alias("title"), F.try_to_date(part(3), "yyyyMMdd").alias("day"), part(4).try_cast("long").alias("version"))
