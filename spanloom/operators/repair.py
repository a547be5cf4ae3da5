"""Repair of machine transcripts: split words joined again, stutters dropped, contractions, digits, times of day, ranges, capitals.

Every step takes and gives words (clip, idx, word, st, en) and looks at a few neighbours through window functions; where one of several
overlapping finds has to be taken from the left, finds that overlap form runs of a known step, of which every other one is taken.
Joining split words depends on the join before. How far the word goes that begins at a place is found for all places at once, in rounds that
are one join with a table of word frequencies each; a streamed fold then takes, of those that overlap, the first. The result is that of a
pass from left to right that looks at a joined word again before it goes on. Rounds are written tables of the places alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scan import scanned
from .steps import written

# fixed values: numbers that are written as digits ("zero" stays a word), acronyms, names, and the frequency limits of split words
SINGLE = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
TENS = [w for w, n in SINGLE.items() if n >= 20]
ONES = [w for w, n in SINGLE.items() if n < 10]
ACRONYMS = ["ai", "ml", "ceo", "cfo", "cto", "coo", "ev", "ip", "kpi", "mvp", "ui", "ux", "usa", "uk", "fbi", "cia", "nasa", "fda", "irs", "gdp", "b2b", "b2c", "saas", "cnn", "bbc", "dtc", "roi", "fyi", "tldr", "faq", "api", "sdk", "cli", "gpu", "cpu"]
NAMES = ["princeton", "harvard", "yale", "mit", "stanford", "oxford", "cambridge", "columbia", "brown", "duke", "apple", "google", "amazon", "microsoft", "facebook", "meta", "twitter", "instagram", "tiktok", "youtube", "linkedin", "netflix", "tesla", "spacex", "california", "america", "american", "texas", "florida", "seattle", "chicago", "boston", "miami", "elon", "musk", "jobs", "gates", "bezos", "zuckerberg", "trump", "biden", "shaq", "jordan", "lebron", "kobe", "jimi", "hendrix", "christmas", "easter", "halloween", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
REAL, FRAGMENT, COMMON = 1.5, 2.0, 2.5
PASSES = 10
AHEAD = 4  # words that a start of a join sees behind it at a time
SLOTS = 1 << 18  # longs of the bits that tell which hashes real words have

def by_clip() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("idx")


COLUMNS = ["clip", "idx", "word", "st", "en"]


def frequencies(texts: DataFrame, word: str = "word") -> DataFrame:
    """w, zipf: the base-ten logarithm of how often each word occurs in a billion, from the words of a table."""
    counts = texts.select(_bare(F.col(word)).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("w", F.log10(F.col("n") * 1e9 / F.col("total")).alias("zipf"))  # one row


def _bare(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, "[^A-Za-z']", ""))


def joined_splits(words: DataFrame, zipf: DataFrame, passes: int = PASSES, parts: int | None = None) -> DataFrame:
    """Fragments of one word as the word: neighbours whose join is a real word, while one of them is rare or a lone letter. A further pass,
    up to ``passes``, holds what a pass joined against the word before it.

    Where words are dealt out by clip already, to ``parts`` partitions, the first pass shuffles no more of them than pairs that look like a known
    word (``_known``)."""
    zipf = written(zipf.filter("w is not null"), "repair-zipf")
    now = words.select(*COLUMNS)
    for k in range(passes):
        taken = written(_taken(_starts(now, zipf), zipf, now), "repair-joins")
        if k and taken.isEmpty():
            break
        now = _joined(now, taken if k or not parts else taken.repartition(parts, "clip"))
        if k + 1 < passes:
            now = written(now, "repair-pass")
    return now


def _following(words: DataFrame) -> DataFrame:
    """words with the ``AHEAD`` words behind each: next, an array of (word, en, idx), shorter where a clip ends."""
    each = [F.struct(*[F.lead(c, k).over(by_clip()).alias(c) for c in ("word", "en", "idx")]) for k in range(1, AHEAD + 1)]
    return words.withColumn("next", F.filter(F.array(*each), lambda x: x["idx"].isNotNull()))


_BIT = "cast(pmod(xxhash64({}), 64) as int)"


def _slot(c: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64({c}), {64 * SLOTS}) div 64 as int)")


def _known(zipf: DataFrame) -> DataFrame:
    """bits, one row: a bit for each hash that a real word has, in ``SLOTS`` longs; a word without its bit is none."""
    hashed = zipf.filter(F.col("zipf") >= REAL).select(_slot("w").alias("slot"), F.expr(f"shiftleft(1L, {_BIT.format('w')})").alias("bit"))
    slots = hashed.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    full = zipf.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits"))


def _may(tried: DataFrame, zipf: DataFrame) -> DataFrame:
    """The rows whose word and first of next may be one word, as both, by all that their letters tell and by the hash of both."""
    a, b = _bare(F.col("word")), _bare(F.get("next", F.lit(0))["word"])
    may = (F.size("next") > 0) & (a != "") & (b != "") & ~F.rtrim("word").rlike("[.,!?;:']$") & ~F.ltrim(F.get("next", F.lit(0))["word"]).rlike(r"^\p{Lu}")
    there = F.expr(f"shiftright(bits[slot], {_BIT.format('both')}) & 1L = 1L")
    rows = tried.filter(may).withColumn("both", F.concat(a, b)).withColumn("slot", _slot("both"))
    return rows.join(F.broadcast(_known(zipf)), there, "left_semi").drop("slot")  # one row


def _fitting(may: DataFrame, zipf: DataFrame) -> DataFrame:
    """Those of the rows whose word and first of next are one word."""
    of = lambda name, value, least: zipf.filter(F.col("zipf") >= least).select(F.col("w").alias(name), F.col("zipf").alias(value))
    a, b = _bare(F.col("word")), _bare(F.get("next", F.lit(0))["word"])
    rows = may.join(of("both", "cz", REAL), "both").withColumn("a", a).withColumn("b", b)
    rows = rows.join(of("a", "az", FRAGMENT), "a", "left").join(of("b", "bz", FRAGMENT), "b", "left")  # rarer ones count as unknown ones do
    z, nz = F.coalesce("az", F.lit(0.0)), F.coalesce("bz", F.lit(0.0))
    lone = lambda x: (F.length(x) == 1) & ~x.isin("a", "i", "o")
    rare = ~((z >= COMMON) & (nz >= COMMON)) & ((z < FRAGMENT) | (nz < FRAGMENT))
    return rows.filter(lone(F.col("a")) | lone(F.col("b")) | rare).drop("a", "b", "az", "bz", "cz", "both")


def _starts(words: DataFrame, zipf: DataFrame) -> DataFrame:
    """The words that fit the one behind them, with both joined: clip, idx, word, last (the idx of what was joined last), en, next."""
    return _extended(_fitting(_may(_following(words).select("clip", "idx", "word", "next"), zipf), zipf))


def _extended(fits: DataFrame) -> DataFrame:
    first = F.get("next", F.lit(0))
    return fits.select("clip", "idx", F.concat("word", first["word"]).alias("word"), first["idx"].alias("last"), first["en"].alias("en"), F.slice("next", 2, AHEAD).alias("next"))


def _taken(starts: DataFrame, zipf: DataFrame, words: DataFrame) -> DataFrame:
    """The joins of a pass: from each start on as far as its word goes, and of those that overlap the first, then the first behind it. A round for each
    further word of the longest join."""
    done, open_ = [], written(starts, "repair-round")
    while not open_.isEmpty():
        short = open_.filter(F.size("next") == 0)
        if not short.isEmpty():  # the words behind those seen so far
            near = words.join(short.select("clip").distinct(), "clip", "left_semi")
            more = _following(near).select("clip", F.col("idx").alias("last"), F.col("next").alias("more"))
            open_ = written(open_.join(more, ["clip", "last"], "left").withColumn("next", F.when(F.size("next") == 0, F.coalesce("more", "next")).otherwise(F.col("next"))).drop("more"), "repair-round")
        on = written(_extended(_fitting(_may(open_, zipf), zipf)), "repair-round")
        done.append(open_.join(on.select("clip", "idx"), ["clip", "idx"], "left_anti"))
        open_ = on
    found = open_ if not done else reduce(DataFrame.unionByName, [x.select(open_.columns) for x in done])

    def first(rows: Iterator) -> Iterator[tuple]:
        end = None
        for r in rows:
            if end is None or r.idx > end:
                end = r.last
                yield r.idx, r.word, r.last, r.en

    return scanned(found.select("clip", "idx", "word", "last", "en"), ["clip"], ["idx"], first, f"clip {found.schema['clip'].dataType.simpleString().replace('bigint', 'long')}, idx long, word string, last long, en double")


def _joined(words: DataFrame, taken: DataFrame) -> DataFrame:
    """words with the joins taken: a join's rows go in front of the words they cover, so that nothing is joined by a shuffle of all words."""
    new = taken.select("clip", "idx", F.col("word").alias("j_word"), "last", F.col("en").alias("j_en"))
    both = words.select(*COLUMNS).unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("clip").orderBy("idx", F.col("last").desc())  # a join, then the word it begins with
    since = lambda c: F.last(c, ignorenulls=True).over(w)
    seen = both.select("*", since("last").alias("until"), F.lag("j_word").over(w).alias("as_word"), F.lag("j_en").over(w).alias("as_en"))
    kept = seen.filter("last is null and (as_word is not null or until is null or idx > until)")
    return kept.select("clip", "idx", F.coalesce("as_word", "word").alias("word"), "st", F.coalesce("as_en", "en").alias("en"))


def without_stutters(words: DataFrame) -> DataFrame:
    """A word of two letters or more that repeats the last one is dropped, and the word kept lasts until it ends."""
    clean = F.lower(F.regexp_replace("word", "[^a-zA-Z]", ""))
    last = F.last(F.when(clean != "", clean), ignorenulls=True).over(by_clip().rowsBetween(Window.unboundedPreceding, -1))
    again = F.coalesce((clean == last) & (F.length(clean) >= 2), F.lit(False))
    marked = words.withColumn("kept", ~again).withColumn("g", F.sum(F.col("kept").cast("int")).over(by_clip()))
    return marked.groupBy("clip", "g").agg(F.min_by("word", "idx").alias("word"), F.min_by("st", "idx").alias("st"), F.max_by("en", "idx").alias("en"), F.min("idx").alias("idx")).select(*COLUMNS)


def lower_case(words: DataFrame) -> DataFrame:
    """Lower case, but for words of two capitals or more and no other letters."""
    return words.withColumn("word", F.when(F.regexp_replace("word", "[^A-Za-z]", "").rlike("^[A-Z]{2,}$"), F.col("word")).otherwise(F.lower("word")))


def moved_apostrophes(words: DataFrame) -> DataFrame:
    """An apostrophe behind punctuation that is a word of its own goes to the front of the next word."""
    w = F.trim("word")
    nxt = F.trim(F.lead("word").over(by_clip()))
    gives = w.rlike("^[.,?!:;]{1,2}'$") & F.coalesce(nxt.rlike(r"^\p{L}"), F.lit(False))
    marked = words.withColumn("gives", gives).withColumn("takes", F.coalesce(F.lag("gives").over(by_clip()), F.lit(False)))
    word = F.when(F.col("gives"), F.expr("left(trim(word), length(trim(word)) - 1)")).when(F.col("takes"), F.concat(F.lit("'"), w)).otherwise(F.col("word"))
    return marked.withColumn("word", word).select(*COLUMNS)


def _absorbing(words: DataFrame, find: Column, size: int, apart: int, word: Column) -> DataFrame:
    """Rows where find holds become word and take in the size - 1 rows behind them; finds that are ``apart`` rows apart overlap, and of a
    run of those every other one is taken. word may use lead columns named n1 ... (their words)."""
    ahead = [F.lead("word", k).over(by_clip()).alias(f"n{k}") for k in range(1, size)]
    seen = words.select(*COLUMNS, *ahead, F.lead("en", size - 1).over(by_clip()).alias("last"), F.row_number().over(by_clip()).alias("row"))
    seen = seen.withColumn("find", F.coalesce(find, F.lit(False)))
    lane = Window.partitionBy("clip", F.col("row") % apart).orderBy("row")
    since = F.coalesce(F.max(F.when(~F.col("find"), F.col("row"))).over(lane.rowsBetween(Window.unboundedPreceding, 0)), (F.col("row") - 1) % apart + 1 - apart)
    seen = seen.withColumn("taken", F.col("find") & (F.floor((F.col("row") - since) / apart) % 2 == 1))
    covered = F.lit(False)
    for k in range(1, size):
        covered = covered | F.coalesce(F.lag("taken", k).over(by_clip()), F.lit(False))
    kept = seen.withColumn("covered", covered).filter("not covered")
    return kept.select("clip", "idx", F.when(F.col("taken"), word).otherwise(F.col("word")).alias("word"), "st", F.when(F.col("taken"), F.col("last")).otherwise(F.col("en")).alias("en"))


def contractions(words: DataFrame) -> DataFrame:
    """"don" and "'t" as "don't", a lone "'" with the word behind it, and no blank before an apostrophe."""
    w, n = F.trim("word"), F.trim("n1")
    suffix = n.startswith("'") & F.length(n).between(2, 4) & ~w.endswith("'")
    lone = (w == "'") & (n != "") & ~n.startswith("'")
    out = _absorbing(words, suffix | lone, 2, 1, F.concat(w, n))
    return out.withColumn("word", F.regexp_replace(F.regexp_replace("word", r"(?U)(\w)\s+'(\w)", "$1'$2"), r"\s+'", "'"))


def digits(words: DataFrame) -> DataFrame:
    """Numbers up to 99 in digits, "twenty" and "one" as one word; punctuation behind them stays."""
    value = F.create_map(*[F.lit(x) for kv in SINGLE.items() for x in kv])
    clean = lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")
    tail = lambda x: F.regexp_extract(x, "[,.!?]+$", 0)
    a, b = clean(F.col("word")), clean(F.col("n1"))
    both = F.concat((F.element_at(value, a) + F.element_at(value, b)).cast("string"), tail(F.col("n1")))
    out = _absorbing(words, a.isin(TENS) & b.isin(ONES), 2, 1, both)
    one = F.element_at(value, clean(F.col("word")))
    return out.withColumn("word", F.when(one.isNotNull(), F.concat(one.cast("string"), tail(F.col("word")))).otherwise(F.col("word")))


def times_of_day(words: DataFrame) -> DataFrame:
    """"5" with "am", or with "a" and "m" and at most two words or dots between them, as "5AM"."""
    ahead = [F.lead("word", k).over(by_clip()).alias(f"n{k}") for k in range(1, 5)] + [F.lead("en", k).over(by_clip()).alias(f"e{k}") for k in range(1, 5)]
    seen = words.select(*COLUMNS, *ahead)
    half = F.lower(F.regexp_replace("n1", "[^A-Za-z]", ""))
    tok = lambda k: F.lower(F.trim(f"n{k}"))
    fine = lambda k: F.coalesce(tok(k).rlike(r"^([.,]|[a-z]+)$"), F.lit(False))
    far = F.lit(0)
    for k in (4, 3, 2):
        ok = F.lit(True)
        for i in range(2, k + 1):
            ok = ok & fine(i)
        far = F.when(ok & (tok(k) == "m"), k).otherwise(far)
    reach = F.when(half.isin("am", "pm"), 1).when(half.isin("a", "p") & (tok(1) == half), far).otherwise(0)
    reach = F.when(F.col("word").rlike(r"^[0-9]+[.,?!]*$"), F.coalesce(reach, F.lit(0))).otherwise(0)
    seen = seen.withColumn("reach", reach)
    covered = F.lit(False)
    for k in range(1, 5):
        covered = covered | (F.coalesce(F.lag("reach", k).over(by_clip()), F.lit(0)) >= k)
    word = F.concat(F.regexp_extract("word", "^[0-9]+", 0), F.upper(F.substring(half, 1, 1)), F.lit("M"), F.regexp_extract("word", "[.,?!]*$", 0))
    end = F.element_at(F.array("e1", "e2", "e3", "e4"), F.greatest(F.col("reach"), F.lit(1)))
    kept = seen.withColumn("covered", covered).filter("not covered")
    hit = F.col("reach") > 0
    return kept.select("clip", "idx", F.when(hit, word).otherwise(F.col("word")).alias("word"), "st", F.when(hit, end).otherwise(F.col("en")).alias("en"))


def _middle(c: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[.,!?]+$", "")


def half_for_both(words: DataFrame) -> DataFrame:
    """"5" "to" "9PM" as "5PM" "to" "9PM"."""
    seen = words.select(*COLUMNS, F.lead("word").over(by_clip()).alias("n1"), F.trim(F.lead("word", 2).over(by_clip())).alias("n2"))
    hit = F.trim("word").rlike("^[0-9]+$") & (_middle("n1") == "to") & F.col("n2").rlike("^[0-9]+(AM|PM|am|pm)[.,!?]*$")
    word = F.when(hit, F.concat(F.trim("word"), F.upper(F.regexp_extract("n2", "(?i)(am|pm)", 1)))).otherwise(F.col("word"))
    return seen.withColumn("word", word).select(*COLUMNS)


def ranges(words: DataFrame) -> DataFrame:
    """A number, "to" or "-" and a number as one word, with " to " between times of day and " - " between others."""
    w, n = F.trim("word"), F.trim("n2")
    find = w.rlike("^[0-9]") & _middle("n1").isin("to", "-") & n.rlike("^[0-9]")
    between = F.when(w.rlike("(?i)(am|pm)$") | n.rlike("(?i)(am|pm)"), " to ").otherwise(" - ")
    return _absorbing(words, find, 3, 2, F.concat(w, between, n))


def capitals(words: DataFrame, acronyms: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Acronyms in capitals, names with a capital."""
    bare = F.regexp_replace(F.lower("word"), "[^a-z]", "")
    part = lambda pattern, k: F.regexp_extract("word", pattern, k)
    first = "(?s)^([^a-zA-Z]*)([a-zA-Z]+)(.*)$"
    big = F.concat(part(first, 1), F.upper(part(first, 2)), part(first, 3))
    start = r"(?s)^(\P{L}*)(\p{L})(.*)$"
    named = F.concat(part(start, 1), F.upper(part(start, 2)), F.lower(part(start, 3)))
    out = words.withColumn("word", F.when(bare.isin(ACRONYMS if acronyms is None else acronyms), big).otherwise(F.col("word")))
    return out.withColumn("word", F.when(bare.isin(NAMES if names is None else names), named).otherwise(F.col("word")))


def repaired(words: DataFrame, zipf: DataFrame, passes: int = PASSES, parts: int | None = None) -> DataFrame:
    """All steps, one after the other."""
    out = joined_splits(words.select(*COLUMNS), zipf, passes, parts)
    for step in (without_stutters, lower_case, moved_apostrophes, contractions, digits, times_of_day, half_for_both, ranges, capitals):
        out = step(out)
    return out
