"""Caption text: ten ordered rules over the tokens of each text, with locks that keep what a rule has settled from those behind it.

A token is a row (id, k, text, trail, locked, spoken, lo, hi): its place, its core, the punctuation behind it, whether later rules may
touch it, whether it was said as number words, and the span of what it was made from. A rule sees its neighbours through window
functions over (id, k) and may take in the rows behind it; all rules share one partitioning and one order, so the whole pipeline is one
shuffle of the words and the texts' length costs rows, not memory of a Python worker. Number words are folded over one run of them.

Every rule that looks at neighbours looks for a digit, a number word or "grand". In texts without any (`_counts`) each token stands for
itself, so ``formatted`` gives them their caption where they are read, without a row or a shuffle for each word.

Rules, in order: misspellings, dictionary, number words, "one" or "1", labels ("step #1"), money, symbols and multipliers, thousands,
capitals, punctuation. Numbers beyond a long stay as they were said.

Cases: a null text, or one of blanks, gives ''; tokens are what stands between single blanks; rows that repeat an id are told apart by
the caller's id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanloom.functions import numbers as nb

# fixed values: the vocabulary of the rules
ONES = {w: i for i, w in enumerate(nb.ONES)}
TENS = {w: 10 * i for i, w in enumerate(nb.TENS) if w}
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
BIG = ["thousand", "million", "billion", "trillion"]
DICTIONARY = {"company.com": "company.com", "ai": "AI", "roi": "ROI", "cac": "CAC", "ltv": "LTV", "ebitda": "EBITDA", "kpi": "KPI", "kpis": "KPIs", "cta": "CTA", "ctas": "CTAs", "b2b": "B2B", "b2c": "B2C", "ceo": "CEO", "cfo": "CFO", "sop": "SOP", "sops": "SOPs", "u.s.": "U.S.", "youtube": "YouTube", "tiktok": "TikTok", "linkedin": "LinkedIn"}
ACRONYMS = ["AI", "ROI", "CEO", "CFO", "SOP", "CAC", "LTV", "EBITDA", "KPI", "KPIs", "CTA", "CTAs", "B2B", "B2C", "CRM", "MRR", "ARR", "AOV"]
PROPER = ["company.com", "U.S.", "Gandhi", "Elon", "Musk", "Warren", "Buffett", "Vegas", "Amazon", "Netflix", "Google", "Mr", "MrBeast", "Beast", "Roy", "Sutherland", "IRL", "UK", "I"]
ABBREVIATED = ["etc.", "e.g.", "i.e.", "etc", "e.g", "i.e"]
I_FORMS = ["i", "i'm", "i'll", "i'd", "i've"]
UNITS = {"k": "K", "mil": "M", "m": "M"}
RATES = ["hour", "day", "week", "month", "quarter", "year"]
COUNTED = ["year", "years", "month", "months", "week", "weeks", "day", "days", "hour", "hours", "minute", "minutes", "point", "points", "people", "person", "customer", "customers", "client", "clients", "editor", "editors", "employee", "employees", "rep", "reps", "user", "users", "member", "members"]
TRIGGERS = ["money", "cash", "cashflow", "revenue", "profit", "ebitda", "pricing", "price", "cost", "costs", "salary", "fee", "fees", "charge", "charges", "charging", "charged", "budget", "expense", "expenses", "income", "earnings", "wage", "wages", "raise", "rate", "rates"]
LABELS_HASH = ["step", "tip", "rule", "law", "point", "reason", "principle", "habit", "mistake", "tactic", "strategy", "lesson", "factor", "secret", "key"]
LABELS_PLAIN = ["day", "week", "month", "round", "level", "season"]
FORMATTED = [r"\$[0-9]{1,3}(,[0-9]{3})*", r"\$[0-9]+(\.[0-9]+)?[KM]", r"\$[0-9]+(\.[0-9]+)?( Billion| Trillion)", r"\$[0-9]+(\.[0-9]+)?", r"[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?X('?\w*)?", r"[0-9]+%", r"#[0-9]+", r"etc\.|e\.g\.|i\.e\.", r"([A-Z]\.){2,}"]
AMOUNT = r"^(\S+\s+)?\$([0-9]+(?:\.[0-9]+)?)\z"
GLUED = r"^\S+\s+\$[0-9]+(?:\.[0-9]+)?(?:[KM]| Billion| Trillion)\z"
INTEGER = r"^([0-9]{1,3}(,[0-9]{3})*|[0-9]+)\z"
QUANTITY = r"^([0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?|[0-9]+(\.[0-9]+)?)\z"

NUMBERS = ONES | TENS | SCALES
FIELDS = ["id", "k", "text", "trail", "locked", "spoken", "lo", "hi"]


def _w() -> WindowSpec:
    return Window.partitionBy("id").orderBy("k")


def _at(c: str, n: int) -> Column:
    return (F.lead(c, n) if n > 0 else F.lag(c, -n)).over(_w())


def _sql(x: str | int) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(values: dict) -> Column:
    """A map of constants, in one expression."""
    return F.expr(f"map({', '.join(_sql(x) for kv in values.items() for x in kv)})")


def _in(x: Column, names: list[str]) -> Column:
    """Whether x is one of the names; null if x is."""
    return F.array_contains(F.expr(f"array({', '.join(map(_sql, names))})"), x)


def _is(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _int(x: Column) -> Column:
    return F.when(x.rlike(INTEGER), F.regexp_replace(x, ",", "").try_cast("bigint"))


def _ahead(df: DataFrame, n: int, back: bool = False) -> DataFrame:
    """df with low, and for each of the next n rows its text (t1 ...), lower case (l1 ...), trail, lock and end; with back, t0, l0, o0 and the start h0 of the row before."""
    df = df.withColumn("low", F.lower("text"))
    cols = {}
    for k in range(1, n + 1):
        cols |= {f"z{k}": F.lead(F.struct("text", "low", "trail", "locked", "hi"), k).over(_w())}
    if back:
        cols |= {"z0": F.lag(F.struct("text", "low", "locked", "lo"), 1).over(_w())}
    df = df.withColumns(cols)
    out = [c for c in df.columns if c not in cols]
    for k in range(1, n + 1):
        z = F.col(f"z{k}")
        out += [z["text"].alias(f"t{k}"), z["low"].alias(f"l{k}"), z["trail"].alias(f"r{k}"), F.coalesce(z["locked"], F.lit(True)).alias(f"o{k}"), z["hi"].alias(f"h{k}")]
    if back:
        z = F.col("z0")
        out += [z["text"].alias("t0"), z["low"].alias("l0"), F.coalesce(z["locked"], F.lit(True)).alias("o0"), z["lo"].alias("h0")]
    return df.select(*out)


def _take(df: DataFrame, n: Column, most: int, text: Column, locked: bool = True, keep_trail: bool = False, spoken: bool = False) -> DataFrame:
    """Rows where n isn't null become text and take in the next n rows. Rows that take others in must not overlap."""
    seen = df.withColumns({"n": n, "new": text})
    covered = F.lit(False)
    for k in range(1, most + 1):
        covered = covered | _is(_at("n", k * -1) >= k)
    trail, hi = F.col("trail"), F.col("hi")
    for k in range(1, most + 1):
        last = F.when(F.col(f"r{k}") != "", F.col(f"r{k}")).otherwise(F.col("trail")) if keep_trail else F.col(f"r{k}")
        trail, hi = F.when(F.col("n") == k, last).otherwise(trail), F.when(F.col("n") == k, F.col(f"h{k}")).otherwise(hi)
    hit = F.col("n").isNotNull()
    kept = seen.withColumn("covered", covered).filter("not covered")
    spoke = F.when(hit, spoken).otherwise(F.col("spoken")) if not locked else F.col("spoken")
    return kept.select("id", "k", F.when(hit, F.col("new")).otherwise(F.col("text")).alias("text"), trail.alias("trail"), (F.col("locked") | hit if locked else F.col("locked")).alias("locked"), spoke.alias("spoken"), "lo", hi.alias("hi"))


def _parted(word: Column) -> tuple[Column, Column]:
    """Core and trail of a word: punctuation behind the core apart, quotes and brackets before it dropped."""
    bare = F.regexp_replace(F.lower(word), r"[,?!]+\z", "")
    kept = bare.isin("etc.", "e.g.", "i.e.", "u.s.") | bare.rlike(r"^(?:[a-z]\.){2,}\z") | bare.rlike(r"[a-z0-9]\.[a-z]{2,}\z")
    trail = F.when(kept, F.regexp_extract(word, r"[,?!]+\z", 0)).otherwise(F.regexp_extract(word, r"[,.?!]+\z", 0))
    core = F.regexp_replace(F.when(kept, F.regexp_replace(word, r"[,?!]+\z", "")).otherwise(F.regexp_replace(word, r"[,.?!]+\z", "")), r"^[\"'(\[]+", "")
    return core, trail


def tokens(words: DataFrame) -> DataFrame:
    """words (id, k, word, lo, hi) as tokens."""
    core, trail = _parted(F.col("word"))
    return words.select("id", "k", core.alias("text"), trail.alias("trail"), F.lit(False).alias("locked"), F.lit(False).alias("spoken"), "lo", "hi")


def _spelled(text: Column, known: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(_map(known), F.lower(text)), text) if known else text


def misspellings(df: DataFrame, known: dict[str, str]) -> DataFrame:
    return df.withColumn("text", _spelled(F.col("text"), known))


def _formed(text: Column, amount: Column | None = None) -> Column:
    """Whether text has its final form; an amount with a scale behind it has not."""
    form = text.rlike("(?U)^(?:" + "|".join(FORMATTED) + r")\z")
    return _in(text, [*ACRONYMS, "1-on-1"]) | (form if amount is None else form & ~amount) | text.rlike(GLUED)


def dictionary(df: DataFrame) -> DataFrame:
    """Phrases first (of those that overlap, from the left), then single entries; what already has its final form is locked."""
    t = _ahead(df, 2).withColumn("row", F.row_number().over(_w()))
    t = t.withColumn("find", _is((F.col("low") == "one") & (F.col("l1") == "on") & (F.col("l2") == "one")))
    lane = Window.partitionBy("id", F.col("row") % 2).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    since = F.coalesce(F.max(F.when(~F.col("find"), F.col("row"))).over(lane), (F.col("row") - 1) % 2 - 1)
    t = _take(t, F.when(F.col("find") & (F.floor((F.col("row") - since) / 2) % 2 == 1), 2), 2, F.lit("1-on-1"))
    t = _ahead(t, 1, back=True)
    shot = _is((F.col("low") == "one") & (F.col("l1") == "shot") & ~F.col("locked"))
    shot2 = _is((F.col("low") == "shot") & (F.col("l0") == "one") & ~F.col("o0"))
    entry = F.when(~F.col("locked"), F.element_at(_map(DICTIONARY), F.col("low")))
    amount = F.col("text").rlike(AMOUNT) & _is(_in(F.col("l1"), list(SCALES)))
    text = F.when(shot | shot2, F.col("low")).otherwise(F.coalesce(entry, "text"))
    return t.select("id", "k", text.alias("text"), F.when(shot, "").otherwise(F.col("trail")).alias("trail"), (F.col("locked") | shot | shot2 | entry.isNotNull() | _formed(F.col("text"), amount)).alias("locked"), "spoken", "lo", "hi")


def _worth(words: Column) -> Column:
    """The value of number words (low, digits) said one after the other."""
    valued = F.transform(words, lambda x: F.struct(x["digits"].alias("digits"), F.coalesce(x["digits"], F.element_at(_map(NUMBERS), x["low"]).cast("bigint")).alias("v")))
    some = lambda c: F.when(c == 0, F.lit(1).cast("bigint")).otherwise(c)
    zero = F.lit(0).cast("bigint")

    def step(s: Column, x: Column) -> Column:
        v = x["v"]
        plain = x["digits"].isNotNull() | (v < 100)
        cur = F.when(plain, F.try_add(s["cur"], v)).when(v == 100, F.try_multiply(some(s["cur"]), F.lit(100).cast("bigint"))).otherwise(zero)
        total = F.when(plain | (v == 100), s["total"]).otherwise(F.try_add(s["total"], F.try_multiply(some(s["cur"]), v)))
        return F.struct(total.alias("total"), cur.alias("cur"))

    return F.aggregate(valued, F.struct(zero.alias("total"), zero.alias("cur")), step, lambda s: F.try_add(s["total"], s["cur"]))


def number_words(df: DataFrame) -> DataFrame:
    """Runs of number words, or of digits and scales, as digits. A lone "one", "zero" before others, and a scale behind "$N" stay words."""
    t = _ahead(df, 1, back=True)
    word = ~F.col("locked") & _in(F.col("low"), list(NUMBERS))
    scale_next = _is(~F.col("o1") & _in(F.col("l1"), list(SCALES)))
    digits = F.when(~F.col("locked") & scale_next, _int(F.col("text")))
    t = t.withColumns({"word": word, "digits": digits})
    starts = F.col("word") & (F.col("low") != "zero") & ((F.col("low") != "one") | scale_next) & ~(_in(F.col("low"), list(SCALES)) & _is(F.col("t0").rlike(AMOUNT)))
    t = t.withColumns({"starts": starts, "b": F.count_if(~F.col("word")).over(_w())})
    whole = Window.partitionBy("id", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.when(F.max("digits").over(whole).isNotNull(), F.lit(-1)).otherwise(F.min(F.when(F.col("starts"), F.col("k"))).over(whole))
    t = t.withColumn("run", _is(F.col("digits").isNotNull() | (F.col("word") & (F.col("k") >= first))))
    held = F.collect_list(F.when(F.col("run"), F.struct("low", "digits"))).over(whole)
    t = t.withColumn("value", F.when(F.col("run"), _worth(held)))
    mine = F.col("value").isNotNull()
    t = t.withColumns({"k0": F.min(F.when(mine, F.col("k"))).over(whole), "end": F.max(F.when(mine, F.col("hi"))).over(whole), "tail": F.last(F.when(mine, F.col("trail")), ignorenulls=True).over(whole)})
    t = t.filter(~mine | (F.col("k") == F.col("k0")))
    one = lambda new, old: F.when(mine, new).otherwise(F.col(old)).alias(old)
    return t.select("id", "k", one(F.col("value").cast("string"), "text"), one(F.col("tail"), "trail"), "locked", one(F.lit(True), "spoken"), "lo", one(F.col("end"), "hi"))


def one_or_digit(df: DataFrame) -> DataFrame:
    """"one" before money or another number as a digit; else it stays a word."""
    t = _ahead(df, 1)
    digit = ~F.col("locked") & (F.col("low") == "one") & _is(_in(F.col("l1"), ["dollar", "dollars", "grand", *NUMBERS]) | F.col("t1").rlike(INTEGER))
    return t.select("id", "k", F.when(digit, "1").otherwise(F.col("text")).alias("text"), "trail", "locked", "spoken", "lo", "hi")


def labels(df: DataFrame) -> DataFrame:
    """"number two" as "#2"; "step one" as "step #1", "day one" as "day 1"."""
    value = lambda t, l: F.coalesce(_int(t), F.element_at(_map(ONES), l).cast("bigint"))
    t = _ahead(df, 1)
    hit = ~F.col("locked") & (F.col("low") == "number") & value(F.col("t1"), F.col("l1")).isNotNull()
    t = _ahead(_take(t, F.when(hit, 1), 1, F.concat(F.lit("#"), value(F.col("t1"), F.col("l1")).cast("string"))), 1, back=True)
    own = value(F.col("text"), F.col("low")).cast("string")
    behind = lambda names: _is(~F.col("o0") & _in(F.col("l0"), names)) & own.isNotNull()
    text = F.when(behind(LABELS_HASH), F.concat(F.lit("#"), own)).when(behind(LABELS_PLAIN), own).otherwise(F.col("text"))
    return t.select("id", "k", text.alias("text"), "trail", (F.col("locked") | behind(LABELS_HASH + LABELS_PLAIN)).alias("locked"), "spoken", "lo", "hi")


def _short(x: Column) -> Column:
    """A number with at most one decimal, which isn't 0."""
    return F.regexp_replace(F.format_string("%.1f", F.bround(x, 1)), r"\.0\z", "")


def dollars(v: Column) -> Column:
    """A whole amount as captions show it: $500, $5,000, $50K, $2M, $2 Billion."""
    part = lambda n, mark: F.concat(F.lit("$"), _short(v / n), F.lit(mark))
    small = F.concat(F.lit("$"), F.format_number(v, 0))
    return F.when(v < 20_000, small).when(v < 10**6, part(1000, "K")).when(v < 10**9, part(10**6, "M")).when(v < 10**12, part(10**9, " Billion")).otherwise(part(10**12, " Trillion"))


def _kilo(x: Column) -> Column:
    return F.when(x.rlike(r"^\$?[0-9]+k\z"), F.try_multiply(F.regexp_extract(x, "[0-9]+", 0).try_cast("bigint"), F.lit(1000).cast("bigint")))


def _amount(value: Column, kilo: Column) -> Column:
    return F.when(kilo.isNotNull() & value.between(1000, 19_999), F.concat(F.lit("$"), _short(value / 1000), F.lit("K"))).otherwise(dollars(value))


def _quantity(x: Column) -> Column:
    """A plain number without commas and idle zeros, as text."""
    plain = F.regexp_replace(x, ",", "")
    whole = F.regexp_replace(F.regexp_extract(plain, "^[0-9]+", 0), "^0+(?=[0-9])", "")
    frac = F.regexp_replace(F.regexp_extract(plain, r"\.([0-9]+)\z", 1), r"0+\z", "")
    return F.when(x.rlike(QUANTITY), F.when(frac == "", F.when(plain.contains("."), F.regexp_extract(plain, "^[0-9]+", 0)).otherwise(whole)).otherwise(F.concat(F.regexp_extract(plain, "^[0-9]+", 0), F.lit("."), frac)))


def money(df: DataFrame) -> DataFrame:
    """Amounts: fractions before a unit, dollars, "$N" with a scale, shorthand units, grands, and what the context makes money."""
    # "three and a half mil"
    t = _ahead(df, 4)
    base = F.when(~F.col("locked"), _int(F.col("text")))
    half = (F.col("l1") == "and") & (F.col("l2") == "a") & F.col("l3").isin("half", "quarter") & F.col("l4").isin("k", "mil", "m", "grand") & ~F.col("o1") & ~F.col("o2") & ~F.col("o3")
    t = _take(t, F.when(base.isNotNull() & _is(half), 3), 3, F.concat(base.cast("string"), F.when(F.col("l3") == "half", ".5").otherwise(".25")), locked=False, spoken=True)

    # dollars, and scales behind "$N"
    t = _ahead(t, 1)
    free = ~F.col("locked")
    named = _is(F.col("l1").isin("dollar", "dollars"))
    kilo = _kilo(F.col("low"))
    value = F.coalesce(_int(F.col("text")), kilo)
    scaled = F.col("text").rlike(AMOUNT) & _is(_in(F.col("l1"), BIG))
    times = F.element_at(_map({k: SCALES[k] for k in BIG}), F.col("l1"))
    folded = (F.regexp_extract("text", AMOUNT, 2).try_cast("decimal(24,6)") * times.cast("decimal(13,0)")).cast("decimal(38,0)").try_cast("bigint")
    n = F.when(free & (((F.col("low") == "zero") & named) | (scaled & folded.isNotNull()) | (value.isNotNull() & named)), 1)
    text = F.when((F.col("low") == "zero") & named, "$0").when(scaled, F.concat(F.regexp_extract("text", AMOUNT, 1), dollars(folded))).otherwise(_amount(value, F.when(_int(F.col("text")).isNull(), kilo)))
    t = _take(t, n, 1, text)

    # "50 k", "3 mil", and "1.5 grand"
    t = _ahead(t, 1)
    q = _quantity(F.col("text"))
    short = _is(_in(F.col("l1"), list(UNITS)) & ~F.col("o1"))
    grand = _is((F.col("l1") == "grand") & ~F.col("o1")) & q.contains(".")
    t = _take(t, F.when(~F.col("locked") & q.isNotNull() & (short | grand), 1), 1, F.concat(F.lit("$"), q, F.when(short, F.element_at(_map(UNITS), F.col("l1"))).otherwise("K")), keep_trail=True)

    # grands: "a grand", "five grand", "a hundred grand"
    t = _ahead(t, 2, back=True)
    counted = lambda tx, lo: F.coalesce(_int(tx), F.when(lo.isin("a", "one"), F.lit(1)).otherwise(F.element_at(_map(ONES), lo)).cast("bigint"))
    is_grand = lambda k: _is((F.col(f"l{k}") == "grand") & ~F.col(f"o{k}"))
    own, nxt = counted(F.col("text"), F.col("low")), counted(F.col("t1"), F.col("l1"))
    article = F.col("low").isin("a", "an") & ~F.col("locked") & nxt.isNotNull() & ~F.col("o1") & is_grand(2)
    before = _is(F.col("l0").isin("a", "an") & ~F.col("o0"))
    direct = own.isNotNull() & ~F.col("locked") & is_grand(1) & ~before
    alone = (F.col("low") == "grand") & ~F.col("locked") & ~_is(counted(F.col("t0"), F.col("l0")).isNotNull() & ~F.col("o0"))
    many = F.try_multiply(F.when(article, nxt).when(direct, own).otherwise(F.lit(1).cast("bigint")), F.lit(1000).cast("bigint"))
    t = _take(t, F.when(article, 2).when(direct, 1).when(alone, 0), 2, dollars(many))
    return _implied(t)


def _implied(df: DataFrame) -> DataFrame:
    """Bare numbers that the context makes money: a rate behind them, their size, or a word about money nearby."""
    t = _ahead(df, 2, back=True)
    kilo = F.when(_int(F.col("text")).isNull(), _kilo(F.col("low")))
    core = F.regexp_replace("low", r"^[.,!?]+|[.,!?]+\z", "")
    about = (_in(core, TRIGGERS) | core.startswith("charg")).cast("int")
    t = t.withColumns({"value": F.when(~F.col("locked"), F.coalesce(_int(F.col("text")), kilo)), "kilo": kilo, "about": about, "full": (F.col("text") != "").cast("int")})
    around = F.sum("about").over(_w().rowsBetween(-8, 3)) - F.col("about") > 0
    alone = F.sum("full").over(Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1
    v = F.col("value")
    year = ~F.col("spoken") & F.col("text").rlike(r"^[0-9]{4}\z") & v.between(1900, 2099)
    rate = _is(F.col("l1").isin("a", "an") & _in(F.col("l2"), RATES))
    counts = _is(_in(F.col("l1"), COUNTED))
    large = (v >= 100_000_000) & ~(alone & _int(F.col("text")).isNotNull())
    said = around & (v >= 1000)
    t = t.withColumns({"rate": rate, "large": large, "said": said, "pays": v.isNotNull() & ~counts & ~year & (rate | large | said)})
    last = F.col("t1").isNull() | F.col("trail").rlike("[.?!]")
    article = _is(F.col("l0").isin("a", "an") & ~F.col("o0"))
    drops = F.col("pays") & article & (F.col("rate") | (~F.col("large") & F.col("said") & last))
    t = t.withColumn("drops", drops).withColumn("gone", _is(_at("drops", 1))).filter("not gone")
    text = F.when(F.col("pays"), _amount(v, F.col("kilo"))).otherwise(F.col("text"))
    return t.select("id", "k", text.alias("text"), "trail", (F.col("locked") | F.col("pays")).alias("locked"), "spoken", F.when(F.col("drops"), F.col("h0")).otherwise(F.col("lo")).alias("lo"), "hi")


def symbols(df: DataFrame) -> DataFrame:
    """Percent signs, "$0" and multipliers: "50 percent" as 50%, "five times" as 5X, 10x as 10X."""
    t = _ahead(df, 1)
    v, free = _int(F.col("text")), ~F.col("locked")
    zero = F.col("low") == "zero"
    shown = F.when(F.col("spoken") & (v >= 1000), F.format_number(v, 0)).otherwise(v.cast("string"))
    open_ = ~F.col("o1")
    percent = _is((F.col("l1").isin("percent", "percentage") | (F.col("t1") == "%")) & open_)
    null = _is((F.col("t1") == "$") & open_) & zero
    times = _is((F.col("l1") == "times") & open_) & v.isNotNull()
    n = F.when(free & ((percent & (v.isNotNull() | zero)) | null | times), 1)
    text = F.when(null, "$0").when(percent & zero, "0%").when(percent, F.concat(shown, F.lit("%"))).otherwise(F.concat(shown, F.lit("X")))
    t = _take(t, n, 1, text, keep_trail=True)
    many = ~F.col("locked") & F.lower("text").rlike(r"(?U)^[0-9]+x'?\w*\z")
    t = t.withColumn("many", many)
    return t.select("id", "k", F.when(F.col("many"), F.regexp_replace("text", "^([0-9]+)[xX]", "$1X")).otherwise(F.col("text")).alias("text"), "trail", (F.col("locked") | F.col("many")).alias("locked"), "spoken", "lo", "hi")


def _cased(text: Column, low: Column) -> Column:
    """"I", abbreviations, acronyms and names as they are written, all else small; low is text in lower case."""
    canon = _map({w.lower(): w for w in PROPER})
    big_i = F.concat(F.lit("I"), F.substring(low, 2, 2**31 - 1))
    owner = F.element_at(canon, F.regexp_extract(low, r"^(.*)['’]s\z", 1))

    def piece(p: Column) -> Column:
        at = lambda n: F.regexp_extract(p, r"(?Us)^(\W*)(.*?)(\W*)\z", n)
        mid = F.lower(at(2))
        named = F.coalesce(F.element_at(canon, mid), F.when(_in(mid, I_FORMS), F.concat(F.lit("I"), F.substring(mid, 2, 9))))
        return F.struct(F.coalesce(F.concat(at(1), named, at(3)), F.lower(p)).alias("text"), named.isNotNull().alias("hit"))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(r"[ \-]|[^ \-]+"), F.lit(0)), piece)
    compound = F.when(text.rlike(r"[ \-]") & F.exists(pieces, lambda p: p["hit"]), F.array_join(F.transform(pieces, lambda p: p["text"]), ""))
    fixed = F.when(_in(low, I_FORMS), big_i).when(_in(low, ABBREVIATED), low).when(_in(text, ACRONYMS + PROPER), text)
    return fixed.otherwise(F.coalesce(F.element_at(canon, low), F.concat(owner, F.lit("'s")), compound, low))


def capitals(df: DataFrame) -> DataFrame:
    """Thousands of spoken numbers, then case."""
    v = F.when(F.col("spoken") & F.col("text").rlike(r"^[0-9]+\z"), F.col("text").try_cast("bigint"))
    t = df.withColumn("text", F.when(~F.col("locked") & (v >= 1000), F.format_number(v, 0)).otherwise(F.col("text"))).withColumn("low", F.lower("text"))
    return t.withColumn("text", F.when(F.col("locked"), F.col("text")).otherwise(_cased(F.col("text"), F.col("low")))).select(*FIELDS)


def _counts(text: Column, known: dict[str, str]) -> Column:
    """Whether text, words between single blanks, holds a digit, a number word or "grand", or what is a misspelling of one."""
    names = [*NUMBERS, "grand"]
    names += [re.escape(k) for k, v in known.items() if v.lower() in names or re.search("[0-9]", v)]
    return F.lower(text).rlike(r"[0-9]|(?:^| )[\"'(\[]*(?:" + "|".join(names) + r")[,.?!]*(?: |\z)")


def _shown(text: Column, trail: Column) -> Column:
    return F.concat(text, F.regexp_replace(trail, "[^?!]", ""))


def _alone(text: Column, low: Column) -> Column:
    """What the rules make of a token (low: its lower case) where nothing counts: an entry, a form that is final, or its case."""
    return F.coalesce(F.element_at(_map(DICTIONARY), low), F.when(_formed(text), text).otherwise(_cased(text, low)))


def _ruled(words: DataFrame, known: dict[str, str]) -> DataFrame:
    t = misspellings(tokens(words), known)
    for rule in (dictionary, number_words, one_or_digit, labels, money, symbols, capitals):
        t = rule(t)
    return t.select("id", "k", _shown(F.col("text"), F.col("trail")).alias("word"), "lo", "hi").filter("word <> ''")


def ruled(words: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """id, k, word, lo, hi: the words (id, k, word, lo, hi) after all rules; merged ones span what they were made from."""
    known = known or {}
    w = words.withColumn("some", F.max(_counts(F.col("word"), known)).over(Window.partitionBy("id")))
    past = misspellings(tokens(w.filter("not some")), known).withColumn("low", F.lower("text"))
    past = past.select("id", "k", _shown(_alone(F.col("text"), F.col("low")), F.col("trail")).alias("word"), "lo", "hi").filter("word <> ''")
    return past.unionByName(_ruled(w.filter("some").drop("some"), known))


def _plain(text: Column, known: dict[str, str]) -> Column:
    """The caption of a text where nothing counts. Words of letters alone that no list names are small, without a look at the rules."""
    listed = sorted({w.lower() for w in [*DICTIONARY, *ACRONYMS, *PROPER, *ABBREVIATED, *I_FORMS, *known]})

    def small(w: Column) -> Column:
        low = F.lower(F.rtrim(w, F.lit(",.")))
        return F.struct(w.alias("word"), F.when(w.rlike(r"^\p{L}+[,.]*\z") & ~low.isin(listed), low).alias("done"))

    def token(x: Column) -> Column:
        core, trail = _parted(x["word"])
        return F.struct(x["done"].alias("done"), F.when(x["done"].isNull(), F.struct(_spelled(core, known).alias("text"), trail.alias("trail"))).alias("t"))

    words = F.transform(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), small), token)
    words = F.transform(words, lambda x: F.struct(x["done"].alias("done"), x["t"].alias("t"), F.lower(x["t"]["text"]).alias("low")))
    words = F.transform(words, lambda x: F.coalesce(x["done"], _shown(_alone(x["t"]["text"], x["low"]), x["t"]["trail"])))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def formatted(texts: DataFrame, id_col: str, text_col: str, known: dict[str, str] | None = None) -> DataFrame:
    """id_col and caption: each text after all rules. Only texts where something counts are dealt out, word by word."""
    known = known or {}
    said = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    rest = texts.filter(~_counts(said, known)).select(id_col, trimmed(_plain(said, known)).alias("caption"))
    some = texts.filter(_counts(said, known)).select(F.col(id_col).alias("id"), said.alias("text"))
    words = some.select("id", F.posexplode(F.split("text", " ")).alias("k", "word")).filter("word <> ''").withColumns({"lo": F.col("k"), "hi": F.col("k")})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    each = _ruled(words, known).groupBy("id").agg(trimmed(joined).alias("caption"))
    each = some.select("id").join(each, "id", "left").select(F.col("id").alias(id_col), F.coalesce("caption", F.lit("")).alias("caption"))
    return rest.unionByName(each)
