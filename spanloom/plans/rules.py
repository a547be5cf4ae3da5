"""Rule sets: unions of rule queries over timed words and spans, each issue one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import intervals as iv
from spanloom.sources.tables import SPANS, WORDS, spans, words

from .registry import query

# fixed values, as in functions.text: fillers and connectors, words that no sentence ends on, and those that a clause goes on after
FILL_SQL = "'uh', 'um', 'uhh', 'umm', 'mm', 'hmm', 'er', 'ah', 'mhm', 'uhm'"
CONN_SQL = "'and', 'but', 'so', 'or', 'well', 'like', 'now', 'okay', 'right', 'because', 'cause', 'which', 'yeah', 'yes', 'no'"
WEAK = ["the", "a", "an", "of", "for", "in", "on", "at", "to", "with", "from", "by", "is", "was", "are", "were", "been", "be", "my", "your", "his", "her", "their", "our", "its", "if", "when", "where", "while", "who", "what", "how", "that"]
WEAK_SQL = "'the', 'a', 'an', 'of', 'for', 'in', 'on', 'at', 'to', 'with', 'from', 'by', 'is', 'was', 'are', 'were', 'been', 'be', 'my', 'your', 'his', 'her', 'their', 'our', 'its', 'if', 'when', 'where', 'while', 'who', 'what', 'how', 'that'"
MIDCLAUSE = ["and", "but", "or", "so", "because", "the", "a", "an", "to", "of", "that", "which", "as", "than", "then", "into", "very", "my", "your", "his", "her", "their", "our", "its", "is", "was", "are", "were", "been", "be", "am", "if", "while", "whose", "until", "unless", "whether", "whereas", "although", "nor", "upon"]
MIDCLAUSE_SQL = "'and', 'but', 'or', 'so', 'because', 'the', 'a', 'an', 'to', 'of', 'that', 'which', 'as', 'than', 'then', 'into', 'very', 'my', 'your', 'his', 'her', 'their', 'our', 'its', 'is', 'was', 'are', 'were', 'been', 'be', 'am', 'if', 'while', 'whose', 'until', 'unless', 'whether', 'whereas', 'although', 'nor', 'upon'"
NEXT_TURN = r"\b(how|what|why|describe|tell me|so how|and your|and what|number one takeaway|did you|was it|gotcha|awesome|perfect|cool|great|thank|sweet|nice|love it|got it|amazing|wonderful|let's|next question|moving on)\b"
NEXT_TURN_SQL = NEXT_TURN.replace("'", "''")

BARE = "regexp_replace(lower(word), '[^a-z0-9'']', '', 'g')"
LOW = "regexp_replace(lower(word), '[^a-z'']', '', 'g')"
ENDS = r"regexp_matches(trim(word), '[.!?][\"'')\]]*$')"
#: Numbered content words of each chunk (a turn), with whether each ends a sentence. A chunk's window reaches into the next turn for every third one.
CHUNKS = f"""{WORDS}, ch AS (SELECT clip, turn, idx, word, {LOW} AS low, st, en, row_number() OVER c AS i, count(*) OVER (PARTITION BY clip, turn) AS n, {ENDS} AS ends, lead(st) OVER c AS next_st FROM words WHERE {BARE} <> '' AND {BARE} NOT IN ({FILL_SQL}) WINDOW c AS (PARTITION BY clip, turn ORDER BY idx)),
win AS (SELECT clip, turn, min(st) AS lo, max(en) + CASE WHEN turn % 3 = 0 THEN 1300 ELSE 0 END AS hi FROM words GROUP BY clip, turn)"""


def chunks(spark, d) -> DataFrame:
    w = Window.partitionBy("clip", "turn")
    by = w.orderBy("idx")
    return words(spark, d).filter(tx.is_content("word")).select("clip", "turn", "idx", "word", tx.letters("word").alias("low"), "st", "en", F.row_number().over(by).alias("i"), F.count("*").over(w).alias("n"), tx.ends_sentence("word").alias("ends"), F.lead("st").over(by).alias("next_st"))


def windows(spark, d) -> DataFrame:
    reach = F.when(F.col("turn") % 3 == 0, 1300.0).otherwise(0.0)
    return words(spark, d).groupBy("clip", "turn").agg(F.min("st").alias("lo"), F.max("en").alias("hi")).withColumn("hi", F.col("hi") + reach)


@query(f"WITH {CHUNKS}, f AS (SELECT clip, turn, min(idx) AS idx FROM ch WHERE n >= 3 AND i <= 3 AND ends GROUP BY clip, turn) SELECT f.clip, f.turn, 'LEADING_ORPHAN' AS rule, coalesce(ch.next_st - 0.10::double, win.lo) AS fix FROM f JOIN ch ON ch.clip = f.clip AND ch.idx = f.idx JOIN win ON win.clip = f.clip AND win.turn = f.turn")
def leading_orphan(spark, d):
    """Chunks that open on the end of a sentence: it ends within their first three content words."""
    c = chunks(spark, d).filter("n >= 3 and i <= 3 and ends")
    first = c.groupBy("clip", "turn").agg(F.min_by(F.struct("next_st"), "idx").alias("f"))
    fix = F.coalesce(F.col("f.next_st") - 0.10, F.col("lo"))
    return first.join(windows(spark, d), ["clip", "turn"]).select("clip", "turn", F.lit("LEADING_ORPHAN").alias("rule"), fix.alias("fix"))


@query(f"WITH {CHUNKS}, l AS (SELECT clip, turn, n, max(i) FILTER (ends) AS last, max_by(en, i) FILTER (ends) AS e FROM ch GROUP BY ALL) SELECT clip, turn, 'TRAILING_ORPHAN' AS rule, e + 0.15::double AS fix FROM l WHERE n >= 3 AND n - last >= 2")
def trailing_orphan(spark, d):
    """Chunks that go on for two content words at least after their last sentence."""
    ends = F.when(F.col("ends"), F.col("i"))
    l = chunks(spark, d).groupBy("clip", "turn", "n").agg(F.max(ends).alias("last"), F.max_by("en", ends).alias("e"))
    return l.filter("n >= 3 and n - last >= 2").select("clip", "turn", F.lit("TRAILING_ORPHAN").alias("rule"), (F.col("e") + 0.15).alias("fix"))


@query(f"WITH {CHUNKS} SELECT clip, turn, st FROM ch WHERE i = 1 AND low IN ({CONN_SQL})")
def opener_dirty(spark, d):
    return chunks(spark, d).filter((F.col("i") == 1) & tx.is_connector("word")).select("clip", "turn", "st")


def completeness(word: Column, low: Column, following: Column) -> Column:
    """Why a sentence is over with word, or isn't; following: the words after it, null or empty at the end."""
    text = F.array_join(F.slice(following, 1, 15), " ")
    fresh = F.get(following, F.lit(0)).rlike(r"^\s*\p{Lu}")
    turn = F.lower(text).rlike(tx.ascii_edges(NEXT_TURN)) | F.contains(text, F.lit("?"))
    return F.when(word.rlike("[.!?][\"')\\]]*\\s*$"), "terminal").when(low.isin(MIDCLAUSE), "midclause").when(following.isNull() | (F.size(following) == 0), "source_ends").when(turn | fresh, "new_turn").otherwise("continues")


AFTER = rf"""{CHUNKS}, la AS (SELECT clip, turn, max_by(word, i) AS last_word, max_by(low, i) AS low, max(idx) AS idx FROM ch GROUP BY clip, turn),
nx AS (SELECT la.clip, la.turn, list(w.word ORDER BY w.idx) AS nxt FROM la JOIN (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS k FROM words) l ON l.clip = la.clip AND l.idx = la.idx JOIN (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS k FROM words) w ON w.clip = la.clip AND w.k > l.k AND w.k <= l.k + 15 GROUP BY ALL),
co AS (SELECT la.*, CASE WHEN regexp_matches(last_word, '[.!?]["'')\]]*\s*$') THEN 'terminal' WHEN low IN ({MIDCLAUSE_SQL}) THEN 'midclause' WHEN nxt IS NULL THEN 'source_ends' WHEN regexp_matches(lower(array_to_string(nxt, ' ')), '{NEXT_TURN_SQL}') OR contains(array_to_string(nxt, ' '), '?') OR regexp_matches(nxt[1], '^\s*\p{{Lu}}') THEN 'new_turn' ELSE 'continues' END AS why FROM la LEFT JOIN nx USING (clip, turn))"""


def last_words(w: DataFrame) -> DataFrame:
    """Of words (clip, turn, idx, word) the last content word of each turn, with up to fifteen words after it. A turn of 10,000 words and more
    runs into the next and may have several rows; all others are dropped before anything else is done with the words after them."""
    back = Window.partitionBy("clip").orderBy(F.desc("idx"))  # one sort, from the end, tells both what follows and the turn of the next content word
    w = w.select("clip", "turn", "idx", "word", tx.is_content("word").alias("content"))
    after = F.reverse(F.collect_list("word").over(back.rowsBetween(-15, -1)))
    then = F.last(F.when(F.col("content"), F.col("turn")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return w.withColumns({"after": after, "then": then}).filter(F.col("content") & ~F.col("then").eqNullSafe(F.col("turn"))).drop("content", "then")


def endings(spark, d) -> DataFrame:
    """clip, turn, last_word, low, why: the last content word of each chunk, and whether the sentence is over with it."""
    ends = last_words(words(spark, d))
    last = ends.groupBy("clip", "turn").agg(F.max_by(F.struct("word", tx.letters("word").alias("low"), "after"), "idx").alias("x")).select("clip", "turn", F.col("x.word").alias("last_word"), "x.low", "x.after")
    return last.select("clip", "turn", "last_word", "low", completeness(F.col("last_word"), F.col("low"), F.col("after")).alias("why"))


@query(f"WITH {AFTER} SELECT clip, turn, last_word, why FROM co")
def sentence_completeness(spark, d):
    """Whether the last content word of each chunk ends its sentence, told by the word and the fifteen words after it."""
    return endings(spark, d).drop("low")


@query(f"WITH {AFTER} SELECT clip, turn, last_word, low IN ({CONN_SQL}, {WEAK_SQL}) OR why IN ('midclause', 'continues') AS truncated FROM co")
def payoff_truncated(spark, d):
    """Chunks that stop in the middle of a clause, or whose speaker goes on with the sentence."""
    weak = F.col("low").isin(tx.CONNECTORS + WEAK)
    return endings(spark, d).select("clip", "turn", "last_word", (weak | F.col("why").isin("midclause", "continues")).alias("truncated"))


@query(f"WITH {CHUNKS} SELECT ch.clip, ch.turn, count(*) FILTER (ends AND i > 3 AND i <= n - 3) AS inner_ends FROM ch JOIN win USING (clip, turn) WHERE hi - lo >= 15 GROUP BY ch.clip, ch.turn HAVING count(*) FILTER (ends AND i > 3 AND i <= n - 3) >= 2")
def tangent_risk(spark, d):
    inner = F.count_if(F.col("ends") & (F.col("i") > 3) & (F.col("i") <= F.col("n") - 3))
    c = chunks(spark, d).groupBy("clip", "turn").agg(inner.alias("inner_ends")).filter("inner_ends >= 2")
    return c.join(windows(spark, d).filter("hi - lo >= 15"), ["clip", "turn"]).select("clip", "turn", "inner_ends")


@query(
    f"""WITH {AFTER}, r AS (
SELECT clip, turn, 'LEADING_ORPHAN' AS rule, 'ERROR' AS severity FROM ch WHERE n >= 3 AND i <= 3 AND ends GROUP BY clip, turn UNION ALL
SELECT clip, turn, 'TRAILING_ORPHAN', 'ERROR' FROM ch GROUP BY clip, turn, n HAVING n >= 3 AND n - max(i) FILTER (ends) >= 2 UNION ALL
SELECT clip, turn, 'PAYOFF_TRUNCATED', 'ERROR' FROM co WHERE low IN ({CONN_SQL}, {WEAK_SQL}) OR why IN ('midclause', 'continues') UNION ALL
SELECT clip, turn, 'OPENER_DIRTY', 'WARN' FROM ch WHERE i = 1 AND low IN ({CONN_SQL}) UNION ALL
SELECT clip, turn, 'TANGENT_RISK', 'WARN' FROM ch JOIN win USING (clip, turn) WHERE hi - lo >= 15 GROUP BY clip, turn HAVING count(*) FILTER (ends AND i > 3 AND i <= n - 3) >= 2 UNION ALL
SELECT clip, turn, CASE WHEN hi > nlo + 0.05 THEN 'OVERLAP' ELSE 'DISJOINT_ORDER' END, 'ERROR' FROM (SELECT *, lead(lo) OVER (PARTITION BY clip ORDER BY turn) AS nlo FROM win) WHERE hi > nlo + 0.05 OR nlo < lo),
e AS (SELECT clip, min(turn) AS first, max(turn) AS last FROM win GROUP BY clip), m AS (SELECT unnest([false, true]) AS rough),
k AS (SELECT r.clip, r.turn, rule, rough, CASE WHEN rough AND rule = 'OVERLAP' THEN 'WARN' ELSE severity END AS severity FROM r JOIN e USING (clip), m WHERE NOT rough OR NOT (rule IN ('LEADING_ORPHAN', 'OPENER_DIRTY') AND r.turn <> first OR rule IN ('TRAILING_ORPHAN', 'PAYOFF_TRUNCATED') AND r.turn <> last))
SELECT *, row_number() OVER (PARTITION BY clip, rough ORDER BY turn, severity <> 'ERROR', rule) AS place FROM k"""
)
def window_driver(spark, d):
    """All word rules over all chunks, for final cuts and for rough windows, in order of chunk and severity. In rough windows openings count
    in a clip's first chunk alone and endings in its last, and chunks may overlap."""
    win = windows(spark, d)
    by = Window.partitionBy("clip", "turn")
    c = words(spark, d).filter(tx.is_content("word")).select("clip", "turn", "idx", tx.is_connector("word").alias("connects"), tx.ends_sentence("word").alias("ends"))
    c = c.select("clip", "turn", "connects", "ends", F.row_number().over(by.orderBy("idx")).alias("i"), F.count("*").over(by).alias("n"))
    i, n, ends = F.col("i"), F.col("n"), F.col("ends")
    c = c.groupBy("clip", "turn").agg(
        F.max((n >= 3) & (i <= 3) & ends).alias("leading"),
        (F.max((n >= 3).cast("int") * n) - F.max(F.when(ends, i)) >= 2).alias("trailing"),
        F.max((i == 1) & F.col("connects")).alias("opener"),
        (F.count_if(ends & (i > 3) & (i <= n - 3)) >= 2).alias("inner"),
    )
    ahead = F.lead("lo").over(Window.partitionBy("clip").orderBy("turn"))
    each = win.withColumn("nlo", ahead).join(c, ["clip", "turn"], "left").join(payoff_truncated(spark, d).select("clip", "turn", "truncated"), ["clip", "turn"], "left")
    overlap = F.col("hi") > F.col("nlo") + 0.05
    rules = (("OVERLAP", "ERROR", overlap), ("DISJOINT_ORDER", "ERROR", ~overlap & (F.col("nlo") < F.col("lo"))), ("LEADING_ORPHAN", "ERROR", F.col("leading")), ("TRAILING_ORPHAN", "ERROR", F.col("trailing")), ("PAYOFF_TRUNCATED", "ERROR", F.col("truncated")), ("OPENER_DIRTY", "WARN", F.col("opener")), ("TANGENT_RISK", "WARN", F.col("inner") & (F.col("hi") - F.col("lo") >= 15)))
    issues = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, hit in rules]))
    found = each.select("clip", "turn", F.explode(issues).alias("x")).select("clip", "turn", "x.rule", "x.severity")
    edge = win.groupBy("clip").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    both = found.join(edge, "clip").withColumn("rough", F.explode(F.array(F.lit(False), F.lit(True))))
    elsewhere = (F.col("rule").isin("LEADING_ORPHAN", "OPENER_DIRTY") & (F.col("turn") != F.col("first"))) | (F.col("rule").isin("TRAILING_ORPHAN", "PAYOFF_TRUNCATED") & (F.col("turn") != F.col("last")))
    severity = F.when(F.col("rough") & (F.col("rule") == "OVERLAP"), "WARN").otherwise(F.col("severity"))
    kept = both.filter(~F.col("rough") | ~elsewhere).select("clip", "turn", "rule", "rough", severity.alias("severity"))
    place = F.row_number().over(Window.partitionBy("clip", "rough").orderBy("turn", F.col("severity") != "ERROR", "rule"))
    return kept.withColumn("place", place.cast("long"))


def frames_near(segments: DataFrame, frames: DataFrame, reach: float) -> DataFrame:
    """Segments (clip, idx, lo, hi, ..) with each frame (clip, t, level) from lo up to hi + reach."""
    g = iv.bucketed(segments.withColumn("far", F.col("hi") + reach), 3600.0, "lo", "far").alias("g")
    p = frames.withColumn("bucket", F.floor(F.col("t") / 3600.0)).alias("p")
    on = (F.col("g.clip") == F.col("p.clip")) & (F.col("g.bucket") == F.col("p.bucket")) & (F.col("p.t") >= F.col("g.lo")) & (F.col("p.t") <= F.col("g.far"))
    return g.join(p, on).select("g.*", "t", "level").drop("bucket")


@query(f"WITH {SPANS}, g AS (SELECT clip, idx, st AS lo, en AS hi, value AS edge FROM spans WHERE label = 'view'), p AS (SELECT g.clip, g.idx, g.edge, avg(s.value) AS post FROM g JOIN spans s ON s.clip = g.clip AND s.st > g.hi AND s.st <= g.hi + 7200 GROUP BY ALL) SELECT clip, idx FROM p WHERE edge > 30 AND post > edge - 6")
def clipped_tail(spark, d):
    """Segments whose sound goes on after their end: the mean level just after is about that of the edge."""
    s = spans(spark, d)
    v = s.filter("label = 'view'").select("clip", "idx", F.col("st").alias("lo"), F.col("en").alias("hi"), F.col("value").alias("edge"))
    got = frames_near(v, s.select("clip", F.col("st").alias("t"), F.col("value").alias("level")), 7200.0).filter("t > hi")
    return got.groupBy("clip", "idx", "edge").agg(F.avg("level").alias("post")).filter("edge > 30 and post > edge - 6").select("clip", "idx")


@query(f"""WITH {SPANS}, g AS (SELECT clip, idx, st AS lo, en + 86400 AS hi FROM spans WHERE label = 'view'), f AS (SELECT g.clip, g.idx, s.value, s.st < g.lo + 28800 AS onset FROM g JOIN spans s ON s.clip = g.clip AND s.label <> 'view' AND s.st >= g.lo AND s.st <= g.hi),
x AS (SELECT clip, idx, 20 * log10(sqrt(avg(sq)) + 1e-9) AS whole, 20 * log10(sqrt(avg(sq) FILTER (onset)) + 1e-9) AS onset, 20 * log10(sqrt(avg(sq) FILTER (NOT onset)) + 1e-9) AS body FROM (SELECT *, (value / 1000) * (value / 1000) AS sq FROM f) GROUP BY clip, idx) SELECT clip, idx, CASE WHEN whole < -35 THEN 'segment' ELSE 'onset' END AS kind FROM x WHERE whole < -35 OR (onset < -35 AND body - onset > 16)""")
def ghost_silence(spark, d):
    """Segments that are silent throughout, and those whose onset is silent and much below what follows."""
    s = spans(spark, d)
    v = s.filter("label = 'view'").select("clip", "idx", F.col("st").alias("lo"), (F.col("en") + 86400).alias("hi"))
    f = frames_near(v, s.filter("label <> 'view'").select("clip", F.col("st").alias("t"), F.col("value").alias("level")), 0.0)
    sq = (F.col("level") / 1000) * (F.col("level") / 1000)
    db = lambda x: 20 * F.log10(F.sqrt(F.avg(x)) + 1e-9)
    early = F.col("t") < F.col("lo") + 28800
    x = f.groupBy("clip", "idx").agg(db(sq).alias("whole"), db(F.when(early, sq)).alias("onset"), db(F.when(~early, sq)).alias("body"))
    return x.filter("whole < -35 or (onset < -35 and body - onset > 16)").select("clip", "idx", F.when(F.col("whole") < -35, "segment").otherwise("onset").alias("kind"))


PAUSE = "coalesce(st - lag(en) OVER (PARTITION BY clip ORDER BY idx) > 0.2::double, true)"


@query(f"""WITH {WORDS}, t AS (SELECT clip, idx, regexp_replace(lower(word), '[^a-z'']', '', 'g') AS t, {PAUSE} AS fresh, lead(st) OVER (PARTITION BY clip ORDER BY idx) - en > 0.2::double AS stops FROM words)
SELECT clip, idx, CASE WHEN t IN ('um', 'uh', 'uhm', 'umm', 'uhh', 'ugh', 'fundamentally', 'ah', 'ahh', 'ahhh', 'aha', 'oh', 'ohh') THEN 'single' WHEN t IN ('now', 'so') AND fresh THEN 'initial' WHEN t IN ('right', 'like', 'okay', 'ok') AND (fresh OR coalesce(stops, true)) THEN 'isolated' ELSE 'short' END AS kind FROM t
WHERE t IN ('um', 'uh', 'uhm', 'umm', 'uhh', 'ugh', 'fundamentally', 'ah', 'ahh', 'ahhh', 'aha', 'oh', 'ohh') OR (t IN ('now', 'so') AND fresh) OR (t IN ('right', 'like', 'okay', 'ok') AND (fresh OR coalesce(stops, true))) OR (length(t) BETWEEN 1 AND 2 AND fresh)""")
def filler_candidates(spark, d):
    """Single fillers anywhere, others only after a pause or alone; very short words after a pause are listed too."""
    w = Window.partitionBy("clip").orderBy("idx")
    t = words(spark, d).select("clip", "idx", tx.letters("word").alias("t"), F.coalesce(F.col("st") - F.lag("en").over(w) > 0.2, F.lit(True)).alias("fresh"), F.coalesce(F.lead("st").over(w) - F.col("en") > 0.2, F.lit(True)).alias("stops"))
    # fixed values: filler words
    single = F.col("t").isin("um", "uh", "uhm", "umm", "uhh", "ugh", "fundamentally", "ah", "ahh", "ahhh", "aha", "oh", "ohh")
    initial = F.col("t").isin("now", "so") & F.col("fresh")
    alone = F.col("t").isin("right", "like", "okay", "ok") & (F.col("fresh") | F.col("stops"))
    short = F.length("t").between(1, 2) & F.col("fresh")
    return t.select("clip", "idx", F.when(single, "single").when(initial, "initial").when(alone, "isolated").when(short, "short").alias("kind")).filter("kind is not null")


@query(f"""WITH {SPANS}, g AS (SELECT clip, idx, st, en, lead(st) OVER (PARTITION BY clip ORDER BY st, idx) AS nst, value, label FROM spans)
SELECT clip, idx, 'OVERLAP' AS rule, 'ERROR' AS severity FROM g WHERE en > nst + 0.05::double UNION ALL SELECT clip, idx, 'GAP', 'WARN' FROM g WHERE nst - en > 86400 UNION ALL SELECT clip, idx, 'SHORT', 'WARN' FROM g WHERE en - st < 60""")
def window_rules(spark, d):
    """Several rules over the same scan, one row an issue."""
    g = spans(spark, d).withColumn("nst", F.lead("st").over(Window.partitionBy("clip").orderBy("st", "idx")))
    issue = lambda rule, sev: F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))
    found = F.array_compact(F.array(F.when(F.col("en") > F.col("nst") + 0.05, issue("OVERLAP", "ERROR")), F.when(F.col("nst") - F.col("en") > 86400, issue("GAP", "WARN")), F.when(F.col("en") - F.col("st") < 60, issue("SHORT", "WARN"))))
    return g.select("clip", "idx", F.explode(found).alias("x")).select("clip", "idx", "x.rule", "x.severity")


@query("WITH e AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 ELSE value END AS dur FROM events), r AS (SELECT CASE WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'posted' WHEN dur > 0 AND dur < 10 THEN 'too_short' WHEN dur > 180 THEN 'too_long' WHEN event_type = 'error' THEN 'no_audio' ELSE 'ok' END AS reason FROM e) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def eligibility(spark, d):
    """Why rows are skipped, counted by reason: posted already, shorter than 10 s or longer than 180 s (an unknown length, 0, passes), or without sound."""
    from spanloom.sources.tables import table

    posted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"), F.lit(True).alias("posted"))
    dur = F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value")).alias("dur")
    e = table(spark, d, "events").select("event_id", "event_type", dur).join(posted, "event_id", "left")
    why = F.when(F.col("posted"), "posted").when((F.col("dur") > 0) & (F.col("dur") < 10), "too_short").when(F.col("dur") > 180, "too_long").when(F.col("event_type") == "error", "no_audio").otherwise("ok")
    return e.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT user_id, greatest(0, 30 - count(*) FILTER (event_type = 'purchase'))::BIGINT AS room FROM events GROUP BY user_id), e AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY value DESC, event_id) AS r FROM events e WHERE event_type NOT IN ('error', 'purchase') AND value BETWEEN 10 AND 180 AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT e.user_id, event_id, r AS slot, room - r AS left_over FROM e JOIN b ON b.user_id = e.user_id WHERE r <= room")
def queue_plan(spark, d):
    """Each key's queue filled up to its budget with the best eligible rows that the ledger lacks, and what is left of the budget after each."""
    from spanloom.sources.tables import table

    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    room = ev.groupBy("user_id").agg(F.greatest(F.lit(0).cast("long"), 30 - F.count_if(F.col("event_type") == "purchase")).alias("room"))
    posted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    e = ev.filter("event_type not in ('error', 'purchase') and value between 10 and 180").join(posted, "event_id", "left_anti")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    return e.withColumn("slot", r).filter("slot <= 30").join(room, "user_id").filter("slot <= room").select("user_id", "event_id", "slot", (F.col("room") - F.col("slot")).alias("left_over"))


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'error' AND value BETWEEN 10 AND 180 AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT user_id, event_id, r AS slot FROM e WHERE r <= 3")
def queue_fill(spark, d):
    """Eligible rows not in the ledger, three a key by value."""
    from spanloom.operators.tables import top_per_key
    from spanloom.sources.tables import table

    posted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    e = table(spark, d, "events").filter("event_type <> 'error' and value between 10 and 180").select("user_id", "event_id", "value").join(posted, "event_id", "left_anti")
    return top_per_key(e, ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", F.col("rank").alias("slot"))


@query(f"""WITH {SPANS}, p AS (SELECT clip, idx, st, en, lag(en) OVER (PARTITION BY clip ORDER BY st, idx) AS pe FROM spans WHERE label = 'view'), q AS (SELECT clip, pe AS st, st AS en FROM p WHERE st - pe >= 3600) SELECT q.clip, q.st, q.en, (SELECT count(*) FROM spans s WHERE s.clip = q.clip AND s.label <> 'view' AND s.st > q.st AND s.st < q.en) AS voiced FROM q""")
def disfluency_gate(spark, d):
    """Long pauses, and what is heard within them."""
    s = spans(spark, d)
    p = s.filter("label = 'view'").select("clip", "idx", "st", F.lag("en").over(Window.partitionBy("clip").orderBy("st", "idx")).alias("pe")).filter("st - pe >= 3600")
    q = p.select("clip", "idx", F.col("pe").alias("lo"), F.col("st").alias("hi"))
    g = iv.bucketed(q, 3600.0, "lo", "hi").alias("g")
    v = s.filter("label <> 'view'").select("clip", F.col("st").alias("t"), F.floor(F.col("st") / 3600.0).alias("bucket")).alias("v")
    on = (F.col("g.clip") == F.col("v.clip")) & (F.col("g.bucket") == F.col("v.bucket")) & (F.col("v.t") > F.col("g.lo")) & (F.col("v.t") < F.col("g.hi"))
    return g.join(v, on, "left").groupBy("g.clip", "g.idx", F.col("g.lo").alias("st"), F.col("g.hi").alias("en")).agg(F.count("v.t").alias("voiced")).drop("idx")
