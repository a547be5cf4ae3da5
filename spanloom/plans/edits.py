"""Queries that cut a timed transcript into chunks, cues and spans, move their bounds, and pair them with other tracks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import timecode as tc
from spanloom.operators import edits as ed
from spanloom.operators import intervals as iv
from spanloom.operators.scan import scanned
from spanloom.sources.tables import SPANS, WORDS, spans, table, words

from .registry import query

CLOCK = "printf('%02d:%02d', floor({0} / 60)::BIGINT, floor({0})::BIGINT % 60)"


@query(
    f"""WITH RECURSIVE {WORDS}, n AS (SELECT clip, st, en, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, count(*) OVER (PARTITION BY clip) AS n, lead(st) OVER (PARTITION BY clip ORDER BY idx) - en AS pause FROM words),
e AS (SELECT a.clip, a.i, a.n, coalesce(min(b.i), a.n + 1) - 1 AS hi FROM n a LEFT JOIN n b ON b.clip = a.clip AND b.i > a.i AND b.i <= a.i + 300 AND b.en > a.st + 60 GROUP BY a.clip, a.i, a.n),
k AS (SELECT e.clip, e.i, CASE WHEN hi = e.n OR hi = e.i THEN hi ELSE (SELECT min_by(p.i, struct_pack(d := -p.pause, i := p.i)) FROM n p WHERE p.clip = e.clip AND p.i >= greatest(e.i, hi - greatest(1, (hi - e.i) // 5)) AND p.i < hi) END AS hi FROM e),
r AS (SELECT clip, i, hi FROM k WHERE i = 1 UNION ALL SELECT k.clip, k.i, k.hi FROM r JOIN k ON k.clip = r.clip AND k.i = r.hi + 1) SELECT clip, i AS first, hi AS last FROM r"""
)
def pause_splits(spark, d):
    """Parts of at most a minute, each cut at the longest pause in its last fifth; words by number within the clip, from 1."""
    return ed.pause_split(words(spark, d).select("clip", "idx", "st", "en"), 60.0)


@query(
    f"""WITH RECURSIVE {WORDS}, n AS (SELECT clip, word, st, en, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, count(*) OVER (PARTITION BY clip) AS total, regexp_matches(word, '[.!?]$') AS ends FROM words),
r AS (SELECT clip, i, 1 AS part, 1 AS k, ends FROM n WHERE i = 1 UNION ALL SELECT n.clip, n.i, CASE WHEN r.ends OR r.k >= 15 THEN r.part + 1 ELSE r.part END, CASE WHEN r.ends OR r.k >= 15 THEN 1 ELSE r.k + 1 END, n.ends FROM r JOIN n ON n.clip = r.clip AND n.i = r.i + 1),
g AS (SELECT n.clip, part, min(n.st) AS a, max_by(n.en, n.i) AS b, max_by(n.ends, n.i) OR count(*) >= 15 AS closed, string_agg(word, ' ' ORDER BY n.i) AS text, count(*) AS n FROM r JOIN n ON n.clip = r.clip AND n.i = r.i GROUP BY n.clip, part)
SELECT clip, part::BIGINT AS part, n, CASE WHEN closed THEN '[' || {CLOCK.format("a")} || '-' || {CLOCK.format("b")} || '] ' ELSE '[' || {CLOCK.format("a")} || '] ' END || text AS line FROM g"""
)
def sentence_lines(spark, d):
    """Timestamped lines that end with a sentence or after fifteen words; a line left open shows its start alone."""
    w = words(spark, d).select("clip", "idx", "word", "st", "en")
    parts = ed.sentence_parts(w, 15, 1 << 30)
    a, b = F.min("st"), F.max_by("en", "idx")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    g = parts.groupBy("clip", "part").agg(a.alias("a"), b.alias("b"), F.max("closed").alias("closed"), text.alias("text"), F.count("*").alias("n"))
    head = F.when(F.col("closed"), F.concat(F.lit("["), tc.clock("a"), F.lit("-"), tc.clock("b"), F.lit("] "))).otherwise(F.concat(F.lit("["), tc.clock("a"), F.lit("] ")))
    return g.select("clip", "part", "n", F.concat(head, "text").alias("line"))


@query(
    f"""WITH {WORDS}, s AS (SELECT clip, turn, min(st) AS a, max(en) AS b, string_agg(word, ' ' ORDER BY idx) AS text FROM words GROUP BY clip, turn)
SELECT clip, string_agg('[' || {CLOCK.format("a")} || '-' || {CLOCK.format("b")} || '] ' || text, E'\\n' ORDER BY turn) AS text FROM s GROUP BY clip"""
)
def timestamped_text(spark, d):
    """A clip's segments as one text, a timestamped line each."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    s = words(spark, d).groupBy("clip", "turn").agg(F.min("st").alias("a"), F.max("en").alias("b"), text.alias("text"))
    line = F.concat(F.lit("["), tc.clock("a"), F.lit("-"), tc.clock("b"), F.lit("] "), "text")
    return s.groupBy("clip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


#: Cues: a new one at a change of speaker, a pause, 18 characters, three words or after a mark.
CUES = f"""{WORDS}, cn AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i FROM words),
cr AS (SELECT clip, i, speaker, en, length(word) AS chars, 1 AS k, regexp_matches(word, '[.?!,]$') AS closed, 1 AS cue FROM cn WHERE i = 1 UNION ALL SELECT clip, i, speaker, en, CASE WHEN fresh THEN size ELSE chars + 1 + size END, CASE WHEN fresh THEN 1 ELSE k + 1 END, shut, CASE WHEN fresh THEN cue + 1 ELSE cue END FROM (SELECT n.clip, n.i, n.speaker, n.en, r.chars, r.k, r.cue, length(n.word) AS size, regexp_matches(n.word, '[.?!,]$') AS shut, r.closed OR r.speaker <> n.speaker OR n.st - r.en > 0.35 OR r.chars + 1 + length(n.word) > 18 OR r.k >= 3 AS fresh FROM cr r JOIN cn n ON n.clip = r.clip AND n.i = r.i + 1)),
cues AS (SELECT cn.clip, cue, min(idx) AS first, max(idx) AS last, min_by(cn.speaker, idx) AS speaker, min_by(cn.st, idx) AS st, max_by(cn.en, idx) AS en, count(*) AS n, sum(length(word)) + count(*) - 1 AS chars FROM cr JOIN cn ON cn.clip = cr.clip AND cn.i = cr.i GROUP BY cn.clip, cue)"""


@query(f"WITH RECURSIVE {CUES} SELECT clip, cue::BIGINT AS cue, first, last, n, chars::BIGINT AS chars FROM cues")
def cue_chunker(spark, d):
    """Words packed into cues: a new one at a change of speaker, a pause, 18 characters, three words or after a mark."""
    return ed.cues(words(spark, d)).select("clip", "cue", "first", "last", "n", "chars")


@query(
    f"""WITH RECURSIVE {CUES}, m AS (SELECT clip, cue, first, last, speaker, st, en, n, chars, cue AS i FROM cues WHERE cue = 1 UNION ALL
SELECT clip, CASE WHEN joins THEN head ELSE i END, first, last, speaker, st, en, n, CASE WHEN joins THEN held + 1 + chars ELSE chars END, i FROM (SELECT c.clip, c.cue AS i, c.first, c.last, c.speaker, c.st, c.en, c.n, c.chars, m.cue AS head, m.chars AS held, c.n = 1 AND c.speaker = m.speaker AND c.st - m.en <= 0.35 AND m.chars + 1 + c.chars <= 25 AS joins FROM m JOIN cues c ON c.clip = m.clip AND c.cue = m.i + 1)),
g AS (SELECT clip, cue, min(first) AS first, max(last) AS last, min_by(speaker, i) AS speaker, min_by(st, i) AS st, max_by(en, i) AS en, sum(n)::BIGINT AS n, max(chars) AS chars, row_number() OVER (PARTITION BY clip ORDER BY cue) AS k FROM m GROUP BY clip, cue),
j AS (SELECT a.clip FROM g a JOIN g b ON b.clip = a.clip AND b.k = 2 WHERE a.k = 1 AND a.n = 1 AND a.speaker = b.speaker AND b.st - a.en <= 0.35 AND a.chars + 1 + b.chars <= 25)
SELECT g.clip, min(first) AS first, max(last) AS last, sum(n)::BIGINT AS n FROM g LEFT JOIN j ON j.clip = g.clip GROUP BY g.clip, CASE WHEN j.clip IS NOT NULL AND k = 1 THEN 2 ELSE k END"""
)
def orphan_merge(spark, d):
    """Cues of one word joined to the one before, or at a clip's start to the next, where voice, pause and length allow it."""
    return ed.without_orphans(ed.cues(words(spark, d))).select("clip", "first", "last", "n")


@query(
    f"""WITH RECURSIVE {SPANS}, n AS (SELECT clip, idx, st, en, value, row_number() OVER (PARTITION BY clip ORDER BY st, idx) AS i FROM spans),
r AS (SELECT clip, i, idx, en, CASE WHEN value > 60 THEN 'host' WHEN value < 5 THEN 'guest' WHEN st > 7200 THEN 'guest' ELSE 'host' END AS who FROM n WHERE i = 1 UNION ALL SELECT n.clip, n.i, n.idx, n.en, CASE WHEN n.value > 60 THEN 'host' WHEN n.value < 5 THEN 'guest' WHEN n.st - r.en > 7200 THEN CASE r.who WHEN 'host' THEN 'guest' ELSE 'host' END ELSE r.who END FROM r JOIN n ON n.clip = r.clip AND n.i = r.i + 1) SELECT clip, idx, who FROM r"""
)
def speaker_resolve(spark, d):
    """Who speaks each word: a clear level decides, else the previous decision turns over after a long pause, else it holds."""

    def step(rows: Iterator) -> Iterator[tuple]:
        who, end = "host", 0.0
        for r in rows:
            if r.value > 60:
                who = "host"
            elif r.value < 5:
                who = "guest"
            elif r.st - end > 7200:
                who = "guest" if who == "host" else "host"
            end = r.en
            yield r.idx, who

    return scanned(spans(spark, d).select("clip", "idx", "st", "en", "value"), ["clip"], ["st", "idx"], step, "clip long, idx long, who string")


#: Points: every 37th word of a clip, expected 0.9 s later than it is, and twice where its number within the clip is even.
POINTS = f"{WORDS}, pn AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i FROM words), pt AS (SELECT clip, i, st + 0.9::double AS t, lower(word) AS head, unnest(range(1 + (i % 2 = 0)::INT)) AS again FROM pn WHERE i % 37 = 5), points AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY i, again) AS point, t, head FROM pt)"


@query(
    f"""WITH RECURSIVE {POINTS}, pl AS (SELECT clip, list(struct_pack(p := point, t := t, h := head) ORDER BY point) AS ps FROM points GROUP BY clip),
q AS (SELECT clip, i // 3 AS cue, min_by(st, i) AS st, list(lower(word) ORDER BY i) AS ws, row_number() OVER (PARTITION BY clip ORDER BY i // 3) AS k FROM pn GROUP BY clip, i // 3),
r AS (SELECT clip, 0::BIGINT AS k, NULL::BIGINT AS cue, NULL::BIGINT AS hit, ps FROM pl UNION ALL SELECT clip, k, cue, h.p, list_filter(ps, lambda x: h IS NULL OR x.p <> h.p) FROM (SELECT q.clip, q.k, q.cue, r.ps, list_filter(r.ps, lambda x: abs(q.st - x.t) <= 1.5 AND list_contains(q.ws, x.h))[1] AS h FROM r JOIN q ON q.clip = r.clip AND q.k = r.k + 1))
SELECT clip, cue, hit AS point FROM r WHERE hit IS NOT NULL"""
)
def numbered_points(spark, d):
    """Cues matched to points by time and heading word; a point serves the first cue that meets it."""
    w = words(spark, d).select("clip", "st", F.lower("word").alias("word"), F.row_number().over(Window.partitionBy("clip").orderBy("idx")).alias("i"))
    again = F.sequence(F.lit(0), F.when(F.col("i") % 2 == 0, 1).otherwise(0))
    p = w.filter("i % 37 = 5").select("clip", "i", (F.col("st") + 0.9).alias("t"), F.col("word").alias("head"), F.explode(again).alias("again"))
    p = p.select("clip", F.row_number().over(Window.partitionBy("clip").orderBy("i", "again")).cast("long").alias("point"), "t", "head")
    rows = F.array_sort(F.collect_list(F.struct("i", "st", "word")))
    c = w.groupBy("clip", F.floor(F.col("i") / 3).cast("long").alias("cue")).agg(rows.alias("r")).select("clip", "cue", F.get("r.st", F.lit(0)).alias("t"), F.array_join("r.word", " ").alias("head"))
    return ed.consumed(p, c, 1.5)


@query(
    f"""WITH {WORDS}, g AS (SELECT *, sum(CASE WHEN st - pe >= 0.2::double OR pe IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY idx) AS span FROM (SELECT *, lag(en) OVER (PARTITION BY clip ORDER BY idx) AS pe FROM words)),
s AS (SELECT clip, span, min_by(st, idx) AS a, max_by(en, idx) AS b FROM g GROUP BY ALL), n AS (SELECT *, lag(b) OVER w AS pe, lead(a) OVER w AS ns FROM s WINDOW w AS (PARTITION BY clip ORDER BY span))
SELECT clip, span::BIGINT AS span, least(coalesce(greatest(a - 0.15::double, pe + 0.005::double), a - 0.15::double), a) AS st, least(b + 0.12::double, coalesce(ns - 0.005::double, b + 0.4::double)) AS en FROM n"""
)
def gap_spans(spark, d):
    """Words cut at gaps of 0.2 s, each span padded without reaching into its neighbours or clipping its onset."""
    w = Window.partitionBy("clip").orderBy("idx")
    before = F.lag("en").over(w)
    g = iv.islands(words(spark, d).withColumn("pe", before), F.col("pe").isNull() | (F.col("st") - F.col("pe") >= 0.2), ["idx"], ["clip"], "span")
    s = g.groupBy("clip", "span").agg(F.min_by("st", "idx").alias("a"), F.max_by("en", "idx").alias("b"))
    by = Window.partitionBy("clip").orderBy("span")
    n = s.withColumns({"pe": F.lag("b").over(by), "ns": F.lead("a").over(by)})
    lo = F.least(F.greatest(F.col("a") - 0.15, F.col("pe") + 0.005), F.col("a"))
    return n.select("clip", "span", lo.alias("st"), F.least(F.col("b") + 0.12, F.coalesce(F.col("ns") - 0.005, F.col("b") + 0.4)).alias("en"))


@query(
    f"""WITH {WORDS}, t AS (SELECT clip, turn, idx, word, regexp_replace(lower(word), '[^a-z'']', '', 'g') IN ('and', 'the', 'of', 'la', 'de', 'et', 'der', 'die', 'to', 'is', 'but', 'so', 'or') AS conn, regexp_matches(word, '[.!?]$') AS ends FROM words),
a AS (SELECT *, row_number() OVER (PARTITION BY clip, turn ORDER BY idx) AS k, count(*) OVER (PARTITION BY clip, turn) AS n FROM (SELECT *, min(idx) FILTER (NOT conn) OVER (PARTITION BY clip, turn) AS lo FROM t) WHERE idx >= lo),
b AS (SELECT * FROM (SELECT *, max(k) FILTER (ends) OVER (PARTITION BY clip, turn) AS le FROM a) WHERE le IS NULL OR n - le > 4 OR k <= le)
SELECT clip, turn, idx FROM (SELECT *, max(idx) FILTER (NOT conn) OVER (PARTITION BY clip, turn) AS hi FROM b) WHERE idx <= hi"""
)
def trimmed_edges(spark, d):
    """Turns without connectors at either end, nor up to four words after their last sentence."""
    w = Window.partitionBy("clip", "turn")
    # words of the test tables that stand in for connectors
    conn = tx.letters("word").isin("and", "the", "of", "la", "de", "et", "der", "die", "to", "is", "but", "so", "or")
    t = words(spark, d).select("clip", "turn", "idx", conn.alias("conn"), F.col("word").rlike("[.!?]$").alias("ends"))
    real = F.when(~F.col("conn"), F.col("idx"))
    a = t.withColumn("lo", F.min(real).over(w)).filter("idx >= lo").withColumns({"k": F.row_number().over(w.orderBy("idx")), "n": F.count("*").over(w)})
    b = a.withColumn("le", F.max(F.when(F.col("ends"), F.col("k"))).over(w)).filter("le is null or n - le > 4 or k <= le")
    return b.withColumn("hi", F.max(real).over(w)).filter("idx <= hi").select("clip", "turn", "idx")


@query(
    f"""WITH {WORDS}, t AS (SELECT clip, idx, word, st, en, lower(regexp_replace(word, '^\\W+|\\W+$', '', 'g')) AS b FROM words), l AS (SELECT *, lead(b) OVER w AS b2, lead(word) OVER w AS word2, lead(en) OVER w AS en2 FROM t WINDOW w AS (PARTITION BY clip ORDER BY idx)),
h AS (SELECT *, b = 'of' AND b2 = 'the' AS hit FROM l), f AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY clip ORDER BY idx), false) AS eaten FROM h),
x AS (SELECT clip, idx, i, ['out', 'of', 'this'][i] || CASE WHEN i = 3 THEN regexp_extract(word2, '[.,!?;:]$') ELSE '' END AS word, st + (en2 - st) / 3 * (i - 1) AS st, st + (en2 - st) / 3 * i AS en FROM f, (SELECT unnest([1, 2, 3]) AS i) WHERE coalesce(hit, false)
UNION ALL SELECT clip, idx, 0, CASE b WHEN 'is' THEN 'was' || regexp_extract(word, '[.,!?;:]+$') WHEN 'and' THEN 'plus' || regexp_extract(word, '[.,!?;:]+$') ELSE word END, st, en FROM f WHERE NOT coalesce(hit, false) AND NOT eaten) SELECT clip, idx, i::BIGINT AS i, word, st, en FROM x"""
)
def phrase_replacement(spark, d):
    """A phrase replaced by one of another length, in equal steps of time and with its last mark; then single words."""
    return ed.replaced(words(spark, d), ["of", "the"], ["out", "of", "this"], {"is": "was", "and": "plus"})


@query(
    f"""WITH {SPANS}, r AS (SELECT clip, idx, st, en, row_number() OVER (PARTITION BY clip ORDER BY st, idx) = 1 AS opens FROM spans WHERE label = 'view'), q AS (SELECT clip, st AS qs, en AS qe FROM spans WHERE label = 'click'),
p AS (SELECT r.clip, r.idx, r.st, r.en, r.opens, min(qe) FILTER (qe >= r.st - 400) AS on_fwd, min_by(qe, struct_pack(d := abs(qe - r.st), t := qe)) FILTER (qe >= r.st - 400 AND abs(qe - r.st) <= 40000) AS fwd, max(qe) FILTER (qe BETWEEN r.st - 14400 AND r.st + 7200) AS back, min(qs) FILTER (abs(qs - r.en) <= 40000 AND qs >= r.en - 7200) AS after, min_by(qs, struct_pack(d := abs(qs - r.en), t := qs)) FILTER (abs(qs - r.en) <= 40000) AS near FROM r LEFT JOIN q ON q.clip = r.clip AND q.qs <= r.en + 40000 AND q.qe >= r.st - 40000 GROUP BY ALL)
SELECT clip, idx, CASE WHEN opens THEN coalesce(fwd, st) ELSE coalesce(back, st) END AS st, coalesce(after, near, en) + 120 AS en FROM p"""
)
def boundary_snap(spark, d):
    """Span bounds moved to the edges of quiet stretches: a clip's first start only forward, later ones to the latest onset close by, ends to the
    next offset, or else the nearest."""
    s = spans(spark, d)
    r = s.filter("label = 'view'").select("clip", "idx", "st", "en", (F.row_number().over(Window.partitionBy("clip").orderBy("st", "idx")) == 1).alias("opens"))
    return ed.snapped(r, s.filter("label = 'click'").select("clip", F.col("st").alias("qs"), F.col("en").alias("qe")), near=40000.0, early=400.0, pull=(14400.0, 7200.0), late=7200.0, pad=120.0)


@query(f"WITH {SPANS}, m AS (SELECT clip, idx AS master, st - 600 AS lo, en + 7200 AS hi FROM spans WHERE label = 'view') SELECT s.clip, s.idx, min(m.master) AS master FROM spans s LEFT JOIN m ON m.clip = s.clip AND s.st BETWEEN m.lo AND m.hi WHERE s.label <> 'view' GROUP BY s.clip, s.idx")
def covering_range(spark, d):
    """The first range that covers each point, give or take a tolerance before it; null where none does."""
    s = spans(spark, d)
    m = s.filter("label = 'view'").select("clip", "idx", (F.col("st") - 600).alias("st"), (F.col("en") + 7200).alias("en"), F.col("idx").alias("label"))
    p = s.filter("label <> 'view'").select("clip", "idx", F.col("st").alias("t"))
    return iv.containing(p, m, 3600.0, closed=True).select("clip", "idx", F.col("label").alias("master"))


@query(
    f"""WITH {SPANS}, x AS (SELECT clip, idx, st, en, label, value < 8 AS filler, lag(en) OVER w AS pe, lag(label) OVER w AS pl, lag(value < 8) OVER w AS pf FROM spans WINDOW w AS (PARTITION BY clip ORDER BY idx)),
g AS (SELECT *, sum(CASE WHEN NOT filler AND NOT pf AND label = pl AND st - pe < 40000 THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY idx) AS part FROM x) SELECT clip, part::BIGINT AS part, min(idx) AS first, max(idx) AS last, min_by(st, idx) AS st, max_by(en, idx) AS en, string_agg(label || idx, ' ' ORDER BY idx) AS summary FROM g GROUP BY clip, part"""
)
def stitched(spark, d):
    """Neighbouring content rows of one lead with little between them joined, their summaries one after another."""
    w = Window.partitionBy("clip").orderBy("idx")
    x = spans(spark, d).select("clip", "idx", "st", "en", "label", (F.col("value") < 8).alias("filler"))
    same = ~F.col("filler") & ~F.lag("filler").over(w) & (F.col("label") == F.lag("label").over(w)) & (F.col("st") - F.lag("en").over(w) < 40000)
    g = iv.islands(x.withColumn("fresh", ~F.coalesce(same, F.lit(False))), F.col("fresh"), ["idx"], ["clip"], "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat("label", "idx").alias("s")))), lambda r: r["s"]), " ")
    return g.groupBy("clip", "part").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("st", "idx").alias("st"), F.max_by("en", "idx").alias("en"), text.alias("summary"))


@query(
    f"""WITH RECURSIVE {SPANS}, s AS (SELECT clip, st AS qs, en AS qe, row_number() OVER (PARTITION BY clip ORDER BY st, en) AS k, count(*) OVER (PARTITION BY clip) AS n FROM spans WHERE label = 'click' AND st < en), w AS (SELECT clip, idx, st, en FROM spans WHERE label <> 'click'),
m AS (SELECT w.clip, idx, st, en, 0::BIGINT AS k, coalesce((SELECT max(n) FROM s WHERE s.clip = w.clip), 0) AS n FROM w
UNION ALL SELECT clip, idx, st + push, en + push, k + 1, n FROM (SELECT *, CASE WHEN inside THEN qe + 60 - min(st) FILTER (inside) OVER (PARTITION BY clip) ELSE 0 END AS push FROM (SELECT m.*, s.qs, s.qe, m.st >= s.qs AND m.st < s.qe AS inside FROM m JOIN s ON s.clip = m.clip AND s.k = m.k + 1)))
SELECT clip, idx, st, en FROM m WHERE k = n"""
)
def group_shift(spark, d):
    """Words that start within a silence moved behind it by one offset for all; later silences see the words where earlier ones have put them."""
    s = spans(spark, d)
    return ed.shifted(s.filter("label <> 'click'").select("clip", "idx", "st", "en"), s.filter("label = 'click'").select("clip", F.col("st").alias("qs"), F.col("en").alias("qe")), 60.0)


@query(
    f"""WITH {SPANS}, n AS (SELECT clip, max(en) - min(st) AS d, min(st) AS o FROM spans GROUP BY clip), t AS (SELECT clip, label, min(st) AS o, max(en) - min(st) AS d FROM spans WHERE label IN ('view', 'click') GROUP BY clip, label)
SELECT a.clip, i::BIGINT AS i, a.o + a.d * (i + 0.5::double) / 9 AS a, b.o + b.d * (i + 0.5::double) / 9 AS b FROM t a JOIN t b ON b.clip = a.clip AND a.label = 'view' AND b.label = 'click', (SELECT unnest(range(9)) AS i)"""
)
def paired_samples(spark, d):
    """Nine times on each of two tracks, at the same shares of their lengths."""
    t = spans(spark, d).filter("label in ('view', 'click')").groupBy("clip", "label").agg(F.min("st").alias("o"), (F.max("en") - F.min("st")).alias("d"))
    at = lambda label, name: t.filter(F.col("label") == label).select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("i"), "o", "d").select("clip", "i", (F.col("o") + F.col("d") * (F.col("i") + 0.5) / 9).alias(name))
    return at("view", "a").join(at("click", "b"), ["clip", "i"])


def track_levels(spark, d) -> DataFrame:
    """Views as words, with the mean level of two tracks over each."""
    s = spans(spark, d)
    v = s.filter("label = 'view'").select("clip", "idx", "st", "en", F.col("st").alias("lo"), (F.col("en") + 86400).alias("hi"))
    f = s.filter("label in ('click', 'error')").select("clip", F.col("st").alias("t"), "label", "value")
    g = iv.bucketed(v, 7200.0, "lo", "hi").alias("g")
    p = f.withColumn("bucket", F.floor(F.col("t") / 7200.0)).alias("p")
    on = (F.col("g.clip") == F.col("p.clip")) & (F.col("g.bucket") == F.col("p.bucket")) & (F.col("p.t") >= F.col("g.lo")) & (F.col("p.t") < F.col("g.hi"))
    level = lambda name: F.coalesce(F.avg(F.when(F.col("label") == name, F.col("value"))), F.lit(0.0))
    got = g.join(p, on, "left").groupBy("g.clip", "g.idx", "g.st", "g.en").agg(level("click").alias("host_level"), level("error").alias("guest_level"))
    return got.withColumn("speaker", F.when(F.col("host_level") >= F.col("guest_level") * 1.15, "host").otherwise("guest"))


TRACKS = f"""{SPANS}, v AS (SELECT clip, idx, st, en FROM spans WHERE label = 'view'), tl AS (SELECT v.clip, v.idx, v.st, v.en, coalesce(avg(f.value) FILTER (f.label = 'click'), 0) AS host_level, coalesce(avg(f.value) FILTER (f.label = 'error'), 0) AS guest_level FROM v LEFT JOIN spans f ON f.clip = v.clip AND f.label IN ('click', 'error') AND f.st >= v.st AND f.st < v.en + 86400 GROUP BY ALL),
tr AS (SELECT *, CASE WHEN host_level >= guest_level * 1.15::double THEN 'host' ELSE 'guest' END AS speaker FROM tl)"""


@query(f"WITH {TRACKS} SELECT clip, idx, host_level, guest_level, speaker FROM tr")
def interval_means(spark, d):
    """Mean level of two tracks over each word's interval, and whose word it is: the host's if theirs is 1.15 times the other's at least."""
    return track_levels(spark, d).drop("st", "en")


@query(
    f"""WITH {TRACKS}, x AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND st - lag(en) OVER w < 100000 THEN 0 ELSE 1 END AS fresh FROM tr WINDOW w AS (PARTITION BY clip ORDER BY st, idx)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY clip ORDER BY st, idx) AS utt FROM x),
u AS (SELECT clip, utt, min_by(speaker, st) AS speaker, min(st) AS st, max_by(en, st) AS en, count(*) AS n FROM g GROUP BY clip, utt) SELECT clip, utt::BIGINT AS utt, speaker, st, en, n, avg((speaker = 'host')::INT) OVER (PARTITION BY clip) AS host_share FROM u"""
)
def track_utterances(spark, d):
    """Utterances by level of two tracks: words by speaker, joined while the gap is under the limit, with the host's share of a clip's."""
    w = Window.partitionBy("clip").orderBy("st", "idx")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("st") - F.lag("en").over(w) < 100000)
    x = track_levels(spark, d).withColumn("fresh", ~F.coalesce(same, F.lit(False)))
    g = iv.islands(x, F.col("fresh"), ["st", "idx"], ["clip"], "utt")
    u = g.groupBy("clip", "utt").agg(F.min_by("speaker", "st").alias("speaker"), F.min("st").alias("st"), F.max_by("en", "st").alias("en"), F.count("*").alias("n"))
    return u.withColumn("host_share", F.avg((F.col("speaker") == "host").cast("int")).over(Window.partitionBy("clip")))


@query(
    f"""WITH {SPANS}, m AS (SELECT clip, idx, st, en FROM spans WHERE label = 'view'), f AS (SELECT m.clip, m.idx, s.value, s.st < m.st + 43200 AS head FROM m JOIN spans s ON s.clip = m.clip AND s.label <> 'view' AND s.st >= m.st AND s.st <= m.en + 86400), h AS (SELECT clip, idx, median(value) FILTER (head) AS ref FROM f GROUP BY ALL)
SELECT f.clip, f.idx, ref, avg((value > ref - 12)::INT) FILTER (NOT head) AS share, avg((value > ref - 12)::INT) FILTER (NOT head) > 0.55 AS stumble FROM f JOIN h USING (clip, idx) WHERE ref IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (NOT head) > 0"""
)
def stretched_words(spark, d):
    """Whether a long word hides speech: over 55 % of its inside is about as loud as its onset."""
    s = spans(spark, d)
    m = s.filter("label = 'view'").select("clip", "idx", F.col("st").alias("lo"), F.col("en").alias("hi"))
    from .rules import frames_near

    f = frames_near(m, s.filter("label <> 'view'").select("clip", F.col("st").alias("t"), F.col("value").alias("level")), 86400.0).withColumn("head", F.col("t") < F.col("lo") + 43200)
    ref = f.groupBy("clip", "idx").agg(F.median(F.when(F.col("head"), F.col("level"))).alias("ref")).filter("ref is not null")
    loud = (F.col("level") > F.col("ref") - 12).cast("int")
    got = f.filter("not head").join(ref, ["clip", "idx"]).groupBy("clip", "idx", "ref").agg(F.avg(loud).alias("share"))
    return got.withColumn("stumble", F.col("share") > 0.55)
