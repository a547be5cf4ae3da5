"""Queries that put several operators together: filler cuts, acoustic ends, caption audit, clip review, release checks, stage chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import align as al
from spanloom.operators import edits as ed
from spanloom.operators import fillers as fl
from spanloom.operators import intervals as iv
from spanloom.operators import sequence as sq
from spanloom.operators.steps import written
from spanloom.sources.tables import SPANS, WORDS, shares, spans, table, words

from . import rules
from .edits import CUES
from .registry import query
from .texts import ACCURACY, aligned_sql, shown_captions

#: Beside the engine's own lists, words of the test tables stand in for fillers of each kind.
LISTS = {"initial": [*fl.INITIAL, ["the"], ["la", "de"]], "phrases": [*fl.PHRASES, ["of", "the"], ["that", "is"], ["in", "of", "the"]], "single": [*fl.SINGLE, "un"], "alone": [*fl.ALONE, "et", "in", "an"]}
TOKEN = "regexp_replace(lower(word), '[^\\pL\\pN_'']', '', 'g')"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_fits = lambda p: " AND ".join(f"t{i} = '{x}'" for i, x in enumerate(p))
_rules = [(f"opens AND {_fits(p)}", "initial", len(p)) for p in LISTS["initial"]] + [(_fits(p), "phrase", len(p)) for p in LISTS["phrases"]] + [(f"t0 IN ({_list(LISTS['single'])})", "single", 1), (f"t0 IN ({_list(LISTS['alone'])}) AND apart", "isolated", 1)]
FILLER_STEPS = f"""ft AS (SELECT *, {TOKEN} AS t0 FROM words), fa AS (SELECT clip, idx, word, st, en, t0, {', '.join(f'lead(t0, {i}) OVER w AS t{i}, lead(en, {i}) OVER w AS e{i}, lead(st, {i + 1}) OVER w AS s{i}' for i in range(1, 5))}, en AS e0, lead(st) OVER w AS s0, lag(en) OVER w AS pe, lag(word) OVER w AS prior, row_number() OVER w AS i FROM ft WINDOW w AS (PARTITION BY clip ORDER BY idx)),
fb AS (SELECT *, pe IS NULL OR st - pe >= 0.2::double OR regexp_matches(prior, '[.!?]$') AS opens, pe IS NULL OR st - pe >= 0.2::double OR s0 IS NULL OR s0 - en >= 0.2::double OR regexp_matches(word, '[?]$') AS apart FROM fa),
fc AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{k}'" for c, k, _ in _rules)} END AS kind, CASE {' '.join(f"WHEN {c} THEN {n}" for c, _, n in _rules)} END AS size FROM fb),
fr AS (SELECT clip, i, kind IS NOT NULL AS hit, coalesce(size, 1) - 1 AS skip FROM fc WHERE i = 1 UNION ALL SELECT c.clip, c.i, r.skip = 0 AND c.kind IS NOT NULL, CASE WHEN r.skip > 0 THEN r.skip - 1 ELSE coalesce(c.size, 1) - 1 END FROM fr r JOIN fc c ON c.clip = r.clip AND c.i = r.i + 1),
fk AS (SELECT c.clip, c.idx, kind, st, CASE size WHEN 1 THEN e0 WHEN 2 THEN e1 WHEN 3 THEN e2 WHEN 4 THEN e3 ELSE e4 END AS en, CASE size WHEN 1 THEN s0 WHEN 2 THEN s1 WHEN 3 THEN s2 WHEN 4 THEN s3 ELSE s4 END AS nx, coalesce(pe, greatest(0, st - 1)) AS before FROM fr r JOIN fc c ON c.clip = r.clip AND c.i = r.i WHERE r.hit)"""
FILLERS = f"{WORDS}, {FILLER_STEPS}"
FILLER_CUTS = f"""{FILLERS}, fx AS (SELECT *, coalesce(nx, en + 1) AS after FROM fk), fy AS (SELECT clip, kind, round(greatest(0, CASE WHEN kind IN ('initial', 'phrase') THEN CASE WHEN st - before >= 0.05::double THEN greatest(st - 0.05::double, before + 0.02::double) ELSE st END ELSE greatest(st - 0.05::double, before + 0.005::double) END), 3) AS st, round(CASE WHEN kind IN ('initial', 'phrase') THEN CASE WHEN after - en >= 0.05::double THEN least(en + 0.08::double, after - 0.02::double) ELSE en END ELSE least(en + 0.08::double, after - 0.02::double) END, 3) AS en FROM fx UNION ALL
SELECT clip, 'pause', round(pe + 0.075::double, 3), round(st - 0.075::double, 3) FROM fa WHERE st - pe >= 0.55::double AND round(st - 0.075::double, 3) - round(pe + 0.075::double, 3) >= 0.1::double),
fz AS (SELECT *, max(en) OVER (PARTITION BY clip ORDER BY st, en, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fy), fi AS (SELECT *, sum(CASE WHEN reach IS NULL OR st - reach > 0.05::double THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY st, en, kind) AS island FROM fz),
filler_cuts AS (SELECT clip, min(st) AS st, max(en) AS en, string_agg(kind, '+' ORDER BY st, en, kind) AS kinds FROM fi GROUP BY clip, island)"""


def cut_words(spark, d) -> DataFrame:
    return words(spark, d).select("clip", "idx", "word", "st", "en")


@query(f"WITH RECURSIVE {FILLERS} SELECT clip, idx, kind, st, en FROM fk")
def filler_matches(spark, d):
    """Fillers of every kind, taken greedily from the left: sentence openers, phrases, single words, and words that stand alone."""
    return fl.taken(fl.candidates(cut_words(spark, d), **LISTS)).select("clip", "idx", "kind", "st", "en")


@query(f"WITH RECURSIVE {FILLER_CUTS} SELECT * FROM filler_cuts")
def filler_cuts(spark, d):
    """Fillers and long pauses as cuts that spare the neighbouring words; those within 50 ms are one."""
    return fl.cuts(cut_words(spark, d), 0.05, 0.08, **LISTS)


def quiet_starts(spark, d) -> DataFrame:
    """clip, idx, st of the frames from which three in a row are quiet."""
    f = spans(spark, d).filter("label <> 'view'").select("clip", "idx", "st", "value")
    ordered = f.withColumn("ok", F.sum(F.when(F.col("value") < 40, 1).otherwise(0)).over(Window.partitionBy("clip").orderBy("st", "idx").rowsBetween(0, 2)) == 3)
    return ordered.filter("ok").select("clip", "idx", "st")


@query(
    f"""WITH {SPANS}, f AS (SELECT clip, idx, st, sum((value < 40)::INT) OVER (PARTITION BY clip ORDER BY st, idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM spans WHERE label <> 'view'), q AS (SELECT * FROM f WHERE n = 3), v AS (SELECT clip, idx, en AS t FROM spans WHERE label = 'view')
SELECT v.clip, v.idx, CASE WHEN min(q.st) - t <= 172800 THEN min(q.st) END AS quiet FROM v LEFT JOIN q ON q.clip = v.clip AND q.st >= v.t GROUP BY v.clip, v.idx, t"""
)
def acoustic_ends(spark, d):
    """Where each word really ends: the first sustained quiet after its label, if it is near."""
    v = spans(spark, d).filter("label = 'view'").select("clip", "idx", F.col("en").alias("t"))
    got = iv.asof(v, quiet_starts(spark, d), "st", ["st"], forward=True, prefix="q_")
    return got.select("clip", "idx", F.when(F.col("q_st") - F.col("t") <= 172800, F.col("q_st")).alias("quiet"))


@query(
    f"""WITH {SPANS}, e AS (SELECT clip, st, loud, lag(loud) OVER w AS before, lag(st) OVER w AS since FROM (SELECT clip, idx, st, value > 60 AS loud FROM spans WHERE label <> 'view' AND (value > 60 OR value < 40)) WINDOW w AS (PARTITION BY clip ORDER BY st, idx)), v AS (SELECT clip, idx, st AS t FROM spans WHERE label = 'view'),
n AS (SELECT v.clip, v.idx, v.t, min_by(e.st, (abs(e.st - v.t), e.st)) AS spot FROM v LEFT JOIN e ON e.clip = v.clip AND e.st >= v.t - 43200 AND e.st < v.t + 64800 AND e.loud AND (NOT coalesce(e.before, false) OR e.since < v.t - 43200) GROUP BY ALL)
SELECT clip, idx, coalesce(spot, t) - 30 AS onset FROM n"""
)
def acoustic_starts(spark, d):
    """Where each word really starts: of the onsets around its label the nearest, a little early; without one, the label. An onset is a loud frame
    with quiet, or nothing that is either within the word's surroundings, before it."""
    s = spans(spark, d)
    e = s.filter("label <> 'view' and (value > 60 or value < 40)").select("clip", "idx", "st", (F.col("value") > 60).alias("loud"))
    w = Window.partitionBy("clip").orderBy("st", "idx")
    e = e.withColumns({"before": F.lag("loud").over(w), "since": F.lag("st").over(w)}).filter("loud").withColumn("bucket", F.floor(F.col("st") / 86400.0))
    v = s.filter("label = 'view'").select("clip", "idx", F.col("st").alias("t"), (F.col("st") - 43200).alias("lo"), (F.col("st") + 64800).alias("hi"))
    near = iv.bucketed(v, 86400.0, "lo", "hi").join(e.drop("idx"), ["clip", "bucket"]).filter("st >= lo and st < hi and (not coalesce(before, false) or since < lo)")
    best = near.groupBy("clip", "idx").agg(F.min_by("st", F.struct(F.abs(F.col("st") - F.col("t")), "st")).alias("at"))
    return v.join(best, ["clip", "idx"], "left").select("clip", "idx", (F.coalesce("at", "t") - 30).alias("onset"))


@query(f"WITH {SPANS}, e AS (SELECT clip, idx, st, 10 * log10(avg(value * value) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-9) AS db FROM spans) SELECT clip, min_by(st, struct_pack(d := db, i := idx)) AS quietest, min(db) AS db FROM e WHERE st BETWEEN 86400 AND 864000 GROUP BY clip")
def quietest_frame(spark, d):
    """Where the energy over five frames is least within a range; the first of equals."""
    w = Window.partitionBy("clip").orderBy("idx").rowsBetween(-4, 0)
    e = spans(spark, d).select("clip", "idx", "st", (10 * F.log10(F.avg(F.col("value") * F.col("value")).over(w) + 1e-9)).alias("db"))
    return e.filter("st between 86400 and 864000").groupBy("clip").agg(F.min_by("st", F.struct("db", "idx")).alias("quietest"), F.min("db").alias("db"))


CHAINED = f"""{WORDS}, f AS (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR st - lag(en) OVER w >= 0.8::double OR coalesce(lag(speaker) OVER w <> speaker, false) THEN 1 ELSE 0 END AS new FROM words WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f),
u AS (SELECT clip, min(idx) AS idx, min(st) AS st, max(en) AS en, string_agg(word, ' ' ORDER BY idx) AS text FROM g GROUP BY clip, k),
near AS (SELECT *, lag(text) OVER (PARTITION BY clip ORDER BY idx) AS before FROM u), pairs AS (SELECT clip::VARCHAR || ' ' || idx AS pair, string_split(before, '') AS a, string_split(text, '') AS b FROM near WHERE before IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {aligned_sql(CHAINED)}, alike AS (SELECT pair, CASE WHEN la + lb = 0 THEN 1 ELSE 2.0::double * equal / (la + lb) END AS ratio FROM sizes),
h AS (SELECT u.*, sum(CASE WHEN ratio > 0.45 THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY idx) AS chain FROM u LEFT JOIN alike ON pair = clip::VARCHAR || ' ' || idx)
SELECT clip, min(idx) AS first, min_by(st, idx) AS st, max_by(en, idx) AS en, count(*) AS n, min_by(text, (-length(text), idx)) AS text FROM h GROUP BY clip, chain"""
)
def chained_texts(spark, d):
    """Texts seen one after another merged while each is like the last one seen; the longest stands for all."""
    u = sq.sessions(words(spark, d, shares(spark, d)), 0.8, "speaker").groupBy("clip", "session").agg(F.min("idx").alias("idx"), F.min("st").alias("st"), F.max("en").alias("en"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("text"))
    return chained(u.select("clip", "idx", "st", "en", "text"), 0.45)


def chained(seen: DataFrame, least: float) -> DataFrame:
    """clip, first, st, en, n, text: rows in order of idx, joined while the share of matching characters with the row before is over ``least``."""
    w = Window.partitionBy("clip").orderBy("idx")
    alike = al.alike(F.col("before"), F.coalesce("text", F.lit("")))
    linked = seen.withColumn("before", F.lag("text").over(w)).withColumn("ratio", alike).drop("before").withColumn("chain", F.sum(F.when(F.col("ratio") > least, 0).otherwise(1)).over(w))
    text = F.min_by("text", F.struct(-F.length("text"), "idx"))
    return linked.groupBy("clip", "chain").agg(F.min("idx").alias("first"), F.min_by("st", "idx").alias("st"), F.max_by("en", "idx").alias("en"), F.count("*").alias("n"), text.alias("text")).drop("chain")


@query(
    f"""WITH RECURSIVE {CUES}, cv AS (SELECT w.clip, w.idx, w.st, w.idx % 23 <> 7 AS shown FROM words w), p AS (SELECT clip, avg(shown::INT) AS presence, count(*) AS n FROM cv GROUP BY clip), g AS (SELECT clip, avg((gap > 0.6)::INT) AS gaps, avg((n > 3 OR chars > 18)::INT) AS long, count(DISTINCT speaker) AS colours FROM (SELECT *, lead(st) OVER (PARTITION BY clip ORDER BY cue) - en AS gap FROM cues) GROUP BY clip),
t AS (SELECT c.clip, avg(abs(c.st - x.st)) AS drift FROM cues c JOIN (SELECT c.clip, c.cue, min(w.st) AS st FROM cues c JOIN words w ON w.clip = c.clip AND w.idx BETWEEN c.first AND c.last AND (w.idx * 7 + w.turn) % 11 > 1 GROUP BY ALL) x ON x.clip = c.clip AND x.cue = c.cue GROUP BY c.clip),
{ACCURACY}, y AS (SELECT clip, avg((cue * 389 % 1920 < 115 OR cue * 389 % 1920 > 1804)::INT) AS edge FROM cues GROUP BY clip)
SELECT p.clip, presence, gaps, long, colours, drift, wer, says_same, edge, CASE WHEN presence < 0.95 OR drift > 0.15 OR long > 0.05 OR NOT says_same OR edge > 0.5 THEN 'FAIL' WHEN gaps > 0.2 OR colours > 3 THEN 'WARN' ELSE 'PASS' END AS verdict FROM p JOIN g USING (clip) LEFT JOIN t USING (clip) LEFT JOIN accuracy USING (clip) LEFT JOIN y USING (clip)"""
)
def caption_audit(spark, d):
    """A clip's captions held against what is spoken: words shown, what they say (by alignment), time off, gaps, overlong cues, colours, cues in the
    outer six hundredths of the picture; with a verdict."""
    w = words(spark, d)
    c = ed.cues(w)
    p = w.groupBy("clip").agg(F.avg((F.col("idx") % 23 != 7).cast("int")).alias("presence"))
    gap = F.lead("st").over(Window.partitionBy("clip").orderBy("cue")) - F.col("en")
    g = c.withColumn("gap", gap).groupBy("clip").agg(F.avg((F.col("gap") > 0.6).cast("int")).alias("gaps"), F.avg(((F.col("n") > 3) | (F.col("chars") > 18)).cast("int")).alias("long"), F.countDistinct("speaker").alias("colours"))
    spoken = w.filter((F.col("idx") * 7 + F.col("turn")) % 11 > 1).select("clip", "idx", F.col("st").alias("at"))
    x = c.select("clip", "cue", "st", F.explode(F.sequence("first", "last")).alias("idx")).join(spoken.hint("merge"), ["clip", "idx"]).groupBy("clip", "cue", "st").agg(F.min("at").alias("at"))
    t = x.groupBy("clip").agg(F.avg(F.abs(F.col("st") - F.col("at"))).alias("drift"))
    says = al.accuracy(shown_captions(w)).select(F.col("pair").alias("clip"), "wer", "says_same")
    at = F.col("cue") * 389 % 1920  # a cue's anchor in a picture of 1920 lines
    y = c.groupBy("clip").agg(F.avg(((at < 115) | (at > 1804)).cast("int")).alias("edge"))
    verdict = F.when((F.col("presence") < 0.95) | (F.col("drift") > 0.15) | (F.col("long") > 0.05) | ~F.col("says_same") | (F.col("edge") > 0.5), "FAIL").when((F.col("gaps") > 0.2) | (F.col("colours") > 3), "WARN").otherwise("PASS")
    return p.join(g, "clip").join(t, "clip", "left").join(says, "clip", "left").join(y, "clip", "left").select("clip", "presence", "gaps", "long", "colours", "drift", "wer", "says_same", "edge", verdict.alias("verdict"))


@query(
    f"""WITH RECURSIVE {FILLER_CUTS}, e AS (SELECT clip, st AS edge FROM filler_cuts WHERE kinds LIKE '%pause%' UNION ALL SELECT clip, en FROM filler_cuts WHERE kinds LIKE '%pause%'), m AS (SELECT k.clip, k.idx, bool_or(e.edge IS NOT NULL) AS near FROM fk k LEFT JOIN e ON e.clip = k.clip AND e.edge BETWEEN k.st - 0.6 AND k.st + 0.6 GROUP BY ALL), l AS (SELECT clip, max(en) - min(st) AS secs FROM words GROUP BY clip)
SELECT l.clip, count(m.idx) FILTER (near) AS at_edges, count(m.idx) FILTER (NOT near) AS residual, CASE WHEN secs < 20 THEN 'short' WHEN secs > 9000 THEN 'long' ELSE 'ok' END AS length FROM l LEFT JOIN m ON m.clip = l.clip GROUP BY l.clip, secs"""
)
def clip_review(spark, d):
    """Fillers left in a clip: those at the edge of a cut may be misheard, the others are residual; and whether its length is right."""
    w = cut_words(spark, d)
    t = written(fl.taken(fl.candidates(w, **LISTS), fl.PAUSE), "review-fillers")  # a small part of the words, read twice
    m = t.filter("kind <> 'pause'").select("clip", "idx", F.col("st").alias("t"))
    e = fl.cuts_of(t, 0.05, 0.08).filter("kinds like '%pause%'").select("clip", F.explode(F.array("st", "en")).alias("edge"))
    near = iv.nearest(m, e.withColumn("idx", F.lit(0).cast("long")), "edge", 0.6)
    n = near.groupBy("clip").agg(F.count("near").alias("at_edges"), F.count_if(F.col("near").isNull()).alias("residual"))
    l = w.groupBy("clip").agg((F.max("en") - F.min("st")).alias("secs")).join(n, "clip", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return l.select("clip", zero("at_edges"), zero("residual"), F.when(F.col("secs") < 20, "short").when(F.col("secs") > 9000, "long").otherwise("ok").alias("length"))


@query(
    f"""WITH RECURSIVE {rules.AFTER}, {FILLER_STEPS}, f AS (SELECT clip, count(*) AS fillers FROM fk WHERE kind IN ('single', 'isolated') GROUP BY clip), o AS (SELECT clip, bool_or(i = 1 AND turn = 0 AND low IN ({rules.CONN_SQL})) AS dirty FROM ch GROUP BY clip), z AS (SELECT clip, max_by(why, turn) AS why FROM co GROUP BY clip)
SELECT z.clip, coalesce(dirty, false) AS dirty_opener, coalesce(fillers, 0) AS fillers, why AS ending, CASE WHEN coalesce(dirty, false) OR why IN ('midclause', 'continues') THEN 'FAIL' WHEN coalesce(fillers, 0) > 20 THEN 'WARN' ELSE 'PASS' END AS verdict FROM z LEFT JOIN o USING (clip) LEFT JOIN f USING (clip)"""
)
def release_qc(spark, d):
    """Release checks of a clip's words: its opener, the fillers left, and whether its last sentence is whole."""
    f = fl.taken(fl.candidates(cut_words(spark, d), **LISTS)).filter("kind in ('single', 'isolated')").groupBy("clip").agg(F.count("*").alias("fillers"))
    o = rules.opener_dirty(spark, d).filter("turn = 0").select("clip", F.lit(True).alias("dirty")).distinct()
    z = rules.endings(spark, d).groupBy("clip").agg(F.max_by("why", "turn").alias("ending"))
    dirty, n = F.coalesce("dirty", F.lit(False)), F.coalesce("fillers", F.lit(0).cast("long"))
    verdict = F.when(dirty | F.col("ending").isin("midclause", "continues"), "FAIL").when(n > 20, "WARN").otherwise("PASS")
    return z.join(o, "clip", "left").join(f, "clip", "left").select("clip", dirty.alias("dirty_opener"), n.alias("fillers"), "ending", verdict.alias("verdict"))


#: Stages by name, each a version and a function from DataFrame to DataFrame.
STAGES: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {
    "stutters": (1, lambda w: sq.without_repeats(w, tx.letters("word"), ["clip"], "idx")),
    "lower": (1, lambda w: w.withColumn("word", F.lower("word"))),
    "lines": (2, lambda w: ed.sentence_parts(w, 15, 160).groupBy("clip", "part").agg(F.count("*").alias("n"), F.min("st").alias("st"), F.max("en").alias("en"))),
}


def run_stages(df: DataFrame, names: list[str], stages: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = STAGES) -> DataFrame:
    """df through the named stages; other stages can be put in their place."""
    for name in names:
        df = df.transform(stages[name][1])
    return df


@query(
    f"""WITH RECURSIVE {WORDS}, t AS (SELECT *, nullif(regexp_replace(lower(word), '[^a-z'']', '', 'g'), '') AS t FROM words), p AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM t), f AS (SELECT *, NOT coalesce(t = pt AND length(t) >= 2, false) AS new FROM p), g AS (SELECT *, sum((new AND t IS NOT NULL)::INT) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f),
s AS (SELECT clip, idx, lower(word) AS word, st, CASE WHEN t IS NOT NULL THEN max(CASE WHEN t IS NOT NULL THEN en END) OVER (PARTITION BY clip, k) ELSE en END AS en, new FROM g), n AS (SELECT clip, idx, word, st, en, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, regexp_matches(word, '[.!?]$') AS ends FROM s WHERE new),
r AS (SELECT clip, i, 1 AS part, 1 AS k, length(word) + 1 AS c, ends FROM n WHERE i = 1 UNION ALL SELECT n.clip, n.i, CASE WHEN shut THEN part + 1 ELSE part END, CASE WHEN shut THEN 1 ELSE k + 1 END, CASE WHEN shut THEN 0 ELSE c END + length(n.word) + 1, n.ends FROM (SELECT *, ends OR k >= 15 OR c > 160 AS shut FROM r) r JOIN n ON n.clip = r.clip AND n.i = r.i + 1)
SELECT n.clip, part::BIGINT AS part, count(*) AS n, min(st) AS st, max(en) AS en FROM r JOIN n ON n.clip = r.clip AND n.i = r.i GROUP BY n.clip, part"""
)
def stage_chain(spark, d):
    """Words through a chain of registered stages: stutters out, lower case, lines."""
    return run_stages(cut_words(spark, d), ["stutters", "lower", "lines"])
