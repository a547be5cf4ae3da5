"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import sequence as sq
from spanloom.sources.tables import SPANS, WORDS, spans, table, words

from .registry import query

WIDTH = 600.0  # seconds a bucket, near the spans' median length


def _kind(spark, d, label):
    return spans(spark, d).filter(F.col("label") == label)


@query(f"WITH {SPANS} SELECT clip, idx, st, en FROM spans WHERE en > 86400 AND st < 172800")
def overlap_slice(spark, d):
    return spans(spark, d, before=172800).filter("en > 86400").select("clip", "idx", "st", "en")


@query(f"WITH {SPANS} SELECT clip, idx, greatest(0.0::double, st - 86400) AS st, greatest(0.0::double, en - 86400) AS en FROM spans WHERE en > 86400 AND st < 172800")
def slice_rebase(spark, d):
    s = spans(spark, d, before=172800).filter("en > 86400")
    return s.select("clip", "idx", *[F.greatest(F.lit(0.0), F.col(c) - 86400).alias(c) for c in ("st", "en")])


@query(f"WITH {WORDS} SELECT clip, idx, word FROM words WHERE st >= 10 - 0.2::double AND st < 40 + 0.2::double")
def padded_start_window(spark, d):
    return words(spark, d).filter((F.col("st") >= 10 - F.lit(0.2)) & (F.col("st") < 40 + F.lit(0.2))).select("clip", "idx", "word")


@query(f"WITH {WORDS} SELECT clip, idx, word FROM words WHERE st BETWEEN 10 AND 40")
def closed_start_window(spark, d):
    return words(spark, d).filter(F.col("st").between(10, 40)).select("clip", "idx", "word")


@query(f"WITH {SPANS}, r AS (SELECT *, max(en) OVER (PARTITION BY clip ORDER BY st, en, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR st - reach > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY st, en, idx) AS k FROM r) SELECT clip, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY clip, k")
def merge_close(spark, d):
    return iv.merge_close(spans(spark, d), 900.0)


@query(f"WITH {SPANS}, r AS (SELECT *, max(en) OVER (PARTITION BY clip ORDER BY st, en, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR st - reach > 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY st, en, idx) AS k FROM r) SELECT clip, min(st) - 60 AS st, max(en) + 60 AS en FROM g GROUP BY clip, k")
def wide_gap_ranges(spark, d):
    return iv.merge_close(spans(spark, d), 1200.0).select("clip", (F.col("st") - 60).alias("st"), (F.col("en") + 60).alias("en"))


@query(f"""WITH {SPANS}, h AS (SELECT max(en) AS hi FROM spans), e AS (SELECT clip, greatest(st, 0) AS st, en FROM spans), r AS (SELECT *, max(en) OVER (PARTITION BY clip ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
all_gaps AS (SELECT clip, coalesce(reach, 0) AS st, st AS en FROM r WHERE st > coalesce(reach, 0) UNION ALL SELECT clip, max(en), (SELECT hi FROM h) FROM e GROUP BY clip) SELECT clip, st, en FROM all_gaps WHERE en - st > 3600""")
def interval_complement(spark, d):
    """What no span of a clip covers, from zero to the last end in the table."""
    s = spans(spark, d)
    hi = s.agg(F.max("en").alias("hi"))
    scope = s.select("clip").distinct().crossJoin(F.broadcast(hi)).select("clip", F.lit(0.0).alias("lo"), "hi")  # one row beside each clip
    return iv.complement(s, scope, 3600.0)


@query(f"WITH {SPANS} SELECT a.clip, a.idx AS a_idx, b.idx AS b_idx, greatest(a.st, b.st) AS st, least(a.en, b.en) AS en FROM spans a JOIN spans b ON a.clip = b.clip AND a.st < b.en AND b.st < a.en WHERE a.label = 'view' AND b.label = 'click'")
def interval_intersect(spark, d):
    return iv.intersect(_kind(spark, d, "view"), _kind(spark, d, "click"), WIDTH)


@query(f"WITH {SPANS} SELECT a.clip, a.idx AS a_idx, b.idx AS b_idx, least(a.en, b.en) - greatest(a.st, b.st) AS overlap FROM spans a JOIN spans b ON a.clip = b.clip AND a.idx < b.idx AND a.st < b.en AND b.st < a.en WHERE least(a.en, b.en) - greatest(a.st, b.st) > 0.1::double")
def self_overlap(spark, d):
    return iv.self_overlaps(spans(spark, d), WIDTH, 0.1)


@query(f"WITH {SPANS}, n AS (SELECT *, lead(st) OVER (PARTITION BY clip ORDER BY st, idx) AS nxt, lead(idx) OVER (PARTITION BY clip ORDER BY st, idx) AS nidx FROM spans) SELECT clip, idx, nidx AS next_idx, en - nxt AS by_s FROM n WHERE en > nxt + 0.05::double")
def adjacent_overlap(spark, d):
    w = Window.partitionBy("clip").orderBy("st", "idx")
    s = spans(spark, d).select("clip", "idx", "en", F.lead("st").over(w).alias("nxt"), F.lead("idx").over(w).alias("next_idx"))
    return s.filter(F.col("en") > F.col("nxt") + 0.05).select("clip", "idx", "next_idx", (F.col("en") - F.col("nxt")).alias("by_s"))


@query(f"WITH {SPANS}, a AS (SELECT * FROM spans WHERE label = 'view'), b AS (SELECT * FROM spans WHERE label = 'click'), o AS (SELECT a.idx, sum(least(a.en, b.en) - greatest(a.st, b.st)) AS covered FROM a JOIN b ON a.clip = b.clip AND a.st < b.en AND b.st < a.en GROUP BY a.idx) SELECT a.clip, a.idx, o.covered / (a.en - a.st) AS ratio FROM a JOIN o USING (idx) WHERE o.covered / (a.en - a.st) > 0.65::double")
def overlap_ratio(spark, d):
    pairs = iv.overlap_pairs(_kind(spark, d, "view"), _kind(spark, d, "click"), WIDTH)
    part = F.sum(F.least("a_en", "b_en") - F.greatest("a_st", "b_st"))
    got = pairs.groupBy("clip", F.col("a_idx").alias("idx"), "a_st", "a_en").agg(part.alias("covered"))
    length = F.col("a_en") - F.col("a_st")
    ratio = F.when(length == 0, F.lit(float("nan"))).otherwise(F.try_divide("covered", length))  # a point in a click: 0 of 0, which SQL has as NaN, over any limit
    return got.select("clip", "idx", ratio.alias("ratio")).filter("ratio > 0.65D")


@query(f"WITH {SPANS}, a AS (SELECT clip, label, sum(en - st) AS total FROM spans WHERE label IN ('error', 'purchase') GROUP BY ALL), o AS (SELECT x.clip, x.label, sum(greatest(0, least(x.en, y.en) - greatest(x.st, y.st))) AS white FROM spans x JOIN spans y ON x.clip = y.clip AND x.st < y.en AND y.st < x.en WHERE x.label IN ('error', 'purchase') AND y.label = 'view' GROUP BY ALL), m AS (SELECT clip, median(value) AS mid FROM spans WHERE label = 'view' GROUP BY clip) SELECT a.clip, CASE a.label WHEN 'error' THEN 'guest' ELSE 'host' END AS speaker, coalesce(o.white, 0) / a.total AS share, m.mid, CASE WHEN coalesce(o.white, 0) / a.total > 0.45::double THEN 'colour' WHEN m.mid > 60 THEN 'place' ELSE 'pass' END AS verdict FROM a LEFT JOIN o ON a.clip = o.clip AND a.label = o.label LEFT JOIN m ON m.clip = a.clip")
def overlap_share_audit(spark, d):
    """How much of each speaker's time lies under cues of another's colour, and where cues stand (the median); a named verdict each."""
    s = spans(spark, d)
    who = s.filter(F.col("label").isin("error", "purchase"))
    total = who.groupBy("clip", "label").agg(F.sum(F.col("en") - F.col("st")).alias("total"))
    white = iv.overlap_pairs(who, _kind(spark, d, "view"), WIDTH).groupBy("clip", F.col("a_label").alias("label")).agg(F.sum(F.greatest(F.lit(0.0), F.least("a_en", "b_en") - F.greatest("a_st", "b_st"))).alias("white"))
    mid = s.filter("label = 'view'").groupBy("clip").agg(F.median("value").alias("mid"))
    share = F.try_divide(F.coalesce("white", F.lit(0.0)), F.col("total"))
    verdict = F.when(share > 0.45, "colour").when(F.col("mid") > 60, "place").otherwise("pass")
    return total.join(white, ["clip", "label"], "left").join(mid, "clip", "left").select("clip", F.when(F.col("label") == "error", "guest").otherwise("host").alias("speaker"), share.alias("share"), "mid", verdict.alias("verdict"))


@query(f"WITH {SPANS}, p AS (SELECT clip, idx, (st + en) / 2 AS t FROM spans WHERE label = 'error'), c AS (SELECT clip, st - 30 AS lo, en + 30 AS hi FROM spans WHERE label = 'view') SELECT clip, idx, t FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.clip = p.clip AND p.t >= c.lo AND p.t <= c.hi)")
def uncovered_points(spark, d):
    p = _kind(spark, d, "error").select("clip", "idx", ((F.col("st") + F.col("en")) / 2).alias("t"))
    return iv.uncovered(p, _kind(spark, d, "view"), 30.0, WIDTH)


@query(f"WITH {SPANS}, {WORDS}, w AS (SELECT * FROM words WHERE en > 5 AND st < 60) SELECT clip, idx, word FROM w WHERE NOT EXISTS (SELECT 1 FROM words c WHERE c.clip = w.clip AND c.idx % 7 = 3 AND (w.st + w.en) / 2 >= c.st - 0.2::double AND (w.st + w.en) / 2 <= c.en)")
def expected_words(spark, d):
    """Words of a window whose midpoint no cut holds; every seventh word, from a little before, stands for a cut."""
    w = words(spark, d)
    cuts = w.filter("idx % 7 = 3").select("clip", (F.col("st") - 0.2).alias("st"), "en")
    p = w.filter("en > 5 and st < 60").select("clip", "idx", "word", ((F.col("st") + F.col("en")) / 2).alias("t"))
    return iv.uncovered(p, cuts, 0.0, 5.0).select("clip", "idx", "word")


@query(f"WITH {SPANS}, g AS (SELECT clip, idx, st, en FROM spans WHERE label = 'view'), w AS (SELECT * FROM spans WHERE label = 'click') SELECT clip, idx FROM g WHERE EXISTS (SELECT 1 FROM w WHERE w.clip = g.clip AND w.st >= g.st - 0.02::double AND w.en <= g.en + 0.02::double)")
def gap_has_words(spark, d):
    return iv.with_contained(_kind(spark, d, "view").select("clip", "idx", "st", "en"), _kind(spark, d, "click"), 0.02, WIDTH).select("clip", "idx")


@query(f"WITH {SPANS}, l AS (SELECT clip, idx, st + 0.005::double AS t FROM spans WHERE label = 'purchase'), r AS (SELECT clip, en, max(idx) AS ridx FROM spans WHERE label = 'click' GROUP BY ALL) SELECT l.clip, l.idx, l.t, r.en AS r_en, r.ridx AS r_idx FROM l ASOF LEFT JOIN r ON l.clip = r.clip AND l.t >= r.en")
def last_before_asof(spark, d):
    left = _kind(spark, d, "purchase").select("clip", "idx", (F.col("st") + 0.005).alias("t"))
    return iv.asof(left, _kind(spark, d, "click"), "en", ["idx"])


@query(f"WITH {SPANS}, l AS (SELECT clip, idx, en AS t FROM spans WHERE label = 'purchase'), r AS (SELECT clip, st, min(idx) AS ridx FROM spans WHERE label = 'click' GROUP BY ALL) SELECT l.clip, l.idx, l.t, CASE WHEN r.st <= l.t + 7200 THEN r.st END AS r_st, CASE WHEN r.st <= l.t + 7200 THEN r.ridx END AS r_idx FROM l ASOF LEFT JOIN r ON l.clip = r.clip AND l.t <= r.st")
def next_after_asof(spark, d):
    left = _kind(spark, d, "purchase").select("clip", "idx", F.col("en").alias("t"))
    got = iv.asof(left, _kind(spark, d, "click"), "st", ["idx"], forward=True)
    soon = F.col("r_st") <= F.col("t") + 7200
    return got.select("clip", "idx", "t", F.when(soon, F.col("r_st")).alias("r_st"), F.when(soon, F.col("r_idx")).alias("r_idx"))


@query(f"WITH {SPANS}, l AS (SELECT clip, idx, st AS t FROM spans WHERE label = 'error'), r AS (SELECT DISTINCT clip, st FROM spans WHERE label = 'click'), b AS (SELECT l.*, r.st AS b FROM l ASOF LEFT JOIN r ON l.clip = r.clip AND l.t >= r.st), f AS (SELECT b.*, r.st AS f FROM b ASOF LEFT JOIN r ON b.clip = r.clip AND b.t <= r.st), n AS (SELECT *, CASE WHEN f IS NULL OR t - b <= f - t THEN b ELSE f END AS x FROM f) SELECT clip, idx, t, CASE WHEN abs(x - t) <= 3600 THEN x END AS near FROM n")
def nearest_within_tol(spark, d):
    return iv.nearest(_kind(spark, d, "error").select("clip", "idx", F.col("st").alias("t")), _kind(spark, d, "click"), "st", 3600.0)


@query(f"WITH {SPANS}, p AS (SELECT clip, idx, st AS t FROM spans WHERE label = 'error') SELECT p.clip, p.idx, p.t, (SELECT min_by(s.label, s.idx) FROM spans s WHERE s.label <> 'error' AND s.clip = p.clip AND p.t >= s.st AND p.t < s.en) AS label FROM p")
def point_in_span(spark, d):
    s = spans(spark, d)
    return iv.containing(s.filter("label = 'error'").select("clip", "idx", F.col("st").alias("t")), s.filter("label <> 'error'"), WIDTH)


@query(f"""WITH {SPANS}, p AS (SELECT clip, idx, st AS t FROM spans WHERE label = 'error'), s AS (SELECT * FROM spans WHERE label <> 'error'), h AS (SELECT p.*, (SELECT min_by(s.label, s.idx) FROM s WHERE s.clip = p.clip AND p.t >= s.st AND p.t <= s.en) AS inside FROM p),
n AS (SELECT h.*, row_number() OVER (PARTITION BY h.idx ORDER BY least(abs(h.t - s.st), abs(h.t - s.en)), s.idx) AS r, s.label AS close FROM h JOIN s ON s.clip = h.clip) SELECT clip, idx, t, coalesce(inside, close) AS label FROM n WHERE r = 1""")
def point_or_nearest(spark, d):
    """The span that holds a point, bounds included, else the one with the nearest edge: the last end before or the first start after."""
    s = spans(spark, d)
    other = s.filter("label <> 'error'")
    p = iv.containing(s.filter("label = 'error'").select("clip", "idx", F.col("st").alias("t")), other, WIDTH, closed=True)
    least = other.groupBy("clip", "en").agg(F.min_by("label", "idx").alias("label"), F.min("idx").alias("idx"))
    first = other.groupBy("clip", "st").agg(F.min_by("label", "idx").alias("label"), F.min("idx").alias("idx"))
    both = iv.asof(iv.asof(p, least, "en", ["label", "idx"], prefix="b_"), first, "st", ["label", "idx"], forward=True, prefix="f_")
    db, df = F.col("t") - F.col("b_en"), F.col("f_st") - F.col("t")
    back = df.isNull() | (db < df) | ((db == df) & (F.col("b_idx") < F.col("f_idx")))
    return both.select("clip", "idx", "t", F.coalesce("label", F.when(back, F.col("b_label")).otherwise(F.col("f_label"))).alias("label"))


@query(f"WITH {SPANS}, m AS (SELECT clip, idx, st, en, en - st AS dur FROM spans WHERE label = 'click') SELECT clip, idx, coalesce(sum(dur) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_st, sum(dur) OVER (PARTITION BY clip ORDER BY idx ROWS UNBOUNDED PRECEDING) AS out_en FROM m")
def cumulative_timeline(spark, d):
    return sq.cumulative_timeline(_kind(spark, d, "click"))


@query(f"""WITH {SPANS}, m AS (SELECT clip, idx, st, en - st AS dur FROM spans WHERE label = 'click'), k AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o0, sum(dur) OVER (PARTITION BY clip ORDER BY idx ROWS UNBOUNDED PRECEDING) AS o1 FROM m),
q AS (SELECT clip, unnest(range(0, ceil(max(o1) / 250)::BIGINT)) * 250.0::double AS t FROM k GROUP BY clip) SELECT q.clip, q.t, k.st + (q.t - k.o0) AS source_t FROM q JOIN k ON q.clip = k.clip AND q.t >= k.o0 AND q.t < k.o1""")
def timeline_remap(spark, d):
    """Clip times, a grid over each clip's whole length, carried back to source times through the kept parts."""
    keeps = sq.cumulative_timeline(_kind(spark, d, "click").select("clip", "idx", "st", "en"), keep=["st"])
    last = F.ceil(F.max("out_en") / 250) - 1
    grid = keeps.groupBy("clip").agg(F.greatest(F.lit(0), last).alias("last")).select("clip", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i")).select("clip", (F.col("i") * 250.0).alias("t"))
    key = iv.bucketed(keeps, WIDTH, "out_st", "out_en").alias("k")
    q = grid.withColumn("bucket", F.floor(F.col("t") / WIDTH)).alias("q")
    on = (F.col("q.clip") == F.col("k.clip")) & (F.col("q.bucket") == F.col("k.bucket")) & (F.col("q.t") >= F.col("k.out_st")) & (F.col("q.t") < F.col("k.out_en"))
    return q.join(key, on).select("q.clip", "q.t", (F.col("k.st") + (F.col("q.t") - F.col("k.out_st"))).alias("source_t"))


@query(f"WITH {SPANS}, n AS (SELECT *, lead(st) OVER (PARTITION BY clip ORDER BY st, idx) AS b0, lead(en) OVER (PARTITION BY clip ORDER BY st, idx) AS b1 FROM spans) SELECT clip, idx, greatest(0, b0 - en, st - b1) AS gap FROM n WHERE b0 IS NOT NULL")
def interval_gap(spark, d):
    w = Window.partitionBy("clip").orderBy("st", "idx")
    s = spans(spark, d).select("clip", "idx", "st", "en", F.lead("st").over(w).alias("b0"), F.lead("en").over(w).alias("b1")).filter("b0 is not null")
    return s.select("clip", "idx", iv.interval_gap(F.col("st"), F.col("en"), F.col("b0"), F.col("b1")).alias("gap"))


@query(f"WITH {SPANS}, a AS (SELECT clip, min(st) AS s0, max(en) AS e0 FROM spans WHERE label = 'view' GROUP BY clip), b AS (SELECT clip, min(st) AS s1, max(en) AS e1 FROM spans WHERE label = 'click' GROUP BY clip) SELECT clip, s0 - s1 AS head, e0 - e1 AS tail FROM a JOIN b USING (clip)")
def envelope_offsets(spark, d):
    def one(label, i):
        return _kind(spark, d, label).groupBy("clip").agg(F.min("st").alias(f"s{i}"), F.max("en").alias(f"e{i}"))

    return one("view", 0).join(one("click", 1), "clip").select("clip", (F.col("s0") - F.col("s1")).alias("head"), (F.col("e0") - F.col("e1")).alias("tail"))


@query(f"WITH {SPANS}, n AS (SELECT clip, idx, en, label, lead(st) OVER w AS nst, lead(label) OVER w AS nlabel FROM spans WHERE label IN ('click', 'purchase') WINDOW w AS (PARTITION BY clip ORDER BY st, idx)), g AS (SELECT * FROM n WHERE nst - en > 0 AND nst - en <= 20000 AND label <> nlabel) SELECT g.clip, g.idx, count(*) AS n_inside, min(s.idx) AS first_inside FROM g JOIN spans s ON s.clip = g.clip AND s.label = 'view' AND s.st > g.en AND s.st < g.nst GROUP BY g.clip, g.idx")
def open_gap_words(spark, d):
    """What is said in the open gap between neighbouring segments of different cameras."""
    s = spans(spark, d)
    w = Window.partitionBy("clip").orderBy("st", "idx")
    n = s.filter(F.col("label").isin("click", "purchase")).select("clip", "idx", "label", F.col("en").alias("lo"), F.lead("st").over(w).alias("hi"), F.lead("label").over(w).alias("nlabel"))
    gaps = n.filter("hi - lo > 0 and hi - lo <= 20000 and label <> nlabel")
    g = iv.bucketed(gaps, WIDTH, "lo", "hi").alias("g")
    v = s.filter("label = 'view'").select("clip", F.col("idx").alias("v_idx"), F.col("st").alias("t"), F.floor(F.col("st") / WIDTH).alias("bucket")).alias("v")
    on = (F.col("g.clip") == F.col("v.clip")) & (F.col("g.bucket") == F.col("v.bucket")) & (F.col("v.t") > F.col("g.lo")) & (F.col("v.t") < F.col("g.hi"))
    return g.join(v, on).groupBy("g.clip", "g.idx").agg(F.count("*").alias("n_inside"), F.min("v_idx").alias("first_inside"))


@query("WITH c AS (SELECT c_custkey, c_acctbal FROM customer), o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders) SELECT c_custkey, o_orderkey, diff FROM (SELECT c_custkey, o_orderkey, abs(o_totalprice - c_acctbal * 20) AS diff, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(o_totalprice - c_acctbal * 20), o_orderdate DESC, o_orderkey) AS r FROM c JOIN o ON o_custkey = c_custkey) WHERE r = 1 AND diff <= 20000")
def closest_match(spark, d):
    """The order whose total is closest to a customer's balance, newest on a tie; too far ones are rejected."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    j = o.join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey").withColumn("diff", F.abs(F.col("o_totalprice") - F.col("c_acctbal") * 20))
    best = j.groupBy("c_custkey").agg(F.min(F.struct("diff", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"), "o_orderkey")).alias("m"))
    return best.select("c_custkey", "m.o_orderkey", "m.diff").filter("diff <= 20000")
