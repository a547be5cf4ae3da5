"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import intervals as iv
from spanloom.operators import sequence as sq
from spanloom.sources.tables import SPANS, WORDS, spans, words

from .registry import query

BY_ST = "PARTITION BY clip ORDER BY st, idx"


@query(f"""WITH {WORDS}, f AS (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR st - lag(en) OVER w >= 0.8::double OR coalesce(lag(speaker) OVER w <> speaker, false) THEN 1 ELSE 0 END AS new FROM words WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f)
SELECT clip, min(st) AS st, max_by(en, idx) AS en, min_by(speaker, idx) AS speaker, string_agg(word, ' ' ORDER BY idx) AS text, count(*) AS n FROM g GROUP BY clip, k""")
def utterance_sessions(spark, d):
    s = sq.sessions(words(spark, d), 0.8, "speaker")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    return s.groupBy("clip", "session").agg(F.min("st").alias("st"), F.max_by("en", "idx").alias("en"), F.min_by("speaker", "idx").alias("speaker"), text.alias("text"), F.count("*").alias("n")).drop("session")


@query(f"WITH {SPANS}, f AS (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR st - lag(en) OVER w >= 600 OR lag(label) OVER w <> label THEN 1 ELSE 0 END AS new FROM spans WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f), b AS (SELECT clip, k, max(en) - min(st) AS dur FROM g GROUP BY clip, k) SELECT clip, count(*) AS blocks, sum(dur) AS seconds FROM b GROUP BY clip ORDER BY blocks DESC, clip LIMIT 10")
def top_clips(spark, d):
    """The ten clips with the most utterance blocks; a top-k report."""
    s = sq.sessions(spans(spark, d).select("clip", "idx", "st", "en", "label"), 600.0, "label")
    b = s.groupBy("clip", "session").agg((F.max("en") - F.min("st")).alias("dur"))
    return b.groupBy("clip").agg(F.count("*").alias("blocks"), F.sum("dur").alias("seconds")).orderBy(F.desc("blocks"), "clip").limit(10)


@query(f"WITH {SPANS}, f AS (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR st - lag(en) OVER w >= 700 OR lag(label) OVER w <> label THEN 1 ELSE 0 END AS new FROM spans WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f) SELECT clip, label, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY clip, k, label")
def strict_sessions(spark, d):
    """Rows join while the gap is under the limit, so one that equals it opens a session."""
    s = sq.sessions(spans(spark, d), 700.0, "label")
    return s.groupBy("clip", "session", "label").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("n")).drop("session")


@query(f"WITH {WORDS}, g AS (SELECT clip, idx, lag(en) OVER (PARTITION BY clip ORDER BY idx) AS pe, st FROM words) SELECT clip, idx, pe + 0.075::double AS st, st - 0.075::double AS en FROM g WHERE st - pe >= 0.55::double AND (st - 0.075::double) - (pe + 0.075::double) >= 0.1::double")
def gap_cuts(spark, d):
    """Pauses to cut, with a breath left on both sides."""
    w = words(spark, d).select("clip", "idx", "st", F.lag("en").over(Window.partitionBy("clip").orderBy("idx")).alias("pe"))
    g = w.filter(F.col("st") - F.col("pe") >= 0.55).select("clip", "idx", (F.col("pe") + 0.075).alias("st"), (F.col("st") - 0.075).alias("en"))
    return g.filter(F.col("en") - F.col("st") >= 0.1)


@query(f"WITH {SPANS}, f AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM spans WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS run FROM f) SELECT clip, run::BIGINT AS run, label, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY ALL")
def run_blocks(spark, d):
    return sq.runs(spans(spark, d).select("clip", "idx", "label"), "label", ["clip"], "idx")


@query(f"WITH {SPANS}, f AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM spans WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS run FROM f) SELECT clip, label, min(idx) AS first, count(*) AS n FROM g GROUP BY clip, run, label HAVING count(*) >= 3")
def long_runs(spark, d):
    return sq.runs(spans(spark, d).select("clip", "idx", "label"), "label", ["clip"], "idx").filter("n >= 3").select("clip", "label", "first", "n")


@query(f"WITH {SPANS} SELECT clip, idx, coalesce(last_value(CASE WHEN label IN ('view', 'click') THEN label END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY idx ROWS UNBOUNDED PRECEDING), 'guest') AS held FROM spans")
def hold_last(spark, d):
    s = spans(spark, d).select("clip", "idx", "label")
    return s.select("clip", "idx", sq.hold_last(F.when(F.col("label").isin("view", "click"), F.col("label")), ["clip"], "idx", "guest").alias("held"))


@query(f"WITH {SPANS} SELECT clip, idx, quantile_cont(CASE WHEN label <> 'error' THEN value END, 0.5) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM spans")
def rolling_median(spark, d):
    s = spans(spark, d).select("clip", "idx", F.when(F.col("label") != "error", F.col("value")).alias("x"))
    return s.select("clip", "idx", sq.rolling_median("x", 5, ["clip"], "idx").alias("med"))


@query(f"""WITH {SPANS}, n AS (SELECT clip, idx, value, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, count(*) OVER (PARTITION BY clip) AS n FROM spans), o AS (SELECT unnest(range(-2, 3)) AS o)
SELECT a.clip, a.idx, avg(b.value) AS mean FROM n a, o JOIN n b ON b.clip = a.clip AND b.i = least(a.n, greatest(1, a.i + o.o)) GROUP BY a.clip, a.idx""")
def rolling_mean_padded(spark, d):
    return sq.padded_mean(spans(spark, d).select("clip", "idx", "value"), "value", 5, ["clip"], "idx", "mean").select("clip", "idx", "mean")


@query(f"WITH {SPANS}, m AS (SELECT clip, idx, value, min(value) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS low FROM spans) SELECT clip, max(low) AS most FROM m GROUP BY clip")
def rolling_min_max(spark, d):
    w = Window.partitionBy("clip").orderBy("idx").rowsBetween(0, 2)
    return spans(spark, d).select("clip", F.min("value").over(w).alias("low")).groupBy("clip").agg(F.max("low").alias("most"))


@query(f"WITH {SPANS}, s AS (SELECT clip, idx, sum((value > 20)::INT) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS ok FROM spans) SELECT clip, min(idx) AS first, max(idx) AS last FROM s WHERE ok GROUP BY clip")
def sustained_runs(spark, d):
    s = spans(spark, d).select("clip", "idx", "value")
    return s.withColumn("ok", sq.sustained(F.col("value") > 20, 3, ["clip"], "idx")).filter("ok").groupBy("clip").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


@query(f"""WITH {WORDS}, t AS (SELECT *, nullif(regexp_replace(lower(word), '[^a-z'']', '', 'g'), '') AS t FROM words), p AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM t), f AS (SELECT *, NOT coalesce(t = pt AND length(t) >= 2, false) AS new FROM p),
g AS (SELECT *, sum((new AND t IS NOT NULL)::INT) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f) SELECT clip, idx, word, CASE WHEN t IS NOT NULL THEN max(CASE WHEN t IS NOT NULL THEN en END) OVER (PARTITION BY clip, k) ELSE en END AS en FROM g QUALIFY new""")
def stutter_dedupe(spark, d):
    return sq.without_repeats(words(spark, d).select("clip", "idx", "word", "en"), tx.letters("word"), ["clip"], "idx")


#: A word list with phrases said twice: after every 40th word its last three, four or five words come again.
TWICE = f"""{WORDS}, tw AS (SELECT clip, idx * 10 AS k, st, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS t FROM words UNION ALL SELECT a.clip, a.idx * 10 + b.i, a.st + 0.1::double * b.i, b.t FROM words a JOIN (SELECT clip, idx, unnest(range(1, n + 1)) AS i, unnest(ts) AS t FROM (SELECT clip, idx, 3 + (idx // 40) % 3 AS n, list(regexp_replace(lower(word), '[^a-z0-9'']', '', 'g')) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS all5, all5[5 - n + 1:] AS ts FROM words) WHERE len(all5) = 5 AND idx % 40 = 20) b ON b.clip = a.clip AND b.idx = a.idx)"""


def said_twice(spark, d):
    w = words(spark, d).select("clip", "idx", "st", F.regexp_replace(F.lower("word"), "[^a-z0-9']", "").alias("t"))
    last = F.collect_list("t").over(Window.partitionBy("clip").orderBy("idx").rowsBetween(-4, 0))
    n = (3 + F.floor(F.col("idx") / 40) % 3).cast("int")
    again = w.withColumn("l", last).filter("size(l) = 5 and idx % 40 = 20").select("clip", "idx", "st", F.posexplode(F.slice("l", 5 - n + 1, n)).alias("i", "t"))
    again = again.select("clip", (F.col("idx") * 10 + F.col("i") + 1).alias("k"), (F.col("st") + 0.1 * (F.col("i") + 1)).alias("st"), "t")
    return w.select("clip", (F.col("idx") * 10).alias("k"), "st", "t").unionByName(again)


@query(f"WITH {TWICE}, l AS (SELECT clip, k, list(t) OVER w AS a, lead(k, 10) OVER o AS m5, lead(k, 8) OVER o AS m4, lead(k, 6) OVER o AS m3 FROM tw WINDOW w AS (PARTITION BY clip ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), o AS (PARTITION BY clip ORDER BY k)), h AS (SELECT clip, k, 5 AS n, a[1:5] AS p FROM l WHERE a[1:5] = a[6:10] AND m5 IS NOT NULL UNION ALL SELECT clip, k, 4, a[1:4] FROM l WHERE a[1:4] = a[5:8] AND m4 IS NOT NULL UNION ALL SELECT clip, k, 3, a[1:3] FROM l WHERE a[1:3] = a[4:6] AND m3 IS NOT NULL) SELECT clip, k, n, array_to_string(p, ' ') AS phrase FROM h WHERE NOT list_contains(p, '')")
def ngram_repeat(spark, d):
    """Phrases of five, four or three words that are said twice in a row."""
    return sq.repeats(said_twice(spark, d).select("clip", "k", "t"), "t", [5, 4, 3], ["clip"], "k").select("clip", "k", "n", "phrase")


@query(f"WITH {TWICE}, l AS (SELECT clip, k, round(st, 1) AS st, list(t) OVER w AS a, lead(k, 10) OVER o AS m5, lead(k, 8) OVER o AS m4, lead(k, 6) OVER o AS m3 FROM tw WINDOW w AS (PARTITION BY clip ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), o AS (PARTITION BY clip ORDER BY k)), h AS (SELECT clip, st, a[1:5] AS p FROM l WHERE a[1:5] = a[6:10] AND m5 IS NOT NULL UNION ALL SELECT clip, st, a[1:4] FROM l WHERE a[1:4] = a[5:8] AND m4 IS NOT NULL UNION ALL SELECT clip, st, a[1:3] FROM l WHERE a[1:3] = a[4:6] AND m3 IS NOT NULL) SELECT clip, round_even(st, 0)::BIGINT AS second, min(struct_pack(st := st, phrase := array_to_string(p, ' '))).phrase AS phrase FROM h WHERE NOT list_contains(p, '') GROUP BY ALL")
def double_takes(spark, d):
    """Doubled phrases of three to five words, one report a second (halves to the even one): the earliest, then the first by text."""
    found = sq.repeats(said_twice(spark, d), "t", [5, 4, 3], ["clip"], "k").withColumn("st", F.round("st", 1))
    return found.groupBy("clip", F.bround("st", 0).cast("bigint").alias("second")).agg(F.min(F.struct("st", "phrase")).alias("x")).select("clip", "second", "x.phrase")


@query(f"WITH {WORDS}, l AS (SELECT clip, turn, idx, lower(word) AS a, lag(lower(word)) OVER (PARTITION BY clip, turn ORDER BY idx) AS b FROM words) SELECT clip, turn, min(idx) AS idx, min_by(a, idx) AS word FROM l WHERE a = b GROUP BY clip, turn")
def doubled_words(spark, d):
    w = words(spark, d).select("clip", "turn", "idx", F.lower("word").alias("word"))
    l = w.withColumn("b", F.lag("word").over(Window.partitionBy("clip", "turn").orderBy("idx"))).filter("word = b")
    return l.groupBy("clip", "turn").agg(F.min("idx").alias("first"), F.min_by("word", "idx").alias("word")).withColumnRenamed("first", "idx")


@query(f"WITH {SPANS} SELECT clip, idx, st, coalesce(lead(st) OVER ({BY_ST}), 2592000.0::double) AS en FROM spans WHERE label = 'purchase'")
def lead_closed_spans(spark, d):
    s = spans(spark, d).filter("label = 'purchase'")
    return s.select("clip", "idx", "st", F.coalesce(F.lead("st").over(Window.partitionBy("clip").orderBy("st", "idx")), F.lit(2592000.0)).alias("en"))


@query(f"WITH {SPANS}, g AS (SELECT clip, st - lag(en) OVER (PARTITION BY clip ORDER BY idx) AS gap FROM spans WHERE label = 'error') SELECT clip, max(gap) AS widest, count(*) AS n FROM g GROUP BY clip HAVING count(*) >= 2 AND max(gap) >= 86400")
def max_gap_filter(spark, d):
    s = spans(spark, d).filter("label = 'error'")
    g = s.select("clip", (F.col("st") - F.lag("en").over(Window.partitionBy("clip").orderBy("idx"))).alias("gap"))
    return g.groupBy("clip").agg(F.max("gap").alias("widest"), F.count("*").alias("n")).filter("n >= 2 and widest >= 86400")


@query(f"""WITH RECURSIVE {SPANS}, n AS (SELECT clip, st, row_number() OVER ({BY_ST}) AS i FROM spans), r AS (SELECT clip, i, st AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.clip, n.i, CASE WHEN n.st - r.last > 14400 THEN n.st ELSE r.last END, n.st - r.last > 14400 FROM r JOIN n ON n.clip = r.clip AND n.i = r.i + 1) SELECT clip, last AS t FROM r WHERE kept""")
def greedy_debounce(spark, d):
    return sq.debounced(spans(spark, d).select("clip", "idx", "st"), "st", 14400.0)


@query(f"""WITH RECURSIVE {SPANS}, n AS (SELECT clip, st, row_number() OVER ({BY_ST}) AS i FROM spans), r AS (SELECT clip, i, st AS anchor, st AS t FROM n WHERE i = 1 UNION ALL SELECT n.clip, n.i, CASE WHEN n.st - r.anchor > 86400 THEN n.st ELSE r.anchor END, n.st FROM r JOIN n ON n.clip = r.clip AND n.i = r.i + 1) SELECT clip, anchor AS st FROM r GROUP BY clip, anchor""")
def anchored_windows(spark, d):
    return sq.anchored(spans(spark, d).select("clip", "idx", "st"), "st", 86400.0)


@query(
    f"""WITH RECURSIVE {SPANS}, n AS (SELECT clip, value, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, count(*) OVER (PARTITION BY clip) AS total FROM spans),
r AS (SELECT clip, i, total, [struct_pack(s := value, n := 1::BIGINT)] AS g FROM n WHERE i = 1 UNION ALL SELECT clip, i, total, CASE WHEN pos > 0 THEN list_transform(g, lambda x, k: CASE WHEN k = pos THEN struct_pack(s := x.s + value, n := x.n + 1) ELSE x END) ELSE list_append(g, struct_pack(s := value, n := 1::BIGINT)) END FROM (SELECT n.clip, n.i, n.total, n.value, r.g, list_position(list_transform(r.g, lambda x: abs(x.s / x.n - n.value) < 20), true) AS pos FROM r JOIN n ON n.clip = r.clip AND n.i = r.i + 1)),
c AS (SELECT clip, total, unnest(g) AS x FROM r WHERE i = total), k AS (SELECT clip, x.s / x.n AS mean, x.n AS n, row_number() OVER (PARTITION BY clip ORDER BY x.n DESC, x.s / x.n) AS rank FROM c WHERE x.n >= 0.05 * total) SELECT * FROM k WHERE rank <= 5"""
)
def value_clusters(spark, d):
    """Greedy one-dimensional clusters in order of arrival, the five largest of at least 5 % of the rows."""
    g = sq.clusters(spans(spark, d).select("clip", "idx", "value"), "value", 20.0)
    w = Window.partitionBy("clip")
    big = g.withColumn("all", F.sum("n").over(w)).filter("n >= 0.05 * all").select("clip", (F.col("total") / F.col("n")).alias("mean"), "n")
    return big.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "mean")).cast("bigint")).filter("rank <= 5")


@query(
    f"""WITH RECURSIVE {SPANS}, f AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM spans WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS run FROM f),
b AS (SELECT clip, label, min(idx) AS first, max(idx) AS last, count(*) AS n, row_number() OVER (PARTITION BY clip ORDER BY min(idx)) AS i FROM g GROUP BY clip, run, label),
r AS (SELECT clip, i, label, first AS block FROM b WHERE i = 1 UNION ALL SELECT b.clip, b.i, CASE WHEN b.n < 2 OR b.label = r.label THEN r.label ELSE b.label END, CASE WHEN b.n < 2 OR b.label = r.label THEN r.block ELSE b.first END FROM r JOIN b ON b.clip = r.clip AND b.i = r.i + 1),
k AS (SELECT r.clip, r.label, block AS first, max(b.last) AS last, sum(b.n)::BIGINT AS n FROM r JOIN b ON b.clip = r.clip AND b.i = r.i GROUP BY ALL) SELECT *, lead(first) OVER (PARTITION BY clip ORDER BY first) AS until FROM k"""
)
def min_block_absorb(spark, d):
    """Label runs shorter than two rows taken over by the block before; neighbours of one label then join, and each block reaches up to the next."""
    blocks = sq.runs(spans(spark, d).select("clip", "idx", "label"), "label", ["clip"], "idx").select("clip", "first", "last", "label", "n")
    return sq.absorbed(blocks, 2).withColumn("until", F.lead("first").over(Window.partitionBy("clip").orderBy("first")))


@query(f"WITH {SPANS}, m AS (SELECT clip, median(value) AS med FROM spans GROUP BY clip), a AS (SELECT s.clip, m.med, median(abs(value - m.med)) AS mad FROM spans s JOIN m USING (clip) GROUP BY s.clip, m.med) SELECT s.clip, idx, value FROM spans s JOIN a USING (clip) WHERE (value - med) / (1.4826::double * (mad + 1e-6)) > 8 AND value > 2.5::double * med")
def robust_outlier(spark, d):
    s = spans(spark, d).select("clip", "idx", "value")
    med = s.groupBy("clip").agg(F.median("value").alias("med"))
    mad = s.join(med, "clip").groupBy("clip", "med").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    far = (F.col("value") - F.col("med")) / (1.4826 * (F.col("mad") + 1e-6)) > 8
    return s.join(mad, "clip").filter(far & (F.col("value") > 2.5 * F.col("med"))).select("clip", "idx", "value")


@query(f"""WITH {SPANS}, m AS (SELECT clip, median(value) AS med FROM spans GROUP BY clip), x AS (SELECT s.clip, s.idx, CASE WHEN abs(value - med) > 60 THEN NULL ELSE value END AS x FROM spans s JOIN m USING (clip)),
f AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, first_value(x IGNORE NULLS) OVER f AS x1, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS t1 FROM x WINDOW b AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT clip, idx, CASE WHEN x IS NOT NULL THEN x WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * ((idx - t0) / (t1 - t0)) END AS smooth FROM f""")
def linear_fill(spark, d):
    s = spans(spark, d).select("clip", "idx", "value")
    med = s.groupBy("clip").agg(F.median("value").alias("med"))
    x = s.join(med, "clip").select("clip", "idx", F.when(F.abs(F.col("value") - F.col("med")) <= 60, F.col("value")).alias("x"))
    return sq.filled(x, "x", ["clip"], "idx", "smooth").select("clip", "idx", "smooth")


@query(f"WITH {WORDS} SELECT clip, (idx // 3)::BIGINT AS block, min_by(t, (-length(t), idx)) AS emphasis FROM (SELECT clip, idx, regexp_replace(lower(word), '[^a-z]', '', 'g') AS t FROM words) WHERE length(t) >= 5 GROUP BY ALL")
def block_emphasis(spark, d):
    """The longest word of five letters at least of each block of three; the first on a tie."""
    w = words(spark, d).select("clip", "idx", F.regexp_replace(F.lower("word"), "[^a-z]", "").alias("t")).filter("length(t) >= 5")
    return w.groupBy("clip", F.floor(F.col("idx") / 3).alias("block")).agg(F.min_by("t", F.struct(-F.length("t"), "idx")).alias("emphasis"))


@query(f"WITH {WORDS}, n AS (SELECT clip, idx, row_number() OVER (PARTITION BY clip ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM words), b AS (SELECT clip, idx, i, n, unnest(range(greatest(0, (i - 2) // 48), i // 48 + 1)) AS batch FROM n) SELECT clip, batch, min(idx) AS first, count(*) AS n FROM b WHERE i >= batch * 48 AND i < batch * 48 + 50 AND (batch = 0 OR (batch - 1) * 48 + 50 < n) GROUP BY clip, batch")
def overlapping_batches(spark, d):
    """Batches of 50 words that overlap by two; none starts once an earlier one has reached the end."""
    w = words(spark, d).select("clip", "idx", (F.row_number().over(Window.partitionBy("clip").orderBy("idx")) - 1).alias("i"), F.count("*").over(Window.partitionBy("clip")).alias("all"))
    lo = F.greatest(F.lit(0), F.floor((F.col("i") - 2) / 48))
    b = w.withColumn("batch", F.explode(F.sequence(lo.cast("bigint"), F.floor(F.col("i") / 48))))
    ok = (F.col("i") >= F.col("batch") * 48) & (F.col("i") < F.col("batch") * 48 + 50) & ((F.col("batch") == 0) | ((F.col("batch") - 1) * 48 + 50 < F.col("all")))
    return b.filter(ok).groupBy("clip", "batch").agg(F.min("idx").alias("first"), F.count("*").alias("n"))


@query(f"WITH {SPANS} SELECT clip, idx, 10 * log10(avg(value * value) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-9) AS db FROM spans")
def framed_energy(spark, d):
    w = Window.partitionBy("clip").orderBy("idx").rowsBetween(-4, 0)
    return spans(spark, d).select("clip", "idx", (10 * F.log10(F.avg(F.col("value") * F.col("value")).over(w) + 1e-9)).alias("db"))


@query(f"WITH {SPANS} SELECT clip, min_by(st, (value, idx)) AS quietest, min(value) AS level FROM spans WHERE st BETWEEN 86400 AND 864000 GROUP BY clip")
def quietest_window(spark, d):
    return spans(spark, d).filter("st between 86400 and 864000").groupBy("clip").agg(F.min_by("st", F.struct("value", "idx")).alias("quietest"), F.min("value").alias("level"))


@query(f"WITH {SPANS} SELECT clip, min(st) FILTER (value > 50) AS first_bright, max(st) FILTER (value > 50) AS last_bright FROM spans GROUP BY clip")
def bright_edges(spark, d):
    s = F.when(F.col("value") > 50, F.col("st"))
    return spans(spark, d).groupBy("clip").agg(F.min(s).alias("first_bright"), F.max(s).alias("last_bright"))


@query(f"WITH {WORDS}, t AS (SELECT clip, turn, idx, lower(regexp_replace(word, '[^A-Za-z]', '', 'g')) IN ('the', 'and', 'of', 'a', 'die', 'der', 'la', 'de', 'et', 'en') AS filler FROM words), e AS (SELECT clip, turn, min(idx) FILTER (NOT filler) AS lo, max(idx) FILTER (NOT filler) AS hi FROM t GROUP BY ALL) SELECT t.clip, t.idx FROM t JOIN e ON t.clip = e.clip AND t.turn = e.turn WHERE idx BETWEEN lo AND hi")
def edge_filler_trim(spark, d):
    """Leading and trailing filler words of a turn dropped; those inside stay."""
    t = words(spark, d).select("clip", "turn", "idx", tx.is_any("word", ["the", "and", "of", "a", "die", "der", "la", "de", "et", "en"]).alias("filler"))
    real = F.when(~F.col("filler"), F.col("idx"))
    e = t.groupBy("clip", "turn").agg(F.min(real).alias("lo"), F.max(real).alias("hi"))
    return t.join(e, ["clip", "turn"]).filter("idx between lo and hi").select("clip", "idx")


@query(f"WITH {WORDS}, c AS (SELECT clip, idx, lower(word) AS w, floor(length(word) / 3) AS n FROM words), x AS (SELECT clip, idx, idx - row_number() OVER (PARTITION BY clip ORDER BY idx) AS k FROM c WHERE n = 0) SELECT clip, min(idx) AS first, count(*) AS n FROM x GROUP BY clip, k HAVING count(*) >= 2")
def adjacent_runs(spark, d):
    """Runs of neighbouring short words, told by index minus row number."""
    w = words(spark, d).filter(F.floor(F.length("word") / 3) == 0)
    x = w.select("clip", "idx", (F.col("idx") - F.row_number().over(Window.partitionBy("clip").orderBy("idx"))).alias("k"))
    return x.groupBy("clip", "k").agg(F.min("idx").alias("first"), F.count("*").alias("n")).filter("n >= 2").drop("k")


@query(f"WITH {SPANS}, p AS (SELECT clip, idx, st, en, value > 30 AS shown FROM spans), f AS (SELECT *, CASE WHEN lag(shown) OVER w IS DISTINCT FROM shown THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY clip ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY idx) AS k FROM f) SELECT clip, min(st) AS st, max(en) AS en, count(*) AS frames FROM g WHERE shown GROUP BY clip, k")
def present_spans(spark, d):
    w = Window.partitionBy("clip").orderBy("idx")
    p = spans(spark, d).select("clip", "idx", "st", "en", (F.col("value") > 30).alias("shown"))
    p = p.withColumn("new", ~F.col("shown").eqNullSafe(F.lag("shown").over(w)))
    g = iv.islands(p, F.col("new"), ["idx"], ["clip"])
    return g.filter("shown").groupBy("clip", "island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("frames")).drop("island")


@query(f"WITH {SPANS}, l AS (SELECT *, lag(en) OVER ({BY_ST}) AS pe, row_number() OVER ({BY_ST}) AS i FROM spans WHERE label = 'view'), g AS (SELECT *, sum(CASE WHEN pe IS NULL OR abs(st - pe) >= 3600 THEN 1 ELSE 0 END) OVER ({BY_ST}) AS run FROM l) SELECT clip, idx, run::BIGINT AS run, min(st) OVER (PARTITION BY clip, run) AS run_st FROM g")
def contiguous_segments(spark, d):
    """Segments that follow one another closely share a run; each row carries its run's start."""
    w = Window.partitionBy("clip").orderBy("st", "idx")
    s = spans(spark, d).filter("label = 'view'").withColumn("pe", F.lag("en").over(w))
    g = iv.islands(s, F.col("pe").isNull() | (F.abs(F.col("st") - F.col("pe")) >= 3600), ["st", "idx"], ["clip"], "run")
    return g.select("clip", "idx", "run", F.min("st").over(Window.partitionBy("clip", "run")).alias("run_st"))
