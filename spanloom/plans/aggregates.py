"""Queries of aggregation, scoring, ranking, set operations and keyed joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import timecode as tc
from spanloom.operators import tables as tb
from spanloom.sources.tables import SPANS, spans, table

from .registry import query

# fixed values: weights of opening, exit and structure tags
OPEN_LIFT = {"view": 3.99, "click": 1.43, "error": 0.18}
EXIT_LIFT = {"0": 1.61, "1": 1.39, "2": 0.35}


@query("SELECT event_type AS stage, count(*) AS n, sum(value) AS total, avg(value) AS mean, median(value) AS p50, list_sort(list(value))[floor(count(*) * 0.95::double)::BIGINT + 1] AS p95, 100.0::double * count(*) FILTER (event_id % 11 = 0) / count(*) AS fail_pct FROM events GROUP BY event_type")
def latency_profile(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), "value", (F.col("event_id") % 11 == 0).alias("failed"))
    return tb.latency_summary(e, "stage", "value", "failed")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS fails, count(*) FILTER (event_type = 'view') AS passes, CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'REVISE' ELSE 'APPROVE' END AS verdict FROM events GROUP BY user_id")
def status_verdict(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    bad = F.bool_or((F.col("event_type") == "error") & (F.col("value") > 60))
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fails"), F.count_if(F.col("event_type") == "view").alias("passes"), F.when(bad, "REVISE").otherwise("APPROVE").alias("verdict"))


@query("SELECT p_type AS kind, count(*) AS n FROM part WHERE p_size <> 1 GROUP BY p_type")
def category_histogram(spark, d):
    return table(spark, d, "part").filter("p_size <> 1").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


CENTROIDS = "e AS (SELECT vec_id, label, unnest(embedding)::double AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), dist AS (SELECT e.vec_id, e.label, sqrt(sum(power((e.x - c.m) / 0.5::double, 2))) AS distance FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY ALL)"


@query(f"WITH {CENTROIDS} SELECT vec_id, label, distance FROM dist")
def centroid_distance(spark, d):
    return tb.centroid_distance(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.5)


@query(f"WITH {CENTROIDS} SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM dist) WHERE rank <= 5")
def nearest_to_centroid(spark, d):
    c = tb.centroid_distance(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.5)
    return tb.top_per_key(c, ["label"], [F.col("distance"), F.col("vec_id")], 5).select("label", "vec_id", "rank")


@query("""SELECT event_id, 0.35::double * coalesce(o.l, 1) + 0.40::double * coalesce(x.l, 1) + 0.25::double AS lift, CASE WHEN 0.35::double * coalesce(o.l, 1) + 0.40::double * coalesce(x.l, 1) + 0.25::double >= 1.25::double THEN 'MINE' WHEN 0.35::double * coalesce(o.l, 1) + 0.40::double * coalesce(x.l, 1) + 0.25::double >= 1 THEN 'MAYBE' ELSE 'SKIP' END AS verdict
FROM events LEFT JOIN (VALUES ('view', 3.99::double), ('click', 1.43), ('error', 0.18)) o(k, l) ON o.k = lower(event_type) LEFT JOIN (VALUES ('0', 1.61::double), ('1', 1.39), ('2', 0.35)) x(k, l) ON x.k = (event_id % 5)::varchar""")
def lift_score(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 5).cast("string").alias("exit"))
    e = tb.with_dimension(tb.with_dimension(e, "event_type", OPEN_LIFT, "o"), "exit", EXIT_LIFT, "x")
    return e.withColumn("lift", 0.35 * F.col("o") + 0.40 * F.col("x") + 0.25).select("event_id", "lift", F.when(F.col("lift") >= 1.25, "MINE").when(F.col("lift") >= 1, "MAYBE").otherwise("SKIP").alias("verdict"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 500 BETWEEN 180 AND 600 THEN 1.0::double WHEN o_totalprice / 500 >= 90 AND o_totalprice / 500 < 180 THEN 0.5::double + 0.5::double * (o_totalprice / 500 - 90) / 90 WHEN o_totalprice / 500 > 600 AND o_totalprice / 500 <= 1200 THEN 1.0::double - 0.6::double * (o_totalprice / 500 - 600) / 600 ELSE 0.3::double END AS score FROM orders")
def duration_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tc.duration_score(F.col("o_totalprice") / 500).alias("score"))


@query(f"WITH {SPANS}, k AS (SELECT *, floor(st / 3600)::BIGINT AS slot, row_number() OVER (PARTITION BY clip, floor(st / 3600) ORDER BY value DESC, idx) AS r FROM spans) SELECT clip, slot, idx FROM k WHERE r = 1")
def dedupe_chunks(spark, d):
    """One row a clip and hour: the longest, first on a tie."""
    s = spans(spark, d).select("clip", "idx", "value", F.floor(F.col("st") / 3600).alias("slot"))
    return s.groupBy("clip", "slot").agg(F.min_by("idx", F.struct(-F.col("value"), "idx")).alias("idx"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type <> 'view' GROUP BY ALL) SELECT user_id, min_by(event_type, (-n, first)) AS mode FROM n GROUP BY user_id")
def mode_exclusion(spark, d):
    """Most frequent label other than the excluded one; the first seen on a tie."""
    n = table(spark, d, "events").filter("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "first")).alias("mode"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, avg(value) FILTER (r <= greatest(1, n // 10)) AS floor_mean, avg((value > 30)::INT) AS above FROM r GROUP BY user_id")
def bottom_decile_mean(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", "value", F.row_number().over(w.orderBy("value", "event_id")).alias("r"), F.count("*").over(w).alias("n"))
    low = F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.col("value"))
    return e.groupBy("user_id").agg(F.avg(low).alias("floor_mean"), F.avg(F.when(F.col("value") > 30, 1.0).otherwise(0.0)).alias("above"))


@query("WITH p AS (SELECT user_id, quantile_cont(value, 0.95) - 20 AS lo FROM events GROUP BY user_id) SELECT e.user_id, median(value) AS level FROM events e JOIN p USING (user_id) WHERE value >= lo GROUP BY e.user_id")
def conditional_median(spark, d):
    e = table(spark, d, "events").select("user_id", "value")
    p = e.groupBy("user_id").agg((F.percentile("value", 0.95) - 20).alias("lo"))
    return e.join(p, "user_id").filter("value >= lo").groupBy("user_id").agg(F.median("value").alias("level"))


@query(f"WITH {SPANS}, w AS (SELECT clip, floor(st / 86400)::BIGINT AS win, avg(value) AS level, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 3) SELECT clip, win, level, level - avg(level) OVER (PARTITION BY clip) AS delta FROM w")
def tumbling_levels(spark, d):
    w = spans(spark, d).groupBy("clip", F.floor(F.col("st") / 86400).alias("win")).agg(F.avg("value").alias("level"), F.count("*").alias("n")).filter("n >= 3")
    return w.select("clip", "win", "level", (F.col("level") - F.avg("level").over(Window.partitionBy("clip"))).alias("delta"))


@query(f"WITH {SPANS} SELECT clip, 1 - sum(en - st) / (max(en) - min(st)) AS keep_ratio, 1 - sum(en - st) / (max(en) - min(st)) < 0.6::double AS aborts FROM spans GROUP BY clip")
def keep_ratio(spark, d):
    r = 1 - F.sum(F.col("en") - F.col("st")) / (F.max("en") - F.min("st"))
    return spans(spark, d).groupBy("clip").agg(r.alias("keep_ratio"), (r < 0.6).alias("aborts"))


@query("SELECT ts::DATE AS day, count(*) AS calls, greatest(0, 400 - count(*))::BIGINT AS remaining FROM events GROUP BY day")
def daily_cap(spark, d):
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))
    return n.select("day", "calls", F.greatest(F.lit(0), 400 - F.col("calls")).alias("remaining"))


@query("WITH b AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS spent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS calls FROM events) SELECT user_id, event_id, spent FROM b WHERE spent <= 1500 AND calls <= 80")
def running_budget(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    b = table(spark, d, "events").select("user_id", "event_id", F.sum("value").over(w).alias("spent"), F.row_number().over(w).alias("calls"))
    return b.filter("round(spent, 9) <= 1500 and calls <= 80").drop("calls")  # a sum of exactly 1500 may end some 1e-11 above it


@query(f"WITH {SPANS}, g AS (SELECT clip, unnest(range(0, floor((SELECT max(st) FROM spans) / 3600)::BIGINT + 1)) * 3600.0::double AS t FROM (SELECT DISTINCT clip FROM spans)), a AS (SELECT clip, st, arg_max(label, idx) AS la FROM spans WHERE label IN ('view', 'click') GROUP BY ALL), b AS (SELECT clip, st, arg_max(CASE WHEN label = 'purchase' THEN 'click' ELSE 'view' END, idx) AS lb FROM spans WHERE label IN ('purchase', 'error') GROUP BY ALL), x AS (SELECT g.clip, g.t, a.la FROM g ASOF LEFT JOIN a ON g.clip = a.clip AND g.t >= a.st), y AS (SELECT x.*, b.lb FROM x ASOF LEFT JOIN b ON x.clip = b.clip AND x.t >= b.st) SELECT clip, avg((la = lb)::INT) AS agreement FROM y GROUP BY clip")
def agreement_rate(spark, d):
    """Share of an hourly grid, up to the last start in the table, on which two sources hold the same label."""
    from spanloom.operators import intervals as iv

    s = spans(spark, d)
    hours = F.broadcast(s.agg(F.floor(F.max("st") / 3600).alias("last")))  # one row
    grid = s.select("clip").distinct().crossJoin(hours).select("clip", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("idx")).withColumn("t", F.col("idx") * 3600.0)
    a = s.filter(F.col("label").isin("view", "click")).select("clip", "idx", "st", "label")
    b = s.filter(F.col("label").isin("purchase", "error")).select("clip", "idx", "st", F.when(F.col("label") == "purchase", "click").otherwise("view").alias("label"))
    both = iv.asof(iv.asof(grid, a, "st", ["label"], prefix="a_"), b, "st", ["label"], prefix="b_")
    return both.groupBy("clip").agg(F.avg((F.col("a_label") == F.col("b_label")).cast("int")).alias("agreement"))


@query("SELECT user_id, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) / count(*) AS rate, min(value) AS worst, count(*) FILTER (value < 5) AS weak FROM events GROUP BY user_id HAVING count(*) >= 10")
def hit_rate_gate(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg((F.sum(F.when(F.col("value") > 20, 1).otherwise(0)) / F.count("*")).alias("rate"), F.min("value").alias("worst"), F.count_if(F.col("value") < 5).alias("weak"), F.count("*").alias("n"))
    return e.filter("n >= 10").drop("n")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'FAIL' WHEN count(*) < 3 THEN 'SKIP' ELSE 'PASS' END AS gate, coalesce(string_agg(event_id::varchar, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS failures FROM events GROUP BY user_id")
def any_fail_rollup(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    bad = F.col("event_type") == "error"
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return e.groupBy("user_id").agg(F.when(F.bool_or(bad), "FAIL").when(F.count("*") < 3, "SKIP").otherwise("PASS").alias("gate"), failed.alias("failures"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'COMPLETE' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'UNAVAILABLE' ELSE 'PARTIAL' END AS status, list_sort(list(DISTINCT o_orderpriority)) AS kinds, sum(o_totalprice) AS cost FROM orders GROUP BY o_custkey")
def completeness_status(spark, d):
    done = F.count_if(F.col("o_orderstatus") == "F")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.groupBy("o_custkey").agg(done.alias("done"), F.count("*").alias("total"), F.when(done == F.count("*"), "COMPLETE").when(done == 0, "UNAVAILABLE").otherwise("PARTIAL").alias("status"), F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"), F.sum("o_totalprice").alias("cost"))


@query("WITH m AS (SELECT user_id, median(value) FILTER (event_type = 'view') AS a, median(value) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'view') AS na, count(*) FILTER (event_type = 'click') AS nb FROM events GROUP BY user_id) SELECT user_id, CASE WHEN na >= 3 AND nb >= 3 AND abs(a - b) >= 6 THEN (a + b) / 2 END AS threshold FROM m")
def anchor_midpoint(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    pick = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    m = e.groupBy("user_id").agg(F.median(pick("view")).alias("a"), F.median(pick("click")).alias("b"), F.count(pick("view")).alias("na"), F.count(pick("click")).alias("nb"))
    return m.select("user_id", F.when((F.col("na") >= 3) & (F.col("nb") >= 3) & (F.abs(F.col("a") - F.col("b")) >= 6), (F.col("a") + F.col("b")) / 2).alias("threshold"))


@query("SELECT conv_id, list_sort(list(DISTINCT role)) AS roles, count(DISTINCT role) AS n_roles, list_has_all(['user', 'assistant'], list(DISTINCT role)) AS known FROM conversations GROUP BY conv_id")
def distinct_styles(spark, d):
    roles = F.collect_set("role")
    c = table(spark, d, "conversations").select("conv_id", "role").groupBy("conv_id").agg(F.array_sort(roles).alias("roles"))
    return c.select("conv_id", "roles", F.size("roles").cast("bigint").alias("n_roles"), (F.size(F.array_except("roles", F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("known"))


@query(f"WITH {SPANS}, g AS (SELECT clip, lead(st) OVER (PARTITION BY clip ORDER BY st, idx) - en AS gap FROM spans) SELECT clip, count(*) FILTER (gap > 0 AND gap < 1800) / greatest(1, count(*) - 1) AS ratio, count(*) FILTER (gap > 0 AND gap < 1800) / greatest(1, count(*) - 1) > 0.3::double AS fails FROM g GROUP BY clip")
def cue_gap_ratio(spark, d):
    g = spans(spark, d).select("clip", (F.lead("st").over(Window.partitionBy("clip").orderBy("st", "idx")) - F.col("en")).alias("gap"))
    r = F.count_if((F.col("gap") > 0) & (F.col("gap") < 1800)) / F.greatest(F.lit(1), F.count("*") - 1)
    return g.groupBy("clip").agg(r.alias("ratio"), (r > 0.3).alias("fails"))


@query("SELECT user_id, count(*) FILTER (event_type IN ('click', 'purchase')) > count(*) / 2 AS is_guest, avg((event_type = 'view')::INT) AS host_share FROM events GROUP BY user_id")
def weighted_majority(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type")
    return e.groupBy("user_id").agg((F.count_if(F.col("event_type").isin("click", "purchase")) > F.count("*") / 2).alias("is_guest"), F.avg((F.col("event_type") == "view").cast("int")).alias("host_share"))


@query("WITH x AS (SELECT user_id, value, event_id % 97 + value / 2 AS other FROM events WHERE value > 2) SELECT user_id, corr(value, other) AS r, corr(value, other) < 0.65::double AS isolated FROM x GROUP BY user_id HAVING count(*) >= 20 AND stddev_pop(value) >= 1e-3")
def channel_correlation(spark, d):
    x = table(spark, d, "events").filter("value > 2").select("user_id", "value", (F.col("event_id") % 97 + F.col("value") / 2).alias("other"))
    r = F.corr("value", "other")
    return x.groupBy("user_id").agg(r.alias("r"), (r < 0.65).alias("isolated"), F.count("*").alias("n"), F.stddev_pop("value").alias("sd")).filter("n >= 20 and sd >= 1e-3").drop("n", "sd")


@query("WITH t AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN turns < 4 AND chars > 1200 THEN 'hotline' ELSE 'interview' END AS format FROM t")
def format_inference(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return t.select("conv_id", F.when((F.col("turns") < 4) & (F.col("chars") > 1200), "hotline").otherwise("interview").alias("format"))


@query("SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY CASE label WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, total DESC) AS rank FROM (SELECT user_id, event_type AS label, sum(value) AS total FROM events GROUP BY ALL)")
def enum_order(spark, d):
    t = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.sum("value").alias("total"))
    order = F.when(F.col("label") == "purchase", 0).when(F.col("label") == "click", 1).when(F.col("label") == "view", 2).otherwise(3)
    return t.select("user_id", "label", F.row_number().over(Window.partitionBy("user_id").orderBy(order, F.desc("total"))).cast("bigint").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def multi_key_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type = 'error') WHERE rank <= 5")
def issue_truncation(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select("user_id", "event_id")
    return tb.top_per_key(e, ["user_id"], [F.col("event_id")], 5)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey")
def newest_by_time(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("newest"))


@query("SELECT p_brand, min_by(p_partkey, (-p_size, p_partkey)) AS best FROM part GROUP BY p_brand")
def argmax_first_wins(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), "p_partkey")).alias("best"))


@query("WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 20 AND p_partkey % 3 > 0 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS tier, (p_partkey * 2654435761 + 42) % 1000003 AS draw FROM part) SELECT p_brand, min_by(p_partkey, (tier, draw, p_partkey)) AS chosen, min(tier)::BIGINT AS tier FROM p GROUP BY p_brand")
def seeded_choice(spark, d):
    """One part a brand, drawn by a seeded hash, the same on every run and cluster: from those unused and viable, else viable, else any."""
    k = F.col("p_partkey")
    tier = F.when((F.col("p_size") > 20) & (k % 3 > 0), 0).when(F.col("p_size") > 20, 1).otherwise(2)
    p = table(spark, d, "part").select("p_brand", "p_partkey", tier.cast("long").alias("tier"), ((k * 2654435761 + 42) % 1000003).alias("draw"))
    return p.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("tier", "draw", "p_partkey")).alias("chosen"), F.min("tier").alias("tier"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ledger_antijoin(spark, d):
    """Customers that the ledger of urgent orders doesn't name."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 10 = 0")
def upsert_merge(spark, d):
    """A third of the rows overwritten by key and a tenth new."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).unionByName(c.filter("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
    return tb.upserted(c, new, ["c_custkey"])


@query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def except_set(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct()
    return a.join(table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


@query("SELECT c_custkey AS key, c_acctbal AS amount, 'customer' AS track FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def tagged_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.lit("customer").alias("track"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount"), F.lit("supplier").alias("track")))


@query("SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS saved, b.n AS live, a.n IS DISTINCT FROM b.n AS mismatch FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def identity_check(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("saved"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("live"))
    return a.join(b, "k", "full").select("k", "saved", "live", (~F.col("saved").eqNullSafe(F.col("live"))).alias("mismatch"))


@query("SELECT l.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'remove' WHEN l.toxic = 1 THEN 'trim' END, 'keep') AS action FROM (SELECT doc_id FROM documents) d JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'keep' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def decisions_with_default(spark, d):
    """Every document's decision; one without a label is kept."""
    act = F.when(F.col("quality") == 0, "remove").when(F.col("toxic") == 1, "trim")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", act.alias("a")), "doc_id", "left").select("doc_id", F.coalesce("a", F.lit("keep")).alias("action"))


@query("WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem) SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(l_quantity) AS qty, max(l_shipdate) - min(l_shipdate) > INTERVAL 60 DAY AS spread FROM l GROUP BY l_orderkey HAVING count(*) >= 5")
def order_summary(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    wide = F.max("l_shipdate").cast("timestamp").cast("double") - F.min("l_shipdate").cast("timestamp").cast("double") > 60 * 86400
    return l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.sum("l_quantity").alias("qty"), wide.alias("spread")).filter("n >= 5")


@query("SELECT n_regionkey, c_mktsegment, grouping(n_regionkey)::BIGINT + 0 AS all_regions, count(*) AS n, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def segment_cube(spark, d):
    """An addition: totals over every combination of region and segment."""
    j = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    return j.cube("n_regionkey", "c_mktsegment").agg(F.grouping("n_regionkey").cast("bigint").alias("all_regions"), F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))
