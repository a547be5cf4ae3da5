"""Queries that look for words, phrases and decisions of one text in another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import phrases as ph
from spanloom.sources.tables import WORDS, table, words

from .registry import query

LETTERS = "regexp_replace(lower(word), '[^a-z'']', '', 'g')"
ALNUM = "regexp_replace(lower(word), '[^a-z0-9]', '', 'g')"
PHRASES = [["of", "the"], ["that", "is"], ["and", "the"]]
#: Each turn's tokens, and a version of it: a part from its middle (turns 0, 3, ..), its inside thinned out (1, 4, ..), or turned round (2, 5, ..).
VERSIONS = f"""{WORDS}, tok AS (SELECT clip, turn, list(t ORDER BY idx) AS have, min_by(st, idx) AS st, max_by(en, idx) AS en, list(st ORDER BY idx) AS sts, list(en ORDER BY idx) AS ens FROM (SELECT *, {ALNUM} AS t FROM words) WHERE t <> '' GROUP BY clip, turn),
v AS (SELECT *, CASE turn % 3 WHEN 0 THEN have[3:len(have) - 3] WHEN 1 THEN list_filter(have, lambda x, i: i % 4 <> 3) ELSE list_reverse(have) END AS want FROM tok)"""


def versions(spark, d) -> DataFrame:
    w = words(spark, d).select("clip", "turn", "idx", tx.alphanumerics("word").alias("t"), "st", "en").filter("t <> ''")
    rows = F.array_sort(F.collect_list(F.struct("idx", "t", "st", "en")))
    each = w.groupBy("clip", "turn").agg(rows.alias("r")).select("clip", "turn", F.col("r.t").alias("have"), F.col("r.st").alias("sts"), F.col("r.en").alias("ens"))
    n = F.size("have")
    thin = F.filter("have", lambda x, i: i % 4 != 2)
    want = F.when(F.col("turn") % 3 == 0, F.slice("have", F.lit(3), F.greatest(F.lit(0), n - 5))).when(F.col("turn") % 3 == 1, thin).otherwise(F.reverse("have"))
    return each.withColumn("want", want)


@query(
    "WITH " + WORDS + f", t AS (SELECT *, {ALNUM} AS t FROM words), l AS (SELECT *, lead(t) OVER w AS t2, lead(en) OVER w AS en2 FROM t WINDOW w AS (PARTITION BY clip ORDER BY idx)), p AS (SELECT * FROM (VALUES ('of', 'the'), ('that', 'is'), ('and', 'the')) AS p(a, b))"
    " SELECT clip, a || ' ' || b AS phrase, min(st) FILTER (st BETWEEN 0 AND 5000) AS first_start, min(en2) FILTER (en2 BETWEEN 0 AND 5000) + 0.12::double AS first_end, count(*) AS n FROM l JOIN p ON t = a AND t2 = b GROUP BY ALL"
)
def phrase_positions(spark, d):
    """Where phrases of several words first start and end within a time range."""
    w = words(spark, d).select("clip", "idx", "st", "en", tx.alphanumerics("word").alias("t"))
    found = None
    for p in PHRASES:
        hit = ph.phrase_starts(w, "t", p, ["clip"], "idx").select("clip", F.lit(" ".join(p)).alias("phrase"), "st", F.col("tail.en").alias("en"))
        found = hit if found is None else found.unionByName(hit)
    inside = lambda c: F.when(F.col(c).between(0, 5000), F.col(c))
    return found.groupBy("clip", "phrase").agg(F.min(inside("st")).alias("first_start"), (F.min(inside("en")) + 0.12).alias("first_end"), F.count("*").alias("n"))


@query(
    f"WITH {VERSIONS}, a AS (SELECT *, list_filter(range(1, greatest(1, len(have) - len(want) + 1) + 1), lambda i: have[i:i + len(want) - 1] = want) AS hits, list_position(have, want[1]) AS lead_at, list_position(list_reverse(have), want[len(want)]) AS tail_at FROM v),"
    " s AS (SELECT *, CASE WHEN len(want) = 0 THEN NULL WHEN len(hits) > 0 THEN hits[1] WHEN lead_at > 0 AND tail_at > 0 THEN lead_at END AS lo, CASE WHEN len(want) = 0 THEN NULL WHEN len(hits) > 0 THEN hits[1] + len(want) - 1 WHEN lead_at > 0 AND tail_at > 0 THEN len(have) - tail_at + 1 END AS hi FROM a),"
    " c AS (SELECT clip, turn, 'empty' AS reason, st, en FROM s WHERE len(want) = 0 UNION ALL SELECT clip, turn, 'lead', st, sts[lo] FROM s WHERE lo > 1 UNION ALL SELECT clip, turn, 'tail', ens[hi], en FROM s WHERE hi < len(have)) SELECT * FROM c WHERE en > st"
)
def sublist_cuts(spark, d):
    """What to cut from each turn so that the part that its version keeps is left."""
    s = versions(spark, d).withColumn("at", ph.sublist(F.col("have"), F.col("want")))
    st, en = F.get("sts", F.lit(0)), F.get("ens", F.size("ens") - 1)
    cut = lambda reason, a, b: F.struct(F.lit(reason).alias("reason"), a.alias("st"), b.alias("en"))
    cuts = F.array_compact(F.array(F.when(F.size("want") == 0, cut("empty", st, en)), F.when(F.col("at.first") > 1, cut("lead", st, F.get("sts", F.col("at.first") - 1))), F.when(F.col("at.last") < F.size("have"), cut("tail", F.get("ens", F.col("at.last") - 1), en))))
    return s.select("clip", "turn", F.explode(cuts).alias("c")).select("clip", "turn", "c.*").filter("en > st")


@query(
    f"WITH RECURSIVE {VERSIONS}, r AS (SELECT clip, turn, have, want, 0 AS i, 0 AS t, []::BOOLEAN[] AS mask FROM v UNION ALL SELECT clip, turn, have, want, i + 1, t + coalesce(have[i + 1] = want[t + 1], false)::INT, list_append(mask, coalesce(have[i + 1] = want[t + 1], false)) FROM r WHERE i < len(have))"
    " SELECT clip, turn, CASE WHEN len(want) = 0 OR t / len(want) >= 0.6 THEN mask END AS mask FROM r WHERE i = len(have)"
)
def kept_words(spark, d):
    """Which words of a turn its version keeps, matched one after another; null where too few match."""
    return versions(spark, d).select("clip", "turn", ph.kept_mask(F.col("have"), F.col("want")).alias("mask"))


#: Replies with a decision line for most rows of a user; some twice, some malformed.
REPLIES = """rep AS (SELECT user_id, count(*) AS total, '```\n' || string_agg(line, '\n' ORDER BY event_id) || '\n```' AS reply FROM (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN '[' || i || '] KEEP' WHEN 'click' THEN '[' || i || '] trim: part ' || event_id WHEN 'error' THEN '  [' || i || ']  REMOVE' WHEN 'purchase' THEN '[' || i // 2 || '] TRIM: ' ELSE 'row ' || i || ' is fine' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)) GROUP BY user_id)"""


def replies(spark, d) -> DataFrame:
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", i)
    mark = F.concat(F.lit("["), "i", F.lit("]"))
    line = F.when(F.col("event_type") == "view", F.concat(mark, F.lit(" KEEP"))).when(F.col("event_type") == "click", F.concat(mark, F.lit(" trim: part "), "event_id")).when(F.col("event_type") == "error", F.concat(F.lit("  "), mark, F.lit("  REMOVE"))).when(F.col("event_type") == "purchase", F.concat(F.lit("["), F.floor(F.col("i") / 2), F.lit("] TRIM: "))).otherwise(F.concat(F.lit("row "), "i", F.lit(" is fine")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return e.groupBy("user_id").agg(F.count("*").alias("total"), F.concat(F.lit("```\n"), lines, F.lit("\n```")).alias("reply"))


@query(
    "WITH " + REPLIES + r""", l AS (SELECT user_id, trim(unnest(string_split(reply, E'\n'))) AS line, unnest(range(len(string_split(reply, E'\n')))) AS pos FROM rep), m AS (SELECT user_id, pos, regexp_extract(line, '(?i)^\[(\d+)\]\s+(KEEP|REMOVE|TRIM)(?:\s*:\s*(.*))?$', ['i', 'action', 'rest']) AS x FROM l WHERE regexp_matches(line, '(?i)^\[(\d+)\]\s+(KEEP|REMOVE|TRIM)(?:\s*:\s*(.*))?$')),
d AS (SELECT user_id, x.i::BIGINT AS i, max_by(lower(x.action), pos) AS action, max_by(trim(x.rest), pos) AS rest FROM m GROUP BY ALL), e AS (SELECT user_id, unnest(range(total)) AS i FROM rep)
SELECT e.user_id, e.i, CASE WHEN d.i IS NULL OR (action = 'trim' AND rest = '') THEN 'keep' ELSE action END AS action, CASE WHEN rest <> '' THEN rest END AS kept_text FROM e LEFT JOIN d ON d.user_id = e.user_id AND d.i = e.i"""
)
def decision_lines(spark, d):
    """Decisions parsed from replies, one a row, with keeping as the default."""
    return ph.decisions(replies(spark, d), "user_id", "reply", "total")


@query(
    "WITH r AS (SELECT o_orderkey, 'Sure.' || E'\n```json\n' || '{\"status\": \"' || o_orderstatus || '\", \"items\": [{\"n\": ' || (o_orderkey % 7) || '}]}' || E'\n```' AS reply FROM orders)"
    " SELECT o_orderkey, json_extract_string(o, '$.status') AS status, json_extract_string(o, '$.items[0].n')::BIGINT AS n FROM (SELECT o_orderkey, regexp_extract(replace(reply, '```', ''), '(\\{.*\\})', 1, 's') AS o FROM r)"
)
def reply_json(spark, d):
    """Fields of the JSON object within a fenced reply."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    reply = F.concat(F.lit("Sure.\n```json\n"), F.lit('{"status": "'), "o_orderstatus", F.lit('", "items": [{"n": '), F.col("o_orderkey") % 7, F.lit("}]}\n```"))
    x = ph.reply_object(reply)
    return o.select("o_orderkey", F.get_json_object(x, "$.status").alias("status"), F.get_json_object(x, "$.items[0].n").cast("long").alias("n"))


@query(
    f"""WITH RECURSIVE {WORDS}, tok AS (SELECT clip, turn, list(struct_pack(t := {LETTERS}, m := regexp_extract(word, '[.?!]$')) ORDER BY idx) AS toks FROM words GROUP BY ALL),
w AS (SELECT clip, turn, idx, {LETTERS} AS t, row_number() OVER (PARTITION BY clip, turn ORDER BY idx) AS i FROM words WHERE (idx * 7 + turn) % 11 > 1),
r AS (SELECT clip, turn, 0::BIGINT AS i, 0::BIGINT AS s, NULL::BIGINT AS idx, NULL::VARCHAR AS mark FROM tok UNION ALL
SELECT clip, turn, i, s + coalesce(o, 0), idx, CASE WHEN o > 0 THEN toks[s + o].m END FROM (SELECT w.clip, w.turn, w.i, r.s, w.idx, tok.toks, list_position(list_transform(tok.toks[r.s + 1:r.s + 5], lambda x: x.t), w.t) AS o FROM r JOIN w ON w.clip = r.clip AND w.turn = r.turn AND w.i = r.i + 1 JOIN tok ON tok.clip = w.clip AND tok.turn = w.turn))
SELECT clip, turn, idx, mark FROM r WHERE mark <> ''"""
)
def copied_marks(spark, d):
    """Sentence marks copied from a punctuated text to a word list that lacks some of its words."""
    w = words(spark, d).select("clip", "turn", "idx", tx.letters("word").alias("token"), F.regexp_extract("word", "[.?!]$", 0).alias("mark"))
    return ph.followed(w.filter((F.col("idx") * 7 + F.col("turn")) % 11 > 1).drop("mark"), w, ["clip", "turn"]).filter("mark <> ''")


# fixed values: words that are written in capitals, names, months that are mostly other words, and what stands before a date
ACRONYMS = ["ai", "ml", "ceo", "cfo", "cto", "coo", "ev", "ip", "kpi", "mvp", "ui", "ux", "usa", "uk", "fbi", "cia", "nasa", "fda", "irs", "gdp", "b2b", "b2c", "saas", "cnn", "bbc", "dtc", "roi", "fyi", "tldr", "faq", "api", "sdk", "cli", "gpu", "cpu", "w-2", "w2", "fl", "ny", "la", "sf", "nyc", "tx", "ca", "hr", "pr", "crm"]
NAMES = ["christmas", "easter", "halloween", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "june", "july", "september", "october", "november", "december", "florida", "texas", "california", "america", "american", "europe"]
MONTHS = ["may", "march", "april", "august"]
DATE_WORDS = ["in", "on", "by", "from", "since", "until", "till", "through", "during", "of"]
#: Words of the test tables that stand in for months and names.
STAND_INS = {"erly": "May", "ntan": "march", "thin": "june", "of": "in", "an": "i'm", "tion": "CEO"}


def cased(word: str, before: str, after: str):
    """A word in its usual case, which for some months depends on its neighbours."""
    core, trail = F.regexp_extract(word, r"^([$]?[\w'\-]+)([.,!?]*)$", 1), F.regexp_extract(word, r"^([$]?[\w'\-]+)([.,!?]*)$", 2)
    low = F.lower(core)
    bare = lambda c: F.lower(F.regexp_extract(c, r"^[$]?([\w'\-]+)", 1))
    dated = F.coalesce(bare(before).isin(DATE_WORDS), F.lit(False)) | F.coalesce(bare(after).rlike(r"^(\d+(?:st|nd|rd|th)|\d{4})$"), F.lit(False))
    title = F.concat(F.upper(F.substring(core, 1, 1)), F.lower(F.substring(core, 2, 100)))
    own = F.when(low.isin("i", "i'm", "i'll", "i've", "i'd"), F.concat(F.lit("I"), F.substring(low, 2, 9))).when(low.isin(ACRONYMS), F.upper(core)).when(low.isin(MONTHS), F.when(dated, title).otherwise(low)).when(low.isin(NAMES), title).when(core.rlike(r"\d"), core).otherwise(low)
    return F.when(core == "", F.col(word)).otherwise(F.concat(own, trail))


_SQL_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(
    "WITH " + WORDS + ", s AS (SELECT clip, idx, CASE lower(word) WHEN 'erly' THEN 'May' WHEN 'ntan' THEN 'march' WHEN 'thin' THEN 'june' WHEN 'of' THEN 'in' WHEN 'an' THEN 'i''m' WHEN 'tion' THEN 'CEO' ELSE word END AS word FROM words), l AS (SELECT *, lag(word) OVER w AS b, lead(word) OVER w AS a FROM s WINDOW w AS (PARTITION BY clip ORDER BY idx)),"
    r" c AS (SELECT *, regexp_extract(word, '^([$]?[\w''\-]+)([.,!?]*)$', 1) AS core, regexp_extract(word, '^([$]?[\w''\-]+)([.,!?]*)$', 2) AS trail, coalesce(lower(regexp_extract(b, '^[$]?([\w''\-]+)', 1)) IN (" + _SQL_LIST(DATE_WORDS) + r"), false) OR coalesce(regexp_matches(lower(regexp_extract(a, '^[$]?([\w''\-]+)', 1)), '^(\d+(?:st|nd|rd|th)|\d{4})$'), false) AS dated FROM l)"
    " SELECT clip, idx, CASE WHEN core = '' THEN word ELSE (CASE WHEN lower(core) IN ('i', 'i''m', 'i''ll', 'i''ve', 'i''d') THEN 'I' || substr(lower(core), 2) WHEN lower(core) IN (" + _SQL_LIST(ACRONYMS) + ") THEN upper(core) WHEN lower(core) IN (" + _SQL_LIST(MONTHS) + ") THEN CASE WHEN dated THEN upper(core[1]) || lower(core[2:]) ELSE lower(core) END WHEN lower(core) IN (" + _SQL_LIST(NAMES) + r") THEN upper(core[1]) || lower(core[2:]) WHEN regexp_matches(core, '\d') THEN core ELSE lower(core) END) || trail END AS word FROM c"
)
def lookaround_case(spark, d):
    """Words in their usual case; months that are mostly other words only near a date."""
    swap = F.create_map(*[F.lit(x) for kv in STAND_INS.items() for x in kv])
    s = words(spark, d).select("clip", "idx", F.coalesce(F.try_element_at(swap, F.lower("word")), F.col("word")).alias("word"))
    w = Window.partitionBy("clip").orderBy("idx")
    return s.withColumns({"b": F.lag("word").over(w), "a": F.lead("word").over(w)}).select("clip", "idx", cased("word", "b", "a").alias("word"))
