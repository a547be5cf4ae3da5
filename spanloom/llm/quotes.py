"""Quotation linking: reply-ordered conversations without quotes, by DataFrame functions alone.

A line's quote level is the number of ``>`` marks it opens with. Consecutive lines of one level form a passage; a blank line ends it.
Passages, and their single lines for partial quotes, are normalised (lower case, runs of white space as one blank) and hashed.
Hashes of quoted text are joined with those of unquoted text: the original is the first message of the same conversation that
says it, if that is an earlier one, else the first message of any other conversation. A message replies to the original, in its
conversation, of its least quoted level, most characters, latest turn; without one, to the turn before. Replies are ordered by
their depth and turn, so every message follows the one it answers.

Originals are aggregated to two conversations a hash before any join across them, so a line that many messages share costs one row each; ordinals within a
conversation are counted in buckets of ``BUCKET`` turns, so no conversation has to fit one task; depths come from pointer jumping
over written tables, doubling the distance each time.

Cases: a null text counts as empty; rows repeated in all four columns are one message; messages of one conversation and turn share
parent, depth and position; rows without conversation or turn are neither linked nor ordered (null parent, depth and position);
texts may be of any length; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

BUCKET = 512
MARKS = r"^(?:[ \t]*>)+"


def parsed(rows: DataFrame) -> DataFrame:
    """rows (with text) and: text without quotes, passages array<struct<level, key, size>>, n_quotes, quote_level."""
    lines = rows.withColumn("lines", F.split("text", "\r\n|\r|\n"))

    def line(x: Column) -> Column:
        body = F.regexp_replace(x, MARKS, "")
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(F.lower(body), r"[\x09-\x0D\x20]+", " ")).alias("norm"))

    marked = lines.withColumn("k", F.transform("lines", line))

    def edge(step: int) -> Column:
        def at(i: Column) -> Column:
            own, other = F.get("k", i), F.get("k", i + step)
            return (own["norm"] != "") & (other.isNull() | (other["level"] != own["level"]) | (other["norm"] == ""))

        return F.filter(F.sequence(F.lit(0), F.size("k") - 1), at)

    cut = marked.withColumns({"first": edge(-1), "last": edge(1)})

    def entry(level: Column, text: Column) -> Column:
        return F.struct(level.alias("level"), F.md5(text.cast("binary")).alias("key"), F.length(text).alias("size"))

    runs = F.transform(F.arrays_zip("first", "last"), lambda x: entry(F.get("k", x["first"])["level"], F.array_join(F.transform(F.slice("k", x["first"] + 1, x["last"] - x["first"] + 1), lambda y: y["norm"]), " ")))
    single = F.transform(F.filter("k", lambda x: x["norm"] != ""), lambda x: entry(x["level"], x["norm"]))
    own = F.filter(F.transform("lines", lambda x, i: F.when(F.get("k", i)["level"] == 0, x)), lambda x: x.isNotNull())
    out = cut.withColumns({"runs": runs, "single": single, "own": own})
    return out.select(
        *[c for c in rows.columns if c != "text"],
        F.regexp_replace(F.array_join("own", "\n"), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "").alias("text"),
        F.array_distinct(F.concat("runs", "single")).alias("passages"),
        F.size(F.filter("runs", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("runs", lambda x: x["level"])), F.lit(0)).cast("long").alias("quote_level"),
    )


def ordinals(rows: DataFrame, group: list[str], by: str, name: str) -> DataFrame:
    """rows with the ordinal (from 0) of by, which is unique in each group; counted bucket by bucket."""
    cell = rows.withColumn("cell", F.floor(F.col(by) / BUCKET))
    counts = cell.groupBy(*group, "cell").agg(F.count("*").alias("in_cell"))
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy(*group, "cell").orderBy(by))
    return cell.withColumn(name, within).join(counts, [*group, "cell"]).withColumn(name, (F.col(name) - 1 + F.col("earlier")).cast("long")).drop("cell", "earlier")


def depths(tree: DataFrame) -> DataFrame:
    """conv, n, depth of the nodes (conv, n, parent); parent -1 marks a root."""
    at = written(tree.select("conv", "n", F.col("parent").alias("up"), F.when(F.col("parent") >= 0, 1).otherwise(0).cast("long").alias("depth")), "quote-depths")
    while not at.filter("up >= 0").isEmpty():
        far = at.select("conv", F.col("n").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        at = written(at.join(far, ["conv", "up"], "left").select("conv", "n", F.coalesce("next", F.lit(-1)).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quote-depths")
    return at.select("conv", "n", "depth")


def reply_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text (without quotes), n_quotes, quote_level, n_linked, quoted_conv, quoted_turn, parent_turn, by_quote, depth, position."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text_or_empty(text_col).alias("text")).distinct()
    messages = written(parsed(rows), "quote-messages")
    placed = messages.filter("conv is not null and turn is not null")
    said = placed.select("conv", "turn", F.explode("passages").alias("p")).filter("p.level = 0").select("conv", F.col("p.key").alias("key"), "turn")
    asked = placed.filter("quote_level > 0").select("conv", "turn", F.explode("passages").alias("p")).filter("p.level > 0").select("conv", "turn", "p.level", "p.key", "p.size").distinct()
    # only what somebody quotes needs an original
    wanted = asked.select("key").distinct()
    first = written(said.join(wanted, "key", "left_semi").groupBy("conv", "key").agg(F.min("turn").alias("there")), "quote-originals")
    # of each, the two least conversations: where the quoting one is the first, the second is the first other one
    least = first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("conv"))).filter("rank <= 2")
    anywhere = least.groupBy("key").agg(F.min(F.struct("conv", "there")).alias("any"), F.max(F.when(F.col("rank") == 2, F.struct("conv", "there"))).alias("other"))
    near = asked.join(first, ["conv", "key"], "left")
    both = near.join(anywhere, "key", "left").select("conv", "turn", "level", "size", F.when(F.col("there") < F.col("turn"), F.struct(F.col("conv"), F.col("there"))).otherwise(F.when(F.col("any.conv") != F.col("conv"), F.col("any")).otherwise(F.col("other"))).alias("to"))
    hits = both.filter("to is not null").groupBy("conv", "turn", "to").agg(F.min("level").alias("level"), F.sum("size").alias("size"), F.count("*").alias("hits"))
    rank = F.struct(-F.col("level"), F.col("size"), F.col("to.there"), -F.col("to.conv"))
    linked = hits.groupBy("conv", "turn").agg(F.sum("hits").alias("n_linked"), F.max_by("to", rank).alias("source"), F.max_by("to.there", F.when(F.col("to.conv") == F.col("conv"), rank)).alias("answers"), F.max(F.col("to.conv") == F.col("conv")).alias("inside"))
    linked = written(linked.select("conv", "turn", "n_linked", F.col("source.conv").alias("quoted_conv"), F.col("source.there").alias("quoted_turn"), F.when(F.col("inside"), F.col("answers")).alias("answers")), "quote-links")

    nodes = written(ordinals(placed.select("conv", "turn").distinct(), ["conv"], "turn", "n"), "quote-nodes")
    number = nodes.toDF("conv", "answers", "by")
    tree = nodes.join(linked, ["conv", "turn"], "left").join(number, ["conv", "answers"], "left").withColumn("parent", F.coalesce("by", F.col("n") - 1))
    tree = written(tree, "quote-tree")
    deep = tree.join(depths(tree), ["conv", "n"])
    spread = ordinals(deep.select("conv", "depth", "n"), ["conv", "depth"], "n", "in_depth")
    level = ordinals_of_levels(spread)
    parents = nodes.toDF("conv", "parent_turn", "parent")
    place = spread.join(level, ["conv", "depth"]).select("conv", "n", "depth", (F.col("earlier") + F.col("in_depth")).alias("position"))
    full = tree.join(place, ["conv", "n"]).join(parents, ["conv", "parent"], "left")
    full = full.select("conv", "turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "quoted_conv", "quoted_turn", "parent_turn", F.col("by").isNotNull().alias("by_quote"), "depth", "position")
    out = messages.drop("passages").join(full, ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "n_quotes", "quote_level", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "quoted_conv", "quoted_turn", "parent_turn", F.coalesce("by_quote", F.lit(False)).alias("by_quote"), "depth", "position")


def ordinals_of_levels(spread: DataFrame) -> DataFrame:
    """conv, depth, earlier: the messages of a conversation above each depth; summed in buckets of depths."""
    level = spread.groupBy("conv", "depth").agg(F.count("*").alias("wide")).withColumn("cell", F.floor(F.col("depth") / BUCKET))
    cells = level.groupBy("conv", "cell").agg(F.sum("wide").alias("wide"))
    before = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv", "cell", F.coalesce(F.sum("wide").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("own", F.coalesce(F.sum("wide").over(within), F.lit(0)))
    return level.join(cells, ["conv", "cell"]).select("conv", "depth", (F.col("base") + F.col("own")).alias("earlier"))


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS mid, * FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
raw AS (SELECT mid, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, unnest(range(len(string_split_regex(text, '\r\n|\r|\n')))) AS i FROM m),
ln AS MATERIALIZED (
  SELECT mid, i, line, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[\x09-\x0D\x20]+', ' ', 'g')) AS norm FROM raw),
isl AS (
  SELECT *, sum(new) OVER (PARTITION BY mid ORDER BY i) AS g FROM (
    SELECT *, CASE WHEN lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR lag(norm) OVER w = '' THEN 1 ELSE 0 END AS new FROM ln WINDOW w AS (PARTITION BY mid ORDER BY i))
  WHERE norm <> ''),
runs AS (SELECT mid, g, min(level) AS level, string_agg(norm, ' ' ORDER BY i) AS key FROM isl GROUP BY mid, g),
pas AS MATERIALIZED (SELECT mid, level, key FROM runs UNION SELECT mid, level, norm FROM ln WHERE norm <> ''),
per AS (
  SELECT m.mid, coalesce((SELECT count(*) FROM runs r WHERE r.mid = m.mid AND r.level > 0), 0) AS n_quotes, coalesce((SELECT max(level) FROM runs r WHERE r.mid = m.mid), 0) AS quote_level,
    regexp_replace(coalesce((SELECT string_agg(line, chr(10) ORDER BY i) FROM ln WHERE ln.mid = m.mid AND level = 0), ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS own FROM m),
placed AS (SELECT mid, conv_id AS conv, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
first AS (SELECT conv, key, min(turn) AS there FROM placed JOIN pas USING (mid) WHERE level = 0 GROUP BY ALL),
anyw AS (SELECT key, min((conv, there)) FILTER (r = 1) AS a, min((conv, there)) FILTER (r = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv) AS r FROM first) GROUP BY key),
asked AS (SELECT DISTINCT conv, turn, level, key FROM placed JOIN pas USING (mid) WHERE level > 0),
tos AS (
  SELECT q.conv, q.turn, q.level, length(q.key) AS size, CASE WHEN f.there < q.turn THEN q.conv WHEN a[1] <> q.conv THEN a[1] ELSE b[1] END AS tc, CASE WHEN f.there < q.turn THEN f.there WHEN a[1] <> q.conv THEN a[2] ELSE b[2] END AS tt
  FROM asked q LEFT JOIN first f ON f.conv = q.conv AND f.key = q.key LEFT JOIN anyw ON anyw.key = q.key),
hits AS (SELECT conv, turn, tc, tt, min(level) AS level, sum(size) AS size, count(*) AS hits FROM tos WHERE tc IS NOT NULL GROUP BY ALL),
best AS (SELECT *, sum(hits) OVER (PARTITION BY conv, turn) AS n_linked, row_number() OVER (PARTITION BY conv, turn ORDER BY level, size DESC, tt DESC, tc) AS r, row_number() OVER (PARTITION BY conv, turn, tc = conv ORDER BY level, size DESC, tt DESC, tc) AS ri FROM hits),
nodes AS MATERIALIZED (SELECT conv, turn, row_number() OVER (PARTITION BY conv ORDER BY turn) - 1 AS n FROM (SELECT DISTINCT conv, turn FROM placed)),
tree AS MATERIALIZED (
  SELECT o.conv, o.turn, o.n, b.n_linked, b.tc, b.tt, p.n AS byq, coalesce(p.n, o.n - 1) AS parent
  FROM nodes o LEFT JOIN best b ON b.conv = o.conv AND b.turn = o.turn AND b.r = 1
  LEFT JOIN best i ON i.conv = o.conv AND i.turn = o.turn AND i.tc = i.conv AND i.ri = 1
  LEFT JOIN nodes p ON p.conv = o.conv AND p.turn = i.tt),
deep(conv, n, depth) AS (SELECT conv, n, 0 FROM tree WHERE parent < 0 UNION ALL SELECT t.conv, t.n, d.depth + 1 FROM deep d JOIN tree t ON t.conv = d.conv AND t.parent = d.n),
pos AS (SELECT conv, n, depth, row_number() OVER (PARTITION BY conv ORDER BY depth, n) - 1 AS position FROM deep)
SELECT m.conv_id, m.turn, m.role, per.own AS text, per.n_quotes::BIGINT AS n_quotes, per.quote_level::BIGINT AS quote_level, coalesce(t.n_linked, 0)::BIGINT AS n_linked, t.tc AS quoted_conv, t.tt AS quoted_turn,
  pt.turn AS parent_turn, coalesce(t.byq IS NOT NULL, false) AS by_quote, pos.depth::BIGINT AS depth, pos.position::BIGINT AS position
FROM m JOIN per USING (mid) LEFT JOIN tree t ON t.conv = m.conv_id AND t.turn = m.turn LEFT JOIN pos ON pos.conv = t.conv AND pos.n = t.n LEFT JOIN nodes pt ON pt.conv = t.conv AND pt.n = t.parent
"""
