"""Benchmark passages in documents: a positional inverted index, offset-adjusted lists of the rarest words, exact and near matches.

The index is a written table of postings (term, document, place), a row for every word of every document. A window is ``WINDOW``
consecutive words of an item. In each window the ``RAREST`` words with the fewest postings are picked; the postings of these
words alone are read, each moved back by the word's place in the item. Where all of a window's picks agree on one start the phrase
may stand there; then the words around each pick are compared with the document's, up to ``WINDOW - 1`` to either side, and a run
of at least a window is a match. Every occurrence of a window holds its own picks, so none is lost. Where as many picks of an item as a window
has lie within ``SLACK`` places of each other after moving, the item is near: reordered, cut or with words put in.

All steps are DataFrame functions. Items' picks and words are broadcast while there are at most ``BROADCAST_ROWS`` of them, as are the keys of
documents with candidates (their text is then read without a shuffle); beyond that Spark joins by shuffle, splitting skewed
terms. Lists are grouped by document and item, so a passage that many documents share is as many small groups.

Cases: null and empty texts have no words, no hits and the digest of ''; an item without words has no window, one of fewer than
``WINDOW`` words is one window; items that share an id are one item with the windows of all; an item without id counts for hits and near matches
but can't be named, so it is in neither n_items nor the digest nor n_near; each row of the documents gets its own result, whatever rows share
its id, null ids included; an empty table of either kind gives a row per document without hits; further columns never clash, as only
ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 10
RAREST = 3
SLACK = 5
BROADCAST_ROWS = 200_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words in order, A-Z in lower case and other letters as they are; null for null."""
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(small, GAP), "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, h (with doc, the key of rows that have the same result) and text."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: doc, h, n (words of the document), pos, term; a row with null pos and term for a document without words."""
    each = keyed(docs, id_col, text_col).select("doc", "h", words(F.col("text")).alias("w"))
    return written(each.select("doc", "h", F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.posexplode_outer("w").alias("pos", "term")), "decontam-postings")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def picks(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rarest words of each window: item (id and hash), m (words of the item), ipos, term, and up to WINDOW - 1 words before
    (nearest first) and after it. Windows with a word that no document has can't occur and have none."""
    each = items.select(F.col(id_col).cast("string").alias("id"), words(F.col(text_col).cast("string")).alias("w")).filter(F.size("w") > 0)
    each = each.select(F.struct("id", F.xxhash64("w").alias("h")).alias("item"), "w").distinct()
    places = written(each.select("item", F.size("w").alias("m"), "w", F.posexplode("w").alias("ipos", "term")), "decontam-items")
    vocabulary = places.select("term").distinct()
    counts = index.select("term").join(small(vocabulary, places.count()), "term").groupBy("term").agg(F.count("*").alias("df"))
    ranked = places.join(counts, "term", "left").groupBy("item", "m").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("df", F.lit(0)).alias("df")))).alias("at"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("m") - WINDOW))
    rare = ranked.select("item", "m", F.explode(F.transform(starts, lambda s: F.array_sort(F.transform(F.slice("at", s + 1, F.lit(WINDOW)), lambda x: F.struct(x["df"].alias("df"), x["ipos"].alias("ipos")))))).alias("window"))
    rare = rare.filter(F.col("window")[0]["df"] > 0).select("item", F.explode(F.slice("window", 1, RAREST)).alias("x")).select("item", F.col("x.ipos").alias("ipos")).distinct()
    back = F.least(F.col("ipos"), F.lit(WINDOW - 1))
    before = F.reverse(F.slice("w", F.col("ipos") - back + 1, back))
    return written(places.join(rare, ["item", "ipos"]).select("item", "m", "ipos", "term", before.alias("before"), F.slice("w", F.col("ipos") + 2, F.lit(WINDOW - 1)).alias("after")), "decontam-picks")


def candidates(index: DataFrame, picked: DataFrame) -> DataFrame:
    """For each document with a near item: near (ids) and maybe (array of item, pos, m, term, before, after), where a phrase may stand."""
    n = picked.count()
    moved = index.select("doc", "h", "pos", "term").join(small(picked.select("term", "item", "m", "ipos"), n), "term").withColumn("start", F.col("pos") - F.col("ipos"))
    by_item = Window.partitionBy("doc", "h", "item")
    need = F.least(F.lit(RAREST), F.col("m"))
    near = F.size(F.collect_set("ipos").over(by_item.orderBy("start").rangeBetween(-SLACK, 0))) >= need
    exact = F.size(F.collect_set("ipos").over(Window.partitionBy("doc", "h", "item", "start"))) >= need
    kept = moved.withColumn("near", near).withColumn("exact", exact).filter("near")
    around = small(picked.select("item", "ipos", "term", "before", "after"), n)
    kept = kept.drop("term").join(around, ["item", "ipos"])
    maybe = F.when(F.col("exact"), F.struct("item", "pos", "m", "term", "before", "after"))
    return written(kept.groupBy("doc", "h").agg(F.collect_set("item.id").alias("near"), F.collect_list(maybe).alias("maybe")), "decontam-candidates")


def agreeing(theirs: Column, ours) -> Column:
    """How many of the words agree one after the other; ours(i) is what stands against the i-th."""
    same = F.transform(theirs, lambda x, i: F.coalesce(ours(i) == x, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(theirs)).otherwise(first - 1).cast("int")


def confirmed(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, h, near and runs: the places (item, s, e) at which the words are an item's, a window or more."""
    texts = keyed(docs, id_col, text_col)
    keys = found.select(F.col("doc").alias("d"), F.col("h").alias("k"))
    n = found.count()
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))
    if n <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(keys), same, "left_semi")
    held = texts.join(found.withColumnsRenamed({"doc": "d", "h": "k"}), same).dropDuplicates(["doc", "h"]).select("doc", "h", words(F.col("text")).alias("w"), "near", "maybe")

    def run(c: Column) -> Column:
        left = agreeing(c["before"], lambda i: F.get("w", c["pos"] - 1 - i))
        right = agreeing(c["after"], lambda i: F.get("w", c["pos"] + 1 + i))
        return F.struct(c["item"]["id"].alias("id"), (c["pos"] - left).alias("s"), (c["pos"] + right).alias("e"), ((F.get("w", c["pos"]) == c["term"]) & (left + right + 1 >= F.least(F.lit(WINDOW), c["m"]))).alias("whole"))

    runs = F.filter(F.transform("maybe", run), lambda r: r["whole"])
    return held.select("doc", "h", "near", F.array_distinct(runs).alias("runs"))


def covered(runs: Column) -> Column:
    """How many places lie in any of the runs."""
    at = F.array_sort(F.array_distinct(F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("e"))
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"] - 1, acc["e"]))).alias("n"), F.greatest(acc["e"], r["e"]).alias("e"))
    return F.aggregate(at, none, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    index = postings(docs, id_col, text_col)
    found = candidates(index, picks(index, items, item_col, item_text))
    runs = confirmed(docs, found, id_col, text_col)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("runs", lambda r: r["id"]), lambda x: x.isNotNull())))
    hits = written(runs.select(F.col("doc").alias("d"), F.col("h").alias("k"), covered(F.col("runs")).alias("hit"), ids.alias("ids"), F.size("near").alias("near")), "decontam-hits")
    each = index.filter("pos is null or pos = 0").select("doc", "h", "n")
    out = each.join(hits, F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    digest = F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256)
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), long(F.size("ids")).alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"), long(F.col("near")).alias("n_near"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT DISTINCT item_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item AS (SELECT row_number() OVER () AS k, id, w, len(w) AS m, least(10, len(w)) AS z FROM items WHERE len(w) > 0),
win AS (SELECT k, id, m, z, s, array_to_string(w[s : s + z - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM item)),
sizes AS (SELECT DISTINCT z FROM win),
spot AS (SELECT d, z, i, array_to_string(w[i : i + z - 1], ' ') AS phrase FROM (SELECT d, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM docs, sizes)),
met AS (SELECT DISTINCT d, z, i, id FROM spot JOIN win USING (z, phrase)),
hit AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(i, i + z)) AS p FROM (SELECT DISTINCT d, z, i FROM met)) GROUP BY d),
named AS (SELECT d, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT d, id FROM met WHERE id IS NOT NULL) GROUP BY d),
post AS (SELECT d, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM docs),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
place AS (SELECT k, id, m, z, ipos, p.term, coalesce(df.n, 0) AS n FROM (SELECT *, unnest(range(1, m + 1)) AS ipos, unnest(w) AS term FROM item) p LEFT JOIN df USING (term)),
picked AS (
  SELECT DISTINCT k, id, m, ipos, term FROM (
    SELECT p.*, row_number() OVER (PARTITION BY win.k, win.s ORDER BY p.n, p.ipos) AS r, min(p.n) OVER (PARTITION BY win.k, win.s) AS least
    FROM win JOIN place p ON p.k = win.k AND p.ipos BETWEEN win.s AND win.s + win.z - 1) WHERE r <= 3 AND least > 0),
moved AS (SELECT d, k, id, m, ipos, pos - ipos AS start FROM post JOIN picked USING (term)),
near AS (
  SELECT d, count(DISTINCT id) AS n FROM (
    SELECT a.d, a.k, a.id, a.m, a.start FROM (SELECT DISTINCT d, k, id, m, start FROM moved) a JOIN moved b ON b.d = a.d AND b.k = a.k AND b.start BETWEEN a.start - 5 AND a.start
    GROUP BY ALL HAVING count(DISTINCT b.ipos) >= least(3, a.m)) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0)::BIGINT AS n_near
FROM docs LEFT JOIN hit USING (d) LEFT JOIN named USING (d) LEFT JOIN near USING (d)
"""
