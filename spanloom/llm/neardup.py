"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct shingles of ``WORDS`` words. Instead of one band of hashes for each table, ``COLLECTIONS`` small
collections of ``HASHES`` minhashes are computed; a table's key combines a pair of them, so 28 collections serve 378 tables with
112 minhashes instead of 3,024. A pair of documents of similarity 0.75 shares a collection with probability 0.75 ** 4 = 0.32 and
misses all tables with probability 3.4e-4 (at 0.8: 7e-6).

Documents with the same set are one class, told by a 64-bit hash of the set, before anything else; further steps see classes.
Collection values that only one class has are dropped by an aggregation, so only classes with near copies form table keys. In each
bucket, members are first held against the class that most others share collections with, usually the text that the copies were
made from (no pairs within a bucket are formed); links are confirmed on the full sets, each class's most promising one first.
Connected components of confirmed links then show which heads still have members of several components; pairs across components are
found there by how sets differ from the head: two linked sets have much of that in common, unless both are linked with the
head (``deltas``), so a join on its first shingles, with a bound on the rest, meets every pair that can be linked and few others.
Beforehand, classes are left out whose shingles that any other class has are too small a part of the set for a link, and
members of a head without another one that sizes and common shingles let them be linked with. These bounds are exact, so no link between different
texts that share a table is lost, while a large group of near copies costs about one check a member.

All joins on hot keys have one row a key on one side, so Spark can split the other side; links, labels and sets never reach the
driver. Intermediate tables go to the shared folder.

Cases: null and empty texts, and texts of white space, have an empty set, are linked with nothing and kept; fewer than WORDS words
are one shingle; texts may be of any length; rows that repeat an id share that id's component; an empty table gives an empty
result; only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .lm import END, mixed, tokens

WORDS = 5
COLLECTIONS = 28
HASHES = 4
SIMILAR = 75  # per cent
BLOCK = 1 << 20  # characters of a batch handled at a time
SMALL = 2_000_000  # ids up to which a list of them may be broadcast; beyond, a shuffled join
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 31, COLLECTIONS * HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COLLECTIONS * HASHES, dtype=np.uint32)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every distinct shingle, ordered by both."""
    owners, words = [], []
    for own, tok, _ in tokens(texts):
        inside = tok != END
        owners.append(own[inside])
        words.append(tok[inside])
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    tok = np.concatenate(words) if words else np.zeros(0, np.uint64)
    n = np.bincount(own, minlength=len(texts))
    h = tok.copy()
    for k in range(1, WORDS):
        h[: len(h) - k] = h[: len(h) - k] * _M + tok[k:]
    full = np.zeros(len(tok), bool)
    if len(tok) >= WORDS:
        full[: len(tok) - WORDS + 1] = own[: len(tok) - WORDS + 1] == own[WORDS - 1 :]
    first = np.cumsum(n) - n
    few = np.flatnonzero((n > 0) & (n < WORDS))
    for i in few:  # the whole sequence as one
        x = np.uint64(n[i])
        for t in tok[first[i] : first[i] + n[i]]:
            x = np.uint64((int(x) * int(_M) + int(t)) & 0xFFFFFFFFFFFFFFFF)
        h[first[i]] = x
    full[first[few]] = True
    own, h = own[full], mixed(h[full])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > BLOCK:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def collections(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The collections' hashes of each set; sets are the runs of h that begin at first."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first), COLLECTIONS), np.uint64)
    for c in range(COLLECTIONS):
        for k in range(c * HASHES, (c + 1) * HASHES):
            out[:, c] = mixed(out[:, c] * _M + np.minimum.reduceat(x * _A[k] + _B[k], first).astype(np.uint64) + np.uint64(1))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, cls (hash of the set; null if empty), bands; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for s, e in blocks(texts):
                own, h = shingle_sets(texts[s:e])
                n = np.bincount(own, minlength=e - s)
                have = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[have]
                cls, bands = np.full(e - s, None, object), np.full(e - s, None, object)
                if len(have):
                    cls[have] = mixed(np.add.reduceat(mixed(h), first) + n[have].astype(np.uint64)).view(np.int64)
                    got = collections(h, first).view(np.int64)
                    for i, row in zip(have, got):
                        bands[i] = row
                yield pd.DataFrame({"id": b["id"].iloc[s:e].to_numpy(), "n": n, "cls": pd.array(cls, dtype="Int64"), "bands": bands})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInPandas(run, f"id {kind}, n long, cls long, bands array<long>"), "dup-rows")


def table_keys(shared: DataFrame) -> DataFrame:
    """A row (t, cls) for each table: a key for each pair of the collections that a class shares with another class."""
    x = F.col("bands")
    pairs = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.lit(COLLECTIONS)), lambda b: F.xxhash64(a["c"], a["h"], b["c"], b["h"]))))
    return shared.select("cls", "n", "known", "common", F.explode(pairs).alias("t"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node it is connected with."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        labels = written(hop.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"), (F.least("new", F.coalesce("up", "new")) < F.col("label")).alias("moved")), "cc-labels")
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def rows_of(docs: DataFrame, ids: DataFrame, how: str, on: str = "id") -> DataFrame:
    """docs semi- or anti-joined with a list of ids: broadcast where the list is counted to be small, shuffled beyond."""
    ids = ids.select(on).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL else ids, on, how)


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, set of the classes whose first document's id is in wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for s, e in blocks(texts):
                own, h = shingle_sets(texts[s:e])
                n = np.bincount(own, minlength=e - s)
                have = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[have]
                if len(have):
                    cls = mixed(np.add.reduceat(mixed(h), first) + n[have].astype(np.uint64)).view(np.int64)
                    yield pd.DataFrame({"cls": cls, "set": np.split(h.view(np.int64), first[1:])})

    rows = rows_of(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), wanted, "left_semi")
    return rows.mapInPandas(run, "cls long, set array<long>")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """cls, common, core: the shingles of a class that another class of sets has too, and their number. A pair's intersection can't
    be larger than either's common, so classes with too few can't be linked at all and are left out."""
    each = sets.select("cls", F.size("set").alias("m"), F.explode("set").alias("h"))
    several = each.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    own = each.join(several, "h").groupBy("cls").agg(F.collect_list("h").alias("core"), F.first("m").alias("m"))
    return own.select("cls", F.size("core").alias("common"), "core", "m").filter(f"100 * common >= {SIMILAR} * m").drop("m")


def facing(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows with far and small: the largest reach and the least need of those others of the same head whose label is not the row's own;
    rows without any are left out."""
    per = others.groupBy("head", "label").agg(F.max("reach").alias("far"), F.min("need").alias("small"))
    one = per.groupBy("head").agg(F.max(F.struct("far", "label")).alias("f"), F.min(F.struct("small", "label")).alias("s"))
    two = per.join(one, "head").groupBy("head").agg(F.first("f").alias("f"), F.first("s").alias("s"), F.max(F.expr("if(label <> f.label, far, null)")).alias("far2"), F.min(F.expr("if(label <> s.label, small, null)")).alias("small2"))
    far = F.when(F.col("label") == F.col("f.label"), F.col("far2")).otherwise(F.col("f.far"))
    small = F.when(F.col("label") == F.col("s.label"), F.col("small2")).otherwise(F.col("s.small"))
    return rows.join(two, "head").select(*[rows[c] for c in rows.columns], far.alias("far"), small.alias("small")).filter("far is not null")


def promising(member: DataFrame) -> DataFrame:
    """The rows (head, cls, n, common, label) whose head also has a class of another label that sizes and common shingles let them
    be linked with: a link needs reach = common * (100 + SIMILAR) - n * SIMILAR, of either, to be SIMILAR times the other's n."""
    m = member.withColumns({"reach": (100 + SIMILAR) * F.col("common") - SIMILAR * F.col("n"), "need": SIMILAR * F.col("n")})
    return facing(m, m).filter("far >= need and reach >= small").select("head", "cls", "n", "label")


def deltas(open_: DataFrame, core: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (head, cls, n, label): d, the number of shingles that only one of the two sets has; whether both are linked; and
    those of the d that may be common with a third class (``parts``), after ``alone`` others, in one order for each head: what the
    head lacks by hash, then what the class lacks by hash.

    100 * both >= 75 * union is 7 * d <= n + nh, so d decides links with the head. Let D be these shingles of a class; the classes a and
    b differ by the symmetric difference of their D, so a link needs 14 * |D(a) & D(b)| >= 7 * (d(a) + d(b)) - (n(a) + n(b)).
    As 7 * d > n + nh without a link, and d >= |n - nh|, the right side is positive unless both are linked with the head."""
    one = open_.join(core, "cls").join(sets.select(F.col("cls").alias("head"), F.col("set").alias("hs"), F.size("set").alias("nh")), "head")
    one = one.withColumns({"more": F.array_except("core", "hs"), "less": F.array_except("hs", "core")})
    # a class's core holds all that it shares with the head, so n - |core & hs| is what the head lacks
    one = one.withColumn("d", F.col("n") + F.col("nh") - 2 * (F.size("core") - F.size("more")))
    parts = F.concat(F.sort_array("more"), F.sort_array("less"))
    return one.select("head", "cls", "n", "nh", "label", "d", F.expr("7 * d <= n + nh").alias("linked"), (F.col("d") - F.size("more") - F.size("less")).alias("alone"), parts.alias("parts"))


def hopeful(delta: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of delta that their d and what is left of it let be linked with one of others, of the same head and another label.

    With need = 7 * d - n, a link of a and b needs 14 * |D(a) & D(b)| >= need(a) + need(b). What they have in common is among the parts of
    both, so reach = 14 * |parts| - need, of either, must come to the other's need."""
    return facing(delta, others).filter("far >= need and reach >= small")


def prefix(delta: DataFrame) -> DataFrame:
    """The shingles of each D up to the last at which the least overlap with one of those it may be linked with can begin, with their places."""
    room = F.greatest(F.lit(0), F.col("d") - F.expr("ceil((need + small) / 14d)") + 1 - F.col("alone")).cast("int")
    return delta.withColumn("e", F.slice("parts", F.lit(1), room)).select("head", "cls", "n", "label", "d", "alone", F.posexplode("e").alias("i", "e")).withColumn("after", F.expr("d - alone - i - 1")).drop("alone", "i")


def across(delta: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different labels that a link's overlap allows, of classes not both linked with the head: a join on the
    first shingles of D, rarest kinds first, with the bound on what may follow. Classes that nothing under their head can be linked with are left out
    before; large groups of copies of one head share few of these, and no pair that can be linked is left out."""
    need = F.expr("7 * d - n")
    delta = delta.filter("cls <> head").withColumns({"need": need, "reach": 14 * F.size("parts") - need})
    free, tied = delta.filter("not linked"), delta.filter("linked")
    side = lambda x, k: x.select("head", "e", F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("label").alias(f"l{k}"), F.col("d").alias(f"d{k}"), F.col("after").alias(f"r{k}"))
    bound = f"la <> lb and 14 * (1 + least(ra, rb)) >= 7 * (da + db) - (na + nb) and 100 * least(na, nb) >= {SIMILAR} * greatest(na, nb)"

    def met(x: DataFrame, y: DataFrame, extra: str) -> DataFrame:
        x, y = side(x, "a").alias("x"), side(y, "b").alias("y")
        return x.join(y, F.expr(f"x.head = y.head and x.e = y.e and {bound}{extra}")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    short = prefix(hopeful(free, free))
    with_free = met(short, short, " and a > b")
    with_tied = met(prefix(hopeful(free, tied)), prefix(hopeful(tied, free)), "")
    return with_free.unionByName(with_tied).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return two.filter(100 * both >= SIMILAR * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable over links), kept (id = component_id)."""
    rows = signatures(docs, id_col, text_col)
    classes = written(rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "dup-classes")

    # collection values that several classes have, gathered by class
    band = classes.select("cls", F.posexplode("bands").alias("c", "h"))
    several = band.groupBy("c", "h").agg(F.count("*").alias("m")).filter("m > 1")
    shared = band.join(several, ["c", "h"]).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("bands"), F.sum("m").alias("known")).filter(F.size("bands") > 1)
    shared = written(shared.join(classes.select("cls", "n", "first"), "cls"), "dup-shared")
    sets = written(sets_of(docs, shared.select(F.col("first").alias("id")), id_col, text_col).dropDuplicates(["cls"]), "dup-sets")
    shared = written(shared.join(shared_shingles(sets), "cls"), "dup-hopeful")

    # each bucket's members against the one that most others share collections with: the text that copies were made from
    keys = table_keys(shared)
    heads = keys.groupBy("t").agg(F.max(F.struct("known", "cls", "n")).alias("head"), F.count("*").alias("m")).filter("m > 1").select("t", F.col("head.cls").alias("head"), F.col("head.n").alias("nh"))
    stars = written(keys.join(heads, "t").groupBy("head", "cls").agg(F.first("n").alias("n"), F.first("nh").alias("nh"), F.first("common").alias("common"), F.count("*").alias("tables")), "dup-stars")
    alike = stars.filter(f"cls <> head and 100 * least(n, nh) >= {SIMILAR} * greatest(n, nh)")
    best = written(alike.groupBy(F.col("cls").alias("a")).agg(F.max_by("head", F.struct("tables", "head")).alias("b")), "dup-best")

    links = written(confirmed(best, sets), "dup-links")
    labels = components(links)

    # what is left: pairs across components among the classes of a head that still has several
    label = F.coalesce("label", "cls").alias("label")
    left = promising(stars.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("head", "cls", "n", "common", label))
    delta = written(deltas(left, shared.select("cls", "core"), sets), "dup-deltas")
    with_head = delta.filter("linked and cls <> head").select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b"))
    more = written(confirmed(across(delta), sets).unionByName(with_head), "dup-more")
    if not more.isEmpty():
        up = labels.select(F.col("node"), "label")
        lifted = more.join(up.toDF("a", "la"), "a", "left").join(up.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        top = components(lifted.filter("a <> b")).toDF("label", "top")
        own = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = own.unionByName(top.select(F.col("label").alias("node"), F.col("top").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))

    named = classes.select("cls", "first").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", label)
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    named = written(named.join(least, "label").select("cls", "component"), "dup-components")
    out = rows.select("id", "n", "cls").join(named, "cls", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""
