"""How the sources of each language differ: pairwise divergence of their term shares, and the terms that mark each source.

A language keeps the terms that at least ``LEAST_DOCS`` of its documents have. Kept terms are dealt by hash into blocks of about ``TERMS``
and sources into blocks of about ``SOURCES``; each tile is a dense int64 matrix, sources by terms, zeros included. In a tile the
shares of all pairs of sources are broadcast against each other (``CELLS`` cells at a time) and their divergences summed over the
tile's terms; Spark sums these partial pair matrices. A tile also gives each source's ``TOP`` best terms against the whole
language, and these lists are merged in two steps. So memory is bounded by the size of a tile, not by the vocabulary, the number of
sources or a source's share of the rows. Output has a row for each ordered pair of sources of a language, as it must.

Arithmetic is exact: shares p = 1 + floor(10^9 * (count + 1) / (N + V)) come from a long division in base 1000 (right up to
9 * 10^15 words a language), a divergence floor((p - q)^2 / q) is below 10^18, and a sum over terms below 10^9 * (10^9 + V).

Terms are counted in Python over UTF-8 bytes (``bytes.translate`` lower-cases A-Z and no other letter), with a map-side sum
that is handed on at ``HELD`` entries. Texts are read ``SLICE`` bytes at a time; a text's own distinct terms are held together.

Cases: null text, language and source count as ''; a text without terms still makes its (language, source) occur; a language
without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs; repeated rows are documents of
their own, whatever their id; ties go by the item's UTF-8 bytes; an empty table gives an empty result; only the three columns are read,
so further columns never clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

LEAST_DOCS = 3
TOP = 200
TERMS = 1024  # kept terms of a tile
SOURCES = 128  # sources of a tile's side
CELLS = 1 << 22  # cells broadcast at a time
HELD = 300_000  # counts that a task holds before it hands them on
SLICE = 1 << 20  # bytes of a text handled at a time, up to the next byte that is no part of a term
PARTS = 16  # parts of a source's best terms that are merged first

LETTER = [65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)]
FOLD = bytes(32 if not LETTER[b] else b + 32 if b < 91 else b for b in range(256))
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time."""
    at = 0
    while at < len(raw):
        cut = GAP.search(raw, at + SLICE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].translate(FOLD).split()
        at = end


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents), summed over what the task has read since it last handed on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        for lang, source, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for some in terms(raw):
                n.update(some)
                own.update(some)
            docs.update(own)
            size += len(n) - before
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def shares(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + kept)), digit by digit in base 1000."""
    whole, rest, out = total + kept, count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), elementwise."""
    return (p - q) ** 2 // q


def pair_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergences of each row of p from each row of q, summed over terms; all pairs broadcast, some rows of p at a time."""
    step = max(1, CELLS // max(1, q.size))
    return np.concatenate([divergence(p[i : i + step, None, :], q[None, :, :]).sum(axis=2) for i in range(0, len(p), step)])


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums for pairs of a tile's sources, and the best terms of each source of a diagonal tile.

    rows: kind 0, a source with its block, words and the language's kept terms; 1, a term with its count in the language and the
    language's words; 2, a term's count in a source."""
    lang, a, b = rows["lang"].iat[0], rows["a"].iat[0], rows["b"].iat[0]
    src, voc, cnt = (rows[rows["kind"] == k] for k in (0, 1, 2))
    if src.empty:  # no source was dealt to either side
        return pd.DataFrame(columns=["lang", "part", "source", "item", "value"])
    voc = voc.iloc[np.argsort(voc["term"].str.encode("utf-8").to_numpy(dtype=object), kind="stable")] if len(voc) else voc
    names, words = src["source"].to_numpy(dtype=object), voc["term"].to_numpy(dtype=object)
    count = np.zeros((len(names), len(words)), np.int64)
    count[pd.Index(names).get_indexer(cnt["source"]), pd.Index(words).get_indexer(cnt["term"])] = cnt["n"].to_numpy(np.int64)
    kept = int(src["whole"].iat[0])
    # a language without kept terms has no column here, so no share is taken
    p = shares(count, src["n"].to_numpy(np.int64)[:, None], kept) if len(words) else count
    left, right = np.flatnonzero(src["own"].to_numpy() == a), np.flatnonzero(src["own"].to_numpy() == b)
    found = []
    for x, y in [(left, right)] if a == b else [(left, right), (right, left)]:
        if len(x) and len(y):
            i, j = np.nonzero(x[:, None] != y[None, :])
            found.append(pd.DataFrame({"part": "pair", "source": names[x[i]], "item": names[y[j]], "value": pair_matrix(p[x], p[y])[i, j]}))
    if a == b and len(words):
        q = shares(voc["n"].to_numpy(np.int64), int(voc["whole"].iat[0]), kept)
        for g in left:
            marks = np.flatnonzero((count[g] > 0) & (p[g] > q))
            value = divergence(p[g, marks], q[marks])
            best = np.argsort(-value, kind="stable")[:TOP]
            found.append(pd.DataFrame({"part": "term", "source": names[g], "item": words[marks[best]], "value": value[best]}))
    out = pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["part", "source", "item", "value"])
    return out.assign(lang=lang)[["lang", "part", "source", "item", "value"]]


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank, as the module says."""
    docs = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).cast("binary").alias("text"))
    counted = docs.mapInArrow(tally, "lang string, source string, term binary, n long, docs long")
    counts = written(counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).drop("docs"), "divergence-terms")
    held = written(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "divergence-held")

    sources = docs.select("lang", "source").distinct().join(held.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, "n")
    sources = written(sources, "divergence-sources")
    ceiling = lambda n, per: F.greatest(F.lit(1), F.ceil(n / per)).cast("int")
    size = sources.groupBy("lang").agg(F.count("*").alias("g")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole")), "lang", "left").fillna(0)
    size = written(size.select("lang", "v", "whole", ceiling(F.col("v"), TERMS).alias("blocks"), ceiling(F.col("g"), SOURCES).alias("sides")), "divergence-sizes")

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("t")
    own = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("own")
    others = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    sides = [F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")]
    none = F.lit(None).cast("string")
    as_source = sources.join(size, "lang").select("lang", "source", "n", F.col("v").alias("whole"), "blocks", own, others).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"))
    as_source = as_source.select("lang", *sides, "t", F.lit(0).alias("kind"), "own", "source", none.alias("term"), "n", "whole")
    as_term = kept.join(size, "lang").select("lang", "term", "n", "whole", block, "sides", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("a"))
    as_term = as_term.select("lang", "a", F.explode(F.sequence("a", F.col("sides") - 1)).alias("b"), "t", F.lit(1).alias("kind"), F.lit(-1).alias("own"), none.alias("source"), "term", "n", "whole")
    as_count = held.join(size, "lang").select("lang", "source", "term", "n", block, own, others)
    as_count = as_count.select("lang", *sides, "t", F.lit(2).alias("kind"), "own", "source", "term", "n", F.lit(0).cast("long").alias("whole"))
    tiles = as_source.unionByName(as_term).unionByName(as_count).groupBy("lang", "a", "b", "t")
    found = written(tiles.applyInPandas(tile, "lang string, part string, source string, item string, value long"), "divergence-found")

    order = [F.desc("value"), F.col("item")]
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    some = found.filter("part = 'term'").withColumn("some", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "some").orderBy(*order))).filter(F.col("rank") <= TOP)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= TOP)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(best.select(columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT lang, source, term, d, count(*) AS n FROM (SELECT lang, source, d, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM each GROUP BY ALL HAVING count(*) >= 3),
held AS (SELECT lang, source, term, sum(each.n)::HUGEINT AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
lang_size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
group_size AS (SELECT lang, source, sum(n)::HUGEINT AS whole FROM held GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (coalesce(s.whole, 0) + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.whole + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN lang_size l USING (lang)
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term LEFT JOIN group_size s ON s.lang = g.lang AND s.source = g.source),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= 200
"""
