"""Hard negatives: per anchor a full sort of all scores, a binary search for each positive's upper limit, the next entries of other labels.

Components become integers (floor(256 * x)), so scores are exact integer inner products. Rows are dealt into blocks of about ``ROWS``;
anchors travel to every block and stream past its rows ``ANCHORS`` at a time, so no row is copied and no task holds more than a
block, whatever the table. In a block the scores of some anchors are one matrix, whose rows are sorted by score, ties by id
(rows lie in the order of their ids, so a stable sort does it). A first pass takes each anchor's best rows of its own label, which are
merged over blocks into its positives; a second sorts the scores again, looks up each positive's upper limit among the rows of other labels by binary search, reads
the next ones that are above the lower limit, and merges these. What a block gives for an anchor or a positive is as many rows as
the result may have, which loses nothing. Work is anchors times rows, as a full sort per anchor must be.

Cases: rows without id or label, with a null vector or a null or non-finite component take no part; of rows that share an id, the
one with the smallest label, then vector, counts; vectors of different lengths have no score and aren't held against each other (two empty ones
score 0); fewer positives or negatives than asked for give as many rows as there are, none give none; a positive of score below 0 has no
negatives, as its limits cross, and one of score 0 takes those of score 0; integers beyond a long are cut to a long's range, and
scores beyond it wrap like a long's sum; an empty table gives an empty result; only the three columns are read, so further columns
never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # a negative's score in hundredths of the positive's
SCALE = 256
ROWS = 4096  # rows of a block
ANCHORS = 64  # anchors held against a block at a time


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the batch's vectors: the length, the rows that have it, and their vectors as a matrix."""
    at = batch.schema.get_field_index("v")
    lists = batch.column(at)
    flat, first = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    size = np.diff(first)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[first[rows][:, None] + np.arange(dim)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: in floating point where every partial sum is exact there, else in longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53 and min(a.min(), b.min()) > -(2**53):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def ordered(score: np.ndarray) -> np.ndarray:
    """Places of a row's scores, highest first, ties by place."""
    return np.argsort(~score, axis=-1, kind="stable")  # ~x is -1 - x, which no long overflows


class Block:
    """Rows of one block and one length, in the order of their ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def best_own(self, anchors: list[dict], vectors: np.ndarray) -> Iterator[tuple]:
        """(anchor, id, score) of the first rows of the anchor's label."""
        score = products(vectors, self.vectors)
        for a, s, order in zip(anchors, score, ordered(score)):
            own = order[(self.labels[order] == a["label"]) & (self.ids[order] != a["id"])][:POSITIVES]
            for i in own:
                yield a["id"], int(self.ids[i]), int(s[i])

    def below(self, anchors: list[dict], vectors: np.ndarray) -> Iterator[tuple]:
        """(anchor, positive, positive's score, id, score) of the first rows of other labels between each positive's limits."""
        score = products(vectors, self.vectors)
        for a, s, order in zip(anchors, score, ordered(score)):
            other = order[self.labels[order] != a["label"]]
            falling = ~s[other]  # ascending
            for p in a["positives"]:
                high, low = MOST * p["score"] // 100, -(-LEAST * p["score"] // 100)
                for i in other[np.searchsorted(falling, ~high) :][:NEGATIVES]:
                    if s[i] < low:
                        break
                    yield a["id"], p["id"], p["score"], int(self.ids[i]), int(s[i])


def met(rows: DataFrame, anchors: DataFrame, blocks: int, what: str, schema: str) -> DataFrame:
    """Every anchor held against every block's rows by a method of Block. rows: block, id, label, v; anchors: id, label, v, positives."""
    positives = "array<struct<id: bigint, score: bigint>>"
    first = rows.select("block", F.lit(False).alias("asks"), "id", "label", "v", F.lit(None).cast(positives).alias("positives"))
    then = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "label", "v", F.col("positives").cast(positives).alias("positives"))
    out = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, blocks_of = None, {}, {}
        for batch in batches:
            number, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), [True]))) if len(number) else [0]
            for s, e in zip(edges[:-1], edges[1:]):
                piece = batch.slice(s, e - s)
                if number[s] != at:
                    at, parts, blocks_of = number[s], {}, {}
                if not asks[s]:
                    for dim, where, vectors in grouped(piece):
                        parts.setdefault(dim, []).append((piece.column(2).to_numpy()[where], piece.column(3).to_numpy()[where], vectors))
                    continue
                if parts:  # the block's rows are complete
                    blocks_of, parts = {dim: Block(*(np.concatenate(x) for x in zip(*some))) for dim, some in parts.items()}, {}
                for k in range(0, len(piece), ANCHORS):
                    some = piece.slice(k, ANCHORS)
                    asked = [{"id": i, "label": g, "positives": p} for i, g, p in zip(*(some.column(c).to_pylist() for c in (2, 3, 5)))]
                    found = []
                    for dim, where, vectors in grouped(some):
                        if dim in blocks_of:
                            found += getattr(blocks_of[dim], what)([asked[i] for i in where], vectors)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], out)

    dealt = first.unionByName(then).repartition(2 * blocks, "block").sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(run, schema)


def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor and label are columns of vectors."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), is_anchor.alias("anchor"), v.alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    rows = rows.select("id", "label", "anchor", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))  # floor() stays in a long's range
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.label", "r.v", F.coalesce("r.anchor", F.lit(False)).alias("anchor"))
    rows = written(rows, "negatives-rows")
    blocks = max(1, -(-rows.count() // ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    anchors = rows.filter("anchor").select("id", "label", "v")

    own = met(rows, anchors.withColumn("positives", F.lit(None)), blocks, "best_own", "anchor long, id long, score long")
    positives = ranked(own, ["anchor"], POSITIVES).groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asked = written(anchors.join(positives.withColumnRenamed("anchor", "id"), "id"), "negatives-positives")
    found = met(rows, asked, blocks, "below", "anchor_id long, positive_id long, positive_score long, id long, score long")
    out = ranked(found, ["anchor_id", "positive_id"], NEGATIVES)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


OP13_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
one AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM one a JOIN one r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT *, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INTEGER AS rank FROM found) WHERE rank <= 3
"""
