"""Nearest neighbours by inner product: a forest of random-projection trees.

Trees are grown on a bounded sample (``SAMPLE`` vectors): a node splits its points at the median along the line between two of
them. Every vector is then filed under one leaf of each tree. A query walks all trees through one shared priority queue: a branch
costs the negative logarithm of the chance that a near neighbour lies beyond all planes on its way, and the cheapest one is
always next, until the leaves met hold ``room`` entries (an entry for each vector and tree); the vectors in those leaves are reranked
exactly, in double precision. How a neighbour's place along a plane follows from the query's (a slope and a spread), and how
many entries find ``TARGET`` of all neighbours, is measured on ``TRIALS`` queries against exact answers over all vectors.
Vectors without structure, as in the test tables, need about half of all vectors for a recall of 0.9, so work then grows
with queries times vectors.

Equal vectors are indexed once with their ``K + 1`` smallest ids, which is all that any query can return of them, so a vector
that many rows share costs no more than another. Leaves are dealt out in parts of ``PART`` vectors at most, about ``ENTRIES`` entries
a unit of work; a unit's entries and the queries that ask for them meet in one partition, sorted, so that queries stream past the
entries ``QUERIES`` at a time: neither side is copied, and memory is bounded whatever the data. A unit returns the best ``K + 1``
a query, and a last aggregation merges them.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and those of another than the commonest
dimension, take no part; fewer than K other vectors give as many rows as there are; scores are summed in one fixed order, and ties
go to the smaller id; rows that repeat both id and vector count once; an empty table gives an empty result; only the id and vector
columns are read, so further columns never clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 20
TREES = 12
SAMPLE = 16_384
LEAF = 64  # vectors a leaf; half the square root of the vectors where that is less
TRIALS = 128  # queries that are answered exactly to set the spread and the room
TARGET = 0.93  # share of their neighbours to be found
PART = 4096  # vectors of one leaf that go together
ENTRIES = 40_000  # index entries of a unit of work
QUERIES = 2048  # queries held against a unit's entries at a time


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dim)


class Forest:
    """Inner nodes of all trees in one list: a plane, and two children, either another node or the complement of a leaf."""

    def __init__(self, points: np.ndarray, leaf: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        planes, cuts, kids, self.roots, self.leaves = [], [], [], [], 0

        def grow(ix: np.ndarray) -> int:
            if len(ix) > leaf:
                for _ in range(3):
                    a, b = points[rng.choice(ix, 2, replace=False)]
                    w = a - b
                    size = np.linalg.norm(w)
                    if size > 0:
                        side = points[ix] @ (w / size)
                        cut = np.median(side)
                        low = side <= cut
                        if 0 < low.sum() < len(ix):
                            me = len(planes)
                            planes.append(w / size)
                            cuts.append(cut)
                            kids.append([0, 0])
                            kids[me][0] = grow(ix[low])
                            kids[me][1] = grow(ix[~low])
                            return me
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(points))))
        self.planes = np.array(planes).reshape(len(planes), points.shape[1])
        self.cuts, self.kids = np.array(cuts), kids
        self.slope, self.spread = 1.0, 1.0

    def file(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(v), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(v)))]
            while stack:
                node, ix = stack.pop()
                if node < 0:
                    out[ix, t] = -node - 1
                elif len(ix):
                    low = v[ix] @ self.planes[node] <= self.cuts[node]
                    stack += [(self.kids[node][0], ix[low]), (self.kids[node][1], ix[~low])]
        return out

    def along(self, q: np.ndarray, near: np.ndarray) -> None:
        """Set slope and spread of neighbours along the planes, from pairs of a query and one of its neighbours."""
        if len(self.planes) and len(q):
            xx = xy = yy = 0.0
            for s in range(0, len(q), 64):
                x, y = q[s : s + 64] @ self.planes.T, near[s : s + 64] @ self.planes.T
                xx, xy, yy = xx + (x * x).sum(), xy + (x * y).sum(), yy + (y * y).sum()
            self.slope = float(xy / max(xx, 1e-300))
            self.spread = float(np.sqrt(max((yy - self.slope * xy) / (len(q) * len(self.planes)), 1e-24)))

    def walk(self, q: np.ndarray, sizes: np.ndarray, room: float) -> Iterator[list[int]]:
        """The leaves that each query meets until they hold room entries, all trees sharing one queue."""
        kids, size = self.kids, sizes.tolist()
        for s in range(0, len(q), 64):
            part = q[s : s + 64]
            # logits of lying above each plane; 1.702 makes a logistic curve of a normal one
            z = (self.slope * (part @ self.planes.T) - self.cuts) * (1.702 / self.spread) if len(self.planes) else np.zeros((len(part), 0))
            for below, above in zip(np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist()):
                heap = [(0.0, r) for r in self.roots]
                heapq.heapify(heap)
                met, held = [], 0
                while heap and held < room:
                    cost, node = heapq.heappop(heap)
                    while node >= 0:
                        low, high = kids[node]
                        heapq.heappush(heap, (cost + below[node], low))
                        cost, node = heapq.heappushpop(heap, (cost + above[node], high))
                    met.append(-node - 1)
                    held += size[-node - 1]
                yield met


def best(query: np.ndarray, node: np.ndarray, score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of each query's K + 1 best distinct nodes: by score, then by the node's smallest id."""
    order = np.lexsort((-score, node, query))
    q, n = query[order], node[order]
    order = order[np.concatenate(([True], (q[1:] != q[:-1]) | (n[1:] != n[:-1])))]
    order = order[np.lexsort((first[order], -score[order], query[order]))]
    q = query[order]
    start = np.concatenate(([True], q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank <= K]


def distinct_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """node, vec (binary, doubles), ids (the K + 1 smallest): a row for each distinct vector; written once."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.vstack(b["v"].to_numpy()).astype("<f8") + 0.0  # no negative zeros
            got = pd.DataFrame({"vec": [x.tobytes() for x in v], "id": b["id"]}).drop_duplicates().sort_values("id").groupby("vec", sort=False).head(K + 1)
            got = got.groupby("vec", sort=False)["id"].agg(list).reset_index(name="ids")
            yield got

    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, K + 1)
    folded = rows.mapInPandas(fold, "vec binary, ids array<long>")
    part = folded.groupBy("vec", F.pmod(F.xxhash64("ids"), F.lit(32)).alias("salt")).agg(least("ids").alias("ids"))
    return written(part.groupBy("vec").agg(least("ids").alias("ids")).withColumn("node", F.monotonically_increasing_id()), "ann-vectors")


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order wherever it is computed."""
    return (q * v).sum(axis=1)


def nearest(nodes: DataFrame, query: list[int], vec: np.ndarray) -> pd.DataFrame:
    """query, vec of the K nearest other nodes of a few queries, exactly: each task keeps its best."""
    dim = vec.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, node = np.full((len(vec), 0), 0.0), np.zeros((len(vec), 0), np.int64)
        for b in batches:
            score = np.concatenate((score, vec @ matrix(b["vec"], dim).T), axis=1)
            node = np.concatenate((node, np.broadcast_to(b["node"].to_numpy(), (len(vec), len(b)))), axis=1)
            if score.shape[1] > K + 1:
                top = np.argpartition(-score, K, axis=1)[:, : K + 1]
                score, node = np.take_along_axis(score, top, 1), np.take_along_axis(node, top, 1)
        yield pd.DataFrame({"query": np.repeat(query, score.shape[1]), "node": node.ravel(), "score": score.ravel()})

    found = nodes.select("node", "vec").mapInPandas(run, "query long, node long, score double").filter("query <> node")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(f"r <= {K}").select("query", "node")
    return nodes.select("node", "vec").join(F.broadcast(top), "node").select("query", "vec").toPandas()  # TRIALS * K rows at most


def room_for(forest: Forest, sizes: np.ndarray, q: dict[int, np.ndarray], truth: pd.DataFrame, dim: int) -> float:
    """Entries that a query must meet for TARGET of the neighbours in truth to be found."""
    held = []
    for query, near in truth.groupby("query"):
        v = matrix(near["vec"], dim)
        met = next(forest.walk(q[query][None], sizes, float("inf")))
        place = np.empty(forest.leaves, np.int64)
        place[met] = np.cumsum(sizes[met])
        held.append(place[forest.file(v)].min(axis=1))
    return float(np.quantile(np.concatenate(held), TARGET, method="higher"))


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the K nearest that the forest finds, for every row for which is_query (of column id) holds."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = dims[0]["d"] if dims else 1
    rows = rows.filter(F.size("v") == dim)
    nodes = distinct_vectors(rows, dim)
    total = nodes.count()
    points = matrix([bytes(r["vec"]) for r in nodes.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").toLocalIterator()], dim)
    leaf = min(LEAF, total**0.5 / 2)
    forest = Forest(points, max(8, round(leaf * len(points) / max(1, total))))
    planted = spark.sparkContext.broadcast(forest)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf, n = np.unique(planted.value.file(matrix(b["vec"], dim)), return_counts=True)
            yield pd.DataFrame({"leaf": leaf, "n": n})

    sizes = np.zeros(forest.leaves, np.int64)
    for r in nodes.select("vec").mapInPandas(tally, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    parts = np.maximum(1, -(-sizes // PART))
    first_unit = np.cumsum(parts) - parts
    task = max(1, -(-int(sizes.sum()) // ENTRIES))

    def as_blob(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.vstack(b["v"].to_numpy()).astype("<f8") + 0.0
            yield pd.DataFrame({"id": b["id"], "vec": [x.tobytes() for x in v]})

    queries = rows.filter(is_query).select("id", "v")
    asked = written(queries.mapInPandas(as_blob, "id long, vec binary").join(nodes.select("vec", "node"), "vec").select("id", "node").distinct(), "ann-queries")
    sought = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vec")
    trial = sought.orderBy(F.xxhash64("vec"), "vec").limit(TRIALS).collect()
    room = float("inf")
    if trial and total > K + 1:
        q = {r["node"]: np.frombuffer(bytes(r["vec"]), "<f8") for r in trial}
        truth = nearest(nodes, list(q), np.array(list(q.values())))
        forest.along(np.array([q[i] for i in truth["query"]]), matrix(truth["vec"], dim))
        room = room_for(forest, sizes, q, truth, dim)
    shared = spark.sparkContext.broadcast(forest)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = shared.value.file(matrix(b["vec"], dim))
            unit = (first_unit[leaf] + b["node"].to_numpy()[:, None] % parts[leaf]).ravel()
            at = np.repeat(np.arange(len(b)), leaf.shape[1])
            yield pd.DataFrame({"task": unit % task, "asks": False, "unit": unit, "node": b["node"].to_numpy()[at], "first": b["first"].to_numpy()[at], "vec": b["vec"].to_numpy()[at], "units": None})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for node, vec, met in zip(b["node"], b["vec"], shared.value.walk(matrix(b["vec"], dim), sizes, room)):
                met = np.array(met, np.int64)
                unit = np.concatenate([np.arange(first_unit[m], first_unit[m] + parts[m]) for m in met]) if (parts[met] > 1).any() else first_unit[met]
                where = unit % task
                order = np.argsort(where, kind="stable")
                tasks, start = np.unique(where[order], return_index=True)
                yield pd.DataFrame({"task": tasks, "asks": True, "unit": 0, "node": node, "first": 0, "vec": [vec] * len(tasks), "units": np.split(unit[order], start[1:])})

    def rerank(entries: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        """The best of a unit's entries for each of some queries."""
        v, q = matrix(entries["vec"], dim), matrix(probes["vec"], dim)
        node, first = entries["node"].to_numpy(), entries["first"].to_numpy()
        by_unit = entries.groupby("unit").indices
        asks = pd.DataFrame({"unit": np.concatenate(probes["units"].to_list()), "row": np.repeat(np.arange(len(probes)), probes["units"].str.len())})
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()  # more than a block's rounding
        floor = np.full(len(q), -np.inf)  # what a query's K + 1 best so far reach
        held, count, limit = [], 0, 100_000
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def fold() -> None:
            nonlocal out, held, count, limit
            r, ix = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            cat = [np.concatenate(x) for x in zip(out, (r, ix, inner(q[r], v[ix])))]
            keep = best(cat[0], node[cat[1]], cat[2], first[cat[1]])
            out, held, count = [c[keep] for c in cat], [], 0
            full = np.bincount(out[0], minlength=len(q)) > K
            least = np.full(len(q), np.inf)
            np.minimum.at(least, out[0], out[2])
            floor[full] = (least - slack)[full]
            limit = max(limit, 8 * len(out[0]))

        for u, at in asks.groupby("unit").indices.items():
            ix = by_unit.get(u)
            if ix is None:
                continue
            r = asks["row"].to_numpy()[at]
            s = q[r] @ v[ix].T
            edge = floor[r]
            if len(ix) > K + 1:
                edge = np.maximum(edge, np.partition(s, len(ix) - K - 1, axis=1)[:, len(ix) - K - 1] - slack[r]) if not np.isfinite(edge).all() else edge
            a, b = np.nonzero(s >= edge[:, None])  # ties at the edge come along
            held.append((r[a], ix[b]))
            count += len(a)
            if count > limit:
                fold()
        if held:
            fold()
        return pd.DataFrame({"query": probes["node"].to_numpy()[out[0]], "node": node[out[1]], "first": first[out[1]], "score": out[2]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's rows by unit of work, entries first: each block of queries is held against the entries before it."""
        at, entries, probes, n = None, [], [], 0

        def done() -> Iterator[pd.DataFrame]:
            nonlocal entries, probes, n
            if probes and entries:
                entries = [pd.concat(entries, ignore_index=True)]
                yield rerank(entries[0], pd.concat(probes, ignore_index=True))
            probes, n = [], 0

        for b in batches:
            for (task, asks), rows in b.groupby(["task", "asks"], sort=True):
                if task != at:
                    yield from done()
                    at, entries = task, []
                if not asks:
                    entries.append(rows)
                    continue
                for s in range(0, len(rows), QUERIES):
                    part = rows.iloc[s : s + QUERIES]
                    probes.append(part)
                    n += len(part)
                    if n >= QUERIES:
                        yield from done()
        yield from done()

    schema = "task long, asks boolean, unit long, node long, first long, vec binary, units array<long>"
    index = nodes.select("node", F.col("ids")[0].alias("first"), "vec").mapInPandas(file, schema)
    both = index.unionByName(sought.mapInPandas(ask, schema)).repartition("task").sortWithinPartitions("task", "asks")
    found = both.mapInPandas(meet, "query long, node long, first long, score double")
    found = found.groupBy("query", "node").agg(F.min("first").alias("first"), F.max("score").alias("score"))
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).filter(f"r <= {K + 1}")
    each = near.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("id"))
    entry = F.struct((-F.col("score")).alias("s"), F.col("id"))
    lists = each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, K + 1).alias("list"))
    lists = written(lists, "ann-lists")
    got = asked.join(lists, asked["node"] == lists["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, K).alias("list"))
    return got.select("query_id", F.posexplode("list").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))


def op3_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
