"""Quality scores by co-training two views of a document.

The content view sees the text: frequencies of ASCII bytes and of hashed byte pairs, and how words repeat. The metadata view sees what a page
record tells without reading the words: source, language, declared length, and statistics of the page as a crawler keeps them (lines,
line lengths, shares of upper case, digits, marks and blanks, repeated lines). Each view has a logistic classifier. In each of ``ROUNDS`` rounds every document is
scored by both; of each view's most confident ``PICKS`` documents a class, drawn from all documents and one for each distinct
score, the pseudo-labels go to the other view's training rows. At the end each view is calibrated on labelled rows kept apart,
and a logistic combination of the calibrated views scores every document.

Training rows are a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of each class by a hash of the id, weighted back to the
classes' true counts, plus the picks. Scores, picks and class counts cover all rows.

Cases: a null text counts as empty, a null source or language as a value of its own, a null declared length as the text's own; a
text of any length is read whole; repeated rows are scored alike, repeated labels count once (conflicting ones as bad), those
other than 0 and 1 not at all; labels of
one class only, or none, give every document the share of good labels (1 without any); with one label of a class, calibration uses
the training rows; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

SAMPLE_ROWS = 1800
PICKS = 60
ROUNDS = 3
PAIRS = 128
CONTENT = 128 + PAIRS + 4
SHORT = 60  # bytes added to a text's length, so that the shares of short texts count less
HASHED = 48
META = HASHED + 12
SLICE = 1 << 20


def content(texts: list[bytes]) -> np.ndarray:
    """As bytes from 0 to 255: square roots of the shares of ASCII bytes and of hashed byte pairs; how much words and neighbouring pairs of words repeat; the logarithm of the number of words."""
    out = np.zeros((len(texts), CONTENT))
    for i, t in enumerate(texts):
        for s in range(0, len(t), SLICE):
            b = np.frombuffer(t[s : s + SLICE + 1], np.uint8)
            own = b[:SLICE]
            out[i, :128] += np.bincount(np.minimum(own, 127), minlength=128)
            pair = b[:-1].astype(np.uint32) * 256 + b[1:]
            out[i, 128:-4] += np.bincount((pair * np.uint32(2654435761)) >> np.uint32(25), minlength=PAIRS)
        out[i] /= len(t) + SHORT
        words = t.split()
        n = len(words)
        again = 1 - len(set(words)) / max(1, n)
        twice = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
        out[i, -4:] = (again * n / (n + 10)) ** 2, (twice * n / (n + 10)) ** 2, (twice * n / (n + 10)) ** 4, (np.log1p(n) / 12) ** 2
    return np.round(255 * np.sqrt(np.minimum(out, 1))).astype(np.uint8)


_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5


def crc(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def metadata(texts: list[bytes], source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(texts), META), np.float32)
    for i, t in enumerate(texts):
        out[i, crc(f"s:{source[i]}") % (HASHED - 8)] = 1
        out[i, HASHED - 8 + crc(f"l:{lang[i]}") % 8] = 1
        lines = t.split(b"\n")
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        shares = np.zeros(6)
        for s in range(0, len(t), SLICE):
            shares += np.bincount(_CLASS[np.frombuffer(t[s : s + SLICE], np.uint8)], minlength=6)
        shares /= len(t) + SHORT
        declared = len(t) if n_chars[i] is None or n_chars[i] != n_chars[i] else max(0, n_chars[i])
        out[i, HASHED:] = (np.log1p(declared) / 10, np.log1p(len(lines)) / 5, np.log1p(sizes.mean()) / 8, np.log1p(sizes.max()) / 10, *np.sqrt(shares), (sizes == 0).mean(), 1 - len(set(lines)) / len(lines))
    return out


class Logistic:
    """Weighted ridge-regularised logistic regression; the last weight is the constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        x = np.column_stack((x, np.ones(len(x))))
        self.b = np.zeros(x.shape[1])
        weight = weight / weight.mean()
        pen = np.full(x.shape[1], ridge)
        pen[-1] = 1e-3
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(x @ self.b, -30, 30)))
            r = weight * p * (1 - p)
            step = np.linalg.solve((x * r[:, None]).T @ x + np.diag(pen), x.T @ (weight * (y - p)) - pen * self.b)
            self.b += step * min(1.0, 8 / max(1e-9, np.abs(x @ step).max()))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.b[:-1] + self.b[-1]


def scaled(c: np.ndarray) -> np.ndarray:
    return c.astype(np.float32) / 64


class Model:
    """Both views' classifiers and what combines them; without classifiers, a constant score."""

    def __init__(self, constant: float = 1.0):
        self.constant, self.views, self.scale, self.top = constant, None, None, None

    def logits(self, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.views is None:
            return np.zeros(len(c)), np.zeros(len(c))
        return self.views[0].logit(scaled(c)), self.views[1].logit(m)

    def calibrate(self, c, m, y, weight) -> None:
        z = self.logits(c, m)
        self.scale = [Logistic(v[:, None], y, weight, 0.01) for v in z]
        self.top = Logistic(np.column_stack([s.logit(v[:, None]) for s, v in zip(self.scale, z)]), y, weight, 0.1)

    def scores(self, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata probabilities of good quality."""
        if self.top is None:
            k = np.full(len(c), self.constant)
            return k, k, k
        cal = [s.logit(v[:, None]) for s, v in zip(self.scale, self.logits(c, m))]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (self.top.logit(np.column_stack(cal)), *cal))


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> DataFrame:
    """id, content binary, meta binary (float32): the two views of every document, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            c, m = content(raw), metadata(raw, list(b["source"]), list(b["lang"]), list(b["size"]))
            yield pd.DataFrame({"id": b["id"], "content": [x.tobytes() for x in c], "meta": [x.tobytes() for x in m]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(size_col).cast("double").alias("size"))
    return written(rows.mapInPandas(run, f"id {kind}, content binary, meta binary"), "quality-views")


def arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = len(rows)
    return np.frombuffer(b"".join(rows["content"]), np.uint8).reshape(n, CONTENT), np.frombuffer(b"".join(rows["meta"]), np.float32).reshape(n, META)


def once(rows: DataFrame, *also: str) -> DataFrame:
    """One row, the least, of those that repeat an id, so an id that many rows share costs the driver one."""
    return rows.groupBy("id", *also).agg(F.min(F.struct("content", "meta")).alias("v")).select("id", *also, "v.content", "v.meta")


def train(views: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    spark = views.sparkSession
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).dropna().filter("good in (0, 1)").groupBy("id").agg(F.min("good").alias("good"))
    counts = {int(r["good"]): r["n"] for r in ids.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(float(next(iter(counts), 1)))
    h = F.xxhash64(F.col("id").cast("string"))
    picked = ids.filter("good = 1").orderBy(h, "id").limit(SAMPLE_ROWS).unionByName(ids.filter("good = 0").orderBy(h, "id").limit(SAMPLE_ROWS))
    rows = once(views.join(F.broadcast(picked), "id"), "good").withColumn("h", h).toPandas().sort_values(["h", "id"])
    y = rows["good"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Model(counts[1] / (counts[0] + counts[1]))
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    c, m = arrays(rows)
    apart = np.zeros(len(y), bool)
    for k in (0, 1):
        apart[np.flatnonzero(y == k)[::4]] = True
    fit = ~apart
    if len(set(y[fit])) < 2:  # too few labels to keep any apart
        fit[:] = True
    model = Model()
    sets = [[scaled(c[fit]), y[fit], weight[fit]], [m[fit], y[fit], weight[fit]]]
    taken = set(rows["id"])
    for step in range(ROUNDS + 1):
        model.views = [Logistic(*s) for s in sets]
        if step == ROUNDS:
            break
        z = scored(views, spark, model)
        chosen = []
        for view in (0, 1):
            col = f"z{view}"
            single = z.groupBy(F.round(col, 9).alias("z")).agg(F.min("id").alias("id"))
            for good, order in ((1.0, F.desc("z")), (0.0, F.asc("z"))):
                chosen.append(single.filter("z > 0" if good else "z < 0").orderBy(order, "id").limit(PICKS).select("id", F.lit(view).alias("view"), F.lit(good).alias("good")))
        union = chosen[0]
        for x in chosen[1:]:
            union = union.unionByName(x)
        got = once(views.join(F.broadcast(union), "id"), "view", "good").toPandas().sort_values(["view", "good", "id"])
        for view in (0, 1):  # one view's picks teach the other
            new = got[(got["view"] == view) & ~got["id"].isin(taken)].drop_duplicates("id")
            if len(new):
                nc, nm = arrays(new)
                other = sets[1 - view]
                other[0] = np.concatenate((other[0], nm if view == 0 else scaled(nc)))
                other[1] = np.concatenate((other[1], new["good"].to_numpy(np.float64)))
                other[2] = np.concatenate((other[2], np.full(len(new), weight.mean())))
        taken |= set(got["id"])
    model.calibrate(c[apart], m[apart], y[apart], weight[apart])
    return model


def scored(views: DataFrame, spark: SparkSession, model: Model) -> DataFrame:
    """id and both views' logits, written once a round."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = shared.value.logits(*arrays(b))
            yield pd.DataFrame({"id": b["id"], "z0": z[0], "z1": z[1]})

    kind = views.schema["id"].dataType.simpleString()
    return written(views.mapInPandas(run, f"id {kind}, z0 double, z1 double"), "quality-round")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", label_col: str = "quality") -> tuple[Model, DataFrame]:
    """The trained model, and the views of every document."""
    views = features(docs, id_col, text_col, source_col, lang_col, size_col)
    return train(views, labels, id_col, label_col), views


def score(views: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, score, content_score, metadata_score."""
    shared = views.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.scores(*arrays(b))
            yield pd.DataFrame({"id": b["id"], "score": s[0], "content_score": s[1], "metadata_score": s[2]})

    kind = views.schema["id"].dataType.simpleString()
    return views.mapInPandas(run, f"id {kind}, score double, content_score double, metadata_score double").withColumnRenamed("id", id_col)


def scorer(spark: SparkSession, model: Model):
    """A column function of text, source, language and declared length: the combined score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.Series:
        raw = [t.encode("utf-8", "surrogatepass") for t in text]
        size = size.astype("float64")
        return pd.Series(shared.value.scores(content(raw), metadata(raw, list(source), list(lang), list(size)))[0])

    return quality


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, views = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(views, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
