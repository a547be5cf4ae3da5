"""A training corpus from documents: drop toxic ones, drop poor ones, keep one of each group of near copies, pack the rest.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and reread as the next one's docs. All
but the last return the columns of documents. Stages learn from ``labels`` and look only at the documents that are left.

Cases: a null or empty text is scored like any other, is a copy of nothing, and is packed as its closing id alone; a null source,
language or length is a value of its own; rows that repeat an id share its fate; of equal scores all stay or go, and of a group of near copies the
smallest id stays, so rows with a null id are neither linked nor dropped as copies; without labels (or with those of one class) toxicity drops
nothing, and quality drops nothing unless all labels are bad; an empty table gives an empty result; further columns, whatever their
names, are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import neardup, packing, quality, toxicity
from spanloom.llm.common import table, text_or_empty, written

TOXIC = 0.7  # scores from here on reject a document
GOOD = 0.5  # scores under this reject a document


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.filter(toxicity.scorer(spark, field)(text_or_empty())["score"] < TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, _ = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = quality.scorer(spark, model)(text_or_empty(), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double"))
    return docs.filter(score >= GOOD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-dedup", drop_copies), ("packing", pack_windows)]

#: Trained models decide what stays, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
