"""The corpus pipeline: every stage on awkward tables, and the whole run against its parts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    rows, labels = [], []
    for i in range(300):
        toxic, bad = i % 10 == 3, i % 10 == 6
        text = " ".join(["buy now"] * 40) + f" {i}" if bad else " ".join(rng.choices(words, k=60)) + (" grumpf snork" * 3 if toxic else "")
        rows.append((i, text, "en", "junk" if bad else "web", len(text), "x", "y"))
        if i < 240:
            labels.append((i, int(not bad), int(toxic)))
    a = rows[0][1]
    rows += [(1000, a, None, None, None, None, None), (1001, a + " tail", None, None, None, None, None), (1002, None, None, None, None, None, None), (1003, "", "en", "web", 0, None, None)]
    rows += [(7, rows[7][1], "en", "web", 5, None, None)]  # a repeated row
    return rows, labels


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_takes_effect(spark, tmp_path):
    d = written(spark, tmp_path, *corpus())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d)
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").collect()]
    assert not {i for i in kept["toxicity"] if i < 300 and i % 10 == 3} and {i for i in range(300) if i % 10 != 3} <= set(kept["toxicity"])
    clean = {i for i in range(300) if i % 10 not in (3, 6)}
    assert clean <= set(kept["quality"]) and not {i for i in kept["quality"] if i < 300 and i % 10 == 6}
    assert 0 in kept["near-dedup"] and not {1000, 1001} & set(kept["near-dedup"]) and clean <= set(kept["near-dedup"])
    assert kept["near-dedup"].count(7) == kept["quality"].count(7)
    assert {r["doc_id"] for r in docs.collect()} == set(kept["near-dedup"])


def test_the_run_is_its_stages_one_after_another(spark, tmp_path):
    d = written(spark, tmp_path, *corpus())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert pieces(corpus_pipeline.run(spark, d)) == pieces(packing.pack(docs))


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, None, None), (1, 2, 7)]])
def test_without_labels_of_both_classes_nothing_is_rejected(spark, tmp_path, labels):
    rows, _ = corpus()
    d = written(spark, tmp_path, rows[:20], labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, d).count() == 20


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    d = written(spark, tmp_path, [], [(0, 1, 0), (1, 0, 1)])
    assert corpus_pipeline.run(spark, d).count() == 0
