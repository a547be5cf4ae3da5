"""Rows that repeat an id, and labels that conflict, before anything is collected."""

from pyspark.sql import functions as F

from spanloom.llm import langid, quality


def test_one_row_for_each_id(spark):
    rows = [(7, bytes([9, i % 250]), b"m", 1) for i in range(2000)] + [(8, b"x", b"y", 0)]
    df = spark.createDataFrame(rows, "id long, content binary, meta binary, good int").repartition(8)
    got = sorted((r["id"], r["good"], bytes(r["content"])) for r in quality.once(df, "good").collect())
    assert got == [(7, 1, bytes([9, 0])), (8, 0, b"x")]


def test_conflicting_labels_are_bad_and_others_don_t_count(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with some words", "s", "en", 30) for i in range(20)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 5), (4, None)], "doc_id long, quality int")
    model, _ = quality.fit(docs, labels)  # both labelled rows are bad: one class alone
    assert model.scores(*quality.arrays(quality.features(docs, "doc_id", "text", "source", "lang", "n_chars").toPandas()))[0].max() == 0


def test_long_and_short_texts_share_the_symbols(spark):
    long = " ".join(f"wort{i}" for i in range(5000))
    rows = [(i, f"ein kurzer text {i}", "de") for i in range(30)] + [(99, long, "de"), (100, long, "de"), (7, "ein kurzer text 7", "de")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "doc_id", "text", "lang")["de"]
    assert len(got) == len(set(got))
    share = langid.SAMPLE_SYMBOLS // len(got)
    big = max(got, key=len)
    assert len(big) <= share + share // langid.STRETCH and "wort0 " in big and big.endswith("wort4999") and all(len(t) <= share for t in got if t != big)
