"""Signs beyond the basic plane are no letters unless they are; copies of one text don't fill the training sample."""

from pyspark.sql import functions as F

from spanloom.llm import langid


def test_signs_alone_are_undetermined():
    p = langid.Parser({"en": ["the quick brown fox"], "xx": ["𐐨𐐩𐐪 abc"]})
    assert p.predict(["😀😀 🚀", "￿", "𐐨𐐩", "the 😀 fox"])[0][:2] == ["und", "und"]
    assert p.predict(["𐐨𐐩"])[0] != ["und"]
    sym, _, _ = p.symbols(["a😀b", "a b"])
    assert sym[:3].tolist() == sym[3:].tolist()


def test_copies_are_sampled_once(spark):
    rows = [(i, "one and the same" if i % 2 else f"text number {i}", "en") for i in range(2000)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "doc_id", "text", "lang")["en"]
    assert len(got) == len(set(got)) and len(got) > 40
