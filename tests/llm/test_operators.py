"""The operators against brute force, exact round trips and held-out accuracy, on small invented tables with the awkward cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ann, bpe, langid, lm, media, neardup, packing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
EN = "the of and to in is that for with as was on are by this be from have not they".split()
DE = "der die und das ist nicht ein eine zu mit auf für von dem sich als auch es an werden".split()


def prose(words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i), None, None) for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " \n\t ", "x", "é" * 3, "a b c d e f", "a b c d e f", "w" * 30_000, " ".join(["long"] * 20_000)]


def test_every_operator_takes_awkward_and_empty_tables(spark):
    d = docs(spark, AWKWARD).withColumn("text2", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for rows, n in ((d, len(AWKWARD)), (d.limit(0), 0)):
        assert bpe.encode_digests(rows).count() == n
        assert neardup.near_duplicates(rows).count() == n
        assert langid.predict(rows, F.lit(True)).count() == n
        merged, model = lm.train(rows)
        assert lm.score(rows, merged, model).count() == n
        assert media.read_back(media.describe(media.store(rows))).count() == n
        assert packing.pack(rows).select("doc_id").distinct().count() == n
        field = toxicity.fit(rows, labels, F.lit(True))
        assert rows.select(toxicity.scorer(spark, field)("text")["score"].alias("s")).filter("s between 0 and 1").count() == n
        model, views = quality.fit(rows, labels)
        assert quality.score(views, model).filter("score between 0 and 1").count() == n


def sets_of(text):
    w = text.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_equal_brute_force(spark):
    vocab = [f"t{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(30, 90))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts += [None, "", "a b", "A  b", "a b c"]
    sets = [sets_of(t or "") for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_codec_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    texts = [prose(EN, 50), "Ünïcode — ‘quotes’ 123,456!  \n tabs\t", "don't <|endoftext|> stop", "ab" * 3000, "日本語 текст", ""]
    e = bpe.encoder(bpe.default_vocabulary())
    for text in texts:
        t.no_padding()
        t.no_truncation()
        want = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == want
        assert e.decode(want, "names") == t.decode(want, skip_special_tokens=False)
        n, ids, _ = e.digest(text)
        assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_language_id_learns_and_holds_out(spark):
    texts = [prose(EN if i % 2 else DE, 30) for i in range(80)] + ["12 34 !!", None]
    d = docs(spark, texts, {i: ("en" if i % 2 else "de") for i in range(80)})
    got = langid.predict(d, F.col("doc_id") % 4 != 2).collect()
    right = [r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got if r["doc_id"] < 80]
    assert np.mean(right) > 0.95
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 80} == {"und"}


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = [rng.randint(3, 6) for _ in range(60)]
    to = langid.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(500):
        probe = tuple(rng.randint(3, 6) for _ in range(rng.randint(1, 6)))
        state = 0
        for s in probe:
            state = to[state].get(s) if state is not None else None
        assert (state is not None) == (probe in subs)


def test_language_model_base_scores_are_exact(spark):
    texts = [prose(EN, rng.randint(0, 60)) for _ in range(60)] + [None, "UNSEEN zzz the"]
    d = docs(spark, texts)
    merged, model = lm.train(d.filter("doc_id % 5 <> 1"))
    got = {r["doc_id"]: r for r in lm.score(d, merged, model).collect()}
    tok = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in tok(t))
    room = sum(c.values()) + 0.5 * (len(c) + 1)
    for i, t in enumerate(texts):
        want = sum(math.log10((c[w] + 0.5) / room) for w in tok(t))
        assert abs(got[i]["base_score"] - want) < 1e-6
        assert got[i]["n_known"] == sum(c[w] > 0 for w in tok(t)) and got[i]["n_tokens"] == len(tok(t))
    assert got[0]["train_tokens"] == sum(c.values())


def test_neighbours_are_found(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(600, 16)).astype(np.float32)
    v[5] = v[6] = v[7]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    full = v.astype(float) @ v.astype(float).T
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
        assert abs(full[r["query_id"], r["vec_id"]] - r["score"]) < 1e-9 and r["query_id"] != r["vec_id"]
    for q, rs in by.items():
        assert [r["rank"] for r in sorted(rs, key=lambda r: r["rank"])] == list(range(1, 21))
        order = [i for i in sorted(range(600), key=lambda i: (-full[q, i], i)) if i != q][:20]
        hits += len(set(order) & {r["vec_id"] for r in rs})
    assert len(by) == 30 and hits / (20 * len(by)) >= 0.9


def test_media_round_trip(spark):
    texts = [prose(EN, 200), "", None, "é" * 100, "same", "same"]
    index = media.store(docs(spark, texts))
    got = {r["doc_id"]: r for r in media.read_back(media.describe(index)).collect()}
    for i, t in enumerate(texts):
        p = media.padded((t or "").encode())
        assert got[i]["payload_sha256"] == hashlib.sha256(p).hexdigest() and got[i]["payload_bytes"] == len(p)
        assert got[i]["tail_crc32"] == zlib.crc32(p[-64:])
        image = media.members(got[i]["shard"])[f"{got[i]['digest']}.png"]
        assert hashlib.sha256(image).hexdigest() == got[i]["media_sha256"] and media.samples(image) == p
    assert got[4]["media_sha256"] == got[5]["media_sha256"] and got[4]["feature"] == got[5]["feature"]


def test_packing_keeps_every_id_once(spark):
    texts = [prose(EN, rng.choice([1, 5, 80, 3000])) for _ in range(80)] + [None, ""]
    got = packing.pack(docs(spark, texts)).collect()
    per = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    ids = packing.Ids(packing.default_vocabulary())
    for i, t in enumerate(texts):
        at = 0
        for start, n, total in sorted(per[i]):
            assert start == at and total == len(ids(t or "")) + 1
            at += n
        assert at == total
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in got) / (len(seq) * packing.CAPACITY) > 0.9


def test_differencing_balances():
    sizes = [rng.randint(1, 256) for _ in range(300)]
    w = packing.differencing(sizes, 40)
    load = np.bincount(w, sizes, 40)
    assert load.sum() == sum(sizes) and load.max() - load.min() <= 8


def test_toxic_spans_point_at_the_words(spark):
    bad = ["grumpf", "blarghy", "snorkbad"]
    wide = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]  # so that no two texts pass for near copies
    texts = [prose(wide, 40) + (" " + rng.choice(bad) + " " + prose(wide, 5) if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    d = docs(spark, texts)
    field = toxicity.fit(d, labels, F.col("doc_id") % 3 != 1)
    got = d.select("doc_id", "text", toxicity.scorer(spark, field)("text").alias("t")).collect()
    held = [r for r in got if r["doc_id"] % 3 == 1]
    assert np.mean([(r["t"]["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    for r in held:
        for s in r["t"]["spans"]:
            assert r["text"][s["start"] : s["end"]] in bad


def test_quality_by_two_views(spark):
    rows = [(i, (prose(EN, 60) if i % 3 else " ".join(["buy now"] * 30)), "en", "good" if i % 3 else "junk", None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    model, views = quality.fit(spark.createDataFrame(rows, DOCS), labels)
    got = quality.score(views, model).filter("doc_id % 2 = 1").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got]) > 0.95


def test_language_model_filter_grows_with_the_corpus():
    """Unseen pairs are told from seen ones at the stated rate, however many there are; pairs seen once are held."""
    g = np.random.default_rng(3)
    keys = g.integers(0, 1 << 54, 400_000, dtype=np.uint64)  # of one group
    counts = g.integers(1, 4, len(keys))
    k, c = lm.planes(np.sort(keys)), counts.astype(np.uint32).tobytes()
    row = {"g": [0], "wk": [b""], "wc": [b""], "pk": [k], "pc": [c]}
    bits = np.frombuffer(lm.merge(lm.pd.DataFrame(row))["bits"].iloc[0], np.uint8)
    unseen = g.integers(0, 1 << 54, 100_000, dtype=np.uint64)
    assert np.mean(lm.probed(bits, unseen) > 0) < 0.015
    assert np.array_equal(np.minimum(lm.probed(bits, np.sort(keys)), counts), counts)  # never under the count (levels 1 to 3 are exact)


@pytest.mark.parametrize("bound", [1 << 40, 0])
def test_language_model_score_is_as_documented(spark, bound):
    """Against exact counts, with the filter broadcast, and by groups over several chunks: a pair seen once counts."""
    texts = [prose(EN, 30) for _ in range(40)] + ["lonely couple", None]
    d = docs(spark, texts)
    merged, model = lm.train(d)
    old = lm.CHUNK, lm.BROADCAST_BYTES, lm.FREQUENT
    lm.CHUNK, lm.BROADCAST_BYTES, lm.FREQUENT = 400, bound, 0.02
    try:
        rows = lm.score(d, merged, model).collect()
    finally:
        lm.CHUNK, lm.BROADCAST_BYTES, lm.FREQUENT = old
    got = {r["doc_id"]: r["score"] for r in rows}
    tok = lambda t: [*(t or "").lower().split(), None]
    one = Counter(w for t in texts for w in tok(t))
    for r in rows:
        want = sum(math.log10((one[w] + 0.5) / (sum(one.values()) + 0.5 * (len(one) + 1))) for w in tok(texts[r["doc_id"]]))
        assert abs(r["base_score"] - want) < 1e-6 and r["n_known"] == r["n_tokens"] == len(tok(texts[r["doc_id"]]))
    two = Counter(p for t in texts for p in zip(["^", *tok(t)], tok(t)))
    one["^"] = len(texts)
    v = lambda n: lm.VALUE[np.searchsorted(lm.LEVELS, n, "right")]
    room = sum(one.values()) - len(texts) + 0.5 * len(one)
    for i, t in enumerate(texts):
        want = 0.0
        for a, b in zip(["^", *tok(t)], tok(t)):
            joint = min(v(two[a, b]), v(one[a]), v(one[b]))
            want += math.log10(0.3 * joint / v(one[a]) + 0.7 * (v(one[b]) + 0.5) / room)
        assert abs(got[i] - want) < 0.02 * abs(want)
