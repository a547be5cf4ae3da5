"""Encoding and decoding against the tokenizers library, on awkward texts; the transducer against whole-word merging."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
rng = random.Random(12)
MARKS = ["a", "B", "é", "é", "Σ", "ς", "İ", "ß", "日", "本", "한", "ᄒ", "ᅡ", "😀", "👩‍👩‍👧", "́", "‍", " ", " ", "\x1f", "\x85", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "’s", "12", "½", "٣", "_", "--", "!?", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "</w>", "Ġ", "\x00", "�", "the", "ing", "http://x.y/z?q=1", "ﬁ"]


def awkward(n=400):
    texts = ["".join(rng.choices(MARKS, k=rng.randint(0, 30))) for _ in range(n)]
    return texts + ["", " ", "w" * 5000, "ab" * 3000 + "é" * 900, " ".join("".join(rng.choices("abcdeé日", k=rng.randint(1, 12))) for _ in range(30_000)), "x" * 70_000 + " y"]


def test_codec_digests_equal_the_library():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    e = bpe.Encoder(bpe.Bpe(bpe.default_vocabulary()))
    for text in awkward():
        ids = t.encode(text, add_special_tokens=False).ids
        text_back = t.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_back.encode()).hexdigest()
        assert e.digest(text) == want, repr(text[:80])


def test_packing_ids_equal_the_library():
    t = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    ids = packing.Ids(packing.default_vocabulary())
    for text in awkward():
        want = t.encode(text, add_special_tokens=False).ids
        assert ids(text).tolist() == want, repr(text[:80])


def test_packing_checksums_equal_the_library(spark):
    t = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    texts = [None, *awkward(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(docs).collect():
        ids = np.array([*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, packing.CLOSE], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_transducer_equals_whole_merging():
    """Also where the buffer is too small for the word, with merge lists that reach far to the right."""
    b = bpe.Bpe(bpe.default_vocabulary())
    old, bpe.CHUNK = bpe.CHUNK, 8
    try:
        for _ in range(200):
            word = "".join(rng.choices(["a", "an", "ing", "er", "th", "é", "日", "e"], k=rng.randint(1, 600)))
            raw = word.encode()
            whole = b.merged([*map(b.inner.__getitem__, raw[:-1]), b.final[raw[-1]]])
            t = bpe.Transducer(b)
            assert [*t.feed(iter(map(b.inner.__getitem__, raw[:-1]))), *t.close(b.final[raw[-1]])] == whole
            assert len(t.buffer) == 0
    finally:
        bpe.CHUNK = old


def test_decoding_by_pieces_equals_decoding_at_once():
    e = bpe.Encoder(bpe.Bpe(bpe.default_vocabulary()))
    for text in ("日本語 текст 😀 naïve", "<|endoftext|> a"):
        ids = e.encode(text)
        for rule in ("names", "text"):
            d = bpe.Decoder(e.bpe, rule)
            assert "".join(d.feed([i]) for i in ids) + d.close() == e.decode(ids, rule)
    assert e.decode(e.encode("日本語 Текст")) == "日本語 текст "
