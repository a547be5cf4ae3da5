"""Phrase counts against a plain greedy parse of the whole text, over many segments and slices; the packed automata against dicts."""

import random

import numpy as np

from spanloom.llm import langid

rng = random.Random(8)


def words(alphabet, n):
    pool = ["".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(60)]
    return " ".join(rng.choice(pool) for _ in range(n))


SAMPLES = {"a": [words("abcde", 300), words("abcde", 40)], "b": [words("cdefgh", 300)], "c": [words("".join(chr(0x4E00 + i) for i in range(900)), 400)]}


def plain_symbols(text):
    out = []
    for c in text.lower():
        s = c if c.isalpha() else " "
        if s != " " or (out and out[-1] != " "):
            out.append(s)
    return out


def plain_phrases(train, text):
    """Longest matches with any stretch of a training text; a symbol that none has is a phrase of its own."""
    known = ["".join(plain_symbols(t)) for t in train]
    sym, i, n = "".join(plain_symbols(text)), 0, 0
    while i < len(sym):
        j = i + 1
        while j < len(sym) and any(sym[i : j + 1] in k for k in known):
            j += 1
        i, n = j, n + 1
    return n, len(sym)


def held_against_plain(texts):
    p = langid.Parser(SAMPLES)
    got, letters = p.entropy(texts)
    for i, k in enumerate(p.langs):
        for j, t in enumerate(texts):
            n, size = plain_phrases(SAMPLES[k], t)
            assert abs(got[i, j] - n * p.bits[i] / max(1, size)) < 1e-9, (k, j)
    assert letters.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_phrases_equal_a_plain_parse():
    texts = [words("abcdefgh", k) for k in (1, 5, 40, 200, 400)] + ["", "  ..", "a", SAMPLES["a"][0], " a  b ", "Xyz 12 " * 100, "ab" * 700]
    held_against_plain(texts)


def test_a_parse_goes_on_over_segments_and_slices():
    old = langid.SEGMENT, langid.SLICE
    langid.SEGMENT, langid.SLICE = 4, 37
    try:
        held_against_plain([words("abcde", 100), SAMPLES["a"][0], " .. ".join(words("cdef", 3) for _ in range(20)), "a" + " " * 200 + "b" * 100, ""])
    finally:
        langid.SEGMENT, langid.SLICE = old


def test_the_model_stays_small_with_a_large_alphabet():
    p = langid.Parser(SAMPLES)
    assert p.base.nbytes + p.owner.nbytes + p.next.nbytes + p.fresh.nbytes < 300_000


def test_transitions_are_those_of_the_automaton():
    p = langid.Parser({"a": SAMPLES["a"]})
    seq = p.symbols([SAMPLES["a"][0].lower()])[0]
    state = np.array([0], np.int32)
    for i, s in enumerate(seq):  # a training text is one phrase
        state, starts = p.step(state, np.array([0]), np.array([s]))
        assert starts[0] == (i == 0)
