"""Links among the copies of one text, half of which are too far from it: none is lost, and few pairs are formed."""

import random

import pytest

from spanloom.llm import neardup


def sets_of(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_of_copies(spark, seed):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(3000)]
    base = rng.choices(vocab, k=90)

    def changed(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(vocab)
        return out[rng.choice([0, 0, 1]) :] + rng.choices(vocab, k=rng.choice([0, 0, 2]))

    texts = [base]
    for _ in range(70):  # copies of the text, and of copies
        texts.append(changed(rng.choice([base, base, *texts[-8:]]), rng.randint(0, 5)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [sets_of(" ".join(t)) for t in texts]
    comp = list(range(len(texts)))
    while True:
        old = list(comp)
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == old:
            break
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == comp
    assert len(set(comp)) > 3


def test_copies_that_nothing_can_be_linked_with_form_few_rows(spark, monkeypatch):
    """Copies with words of their own in many places: the copies near the text are linked with it, and what the others share is too little."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    texts = [base]
    for c in range(300):
        out = list(base)
        for at in rng.sample(range(0, 120, 5), 1 + c % 6):
            out[at] = f"own{c}x{at}"
        texts.append(out)
    made, prefix = [], neardup.prefix

    def counted(*delta):
        made.append(prefix(*delta).count())
        return prefix(*delta)

    monkeypatch.setattr(neardup, "prefix", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    linked = lambda n: 100 * (116 - 5 * n) >= 75 * (116 + 5 * n)
    assert all(got[i + 1] == 0 for i in range(300) if linked(1 + i % 6))
    assert len(made) == 3 and sum(made) < 150  # 303 without the bound
