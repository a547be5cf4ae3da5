"""The counting step of op5: whole counts out of a bounded memory, handed on in small batches."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from spanloom.llm import lm


def batches(n, words, seed=3):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}" for i in rng.integers(0, 400_000, words)) for _ in range(600)])], names=["text"])


def test_counts_are_whole_over_flushes_and_groups():
    old = lm.FLUSH
    lm.FLUSH = 1000
    try:
        got, rows = {"w": Counter(), "p": Counter()}, 0
        for b in lm.counter(10)(batches(2, 7)):
            rows = max(rows, b.num_rows)
            for r in b.to_pylist():
                for kind in "wp":
                    keys = lm.from_planes(r[f"{kind}k"])
                    assert (keys >> np.uint64(54) == r["g"]).all()
                    got[kind].update(dict(zip(keys.tolist(), np.frombuffer(r[f"{kind}c"], np.uint32).tolist())))
    finally:
        lm.FLUSH = old
    want = {"w": Counter(), "p": Counter()}
    for b in batches(2, 7):
        for _, tok, before in lm.tokens(b["text"].to_pylist()):
            want["w"].update(tok.tolist())
            want["p"].update(lm.pair(before, tok).tolist())
    assert got == want and rows <= lm.GROUPS


def test_memory_of_a_counting_task():
    given = list(batches(15, 400))  # 3.6 million tokens, most pairs distinct
    tracemalloc.start()
    try:
        for b in lm.counter(10)(iter(given)):
            del b
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45 * lm.FLUSH  # the two arrays take 16


def test_a_broadcast_filter_is_mapped_not_copied(spark):
    data = np.arange(300_000, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        for _ in batches:
            got = lm.mapped(shared, 300_000)
            yield pa.RecordBatch.from_pydict({"same": [bool((got == np.arange(300_000, dtype=np.uint8)).all())], "own": [got.flags.writeable]})

    assert spark.range(1).mapInArrow(run, "same boolean, own boolean").collect() == [(True, False)]
    assert lm.mapped(SimpleNamespace(value=data), 300_000) is data
