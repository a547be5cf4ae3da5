"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids, closed by ``CLOSE``, are cut into whole windows as far as they go; what is left over is cut into pieces of
``PIECE`` ids at most. A task gathers the pieces in blocks of ``BLOCK``. A block goes into k windows, first as few as its ids
need: every piece starts as a partial partition with one filled window; the two partial partitions with the largest imbalance are
merged, fullest windows with emptiest, until one is left, with windows of nearly the same length. If one of them exceeds the
capacity, k rises by one and the block is parted anew. All is a map over the input's partitions, without a shuffle: sequence ids
hold the partition's number.

Cases: a null text counts as empty; an empty text is the closing id alone; a text of any length is cut into windows; repeated rows
are packed each, as documents of their own; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

CAPACITY = 1024
PIECE = 256
BLOCK = 1500
CLOSE = 0


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window of each piece when all go into k windows of nearly equal sums.

    A partial partition is its k sums in falling order; of a merge, the places of both parents' windows are kept, so that the
    windows of all pieces follow from the last partition downwards.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    lone = np.zeros(k, np.int64)
    parts: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        p = lone.copy()
        p[0] = s
        parts[i] = p
        heap.append((-s, i))
    heapq.heapify(heap)
    merges, new = [], n
    kind = np.int32 if k > 32000 else np.int16
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = parts.pop(a) + parts.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merges.append((a, b, order.astype(kind)))
        parts[new] = both - both[-1]  # only differences count
        heapq.heappush(heap, (int(both[-1] - both[0]), new))
        new += 1
    at: dict[int, np.ndarray] = {new - 1: np.arange(k)}
    window = np.zeros(n, np.int64)
    for node in range(new - 1, n - 1, -1):
        a, b, order = merges[node - n]
        bins = at.pop(node)
        place = np.empty(k, np.int64)
        place[order] = bins
        for child, own in ((a, place), (b, place[::-1])):
            if child < n:
                window[child] = own[0]
            else:
                at[child] = own
    if n == 1:
        window[0] = 0
    return window


def windows(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Windows by differencing; their number rises until none exceeds the capacity. A piece exceeds it never."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        got = differencing(sizes, k)
        if np.bincount(got, sizes).max() <= capacity:
            return got
        k += 1


class Ids:
    """Token ids of a byte-level BPE file, as its own library gives them without special tokens added."""

    def __init__(self, path: str):
        from .bpe import byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.path, self.plain = path, None
        if spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and ids == sorted(ids):
            import public_tokenizers
            import tiktoken  # the same merges, several times as fast

            back = {s: b for b, s in enumerate(byte_symbols())}
            ranks = {bytes(map(back.__getitem__, s)): i for s, i in vocab.items() if all(c in back for c in s)}
            self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
        self.library = None

    def __call__(self, text: str) -> np.ndarray:
        if self.plain is not None:
            try:
                return self.plain.encode_to_numpy(text, allowed_special="all")
            except (ValueError, UnicodeError):  # its pattern engine gave up on a text; the other library reads it
                pass
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LOADED: dict[str, Ids] = {}
COLUMNS = ["start", "length", "ids_crc32", "doc_tokens"]


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _LOADED:
            _LOADED[path] = Ids(path)
        encode, sequence = _LOADED[path], TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            nonlocal sequence, held
            out = pd.DataFrame(held, columns=["id", *COLUMNS])
            w = windows(out["length"].tolist())
            order = np.argsort(w, kind="stable")
            size = out["length"].to_numpy()[order]
            before = np.cumsum(size) - size
            first = np.concatenate(([True], np.diff(w[order]) != 0))
            _, number = np.unique(w[order], return_inverse=True)
            out = out.iloc[order].assign(sequence_id=sequence + number, offset=before - np.maximum.accumulate(np.where(first, before, 0)))
            sequence, held = sequence + int(number.max()) + 1, []
            return out

        for b in batches:
            whole = []
            for i, text in zip(b["id"], b["text"]):
                ids = np.append(encode(text), CLOSE).astype("<u4")
                n = len(ids)
                for s in range(0, n - n % CAPACITY, CAPACITY):
                    whole.append((i, s, CAPACITY, zlib.crc32(ids[s : s + CAPACITY].tobytes()), n, sequence, 0))
                    sequence += 1
                for s in range(n - n % CAPACITY, n, PIECE):
                    piece = ids[s : s + PIECE]
                    held.append((i, s, len(piece), zlib.crc32(piece.tobytes()), n))
                if len(held) >= BLOCK:
                    yield flush()
            if whole:
                yield pd.DataFrame(whole, columns=["id", *COLUMNS, "sequence_id", "offset"])
        if held:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op8_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
