"""Language-model scores from a log-frequency Bloom filter.

All training texts are counted (words, an end mark after each text, and neighbouring pairs) as 64-bit hashes, in one shuffle that
grows with the corpus, by groups of hashes whose number grows with it too. Counts are quantised to levels growing by ``GROWTH``; the filter holds (n-gram, level) for every level up
to the n-gram's own, so that repeated membership probes, level after level until one misses, give its count back. The filter has
blocks, one for each hash group (a prefix of the hash), each with ``BITS`` bits for every (n-gram, level) it holds: a probe for one it lacks
hits with a chance of 1 % whatever the corpus. Probabilities are mixed with those of the shorter context:

    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),   P(w | v) = MIX c(v w) / c(v) + (1 - MIX) P(w), or P(w) where v is unseen

with counts read from the filter; the base score sums log10 P(w) with exact ones. While the filter is no larger than
``BROADCAST_BYTES``, it is broadcast, once for all workers of an executor, and texts are scored by a map; exact counts of tokens that make up a share of ``FREQUENT`` of all
tokens (so 1 / ``FREQUENT`` of them at most) go with it, those of all others are joined. A larger filter stays in its table: texts are dealt
into chunks, the distinct words and pairs of each are shuffled to the blocks of their groups, and the counts found there go back to
the chunk. Both ways read the same blocks and give the same scores.

Cases: a null text counts as empty and has its end mark alone; texts may be of any length (read in slices at white space);
repeated rows are counted and scored each; without training rows every probability is 1; an empty table gives an empty result;
only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_or_empty, written

GROUP_CHARS = 2 << 20  # characters of training text a hash group, so that a group's counts fit a task whatever the corpus
LEAST_BITS = 10  # hash groups are a power of two, and at least so many
PROBES = 3
BITS = 12.5  # bits of a block for each entry: with PROBES, false hits of (1 - exp(-PROBES / BITS)) ** PROBES, or 1 %
GROWTH = 1.25
MIX = 0.3  # weight of the longer context
BROADCAST_BYTES = 192 << 20  # of a filter, up to which it is broadcast
FREQUENT = 1e-6  # share of all tokens from which on a token's exact count is broadcast with it
CHUNK = 6 << 20  # characters of texts scored together; a longer text is a chunk of its own
SLICE = 1 << 20  # bytes of one text handled at a time, up to the next white space
BATCH = 1 << 20  # bytes handled at a time
FLUSH = 3_000_000  # pairs counted in a task before they are handed on
GROUPS = 64  # hash groups handed on together
ROWS = 512  # texts taken out of a batch together

END = np.uint64(0x9D5C0FB1A7E34D21)
START = np.uint64(0x3F84D5B5B5470917)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW = np.cumprod(np.concatenate(([np.uint64(1)], np.full(1 << 12, _MULT))), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, _MULT))), dtype=np.uint64)
    return _POW


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all parts, in order, and the index of the part each is in."""
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    ink = ~_WHITE[raw]
    edge = np.diff(ink.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - start
    at = np.cumsum(size) - size
    letters = _BYTE[_LOWER[raw[ink]]]
    pos = np.arange(len(letters)) - np.repeat(at, size)
    letters *= powers(int(size.max()))[pos]
    h = mixed(np.add.reduceat(letters, at) + size.astype(np.uint64))
    begins = np.cumsum([len(p) + 1 for p in parts])
    return h, np.searchsorted(begins, start, "right")


def tokens(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text index, token hash, hash of the token before it); each text closes with END and opens after START."""
    last: dict[int, np.uint64] = {}

    def joined(parts: list[bytes], owner: list[int], closes: list[bool]):
        h, part = word_hashes(parts)
        own, n = np.array(owner), len(parts)
        count = np.bincount(part, minlength=n)
        shut = np.array(closes)
        size = count + shut
        first = np.cumsum(size) - size
        out = np.full(int(size.sum()), END)
        out[np.arange(len(h)) + np.repeat(first - (np.cumsum(count) - count), count)] = h
        before = np.empty_like(out)
        before[1:] = out[:-1]
        for i in np.flatnonzero(size):
            before[first[i]] = last.get(owner[i], START)
        for i in np.flatnonzero(~shut & (count > 0)):
            last[owner[i]] = out[first[i] + size[i] - 1]
        return np.repeat(own, size), out, before

    parts, owner, closes, held = [], [], [], 0
    for i, t in enumerate(texts):
        raw, s = t.encode("utf-8", "surrogatepass"), 0
        while True:
            e = min(len(raw), s + SLICE)
            while e < len(raw) and not _WHITE[raw[e]]:
                e += 1
            parts.append(raw[s:e])
            owner.append(i)
            closes.append(e >= len(raw))
            held += e - s
            s = e
            if held >= BATCH:
                yield joined(parts, owner, closes)
                parts, owner, closes, held = [], [], [], 0
            if s >= len(raw):
                break
    if parts:
        yield joined(parts, owner, closes)


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + token)


def thresholds() -> np.ndarray:
    """The least count of each level."""
    t = [1]
    while t[-1] < 1 << 50:
        t.append(max(t[-1] + 1, int(np.ceil(t[-1] * GROWTH))))
    return np.array(t, np.int64)


LEVELS = thresholds()
#: What a count of each level counts as: level 0 is an n-gram that the filter lacks.
VALUE = np.concatenate(([0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0))))


def positions(keys: np.ndarray, level: int, size: int | np.ndarray) -> list[np.ndarray]:
    """Bits of (key, level) within the key's block of size bits."""
    size = np.asarray(size, np.uint64)
    h = mixed(keys + np.uint64(level * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % size).astype(np.int64) for i in range(PROBES)]


def block(grams: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A block with the given (keys, counts)."""
    grams = list(grams)
    entries = sum(int(np.searchsorted(LEVELS, c, "right").sum()) for _, c in grams)
    bits = np.zeros(8 + int(entries * BITS / 8), np.uint8)
    for keys, counts in grams:
        for j, least in enumerate(LEVELS, 1):
            many = counts >= least
            keys, counts = keys[many], counts[many]
            if not len(keys):
                break
            for p in positions(keys, j, 8 * len(bits)):
                np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
    return bits


def probed(bits: np.ndarray, keys: np.ndarray, size: np.ndarray | None = None, base: np.ndarray | None = None) -> np.ndarray:
    """Levels of keys by repeated probes: the one before the first miss, 0 where the filter lacks the key. The keys' block is bits, or lies in it
    from base (bytes) with size (bits), for each key."""
    level = np.zeros(len(keys), np.uint8)
    active = np.arange(len(keys))
    whole = np.uint64(8 * len(bits))
    for j in range(1, len(LEVELS)):
        at = 0 if base is None else base[active]
        for i, p in enumerate(positions(keys[active], j, whole if size is None else size[active])):
            ok = (bits[at + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            hit = ok if i == 0 else hit & ok
        active = active[hit]
        if not len(active):
            break
        level[active] = j
    return level


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte plane by byte plane, so that their common prefixes compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def tallied(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if counts is None:
        return np.unique(k, return_counts=True)
    order = np.argsort(k, kind="stable")
    k, c = k[order], np.concatenate(counts)[order] if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def group_bits(chars: int) -> int:
    """The binary logarithm of the number of hash groups for so many characters."""
    return max(LEAST_BITS, int(np.ceil(np.log2(max(1, chars / GROUP_CHARS)))))


def by_group(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The groups that sorted keys are in, and where."""
    group = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return group[first], [slice(a, b) for a, b in zip(first, [*first[1:], len(keys)])]


def parted(bits: int, words: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, ...], names: tuple[str, ...]) -> pd.DataFrame:
    """A row for each group of the words' and pairs' keys (first in each tuple), with the packed columns of both."""
    out = {}
    for columns, mine in ((words, names[: len(words)]), (pairs, names[len(words) :])):
        groups, at = by_group(columns[0], bits)
        for g, i in zip(groups.tolist(), at):
            row = out.setdefault(g, dict.fromkeys(names, b""))
            for name, c in zip(mine, columns):
                row[name] = planes(c[i]) if c is columns[0] else c[i].tobytes()
    return pd.DataFrame([{"g": g, **row} for g, row in sorted(out.items())], columns=["g", *names])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys with their counts."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.uint32)


def counter(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts, by group: words and pairs as sorted keys with counts. Two arrays are filled and sorted again and again, and a few
        groups at a time are counted and handed on, so that a task's memory is these arrays."""
        words, pairs, held = np.empty(FLUSH, np.uint64), np.empty(FLUSH, np.uint64), 0
        names = ["wk", "wc", "pk", "pc"]

        def flush() -> Iterator[pa.RecordBatch]:
            both = [words[:held], pairs[:held]]
            for k in both:
                k.sort()
            begins = np.arange(0, 1 << bits, GROUPS).astype(np.uint64) << np.uint64(64 - bits)
            for w, p in zip(*[np.split(k, np.searchsorted(k, begins[1:])) for k in both]):
                if len(w) or len(p):
                    rows = parted(bits, counted(w), counted(p), tuple(names))
                    yield pa.RecordBatch.from_arrays([pa.array(rows["g"], pa.int64()), *[pa.array(rows[c], pa.binary()) for c in names]], names=["g", *names])

        for texts in some_texts(batches):
            for _, tok, before in tokens(texts):
                at = 0
                while at < len(tok):
                    n = min(FLUSH - held, len(tok) - at)
                    words[held : held + n] = tok[at : at + n]
                    pairs[held : held + n] = pair(before[at : at + n], tok[at : at + n])
                    held, at = held + n, at + n
                    if held == FLUSH:
                        yield from flush()
                        held = 0
        if held:
            yield from flush()

    return count


def some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The texts of batches, a few at a time."""
    for b in batches:
        for s in range(0, b.num_rows, ROWS):
            yield b["text"].slice(s, ROWS).to_pylist()


def merge(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's counts over all tasks: its block of the filter, and its words with exact counts."""
    wk, wc = tallied(*[list(x) for x in zip(*[(from_planes(k), np.frombuffer(c, np.uint32).astype(np.int64)) for k, c in zip(rows["wk"], rows["wc"])])])
    pk, pc = tallied(*[list(x) for x in zip(*[(from_planes(k), np.frombuffer(c, np.uint32).astype(np.int64)) for k, c in zip(rows["pk"], rows["pc"])])])
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "bits": [block([(wk, wc), (pk, pc)]).tobytes()], "words": [planes(wk)], "counts": [wc.tobytes()], "n_words": [len(wk)], "n_tokens": [int(wc.sum())], "n_pairs": [len(pk)]})


class Model:
    """The corpus totals; filter and counts stay in their table."""

    def __init__(self, total: int, distinct: int, bits: int, filter_bytes: int):
        self.total, self.distinct, self.bits, self.filter_bytes = total, distinct, bits, filter_bytes
        self.room = total + 0.5 * (distinct + 1)


class Held:
    """What is broadcast of a model: all blocks one after another, and the exact counts of frequent tokens."""

    def __init__(self, bits: int, blocks: dict[int, bytes], keys: np.ndarray, counts: np.ndarray):
        sizes = np.full(1 << bits, len(EMPTY), np.int64)
        for g, b in blocks.items():
            sizes[g] = len(b)
        self.bits, self.base, self.size = bits, np.cumsum(sizes) - sizes, (8 * sizes).astype(np.uint64)
        self.data = np.empty(int(sizes.sum()), np.uint8)
        for g, at in enumerate(self.base):
            self.data[at : at + sizes[g]] = np.frombuffer(blocks.get(g, EMPTY), np.uint8)
        self.keys, self.counts = keys, counts

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys as the filter has them."""
        g = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return VALUE[probed(self.data, keys, self.size[g], self.base[g])]

    def exact(self, tok: np.ndarray) -> np.ndarray:
        """Exact counts, 0 where a token isn't among the frequent ones."""
        if not len(self.keys):
            return np.zeros(len(tok), np.int64)
        at = np.minimum(np.searchsorted(self.keys, tok), len(self.keys) - 1)
        return np.where(self.keys[at] == tok, self.counts[at], 0)


EMPTY = block([]).tobytes()


def mapped(shared: Broadcast, size: int) -> np.ndarray:
    """A broadcast array of size bytes, mapped from the file in which an executor keeps it for all its workers; where there is none, or the
    array can't be found in it, the worker's own copy."""
    path = getattr(shared, "_path", None)
    if path and size and os.path.exists(path):
        with open(path, "rb") as f:
            at = f.read(4096).find(b"\x96" + struct.pack("<Q", size))  # how pickle begins a writable buffer
            if at >= 0:
                return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8, size, at + 9)
    return shared.value


def train(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Model]:
    """The merged counts with the filter's blocks (written once), and the totals."""
    texts = docs.select(text_or_empty(text_col).alias("text"))
    bits = group_bits(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    parts = texts.mapInArrow(counter(bits), "g long, wk binary, wc binary, pk binary, pc binary")
    merged = parts.groupBy("g").applyInPandas(merge, "g long, bits binary, words binary, counts binary, n_words long, n_tokens long, n_pairs long")
    merged = written(merged, "lm-counts")
    r = merged.agg(F.sum("n_tokens").alias("total"), F.sum("n_words").alias("distinct"), F.sum(F.length("bits")).alias("size")).first()
    return merged, Model(r["total"] or 0, r["distinct"] or 0, bits, (r["size"] or 0) + (len(EMPTY) << bits))


def exact_counts(merged: DataFrame, low: int, high: int) -> DataFrame:
    """word, c of the words with a count from low to under high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w, c in zip(b["words"], b["counts"]):
                words, counts = from_planes(w), np.frombuffer(c, np.int64)
                ok = (counts >= low) & (counts < high)
                yield pd.DataFrame({"word": words[ok].view(np.int64), "c": counts[ok]})

    return merged.select("words", "counts").mapInPandas(run, "word long, c long")


def held(merged: DataFrame, model: Model, least: int) -> Held:
    """A filter within the bound, and the counts of ``least`` or more, 1 / FREQUENT of them at most."""
    blocks = {r["g"]: bytes(r["bits"]) for r in merged.select("g", "bits").toLocalIterator()}
    often = exact_counts(merged, least, 1 << 62).orderBy("word").toPandas()
    keys = often["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Held(model.bits, blocks, keys[order], often["c"].to_numpy(np.int64)[order])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (who, text) as chunks of up to CHUNK characters: one row with an array of each column."""
    import pyarrow.compute as pc

    for b in batches:
        at = np.cumsum(pc.utf8_length(b["text"]).to_numpy(zero_copy_only=False)) // CHUNK
        cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
        for s, e in zip(cut, cut[1:]):
            if e > s:
                yield pa.RecordBatch.from_arrays([pa.array([x.slice(s, e - s).to_pylist()], pa.list_(x.type)) for x in b.columns], names=b.schema.names)


def unique_tokens(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and the distinct pairs of a chunk, sorted."""
    words, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, tok, before in tokens(list(texts)):
        words.append(np.unique(tok))
        pairs.append(np.unique(pair(before, tok)))
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))


def asker(bits: int):
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words and pairs that each chunk asks for, by group; one chunk's texts at a time are taken out of a batch."""
        for b in batches:
            for i, chunk in enumerate(b["chunk"].to_pylist()):
                words, pairs = unique_tokens(b["text"][i].as_py())
                rows = parted(bits, (words,), (pairs,), ("wk", "pk"))
                yield pa.RecordBatch.from_pydict({"g": pa.array(rows["g"], pa.int64()), "wk": pa.array(rows["wk"], pa.binary()), "pk": pa.array(rows["pk"], pa.binary()), "chunk": pa.array(np.full(len(rows), chunk), pa.int64())})

    return probes


def answers(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """For the keys of a group, in their order: the words' exact counts, and the levels of words and pairs in the filter."""
    if len(held):
        bits, keys = np.frombuffer(held["bits"].iloc[0], np.uint8), from_planes(held["words"].iloc[0])
        counts = np.frombuffer(held["counts"].iloc[0], np.int64)
    else:
        bits, keys, counts = block([]), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w, p = ([from_planes(k) for k in asked[c]] for c in ("wk", "pk"))
    (words, w_at), (pairs, p_at) = (np.unique(np.concatenate([np.zeros(0, np.uint64), *x]), return_inverse=True) for x in (w, p))
    exact = np.zeros(len(words), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        exact = np.where(keys[at] == words, counts[at], 0)

    def parts(found: np.ndarray, at: np.ndarray, like: list[np.ndarray]) -> list[bytes]:
        return [x.tobytes() for x in np.split(found[at], np.cumsum([len(x) for x in like])[:-1])] if like else []

    out = {"exact": parts(exact, w_at, w), "wl": parts(probed(bits, words), w_at, w), "pl": parts(probed(bits, pairs), p_at, p)}
    return pd.DataFrame({"chunk": asked["chunk"].to_numpy(np.int64), "g": asked["g"].to_numpy(np.int64), **out})


def log10p(model: Model, c_tok: np.ndarray, c_before: np.ndarray, joint: np.ndarray) -> np.ndarray:
    if not model.total:
        return np.zeros(len(c_tok))
    joint = np.minimum(joint, np.minimum(c_tok, c_before))
    p1 = (c_tok + 0.5) / model.room
    return np.log10(np.where(c_before > 0, MIX * joint / np.maximum(c_before, 1) + (1 - MIX) * p1, p1))


def score(docs: DataFrame, merged: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id, keep, n_tokens, n_known, train_tokens, base_score, score."""
    way = by_broadcast if model.filter_bytes <= BROADCAST_BYTES else by_groups
    return way(docs, merged, model, id_col, text_col, keep)


def by_broadcast(docs: DataFrame, merged: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[Column, ...]) -> DataFrame:
    least = max(1, int(np.ceil(model.total * FREQUENT)))
    all_, context = held(merged, model, least), docs.sparkSession.sparkContext
    size, blocks, all_.data = len(all_.data), context.broadcast(all_.data), None
    shared = context.broadcast(all_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        h.data = mapped(blocks, size)
        ends = h.values(np.array([END]))[0]  # every text has one end and one start
        for b in (x.slice(s, ROWS) for x in batches for s in range(0, x.num_rows, ROWS)):
            texts = b["text"].to_pylist()
            n = len(texts)
            n_tokens, n_known, base, full = (np.zeros(n) for _ in range(4))
            rare, n_rare = [np.zeros(0, np.uint64)], np.zeros(n + 1, np.int64)
            for own, tok, before in tokens(texts):
                words, at = np.unique(np.concatenate((tok, before)), return_inverse=True)
                c, values = h.exact(words)[at[: len(tok)]], h.values(words)
                values[words == START] = ends
                pairs, where = np.unique(pair(before, tok), return_inverse=True)
                hit = c > 0
                n_tokens += np.bincount(own, minlength=n)
                n_known += np.bincount(own, hit, n)
                base += np.bincount(own, np.where(hit, np.log10((c + 0.5) / model.room), 0.0), n)
                full += np.bincount(own, log10p(model, values[at[: len(tok)]], values[at[len(tok) :]], h.values(pairs)[where]), n)
                rare.append(tok[~hit])  # blocks are in order of texts
                n_rare[1:] += np.bincount(own[~hit], minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n_rare), pa.int32()), pa.array(np.concatenate(rare).view(np.int64)))
            kept = {name: b[name] for name in b.schema.names if name != "text"}
            scored = {"n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "base": pa.array(base), "score": pa.array(full), "rare": lists}
            yield pa.RecordBatch.from_pydict(kept | scored)

    rows = docs.select(F.col(id_col).alias("id"), *keep, text_or_empty(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    got = rows.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base double, score double, rare array<long>")
    got = written(got.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    left = got.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    part = F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(float(model.room))))
    more = left.join(exact_counts(merged, 1, least), "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), part.alias("part"))
    out = got.drop("rare").join(more, "row", "left")
    extra = [F.col(f.name) for f in rows.schema if f.name not in ("id", "text")]
    return out.select(F.col("id").alias(id_col), *extra, "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score")


def by_groups(docs: DataFrame, merged: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[Column, ...]) -> DataFrame:
    def sums(found: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        texts = list(chunk["text"].iloc[0])
        n = len(texts)
        found = found.sort_values("g")  # groups are prefixes, so all keys are in order
        words, pairs = unique_tokens(texts)
        exact, wl, pl = (np.frombuffer(b"".join(found[c]), t) for c, t in (("exact", np.int64), ("wl", np.uint8), ("pl", np.uint8)))
        c_words, c_pairs = VALUE[wl], VALUE[pl]
        n_ends = c_words[np.searchsorted(words, END)]  # every text has one, and a start
        n_tokens, n_known, base, full = (np.zeros(n) for _ in range(4))
        for own, tok, before in tokens(texts):
            at = np.searchsorted(words, tok)
            c = exact[at]
            c_before = np.where(before == START, n_ends, c_words[np.minimum(np.searchsorted(words, before), len(words) - 1)])
            n_tokens += np.bincount(own, minlength=n)
            n_known += np.bincount(own, c > 0, n)
            base += np.bincount(own, np.log10((c + 0.5) / model.room), n)
            full += np.bincount(own, log10p(model, c_words[at], c_before, c_pairs[np.searchsorted(pairs, pair(before, tok))]), n)
        return pd.DataFrame({"chunk": [chunk["chunk"].iloc[0]], "n_tokens": [n_tokens.astype(np.int64)], "n_known": [n_known.astype(np.int64)], "base_score": [base], "score": [full]})

    rows = docs.select(F.struct(F.col(id_col).alias("id"), *keep).alias("who"), text_or_empty(text_col).alias("text"))
    extra = [f.name for f in rows.schema["who"].dataType if f.name != "id"]
    chunks = rows.mapInArrow(chunked, f"who array<{rows.schema['who'].dataType.simpleString()}>, text array<string>")
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")
    asked = chunks.select("chunk", "text").mapInArrow(asker(model.bits), "g long, wk binary, pk binary, chunk long")
    found = asked.groupBy("g").cogroup(merged.groupBy("g")).applyInPandas(answers, "chunk long, g long, exact binary, wl binary, pl binary")
    got = found.groupBy("chunk").cogroup(chunks.select("chunk", "text").groupBy("chunk")).applyInPandas(sums, "chunk long, n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>")
    each = chunks.select("chunk", "who").join(got, "chunk").select(F.explode(F.arrays_zip("who", "n_tokens", "n_known", "base_score", "score")).alias("x"))
    return each.select(F.col("x.who.id").alias(id_col), *[F.col(f"x.who.`{c}`") for c in extra], "x.n_tokens", "x.n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "x.base_score", "x.score")


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 1
    merged, model = train(docs.filter(~held))
    return score(docs, merged, model, keep=(held.alias("held_out"),))
