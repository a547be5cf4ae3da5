"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A merge list decides each token from a bounded stretch of text to its right. ``lookahead`` computes a sufficient length from
the list itself; ``Transducer`` then reads every word symbol by symbol, emits a token once that many symbols lie beyond it or the
word has ended, and goes on from there, so its buffer stays constant however long the word is. Decoding is a state machine from
ids to bytes to text, fed block by block. A text goes through both in slices, and digests are updated as blocks of ids come.

Cases: a null text counts as empty; an empty text gives no ids and an empty decoded text; texts may be of any length (a word
without a break, too); repeated rows give repeated results; an empty table gives an empty one. Only the id and text columns
are read, so further columns never clash.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Symbols that a buffer takes beyond the lookahead before tokens are emitted.
CHUNK = 1024
#: Characters of a text, or ids, handled at a time.
SLICE = 1 << 16
#: Words whose encoding each worker keeps; two generations of this many at most.
CACHE = 120_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols beyond a token that settle it.

    A merge (u, v) can only be lost to an earlier one (v, x) that takes v first, and that one to a still earlier (x, y), and
    so on: the longest such chain of right parts, measured in symbols, bounds how far to the right a token can depend. One
    longest token is added for the part x is itself being built from.
    """
    best: dict[str, int] = {}
    most = 0
    for u, v in merges:
        d = len(v) + best.get(v, 0)
        most = max(most, d)
        if d > best.get(u, 0):
            best[u] = d
    return most + max((len(u) + len(v) for u, v in merges), default=1)


class Bpe:
    """The vocabulary and merges of a tokenizers file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[u], self.vocab[v]): r for r, (u, v) in enumerate(merges)}
        self.joined = [self.vocab[u + v] for u, v in merges]
        cut = len(self.suffix)
        bare = [(u.removesuffix(self.suffix) if cut else u, v.removesuffix(self.suffix) if cut else v) for u, v in merges]
        self.lookahead = lookahead(bare)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names |= {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.rule = "names" if spec.get("decoder") is None else "text"
        self.inner = [self.vocab.get(s) for s in symbols]
        self.final = [self.vocab.get(s + self.suffix) for s in symbols]
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        size = 1 + max(self.names)
        self.decimal = [str(i).encode() for i in range(size)]
        self.tables = {"names": [self.names.get(i, "").encode() for i in range(size)], "text": [self.bytes_for(self.names.get(i, "")) for i in range(size)]}

    def bytes_for(self, name: str) -> bytes:
        """The bytes of the text that a token stands for; a space for a word end."""
        if name in self.special:
            return name.encode()
        end = bool(self.suffix) and name.endswith(self.suffix)
        return bytes(map(self.bytes_of.__getitem__, name.removesuffix(self.suffix) if end else name)) + (b" " if end else b"")

    def merged(self, ids: list[int]) -> list[int]:
        """All merges in a list of symbols: lowest rank first, leftmost first among equals."""
        rank, joined, none = self.ranks.get, self.joined, len(self.joined)
        if len(ids) <= 96:
            found = [rank(p, none) for p in zip(ids, ids[1:])]
            while found:
                r = min(found)
                if r == none:
                    break
                i = found.index(r)
                ids[i : i + 2] = [joined[r]]
                del found[i]
                if i:
                    found[i - 1] = rank((ids[i - 1], ids[i]), none)
                if i < len(found):
                    found[i] = rank((ids[i], ids[i + 1]), none)
            return ids
        n = len(ids)
        after, before, ids = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]), none)) < none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = joined[r], -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]), none)) < none:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if h >= 0 and (r := rank((ids[h], ids[i]), none)) < none:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def symbol_count(self, token: int) -> int:
        return len(self.names[token].removesuffix(self.suffix) if self.suffix else self.names[token])


class Transducer:
    """Fed the symbols of one word; emits tokens as soon as they are settled, the rest at the word's end."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.buffer, self.limit = bpe, [], bpe.lookahead + CHUNK

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        symbols = iter(symbols)
        while True:
            self.buffer += islice(symbols, self.limit - len(self.buffer))
            if len(self.buffer) < self.limit:
                return
            used = 0
            for token in self.bpe.merged(list(self.buffer)):
                n = self.bpe.symbol_count(token)
                if used + n + self.bpe.lookahead > len(self.buffer):
                    break
                used += n
                yield token
            del self.buffer[:used]

    def close(self, last: int) -> list[int]:
        self.buffer.append(last)
        out, self.buffer = self.bpe.merged(self.buffer), []
        return out


class Decoder:
    """The byte-to-text machine: ids turn into bytes, and bytes into text as characters complete. Its state is the bytes of an
    unfinished character and whether anything came before.

    Under the rule ``names``, which is that of a file without a decoder, an id's bytes are its token's name, and one space stands
    between tokens; under ``text`` they are the bytes that the token stands for, with a space after each word end."""

    def __init__(self, bpe: Bpe, rule: str | None = None):
        self.rule, self.started = rule or bpe.rule, False
        self.of = bpe.tables[self.rule].__getitem__
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        if not ids:
            return ""
        if self.rule == "text":
            return self.utf8.decode(b"".join(map(self.of, ids)))
        raw = b" ".join(map(self.of, ids))
        raw, self.started = (b" " + raw if self.started else raw), True
        return self.utf8.decode(raw)

    def close(self) -> str:
        return self.utf8.decode(b"", True)


def lowered(text: str) -> str:
    """Lower case character by character, so a final sigma stays a plain one."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def slices(text: str) -> Iterator[str]:
    """A text in slices of about SLICE characters that end after a blank, where no word and no character composition goes on."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + SLICE) + 1 or len(text)
        yield text[at:end]
        at = end


class Encoder:
    """Whole texts to ids. Every word goes through a transducer; those met lately are kept in a bounded two-generation cache."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.young, self.old = bpe, {}, {}

    def word(self, word: str) -> Iterator[int]:
        raw = word.encode("utf-8", "surrogatepass")
        t = Transducer(self.bpe)
        yield from t.feed(map(self.bpe.inner.__getitem__, memoryview(raw)[:-1]))
        yield from t.close(self.bpe.final[raw[-1]])

    def fresh(self, word: str) -> Iterable[int]:
        """A word's ids; kept if the word is short."""
        found = self.old.get(word)
        if found is None:
            found = self.word(word)
            if len(word) > 64:
                return found
            found = tuple(found)
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in blocks of bounded size, in order."""
        held: list[int] = []
        for part in self.bpe.specials.split(text) if self.bpe.specials else [text]:
            if part in self.bpe.special:
                held.append(self.bpe.special[part])
                continue
            for s in slices(part):
                young = self.young
                for x in self.bpe.words.findall(lowered(s)):
                    ids = young.get(x)
                    if ids is None:
                        ids = self.fresh(x)
                        young = self.young
                        if type(ids) is not tuple:  # a long word: as its tokens settle
                            for i in ids:
                                held.append(i)
                                if len(held) >= SLICE:
                                    yield held
                                    held = []
                            continue
                    held += ids
                if len(held) >= SLICE:
                    yield held
                    held = []
        if held:
            yield held

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by one space, SHA-256 of the decoded text, all updated block by block."""
        n, ids, out, machine, number = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.bpe), self.bpe.decimal.__getitem__
        for block in self.blocks(text):
            if n:
                ids.update(b" ")
            ids.update(b" ".join(map(number, block)))
            out.update(machine.feed(block).encode())
            n += len(block)
        out.update(machine.close().encode())
        return n, ids.hexdigest(), out.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for i in block]

    def decode(self, ids: list[int], rule: str = "text") -> str:
        d = Decoder(self.bpe, rule)
        return d.feed(ids) + d.close()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(Bpe(path))
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string (the text from the state machine)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(x) for x in b["text"]]
            yield pd.DataFrame({"id": b["id"], "ids": ids, "decoded": [e.decode(x) for x in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text; a map without a shuffle."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            got = [e.digest(x) for x in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n_tokens": [x[0] for x in got], "ids_sha256": [x[1] for x in got], "decoded_sha256": [x[2] for x in got]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
