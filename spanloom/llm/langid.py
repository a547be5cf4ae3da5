"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text accepts exactly that text's substrings. A document is parsed greedily against
each automaton: a phrase is the longest match with the language's text, and the language that needs the fewest phrases,
normalised to bits a symbol (phrases * log2(training symbols) / symbols), wins; ties go to the smaller name.

The automata are built from a bounded sample of labelled rows: ``SAMPLE_ROWS`` rows a language at most, picked by a hash of the text
whatever its length, so copies count once, which share ``SAMPLE_SYMBOLS`` characters evenly. A text within its share is learned whole, of a longer one
stretches of ``STRETCH`` characters spread evenly from its start to its end. Every document is scored on its whole text. A suffix automaton of n symbols has at most 2n states and 3n transitions, and
transitions are stored sparsely, so the broadcast model takes under 1 MB a language whatever its alphabet.

For parsing many documents at once, a text is laid out as rows of ``SEGMENT`` symbols that are parsed side by side, each as if a
phrase began there; then every row is parsed again from the state in which the row before it ends, until both parses of it agree, so
phrases are those of one parse of the whole text.

Cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled row everything is ``und``; texts may
be of any length (read in slices, the parse going on); repeated rows are scored alike; an empty table gives an empty result; only the id,
text and language columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, table, text_or_empty, written

SAMPLE_ROWS = 48  # labelled rows a language
SAMPLE_SYMBOLS = 24_000  # characters of them, shared evenly, that go into its automaton
STRETCH = 100  # characters of a text that are learned together
SEGMENT = 512
SLICE = 1 << 19  # characters of one text handled at a time; the parse goes on in the next slice
BLOCK = 12 << 20  # characters times languages of a batch handled at a time
TRIES = 50  # places tried for a row of transitions before going on at the end of the table
SPACE, OTHER, PAD = 0, 1, 2


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 its root. Negative symbols end a row and match nothing."""
    to, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        if s < 0:
            last = 0
            continue
        if s in to[last] and length[to[last][s]] == length[last] + 1:  # known from an earlier row
            last = to[last][s]
            continue
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, split_last = last, -1
        if s in to[p]:
            q = to[p][s]
            clone = len(to)
            to.append(dict(to[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and to[p].get(s) == q:
                to[p][s] = clone
                p = link[p]
            link[q] = clone
            split_last = clone
        if split_last >= 0:
            to[cur], length[cur], link[cur] = {}, length[split_last], link[split_last]
            last = split_last
            continue
        while p >= 0 and s not in to[p]:
            to[p][s] = cur
            p = link[p]
        if p >= 0:
            q = to[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(s) == q:
                    to[p][s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


class Parser:
    """All languages' automata, states numbered through. The transition of a state by a symbol is at ``base[state] + symbol``, if that
    place belongs to the state (``owner``); else a new phrase starts with the symbol, in the state ``fresh[language, symbol]``. A symbol
    that the language lacks is a phrase of its own, after which its root is entered again."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        lowered = {k: [t.lower() for t in v] for k, v in samples.items()}
        letters = sorted({c for v in lowered.values() for t in v for c in t if c.isalpha() and ord(c) < 0xFFFF})
        self.code = np.zeros(0x10000, np.uint16)
        self.alpha = np.array([chr(i).isalpha() for i in range(0x10000)])
        self.code[self.alpha] = OTHER
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 3
        width = len(letters) + 3
        edges: list[dict[int, int]] = []
        roots, self.bits = [], []
        for k in self.langs:
            train: list[int] = []
            for t in lowered[k]:
                train += [*self.symbols([t])[0].tolist(), -1]
            roots.append(len(edges))
            edges += [{s: n + roots[-1] for s, n in to.items()} for to in suffix_automaton(train)]
            self.bits.append(float(np.log2(max(2, len(train)))))
        self.fresh = np.repeat(np.array(roots, np.int32)[:, None], width, axis=1)
        for i, r in enumerate(roots):
            for s, n in edges[r].items():
                self.fresh[i, s] = n
            edges[r] = {}  # whatever follows a root starts a phrase
        self.roots = np.array(roots, np.int32)
        self.pack(edges, width)

    def pack(self, edges: list[dict[int, int]], width: int) -> None:
        """Lay the rows of transitions over each other so that no two share a place: the fullest first, at the first fit nearby."""
        self.base = np.zeros(len(edges), np.int32)
        taken, low, top = bytearray(sum(map(len, edges)) + 2 * width + 1), width, width
        for i in sorted(range(len(edges)), key=lambda i: -len(edges[i])):
            keys = list(edges[i])
            if not keys:
                continue
            while low < len(taken) and taken[low]:
                low += 1
            at, tries = low - min(keys), 0
            while True:
                need = at + width + 1 - len(taken)
                if need > 0:
                    taken += bytes(need + width)
                if not any([taken[at + s] for s in keys]):
                    break
                at, tries = at + 1, tries + 1
                if tries == TRIES:  # a full region: go on where the last rows lie
                    at = max(at, top - width)
            self.base[i] = at
            for s in keys:
                taken[at + s] = 1
            top = max(top, at + max(keys))
        grow = max(len(taken) + width + 1, int(self.base.max(initial=0)) + width + 1)
        self.owner, self.next = np.full(grow, -1, np.int32), np.zeros(grow, np.int32)
        for i, to in enumerate(edges):
            for s, n in to.items():
                self.owner[self.base[i] + s], self.next[self.base[i] + s] = i, n

    def step(self, state: np.ndarray, lang, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and whether it starts a phrase."""
        at = self.base.take(state)
        at += symbol
        starts = self.owner.take(at) != state
        return np.where(starts, self.fresh[lang, symbol], self.next.take(at)), starts

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased texts: the symbols, with one space for a run of anything but letters; each text's count of them; whether it has a letter."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.code[np.minimum(raw, 0xFFFF)]
        far = np.flatnonzero(raw > 0xFFFF)
        if len(far):
            points, at = np.unique(raw[far], return_inverse=True)
            sym[far] = np.array([OTHER if chr(p).isalpha() else SPACE for p in points], np.uint16)[at]
        start = np.concatenate(([0], np.cumsum(lens)))
        space = sym == SPACE
        drop = space.copy()
        drop[1:] &= space[:-1]
        drop[start[:-1][lens > 0]] = space[start[:-1][lens > 0]]
        kept = np.concatenate(([0], np.cumsum(~drop)))
        letters = np.concatenate(([0], np.cumsum(~space)))
        return sym[~drop], np.diff(kept[start]), np.diff(letters[start]) > 0

    def phrases(self, sym: np.ndarray, lens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that start within each text, by language, when it is entered in the states begin; the states after it."""
        langs = len(self.langs)
        rows = -(-lens // SEGMENT)
        first = np.concatenate(([0], np.cumsum(rows)))
        n = int(first[-1])
        text = np.repeat(np.arange(len(lens)), rows)
        opens = np.zeros(n, bool)
        opens[first[:-1][rows > 0]] = True
        size = np.full(n, SEGMENT)
        size[first[1:][rows > 0] - 1] = (lens[rows > 0] - 1) % SEGMENT + 1
        grid = np.full(n * SEGMENT, PAD, np.int32)
        start = np.concatenate(([0], np.cumsum(lens)))
        grid[np.arange(len(sym)) + np.repeat(first[:-1] * SEGMENT - start[:-1], lens)] = sym
        grid = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        inside = np.arange(SEGMENT)[:, None] < size

        every = np.arange(langs)[:, None]
        enter = np.where(opens, begin[:, text], self.roots[:, None]).astype(np.int32)
        path, count = np.empty((SEGMENT, langs, n), np.int32), np.zeros((langs, n), np.int64)
        begun = np.empty((SEGMENT, langs, n), bool)
        state = enter
        for t in range(SEGMENT):
            state, begun[t] = self.step(state, every, grid[t])
            begun[t] &= inside[t]
            count += begun[t]
            path[t] = state
        # rows after a text's first one, again from where the row before leaves off, until both parses meet
        lang, row = (x.ravel() for x in np.meshgrid(np.arange(langs), np.flatnonzero(~opens), indexing="ij"))
        while len(row):
            came = path[size[row - 1] - 1, lang, row - 1]
            moved = came != enter[lang, row]
            lang, row, state = lang[moved], row[moved], came[moved]
            enter[lang, row] = state
            late_lang, late_row = [], []
            for t in range(SEGMENT):
                live = t < size[row]
                if not live.all():
                    lang, row, state = lang[live], row[live], state[live]
                if not len(row):
                    break
                state, starts = self.step(state, lang, grid[t, row])
                np.add.at(count, (lang, row), starts.astype(np.int64) - begun[t, lang, row])
                begun[t, lang, row] = starts
                apart = path[t, lang, row] != state
                path[t, lang, row] = state
                last = apart & (t == size[row] - 1)
                late_lang.append(lang[last])
                late_row.append(row[last])
                lang, row, state = lang[apart], row[apart], state[apart]
            lang, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (late_lang, late_row))
            follows = row + 1 < n
            lang, row = lang[follows], row[follows] + 1
            lang, row = lang[~opens[row]], row[~opens[row]]
        sums = np.concatenate((np.zeros((langs, 1), np.int64), np.cumsum(count, axis=1)), axis=1)
        after = begin.astype(np.int32)
        full = np.flatnonzero(rows > 0)
        after[:, full] = path[size[first[full + 1] - 1] - 1, :, first[full + 1] - 1].T
        return sums[:, first[1:]] - sums[:, first[:-1]], after

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol by language and text; whether the text has a letter."""
        n, langs = len(texts), len(self.langs)
        phrases, length, letters = np.zeros((langs, n)), np.zeros(n), np.zeros(n, bool)
        state = np.repeat(self.roots[:, None], n, axis=1)

        def take(which: list[int], parts: list[str]) -> None:
            sym, lens, has = self.symbols(parts)
            got, after = self.phrases(sym, lens, state[:, which])
            phrases[:, which] += got
            state[:, which] = after
            length[which] += lens
            letters[which] |= has

        which, parts, held = [], [], 0
        for i, t in enumerate(texts):
            t, s = t.lower(), 0
            while True:
                e = s + SLICE
                while e < len(t) and not t[e].isalpha():  # the next slice starts with a letter, so blanks stay together
                    e += 1
                if which and (s or held + min(e, len(t)) - s > BLOCK // langs):
                    take(which, parts)
                    which, parts, held = [], [], 0
                which.append(i)
                parts.append(t[s:e])
                held += len(parts[-1])
                s = e
                if s >= len(t):
                    break
        if which:
            take(which, parts)
        return phrases * np.array(self.bits).reshape(-1, 1) / np.maximum(length, 1), letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        h, letters = self.entropy(texts)
        best = h.argmin(axis=0)
        rank = np.sort(h, axis=0)
        second = rank[1] if len(self.langs) > 1 else rank[0] * 0 + np.inf
        score = np.where(letters, 1 - rank[0] / np.maximum(rank[0] + np.minimum(second, 1e9), 1e-12), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], score


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Per language, a bounded sample of its labelled rows: of each of SAMPLE_ROWS hash buckets the text of least hash, in its share of symbols."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("bucket")).agg(F.min(F.struct("h", "id")).alias("m")).select("m.h", "m.id", "lang")
    share = F.floor(SAMPLE_SYMBOLS / F.count("*").over(Window.partitionBy("lang")))
    picked = written(picked.withColumn("share", share.cast("int")), "lang-sample")  # its size is known now, so Spark broadcasts it while it is small
    # rows that repeat an id and its text are one before anything is collected
    one = rows.join(picked, [rows["h"] == picked["h"], rows["id"].eqNullSafe(picked["id"]), rows["lang"] == picked["lang"]]).select(rows["lang"], rows["h"], "share", "text").dropDuplicates(["lang", "h"])
    size, n = F.length("text"), F.greatest(F.lit(1), F.floor(F.col("share") / STRETCH)).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", F.floor(i * (size - STRETCH) / F.greatest(F.lit(1), n - 1)).cast("int") + 1, F.lit(STRETCH))), " ")
    got = one.select("lang", "h", F.when(size <= F.col("share"), F.col("text")).otherwise(spread).alias("text")).toPandas()
    got = got.sort_values(["lang", "h", "text"])
    return {k: list(v["text"]) for k, v in got.groupby("lang")}


def predict(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id, the columns in keep, lang_pred, score. Learns from the rows for which learn holds; scores every row by a map."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Parser(sample(docs, learn, id_col, text_col, lang_col)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = model.value
        for b in batches:
            lang, score = parser.predict(list(b.pop("text")))
            yield b.assign(lang_pred=lang, score=score)

    rows = docs.select(F.col(id_col).alias("id"), *keep, text_or_empty(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(run, f"{schema}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 4) == 2
    return predict(table(spark, sf_dir, "documents"), ~held, keep=(held.alias("held_out"),))
