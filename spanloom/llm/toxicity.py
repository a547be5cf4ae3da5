"""Toxic spans by a linear-chain conditional random field over words.

Words are runs of letters. A word's features are hashes of itself and of its first 4 to 8 letters, where it has more. Token
labels come from the labelled rows: in a toxic document, the words with a feature that marks toxic documents (``marking``) are
toxic, all other words clean. The field has two states and one chain a text; forward-backward gives each word's marginal. A document's score
is a logistic function of the sum of squared marginals (so that many slight doubts weigh little), its share of the text and the
largest marginal, fitted on the whole texts of labelled rows that the field has not seen. Offending offsets are the runs of words
with a marginal of one half at least.

Training uses a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` of each class, by a hash of the id, and of these the first whose
texts have ``SAMPLE_CHARS`` characters together (a text that alone is longer is passed over); each is learned whole, as one chain. A row
weighs as many labelled rows of its class as it stands for, so that the classes weigh as in all labelled rows. Everything else is a
map over whole texts. For numpy's sake a chain is laid out in rows of ``ROW`` words; messages pass from row to row, and from slice to
slice of a text over ``SLICE`` characters, once forth and once back, so marginals are always those of the whole chain.

Cases: a null or empty text, or one without letters, gets the score of a text without toxic words; without labels of both classes
the score is 0 throughout; labels other than 0 and 1 don't count; texts may be of any length (read in slices); repeated rows are
scored alike; repeated labels count once, a document with conflicting ones is toxic; an empty table gives an empty result; further
columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table, text_or_empty, written

SAMPLE_ROWS = 2500
SAMPLE_CHARS = 9_000_000  # characters of the sampled texts of a class
PREFIXES = (4, 5, 6, 7, 8)
DIMS = 1 << 21
SUPPORT, PURE, EVIDENCE, EVIDENCE_REST = 4, 0.8, 14.0, 7.0
ROW = 64
SLICE = 1 << 19
BLOCK = 1 << 20  # characters of texts handled together
ROUNDS = 40
SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType()), T.StructField("most", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])

_POW = np.cumprod(np.concatenate(([1], np.full(4095, 0x9E3779B97F4A7C15, np.uint64))), dtype=np.uint64)


def lower_same_length(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Words:
    """Letter runs of lower-cased texts: text index, start, end, and a row of feature hashes for each."""

    alpha: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        if Words.alpha is None:
            Words.alpha = np.array([chr(i).isalpha() for i in range(0x10000)])
        n = len(texts)
        lens = np.fromiter(map(len, texts), np.int64, n)
        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = Words.alpha[np.minimum(raw, 0xFFFF)]
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.cumsum(lens + 1) - (lens + 1)
        self.text = np.searchsorted(begins, start, "right") - 1
        self.start, self.end = start - begins[self.text] if n else start, end - begins[self.text] if n else end
        size = end - start
        feats = np.zeros((len(start), 1 + len(PREFIXES)), np.int32)
        if len(start):
            codes = raw[letter].astype(np.uint64)
            at = np.cumsum(size) - size
            pos = np.arange(len(codes)) - np.repeat(at, size)
            mixed = (codes + np.uint64(7)) * _POW[np.minimum(pos, 4095)]
            for k, p in enumerate((0, *PREFIXES)):
                h = np.add.reduceat(np.where(pos < p, mixed, np.uint64(0)) if p else mixed, at)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                feats[:, k] = (h >> np.uint64(43)).astype(np.int32)
                if p:
                    feats[size <= p, k] = DIMS  # no such prefix, or it is the word
        self.feats = feats


def words_of(texts: list[str]) -> Words:
    """The words of any number of texts, hashed a block of characters at a time."""
    done, start = [], 0
    while start < len(texts) or not done:
        end, chars = start, 0
        while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= BLOCK):
            chars += len(texts[end])
            end += 1
        part = Words(texts[start:end])
        part.text = part.text + start
        done.append(part)
        start = end
    out = done[0]
    for name in ("text", "start", "end", "feats"):
        setattr(out, name, np.concatenate([getattr(w, name) for w in done]))
    return out


def grid(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word goes when the words of each chain are laid out in rows of ROW; the chain of each row."""
    count = np.bincount(owner, minlength=n)
    rows = -(-count // ROW)
    first = np.cumsum(rows) - rows
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first * ROW, count), np.repeat(np.arange(n), rows)


class Field:
    """Two-state chain: emission weights (toxic against clean) by feature, and transition weights."""

    def __init__(self):
        self.w = np.zeros(DIMS + 1, np.float32)
        self.bias = -4.0
        self.trans = np.zeros((2, 2))
        self.doc = np.array([-20.0, 0.0, 0.0, 0.0])

    def __getstate__(self):
        """Only the features that occur travel to the workers."""
        have = np.flatnonzero(self.w).astype(np.int32)
        return have, self.w[have], self.bias, self.trans, self.doc

    def __setstate__(self, state):
        have, w, self.bias, self.trans, self.doc = state
        self.w = np.zeros(DIMS + 1, np.float32)
        self.w[have] = w

    def emission(self, feats: np.ndarray) -> np.ndarray:
        out = np.full(len(feats), self.bias, np.float32)
        for k in range(feats.shape[1]):
            out += self.w.take(feats[:, k])
        return out

    def forward_backward(self, u: np.ndarray, owner: np.ndarray, n: int, before: float = np.nan, behind: float = np.nan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of n chains (owner ascending) with emissions u: marginals of the toxic state, and the odds from the left
        (own word included) and from the right (likewise), of which ``pairs`` makes expected transitions. before and behind are these odds of
        the words next to the chains, where the chains are parts of longer ones.

        A message is the odds of the toxic state; a word turns it by a 2 x 2 matrix. The product of a row's matrices passes a
        message over the whole row, so rows of one chain wait for each other only in the short loops over row numbers."""
        (a00, a01), (a10, a11) = np.exp(self.trans)
        place, chain = grid(owner, n)
        rows = len(chain)
        if not rows:
            return np.zeros(0), np.zeros(0), np.zeros(0)
        lay = np.ones(rows * ROW)
        lay[place] = np.exp(np.clip(u, -30, 30).astype(np.float64))
        e = np.ascontiguousarray(lay.reshape(rows, ROW).T)
        opens = np.concatenate(([True], chain[1:] != chain[:-1]))  # a chain's first row
        closes = np.concatenate((opens[1:], [True]))
        starts = opens & np.isnan(before)  # no word before it
        end = 1.0 if np.isnan(behind) else (a11 * behind + a10) / (a01 * behind + a00)  # what a chain's last word gets from its right
        size = np.full(rows, ROW)
        size[closes] = (np.bincount(owner, minlength=n) - 1)[chain[closes]] % ROW + 1
        start = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        number = np.arange(rows) - start
        to_end = np.flatnonzero(closes)[np.cumsum(opens) - 1] - np.arange(rows)

        # messages into each row: over whole rows, as the odds' fractions (p11 o + p01) / (p10 o + p00)
        into, beyond = np.ones(rows), np.ones(rows)
        into[opens & ~starts] = before
        many = np.flatnonzero(~(opens & closes))
        if len(many):
            x, first = e[:, many], starts[many]
            p00, p01, p10, p11 = a00 + 0 * x[0], a01 * x[0], a10 + 0 * x[0], a11 * x[0]
            for p, v in ((p00, 1.0), (p10, 1.0), (p01, x[0]), (p11, x[0])):  # no word before a chain's first one
                p[first] = v[first] if isinstance(v, np.ndarray) else v
            for t in range(1, ROW):
                p00, p01, p10, p11 = p00 * a00 + p01 * a10, (p00 * a01 + p01 * a11) * x[t], p10 * a00 + p11 * a10, (p10 * a01 + p11 * a11) * x[t]
                top = 1 / (p00 + p01 + p10 + p11)
                p00, p01, p10, p11 = p00 * top, p01 * top, p10 * top, p11 * top
            at = np.empty(rows, np.int64)
            at[many] = np.arange(len(many))
            order = np.argsort(number[many], kind="stable")
            cut = np.searchsorted(number[many][order], np.arange(number.max() + 2))
            for k in range(1, number.max() + 1):
                r = many[order[cut[k] : cut[k + 1]]]
                i, o = at[r - 1], into[r - 1]
                into[r] = (o * p11[i] + p01[i]) / (o * p10[i] + p00[i])
            last = size[many] - 1
            ends = closes[many]
            # the same from the right: a row turns what comes from its right into the odds at its first word
            q00, q01, q10, q11 = np.ones(len(many)), np.zeros(len(many)), np.zeros(len(many)), np.ones(len(many))
            for t in range(ROW - 1, -1, -1):
                shut = ends & (t >= last)  # at and after the chain's last word nothing more comes from the right
                q00, q01, q10, q11 = a00 * q00 + a01 * q10, a00 * q01 + a01 * q11, (a10 * q00 + a11 * q10) * x[t], (a10 * q01 + a11 * q11) * x[t]
                q00[shut], q01[shut] = 0.5, 0.5
                q10[shut] = q11[shut] = 0.5 * x[t][shut] * end
                top = 1 / (q00 + q01 + q10 + q11)
                q00, q01, q10, q11 = q00 * top, q01 * top, q10 * top, q11 * top
            order = np.argsort(to_end[many], kind="stable")
            cut = np.searchsorted(to_end[many][order], np.arange(to_end.max() + 2))
            for k in range(1, to_end.max() + 1):
                r = many[order[cut[k] : cut[k + 1]]]
                i, o = at[r + 1], beyond[r + 1]
                beyond[r] = (o * q11[i] + q10[i]) / (o * q01[i] + q00[i])

        left, right = np.empty_like(e), np.empty_like(e)
        o = e[0] * np.where(starts, 1.0, (into * a11 + a01) / (into * a10 + a00))
        left[0] = o
        for t in range(1, ROW):
            o = e[t] * (o * a11 + a01) / (o * a10 + a00)
            left[t] = o
        x = beyond
        for t in range(ROW - 1, -1, -1):
            b = (a11 * x + a10) / (a01 * x + a00)
            b[closes & (t >= size - 1)] = end
            x = e[t] * b
            right[t] = x
        left, right = left.T.ravel()[place], right.T.ravel()[place]
        odds = left * right / lay[place]
        return odds / (1 + odds), left, right

    def pairs(self, left: np.ndarray, right: np.ndarray, inner: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of state pairs over the neighbours (i, i + 1) for i in inner."""
        f, x, a = left[inner], right[inner + 1], np.exp(self.trans)
        p01, p10, p11 = a[0, 1] * x, a[1, 0] * f, a[1, 1] * f * x
        w = weight[inner] / (a[0, 0] + p01 + p10 + p11)
        return np.array([[a[0, 0] * w.sum(), p01 @ w], [p10 @ w, p11 @ w]])

    def fit(self, feats: np.ndarray, label: np.ndarray, owner: np.ndarray, n: int, weight: np.ndarray) -> None:
        """Maximum likelihood with a small ridge, by full-batch adaptive gradient steps; words have the weights of their texts.
        Weights, gradients and their squares are held for the features that occur; feats is renumbered in place."""
        occurs = np.zeros(DIMS + 1, bool)
        for k in range(feats.shape[1]):
            occurs[feats[:, k]] = True
        have = np.flatnonzero(occurs)
        number = np.zeros(DIMS + 1, np.int32)
        number[have] = np.arange(len(have))
        for k in range(feats.shape[1]):
            feats[:, k] = number[feats[:, k]]
        none = number[DIMS] if occurs[DIMS] else -1
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        seen = np.bincount((2 * label[inner] + label[inner + 1]).astype(np.int64), weight[inner], 4).reshape(2, 2)
        del inner
        # whole chains of about BLOCK / 8 words go through the messages together, so that these stay small
        ends = np.cumsum(np.bincount(owner, minlength=n))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(ends // (BLOCK // 8))) + 1, [n])) if n else np.zeros(1, np.int64)
        blocks = [(slice(ends[c - 1] if c else 0, ends[e - 1]), c, e) for c, e in zip(cuts, cuts[1:]) if e > c]
        full, self.w = self.w, np.zeros(len(have), np.float32)
        sq_w, sq_b, sq_t = np.full(len(have), 1e-6), 1e-6, np.full((2, 2), 1e-6)
        for _ in range(ROUNDS):
            gw, gb, gt = -0.02 * self.w.astype(np.float64), 0.0, seen - 0.02 * self.trans
            for at, first, last in blocks:
                own, w, f = owner[at] - first, weight[at], feats[at]
                p, left, right = self.forward_backward(self.emission(f), own, last - first)
                g = w * (label[at] - p)
                for k in range(f.shape[1]):
                    gw += np.bincount(f[:, k], g, len(have))
                gb += g.sum()
                gt -= self.pairs(left, right, np.flatnonzero(own[1:] == own[:-1]), w)
            if none >= 0:
                gw[none] = 0
            sq_w += gw * gw
            self.w += (0.6 * gw / np.sqrt(sq_w)).astype(np.float32)
            sq_b += gb**2
            self.bias += 0.6 * gb / np.sqrt(sq_b)
            sq_t += gt * gt
            self.trans += 0.2 * gt / np.sqrt(sq_t)
        full[have] = self.w
        self.w = full

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text: sum of squared marginals, largest marginal, words; and the offending spans."""
        sums, spans = np.zeros((len(texts), 3)), [[] for _ in texts]
        held, chars = [], 0
        for i, t in enumerate(texts):
            t = lower_same_length(t)
            if len(t) > SLICE:
                self._long(i, t, sums, spans)
                continue
            if held and chars + len(t) > BLOCK:
                self._block(held, sums, spans)
                held, chars = [], 0
            held.append((i, t))
            chars += len(t)
        if held:
            self._block(held, sums, spans)
        return sums, spans

    def _block(self, held: list[tuple[int, str]], sums: np.ndarray, spans: list) -> None:
        words = Words([t for _, t in held])
        if not len(words.text):
            return
        p = self.forward_backward(self.emission(words.feats), words.text, len(held))[0]
        which = np.array([i for i, _ in held])
        own = which[words.text]
        sums[:, 0] += np.bincount(own, p * p, len(sums))
        np.maximum.at(sums[:, 1], own, p)
        sums[:, 2] += np.bincount(own, minlength=len(sums))
        for d, start, end, most in offending(words, p):
            spans[which[d]].append((start, end, most))

    def _long(self, i: int, t: str, sums: np.ndarray, spans: list) -> None:
        """One text in slices that end where no word goes on: odds from the left are handed from slice to slice, then those from the right."""
        cuts = [0]
        while cuts[-1] < len(t):
            e = min(len(t), cuts[-1] + SLICE)
            while e < len(t) and t[e].isalpha():
                e += 1
            cuts.append(e)
        part = lambda k: Words([t[cuts[k] : cuts[k + 1]]])
        before, n = [np.nan], len(cuts) - 1
        for k in range(n - 1):
            words = part(k)
            left = self.forward_backward(self.emission(words.feats), words.text, 1, before[-1])[1]
            before.append(left[-1] if len(left) else before[-1])
        behind, found, open_right = np.nan, [], False
        for k in reversed(range(n)):
            words = part(k)
            p, _, right = self.forward_backward(self.emission(words.feats), words.text, 1, before[k], behind)
            if not len(p):
                continue
            behind = right[0]
            sums[i] += (p @ p, 0, len(p))
            sums[i, 1] = max(sums[i, 1], p.max())
            own = [(a + cuts[k], b + cuts[k], m) for _, a, b, m in offending(words, p)]
            if found and open_right and p[-1] >= 0.5:  # a span that goes on in the slice behind
                (a, _, m), (_, b, m2) = own.pop(), found.pop()
                own.append((a, b, max(m, m2)))
            found += reversed(own)
            open_right = p[0] >= 0.5
        spans[i] += reversed(found)

    @staticmethod
    def summary(sums: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(sums)), np.log1p(20 * sums[:, 0]), sums[:, 1], np.log1p(100 * sums[:, 0] / (sums[:, 2] + 20))], axis=1)

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(sums) @ self.doc, -30, 30)))

    def calibrate(self, sums: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression on the summaries, by Newton steps; with the rows' weights, 1 on average, classes weigh as in all labelled rows."""
        weight = weight * len(weight) / max(weight.sum(), 1e-9)
        x, b = self.summary(sums), np.zeros(4)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
            b += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * b), -5, 5)
        self.doc = b


def offending(words: Words, p: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, start, end, largest marginal) of each run of words with a marginal of one half at least."""
    bad = np.flatnonzero(p >= 0.5)
    if len(bad):
        for k in np.split(bad, np.flatnonzero((np.diff(bad) != 1) | (np.diff(words.text[bad]) != 0)) + 1):
            yield int(words.text[k[0]]), int(words.start[k[0]]), int(words.end[k[-1]]), float(p[k].max())


def marking(words: Words, y: np.ndarray, n: int, clean: float = 1.0) -> np.ndarray:
    """Features that mark toxic documents: their share of toxic documents can't well be chance (EVIDENCE), or they explain toxic
    documents without such a feature (EVIDENCE_REST, taken greedily). Near copies, told by their least word hashes, count once.
    Each clean document weighs ``clean`` and each toxic one 1, so the evidence is that of the toxic documents seen, at the true share."""
    least = np.full((n, 2), DIMS)
    np.minimum.at(least[:, 0], words.text, words.feats[:, 0])
    rest = words.feats[:, 0] != least[words.text, 0]
    np.minimum.at(least[:, 1], words.text[rest], words.feats[rest, 0])
    _, first = np.unique(np.column_stack((least, y)), axis=0, return_index=True)
    single = np.zeros(n, bool)
    single[first] = True
    cuts = np.searchsorted(words.text, np.arange(0, n + 250, 250))  # by whole texts, so blocks share no pair
    pair = np.concatenate([np.unique((words.text[a:b].astype(np.int64)[:, None] * (DIMS + 1) + words.feats[a:b]).ravel()) for a, b in zip(cuts, cuts[1:])])
    doc, feat = pair // (DIMS + 1), pair % (DIMS + 1)
    ok = single[doc] & (feat != DIMS)
    doc, feat = doc[ok], feat[ok]
    pos = np.bincount(feat[y[doc] == 1], minlength=DIMS + 1)
    neg = clean * np.bincount(feat[y[doc] == 0], minlength=DIMS + 1)
    q = min(max(np.average(y[single], weights=np.where(y[single] == 1, 1.0, clean)), 1e-3), 1 - 1e-3)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = pos + neg
        g = np.where(pos > 0, pos * np.log(pos / (m * q)), 0) + np.where(neg > 0, neg * np.log(neg / (m * (1 - q))), 0)
    strong = (pos >= SUPPORT) & (pos > PURE * m)
    marks = strong & (g >= EVIDENCE)
    more = strong & (g >= EVIDENCE_REST)
    while True:
        done = np.zeros(n, bool)
        done[doc[marks[feat]]] = True
        left = (y[doc] == 1) & ~done[doc] & more[feat]
        gain = np.bincount(feat[left], minlength=DIMS + 1)
        if gain.max() < SUPPORT:
            return marks
        marks[gain.argmax()] = True


def train(texts: list[str], toxic: np.ndarray, clean: float = 1.0) -> Field:
    """A field from whole texts, each a chain. A clean text weighs ``clean`` toxic ones."""
    field, n = Field(), len(texts)
    words = words_of([lower_same_length(t) for t in texts])
    words.start = words.end = None
    marks = marking(words, toxic, n, clean)
    bad = toxic[words.text] == 1
    label = bad.copy()
    label[bad] = marks[words.feats[bad]].any(axis=1)
    field.fit(words.feats, label, words.text, n, np.where(bad, 1.0, clean))
    return field


def within(drawn: list) -> list[list]:
    """Ids of the clean and of the toxic rows drawn (id, toxic, h, n), in the order of h: the first whose texts have SAMPLE_CHARS characters."""
    picked: list[list] = [[], []]
    chars = [0, 0]
    for r in sorted(drawn, key=lambda r: (r["h"], r["id"])):
        c = r["toxic"]
        if r["n"] <= SAMPLE_CHARS and chars[c] <= SAMPLE_CHARS:
            chars[c] += r["n"]
            if chars[c] <= SAMPLE_CHARS:
                picked[c].append(r["id"])
    return picked


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """Learn from a bounded sample of the labelled rows for which learn (a condition on the id column) holds: two of every three rows
    of a class train the field, the third calibrates the score."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col("id").cast("string"))
    ids = labels.filter(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().filter("toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = written(ids.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "toxic-labels")
    size = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Field()
    first = [ids.filter(F.col("toxic") == c).orderBy(h, "id").limit(SAMPLE_ROWS) for c in (0, 1)]
    drawn = first[0].unionByName(first[1])
    # of rows that repeat an id the least text, so nothing is collected more than once
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(drawn), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    texts = written(texts, "toxic-sample")
    picked = within(texts.select("id", "toxic", h.alias("h"), F.length("text").alias("n")).collect())
    apart = [p[2::3] or p for p in picked]  # too few to keep any apart: calibrate on the rows that train
    kind = ids.schema["id"].dataType.simpleString()
    part = spark.createDataFrame([(i, k) for c in (0, 1) for k, x in ((0, [i for j, i in enumerate(picked[c]) if j % 3 != 2]), (1, apart[c])) for i in x], f"id {kind}, part int")
    rows = texts.join(F.broadcast(part), "id")
    got = rows.filter("part = 0").select("id", "toxic", "text").toPandas().sort_values("id")
    whole_texts, toxic = list(got.pop("text")), got["toxic"].to_numpy(np.int64)
    del got
    stands = [size[c] / max(1, len(picked[c])) for c in (0, 1)]
    field = train(whole_texts, toxic, stands[0] / stands[1])
    del whole_texts
    model = spark.sparkContext.broadcast(field)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums, _ = model.value.tag(list(b["text"]))
            yield b[["id", "toxic"]].assign(a=sums[:, 0], b=sums[:, 1], c=sums[:, 2])

    held = rows.filter("part = 1").mapInPandas(whole, f"id {kind}, toxic int, a double, b double, c double").toPandas().sort_values("id")
    y = held["toxic"].to_numpy(np.int64)
    field.calibrate(held[["a", "b", "c"]].to_numpy(np.float64), y, np.where(y == 1, stands[1], stands[0]))
    return field


def scorer(spark: SparkSession, field: Field):
    """A column function: text -> struct(score, expected, most, spans)."""
    model = spark.sparkContext.broadcast(field)

    @F.pandas_udf(SCHEMA)
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = model.value
        for b in texts:
            sums, spans = f.tag([x or "" for x in b])
            yield pd.DataFrame({"score": f.score(sums), "expected": sums[:, 0], "most": sums[:, 1], "spans": [[{"start": a, "end": e, "score": s} for a, e, s in x] for x in spans]})

    return toxicity


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"), ~held)
    got = docs.select("doc_id", held.alias("held_out"), scorer(spark, field)(text_or_empty()).alias("t"))
    return got.select("doc_id", "held_out", "t.score", (F.col("t.score") >= 0.7).cast("int").alias("predicted"), F.size("t.spans").cast("long").alias("n_spans"), "t.spans")
