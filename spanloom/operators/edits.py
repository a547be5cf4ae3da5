"""Cutting, joining and moving timed words: parts, cues, consumed matches, replaced phrases, shifted and snapped bounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bucketed
from .scan import scanned
from .steps import written


def pause_split(words: DataFrame, limit: float) -> DataFrame:
    """clip, first, last: parts whose words end within ``limit`` seconds of their start; a part that isn't the last ends at the longest
    pause (the first of equals) in its last fifth. Words are numbered from 1; only a part's words are held."""

    def step(rows: Iterator) -> Iterator[tuple]:
        held: list[tuple[float, float]] = []
        first = 1
        for r in rows:
            held.append((r.st, r.en))
            over = len(held) - 1 if len(held) > 1 and r.en > held[0][0] + limit else None
            while over:
                end = over - 1
                fifth = range(max(0, end - max(1, end // 5)), end)
                end = max(fifth, key=lambda i: held[i + 1][0] - held[i][1], default=end)
                yield first, first + end
                first += end + 1
                del held[: end + 1]
                over = next((i for i in range(1, len(held)) if held[i][1] > held[0][0] + limit), None)
        yield first, first + len(held) - 1

    return scanned(words, ["clip"], ["idx"], step, "clip long, first long, last long")


def sentence_parts(words: DataFrame, most: int, chars: int) -> DataFrame:
    """words with part (from 1) and closed: a part ends with a sentence, or at ``most`` words or ``chars`` characters."""
    names = ["idx", "word", "st", "en"]

    def step(rows: Iterator) -> Iterator[tuple]:
        part, n, size = 1, 0, 0
        for r in rows:
            n, size = n + 1, size + len(r.word) + 1
            shut = r.word.endswith((".", "!", "?")) or n >= most or size > chars
            yield r.idx, r.word, r.st, r.en, part, shut
            if shut:
                part, n, size = part + 1, 0, 0

    return scanned(words.select("clip", *names), ["clip"], ["idx"], step, "clip long, idx long, word string, st double, en double, part long, closed boolean")


CUE = "clip long, cue long, first long, last long, speaker string, st double, en double, n long, chars long"


def cues(words: DataFrame, pause: float = 0.35, width: int = 18, most: int = 3) -> DataFrame:
    """Words packed into cues: a new one at a change of speaker, after a pause, over ``width`` characters or ``most`` words, and after a mark."""

    def step(rows: Iterator) -> Iterator[tuple]:
        cue, held, closed = 0, None, False
        for r in rows:
            if held is None or closed or r.speaker != held[2] or r.st - held[4] > pause or held[6] + 1 + len(r.word) > width or held[5] >= most:
                if held:
                    yield (cue, *held)
                cue, held = cue + 1, (r.idx, r.idx, r.speaker, r.st, r.en, 1, len(r.word))
            else:
                held = (held[0], r.idx, held[2], held[3], r.en, held[5] + 1, held[6] + 1 + len(r.word))
            closed = r.word.endswith((".", "?", "!", ","))
        if held:
            yield (cue, *held)

    return scanned(words.select("clip", "idx", "word", "speaker", "st", "en"), ["clip"], ["idx"], step, CUE)


def without_orphans(cues: DataFrame, pause: float = 0.35, width: int = 25) -> DataFrame:
    """Cues of one word joined to the previous one, and a first one to the next, where voice, pause and width allow."""

    def fits(a: tuple, b: tuple) -> bool:
        return a[3] == b[3] and b[4] - a[5] <= pause and a[7] + 1 + b[7] <= width

    def both(a: tuple, b: tuple) -> tuple:
        return (*a[:2], b[2], *a[3:5], b[5], a[6] + b[6], a[7] + 1 + b[7])

    def step(rows: Iterator) -> Iterator[tuple]:
        head, held = None, None  # head: a first cue of one word, until the next one is whole
        for r in rows:
            c = tuple(r)[1:]
            if held is not None and c[6] == 1 and fits(held, c):
                held = both(held, c)
                continue
            if held is not None:
                if head is not None:
                    if fits(head, held):
                        held = both(head, held)
                    else:
                        yield head
                    head = None
                    yield held
                elif held[0] == first and held[6] == 1:
                    head = held
                else:
                    yield held
            else:
                first = c[0]
            held = c
        if head is not None:
            if fits(head, held):
                held = both(head, held)
            else:
                yield head
        yield held

    return scanned(cues.select("clip", "cue", "first", "last", "speaker", "st", "en", "n", "chars"), ["clip"], ["cue"], step, CUE)


def consumed(points: DataFrame, cues: DataFrame, tol: float) -> DataFrame:
    """clip, cue, point: each cue's first point (t, head) within ``tol`` whose head is one of its words; a point is taken once. A clip's
    points that are still open are held."""
    both = points.select("clip", F.lit(0).alias("kind"), "point", "t", "head").unionByName(cues.select("clip", F.lit(1).alias("kind"), F.col("cue").alias("point"), "t", "head"))

    def step(rows: Iterator) -> Iterator[tuple]:
        opened: dict[int, tuple] = {}
        for r in rows:
            if r.kind == 0:
                opened[r.point] = (r.t, r.head)
                continue
            own = r.head.split(" ")
            hit = next((p for p, (t, head) in opened.items() if abs(r.t - t) <= tol and head in own), None)
            if hit is not None:
                del opened[hit]
                yield r.point, hit

    return scanned(both, ["clip"], ["kind", "point"], step, "clip long, cue long, point long")


def replaced(words: DataFrame, phrase: list[str], by: list[str], single: dict[str, str]) -> DataFrame:
    """clip, idx, i, word, st, en: two words that are ``phrase`` give way to ``by`` (i from 1) in equal steps of their time, the last with the
    phrase's closing mark; elsewhere (i = 0) single words are replaced and keep theirs."""
    w = Window.partitionBy("clip").orderBy("idx")
    bare = F.lower(F.regexp_replace("word", r"^\W+|\W+$", ""))
    t = words.select("clip", "idx", "word", "st", "en", bare.alias("b")).withColumns({"b2": F.lead("b").over(w), "word2": F.lead("word").over(w), "en2": F.lead("en").over(w)})
    t = t.withColumn("hit", F.coalesce((F.col("b") == phrase[0]) & (F.col("b2") == phrase[1]), F.lit(False)))
    t = t.withColumn("eaten", F.coalesce(F.lag("hit").over(w), F.lit(False)))
    n, span = len(by), F.col("en2") - F.col("st")
    mark = F.regexp_extract("word2", "[.,!?;:]$", 0)
    new = F.posexplode(F.array(*[F.lit(x) for x in by])).alias("k", "x")
    long = t.filter("hit").select("clip", "idx", "word2", "st", span.alias("d"), new)
    i = (F.col("k") + 1).cast("long")
    long = long.select("clip", "idx", i.alias("i"), F.concat("x", F.when(i == n, mark).otherwise(F.lit(""))).alias("word"), (F.col("st") + F.col("d") / n * (i - 1)).alias("st"), (F.col("st") + F.col("d") / n * i).alias("en"))
    word = F.col("word")
    for old, other in single.items():
        word = F.when(F.col("b") == old, F.concat(F.lit(other), F.regexp_extract("word", "[.,!?;:]+$", 0))).otherwise(word)
    return long.unionByName(t.filter("not hit and not eaten").select("clip", "idx", F.lit(0).cast("long").alias("i"), word.alias("word"), "st", "en"))


def shifted(words: DataFrame, silences: DataFrame, buffer: float) -> DataFrame:
    """Words that start within a silence (qs, qe) moved by one offset, so that the first of them starts ``buffer`` behind it; silences follow
    each other in time, and a later one sees the words where the earlier ones have put them.

    A silence moves words no further than its own length behind its end, so silences further apart than that can't meet the same word.
    They form groups; the first silences of all groups move their words together, then the second ones, and so on, each round a written table."""
    w = Window.partitionBy("clip").orderBy("qs", "qe")
    reach = F.max(F.col("qe") + buffer + (F.col("qe") - F.col("qs"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    q = silences.filter("qs < qe").withColumn("fresh", F.coalesce((F.col("qs") >= reach).cast("int"), F.lit(1))).withColumn("group", F.sum("fresh").over(w))
    q = written(q.withColumn("turn", F.row_number().over(Window.partitionBy("clip", "group").orderBy("qs", "qe"))).select("clip", "qs", "qe", "turn"), "shift-silences")
    now = words.select("clip", "idx", "st", "en")
    for turn in range(1, (q.agg(F.max("turn")).first()[0] or 0) + 1):
        mine = bucketed(q.filter(F.col("turn") == turn), 3600.0, "qs", "qe").alias("q")
        p = now.withColumn("bucket", F.floor(F.col("st") / 3600.0)).alias("p")
        on = (F.col("p.clip") == F.col("q.clip")) & (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.st") >= F.col("q.qs")) & (F.col("p.st") < F.col("q.qe"))
        inside = p.join(mine, on, "left").select("p.clip", "p.idx", "p.st", "p.en", "q.qs", "q.qe")
        first = F.min("st").over(Window.partitionBy("clip", "qs", "qe"))
        by = F.when(F.col("qs").isNotNull(), F.col("qe") + buffer - F.col("first")).otherwise(0.0)
        now = written(inside.withColumn("first", first).select("clip", "idx", (F.col("st") + by).alias("st"), (F.col("en") + by).alias("en")), "shift-round")
    return now


def snapped(spans: DataFrame, quiet: DataFrame, near: float, early: float, pull: tuple[float, float], late: float, pad: float) -> DataFrame:
    """clip, idx, st, en with bounds at edges of quiet stretches (qs, qe) within ``near``: a start where ``opens`` holds goes to the nearest onset not over
    ``early`` before it, others to the latest onset from ``pull[0]`` before to ``pull[1]`` after; an end goes to the first offset not over ``late`` before it, else to
    the nearest, and then ``pad`` further."""
    r = bucketed(spans.withColumns({"lo": F.col("st") - near, "hi": F.col("en") + near}), 43200.0, "lo", "hi").alias("r")
    q = bucketed(quiet, 43200.0, "qs", "qe").alias("q")
    on = (F.col("r.clip") == F.col("q.clip")) & (F.col("r.bucket") == F.col("q.bucket")) & (F.col("q.qs") <= F.col("r.hi")) & (F.col("q.qe") >= F.col("r.lo"))
    got = r.join(q, on, "left")
    when = lambda cond, c: F.when(cond, F.col(c))
    close = lambda c, at: F.abs(F.col(c) - F.col(at)) <= near
    nearest = lambda c, at, cond: F.min_by(when(cond, c), F.when(cond, F.struct(F.abs(F.col(c) - F.col(at)), F.col(c))))
    edges = got.groupBy("r.clip", "r.idx", "r.st", "r.en", "r.opens").agg(
        nearest("qe", "st", (F.col("qe") >= F.col("st") - early) & close("qe", "st")).alias("forward"),
        F.max(when(F.col("qe").between(F.col("st") - pull[0], F.col("st") + pull[1]), "qe")).alias("back"),
        F.min(when(close("qs", "en") & (F.col("qs") >= F.col("en") - late), "qs")).alias("after"),
        nearest("qs", "en", close("qs", "en")).alias("nearby"),
    )
    start = F.when(F.col("opens"), F.coalesce("forward", "st")).otherwise(F.coalesce("back", "st"))
    return edges.select("clip", "idx", start.alias("st"), (F.coalesce("after", "nearby", "en") + pad).alias("en"))
