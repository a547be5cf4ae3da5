"""Readers of transcripts, subtitles, logs and listings. All are Spark reads followed by DataFrame functions; a file is one row only
where its format needs the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import timecode as tc

WORD = "struct<word:string,text:string,start:double,`end`:double,speaker:string,confidence:double>"
WORDS_JSON = f"words array<{WORD}>, segments array<struct<start:double,`end`:double,text:string,speaker:string,words:array<{WORD}>>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, word, st, en, speaker of JSON transcripts: a bare list (kept as it is), {words: []} or {segments: [{words: []}]}.

    In the nested shapes words without a start are dropped, a missing end is the start, and the text may be under either name."""
    raw = _whole(spark, path)
    bare = F.from_json("body", f"array<{WORD}>")
    flat = raw.filter(F.ltrim("body").startswith("[")).select("file", F.posexplode(bare).alias("idx", "w")).select("file", "idx", F.coalesce("w.word", "w.text").alias("word"), F.col("w.start").alias("st"), F.col("w.end").alias("en"), F.col("w.speaker").alias("speaker"))
    doc = raw.filter(F.ltrim("body").startswith("{")).select("file", F.from_json("body", WORDS_JSON).alias("j"))
    nested = F.flatten(F.transform("j.segments", lambda s: F.coalesce(s["words"], F.array().cast(f"array<{WORD}>"))))
    deep = doc.select("file", F.posexplode(F.coalesce(F.when(F.size("j.segments") > 0, nested), F.col("j.words"))).alias("idx", "w")).filter("w.start is not null")
    deep = deep.select("file", "idx", F.trim(F.coalesce("w.word", "w.text")).alias("word"), F.col("w.start").alias("st"), F.coalesce("w.end", "w.start").alias("en"), F.col("w.speaker").alias("speaker"))
    return flat.unionByName(deep)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, st, en, text, speaker, words (nested) of {segments: []} transcripts."""
    j = _whole(spark, path).select("file", F.from_json("body", WORDS_JSON).alias("j"))
    return j.select("file", F.posexplode("j.segments").alias("idx", "s")).select("file", "idx", F.col("s.start").alias("st"), F.col("s.end").alias("en"), "s.text", "s.speaker", "s.words")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, st, en, text of transcripts in lines: segments of a JSON file, its text as one line where it has none, or the lines of a plain
    file, blank ones dropped."""
    raw = _whole(spark, path)
    json = F.ltrim("body").startswith("{")
    j = raw.filter(json).select("file", F.from_json("body", f"segments array<struct<start:double,`end`:double,text:string>>, transcript array<struct<start:double,`end`:double,text:string>>, text string").alias("j"))
    rows = F.coalesce(F.when(F.size("j.segments") > 0, F.col("j.segments")), F.when(F.size("j.transcript") > 0, F.col("j.transcript")), F.array(F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.col("j.text").alias("text"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    deep = j.select("file", F.posexplode(rows).alias("idx", "s")).filter("s.text is not null").select("file", "idx", zero(F.col("s.start")).alias("st"), zero(F.col("s.end")).alias("en"), F.trim("s.text").alias("text"))
    kept = F.filter(F.transform(F.split("body", "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    flat = raw.filter(~json).select("file", F.posexplode(kept).alias("idx", "text")).select("file", "idx", F.lit(0.0).alias("st"), F.lit(0.0).alias("en"), "text")
    return deep.unionByName(flat)


def timestamped(lines: DataFrame, key: str = "file") -> DataFrame:
    """key, text: a file's lines as one text, ``[MM:SS-MM:SS] text`` each; lines without times as they are."""
    timed = F.concat(F.lit("["), tc.clock("st"), F.lit("-"), tc.clock("en"), F.lit("] "), "text")
    line = F.when((F.col("st") == 0) & (F.col("en") == 0), F.col("text")).otherwise(timed)
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def read_chunk_specs(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, slug, in_s, out_s of cut specifications; a missing slug becomes clip_<i>."""
    item = "struct<slug:string,`in`:double,`out`:double>"
    j = _whole(spark, path).select("file", F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{item}>")).otherwise(F.coalesce(*[F.from_json("body", f"{k} array<{item}>")[k] for k in ("chunks", "segments", "clips")])).alias("c"))
    return j.select("file", F.posexplode("c").alias("idx", "c")).select("file", "idx", F.coalesce("c.slug", F.concat(F.lit("clip_"), F.col("idx").cast("string"))).alias("slug"), F.col("c.in").alias("in_s"), F.col("c.out").alias("out_s"))


def provider_words(df: DataFrame) -> DataFrame:
    """A provider's words in whole milliseconds as words in seconds."""
    return df.select(*[c for c in df.columns if c not in ("start", "end", "text")], F.col("text").alias("word"), (F.col("start") / 1000.0).alias("st"), (F.col("end") / 1000.0).alias("en"))


def evidence(words: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """keys, n, status: FULL where a provider's words reach the expected end of the recording, PARTIAL where they stop short or have no times."""
    end = F.max("en")
    full = (end >= F.first(expected) - 1.0) & (F.count_if(F.col("st").isNull()) == 0)
    return words.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.coalesce(full, F.lit(False)), "FULL").otherwise("PARTIAL").alias("status"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, st, en, text of SubRip files, tags stripped."""
    blocks = _whole(spark, path).select("file", F.posexplode(F.split(F.trim(F.regexp_replace("body", "\r\n?", "\n")), r"\n\s*\n")).alias("idx", "b"))
    line = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)[^\n]*\n?([\s\S]*)"
    part = lambda i: F.regexp_extract("b", line, i)
    return blocks.filter(F.col("b").rlike("-->")).select("file", "idx", tc.seconds(part(1)).alias("st"), tc.seconds(part(2)).alias("en"), F.trim(F.regexp_replace(F.regexp_replace(part(3), "<[^>]*>", ""), r"\s*\n\s*", " ")).alias("text"))


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, st, en, style, text, colour, is_shadow, anchor_y of Advanced SubStation files. Fields lie where the section's Format line has them,
    the last of which may hold commas; colours come from inline overrides, else from the style."""
    body = _whole(spark, path)
    names = lambda section: F.transform(F.split(F.regexp_extract("body", rf"(?s)\[{section}\].*?Format:\s*([^\r\n]*)", 1), ","), lambda x: F.lower(F.trim(x)))
    lines = body.select("file", names("V4\\+ Styles").alias("sf"), names("Events").alias("ef"), F.posexplode(F.split("body", "\r\n|\r|\n")).alias("idx", "line"))
    # a field's place is that of its name in the section's Format line, or the usual one
    place = lambda fmt, name, usual: F.when(F.array_contains(fmt, name), F.array_position(fmt, name).cast("int") - 1).otherwise(usual)
    field = lambda fmt, name, usual: F.trim(F.get("f", place(fmt, name, usual)))
    style = lines.filter(F.col("line").startswith("Style:")).withColumn("f", F.split(F.regexp_replace("line", r"^Style:\s*", ""), ",")).select("file", field("sf", "name", 0).alias("style"), field("sf", "primarycolour", 3).alias("primary"))
    n = F.when(F.size("ef") > 1, F.size("ef")).otherwise(10)
    d = lines.filter(F.col("line").startswith("Dialogue:")).withColumn("parts", F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",")).withColumn("n", n).filter("size(parts) >= n")
    d = d.withColumn("f", F.concat(F.slice("parts", F.lit(1), F.col("n") - 1), F.array(F.array_join(F.slice("parts", F.col("n"), F.size("parts")), ","))))  # the last field may hold commas
    d = d.select("file", "idx", tc.seconds(field("ef", "start", 1)).alias("st"), tc.seconds(field("ef", "end", 2)).alias("en"), field("ef", "style", 3).alias("style"), F.get("f", F.col("n") - 1).alias("raw"))
    inline = F.regexp_extract_all("raw", F.lit(r"\\1?c&H([0-9A-Fa-f]+)&"), F.lit(1))
    j = d.join(style.dropDuplicates(["file", "style"]), ["file", "style"], "left").withColumn("inline", inline)
    seen = F.coalesce(F.try_element_at(F.filter("inline", lambda c: tc.rgb(c) != "000000"), F.lit(1)), F.col("primary"))
    shadow = F.lower("style").contains("shadow") | ((F.size("inline") > 0) & F.forall("inline", lambda c: tc.rgb(c) == "000000"))
    y = F.coalesce(F.nullif(F.regexp_extract("raw", r"\\move\([^,]*,[^,]*,[^,]*,\s*([\d.]+)", 1), F.lit("")), F.nullif(F.regexp_extract("raw", r"\\pos\([^,]*,\s*([\d.]+)", 1), F.lit("")))
    return j.select("file", "idx", "st", "en", "style", tx.without_cue_tags("raw").alias("text"), tc.rgb(seen).alias("colour"), shadow.alias("is_shadow"), y.try_cast("double").alias("anchor_y"))


def cue_runs(cues: DataFrame, text: str = "raw") -> DataFrame:
    """A row for each inline run {tags}words of a cue: word, bold, italic, rgb."""
    runs = F.regexp_extract_all(text, F.lit(r"(\{[^}]*\})?[^{]+"), F.lit(0))
    r = cues.select(*[c for c in cues.columns if c != text], F.posexplode(runs).alias("run", "r"))
    colour = F.regexp_extract("r", r"\\1?c&H([0-9A-Fa-f]+)&", 1)
    return r.select(*[c for c in r.columns if c != "r"], tx.without_cue_tags("r").alias("word"), F.col("r").rlike(r"\\b1").alias("bold"), F.col("r").rlike(r"\\i1").alias("italic"), F.when(colour != "", tc.rgb(colour)).alias("rgb"))


def read_caption_text(spark: SparkSession, path: str) -> DataFrame:
    """file, text of VTT, SRT or plain files: headers, numbers, times and blank lines dropped, lines joined by blanks."""
    lines = F.transform(F.split("body", "\r\n|\r|\n"), lambda x: F.trim(x))
    keep = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$|-->|^(WEBVTT|Kind:|Language:)"))
    return _whole(spark, path).select("file", F.array_join(keep, " ").alias("text"))


def read_json3(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, st, en, text of timed caption events in milliseconds with text segments."""
    shape = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"
    e = _whole(spark, path).select("file", F.posexplode(F.from_json("body", shape)["events"]).alias("idx", "e")).filter("e.segs is not null")
    text = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " "))
    return e.select("file", "idx", (F.col("e.tStartMs") / 1000).alias("st"), ((F.col("e.tStartMs") + F.coalesce("e.dDurationMs", F.lit(0.0))) / 1000).alias("en"), text.alias("text")).filter("text <> ''")


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, st, en, word of the words tier of forced alignments; blank intervals dropped."""
    tier = F.regexp_extract("body", r'name = "words"([\s\S]*?)(?:item \[|$)', 1)
    rows = F.regexp_extract_all(tier, F.lit(r'xmin = [\d.]+\s*xmax = [\d.]+\s*text = "[^"]*"'), F.lit(0))
    r = _whole(spark, path).select("file", F.posexplode(rows).alias("idx", "r"))
    part = lambda k: F.regexp_extract("r", k, 1)
    return r.select("file", "idx", part(r"xmin = ([\d.]+)").try_cast("double").alias("st"), part(r"xmax = ([\d.]+)").try_cast("double").alias("en"), F.trim(part(r'text = "([^"]*)"')).alias("word")).filter("word <> ''")


def read_log(spark: SparkSession, path: str, schema: str, since: float = 0.0) -> DataFrame:
    """JSON lines; malformed ones are skipped and those before ``since`` dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("ts") >= since)


def find_column(headers: list[str], *needles: str) -> str | None:
    """The first header that contains all needles, whatever the case."""
    return next((h for h in headers if all(n.lower() in h.lower() for n in needles)), None)


def read_studio_csv(spark: SparkSession, path: str) -> DataFrame:
    """video_id, title columns found by what their headers contain; totals and other ids dropped; subscribers a thousand views."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    number = lambda h: F.regexp_replace(F.col(f"`{h}`"), r"[^0-9.\-]", "").try_cast("double") if h else F.lit(None).cast("double")
    ident, views, subs = find_column(raw.columns, "content"), find_column(raw.columns, "views"), find_column(raw.columns, "subscribers")
    ctr, money, length = find_column(raw.columns, "impressions", "click"), find_column(raw.columns, "revenue"), find_column(raw.columns, "average", "duration")
    held = tc.seconds(F.col(f"`{length}`")) if length else F.lit(None).cast("double")
    out = raw.select(F.col(f"`{ident}`").alias("video_id"), number(views).alias("views"), number(subs).alias("subs"), number(ctr).alias("ctr"), number(money).alias("revenue"), held.alias("view_s"))
    return out.filter(F.col("video_id").rlike("^[A-Za-z0-9_-]{11}$")).withColumn("subs_per_1k", F.round(F.try_divide("subs", "views") * 1000, 2))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """term, tokens of list files: comments and blank lines dropped, the first field of each line."""
    t = spark.read.text(path).select(F.trim(F.element_at(F.split("value", r"[|\t]"), 1)).alias("term"))
    return t.filter((F.col("term") != "") & ~F.col("term").rlike("^(#|//)")).select("term", tx.tokens("term").alias("tokens"))


def read_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, ext, length, modified of files; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", "modified")


def eligible(listing: DataFrame, posted: DataFrame, exts: list[str], least: int = 1) -> DataFrame:
    """A listing with why each file is left out: its extension, its size, or that it is in ``posted`` (name); ``ok`` otherwise. (Spark's listing leaves out empty files itself.)"""
    known = posted.select("name", F.lit(True).alias("posted")).distinct()
    reason = F.when(~F.col("ext").isin(exts), "extension").when(F.col("length") < least, "small").when(F.col("posted"), "posted").otherwise("ok")
    return listing.join(known, "name", "left").withColumn("reason", reason).drop("posted")


def pools(listing: DataFrame) -> DataFrame:
    """category, names: the files of each folder, sorted by name; one row a folder."""
    return listing.groupBy(F.element_at(F.split("path", "/"), -2).alias("category")).agg(F.array_sort(F.collect_list("name")).alias("names"))


BROADCAST_ROWS = 1_000_000  # folders up to which a counted list is broadcast; beyond, a shuffled join


def contracts(clips: DataFrame, listing: DataFrame, name: str, up: int = 4) -> DataFrame:
    """clips (path) with the contract file of that name next to each or in the nearest of up to ``up`` folders above it; null without one."""
    folder = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    there = listing.filter(F.col("name") == name).select(folder(F.col("path")).alias("dir"), F.col("path").alias("contract"))
    steps, d = [], F.col("own")
    for i in range(up + 1):
        steps.append(F.struct(F.lit(i).alias("up"), d.alias("dir")))
        d = folder(d)
    # folders are looked up once each, however many files they hold; the files meet them by broadcast where they are counted to be few
    own = clips.select(folder(F.col("path")).alias("own")).distinct()
    each = own.select("own", F.explode(F.array(*steps)).alias("s")).select("own", "s.up", "s.dir").join(there, "dir")
    near = each.groupBy("own").agg(F.min_by("contract", "up").alias("contract"))
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    return clips.withColumn("own", folder(F.col("path"))).join(near, "own", "left").select(*[F.col(c) for c in clips.columns], "contract")


def newest(listing: DataFrame, *keys: str) -> DataFrame:
    """The newest file of each key (of all without keys)."""
    return listing.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def paired_times(lines: DataFrame, start: str, end: str, group: list[str], order: str, line: str = "value") -> DataFrame:
    """st, en of a tool's log: the i-th start mark with the i-th end mark; unmatched ones dropped."""
    from pyspark.sql import Window

    def marks(word: str, name: str) -> DataFrame:
        t = F.regexp_extract(line, word + r"[:=]\s*(-?[\d.]+)", 1).try_cast("double")
        hit = lines.select(*group, order, t.alias(name)).filter(F.col(name).isNotNull())
        return hit.select(*group, name, F.row_number().over(Window.partitionBy(*group).orderBy(order)).alias("i"))

    return marks(start, "st").join(marks(end, "en"), [*group, "i"]).select(*group, "st", "en")


def marked_times(lines: DataFrame, mark: str, group: list[str], line: str = "value") -> DataFrame:
    """t of every mark such as ``pts_time:12.3`` in a tool's log."""
    t = F.regexp_extract(line, mark + r"[:=]\s*(-?[\d.]+)", 1).try_cast("double")
    return lines.select(*group, t.alias("t")).filter("t is not null")


def probe(df: DataFrame, col: str = "body") -> DataFrame:
    """Typed fields of a media probe's JSON; a frame rate num/den is divided and rounded to three places."""
    shape = "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string>>, format struct<duration:string,size:string>"
    j = df.select(*[c for c in df.columns if c != col], F.from_json(col, shape).alias("j"))
    v = F.try_element_at(F.filter("j.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    rate = F.split(v["r_frame_rate"], "/")
    fps = F.round(F.try_divide(F.try_element_at(rate, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(rate, F.lit(2)).try_cast("double"), F.lit(1.0))), 3)
    audio = F.exists("j.streams", lambda s: s["codec_type"] == "audio")
    return j.select(*[c for c in j.columns if c != "j"], v["width"].alias("width"), v["height"].alias("height"), fps.alias("fps"), F.col("j.format.duration").try_cast("double").alias("duration"), audio.alias("has_audio"))


def pcm(df: DataFrame, samples: Column, rate: int, start: float = 0.0, length: float | None = None) -> DataFrame:
    """A long table (i, t, v) of sample arrays, from a start in seconds and of a length; only that window is taken apart."""
    first = int(start * rate)
    n = F.size(samples) if length is None else F.lit(int(length * rate))
    window = F.when(F.size(samples) > first, F.slice(samples, F.lit(first + 1), n))
    return df.select(*df.columns, F.posexplode(window).alias("i", "v")).withColumn("i", F.col("i") + first).withColumn("t", F.col("i") / rate)
