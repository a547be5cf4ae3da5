"""Writers: subtitles, reports, keyed upsert, exclusive and versioned outputs."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import timecode as tc
from spanloom.operators.tables import upserted


def srt_blocks(cues: DataFrame, keys: list[str]) -> DataFrame:
    """keys and body: numbered SubRip blocks of each clip, in order of start. A clip's cues make one file, so they meet in one row."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("st", "en", "text"))
    block = F.concat(n.cast("string"), F.lit("\n"), tc.cue_time(F.col("st"), True), F.lit(" --> "), tc.cue_time(F.col("en"), True), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = cues.select(*keys, n.alias("n"), block.alias("block"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("body"))


def ass_lines(cues: DataFrame, keys: list[str], colours: dict[str, str]) -> DataFrame:
    """keys and body: dialogue lines of each clip in order of start, coloured by speaker (rgb by name)."""
    bgr = F.create_map(*[F.lit(x) for name, rgb in colours.items() for x in (name, rgb[4:6] + rgb[2:4] + rgb[0:2])])
    tag = F.concat(F.lit("{\\1c&H"), F.coalesce(F.try_element_at(bgr, F.col("speaker")), F.lit("FFFFFF")), F.lit("&}"))
    line = F.concat(F.lit("Dialogue: 0,"), tc.cue_time(F.col("st")), F.lit(","), tc.cue_time(F.col("en")), F.lit(",Main,,0,0,0,,"), tag, F.col("text"))
    return cues.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("st", "en", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


def write_srt(cues: DataFrame, path: str, keys: list[str]) -> None:
    """One folder a clip, partitioned by its keys."""
    srt_blocks(cues, keys).write.partitionBy(*keys).mode("errorifexists").text(path)


def report(checks: DataFrame, category: str, status: str, summary: str) -> DataFrame:
    """category, passed, warned, failed, verdict, body: a check list as Markdown lines, one row a category."""
    line = F.concat(F.lit("- "), F.col(status), F.lit(": "), F.col(summary))
    n = lambda s: F.count_if(F.col(status) == s)
    return checks.groupBy(category).agg(n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), F.when(n("fail") > 0, "REVISE").otherwise("APPROVE").alias("verdict"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))


def write_new(df: DataFrame, path: str) -> None:
    """Never overwrites."""
    df.write.mode("errorifexists").parquet(path)


PARTS = 256  # key-hash parts of an upserted table
KEPT = 3  # manifests, and what they name, that a clean-up leaves
TRIES = 5  # times a write starts anew because another one came first


class Lost(Exception):
    """Another writer has committed this version."""


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], dry_run: bool = True, batch: int | None = None) -> DataFrame:
    """The table at path with new's rows in place of those of the same keys.

    Rows lie in ``PARTS`` parts by a hash of their keys. A write makes new folders of the parts that it touches alone, each part whole and in
    one file, and then commits a manifest that names the live folder of every part: a small file, put in place by a rename that fails if another
    writer was first, in which case the write starts anew. Readers follow the newest manifest alone, however many writes there were; a lost
    writer leaves a folder that no manifest names. Each write removes what only manifests older than the last ``KEPT`` name. Batches
    have rising numbers; one that isn't above the last committed one is not written again."""
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    add = new.dropDuplicates(keys).withColumn("_part", part)
    touched = [r["_part"] for r in add.select("_part").distinct().collect()]  # PARTS numbers at most
    for _ in range(TRIES):
        live = manifest(spark, path)
        if batch is not None and not dry_run and live["batch"] is not None and batch <= live["batch"]:
            break
        old = table_at(spark, path, live, touched)
        merged = upserted(old, add.drop("_part"), keys) if old is not None else add.drop("_part")
        if dry_run:
            rest = table_at(spark, path, live, [p for p in range(PARTS) if p not in touched])
            return merged if rest is None else merged.unionByName(rest, allowMissingColumns=True)
        version = live["version"] + 1
        name = f"v{version}" if not _exists(spark, f"{path}/v{version}") else f"v{version}-{uuid.uuid4().hex}"  # a lost writer's folder may be there
        merged.withColumn("_part", part).repartition("_part").write.partitionBy("_part").mode("errorifexists").parquet(f"{path}/{name}")
        parts = live["parts"] | {str(p): name for p in touched}
        try:
            commit(spark, path, {"version": version, "batch": live["batch"] if batch is None else batch, "parts": parts})
        except Lost:
            continue
        clean(spark, path)
        break
    else:
        raise Lost(f"{path}: {TRIES} other writers came first")
    return table_at(spark, path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/_manifest") if re.fullmatch(r"[0-9]+[.]json", n))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, the last batch, and the live folder of each part; of a table that isn't there, version 0."""
    have = [version] if version is not None else _manifests(spark, path)[-1:]
    if not have:
        return {"version": 0, "batch": None, "parts": {}}
    p, fs = _path(spark, f"{path}/_manifest/{have[0]}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, content: dict) -> None:
    """Put a manifest in place, whole or not at all; Lost if its version is there already."""
    jvm = spark.sparkContext._jvm
    src, fs = _path(spark, f"{path}/_manifest/.{uuid.uuid4().hex}")
    dst, _ = _path(spark, f"{path}/_manifest/{content['version']}.json")
    out = fs.create(src, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(src), fs.makeQualified(dst), how)
    except Exception as e:
        fs.delete(src, False)
        if fs.exists(dst):
            raise Lost(str(dst)) from e
        raise


def clean(spark: SparkSession, path: str) -> None:
    """Remove manifests older than the last KEPT, and folders of versions before those that no kept manifest names; what a running writer makes is newer."""
    have = _manifests(spark, path)
    kept = have[-KEPT:]
    if kept == have:
        return
    named = {f for v in kept for f in manifest(spark, path, v)["parts"].values()}
    for n in _names(spark, path):
        m = re.fullmatch(r"v([0-9]+)(-[0-9a-f]+)?", n)
        if m and int(m[1]) < kept[0] and n not in named:
            p, fs = _path(spark, f"{path}/{n}")
            fs.delete(p, True)
    for v in have[:-KEPT]:
        p, fs = _path(spark, f"{path}/_manifest/{v}.json")
        fs.delete(p, False)


def table_at(spark: SparkSession, path: str, live: dict | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The table's rows by its newest manifest (or a given one), of some parts or all; None if there are none."""
    live = manifest(spark, path) if live is None else live
    chosen = [f"{path}/{name}/_part={p}" for p, name in sorted(live["parts"].items()) if parts is None or int(p) in parts]
    return spark.read.option("mergeSchema", "true").parquet(*chosen) if chosen else None


def latest_version(spark: SparkSession, path: str) -> int:
    """The largest N of the folders v<N> that hold a finished write; 0 if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath() for s in fs.listStatus(root)]
    return max((int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=0)


def contract(declared: Column, observed: Column) -> Column:
    """Declared fields beside observed ones, as JSON."""
    return F.to_json(F.struct(declared.alias("declared"), observed.alias("observed")))


def log_rows(rows: DataFrame, path: str, stage: str) -> None:
    """Appends rows to a JSON log, each with the time and the stage that wrote it."""
    rows.withColumns({"ts": F.unix_timestamp().cast("double"), "stage": F.lit(stage)}).write.mode("append").json(path)
