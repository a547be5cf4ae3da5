"""Hand-made rows for what SQL doesn't cover: readers, sinks, folds, streaming."""

from pyspark.sql import functions as F

from spanloom.functions import timecode as tc
from spanloom.operators import intervals as iv
from spanloom.operators import sequence as sq
from spanloom.sources import readers as rd
from spanloom.sources import sinks as sk
from spanloom.streaming import spans as st


def spans_of(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "clip long, idx long, st double, en double")


def pairs(df):
    return sorted((round(r["st"], 6), round(r["en"], 6)) for r in df.collect())


def test_interval_golden_rows(spark):
    a, b = spans_of(spark, [(0, 2), (5, 9)]), spans_of(spark, [(1, 6)])
    assert pairs(iv.intersect(a, b, 2.0)) == [(1, 2), (5, 6)]
    assert pairs(iv.merge_close(spans_of(spark, [(0, 1), (1.1, 2), (2.3, 3)]), 0.15)) == [(0, 2), (2.3, 3)]
    scope = spark.createDataFrame([(1, 0.0, 10.0)], "clip long, lo double, hi double")
    assert pairs(iv.complement(spans_of(spark, [(1, 2), (1.5, 3), (9.99, 12)]), scope, 0.02)) == [(0, 1), (3, 9.99)]
    plan = iv.intersect(a, b, 2.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sessions(spark):
    got = sq.sessions(spans_of(spark, [(0, 0.5), (0.6, 1.0), (1.9, 2.1)]), 0.8).orderBy("idx").collect()
    assert [r["session"] for r in got] == [1, 1, 2]


def test_scalar_golden_rows(spark):
    one = spark.range(1)
    assert [one.select(tc.money(F.lit(v).cast("bigint"))).first()[0] for v in (999, 1500, 20000, 1200000)] == ["$999", "$1,500", "$20K", "$1.2M"]
    assert [one.select(tc.duration_score(F.lit(v).cast("double"))).first()[0] for v in (None, 60, 90, 180, 900)] == [0.7, 0.3, 0.5, 1.0, 0.7]
    c = one.select(tc.rgb(F.lit("&H0000CBFE&")).alias("c"))
    assert c.first()[0] == "FECB00" and c.select(tc.colour_name(F.col("c"))).first()[0] == "yellow"
    assert [one.select(tc.tempo(F.lit(v).cast("double"))).first()[0] for v in (130, 0, 120)] == [65.0, 92.0, 120.0]
    assert one.select(tc.seconds(F.lit("01:05")), tc.seconds(F.lit("42")), tc.seconds(F.lit("x"))).first()[:] == (65.0, 42.0, None)
    assert one.select(tc.cue_time(F.lit(59.999)), tc.cue_time(F.lit(3661.5), True)).first()[:] == ("0:01:00.00", "01:01:01,500")


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": [{"start": 0, "end": 2, "text": "a b", "words": [{"word": " a ", "start": 0.1}, {"text": "b", "start": 0.5, "end": 0.9}, {"word": "x"}]}]}')
    (tmp_path / "b.json").write_text('[{"word": "c", "start": 1, "end": 2}, {"word": "d"}]')
    got = sorted((r["word"], r["st"], r["en"]) for r in rd.read_words(spark, f"{tmp_path}/a.json").collect())
    assert got == [("a", 0.1, 0.1), ("b", 0.5, 0.9)]
    assert rd.read_words(spark, f"{tmp_path}/b.json").count() == 2
    (tmp_path / "c.json").write_text('{"clips": [{"slug": "s", "in": 1, "out": 2}, {"in": 3, "out": 4}]}')
    assert [r["slug"] for r in rd.read_chunk_specs(spark, f"{tmp_path}/c.json").orderBy("idx").collect()] == ["s", "clip_1"]
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i>\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")
    assert [(r["st"], r["en"], r["text"]) for r in rd.read_srt(spark, f"{tmp_path}/a.srt").orderBy("idx").collect()] == [(1.0, 2.5, "Hi there"), (3.0, 4.0, "Bye")]
    assert rd.read_caption_text(spark, f"{tmp_path}/a.srt").first()["text"] == "<i>Hi</i> there Bye"
    (tmp_path / "a.ass").write_text("[V4+ Styles]\nStyle: Main,Arial,60,&H00FFFFFF,&H0\n[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Main,,0,0,0,,{\\pos(10,900)\\c&H00CBFE&}Hello, you\n")
    r = rd.read_ass(spark, f"{tmp_path}/a.ass").first()
    assert (r["st"], r["text"], r["colour"], r["is_shadow"], r["anchor_y"]) == (1.0, "Hello, you", "FECB00", False, 900.0)
    (tmp_path / "s.csv").write_text("Content,Views,Subscribers\nabcdefghijk,\"1,000\",5\nTotal,9,9\n")
    assert rd.read_studio_csv(spark, f"{tmp_path}/s.csv").first()["subs_per_1k"] == 5.0
    log = spark.createDataFrame([(1, 0, "silence_start: 1.5"), (1, 1, "silence_end: 2.5"), (1, 2, "silence_start: 9")], "clip long, i long, value string")
    assert rd.paired_times(log, "silence_start", "silence_end", ["clip"], "i").collect()[0][:] == (1, 1.5, 2.5)
    p = spark.createDataFrame([('{"streams": [{"codec_type": "video", "width": 4, "height": 2, "r_frame_rate": "30000/1001"}], "format": {"duration": "1.5"}}',)], "body string")
    assert rd.probe(p).first()[:] == (4, 2, 29.97, 1.5, False)


def test_upsert_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    sk.upsert(spark, a, path, ["k"], dry_run=False)
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    want = [(1, "a"), (2, "B"), (3, "c")]
    assert sorted((r["k"], r["v"]) for r in sk.upsert(spark, new, path, ["k"]).collect()) == want  # tried without writing
    assert sk.latest_version(spark, path) == 1
    got = sk.upsert(spark, new, path, ["k"], dry_run=False)
    assert sorted((r["k"], r["v"]) for r in got.collect()) == want
    assert sk.latest_version(spark, path) == 2
    parts = {p.name for p in (tmp_path / "t" / "v2").iterdir() if p.name.startswith("_part=")}
    assert 1 <= len(parts) <= 2  # only what the new rows touch


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge = st.upserting(path, ["k"])
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    merge(one, 0)
    merge(spark.createDataFrame([(1, "z"), (2, "b")], "k long, v string"), 1)
    merge(one, 0)
    assert sorted((r["k"], r["v"]) for r in sk.table_at(spark, path).collect()) == [(1, "z"), (2, "b")]


def rows_at(spark, path):
    return sorted((r["k"], r["v"]) for r in sk.table_at(spark, path).collect())


def put(spark, path, rows, **how):
    return sk.upsert(spark, spark.createDataFrame(rows, "k long, v string"), path, ["k"], dry_run=False, **how)


def test_a_lost_writer_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    put(spark, path, [(1, "a"), (2, "b")])
    spark.createDataFrame([(1, "half", 5)], "k long, v string, _part int").write.partitionBy("_part").parquet(f"{path}/v2")  # written, never committed
    assert rows_at(spark, path) == [(1, "a"), (2, "b")]
    put(spark, path, [(2, "c")])
    assert rows_at(spark, path) == [(1, "a"), (2, "c")]


def test_a_writer_that_comes_second_starts_anew(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    put(spark, path, [(1, "a")])
    commit, others = sk.commit, []

    def late(spark, path, content):
        if not others:
            others.append(1)
            put(spark, path, [(2, "other")])
        commit(spark, path, content)

    monkeypatch.setattr(sk, "commit", late)
    put(spark, path, [(3, "mine")])
    assert rows_at(spark, path) == [(1, "a"), (2, "other"), (3, "mine")]
    assert sk.manifest(spark, path)["version"] == 3


def test_many_batches_leave_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for i in range(8):
        put(spark, path, [(i % 3, f"v{i}")], batch=i)
    put(spark, path, [(0, "again")], batch=7)
    assert rows_at(spark, path) == [(0, "v6"), (1, "v7"), (2, "v5")]
    assert len([p for p in (tmp_path / "t" / "_manifest").iterdir() if p.suffix == ".json"]) == sk.KEPT
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) <= sk.KEPT + 3


def test_log_rows_and_new_files(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k long")
    for i in range(2):
        sk.log_rows(df, f"{tmp_path}/log", f"s{i}")
    assert sorted(r["stage"] for r in spark.read.json(f"{tmp_path}/log").collect()) == ["s0", "s1"]
    sk.write_new(df, f"{tmp_path}/new")
    try:
        sk.write_new(df, f"{tmp_path}/new")
        raise AssertionError("an existing table was written again")
    except Exception as e:
        assert "PATH_ALREADY_EXISTS" in str(e)
    r = df.select(sk.contract(F.col("k"), F.col("k") + 1).alias("c")).first()["c"]
    assert r == '{"declared":1,"observed":2}'


def test_streams_match_batch(spark, tmp_path):
    rows = [(1, 0), (1, 5), (1, 30), (2, 3), (3, 1000)]
    df = spark.createDataFrame(rows, "k long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 10000))
    df.write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for i, (stream, want) in enumerate([(st.debounced(src, "k", "ts", 6.0, "1 minute"), [(1, 10000.0), (1, 10030.0), (2, 10003.0)]), (st.first_seen(src, ["k"], "ts", "1 minute").select("k", F.lit(0).alias("t")), [(1, 0), (2, 0), (3, 0)]), (st.anchored(src, "k", "ts", 20.0, "1 minute"), [(1, 10000.0), (1, 10030.0), (2, 10003.0)])]):
        q = stream.writeStream.format("memory").queryName(f"out{i}").option("checkpointLocation", f"{tmp_path}/c{i}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(r[:] for r in spark.table(f"out{i}").collect()) == want
    q = st.session_counts(src, "k", "ts", "10 seconds", "1 second").writeStream.format("memory").outputMode("complete").queryName("sess").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("sess").collect()) == [1, 1, 1, 2]
    levels = st.tumbling_levels(src, "k", "ts", "s", "10 seconds", "1 second").writeStream.format("memory").outputMode("complete").queryName("lev").option("checkpointLocation", f"{tmp_path}/l").trigger(availableNow=True).start()
    levels.awaitTermination(120)
    assert sorted((r["k"], r["level"], r["n"]) for r in spark.table("lev").collect()) == [(1, 2.5, 2), (1, 30.0, 1), (2, 3.0, 1), (3, 1000.0, 1)]


def test_debounce_does_not_depend_on_how_rows_come_in(spark, tmp_path):
    """Late rows within the watermark, over several batches."""
    times = [[10, 40], [0, 5], [44, 47], [1000]]
    for i, part in enumerate(times):
        d = spark.createDataFrame([(1, s) for s in part], "k long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 10000)).coalesce(1)
        d.write.mode("append").parquet(f"{tmp_path}/in{i}")
        schema = d.schema
    (tmp_path / "all").mkdir()
    q = None
    for i in range(len(times)):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(tmp_path / "all" / f"{i}-{f.name}")
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/all")
        q = st.debounced(src, "k", "ts", 6.0, "2 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["t"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [10000.0, 10010.0, 10040.0, 10047.0]
