"""Readers of every format on hand-made files."""

from pyspark.sql import functions as F

from spanloom.sources import readers as rd
from spanloom.sources import sinks as sk


def test_lines_and_timestamped_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": [{"start": 0.5, "end": 65.2, "text": " one "}, {"start": 66, "text": "two"}]}')
    (tmp_path / "b.json").write_text('{"text": "all of it"}')
    (tmp_path / "c.txt").write_text("first\n\nsecond\r\n  \nthird")
    got = {}
    for r in rd.read_lines(spark, f"{tmp_path}/*").orderBy("file", "idx").collect():
        got.setdefault(r["file"][-6:], []).append((r["st"], r["en"], r["text"]))
    assert got == {"a.json": [(0.5, 65.2, "one"), (66.0, 0.0, "two")], "b.json": [(0.0, 0.0, "all of it")], "/c.txt": [(0.0, 0.0, x) for x in ("first", "second", "third")]}
    text = {r["file"][-6:]: r["text"] for r in rd.timestamped(rd.read_lines(spark, f"{tmp_path}/*")).collect()}
    assert text == {"a.json": "[00:00-01:05] one\n[01:06-00:00] two", "b.json": "all of it", "/c.txt": "first\nsecond\nthird"}


def test_segments_runs_and_shadows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": [{"start": 1, "end": 2, "text": "x", "speaker": "A", "words": [{"word": "x", "start": 1}]}, {"start": 3, "end": 4, "text": "y"}]}')
    rows = rd.read_segments(spark, f"{tmp_path}/a.json").orderBy("idx").collect()
    assert [(r["st"], r["en"], r["text"], r["speaker"], r["words"] is None) for r in rows] == [(1.0, 2.0, "x", "A", False), (3.0, 4.0, "y", None, True)]
    cues = spark.createDataFrame([(1, r"{\b1\1c&H0000FF&}big {\i1}slanted {\b0}plain")], "clip long, raw string")
    runs = rd.cue_runs(cues).orderBy("run").collect()
    assert [(r["word"], r["bold"], r["italic"], r["rgb"]) for r in runs] == [("big", True, False, "FF0000"), ("slanted", False, True, None), ("plain", False, False, None)]


def test_subtitle_fields_lie_where_the_format_line_has_them(spark, tmp_path):
    (tmp_path / "a.ass").write_text("[V4+ Styles]\nFormat: Fontname, Name, PrimaryColour\nStyle: Arial,Main,&H0000FF00\n[Events]\nFormat: Start, End, Layer, Style, Text\nDialogue: 0:00:01.00,0:00:02.50,0,Main,Hello, you, there\n")
    r = rd.read_ass(spark, f"{tmp_path}/a.ass").first()
    assert (r["st"], r["en"], r["style"], r["text"], r["colour"]) == (1.0, 2.5, "Main", "Hello, you, there", "00FF00")


def test_logs_lists_and_marks(spark, tmp_path):
    (tmp_path / "log").write_text('{"ts": 5, "stage": "a"}\nnot json\n{"ts": 1, "stage": "b"}\n')
    assert [r["stage"] for r in rd.read_log(spark, f"{tmp_path}/log", "ts double, stage string", 2.0).collect()] == ["a"]
    (tmp_path / "list").write_text("# head\nSales Calls|x\n\n// no\nMoney\ty\n")
    assert sorted((r["term"], r["tokens"]) for r in rd.read_list(spark, f"{tmp_path}/list").collect()) == [("Money", ["money"]), ("Sales Calls", ["sales", "calls"])]
    lines = spark.createDataFrame([(1, "n:0 pts_time:1.5 pos:3"), (1, "frame"), (2, "pts_time:9")], "clip long, value string")
    assert sorted(r[:] for r in rd.marked_times(lines, "pts_time", ["clip"]).collect()) == [(1, 1.5), (2, 9.0)]


def test_alignments_and_caption_events(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text('item [1]:\n name = "words"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "hi"\n intervals [2]:\n xmin = 0.5\n xmax = 0.7\n text = ""\n item [2]:\n name = "phones"\n intervals [1]:\n xmin = 0\n xmax = 0.2\n text = "HH"\n')
    assert [(r["st"], r["en"], r["word"]) for r in rd.read_textgrid(spark, f"{tmp_path}/a.TextGrid").collect()] == [(0.0, 0.5, "hi")]
    (tmp_path / "a.json3").write_text('{"events": [{"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "a"}, {"utf8": "\\n b"}]}, {"tStartMs": 2000, "segs": [{"utf8": " "}]}, {"tStartMs": 3000}]}')
    assert [(r["st"], r["en"], r["text"]) for r in rd.read_json3(spark, f"{tmp_path}/a.json3").collect()] == [(1.0, 1.5, "a b")]


def test_listings(spark, tmp_path):
    for name, body in (("p/a/one.mp4", "xx"), ("p/a/two.mp4", "x"), ("p/b/three.txt", "yy"), ("p/contract.json", "{}"), ("p/b/contract.json", "{}"), ("q/four.mp4", "zz")):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    files = rd.read_listing(spark, str(tmp_path))
    posted = spark.createDataFrame([("one.mp4",)], "name string")
    assert {r["name"]: r["reason"] for r in rd.eligible(files, posted, ["mp4"], 2).collect() if r["ext"] != "json"} == {"one.mp4": "posted", "two.mp4": "small", "three.txt": "extension", "four.mp4": "ok"}
    assert {r["category"]: r["names"] for r in rd.pools(files.filter("ext <> 'json'")).collect()} == {"a": ["one.mp4", "two.mp4"], "b": ["three.txt"], "q": ["four.mp4"]}
    clips = files.filter("ext in ('mp4', 'txt')").select("path")
    got = {r["path"].rsplit("/", 1)[1]: r["contract"] and r["contract"][len(f"file:{tmp_path}") :] for r in rd.contracts(clips, files, "contract.json").collect()}
    assert got == {"one.mp4": "/p/contract.json", "two.mp4": "/p/contract.json", "three.txt": "/p/b/contract.json", "four.mp4": None}
    assert rd.newest(files).count() == 1


def test_studio_columns_and_evidence(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Content,Views,Subscribers,Estimated revenue (USD),Average view duration\nabcdefghijk,"1,000",5,"$12.50",0:03:20\n')
    r = rd.read_studio_csv(spark, f"{tmp_path}/s.csv").first()
    assert (r["revenue"], r["view_s"], r["subs_per_1k"]) == (12.5, 200.0, 5.0)
    raw = spark.createDataFrame([(1, 0, 500, "a", 10.0), (1, 9000, 9800, "b", 10.0), (2, 0, 400, "c", 10.0)], "clip long, start long, end long, text string, dur double")
    w = rd.provider_words(raw)
    assert sorted((r["clip"], r["n"], r["status"]) for r in rd.evidence(w, ["clip"], "dur").collect()) == [(1, 2, "FULL"), (2, 1, "PARTIAL")]


def test_sample_windows(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, [])], "clip long, x array<double>")
    assert rd.pcm(df.select("clip", "x"), F.col("x"), 2).count() == 10
    assert [(r["i"], r["t"], r["v"]) for r in rd.pcm(df, F.col("x"), 2, 1.0, 1.5).collect()] == [(2, 1.0, 2.0), (3, 1.5, 3.0), (4, 2.0, 4.0)]


def test_subtitle_lines(spark, tmp_path):
    cues = spark.createDataFrame([(1, 2.0, 3.0, "b", "guest"), (1, 0.0, 1.0, "a", "host")], "clip long, st double, en double, text string, speaker string")
    body = sk.ass_lines(cues, ["clip"], {"guest": "FECB00"}).first()["body"]
    assert body.split("\n") == [r"Dialogue: 0,0:00:00.00,0:00:01.00,Main,,0,0,0,,{\1c&HFFFFFF&}a", r"Dialogue: 0,0:00:02.00,0:00:03.00,Main,,0,0,0,,{\1c&H00CBFE&}b"]
    (tmp_path / "x.ass").write_text("[Events]\n" + body)
    assert [(r["text"], r["colour"]) for r in rd.read_ass(spark, f"{tmp_path}/x.ass").orderBy("idx").collect()] == [("a", "FFFFFF"), ("b", "FECB00")]
    sk.write_srt(cues, f"{tmp_path}/srt", ["clip"])
    assert "00:00:02,000 --> 00:00:03,000" in spark.read.text(f"{tmp_path}/srt", wholetext=True).first()[0]


def test_folders_are_looked_up_once_each(spark):
    import re

    files = spark.range(300).selectExpr("concat('r/', id % 3, '/', id % 2, '/', id, '.mp4') as path", "id")
    listing = spark.createDataFrame([("r/1/contract.json", "contract.json"), ("r/2/1/contract.json", "contract.json"), ("r/2/contract.json", "contract.json"), ("r/0/other", "other")], "path string, name string")
    found = rd.contracts(files, listing, "contract.json")
    assert found.columns == ["path", "id", "contract"] and found.count() == 300
    want = {0: None, 1: "r/1/contract.json"}
    assert all(r["contract"] == want.get(r["id"] % 3, f"r/2/{'1/' if r['id'] % 2 else ''}contract.json") for r in found.collect())
    assert not re.search(r"keys?=\[path", found._jdf.queryExecution().executedPlan().toString())  # no aggregation over files
