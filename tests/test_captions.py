"""Caption rules: what each text comes out as, that a second pass changes nothing, and that merged words span what they were made from."""

from spanloom.operators import captions as cp

SAME = ["zero people", "so one thing", "one of the biggest mistakes", "one shot", "1k", "$1K", "vitamin k", "plan m", "50 sales", "in 2024 our revenue grew", "a lot of dollars", "what percentage did you get", "many times over", "company.com", "etc.", "e.g.", "i.e.", "are you sure?", "that's amazing!", "don't do it", "1,000", "$1.2M", "U.S.", "ROI", "1-on-1", "10X", "5000", "12000 steps", "2,000X", "#2", "one way", ""]
SHOWN = {
    "numbers": {"two": "2", "ten": "10", "twenty two": "22", "one hundred": "100", "one thousand": "1,000", "fifty thousand": "50,000", "one hundred thousand": "100,000", "three hundred million": "300,000,000", "a thousand": "a 1,000", "44 million": "44,000,000", "two hundred thousand": "200,000", "two thousand": "2,000", "nine hundred hundred hundred hundred hundred hundred hundred hundred hundred trillion": "nine hundred hundred hundred hundred hundred hundred hundred hundred hundred trillion"},
    "labels": {"number two": "#2", "number one": "#1", "law number 1": "law #1", "step number 5": "step #5", "week number one": "week #1", "step one": "step #1", "tip three": "tip #3", "day one": "day 1", "round two": "round 2"},
    "dollars": {"zero dollars": "$0", "five hundred dollars": "$500", "fifty thousand dollars": "$50K", "two million dollars": "$2M", "one billion dollars": "$1 Billion", "one trillion dollars": "$1 Trillion", "a thousand dollars": "a $1,000", "five thousand dollars": "$5,000", "thousand dollars": "$1,000", "a 100 dollar deal": "a $100 deal", "100 million dollars": "$100M"},
    "grands": {"a grand": "$1,000", "one grand": "$1,000", "ten grand": "$10,000", "a hundred grand": "$100K", "500 grand": "$500K", "100 grand or 200 grand": "$100K or $200K", "1.5 grand": "$1.5K"},
    "units": {"50 k": "$50K", "3 mil": "$3M", "10 m": "$10M", "5 mil in revenue": "$5M in revenue", "three and a half mil in revenue": "$3.5M in revenue", "five and a quarter mil": "$5.25M", "three and a half years": "3 and a half years"},
    "scales": {"$100 million": "$100M", "$5 thousand": "$5,000", "$2 billion": "$2 Billion", "$1.5 billion": "$1.5 Billion", "I made a $400 million exit": "I made a $400M exit", "it's a $2 billion company": "it's a $2 Billion company"},
    "context": {"how much do you charge a thousand": "how much do you charge $1,000", "a million a month": "$1M a month", "making a million a month": "making $1M a month", "two hundred thousand a week": "$200K a week", "the past five years": "the past 5 years", "two points three points": "2 points 3 points", "200 million or 500 million": "$200M or $500M", "we did 44 million in revenue": "we did $44M in revenue", "cash was tight we only had five thousand left": "cash was tight we only had $5,000 left", "two thousand in revenue": "$2,000 in revenue", "the price is 5k": "the price is $5K", "the price is 50k": "the price is $50K", "i run 5k every morning": "I run 5k every morning"},
    "symbols": {"fifty percent": "50%", "five times": "5X", "ten times bigger": "10X bigger", "10x": "10X", "10x'ing": "10X'ing", "2xing": "2Xing", "zero percent": "0%", "zero %": "0%", "zero $": "$0", "one thousand times": "1,000X", "fifty thousand percent": "50,000%"},
    "dictionary": {"one on one": "1-on-1", "one on one on one": "1-on-1 on one", "One Shot.": "one shot", "ai": "AI", "kpis": "KPIs", "we wrote an sop": "we wrote an SOP", "the u.s. economy": "the U.S. economy", "youtube": "YouTube"},
    "case": {"i": "I", "i'm": "I'm", "The Best thing i did": "the best thing I did", "elon's": "Elon's", "irl-based": "IRL-based", "Well-Known": "well-known"},
    "marks": {"hello, world": "hello world", "this is great.": "this is great", "e.g.,": "e.g.", "in the U.S., we win": "in the U.S. we win", '"Quoted (words)': "quoted words)", "really?!": "really?!"},
}


def captions(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r["caption"] for r in cp.formatted(df, "id", "text").orderBy("id").collect()]


def test_what_texts_come_out_as(spark):
    pairs = [(k, v) for group in SHOWN.values() for k, v in group.items()] + [(t, t) for t in SAME] + [(None, ""), ("  ", "")]
    got = dict(zip([k for k, _ in pairs], captions(spark, [k for k, _ in pairs])))
    assert {k: (got[k], v) for k, v in pairs if got[k] != v} == {}


def test_a_second_pass_changes_nothing(spark):
    once = [v for group in SHOWN.values() for k, v in group.items() if "hundred hundred" not in k and k not in ("one on one on one", "three and a half years", "two points three points")]
    assert captions(spark, once) == once


def test_merged_words_span_their_words(spark):
    said = ["we", "made", "a", "hundred", "grand", "in", "one", "on", "one", "calls."]
    words = spark.createDataFrame([(1, i, w, float(i), i + 0.9) for i, w in enumerate(said)], "id long, k int, word string, lo double, hi double")
    got = [(r["word"], r["lo"], r["hi"]) for r in cp.ruled(words).orderBy("k").collect()]
    assert got == [("we", 0.0, 0.9), ("made", 1.0, 1.9), ("$100K", 2.0, 4.9), ("in", 5.0, 5.9), ("1-on-1", 6.0, 8.9), ("calls", 9.0, 9.9)]


def test_known_misspellings_come_first(spark):
    words = spark.createDataFrame([(1, 0, "Jon", 0.0, 1.0), (1, 1, "oen", 1.0, 2.0), (1, 2, "shot", 2.0, 3.0)], "id long, k int, word string, lo double, hi double")
    assert [r["word"] for r in cp.ruled(words, {"jon": "elon", "oen": "one"}).orderBy("k").collect()] == ["Elon", "one", "shot"]


def rows_dealt(spark, run):
    """What run gives, and how many rows its jobs shuffled."""
    sc, group = spark.sparkContext, f"captions-{id(run)}"
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    store = sc._jsc.sc().statusStore()
    return out, sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in {k for j in jobs for k in j.stageIds} if sc.statusTracker().getStageInfo(k).numCompletedTasks)


def test_only_texts_with_numbers_are_dealt_out(spark):
    long = "We asked an editor, what is our ROI? I'm sure. " * 40
    shown = ("we asked an editor what is our ROI? I'm sure " * 40).strip()
    got, dealt = rows_dealt(spark, lambda: captions(spark, [long, "(five million dollars", None] * 20))
    assert got == [shown, "$5M", ""] * 20
    assert dealt <= 400  # each long text has 400 words; 3 words of each text with a number, a few rows for it, and 60 that orderBy deals out


def test_texts_without_numbers_as_by_the_rules(spark):
    words = ["The", "AI", "ai.", "Roi?!", "i'LL", "I", "etc.", "E.G.,", "ETC", "U.S.", "u.s.,", "a.b.", "A.B.", "N.A.S.A.", "Elon's", "ELON’S", "irl-Based", "Well-Known", "\"Quoted", "[(x", "...", "?", "!,", ".", "--", "'", "don't", "Mr.", "MrBeast", "ÉCOLE,", "ΟΔΟΣ.", "ΟΔΟΣ?", "İ", "ſo", "a\tB", "Vegas\nI", "$", "%", "shot", "On", "company.com", "Foo.Com,", "someone", "Tone", "x'S", "KK", "jon", "etc", "youtube!", "c++", "a_b"]
    texts = [" ".join([w, v]) for w in words for v in (*words[:12], "", " b")]
    known = {"jon": "elon", "tone": "Gonna Be"}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert df.filter(cp._counts(df["text"], known)).count() == 0
    got = {r["id"]: r["caption"] for r in cp.formatted(df, "id", "text", known).collect()}
    split = spark.createDataFrame([(i, k, w, k, k) for i, t in enumerate(texts) for k, w in enumerate(t.split(" ")) if w], "id long, k int, word string, lo int, hi int")
    said: dict[int, list] = {}
    for r in cp._ruled(split, known).orderBy("id", "k").collect():
        said.setdefault(r["id"], []).append(r["word"])
    assert {texts[i]: (got[i], " ".join(said.get(i, [])).strip()) for i in got if got[i] != " ".join(said.get(i, [])).strip()} == {}
    assert sorted(got) == list(range(len(texts)))


def test_a_misspelled_number_counts(spark):
    df = spark.createDataFrame([(1, "(Fife, million dollars"), (2, "fifes, million-ish dollars")], "id long, text string")
    assert [r["caption"] for r in cp.formatted(df, "id", "text", {"fife": "Five"}).orderBy("id").collect()] == ["$5M", "fifes million-ish dollars"]
