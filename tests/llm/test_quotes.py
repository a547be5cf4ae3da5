import random

import duckdb
import pandas as pd
from conftest import plain, rows_of

from spanloom.llm.quotes import OP1_SQL, parsed, reply_order

SCHEMA = "conv_id long, turn long, role string, text string"


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.sql(OP1_SQL)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def made(seed: int, n_conv: int = 6) -> list:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta"]
    out, pool = [], []
    for c in range(n_conv):
        texts = []
        for t in range(rng.randint(1, 9)):
            own = "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
            text = own
            if texts and rng.random() < 0.7:
                text = "\n".join("> " + x for x in rng.choice(texts).split("\n")) + "\n\n" + own
            if pool and rng.random() < 0.2:
                text = "> > " + rng.choice(pool).split("\n")[0] + "\n" + text
            texts.append(text)
            pool.append(own)
            out.append((c, t * 2, rng.choice(["user", "assistant"]), text))
    return out


def test_nested_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "a", "First line here.\nSecond line."),
        (1, 1, "b", "> First   LINE here.\n> Second line.\nI agree."),
        (1, 2, "c", ">> First line here.\n>> second line.\n> I agree.\n\nMe too."),
        (1, 3, "a", "> First line here.\n\nA new branch."),
        (2, 0, "a", "> I agree.\nElsewhere."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2]["parent_turn"] == 1 and got[1, 2]["quote_level"] == 2 and got[1, 2]["text"] == "Me too."
    assert got[1, 3]["parent_turn"] == 0 and got[1, 3]["depth"] == 1 and got[1, 3]["position"] == 2
    assert got[1, 2]["position"] == 3
    assert (got[2, 0]["quoted_conv"], got[2, 0]["quoted_turn"], got[2, 0]["parent_turn"]) == (1, 1, None)


def test_matches_sql_on_invented_threads(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert rows_of(reply_order(spark.createDataFrame(rows, SCHEMA))) == sql_rows(rows)


def test_nulls_repeats_and_empties(spark):
    rows = [(None, 0, "a", "x"), (1, None, "a", "> x\ny"), (1, 0, None, None), (1, 0, None, None), (1, 1, "b", ""), (1, 1, "c", ">\n> \n>>>"), (1, 5, "b", "> x"), (2, 3, "a", " \t\n> >deep\rx")]
    df = spark.createDataFrame(pd.DataFrame({"extra": ["k"] * len(rows)})).limit(0)
    assert df.count() == 0
    assert rows_of(reply_order(spark.createDataFrame(rows, SCHEMA))) == sql_rows(rows)
    assert reply_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_do_not_clash(spark):
    rows = [(1, 0, "a", "hello there", "p"), (1, 1, "b", "> hello there\nyes", "q")]
    df = spark.createDataFrame(rows, SCHEMA + ", depth string").withColumnRenamed("depth", "passages")
    assert reply_order(df).filter("by_quote").count() == 1


def test_long_chain_and_long_text(spark):
    rows = [(7, t, "a", f"word{t}") for t in range(1500)]
    got = reply_order(spark.createDataFrame(rows, SCHEMA))
    assert got.filter("depth <> turn or position <> turn").count() == 0
    long = "\n".join(f"> line {i}" if i % 3 else f"own {i}" for i in range(20_000))
    one = parsed(spark.createDataFrame([(long,)], "text string")).selectExpr("size(passages) n", "n_quotes").first()
    assert one["n_quotes"] > 5000
