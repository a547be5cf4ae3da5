"""A passage first said elsewhere is found also where the quoting conversation says it itself, but later."""

from spanloom.llm.quotes import reply_order


def test_the_quoting_conversation_is_passed_over(spark):
    rows = [(1, 0, "a", "> thanks a lot\nhm"), (1, 1, "b", "thanks a lot"), (2, 0, "a", "thanks a lot"), (3, 4, "a", "thanks a lot"), (4, 0, "b", "> thanks a lot\n> only here\nso"), (4, 1, "b", "only here")]
    got = {(r["conv_id"], r["turn"]): r for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0]["quoted_conv"], got[1, 0]["quoted_turn"], got[1, 0]["n_linked"]) == (2, 0, 1)
    assert (got[4, 0]["quoted_conv"], got[4, 0]["quoted_turn"]) == (1, 1)


def test_and_so_it_is_in_the_sql(spark):
    from conftest import rows_of
    from test_quotes import SCHEMA, sql_rows

    rows = [(1, 0, "a", "> thanks a lot\nhm"), (1, 1, "b", "thanks a lot"), (2, 0, "a", "thanks a lot"), (3, 4, "a", "thanks a lot"), (4, 0, "b", "> thanks a lot\n> only here\nso"), (4, 1, "b", "only here")]
    assert rows_of(reply_order(spark.createDataFrame(rows, SCHEMA))) == sql_rows(rows)
