"""Chat formatting: an exact round trip, merged neighbours, odd rows."""

from pyspark.sql import functions as F

from pitlens.llm import chat

ROWS = [(1, 0, "user", "hi"), (1, 1, "user", "more </s> \\ \\\\</s>"), (1, 2, "assistant", "<|turn|>[INST]\\"), (1, 3, "assistant", ""), (1, 4, "user", None),
        (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "system", "first\n"), (None, 0, None, "x"),
        (None, 1, "<|role|>", "漢<s><<SYS>>🙂"), (3, 0, "user", "")]
SHAPE = "conv_id long, turn long, role string, text string"


def read(spark, rows):
    df = spark.createDataFrame(rows, SHAPE).withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1))
    out = chat.format_conversations(df)
    return {r[0]: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                        chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"), "formatted", "loss").collect()}


def test_turns_come_back_in_order(spark):
    got = read(spark, ROWS)
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[conv]["t"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["l"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert got[1]["formatted"].count("</s>") == 3 and len(got[1]["loss"]) == 2
    assert got[2]["formatted"] == "<s>system<|role|>first\n</s><s>assistant<|role|>a<|turn|>a<|turn|>b</s>"


def test_long_text_and_no_rows(spark):
    assert read(spark, [(1, 0, "assistant", "<s>" * 40_000)])[1]["l"] == "<s>" * 40_000
    assert not read(spark, [])


def test_query_matches_sql(spark, con):
    from compare import check
    from conftest import SF
    from pitlens.llm.queries import ORACLE_SQL, QUERIES
    assert check(con, QUERIES["op9_chat_formatting"](spark, SF), ORACLE_SQL["op9_chat_formatting"]) is None
