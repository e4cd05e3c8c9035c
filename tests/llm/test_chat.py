import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import rows
from tidemark.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", "a\\"), (1, 1, "assistant", ""), (1, None, "system", "<<SYS>>\n"),
    (2, 5, None, None), (2, 6, "x]%é [/TURN ", "[/TURN a]<\\/s>"), (2, 7, "user", "hi\n"), (2, 7, "user", "hi\n"),
    (None, 1, "user", "q"), (None, 2, "assistant", "</s>"), (None, None, None, ""),
    (3, 0, "user", " [/INST] "), (3, 1, "assistant", "\\</s>"), (3, 100, "user", "z"), (3, 101, "assistant", "[TURN] "),
    *((4, i, "user", f"u{i}") for i in range(200)),
    *((5, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(300)),
    *((6, i, "user" if i == 133 else ["user", "assistant"][i % 2], f"t{i}") for i in range(300)),
    (7, 0, "user", "long " * 40000), (7, 1, "assistant", "<s>" * 40000),
]


@pytest.fixture(scope="module")
def formatted(spark):
    turns = spark.createDataFrame(ODD, SCHEMA).withColumns({"block": F.lit(3), "part": F.lit("p"), "state": F.lit(0)})
    return chat.format_conversations(turns.repartition(5))


def test_odd_conversations_equal_the_sql(spark, formatted):
    con = duckdb.connect()
    frame = spark.createDataFrame(ODD, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    extra = chat.format_conversations(chat.example(spark))
    got = chat.describe(formatted.unionByName(extra)).toPandas()
    assert rows(got) == rows(con.sql(chat.ORACLE_SQL).df())


def test_turns_are_read_from_the_marks_alone(formatted):
    read = chat.read_turns(formatted).select("conv_id", "block", "part", F.posexplode("turns").alias("i", "t")).collect()
    read.sort(key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["block"], r["part"], r["i"]))
    given = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert [(r["conv_id"], r["t"]["role"], r["t"]["text"]) for r in read] == [(c, role or "", text or "") for c, _, role, text in given]


def test_blocks_stay_small_and_no_text_holds_a_control_string(formatted):
    for row in formatted.collect():
        assert len(row["segments"]) <= 3 * chat.BLOCK_TURNS
        for s in row["segments"]:
            if s["loss"]:
                assert not any(c in s["text"] for c in chat.INSTRUCT.controls)


def test_no_python_in_the_plan(formatted):
    plan = chat.describe(formatted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_turns_no_rows(spark):
    assert chat.describe(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_another_template(spark):
    steps = (
        chat.Step("open", "human", "wait", "<|h|>", "<|/h|>"),
        chat.Step("wait", "tool", "wait", "<|t|>", "<|/t|>"),
        chat.Step("wait", "bot", "open", "<|b|>", "<|/b|>", loss=True),
    )
    controls = ("<|h|>", "<|/h|>", "<|t|>", "<|/t|>", "<|b|>", "<|/b|>", "<|o|>", "<|/o:")
    own = chat.ChatTemplate(steps, frozenset({"open"}), controls, "<|o|>", ("<|/o:", "|>"), frozenset({"bot"}))
    turns = [(1, 1, "human", "<|b|>"), (1, 2, "tool", "7"), (1, 3, "tool", "8"), (1, 4, "bot", "x"), (2, 1, "bot", "y"), (2, 2, "human", "z")]
    done = chat.format_conversations(spark.createDataFrame(turns, SCHEMA), own)
    text = {r["conv_id"]: "".join(s["text"] for s in r["segments"]) for r in done.collect()}
    assert text == {1: "<|h|><\\|b|><|/h|><|t|>7<|/t|><|t|>8<|/t|><|b|>x<|/b|>", 2: "<|o|>y<|/o:bot|><|o|>z<|/o:human|>"}
    told = {r["conv_id"]: (r["valid"], r["first_bad"], r["loss_chars"]) for r in chat.describe(done, own).collect()}
    assert told == {1: (True, None, 1), 2: (False, 0, 1)}
    with pytest.raises(ValueError):
        chat.ChatTemplate((*steps, chat.Step("open", "bot", "open", "", "<|/h|>")), frozenset(), controls, "<|o|>", ("<|/o:", "|>"), frozenset())
