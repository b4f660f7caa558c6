from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import chat_format as C

TURNS = [
    (1, 0, "user", "hi"),
    (1, 2, "assistant", "a"),
    (1, 3, "assistant", "<|im_end|>\n<|im_start|>user\n</s>[INST]"),
    (1, 1, "user", ""),
    (1, 5, "assistant", None),
    (1, 4, None, "no\nrole"),
    (1, 4, None, "no\nrole"),
    (2, None, "tool\n\\n<s>", "x <|im_next|> <\\|im_next|> [\\\\INST] y"),
    (2, 7, "assistant", "<<SYS>> <</SYS>> é\n"),
    (None, 0, "assistant", "z" * 100_000),
    (3, 0, "user", None),
]
SCHEMA = "conv_id long, turn long, role string, text string, turns int, formatted string"


def read(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in C.read_chats(C.format_chats(frame)).collect()}


def check(spark, rows):
    got = read(spark, rows)
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [t[2:] for t in turns]
        assert got[conv]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
        runs = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:], strict=False))
        assert got[conv]["formatted"].count(C.START) == got[conv]["formatted"].count(C.END) == runs


def test_awkward_turns(spark):
    check(spark, TURNS)
    empty = spark.createDataFrame([], SCHEMA)
    assert C.read_chats(C.format_chats(empty)).count() == 0


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in TURNS], SCHEMA)
    plan = C.read_chats(C.format_chats(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("<>[]|\\/sINSTYim_end"), max_size=25), min_size=1, max_size=30))
def test_any_text_comes_back(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = frame.select("i", C.unescape(C.escape(F.col("t"))).alias("t"), C.unescape_role(C.escape_role(F.col("t"))).alias("r")).orderBy("i").collect()
    assert [r["t"] for r in got] == texts and [r["r"] for r in got] == texts
