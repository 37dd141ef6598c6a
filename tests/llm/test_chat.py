from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echometer.llm import chat
from tests.compare import difference

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted")))
    return {r.conv_id: r for r in out.collect()}


def test_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n\\n \\| <\\|"),
        (2, 1, "assistant", None), (2, 0, "user", ""),
        (3, 0, None, None),
        (4, 0, "user", "a"), (4, 0, "user", "a"),
        (5, None, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a"),
        (None, 0, "we\\n<|im_start|>ird\nrole", "t"),
        (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "<|" * 50_000),
    ]
    out = formatted(spark, rows)
    assert [out[k].valid for k in (1, 2, 3, 4, 5, 6, None)] == [True, True, False, False, True, True, False]
    expected = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1])):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [tuple(t) for t in r.back] for k, r in out.items()} == expected
    assert [s.text for s in out[2].segments if s.loss] == [""]
    assert sum(s.loss for s in out[5].segments) == 1


def test_empty(spark):
    assert formatted(spark, []) == {}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="<|\\n\nim_startend>", max_size=30), min_size=1, max_size=4), min_size=1, max_size=20))
def test_round_trip(spark, convs):
    rows = [(c, t, ("user", text)[t % 2], text) for c, turns in enumerate(convs) for t, text in enumerate(turns)]
    out = formatted(spark, rows)
    for c, turns in enumerate(convs):
        assert [tuple(t) for t in out[c].back] == [(("user", x)[t % 2], x) for t, x in enumerate(turns)]


def test_query(spark, tables):
    assert difference(chat.op4_chat_formatting(spark, tables), tables, chat.OP4_SQL) is None
