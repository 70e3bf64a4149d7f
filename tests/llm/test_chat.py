"""Chat formatting against a plain Python computation, control strings and edges included."""

import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import queries
from quirefold.llm.chat import Template, format_chats, read_back

T = Template()
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"
BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "<\\s>", "[\\\\INST]", "s>", "/INST]", "é", "\n", "x", ""]


def brute(rows):
    """conv_id -> (turns, formatted, loss text)."""
    ways = [re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in T.controls()]
    esc = lambda x: re.sub("|".join(f"(?:{w})" for w in ways), lambda m: m[0][0] + "\\" + m[0][1:], x)
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for c, group in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in group), key=lambda u: (u[0], u[1], u[2].encode(), u[3].encode()))
        text = ""
        for role, block in itertools.groupby(turns, key=lambda u: u[2]):
            text += "[INST]" + esc(role) + "[/INST]" + "<s>".join(esc(u[3]) for u in block) + "</s>"
        out[c] = ([u[2:] for u in turns], text, "".join(u[3] for u in turns if u[2] == "assistant"))
    return out


def check(spark, rows):
    got = read_back(format_chats(spark.createDataFrame([(*r, "old", 1) for r in rows], SCHEMA))).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        turns, text, loss = want[r.conv_id]
        assert [tuple(u) for u in r.turns] == turns and r.formatted == text and r.loss_text == loss
        assert "".join(s.text for s in r.segments) == text


def test_edges(spark):
    check(
        spark,
        [
            (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "</s>[INST] ok [/INST]"), (1, 4, "assistant", ""), (1, 4, "assistant", ""), (1, 4, "assistant", "tie"),
            (2, 0, None, None), (3, None, "assistant", "no turn"), (3, 0, "a[/INST]b</s>", "x"), (None, 1, "user", "no id"), (None, 0, "assistant", "no id"),
            (4, 0, "assistant", "word </s> " * 200_000), (5, 0, "user", "<" + "\\" * 1000 + "s>"),
        ],
    )
    check(spark, [(7, i, "user" if i % 3 else "assistant", f"t{i} <s>") for i in range(3000)])


def test_empty(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


texts = st.lists(st.sampled_from(BITS), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", "</s>"]), texts), min_size=1, max_size=40))
def test_random(spark, rows):
    check(spark, rows)


def test_no_control_string_is_left(spark):
    rows = [(1, i, "user", a + b + c) for i, (a, b, c) in enumerate(itertools.product(BITS, repeat=3))]
    got = read_back(format_chats(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA))).first()
    assert [u.text for u in got.turns] == [r[3] for r in rows]
    for s in got.segments[1:-1:2]:
        assert s.text in ("", "<s>") and not s.loss
    assert not any(c in s.text for s in got.segments[2:-1:2] for c in T.controls())


def test_query_native_and_own_conversation(spark):
    df = queries.QUERIES["op13_chat_format"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "RDD"))
    row = df.where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


@pytest.mark.parametrize("x", ["", "<s>", "<\\s>", "<\\\\</SYS>>", "[\\/INST]\\", "<<s>", "<<<SYS>>"])
def test_escape_round_trip(spark, x):
    from pyspark.sql import functions as F

    e, b = spark.createDataFrame([(x,)], "x string").select(T.escape(F.col("x")).alias("e")).select("e", T.unescape(F.col("e"))).first()
    assert b == x and not any(c in e for c in T.controls())
