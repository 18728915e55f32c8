import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trolley.llm import chat_format as C

TURNS = [
    (1, 0, "system", "s"), (1, 1, "user", "hi <|end|> & [INST]"), (1, 2, "assistant", "a|b"), (1, 3, "assistant", None), (1, 4, "assistant", "&amp;lt;<|part|>"),
    (2, 5, "assistant", ""), (2, 5, "assistant", ""), (3, None, None, "x"), (3, 1, "a|>b<|", "\n"), (None, 1, "user", "é𝄞"),
]


def check(spark, turns):
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    formatted = C.format_conversations(df)
    want = {}
    for conv, turn, role, text in turns:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in C.read_back(formatted).collect()}
    masks = {r.conv_id: r for r in formatted.collect()}
    assert got.keys() == want.keys()
    for conv, ts in want.items():
        ts = sorted(ts)
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in ts]
        assert got[conv].loss_text == "".join(t[3] for t in ts if t[2] == "assistant")
        text, at = masks[conv].formatted, 0
        parts = []
        for run in masks[conv].loss_mask:
            if run.loss:
                parts.append(text[at : at + run.length])
            at += run.length
        assert at == len(text)
        assert len(parts) == sum(t[2] == "assistant" for t in ts)
        blocks = sum(i == 0 or ts[i - 1][2] != t[2] for i, t in enumerate(ts))
        assert text.count(C.END) == blocks and text.count(C.PART) == len(ts) - blocks


def test_round_trip(spark):
    check(spark, TURNS)
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", "a<|b"]), st.text(alphabet="<|>&;ampltb[ \n\\é", max_size=12)), min_size=1, max_size=25))
def test_any_text_round_trips(spark, turns):
    check(spark, turns)


def test_many_turns_and_long_ones(spark):
    """Reading back grows with the length, whether turns alternate, are merged into one block, or are long."""
    turns = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(16_000)] + [(2, i, "assistant", f"[{i}|") for i in range(16_000)]
    turns += [(3, 0, "user", "é<" * 200_000), (3, 1, "assistant", "𝄞&" * 200_000)]
    began = time.monotonic()
    check(spark, turns)
    assert time.monotonic() - began < 90


def test_long_conversation(spark):
    check(spark, [(1, i, ("user", "assistant")[i // 3 % 2], f"t{i}") for i in range(1500)])
