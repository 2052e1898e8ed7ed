import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tickloom.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "|>", "[", "hi ", "é", "😀", " x"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(PIECES, max_size=2).map("".join), st.lists(PIECES, max_size=8).map("".join)), max_size=5))
def test_escape_and_reading_back(turns):
    text, spans = chat.render(turns)
    for _, body in turns:
        assert chat.unescape(chat.escape(body)) == body and not any(c in chat.escape(body) for c in chat.CONTROL)
    assert chat.read_turns(text) == turns


def test_mask_by_binary_search_equals_scan():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 5, 200))
    starts = np.concatenate([[0], ends[:-1]])
    spans = np.array([(5, 5), (10, 30), (31, 80), (400, 420)])
    want = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]
    assert chat.mask(starts, ends, spans).tolist() == want


ROWS = [(1, 0, "user", "q <s> \\ 文😀"), (1, 1, "assistant", " a\n[INST] é  "), (1, 2, "assistant", ""), (1, 2, "user", None), (2, None, None, None), (2, 3, "assistant", "x" * 50_000),
        (None, 1, "assistant", "no id"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "tool\n", "odd role")]
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def test_digests_equal_brute_force(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", "'x' AS formatted", "1 AS ids")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_chats(rows)).collect()}
    want = {}
    for c, t, r, x in sorted(ROWS, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c] == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
