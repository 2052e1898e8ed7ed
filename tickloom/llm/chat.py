"""Chat formatting with loss masks aligned by token offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table
from tickloom.llm.registry import query

VOCABULARY = "byte_bpe_50k.json"
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that steer a model; none of them stays whole inside a text.
CONTROL = (START, MIDDLE, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string; ``unescape`` undoes it."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]], learn_from: str = "assistant") -> tuple[str, np.ndarray]:
    """The whole conversation as one string, and the (start, end) spans of the texts to learn from, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role or "") + MIDDLE, escape(text or "")
        if role == learn_from:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep leading spaces
    tok.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, MIDDLE, END)])
    return tok


def mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens that touch a span. Tokens and spans are sorted; both borders of a span are found by binary search."""
    out = np.zeros(len(starts) + 1, np.int64)
    some = spans[spans[:, 1] > spans[:, 0]]
    first, last = np.searchsorted(ends, some[:, 0], "right"), np.searchsorted(starts, some[:, 1], "left")
    np.add.at(out, first, 1)
    np.add.at(out, last, -1)
    return np.cumsum(out)[:-1] > 0


FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), *[(c, pa.list_(pa.int32())) for c in ("ids", "starts", "ends")], ("loss", pa.list_(pa.bool_()))])
FORMATTED_DDL = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
RUN = 200  # conversations that are turned into a batch at a time


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """conv_id, formatted, ids, starts, ends and loss of every conversation.

    A conversation is rendered whole, encoded once, and the loss mask is what the assistant spans and
    the token offsets share; markers are tokens of their own, so a masked token never reaches past its
    text. Turns are sorted by turn, then role and text, nulls first; repeated rows are repeated turns.
    Null text and null role: empty; a null conv_id is a conversation. One conversation is one example
    and so one row. Empty table: no rows. Other columns are not read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, RUN):
                part = b.slice(i, RUN)
                cols: list[list] = [[], [], [], [], []]
                for turns in part.column(1).to_pylist():
                    text, spans = render([(t["role"], t["text"]) for t in turns])
                    e = tok.encode(text, add_special_tokens=False)
                    at = np.array(e.offsets, np.int32).reshape(-1, 2)
                    for col, x in zip(cols, (text, np.array(e.ids, np.int32), at[:, 0], at[:, 1], mask(at[:, 0], at[:, 1], spans))):
                        col.append(x)
                yield pa.record_batch([part.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(FORMATTED)[1:])]], schema=FORMATTED)

    turns = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))))
    chats = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(turns.alias("turns"))
    return chats.mapInArrow(run, FORMATTED_DDL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_loss(formatted: str, starts, ends, loss) -> str:
    """The text under the mask, unescaped. Tokens that are parts of one character share its offsets; it is read once."""
    keep = np.asarray(loss, bool)
    parts, done = [], 0
    for a, b in zip(np.asarray(starts)[keep].tolist(), np.asarray(ends)[keep].tolist()):
        if b > done:
            parts.append(formatted[max(a, done):b])
            done = b
    return unescape("".join(parts))


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(chats: DataFrame) -> DataFrame:
    """Figures of every formatted conversation, read back from its string, offsets and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, formatted, starts, ends, loss in zip(*b.columns):
                text = formatted.as_py()
                turns = read_turns(text)
                learned = read_loss(text, *(x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, loss)))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv.as_py(), len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), DIGEST)], schema=DIGEST)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, ddl)


@query("op6_chat_masks")
def op6_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    trial = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.unionByName(trial)))
