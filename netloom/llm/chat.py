"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole, ``<s>[INST]role[/INST]text</s>`` per turn, and encoded once with
offsets. The sorted spans of the trained turns are intersected with the token spans by binary
search. The four control strings are added tokens, so no token spans the edge of a text; the same
strings inside roles and texts are escaped with a backslash, which the reader takes out again.

A conversation longer than ``block_chars`` is rendered and encoded in blocks that end with a turn:
added tokens separate turns, so the ids are those of the whole. A task holds one block, not one
conversation, and digests are continued from block to block.

Defined results: turns are ordered by turn, role, text; nulls first; repeated rows are turns of
their own. A null role or text is empty. A null conv_id is a conversation of its own. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.tokens import vocabulary

#: Control strings of the template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
BLOCK_CHARS = 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, (BEGIN, END, OPEN, CLOSE))))
_TURN = re.compile(f"{re.escape(BEGIN + OPEN)}(.*?){re.escape(CLOSE)}(.*?){re.escape(END)}", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes are doubled; one is put after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@functools.lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([BEGIN, END, OPEN, CLOSE])
    return tokenizer


def render(turns: list[tuple[str, str]], train_role: str) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns and the sorted spans of the trained ones."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = BEGIN + OPEN + escape(role) + CLOSE, escape(text)
        at += len(head)
        if role == train_role:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that begin inside a span; both are sorted."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        edges = np.searchsorted(offsets[:, 0], np.asarray(spans), side="left")
        for lo, hi in edges:
            mask[lo:hi] = True
    return mask


FORMATTED = ("conv_id bigint, block int, formatted string, ids array<int>, starts array<int>, ends array<int>, "
             "mask array<boolean>")


def format_conversations(conversations: DataFrame, train_role: str = "assistant", path: str | None = None,
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation (per block of a long one), in order: text, ids, offsets, mask."""
    path = path or vocabulary()
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
                                F.coalesce(F.col("role"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def block_row(conv_id, block, turns):
        text, spans = render(turns, train_role)
        code = chat_tokenizer(path).encode(text, add_special_tokens=False)
        offsets = np.asarray(code.offsets, np.int32).reshape(-1, 2)
        return conv_id, block, text, code.ids, offsets[:, 0], offsets[:, 1], mask_tokens(offsets, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, block, turns, chars, ready = None, 0, [], 0, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if turns and (c != conv_id or chars >= block_chars):
                    ready.append(block_row(conv_id, block, turns))
                    block, turns, chars = block + 1 if c == conv_id else 0, [], 0
                conv_id = c
                turns.append((role, text))
                chars += len(text)
            if ready:
                yield _formatted(ready)
                ready = []
        if turns:
            yield _formatted([block_row(conv_id, block, turns)])

    return rows.mapInArrow(run, FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
    names = ("conv_id", "block", "formatted", "ids", "starts", "ends", "mask")
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted text and the mask alone.

    Takes the rows of ``format_conversations`` as they come: blocks in order, in one task.
    """

    def fresh(conv_id):
        return [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def result(states):
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        rows = [(c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in states]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            conv, blocks, texts = (batch.column(i).to_pylist() for i in range(3))
            for i, (c, block, text) in enumerate(zip(conv, blocks, texts)):
                if block == 0:
                    if state:
                        done.append(state)
                    state = fresh(c)
                for role, body in _TURN.findall(text):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                starts, ends, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                for lo, hi in zip(edges[::2], edges[1::2]):
                    kept = unescape(text[starts[lo]:ends[hi - 1]])
                    state[3] += len(kept)
                    state[4].update(kept.encode())
                state[5] += len(text)
            if done:
                yield result(done)
                done = []
        if state:
            yield result([state])

    return formatted.select("conv_id", "block", "formatted", "ids", "starts", "ends", "mask").mapInArrow(run, DIGESTS)
