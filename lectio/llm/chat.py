"""Chat formatting: conversations become one training text each, put together as columns of bytes.

A turn is five segments (opening, role, line break, text, closing). Their lengths give each segment's offset by one running
sum; the bytes of a whole column then go to their places in one preallocated buffer by one scatter, and that buffer is the
Arrow column which is returned. No string is made per turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, edges, ragged, runs, view

OPEN, BREAK, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TRAINED = "assistant"
#: Bytes of text that are put together at once; a longer conversation is put together by itself.
PART_BYTES = 4 << 20
#: What a string of Spark can hold.
MOST_BYTES = (1 << 31) - 1


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The text of each conversation (whose turns begin at first), and for each turn where its content lies in the buffer."""
    (role_data, role_at), (text_data, text_at) = view(role), view(text)
    n = len(role_at) - 1
    length = np.empty((n, 5), np.int64)
    length[:, 0], length[:, 2], length[:, 4] = len(OPEN), len(BREAK), len(CLOSE)
    length[:, 1], length[:, 3] = np.diff(role_at), np.diff(text_at)
    end = np.cumsum(length.ravel()).reshape(n, 5)
    begin = end - length
    if n and end[-1, -1] > MOST_BYTES:
        raise ValueError(f"a conversation of {end[-1, -1]} bytes can't be one string")
    out = np.empty(int(end[-1, -1]) if n else 0, np.uint8)
    for place, mark in ((0, OPEN), (2, BREAK), (4, CLOSE)):
        out[begin[:, place, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    out[ragged(begin[:, 1], length[:, 1])] = role_data
    out[ragged(begin[:, 3], length[:, 3])] = text_data
    offsets = np.r_[begin[:, 0], len(out)][first].astype(np.int32)
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets), pa.py_buffer(out)), begin[:, 3], end[:, 3]


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_bytes, trained_bytes, text): one row for each conversation, its turns in order.

    A turn is "<|im_start|>role\\ntext<|im_end|>\\n". trained_bytes counts the bytes of the assistant's texts, which a loss
    mask keeps. "<|" inside a role or text becomes "< |", so no content can open or close a turn. A null role or text is
    empty; a null turn comes first; turns with the same number are ordered by role, then text, and rows that repeat are each
    a turn. Rows with a null conv_id are one conversation, whose id is null. Further columns are ignored. A
    conversation that is longer than a string can be (2 GiB) is an error. An empty table gives no rows.
    """
    clean = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), clean("role"), clean("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "conv_id"):
            first = edges(batch.column("conv_id"))
            size = np.r_[0, np.cumsum(np.diff(view(batch.column("text"))[1]))][first]
            at = 0
            while at < len(first) - 1:
                to = max(at + 1, int(np.searchsorted(size, size[at] + PART_BYTES, "right")) - 1)
                part = batch.slice(first[at], first[to] - first[at])
                begin = first[at : to + 1] - first[at]
                text, start, end = assemble(part.column("role"), part.column("text"), begin)
                mine = pa.compute.equal(part.column("role"), TRAINED).to_numpy(zero_copy_only=False)
                trained = np.add.reduceat(np.where(mine, end - start, 0), begin[:-1])
                yield pa.RecordBatch.from_arrays([part.column("conv_id").take(pa.array(begin[:-1])), pa.array(np.diff(begin)), pa.array(np.diff(np.frombuffer(text.buffers()[1], np.int32)).astype(np.int64)), pa.array(trained), text], ["conv_id", "n_turns", "n_bytes", "trained_bytes", "text"])
                at = to

    return arrow_map(turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), build, "conv_id long, n_turns long, n_bytes long, trained_bytes long, text string")


ORACLE = """
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
     f AS (SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END) AS BIGINT) AS trained_bytes,
                  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
           FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, strlen(text) AS n_bytes, trained_bytes, text FROM f
"""
