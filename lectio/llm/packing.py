"""Order-preserving packing of documents into training windows by dynamic programming.

Documents follow one another by doc_id, each with one end token. A window is cut at the end of a document (no cost), at the
end of a sentence (a truncation penalty) or at any other token (a greater one). The cuts minimise padding plus penalties:
with v(i) = cost(i) + place(i), the best predecessor of a cut is the least v among those at most one capacity back, which a
monotone queue yields in constant time. A cut inside a sentence is only ever best one capacity after the cut before it, and
only where that one is still in the queue when it gets out of reach; so such cuts are made as places leave the queue, and
the result is the best of all cuts at all tokens.

Blocks hold a set number of tokens, counted along the whole sequence, so they don't depend on what the ids are. Token counts
alone are sorted to find where blocks begin; the token ids are then shuffled once, to their block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, flat, joined, ragged, slices, view
from lectio.llm.tokens import encoder, first_free, shipped
from lectio.session import materialise

CAPACITY, SENTENCE, HARD = 2048, 128, 1024
#: Tokens of a block, to the document; blocks are packed apart from one another, so each ends with a window of its own.
BLOCK_TOKENS = 2 << 20
#: Parts of the sequence, each of whole blocks, whose first keys every task knows: 32 bytes for each.
PARTS = 1 << 16

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_NONE = np.iinfo(np.int64).min


def tokenised(column: pa.Array, coder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, where each text's begin; and the token places, within the text, of sentence ends inside it, with where each text's begin."""
    data, _ = view(column)
    at, start, count, piece = coder.parts(column)
    total = np.r_[0, np.cumsum(count)]
    first = total[np.searchsorted(start, at)]
    ids = coder.ids[ragged(coder.start[piece], count)] if len(piece) else coder.ids[:0]
    if not len(data):
        return ids, first, np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    end = np.flatnonzero(_END[data] & np.r_[_GAP[data[1:]], False]) + 1
    end = np.union1d(end, np.flatnonzero(data[:-1] == 10) + 1)
    place = np.unique(total[np.searchsorted(start, end)])
    place = place[~np.isin(place, first)]
    text = np.searchsorted(first, place, "right") - 1
    return ids, first, place - first[text], np.searchsorted(text, np.arange(len(at)))


def cuts(place: list[int], penalty: list[int], capacity: int, hard: int) -> list[int]:
    """Places of the cuts that cost least: place rises from 0, penalty is that of a cut there, hard that of one anywhere else; the last cut is the last place. Of equal costs the longer last window counts."""
    at, value, before = [0], [0], [-1]
    queue = deque([0])
    for j in range(1, len(place)):
        here = place[j]
        while at[queue[0]] < here - capacity:
            i = queue.popleft()
            v = value[i] + capacity + hard
            while queue and value[queue[-1]] > v:
                queue.pop()
            queue.append(len(at))
            at.append(at[i] + capacity)
            value.append(v)
            before.append(i)
        i = queue[0]
        v = value[i] + capacity + penalty[j]  # the window's padding is capacity - here + at[i]; here is added again, as v holds cost + place
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(len(at))
        at.append(here)
        value.append(v)
        before.append(i)
    out, j = [], len(at) - 1
    while j > 0:
        out.append(at[j])
        j = before[j]
    return out[::-1]


def candidates(tokens: np.ndarray, ends: list[np.ndarray], sentence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of documents and sentences of a block, from 0, their penalties, and where documents begin (the end last); each has its end token."""
    begin = np.r_[0, np.cumsum(tokens + 1)]
    inner = np.concatenate([e + b for e, b in zip(ends, begin)]) if ends else np.zeros(0, np.int64)
    place = np.concatenate([begin, inner])
    order = np.argsort(place, kind="stable")
    place, penalty = place[order], np.r_[np.zeros(len(begin), np.int64), np.full(len(inner), sentence)][order]
    new = np.r_[True, place[1:] != place[:-1]]
    return place[new], penalty[new], begin


def windows(tokens: np.ndarray, ends: list[np.ndarray], capacity: int = CAPACITY, sentence: int = SENTENCE, hard: int = HARD) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the windows of a block, and where its documents begin (the end last)."""
    place, penalty, begin = candidates(tokens, ends, sentence)
    return np.array([0, *cuts(place.tolist(), penalty.tolist(), capacity, hard)]), begin


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The values of each text as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _count(docs: DataFrame, vocab: Broadcast) -> DataFrame:
    """(row, key, tie, doc_id, n, ids, ends): texts that have tokens. Rows are in order by key, tie and row: doc_id (null first), digest of the text, and a number that tells rows apart which are the same in both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab.value)
        for batch in batches:
            for part in slices(batch):
                ids, first, ends, begin = tokenised(part.column("text"), coder)
                some = pa.array(np.diff(first) > 0)
                columns = [part.column("doc_id"), part.column("tie"), pa.array(np.diff(first)), _binary(ids, first), _binary(ends.astype(np.uint32), begin)]
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], ["doc_id", "tie", "n", "ids", "ends"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    counted = arrow_map(rows, count, "doc_id long, tie long, n long, ids binary, ends binary")
    return materialise(counted.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(_NONE)).alias("key"), "tie", "doc_id", "n", "ids", "ends"), "tokens")


def _bounds(counted: DataFrame, block_tokens: int, parts: int) -> list[tuple[int, int, int, int]]:
    """(key, tie, row, tokens before) of the first row of each part."""

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, before = TaskContext.get(), 0
        for batch in batches:
            size = batch.column("n").to_numpy() + 1
            total = before + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), context.partitionId())), *(batch.column(c) for c in ("key", "tie", "row")), pa.array(total - size), pa.array(size)], ["pid", "key", "tie", "row", "before", "size"])
            before = int(total[-1]) if len(total) else before

    order = ("key", "tie", "row")
    light = counted.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
    light = materialise(arrow_map(light, along, "pid long, key long, tie long, row long, before long, size long"), "counts")
    sums = sorted((r.pid, r.size) for r in light.groupBy("pid").agg(F.sum("size").alias("size")).collect())
    if not sums:
        return []
    total = np.cumsum([s for _, s in sums]).tolist()
    offsets = light.sparkSession.createDataFrame([(p, t - s) for (p, s), t in zip(sums, total)], "pid long, above long")
    blocks = -(-total[-1] // block_tokens)
    part = F.expr(f"((above + before) DIV {block_tokens}L) DIV {-(-blocks // parts)}L")
    first = light.join(F.broadcast(offsets), "pid").groupBy(part.alias("part")).agg(F.min(F.struct(*order, (F.col("above") + F.col("before")).alias("tokens"))).alias("first"))
    return sorted(tuple(r.first) for r in first.collect())


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, sentence: int = SENTENCE, hard: int = HARD, block_tokens: int = BLOCK_TOKENS, parts: int = PARTS) -> DataFrame:
    """(block, window, doc_ids, starts, ends, n_tokens, padding, tokens): windows of at most `capacity` tokens that hold the documents in order.

    Piece i of a window is the tokens starts[i] to ends[i] of document doc_ids[i]; a document's last token, one beyond those
    of its text, is its end token, whose id is the size of the vocabulary. tokens are the ids of all pieces in a row, without
    the padding. A block has the documents that begin in its block_tokens tokens of the sequence; within it no other cuts, at
    whatever tokens, cost less in padding plus penalties. Every token is in one window, and the windows are the same whatever
    the ids are, as long as they put the documents in the same order. Null and empty texts have no tokens and no place in a
    window. Rows that repeat a doc_id are each packed, in the order of a digest of their text. Rows with a null doc_id come
    first. Further columns are ignored. An empty table gives no rows.
    """
    ranks = shipped(docs.sparkSession, vocab)
    last = first_free(ranks.value)
    counted = _count(docs, ranks)
    bounds = _bounds(counted, block_tokens, parts)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [b[:3] for b in shared.value]
        keys = np.array([b[0] for b in first], np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy()
            part = np.searchsorted(keys, key, "right") - 1
            tied = np.flatnonzero(np.searchsorted(keys, key, "left") <= part)
            if len(tied):
                some = batch.take(pa.array(tied))
                part[tied] = [bisect_right(first, x) - 1 for x in zip(*(some.column(c).to_pylist() for c in ("key", "tie", "row")))]
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", *batch.schema.names])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = [b[3] for b in shared.value]
        held: list[pa.RecordBatch] = []
        now = block = None
        total = 0
        for batch in batches:
            part, at = batch.column("part").to_numpy(), 0
            while at < len(part):
                if part[at] != now:
                    now = int(part[at])
                    total = begins[now]
                end = int(np.searchsorted(part, now, "right"))
                size = batch.column("n").to_numpy()[at:end] + 1
                after = total + np.cumsum(size)
                number = (after - size) // block_tokens
                end = at + int(np.searchsorted(number, number[0], "right"))
                if number[0] != block and held:
                    yield build(block, joined(held))
                    held = []
                block, total = int(number[0]), int(after[end - at - 1])
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield build(block, joined(held))

    def build(block: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        data, at = view(rows.column("ends"))
        inner = np.split(data.copy().view(np.uint32).astype(np.int64), at[1:-1] // 4)
        n = rows.column("n").to_numpy()
        cut, begin = windows(n, inner, capacity, sentence, hard)
        ids = np.full(begin[-1], last, np.int32)
        ids[ragged(begin[:-1], n)] = view(rows.column("ids"))[0].copy().view(np.uint16 if last < 1 << 16 else np.uint32)
        low, high = cut[:-1], cut[1:]
        one = np.searchsorted(begin, low, "right") - 1
        size = np.searchsorted(begin, high, "left") - one
        which = ragged(one, size)
        edges = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        lists = [flat(rows.column("doc_id")).take(pa.array(which)), pa.array(np.maximum(np.repeat(low, size) - begin[which], 0)), pa.array(np.minimum(np.repeat(high, size), begin[which + 1]) - begin[which])]
        columns = [pa.array(np.full(len(low), block)), pa.array(np.arange(len(low))), *(pa.ListArray.from_arrays(edges, x) for x in lists), pa.array(high - low), pa.array(capacity - (high - low)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))]
        return pa.RecordBatch.from_arrays(columns, ["block", "window", "doc_ids", "starts", "ends", "n_tokens", "padding", "tokens"])

    located = arrow_map(counted, locate, "part long, row long, key long, tie long, doc_id long, n long, ids binary, ends binary")
    ordered = located.repartition("part").sortWithinPartitions("part", "key", "tie", "row")
    return arrow_map(ordered, choose, "block long, window long, doc_ids array<long>, starts array<long>, ends array<long>, n_tokens long, padding long, tokens array<int>")
