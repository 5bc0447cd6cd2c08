"""Text columns as numpy arrays: byte views of Arrow strings, words, and hashes of words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lectio.session import importable

#: Bytes of text that are taken up by numpy at once.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    column = flat(column)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most so many bytes; a longer text is a part of its own."""
    _, at = view(batch.column(column))
    n, start = len(at) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that table marks, none across two texts; and the index of each text's first run, with the count of runs last."""
    mark = table[data]
    first, last = mark.copy(), mark.copy()
    if len(mark):
        full = at[:-1] < at[1:]
        first[1:] &= ~mark[:-1]
        last[:-1] &= ~mark[1:]
        begins, ends = at[:-1][full], at[1:][full] - 1
        first[begins] = mark[begins]
        last[ends] = mark[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


_POWERS: dict[str, np.ndarray] = {}


def powers(name: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        got[0] = 1
        got = _POWERS[name] = np.multiply.accumulate(got)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit values: each bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same wherever a span stands: differences of one running sum over all bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", BASE, len(data))[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers("down", INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, lower-cased and without punctuation, and where each text's words begin."""
    hashed, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([flat(column)], ["text"])):
        data, at = view(pc.utf8_lower(part.column("text")))
        start, end, first = spans(data, at, WORD)
        hashed.append(hashes(data, start, end))
        counts.append(np.diff(first))
    return np.concatenate(hashed), np.cumsum(np.concatenate(counts))


_RELEASES: list[Callable[[], None]] = []


def at_release(forget: Callable[[], None]) -> None:
    """Has something forgotten at the end of each task of this worker."""
    _RELEASES.append(forget)


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers outlive their tasks."""
    _POWERS.clear()
    for forget in _RELEASES:
        forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, with this package importable on the workers, and their memory released after each task."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def runs(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew, so that the rows of a key (a null is one) come in one batch; of several keys in a batch, up to most rows at first."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids = part.column(key)
            if held and ids[0].as_py() != last:
                yield joined(held)
                held = []
            last = ids[part.num_rows - 1].as_py()
            same = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
            begin = int(np.flatnonzero(same.to_numpy(zero_copy_only=False))[0])
            if begin:
                yield joined([*held, part.slice(0, begin)])
                held = []
            held.append(part.slice(begin))
    if held:
        yield joined(held)


def edges(ids: pa.Array) -> np.ndarray:
    """Where each run of equal ids begins, and the number of ids last."""
    n = len(ids)
    if not n:
        return np.zeros(1, np.int64)
    void = pc.is_null(ids).to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero((value[1:] != value[:-1]) | (void[1:] != void[:-1])) + 1, n]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin, begin + 1, ... of each run, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
