"""Token ids as wavelet matrices: one compressed file for each shard, from which tokens can be read, counted and found.

Plane b of the matrix holds the b-th highest bit of every token, the tokens being stably parted into zeros and ones after
each plane. With the count of ones before each block, a token at a place is read by one rank a plane, the occurrences of a
token are an interval that narrows by two ranks a plane, and a place is found by going back up by selects. Blocks are
compressed one by one, so a query unpacks only the blocks that it touches.

File: magic, version and counts; zeros of each plane; ones before each block; the length of each packed block; where each
document begins; document ids; the packed blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import SLICE_BYTES, arrow_map, slices
from lectio.llm.tokens import encoder, shipped

MAGIC, BLOCK = b"WVM1", 1 << 15
HEAD = struct.Struct("<4sHHIIQ")
#: Tokens of a shard: a shard ends with the text that brings it to so many.
SHARD_TOKENS = 2 << 20


def build(tokens: np.ndarray, first: np.ndarray, ids: np.ndarray, level: int = 1) -> bytes:
    """The file of some documents: their tokens, where each one's begin (the count of tokens last), and their ids."""
    n = len(tokens)
    planes = max(1, int(tokens.max(initial=0)).bit_length())
    blocks = -(-n // BLOCK)
    zeros, ones, sizes, packed = np.zeros(planes, np.uint64), np.zeros((planes, blocks + 1), np.uint64), np.zeros((planes, blocks), np.uint32), []
    press = zstandard.ZstdCompressor(level=level)
    for p in range(planes):
        bit = (tokens >> (planes - 1 - p) & 1).astype(bool)
        raw = np.packbits(bit)
        count = np.add.reduceat(bit, np.arange(0, n, BLOCK), dtype=np.uint64) if n else np.zeros(0, np.uint64)
        np.cumsum(count, out=ones[p, 1:])
        zeros[p] = n - int(ones[p, -1])
        for b in range(blocks):
            packed.append(press.compress(raw[b * BLOCK // 8 : (b + 1) * BLOCK // 8].tobytes()))
            sizes[p, b] = len(packed[-1])
        tokens = np.concatenate([tokens[~bit], tokens[bit]])
    return b"".join([HEAD.pack(MAGIC, 1, planes, BLOCK, len(ids), n), zeros.tobytes(), ones.tobytes(), sizes.tobytes(), first.astype(np.uint64).tobytes(), ids.astype(np.int64).tobytes(), *packed])


class Wavelet:
    """Queries on one file. Places count tokens from 0."""

    def __init__(self, file: bytes) -> None:
        magic, version, self.planes, self.block, docs, self.n = HEAD.unpack_from(file)
        if (magic, version) != (MAGIC, 1):
            raise ValueError("not a wavelet file")
        blocks, at = -(-self.n // self.block), HEAD.size

        def take(kind: type, *shape: int) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape))
            got = np.frombuffer(file, kind, size, at).reshape(shape)
            at += got.nbytes
            return got

        self.zeros = take(np.uint64, self.planes).astype(np.int64)
        self.ones = take(np.uint64, self.planes, blocks + 1).astype(np.int64)
        sizes = take(np.uint32, self.planes, blocks)
        self.first, self.ids = take(np.uint64, docs + 1).astype(np.int64), take(np.int64, docs)
        self.where = at + np.r_[0, np.cumsum(sizes.ravel(), dtype=np.int64)]
        self.file, self.cache, self.unpack = file, {}, zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return self.n

    def bits(self, plane: int, block: int) -> np.ndarray:
        got = self.cache.get((plane, block))
        if got is None:
            k = plane * (self.ones.shape[1] - 1) + block
            raw = self.unpack.decompress(self.file[self.where[k] : self.where[k + 1]])
            got = self.cache[plane, block] = np.unpackbits(np.frombuffer(raw, np.uint8))[: min(self.block, self.n - block * self.block)]
        return got

    def ones_before(self, plane: int, at: int) -> int:
        block, rest = divmod(at, self.block)
        return int(self.ones[plane, block]) + (int(np.count_nonzero(self.bits(plane, block)[:rest])) if rest else 0)

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for p in range(self.planes):
            bit = int(self.bits(p, at // self.block)[at % self.block])
            before = self.ones_before(p, at)
            at = int(self.zeros[p]) + before if bit else at - before
            token = token << 1 | bit
        return token

    def _interval(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self.ones_before(p, low), self.ones_before(p, high)
            low, high = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (low - a, high - b)
            if low == high:
                break
        return low, high

    def rank(self, token: int, at: int) -> int:
        """How often the token stands before a place."""
        low, high = self._interval(token, 0, max(0, min(at, self.n)))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of this kind stands in a plane."""
        edge = self.ones[plane] if bit else np.minimum(np.arange(self.ones.shape[1]) * self.block, self.n) - self.ones[plane]
        block = int(np.searchsorted(edge, k, "right")) - 1
        return block * self.block + int(np.flatnonzero(self.bits(plane, block) == bit)[k - int(edge[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of the token."""
        low, high = self._interval(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            at = self._place(p, bit, at - int(self.zeros[p]) if bit else at)
        return at

    def _gather(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a plane at some places, and the ones before each; each block that is touched is unpacked once."""
        bit, before = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        block = at // self.block
        for b in np.unique(block).tolist():
            some = np.flatnonzero(block == b)
            bits = self.bits(plane, b)
            rest = at[some] - b * self.block
            total = np.cumsum(bits, dtype=np.int64)
            bit[some] = bits[rest]
            before[some] = self.ones[plane, b] + total[rest] - bit[some]
        return bit, before

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the token, in order."""
        low, high = self._interval(token, 0, self.n)
        at = np.arange(low, high)
        for p in reversed(range(self.planes)):
            if not len(at):
                break
            bit = token >> (self.planes - 1 - p) & 1
            k = at - int(self.zeros[p]) * bit
            edge = self.ones[p] if bit else np.minimum(np.arange(self.ones.shape[1]) * self.block, self.n) - self.ones[p]
            block = np.searchsorted(edge, k, "right") - 1
            at = np.empty(len(k), np.int64)
            for b in np.unique(block).tolist():
                some = np.flatnonzero(block == b)
                at[some] = b * self.block + np.flatnonzero(self.bits(p, b) == bit)[k[some] - edge[b]]
        return np.sort(at)

    def read(self, low: int, high: int) -> np.ndarray:
        """The tokens from one place to another, one rank a plane for all of them at once."""
        at, out = np.arange(low, high), np.zeros(high - low, np.int64)
        for p in range(self.planes):
            bit, before = self._gather(p, at)
            at = np.where(bit == 1, int(self.zeros[p]) + before, at - before)
            out = out << 1 | bit
        return out

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes from the last."""
        order, out = np.arange(self.n), np.zeros(self.n, np.int64)
        for p in range(self.planes):
            bit = np.concatenate([self.bits(p, b) for b in range(self.ones.shape[1] - 1)]).astype(bool) if self.n else np.zeros(0, bool)
            out[order] = out[order] << 1 | bit
            order = np.concatenate([order[~bit], order[bit]])
        return out

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.first[i]), int(self.first[i + 1]))


def shard_files(docs: DataFrame, vocab: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, n_docs, n_tokens, doc_ids, file): the texts as token ids, in files of about shard_tokens tokens.

    Each text's tokens end with one more, whose id is the size of the vocabulary; null and empty texts have that one alone.
    Every row is in one file, also those that repeat a doc_id. A null doc_id is null in doc_ids and -1 in the file. Texts
    stay in the task that reads them, so shards follow the partitions of docs (shard is partition and number); a text is
    never cut, however long. Further columns are ignored. An empty table gives no rows.
    """
    ranks = shipped(docs.sparkSession, vocab)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, context = encoder(ranks.value), TaskContext.get()
        held: list[tuple] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            tokens, count, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
            file = build(tokens, np.r_[0, np.cumsum(count)], ids.fill_null(-1).to_numpy(zero_copy_only=False))
            row = pa.RecordBatch.from_arrays([pa.array([f"{context.partitionId() if context else 0}-{number}"]), pa.array([len(count)]), pa.array([len(tokens)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([file], pa.binary())], ["shard", "n_docs", "n_tokens", "doc_ids", "file"])
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            for part in slices(batch, most=min(SLICE_BYTES, 4 * shard_tokens)):
                ids, first = coder.encode(part.column("text"))
                count = np.diff(first)
                out = np.full(len(ids) + len(count), coder.vocabulary, coder.kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                held.append((out, count + 1, part.column("doc_id")))
                size += len(out)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), pack, "shard string, n_docs long, n_tokens long, doc_ids array<long>, file binary")


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(shard, doc_id, place): each occurrence of a token, place counting tokens of its document from 0; doc_id is -1 where it was null."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file in zip(batch.column("shard").to_pylist(), batch.column("file")):
                wave = Wavelet(file.as_py())
                at = wave.occurrences(token)
                doc = np.searchsorted(wave.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(at), pa.string()), pa.array(wave.ids[doc]), pa.array(at - wave.first[doc])], ["shard", "doc_id", "place"])

    return arrow_map(files.select("shard", "file"), find, "shard string, doc_id long, place long")
