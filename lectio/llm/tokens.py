"""Byte-level BPE over whole columns: texts are cut into pieces in numpy, and only pieces not seen before reach the tokenizer.

The cut is the one of the usual byte-level pattern (contractions, runs of letters, numbers or other signs with the space
before them, white space). Pieces are told apart by 64-bit hashes; each worker keeps the token ids of those it has seen, up
to a bounded number, so the cost of a text is that of a few array operations on its bytes.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from lectio.llm.blocks import at_release, hashes, view

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; when there are more it starts anew.
MEMORY = 1 << 17
#: A vocabulary that is sent to the workers has so many bytes at most.
MOST_BYTES = 64 << 20

SIGN, LETTER, NUMBER, BLANK = 0, 1, 2, 3


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the public vocabulary of that name lies on this machine; any other path to a file of ranks does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The bytes of a file of ranks, read on the driver and sent to all workers, which need no such file. At most MOST_BYTES."""
    path = path or vocabulary()
    if Path(path).stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))[0]
        if category in "LN":
            kind[c] = LETTER if category == "L" else NUMBER
    kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kind


def pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each piece begins, for UTF-8 texts that lie between the offsets `at`; no piece spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[lead].astype(np.int32)
    if len(lead) < len(data):
        for bits, mask, low in ((1, 0x1F, 0xC0), (2, 0x0F, 0xE0), (3, 0x07, 0xF0)):
            some = np.flatnonzero((data[lead] >= low) & (data[lead] <= low + mask))
            got = data[lead[some]].astype(np.int32) & mask
            for i in range(1, bits + 1):
                got = got << 6 | (data[np.minimum(lead[some] + i, len(data) - 1)].astype(np.int32) & 0x3F)
            code[some] = got
    kind = classes()[code]
    n = len(lead)
    new = np.zeros(n + 1, bool)  # of a text
    new[np.searchsorted(lead, at)] = True
    begin = np.r_[True, kind[1:] != kind[:-1]] | new[:-1]
    last = np.r_[begin[1:], True]
    blank = kind == BLANK
    follows = np.r_[~blank[1:], False] & ~new[1:]  # something else comes next in this text
    tail = blank & last & follows  # the last blank before a piece stands apart from the blanks before it
    begin = begin | tail
    joined = np.r_[False, (tail & (code == 32))[:-1]]
    begin &= ~joined
    quote = np.flatnonzero((code == 39) & begin & np.r_[(kind[1:] == LETTER), False] & ~new[1:])
    if len(quote):
        at2 = lambda i: np.where((quote + i < n) & (np.cumsum(new)[np.minimum(quote + i, n)] == np.cumsum(new)[quote]), code[np.minimum(quote + i, n - 1)], 0)
        a, b = at2(1), at2(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit, size = quote[size > 0], size[size > 0]
        begin[hit + 1] = False
        after = hit + size + 1
        after = after[after < n]
        begin[after[kind[after] == LETTER]] = True
    return lead[begin]


class Encoder:
    """Token ids of texts by a file of ranks, given as its path or its bytes. vocabulary is the first free id, kind the type that holds it."""

    def __init__(self, source: str | bytes) -> None:
        import tiktoken

        lines = (source if isinstance(source, bytes) else Path(source).read_bytes()).splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = max(ranks.values()) + 1
        self.kind = np.uint16 if self.vocabulary < 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.count, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.kind), 0

    def _learn(self, new: list[int], raw: list[bytes]) -> None:
        ids = list(map(self.plain._encode_single_piece, raw))
        n = len(self.known)
        self.known.update(zip(new, range(n, n + len(new))))
        while len(self.start) < n + len(new):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        while len(self.ids) < self.used + size.sum():
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.count[n : n + len(new)] = size
        self.start[n : n + len(new)] = self.used + np.cumsum(size) - size
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a column: bytes' offsets of texts, where the pieces begin, the tokens that each has, and what identifies it here."""
        data, at = view(column)
        start = pieces(data, at)
        if not len(start):
            return at, start, np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.r_[start[1:], len(data)]
        value, first, back = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(value) > MEMORY:
            self._forget()
        value = value.tolist()
        where = [self.known.get(v, -1) for v in value]
        lack = [i for i, w in enumerate(where) if w < 0]
        if lack:
            f = first[lack]
            raw = data.tobytes()
            self._learn([value[i] for i in lack], [raw[s:e] for s, e in zip(start[f].tolist(), end[f].tolist())])
            where = [self.known[v] for v in value]
        piece = np.array(where, np.int64)[back]
        return at, start, self.count[piece], piece

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts in a row, and where each text's begin; nulls have none."""
        at, start, count, piece = self.parts(column)
        total = np.r_[0, np.cumsum(count)]
        where = np.arange(total[-1]) + np.repeat(self.start[piece] - total[:-1], count)
        return self.ids[where], total[np.searchsorted(start, at)]


@functools.lru_cache(2)
def encoder(source: str | bytes) -> Encoder:
    """The encoder of a vocabulary, which a worker keeps; what it has learnt of a task's texts goes when the task ends."""
    made = Encoder(source)
    at_release(made._forget)
    return made


def first_free(source: bytes) -> int:
    """The first id beyond those of a file of ranks."""
    return 1 + max(int(line.split()[1]) for line in source.splitlines() if line)
