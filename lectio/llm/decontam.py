"""Benchmark decontamination with suffix arrays over the training texts.

Each task cuts its partition into shards of bounded size and builds the suffix array of a shard over words: equal words get
equal ranks, three ranks make the first sort key, and prefix doubling settles the suffixes that still tie, until they
differ or agree in as many words as the longest test text has. Every suffix of every test text is then searched in the
array, all of them at once, one halving a step. What matches in at least min_words words is a leak: all places that match
are found, and for each the longest verbatim run.

Texts never move: an array lives in the task that has the texts, and only the test suffixes are sent to it. They are
broadcast in chunks of a checked size, of which a task holds one at a time. However many there are, the texts are read once
and their arrays built once; what grows with the benchmark is the searching alone, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, flat, ragged, words

#: Words of a run that make a leak; a test text that is shorter leaks as a whole, and one under SHORTEST words where it is all of a document.
MIN_WORDS, SHORTEST = 13, 5
#: Text of one shard, and test text that is broadcast at once: 8 bytes for a word, so 32 MB at most, and about 11 for usual words.
SHARD_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of values, and for each place in it the first place with an equal value."""
    order = np.argsort(values)
    got = values[order]
    head = np.flatnonzero(np.r_[True, got[1:] != got[:-1]]) if len(got) else np.zeros(0, np.int64)
    return order, np.repeat(head, np.diff(np.r_[head, len(got)]))


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of seq (ranks from 0, all under 2**21 or else compared one by one) in the order of their first depth ranks."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    k = 3 if int(seq.max()) < 1 << 21 else 1
    key = seq.astype(np.int64)
    for i in range(1, k):
        key <<= 21
        key[: n - i] |= seq[i:]
    order, head = _ranked(key)
    rank = np.empty(n, np.int64)
    rank[order] = head
    while k < depth:
        tied = np.flatnonzero((np.r_[head[1:], n] == head) | (head != np.arange(n)))  # places whose group has more than one suffix
        if not len(tied):
            break
        who = order[tied]
        beyond = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
        turn = np.lexsort((beyond, head[tied]))
        who, beyond, group = who[turn], beyond[turn], head[tied][turn]
        order[tied] = who
        new = np.r_[True, (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])]
        begin = np.flatnonzero(new)
        head[tied] = np.repeat(tied[begin], np.diff(np.r_[begin, len(tied)]))
        rank[who] = head[tied]
        k *= 2
    return order


class Tests:
    """Test texts as one sequence of word hashes, which is all that is broadcast."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int = MIN_WORDS, shortest: int = SHORTEST) -> None:
        self.hashed, self.first = words(pa.array(texts, pa.string()))
        self.ids, self.depth = np.array(ids, np.int64), int(np.diff(self.first).max(initial=1))
        self.min_words, self.shortest = min_words, shortest

    def suffixes(self) -> None:
        """A suffix for each place where a leak may begin: its item and word, where it lies, and the words it needs."""
        count = np.diff(self.first)
        need = np.minimum(self.min_words, count)
        starts = np.where(count > 0, count - need + 1, 0)
        self.item = np.repeat(np.arange(len(count)), starts)
        self.word = np.arange(len(self.item)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.at, self.end, self.need = self.first[self.item] + self.word, self.first[self.item + 1], need[self.item]

    def __len__(self) -> int:
        return len(self.hashed)


def _common(seq: np.ndarray, at: np.ndarray, test: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes of seq at `at` and the test texts from begin to end have in common."""
    n = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        i, j = at[live] + n[live], begin[live] + n[live]
        ok = (i < len(seq)) & (j < end[live])
        live, i, j = live[ok], i[ok], j[ok]
        live = live[seq[i] == test[j]]
        n[live] += 1
    return n


def _bound(seq: np.ndarray, order: np.ndarray, test: np.ndarray, begin: np.ndarray, end: np.ndarray, upper: bool) -> np.ndarray:
    """For each test run, the first place of the array whose suffix isn't under it (upper: is over it, beyond its extensions)."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        at = order[mid]
        n = _common(seq, at, test, begin[live], end[live])
        whole = begin[live] + n >= end[live]
        mine = test[np.minimum(begin[live] + n, len(test) - 1)]
        theirs = np.where(at + n < len(seq), seq[np.minimum(at + n, len(seq) - 1)], -1)
        under = np.where(whole, upper, theirs < mine)
        low[live] = np.where(under, mid + 1, low[live])
        high[live] = np.where(under, high[live], mid)
        live = live[low[live] < high[live]]
    return low


class Shard:
    """The suffix array of some texts over words."""

    def __init__(self, texts: pa.Array, depth: int) -> None:
        hashed, self.first = words(texts)
        self.count = np.diff(self.first)
        # Ranks of words from 1 on; 0 ends each text. The array holds them doubled, so that a test word that no text has falls between.
        order, head = _ranked(hashed)
        new = head == np.arange(len(head))
        self.known = hashed[order[new]]
        seq = np.zeros(len(hashed) + len(self.count), np.int64)
        seq[order + np.repeat(np.arange(len(self.count)), self.count)[order]] = np.cumsum(new)
        self.array = suffix_array(seq, depth)[len(self.count) :]  # the ends of texts come first
        self.seq = seq * 2

    def search(self, tests: Tests) -> dict[str, np.ndarray]:
        """The leaks of a shard, for each text and test text the longest run (of equals the first): text and item are indices, doc_word and item_word count words from 0."""
        none = {k: np.zeros(0, np.int64) for k in ("text", "item", "n_words", "doc_word", "item_word")}
        if not len(self.array) or not len(tests):
            return none
        tests.suffixes()
        place = np.searchsorted(self.known, tests.hashed)
        found = (place < len(self.known)) & (self.known[np.minimum(place, len(self.known) - 1)] == tests.hashed)
        test = np.where(found, 2 * (place + 1), 2 * place + 1)
        low = _bound(self.seq, self.array, test, tests.at, tests.at + tests.need, False)
        high = _bound(self.seq, self.array, test, tests.at, tests.at + tests.need, True)
        hit = np.flatnonzero(low < high)
        if not len(hit):
            return none
        size = (high - low)[hit]
        where = self.array[ragged(low[hit], size)]
        which = np.repeat(hit, size)
        begin = self.first[:-1] + np.arange(len(self.count))
        text = np.searchsorted(begin, where, "right") - 1
        short = tests.end[which] - tests.at[which] < tests.shortest
        whole = (where == begin[text]) & (self.count[text] == tests.need[which]) & (tests.word[which] == 0)
        some = ~(short & (tests.need[which] < tests.shortest)) | whole
        where, which, text = where[some], which[some], text[some]
        n = _common(self.seq, where, test, tests.at[which], tests.end[which])
        doc_word, item, item_word = where - begin[text], tests.item[which], tests.word[which]
        best = np.lexsort((item_word, doc_word, -n, item, text))
        keep = best[np.r_[True, (text[best][1:] != text[best][:-1]) | (item[best][1:] != item[best][:-1])]] if len(best) else best
        return {"text": text[keep], "item": item[keep], "n_words": n[keep], "doc_word": doc_word[keep], "item_word": item_word[keep]}


def search(texts: pa.Array, tests: Tests) -> dict[str, np.ndarray]:
    return Shard(texts, tests.depth).search(tests)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to shards of about so many bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = np.nan_to_num(flat(pa.compute.binary_length(batch.column("text"))).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        total = np.cumsum(lengths)
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + shard_bytes - size, "right")))
            held.append(batch.slice(start, end - start))
            size += int(total[min(end, batch.num_rows) - 1]) - before
            start = end
            if size >= shard_bytes or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _chunks(benchmark: DataFrame, min_words: int, shortest: int, chunk_bytes: int) -> tuple[list, int]:
    """Broadcasts of the benchmark, each of about chunk_bytes of text at most, and the words of its longest text. The driver has one chunk at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, depth, out = 1 + total // chunk_bytes, 1, []
    for c in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == c)).collect()
        tests = Tests([r[0] for r in rows], [r[1] for r in rows], min_words, shortest)
        depth = max(depth, tests.depth)
        out.append(spark.sparkContext.broadcast(tests))
    return out, depth


def _each(chunks: list) -> Iterator[Tests]:
    """The chunks one after another; where there are several, none is kept in memory when the next is loaded."""
    for chunk in chunks:
        yield chunk.value
        if len(chunks) > 1:
            chunk.__dict__.pop("_value", None)


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, shortest: int = SHORTEST, shard_bytes: int = SHARD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): for each document and test text that share a run of min_words words,
    the longest such run and where it begins in either, in words from 0.

    Words are compared in lower case and without punctuation. A test text under min_words words leaks as a whole; one under
    `shortest` words where it is the whole of a document, as it may occur anywhere by chance. Of runs of equal length the
    first in the document counts, then the first in the test text. Null texts and empty ones have no runs; rows with a null
    doc_id are reported with it; null item_ids take no part. Rows that repeat a doc_id are each searched, and the longest run
    of each (doc_id, item_id) is reported once. An empty benchmark has no leaks, and neither have empty docs. Further columns
    are ignored, whatever they are called.
    """
    schema = "doc_id long, item_id long, n_words long, doc_word long, item_word long"
    names = ["doc_id", "item_id", "n_words", "doc_word", "item_word"]
    chunks, depth = _chunks(benchmark, min_words, shortest, chunk_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, shard_bytes):
            shard = Shard(part.column("text"), depth)
            for tests in _each(chunks):
                got = shard.search(tests)
                if len(got["text"]):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(got["text"])), pa.array(tests.ids[got["item"]]), *(pa.array(got[k]) for k in names[2:])], names)

    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return arrow_map(data, scan, schema).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_words", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, shortest: int = SHORTEST, shard_bytes: int = SHARD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without the rows that leaks() would report, all columns as they are. Null and empty texts stay; empty docs give no rows."""
    chunks, depth = _chunks(benchmark, min_words, shortest, chunk_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, shard_bytes):
            shard, clean = Shard(part.column("text"), depth), np.ones(part.num_rows, bool)
            for tests in _each(chunks):
                clean[shard.search(tests)["text"]] = False
            yield part.filter(pa.array(clean))

    return arrow_map(docs, keep, docs.schema)
