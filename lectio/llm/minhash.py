"""Near duplicates: an inverted join over the coordinates of MinHash signatures.

Each text has a signature of K minima over its word shingles. Every (coordinate, value) pair is a token with a posting
list of the texts that have it; two texts are near duplicates when they collide in at least M of the K coordinates.

Prefix: tokens have one global order, rarest first. Of texts that collide M times, the first K - M + 1 tokens of both must
share one, so only those are posted. A token that a single text has can't collide, yet takes up a place in the prefix, so
nearly all unrelated texts end with no postings, however often a boilerplate line gives them a token in common.
Skip: the long lists, which are all behind the prefix, are never merged; a candidate's collisions in them are counted by
probing the two signatures, which the postings carry. A pair counts at its first common token only.

Identical signatures are one class, so copies cost nothing in the join. A list that may hold more than LIST classes is cut
into blocks, and each pair of blocks is a list of its own: no task holds more than two blocks, whatever the token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, joined, mix, ragged, slices, words
from lectio.session import materialise

K, M, SHINGLE = 64, 28, 3
#: Removed ids are broadcast up to this many bytes and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20
#: Classes of a block of a posting list.
LIST = 16_384
#: Rows and columns of signatures that are compared at once; lists up to SMALL are compared together, so many pairs at once.
TILE, SMALL, PAIRS = 512, 96, 1 << 14

_SEEDS = mix(np.arange(1, 2 * 1024 + 1, dtype=np.uint64))


def _sign(hashed: np.ndarray, first: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the indices of the texts that have words."""
    count = np.diff(first)
    some = np.flatnonzero(count)
    if not len(some):
        return np.zeros((0, k), np.uint32), some
    # A shingle at each word but the last n - 1 of a text; a shorter text is one shingle.
    length = np.maximum(count[some] - n + 1, 1)
    begin = np.zeros(len(some), np.int64)
    np.cumsum(length[:-1], out=begin[1:])
    where = np.arange(begin[-1] + length[-1]) + np.repeat(first[some] - begin, length)
    end = np.repeat(first[some] + count[some], length)
    shingle = np.zeros(len(where), np.uint64)
    for i in range(n):
        at = where + i
        inside = at < end
        shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, hashed[np.minimum(at, len(hashed) - 1)], np.uint64(i))
    low = (mix(shingle) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(some), k), np.uint32)
    for j in range(k):
        flip, odd = np.uint32(_SEEDS[2 * j] & 0xFFFFFFFF), np.uint32(int(_SEEDS[2 * j + 1]) & 0xFFFFFFFF | 1)
        turned = (low ^ flip) * odd
        turned ^= turned >> np.uint32(15)
        turned *= np.uint32(0x2C1B3C6D)
        out[:, j] = np.minimum.reduceat(turned, begin)
    return out, some


def signatures(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig): K unsigned 32-bit minima of each text that has a word and a doc_id."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sig, some = _sign(*words(part.column("text")), k, shingle)
                if len(some):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.Array.from_buffers(pa.binary(4 * k), len(some), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())], ["doc_id", "sig"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), sign, "doc_id long, sig binary")


def _tokens(classes: DataFrame, k: int) -> DataFrame:
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, k).astype(np.int64)
            token = sig + (np.arange(k, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), k)), pa.array(token.ravel())], ["node", "token"])

    return arrow_map(classes.select("node", "sig"), tokens, "node long, token long")


def _order(q: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The global order of tokens: by how common they are, ties by hash."""
    return (q.astype(np.uint64) << np.uint64(56)) | (mix(token.astype(np.uint64)) >> np.uint64(8))


def _postings(candidates: DataFrame, k: int, m: int, most: int) -> DataFrame:
    """(token, i, j, side, node, rep, size, packed): the prefix of each class; a token that more than `most` classes may have is posted once for each pair (i, j) of blocks that the class is in."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            token, q = flat.field("token").to_numpy(), flat.field("q").to_numpy().astype(np.uint8)
            row = np.repeat(np.arange(len(size)), size)
            values, ranks = np.zeros((len(size), k), np.uint32), np.zeros((len(size), k), np.uint8)
            values[row, token >> 32] = token & 0xFFFFFFFF
            ranks[row, token >> 32] = q
            sort = np.lexsort((_order(q, token), row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            head = place < size[row] - m + 1
            token, q, row = token[sort][head], q[sort][head], row[head]
            packed = pa.array([v.tobytes() + r.tobytes() for v, r in zip(values, ranks)], pa.binary())
            blocks = np.ceil(2.0 ** ((q.astype(float) + 1) / 8) / most).astype(np.int64)
            mine = (mix(batch.column("node").to_numpy(zero_copy_only=False)[row].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            total = np.r_[0, np.cumsum(blocks)]
            for at in range(0, int(total[-1]), 4096):
                line = np.arange(at, min(at + 4096, int(total[-1])))
                p = np.searchsorted(total, line, "right") - 1
                own, other = mine[p], line - total[p]
                part = pa.array(row[p])
                columns = [pa.array(token[p]), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own > other), *(batch.column(c).take(part) for c in ("node", "rep", "size")), packed.take(part)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "i", "j", "side", "node", "rep", "size", "packed"])

    return arrow_map(candidates, post, "token long, i long, j long, side boolean, node long, rep long, size long, packed binary")


def _codes(packed: list[bytes], k: int, m: int, own: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which members of a list have M tokens that some other member has; for these and each coordinate a small code of such a
    token, the same for equal ones and 0 for all others; and, with an own token, the codes of tokens that come before it."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 5 * k)
    values, ranks = raw[:, : 4 * k].copy().view(np.uint32), raw[:, 4 * k :]
    token = values.astype(np.int64) + (np.arange(k, dtype=np.int64) << 32)
    some = np.flatnonzero((ranks > 0).ravel())
    value, first, back, count = np.unique(token.ravel()[some], return_index=True, return_inverse=True, return_counts=True)
    shared = count > 1
    column = value >> 32
    number = np.cumsum(shared)
    start = np.r_[0, number][np.searchsorted(column, np.arange(k))]
    code = np.where(shared, number - start[column], 0)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if int(code.max(initial=0)) < np.iinfo(t).max)
    codes = np.zeros(token.size, kind)
    codes[some] = code[back]
    codes = codes.reshape(-1, k)
    live = np.flatnonzero((codes > 0).sum(1) >= m)
    before = np.zeros((k, 0), kind)
    if own is not None and len(live) > 1:
        order = _order(ranks.ravel()[some[first]], value)
        early = np.zeros(token.size, kind)
        early[some] = np.where(order < order[np.searchsorted(value, own)], code, 0)[back]
        before = early.reshape(-1, k)[live].T.copy()
    return live, codes[live].T.copy(), before


def _other(codes: np.ndarray) -> np.ndarray:
    """The codes with a second sign for none, so that none equals none of the first."""
    return np.where(codes == 0, np.iinfo(codes.dtype).max, codes).astype(codes.dtype)


def _count(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Collisions of each member of left with each of right, both by coordinate."""
    out, same = np.zeros((left.shape[1], right.shape[1]), np.uint8 if len(left) < 256 else np.uint16), np.empty((left.shape[1], right.shape[1]), bool)
    for a, b in zip(left, right):
        np.equal(a[:, None], b[None], out=same)
        np.add(out, same, out=out)
    return out


def _hits(codes: np.ndarray, before: np.ndarray, side: np.ndarray, across: bool, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of members with M collisions that have no token before in common, and how many; across: only of different sides."""
    n, other = codes.shape[1], _other(codes)
    used = np.flatnonzero(before.any(1)) if before.shape[1] else np.zeros(0, np.int64)
    used = used[np.argsort([-np.bincount(before[c])[1:].max(initial=0) for c in used], kind="stable")]
    mine, theirs = (before[used], _other(before[used])) if len(used) else (codes[:0], codes[:0])
    for s in range(0, n, TILE):
        for t in range(s, n, TILE):
            i, j = slice(s, min(s + TILE, n)), slice(t, min(t + TILE, n))
            live = side[i, None] != side[None, j] if across else np.ones((i.stop - s, j.stop - t), bool)
            if s == t:
                live &= np.triu(np.ones_like(live), 1)
            for x, (a, b) in enumerate(zip(mine[:, i], theirs[:, j])):
                live &= a[:, None] != b[None]
                if x % 4 == 0 and not live.any():
                    break
            if not live.any():
                continue
            if live.mean() < 0.02:
                a, b = np.nonzero(live)
                found = (codes[:, s + a] == other[:, t + b]).sum(0)
                keep = found >= m
                a, b, found = a[keep], b[keep], found[keep]
            else:
                count = _count(codes[:, i], other[:, j])
                a, b = np.nonzero(live & (count >= m))
                found = count[a, b]
            if len(a):
                yield s + a, t + b, found.astype(np.int32)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its group) after the groups of a and b are joined."""
    while True:
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        differ = high != low
        if not differ.any():
            return label
        a, b, parent = a[differ], b[differ], np.arange(len(label))
        np.minimum.at(parent, high[differ], low[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _connect(codes: np.ndarray, m: int) -> np.ndarray:
    """Labels of the groups that M collisions connect. Members that are connected already aren't compared, so a list of copies
    takes one pass; once several members in a row turn out to be alone, those left are compared all with all."""
    label = np.arange(codes.shape[1])
    rest, mine, theirs, alone = label.copy(), codes, _other(codes), 0
    while len(rest) > 1 and alone < 8:
        root, front, alone = rest[0], mine[:, :1], alone + 1
        rest, mine, theirs = rest[1:], mine[:, 1:], theirs[:, 1:]
        while front.shape[1] and len(rest):
            near = np.zeros(len(rest), bool)
            for s in range(0, len(rest), 16 * TILE):
                for t in range(0, front.shape[1], TILE):
                    near[s : s + 16 * TILE] |= (_count(front[:, t : t + TILE], theirs[:, s : s + 16 * TILE]) >= m).any(0)
            if not near.any():
                break
            label[rest[near]], alone = root, 0
            front = mine[:, near]
            rest, mine, theirs = rest[~near], mine[:, ~near].copy(), theirs[:, ~near].copy()
    for a, b, _ in _hits(mine, mine[:, :0], np.zeros(len(rest), bool), False, m) if len(rest) > 1 else ():
        label = _union(label, rest[a], rest[b])
    return label


def _visit(kind: str, token: int, across: bool, part: pa.RecordBatch, k: int, m: int) -> list[np.ndarray]:
    """What a list (in order by rep) adds. pairs: (doc_a, doc_b, matches). links: (node, rep, links, root), the documents that a class is linked to and the least representative that it is connected to. forest: the same with no links."""
    live, codes, before = _codes(part.column("packed").to_pylist(), k, m, None if kind == "forest" else token)
    node, rep, size, side = (part.column(c).to_numpy(zero_copy_only=False)[live] for c in ("node", "rep", "size", "side"))
    if len(rep) < 2:
        return [np.zeros(0, np.int64)] * (3 if kind == "pairs" else 4)
    if kind == "forest":
        return _result(kind, node, rep, size, [], _connect(codes, m))
    return _result(kind, node, rep, size, _hits(codes, before, side, across, m), np.arange(len(rep)))


def _small(kind: str, token: np.ndarray, first: np.ndarray, part: pa.RecordBatch, k: int, m: int) -> list[np.ndarray]:
    """The same for some small lists at once, which begin at first (the count of members last)."""
    raw = np.frombuffer(b"".join(part.column("packed").to_pylist()), np.uint8).reshape(-1, 5 * k)
    values, ranks = raw[:, : 4 * k].copy().view(np.uint32), raw[:, 4 * k :]
    node, rep, size, side, i, j = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "rep", "size", "side", "i", "j"))
    n = np.diff(first)
    after = np.repeat(first[1:], n) - np.arange(first[-1]) - 1  # members behind each in its list
    left = np.repeat(np.arange(first[-1]), after)
    right = ragged(np.arange(first[-1]) + 1, after)

    def hits() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(left), PAIRS):
            a, b = left[at : at + PAIRS], right[at : at + PAIRS]
            ok = (i[a] == j[a]) | (side[a] != side[b])
            a, b = a[ok], b[ok]
            same = (values[a] == values[b]) & (ranks[a] > 0) & (ranks[b] > 0)
            found = same.sum(1)
            ok = found >= m
            a, b, same, found = a[ok], b[ok], same[ok], found[ok]
            if len(a) and kind != "forest":
                column = token[a] >> 32
                order = _order(ranks[a], values[a].astype(np.int64) + (np.arange(k, dtype=np.int64) << 32))
                ok = ~(same & (order < order[np.arange(len(a)), column][:, None])).any(1)
                a, b, found = a[ok], b[ok], found[ok]
            if len(a):
                yield a, b, found

    return _result(kind, node, rep, size, hits(), np.arange(len(rep)))


def _result(kind: str, node: np.ndarray, rep: np.ndarray, size: np.ndarray, hits: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray) -> list[np.ndarray]:
    links, pairs = np.zeros(len(rep)), [[np.zeros(0, np.int64)] * 3]
    for a, b, found in hits:
        other = rep[a] != rep[b]
        a, b, found = a[other], b[other], found[other]
        if kind == "pairs":
            pairs.append([rep[a], rep[b], found])
            continue
        if kind == "links":
            links += np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
        label = _union(label, a, b)
    if kind == "pairs":
        return list(map(np.concatenate, zip(*pairs)))
    some = (links > 0) | (rep[label] != rep)
    return [node[some], rep[some], links[some].astype(np.int64), rep[label][some]]


def _merge(postings: DataFrame, k: int, m: int, kind: str, small: int) -> DataFrame:
    names = ["doc_a", "doc_b", "matches"] if kind == "pairs" else ["node", "rep", "links", "root"]
    key = ("token", "i", "j")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches of whole lists, and where each begins (the count of members last)."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in key])
            edge = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            begin = edge[0] if not held or tuple(keys[:, 0]) != last else edge[1] if len(edge) > 1 else batch.num_rows
            if held and begin < batch.num_rows:  # the list that was open ends here
                part = joined([*held, batch.slice(0, begin)])
                yield part, np.array([0, part.num_rows])
                held = []
            if begin == batch.num_rows:
                held.append(batch)
                continue
            if edge[-1] > begin:
                own = edge[(edge >= begin)]
                yield batch.slice(begin, edge[-1] - begin), own - begin
            held, last = [batch.slice(edge[-1])], tuple(keys[:, -1])
        if held:
            part = joined(held)
            yield part, np.array([0, part.num_rows])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first in lists(batches):
            size = np.diff(first)
            token, i, j = (part.column(c).to_numpy() for c in key)
            out = []
            few = (size > 1) & (size <= small)
            if few.any():
                row = ragged(first[:-1][few], size[few])
                out.append(_small(kind, token[row], np.r_[0, np.cumsum(size[few])], part.take(pa.array(row)), k, m))
            for x in np.flatnonzero(size > small):
                at = first[x]
                out.append(_visit(kind, int(token[at]), bool(i[at] != j[at]), part.slice(at, size[x]), k, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names)

    schema = ", ".join(f"{n} long" for n in names)
    return arrow_map(postings.repartition(*key).sortWithinPartitions(*key, "rep"), merge, schema)


def classes(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, bool]:
    """Signatures (doc_id, sig), each of a document once; their classes (node, rep, size, key, sig), where rep is the smallest doc_id and key the digest of sig; and whether some document has several."""
    sigs = materialise(signatures(docs, k, shingle), "signatures")
    several = not sigs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if several:
        sigs = materialise(sigs.distinct(), "signatures")
    found = sigs.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    return sigs, materialise(found.select(F.monotonically_increasing_id().alias("node"), "rep", "size", F.unhex(F.md5("sig")).alias("key"), "sig"), "classes"), several


def join(of: DataFrame, k: int = K, m: int = M, kind: str = "pairs", small: int = SMALL) -> DataFrame:
    """The inverted join over classes: what _visit says for each list."""
    tokens = _tokens(of, k)
    # Counted by an aggregate, then joined: a token that many classes have is counted before it is shuffled, and its rows are split by the skew join.
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token", F.least(F.lit(255), F.floor(F.log2("n") * 8)).cast("int").alias("q"))
    lists = tokens.join(common, "token").groupBy("node").agg(F.collect_list(F.struct("token", "q")).alias("tokens")).where(F.size("tokens") >= m)
    return _merge(_postings(lists.join(of.select("node", "rep", "size"), "node"), k, m, LIST), k, m, kind, small)


def near_duplicates(docs: DataFrame, k: int = K, m: int = M, shingle: int = SHINGLE) -> DataFrame:
    """(doc_a, doc_b, matches): near-duplicate pairs, doc_a < doc_b.

    Every pair of signature classes with at least m collisions is there, once, named by the smallest doc_id of each class;
    texts with equal signatures are there as pairs with their class's smallest doc_id. So two documents are near duplicates
    if their classes are one or are paired. Null ids, null texts and texts without a word take no part. Rows that repeat a
    doc_id are one document, which isn't paired with itself. Further columns are ignored. No row is capped or left out. An
    empty table gives no rows.
    """
    sigs, found, _ = classes(docs, k, shingle)
    copies = sigs.select("doc_id", F.unhex(F.md5("sig")).alias("key")).join(found.select("key", "rep"), "key").where("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(k).cast("long").alias("matches"))
    return join(found, k, m).unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("matches").cast("int").alias("matches"))


def links(docs: DataFrame, k: int = K, m: int = M, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document. class_id is the smallest doc_id of the connected group of near
    duplicates that it is in (its own where it has none), n_links the number of documents that it collides with in at least m
    of k coordinates, copies included.

    Every link counts, also those within groups of thousands; none is written out as a pair. Null and empty texts and texts
    without a word have no links and are classes of their own; rows with a null doc_id are left out, as they can't be named.
    Rows that repeat a doc_id are one document: it is in one group with whatever any of its texts is linked to, and the links
    of its different texts to other documents' classes are added up. Further columns are ignored. An empty table gives no rows.
    """
    sigs, found, several = classes(docs, k, shingle)
    merged = materialise(join(found, k, m, "links"), "links")
    root = components(_edges(merged, sigs, found, several))
    degree = merged.groupBy("node").agg(F.sum("links").alias("links"))
    about = found.select("node", "rep", "size", "key").join(degree, "node", "left").join(root.select(F.col("node").alias("rep"), "root"), "rep", "left")
    about = about.select("key", F.coalesce("root", "rep").alias("root"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    mine = sigs.select("doc_id", F.unhex(F.md5("sig")).alias("key")).join(about, "key").select("doc_id", "root", "links")
    if several:
        mine = mine.groupBy("doc_id").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(mine, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def _edges(merged: DataFrame, sigs: DataFrame, found: DataFrame, several: bool) -> DataFrame:
    """Edges between representatives; where a document has several texts, also those between the classes of each."""
    out = merged.select(F.col("rep").alias("doc_a"), F.col("root").alias("doc_b"))
    if several:
        reps = sigs.select("doc_id", F.unhex(F.md5("sig")).alias("key")).join(found.select("key", "rep"), "key")
        out = out.union(reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select("rep", "least"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large and small stars, for every node
    but the roots. Each round is written to the shared folder, so no lineage grows."""
    edges = materialise(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u > v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    was = state(edges)
    while was[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        star = large.join(least, "u")
        small = star.select(F.col("v").alias("u"), F.col("w").alias("v")).union(least.select("u", F.col("w").alias("v"))).where("u > v").distinct()
        edges = materialise(small, "edges")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def deduplicate(docs: DataFrame, k: int = K, m: int = M, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each connected group of near duplicates: the one with the smallest doc_id.

    All columns stay as they are. Rows without a doc_id or a word stay. Of rows that repeat a doc_id, the one with the
    smallest text stays (null texts first). An empty table gives no rows.
    """
    sigs, found, several = classes(docs, k, shingle)
    root = components(_edges(join(found, k, m, "forest"), sigs, found, several)).select(F.col("node").alias("rep"), "root")
    about = found.select("key", "rep").join(root, "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    mine = sigs.select("doc_id", F.unhex(F.md5("sig")).alias("key")).join(about, "key")
    gone = materialise(mine.where("doc_id > root").select(F.col("doc_id").alias("gone")).distinct(), "gone")

    def size(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() * 8 <= BROADCAST_BYTES else ids

    kept = docs.join(size(gone), docs["doc_id"] == gone["gone"], "left_anti")
    again = materialise(docs.select(F.col("doc_id").cast("long").alias("again")).where("again IS NOT NULL").groupBy("again").count().where("count > 1").select("again"), "again")
    if again.isEmpty():
        return kept
    names, held = docs.columns, size(again)
    once = kept.join(held, kept["doc_id"] == again["again"], "left_anti")
    place = F.row_number().over(Window.partitionBy("row.doc_id").orderBy(F.col("row.text").asc_nulls_first()))
    first = kept.join(held, kept["doc_id"] == again["again"], "left_semi").select(F.struct(*names).alias("row")).withColumn("place", place).where("place = 1").select("row.*")
    return once.union(first)
