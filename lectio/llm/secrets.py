"""Secret scans: strings that look random, found by the entropy of a window that slides over them.

Candidates are the runs of characters that keys and tokens are made of. For each class of characters a window moves over the
candidate by one place at a time, and its Shannon entropy follows from the counts of its characters, of which a step changes
two; all candidates of a batch take each step together. A candidate whose best window reaches the class's threshold is a
finding unless the allow-list suppresses it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import arrow_map, flat, slices, spans, view

WINDOW = 20
#: Bits of the best window that make a finding, for each class of characters, in a window of WINDOW.
THRESHOLDS = {"hex": 2.8, "alnum": 3.4, "base64": 3.6, "mixed": 3.8, "letters": 3.6}
#: Letters alone are judged where this part of all steps from one to the next changes the case, as in keys and not in names.
CASE_CHANGES = 0.25
#: Values that are known not to be secret; what stands right before a value that isn't; and what does so anywhere before it in the same run of non-space.
ALLOWED_VALUES = (rb"(?i)example", rb"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", rb"(?i)0123456789abcdef", rb"(?i)abcdefghijklmnop")
ALLOWED_BEFORE = (rb"(?i)\b(commit|sha1|sha256|sha512|md5|checksum|digest|integrity|etag|rev)\W{0,3}(sha\d{1,8}-)?$",)
EMBEDDED = rb"(?i)\bdata:"
#: Bytes that a match of ALLOWED_BEFORE can have at most, with one to tell where its word begins.
NEAR = 32
#: Within the host or path of an address (not its query or user) hex hashes and runs of words and numbers are known not to be secret.
ADDRESS, QUERY, USER = rb"://", rb"[?#]", re.compile(rb"[^\s/?#]*@")
WORDS = rb"[/+_-]*(?:[A-Za-z]+|\d+)(?:[/+_-]+(?:[A-Za-z]+|\d+))*[/+_-]*"
#: So are, anywhere, lower-case words and numbers of the mixed class, such as names of files.
LOWER_WORDS = WORDS.replace(b"A-Z", b"")
MASK = "[SECRET]"

_PARTS = "+/-_"
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, _PARTS)]] = True
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, _PARTS)]] = np.arange(66)
_DIGIT, _UPPER, _LOWER, _OTHER, _HEX = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58], _UPPER[65:91], _LOWER[97:123] = True, True, True
_OTHER[[*map(ord, _PARTS)]] = True
_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PART, _SEGMENT = _CANDIDATE & ~_OTHER, _CANDIDATE.copy()
_SEGMENT[ord("/")] = False
#: Places of a candidate that are stepped through as one row, at least; a longer one is several rows that overlap by a window.
ROW = 256


def best_entropy(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The highest entropy of any window of each span, in bits; every span has a window's length at least."""
    steps = max(ROW - window, window)
    rows = np.maximum(1, -(-(end - start - window + 1) // steps))
    who = np.repeat(np.arange(len(start)), rows)
    low = start[who] + (np.arange(len(who)) - np.repeat(np.cumsum(rows) - rows, rows)) * steps
    high = np.minimum(low + steps + window - 1, end[who])
    order = np.argsort(low - high, kind="stable")  # long rows first, so that those still moving are a head
    who, low, length = who[order], low[order], (high - low)[order]
    symbol = _SYMBOL[data]
    n = len(low)
    log = np.r_[0.0, np.arange(1, window + 2) * np.log2(np.arange(1, window + 2))]
    counts = np.zeros((n, 66), np.int32)
    row = np.arange(n)
    total = np.zeros(n)
    for i in range(window):
        s = symbol[low + i]
        was = counts[row, s]
        total += log[was + 1] - log[was]
        counts[row, s] = was + 1
    least = total.copy()
    for i in range(window, int(length[0]) if n else 0):
        live = int(np.searchsorted(-length, -i, "left"))
        row, at = row[:live], low[:live] + i
        out, into = symbol[at - window], symbol[at]
        was = counts[row, out]
        total[:live] += log[was - 1] - log[was]
        counts[row, out] = was - 1
        was = counts[row, into]
        total[:live] += log[was + 1] - log[was]
        counts[row, into] = was + 1
        np.minimum(least[:live], total[:live], out=least[:live])
    best = np.full(len(start), np.inf)
    np.minimum.at(best, who, least)
    return np.log2(window) - best / window


def _last(places: np.ndarray, before: int) -> int:
    """The last of some places that is under a bound, or -1."""
    i = int(np.searchsorted(places, before, "left"))
    return int(places[i - 1]) if i else -1


def scan(texts: pa.Array, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> tuple[np.ndarray, ...]:
    """Findings in a column: indices of texts, bytes where they begin and end, class, entropy."""
    data, at = view(texts)
    start, end, first = spans(data, at, _CANDIDATE)
    keep = end - start >= window
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))[keep]
    start, end = start[keep], end[keep]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, "U7"), np.zeros(0))
    owner, level, begin, whole = np.arange(len(start)), np.zeros(len(start), np.int8), start, end
    for n, table in ((1, _SEGMENT), (2, _PART)):  # what lies between slashes, and between any separators
        s, e, _ = spans(data, at, table)
        s, e = s[e - s >= window], e[e - s >= window]
        of = np.searchsorted(begin, s, "right") - 1
        inner = (s > begin[of]) | (e < whole[of])
        start, end, owner, level = np.r_[start, s[inner]], np.r_[end, e[inner]], np.r_[owner, of[inner]], np.r_[level, np.full(inner.sum(), n, np.int8)]

    def has(mark: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mark)]
        return total[end] - total[start]

    digit, upper, lower, other, hexa = (has(t[data]) for t in (_DIGIT, _UPPER, _LOWER, _OTHER, _HEX))
    turn = np.zeros(len(data), bool)
    turn[1:] = _UPPER[data[1:]] & _LOWER[data[:-1]] | _LOWER[data[1:]] & _UPPER[data[:-1]]
    turns = has(turn) - turn[start]
    size, some = end - start, (digit > 0) & (upper + lower > 0)
    kind = np.where(~some, "", np.where((hexa == size) & ((upper == 0) | (lower == 0)), "hex", np.where(other == 0, "alnum", np.where((upper > 0) & (lower > 0), "base64", "mixed"))))
    kind = np.where((upper + lower + other == size) & (turns >= CASE_CHANGES * (size - 1)), "letters", kind)
    some = np.flatnonzero(kind != "")
    start, end, kind, owner, level = start[some], end[some], kind[some], owner[some], level[some]
    if not len(start):
        return text[owner], start, end, kind, np.zeros(0)
    entropy = best_entropy(data, start, end, window)
    some = np.flatnonzero(entropy >= np.array([thresholds.get(k, THRESHOLDS[k]) for k in kind.tolist()]))
    if not len(some):
        return text[owner[some]], start[some], end[some], kind[some], entropy[some]
    raw, spaces = data.tobytes(), np.flatnonzero(_SPACE[data])
    address, query, embedded = (np.fromiter((m.start() for m in re.finditer(p, raw)), np.int64) for p in (ADDRESS, QUERY, EMBEDDED))

    def allowed(low: int, s: int) -> bool:
        """Whether the text from low on allows what begins at s."""
        if _last(embedded, s) >= max(low, _last(spaces, s)):
            return True
        near = max(low, s - NEAR)
        return any(re.search(p, raw[near:s]) for p in ALLOWED_BEFORE)

    def inside(low: int, s: int) -> int:
        """Where the address begins in whose host or path s is, or -1."""
        got = _last(address, s - 2)
        return got + 3 if got >= max(low, _last(spaces, s)) and _last(query, s) < got else -1

    keep, last, done, digest, linked = [], -1, [], False, False
    for i in some[np.lexsort((start[some], level[some], owner[some]))].tolist():
        s, e, o = int(start[i]), int(end[i]), int(owner[i])
        low, high = int(at[text[o]]), int(at[text[o] + 1])
        if o != last:
            b = int(begin[o])
            digest = allowed(low, b)
            linked = inside(low, min(b + 2, high)) >= 0
            last, done = o, []
        value = raw[s:e]
        if digest or level[i] == 0 and linked and b"/" in value or level[i] == 1 and not linked or any(a <= s and e <= z for a, z in done):
            continue
        if any(re.search(p, value) for p in ALLOWED_VALUES) or allowed(low, s):
            continue
        host = inside(low, s)
        if host >= 0 and (raw.find(b"/", host, s) >= 0 or not USER.match(raw, e, high)):
            if kind[i] == "hex" or re.fullmatch(WORDS, value):
                continue
        if kind[i] == "mixed" and re.fullmatch(LOWER_WORDS, value):
            continue
        done.append((s, e))
        keep.append(i)
    some = np.array(sorted(keep, key=lambda i: start[i]), np.int64)
    text = text[owner[some]]
    return text, start[some] - at[text], end[some] - at[text], kind[some], entropy[some]


def find(docs: DataFrame, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(doc_id, start, length, kind, entropy, preview): every finding, in bytes of the UTF-8 text; preview is its first four characters.

    Kinds: hex (digits and letters a to f of one case), alnum (letters and digits), base64 (with +, /, - or _, and digits and
    both cases), mixed (the same with letters of one case), letters (no digits, but cases that change as in a random key).
    Every candidate of at least `window` characters that has a digit and a letter, or is of the last kind, is judged along its
    whole length, and where it isn't a finding, so are its parts between separators, as far as they have that length. In
    addresses what is between slashes takes the place of the whole. Digits alone are never a finding. Null and empty texts
    have no findings; a null doc_id is reported as null; each row is scanned, also those that repeat. Further columns are
    ignored, whatever they are called. An empty table gives no rows.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, start, end, kind, entropy = scan(part.column("text"), window, thresholds)
                if len(text):
                    data, at = view(part.column("text"))
                    preview = [data[a : a + 4].tobytes().decode() for a in (at[text] + start).tolist()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(end - start), pa.array(kind.tolist(), pa.string()), pa.array(np.round(entropy, 6)), pa.array(preview, pa.string())], ["doc_id", "start", "length", "kind", "entropy", "preview"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), look, "doc_id long, start long, length long, kind string, entropy double, preview string")


def redact(docs: DataFrame, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, mask: str = MASK) -> DataFrame:
    """docs with every finding in text replaced by the mask, and n_chars set anew in the rows that had one; all else, nulls included, as it was. An empty table gives no rows."""
    schema = docs.schema
    place = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    length = next((i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"), None)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[place]):
                column = flat(part.column(place))
                text, start, end, _, _ = scan(column, window, thresholds)
                if len(text):
                    new = {}
                    for t, s, e in sorted(zip(text.tolist(), start.tolist(), end.tolist()), reverse=True):
                        raw = new[t] if t in new else column[t].as_py().encode()
                        new[t] = raw[:s] + mask.encode() + raw[e:]
                    hit = np.zeros(len(column), bool)
                    hit[list(new)] = True
                    texts = pa.array([new[t].decode() for t in sorted(new)], column.type)
                    part = part.set_column(place, part.schema.field(place), pa.compute.replace_with_mask(column, pa.array(hit), texts))
                    if length is not None:
                        old = flat(part.column(length))
                        sizes = pa.compute.utf8_length(texts).cast(old.type)
                        part = part.set_column(length, part.schema.field(length), pa.compute.replace_with_mask(old, pa.array(hit), sizes))
                yield part

    return arrow_map(docs, change, schema)
