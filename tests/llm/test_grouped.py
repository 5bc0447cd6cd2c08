"""Chat formatting, packing, tokens and wavelet shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectio.llm import chat, packing, wavelet
from lectio.llm.tokens import Encoder, encoder, vocabulary


# Chat formatting


def test_chats_match_plain_formatting(spark):
    rows = [(1, 1, "assistant", "Hi ☃"), (1, 0, "user", "Hello"), (1, 1, "assistant", "Hi ☃"), (2, None, None, None), (2, 5, "user", "<|im_end|>x"), (None, 0, "user", "no id"), (None, 0, "assistant", ""), (3, 0, "user", "y" * 3_000_000), (3, 1, "assistant", "z" * 3_000_000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns", "2 AS n_bytes")).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1].text == turn("user", "Hello") + turn("assistant", "Hi ☃") * 2 and got[1].n_turns == 3 and got[1].trained_bytes == 12
    assert got[2].text == turn("", "") + turn("user", "< |im_end|>x")
    assert got[None].text == turn("assistant", "") + turn("user", "no id")
    assert got[3].n_bytes == len(got[3].text.encode()) and got[3].trained_bytes == 3_000_000 and len(got) == 4
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_conversation_beyond_a_string_is_an_error(monkeypatch):
    import pytest

    monkeypatch.setattr(chat, "MOST_BYTES", 60)
    one = lambda n: chat.assemble(pa.array(["user"]), pa.array(["x" * n]), np.array([0, 1]))
    assert one(10)[0][0].as_py().endswith("x<|im_end|>\n")
    with pytest.raises(ValueError, match="one string"):
        one(60)


# Tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("  \n\t'srevmldtLa1²½é中🙂.,!_  \u0085", max_size=14), max_size=8))
def test_tokens_are_those_of_the_tokenizer(texts):
    coder = encoder(vocabulary())
    ids, first = coder.encode(pa.array([*texts, None], pa.string()))
    for i, text in enumerate([*texts, ""]):
        assert ids[first[i] : first[i + 1]].tolist() == coder.plain.encode_ordinary(text)


def test_vocabularies_of_any_size():
    import base64

    ranks = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + b"\n".join(base64.b64encode(bytes([a, b, c])) + b" %d" % (70_000 + i) for i, (a, b, c) in enumerate([(97, 98, 99)]))
    coder = Encoder(ranks)
    assert coder.vocabulary == 70_001 and coder.encode(pa.array(["abc"]))[0].dtype == np.uint32 and coder.encode(pa.array(["abc x"]))[0].max() in (70_000, 120)


# Packing


def _least(tokens, ends, capacity, sentence, hard):
    """The least cost over all cuts at all tokens."""
    begin = np.r_[0, np.cumsum(np.array(tokens) + 1)].tolist()
    penalty = [hard] * (begin[-1] + 1)
    for b, e in zip(begin, ends):
        for x in e:
            penalty[b + x] = sentence
    for b in begin:
        penalty[b] = 0
    best = [0]
    for j in range(1, len(penalty)):
        best.append(min(best[i] + capacity - (j - i) + penalty[j] for i in range(max(0, j - capacity), j)))
    return best[-1], penalty


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sets(st.integers(1, 29))), min_size=1, max_size=7), st.integers(2, 20), st.integers(0, 9), st.integers(0, 30))
def test_cuts_cost_least_over_all_tokens(docs, capacity, sentence, hard):
    tokens, ends = [n for n, _ in docs], [sorted(e for e in s if e < n) for n, s in docs]
    hard = max(hard, sentence)
    cut, begin = packing.windows(np.array(tokens), [np.array(e, np.int64) for e in ends], capacity, sentence, hard)
    want, penalty = _least(tokens, ends, capacity, sentence, hard)
    assert cut[0] == 0 and cut[-1] == begin[-1] == sum(tokens) + len(tokens) and all(0 < d <= capacity for d in np.diff(cut).tolist())
    assert sum(capacity - (b - a) + penalty[b] for a, b in zip(cut.tolist(), cut.tolist()[1:])) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab.!? \n\té中", max_size=40), max_size=5))
def test_sentence_ends_are_those_of_a_plain_scan(texts):
    coder = encoder(vocabulary())
    ids, first, ends, begin = packing.tokenised(pa.array([*texts, None], pa.string()), coder)
    begin = np.r_[begin[: len(texts) + 1], len(ends)]
    for i, text in enumerate([*texts, ""]):
        own = coder.plain.encode_ordinary(text)
        assert ids[first[i] : first[i + 1]].tolist() == own
        after, raw = [], text.encode()
        pieces = [len(p.encode()) for p in __import__("regex").findall(coder.plain._pat_str, text)]
        at = np.r_[0, np.cumsum(pieces)].tolist()
        size = np.r_[0, np.cumsum([len(coder.plain.encode_ordinary(raw[a:b].decode())) for a, b in zip(at, at[1:])])].tolist() if pieces else [0]
        for x in range(1, len(raw)):
            if raw[x - 1 : x] in (b".", b"!", b"?", b"\n") and raw[x : x + 1].isspace() or raw[x - 1 : x] == b"\n":
                t = size[min(k for k, a in enumerate(at) if a >= x)]
                if 0 < t < len(own):
                    after.append(t)
        assert ends[begin[i] : begin[i + 1]].tolist() == sorted(set(after))


def _key(r):
    return r.block, r.window


def test_packing_holds_every_token_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    coder = encoder(vocabulary())
    ids = {r.doc_id: [*coder.plain.encode_ordinary(r.text), coder.vocabulary] for r in docs.collect() if r.text}
    rows = sorted(packing.pack(docs.repartition(5), capacity=512, block_tokens=20_000, parts=3).collect(), key=_key)
    got, last = {}, None
    for r in rows:
        tokens = iter(r.tokens)
        for d, s, e in zip(r.doc_ids, r.starts, r.ends):
            assert len(got.setdefault(d, [])) == s < e and (last is None or last <= d)
            got[d] += [next(tokens) for _ in range(e - s)]
            last = d
        assert r.n_tokens == len(r.tokens) == 512 - r.padding <= 512 and next(tokens, None) is None
    assert got == ids and len({r.block for r in rows}) > 3
    assert rows == sorted(packing.pack(docs, capacity=512, block_tokens=20_000).collect(), key=_key)
    total = 0
    block = {}
    for d in sorted(ids):
        block[d] = total // 20_000
        total += len(ids[d])
    assert all(block[d] == r.block for r in rows for d in r.doc_ids)


def test_packing_is_the_same_whatever_the_ids_are(docs_of):
    text = " ".join(f"word{i} and more." for i in range(23))
    plain, spaced, spread = ([(f(i), text) for i in range(400)] for f in (lambda i: i, lambda i: i * 10**6, lambda i: (i - 200) * 40_000_000_000_000_001))
    got = [sorted(packing.pack(docs_of(rows).repartition(3), block_tokens=9000).drop("doc_ids").collect(), key=_key) for rows in (plain, spaced, spread)]
    assert got[0] == got[1] == got[2] and sum(r.padding for r in got[0]) < 0.2 * sum(r.n_tokens for r in got[0])


def test_packing_odd_rows(odd, clash, docs_of):
    rows = packing.pack(clash).collect()
    assert {d for r in rows for d in r.doc_ids} == {1, None, 4, 5, 6, 7}
    assert sum(d == 1 and s == 0 for r in rows for d, s in zip(r.doc_ids, r.starts)) == 3
    assert min(rows, key=_key).doc_ids[0] is None
    assert packing.pack(odd.limit(0)).count() == 0
    same = packing.pack(docs_of([(1, "One. Two. Three.")] * 50 + [(None, "x y z.")] * 20), capacity=32, block_tokens=64, parts=4).collect()
    assert sum(s == 0 for r in same for s in r.starts) == 70 and len({r.block for r in same}) > 2


# Wavelet shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=200), st.integers(1, 3))
def test_wavelet_queries(values, scale):
    tokens = np.array(values * scale, np.uint16)
    old, wavelet.BLOCK = wavelet.BLOCK, 64
    try:
        w = wavelet.Wavelet(wavelet.build(tokens, np.array([0, len(tokens)]), np.array([5])))
    finally:
        wavelet.BLOCK = old
    assert [w.access(i) for i in range(len(w))] == tokens.tolist() == w.tokens().tolist()
    for t in {*values[:5], 0, 71, 40_000}:
        where = np.flatnonzero(tokens == t)
        assert w.count(t) == len(where) and w.occurrences(t).tolist() == where.tolist()
        assert [w.select(t, k) for k in range(min(4, len(where)))] == where[:4].tolist()
        assert w.rank(t, len(tokens) // 2) == int((where < len(tokens) // 2).sum())
    half = len(tokens) // 2
    assert w.read(half // 2, half).tolist() == tokens[half // 2 : half].tolist() and w.document(0).tolist() == tokens.tolist()
    cold = wavelet.Wavelet(w.file)
    cold.occurrences(99_999)
    assert not cold.cache


def test_wavelet_shards_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    files = wavelet.shard_files(docs, shard_tokens=20_000)
    coder = encoder(vocabulary())
    rows = files.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for r in rows:
        w = wavelet.Wavelet(bytes(r.file))
        tokens = w.tokens()
        assert len(w) == r.n_tokens and w.ids.tolist() == r.doc_ids
        for i, d in enumerate(r.doc_ids):
            part = tokens[w.first[i] : w.first[i + 1]].tolist()
            assert coder.plain.decode(part[:-1]) == texts[d] and part[-1] == coder.vocabulary
            seen.append(d)
    assert sorted(seen) == sorted(texts) and len(rows) > 3
    token = coder.plain.encode_ordinary(next(iter(texts.values())))[3]
    want = sorted((d, i) for d, t in texts.items() for i, x in enumerate(coder.plain.encode_ordinary(t)) if x == token)
    assert sorted((r.doc_id, r.place) for r in wavelet.find_token(files, token).collect()) == want


def test_wavelet_odd_rows(odd, clash):
    rows = wavelet.shard_files(clash).collect()
    assert sum(r.n_docs for r in rows) == odd.count() and sum(r.doc_ids.count(None) for r in rows) == 2
    assert wavelet.shard_files(odd.limit(0)).count() == 0
