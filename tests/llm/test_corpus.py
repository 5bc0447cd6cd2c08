"""Near duplicates, decontamination and the pipeline, against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectio.llm import decontam, minhash, packing, rules, secrets
from lectio.llm.blocks import words


def _signatures(rows):
    sig, some = minhash._sign(*words(pa.array([t for _, t in rows], pa.string())), minhash.K, minhash.SHINGLE)
    return {rows[i][0]: s for i, s in zip(some.tolist(), sig)}


def _pairs(sigs, m):
    """Pairs of classes by their smallest id, and of members with it."""
    classes = {}
    for d, s in sigs.items():
        classes.setdefault(s.tobytes(), []).append(d)
    reps = sorted(min(c) for c in classes.values())
    out = {(a, b): int((sigs[a] == sigs[b]).sum()) for i, a in enumerate(reps) for b in reps[i + 1 :]}
    out = {k: n for k, n in out.items() if n >= m}
    return out | {(min(c), d): minhash.K for c in classes.values() for d in c if d != min(c)}


def _groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("m", [8, 28, 64])
def test_near_duplicates_match_brute_force(spark, data, m):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(r.doc_a, r.doc_b): r.matches for r in minhash.near_duplicates(docs, m=m).collect()}
    want = _pairs(_signatures(rows), m)
    assert got == want and len(got) > 70
    if m == 28:
        root = _groups(want, [d for d, _ in rows])
        assert sorted(r.doc_id for r in minhash.deduplicate(docs).select("doc_id").collect()) == sorted(d for d in root if root[d] == d)


def test_near_duplicates_find_edited_copies(docs_of):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(3000)], 200)) for _ in range(12)]
    edited = []
    for t in base:
        w = t.split()
        for i in rng.choice(200, 6, replace=False):
            w[i] = "changed"
        edited.append(" ".join(w))
    got = {(r.doc_a, r.doc_b) for r in minhash.near_duplicates(docs_of(list(enumerate(base + edited)))).collect()}
    assert got == {(i, i + 12) for i in range(12)}


def _all_pairs(sigs, m):
    ids = sorted(sigs)
    sig = np.array([sigs[i] for i in ids])
    out = {}
    for i, a in enumerate(ids):
        n = (sig[i] == sig[i + 1 :]).sum(1)
        out |= {(a, ids[i + 1 + j]): int(n[j]) for j in np.flatnonzero(n >= m)}
    return out


def _links(sigs, m):
    """For each document the smallest of its group, and with how many it collides; by comparing all rows."""
    pairs = _all_pairs(sigs, m)
    root, n = _groups(pairs, sigs), dict.fromkeys(sigs, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {d: (root[d], n[d]) for d in sigs}


@pytest.mark.parametrize(("most", "small"), [(16_384, 96), (3, 1)])
def test_links_match_brute_force_over_all_rows(spark, data, docs_of, monkeypatch, most, small):
    from lectio.llm.queries import QUERIES

    plain = minhash.join
    monkeypatch.setattr(minhash, "LIST", most)
    monkeypatch.setattr(minhash, "join", lambda of, k, m, kind="pairs": plain(of, k, m, kind, small))
    if most > 3:
        tables = data.replace("0.001", "0.01")
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
        got = QUERIES["op9_near_duplicates"](spark, tables).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _links(_signatures(rows), minhash.M) and len(got) == len(rows)
    words_ = [f"w{i}" for i in range(200)]
    near = [" ".join(w if j != 3 * i else "changed" for j, w in enumerate(words_)) for i in range(60)]
    rows = [*((i, "the very same text of some words") for i in range(100, 160)), *((1000 + i, t) for i, t in enumerate(near)), *((2000 + i, t) for i, t in enumerate(near[:7])), (3, None), (4, "")]
    want = _links(_signatures([r for r in rows if r[1]]), minhash.M) | {3: (3, 0), 4: (4, 0)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in minhash.links(docs_of(rows)).collect()} == want and want[2000] == (1000, 66)
    pairs = {(r.doc_a, r.doc_b): r.matches for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert pairs == _pairs(_signatures([r for r in rows if r[1]]), minhash.M)
    kept = {r.doc_id for r in minhash.deduplicate(docs_of(rows)).select("doc_id").collect()}
    assert kept == {d for d, (c, _) in want.items() if c == d}


def test_links_of_a_document_with_several_texts(docs_of):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(5, one), (5, one), (5, two), (7, one), (8, two), (2, two + " more"), (9, "quite another text"), (None, one)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in minhash.links(docs_of(rows)).collect()}
    assert got == {5: (2, 3), 7: (2, 1), 8: (2, 2), 2: (2, 2), 9: (9, 0)}


def test_long_lists_of_unlike_texts_take_little_time():
    import time

    rng = np.random.default_rng(1)
    values, ranks = rng.integers(0, 1 << 32, (8000, minhash.K), dtype=np.uint32), np.full((8000, minhash.K), 9, np.uint8)
    values[:, 0] = 7
    packed = [v.tobytes() + r.tobytes() for v, r in zip(values, ranks)]
    shared = values.copy()
    shared[:, :30] = rng.integers(0, 5, (8000, 30))  # texts that share tokens, but never so many
    for some in (packed, [v.tobytes() + r.tobytes() for v, r in zip(shared, ranks)]):
        n = len(some)
        part = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.ones(n, np.int64)), pa.array([False] * n), pa.array(some, pa.binary())], ["node", "rep", "size", "side", "packed"])
        for kind in ("links", "forest"):
            start = time.perf_counter()
            found = minhash._visit(kind, 7, False, part, minhash.K, minhash.M)
            assert not len(found[0]) and time.perf_counter() - start < 10


def test_near_duplicates_odd_rows(odd, clash, docs_of):
    assert minhash.near_duplicates(clash).collect() == []
    assert {r.doc_id: (r.class_id, r.n_links) for r in minhash.links(clash).collect()} == {i: (i, 0) for i in range(1, 8)} and minhash.links(odd.limit(0)).count() == 0
    kept = minhash.deduplicate(clash)
    assert kept.columns == clash.columns
    rows = [(r.doc_id, r.text and r.text[:9]) for r in kept.collect()]
    assert sorted(rows, key=repr) == sorted([(1, "Another t"), (None, "A text wi"), (None, None), (2, None), (3, ""), (4, " \n "), (5, "w0 and 0."), (6, "Ünïcode ☃"), (7, "x" * 9)], key=repr)
    assert minhash.deduplicate(odd.limit(0)).count() == 0 and minhash.near_duplicates(odd.limit(0)).count() == 0
    copies = docs_of([(i, "the very same text of some words") for i in range(300)])
    assert minhash.near_duplicates(copies).count() == 299 and [r.doc_id for r in minhash.deduplicate(copies).collect()] == [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 40))
def test_suffix_array_is_sorted(values, depth):
    order = decontam.suffix_array(np.array(values, np.int64), depth)
    heads = [tuple(values[i : i + depth]) for i in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(values)))


def _leaks(docs, tests, need=decontam.MIN_WORDS):
    """The longest common run of words for each pair, by comparing all places."""
    out = {}
    split = lambda t: pa.array([t])
    for d, text in docs:
        a = words(split(text))[0].tolist()
        for i, test in tests:
            b = words(split(test))[0].tolist()
            least = min(need, len(b))
            if len(b) < decontam.SHORTEST:
                if b and a == b:
                    out[d, i] = (len(b), 0, 0)
                continue
            best = (0, 0, 0)
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, (n, -x, -y))
            if best[0] >= least:
                out[d, i] = (best[0], -best[1], -best[2])
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=4))
def test_search_matches_brute_force(docs, tests):
    docs, tests = [" ".join(d) for d in docs], [" ".join(t) for t in tests]
    got = decontam.search(pa.array(docs), decontam.Tests(list(range(len(tests))), tests))
    found = {(int(t), int(i)): (int(n), int(x), int(y)) for t, i, n, x, y in zip(*(got[k] for k in ("text", "item", "n_words", "doc_word", "item_word")))}
    assert found == _leaks(list(enumerate(docs)), list(enumerate(tests)))


def test_leaks_over_tables(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.n_words, r.doc_word, r.item_word) for r in decontam.leaks(docs, bench).collect()}
    small = {(r.doc_id, r.item_id): (r.n_words, r.doc_word, r.item_word) for r in decontam.leaks(docs.repartition(3), bench, shard_bytes=10_000, chunk_bytes=2_000).collect()}
    assert got and got == small
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted({d for d, _ in got})[:2]
    want = _leaks([(d, text[d]) for d in ids], [(r.item_id, r.text) for r in bench.collect()])
    assert {k: v for k, v in got.items() if k[0] in ids} == want
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench, chunk_bytes=3_000).collect()}
    assert kept == set(text) - {d for d, _ in got}


def test_a_benchmark_of_many_chunks_is_one_pass(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    assert len(decontam._chunks(bench, 13, 5, 1_000)[0]) >= 10
    for plan in (decontam.leaks(docs, bench, chunk_bytes=1_000), decontam.decontaminate(docs, bench, chunk_bytes=1_000)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 1


def test_leaks_odd_rows(spark, odd, clash):
    bench = spark.createDataFrame([(1, "One plain line of words."), (2, None), (None, "Another text for it, yes."), (3, ""), (4, "too short"), (1, "One plain line of words.")], "item_id long, text string")
    got = decontam.leaks(clash, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_words) for r in got] == [(1, 1, 5)]
    short = spark.createDataFrame([(1, "another text"), (2, "another text for it"), (3, "unicode")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_words) for r in decontam.leaks(clash, short).collect()] == [(1, 2, 4)]
    kept = decontam.decontaminate(clash, bench)
    assert kept.columns == clash.columns and kept.count() == odd.count() - 2
    assert decontam.leaks(odd, bench.limit(0)).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontam.leaks(odd.limit(0), bench).count() == 0


def test_pipeline_stages_follow_one_another(spark, data):
    import corpus_pipeline

    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    left = {r.doc_id: r.text for r in rules.clean(docs).collect()}
    rows = sorted(left.items())
    root = _groups(_pairs(_signatures(rows), minhash.M), left)
    left = {d: t for d, t in left.items() if root[d] == d}
    tests = decontam.Tests(*zip(*((r.item_id, r.text) for r in bench.collect())))
    for d in sorted(left):
        if len(decontam.search(pa.array([left[d]]), tests)["text"]):
            del left[d]
    clean = secrets.redact(spark.createDataFrame(sorted(left.items()), "doc_id long, text string"))
    want = packing.pack(clean)
    key = lambda r: (r.block, r.window)
    assert sorted(corpus_pipeline.run(spark, data).collect(), key=key) == sorted(want.collect(), key=key)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_keeps_columns(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") < 40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
    assert all(stage(spark, docs.limit(0), data).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_over_odd_rows(spark, data, clash, tmp_path):
    import corpus_pipeline
    from lectio.llm.tokens import encoder, vocabulary

    folder = f"file://{tmp_path}"
    clash.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r.block, r.window))
    got = {}
    for r in rows:
        tokens = iter(r.tokens)
        for d, s, e in zip(r.doc_ids, r.starts, r.ends):
            got.setdefault(d, []).extend(next(tokens) for _ in range(e - s))
    coder = encoder(vocabulary())
    text = {d: coder.plain.decode(t[:-1]) for d, t in got.items()}
    want = {r.doc_id: r.text for r in clash.collect() if r.text and r.text.strip() and (r.doc_id != 1 or r.text.startswith("Another"))}
    assert text == want and set(got) == {None, 1, 5, 6, 7}
