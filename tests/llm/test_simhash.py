"""Fingerprints by hand, links and components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillcheck.llm import simhash
from quillcheck.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64(b" ".join(words[i : i + k]), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in (None, "", " \n", "One", "two words", "A b C", "ÄÖ ü x\xa0y z a b c d", "the cat sat on the mat " * 40, "a b c a b c a b c"):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_bit_sliced_distances(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = fps.copy()
    for i in range(n):
        for b in rng.choice(64, i % 6, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    want = {(i, j) for i in range(n) for j in range(n) if bin(int(near[i] ^ fps[j])).count("1") <= 2}
    a, b = simhash.within(near, simhash.planes(fps), n)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


@pytest.mark.parametrize("rows,part", [(2048, 1 << 15), (128, 1 << 15), (128, 40)])
def test_links_connect_like_all_pairs(spark, monkeypatch, rows, part):
    monkeypatch.setattr(simhash, "_PART", part)
    rng = random.Random(rows)
    fps = set()
    for _ in range(25):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            fps.add(fp)
            for _ in range(rng.randint(0, 3)):
                fp ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)  # a dense group that shares most bits
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i, 16)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table).collect()]
    assert all(bin(a ^ b).count("1") > 0 for a, b in found) and len(found) < 8 * len(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2]
    assert groups(found, fps) == groups(pairs, fps)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(200, 330)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    want = groups(pairs, {n for p in pairs for n in p if p[0] != p[1]} | {n for p in pairs for n in p})
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found.get(n, n) == want[n] for n in want) and set(found) <= set(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(docs_of):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(5, base), (3, base), (9, base + "x"), (4, None), (2, ""), (8, " \n "), (6, "another text with other words altogether " * 20), (7, base), (7, base), (None, base), (None, "a row of its own without id")]
    docs = docs_of(rows).selectExpr("*", "1 AS fp", "2 AS component_id")
    fps = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    pairs = [(a, b) for a in fps for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = groups(pairs, fps)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == fps[r.doc_id] and r.component_id == want[r.doc_id]
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["3", "None"]
    kept = [r.doc_id for r in simhash.one_of_each(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted({*want.values(), None}, key=str)
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_whole_table(sample_docs):
    rows = sample_docs.collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    want = groups([(a, b) for a in fps for b in fps if a > b and bin(fps[a] ^ fps[b]).count("1") <= 2], fps)
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(sample_docs).collect()}
    assert found == {i: (fps[i], want[i]) for i in fps}


@pytest.mark.parametrize("rows", [128, 2048])
@pytest.mark.parametrize("sizes", [(1, 1), (2, 3), (3, 2), (300, 7), (50, 60), (200, 300), (130, 2, 259)])
def test_blocks_that_straddle_runs_and_batches(monkeypatch, rows, sizes):
    monkeypatch.setattr(simhash, "_ROWS", rows)
    rng = np.random.default_rng(sum(sizes))
    n = sum(sizes)
    near = rng.integers(0, 1 << 63, -(-n // 2), dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 32, len(near), dtype=np.uint64)) | (np.uint64(1) << rng.integers(32, 64, len(near), dtype=np.uint64))
    fps = np.concatenate([near, near ^ flips])[:n]  # a fingerprint's only copy lies half the block away
    before = rng.integers(0, 1 << 63, rows - 1, dtype=np.uint64)  # another block, so that the run's end cuts this one
    for lead in (before[:0], before):
        key = np.concatenate([np.zeros(len(lead), np.int64), np.ones(n, np.int64)])
        both, cuts = np.concatenate([lead, fps]), np.cumsum([len(lead) + sizes[0], *sizes[1:]])[:-1]
        batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(k * 0), pa.array(k * 0), pa.array(f.view(np.int64))], names=["block", "lo", "hi", "fp"]) for k, f in zip(np.split(key, cuts), np.split(both, cuts), strict=True)]
        found = [(a % (1 << 64), b % (1 << 64)) for out in simhash._compare(iter(batches)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        pairs = [(int(a), int(b)) for a, b in zip(near, near ^ flips, strict=True)][: n - len(near)]
        assert groups(found, both.tolist()) == groups(pairs, both.tolist())


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (50, 60), (200, 300), (1808, 2048)])
def test_every_pair_across_a_seam(monkeypatch, n, m):
    met = np.zeros((n, m), dtype=int)

    def within(queries, table, width):
        bits = np.unpackbits(np.ascontiguousarray(table).view(np.uint8), axis=1, bitorder="little")[:, :width].T
        ids = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little")).view("<u8").ravel()
        left, right = queries[queries < n].astype(int), ids[ids >= n].astype(int) - n
        met[np.ix_(left, right)] += 1
        return np.empty(0, np.int64), np.empty(0, np.int64)

    monkeypatch.setattr(simhash, "within", within)
    simhash._forest(np.arange(n, dtype=np.uint64), np.arange(n, n + m, dtype=np.uint64))
    assert (met == 1).all()


def test_one_of_each_without_ids_or_with_ids_repeated(docs_of):
    words = [f"{c}{k}" for c in "abcdefgh" for k in range(40)]
    text = lambda seed: " ".join(random.Random(seed).choices(words, k=200))
    rows = [(None, text(i)) for i in range(6)] + [(None, text(0)), (None, text(1) + "x"), (7, text(10)), (7, text(11)), (7, text(11)), (8, text(2)), (9, text(2)), (9, text(12)), (None, None), (None, "")]
    fps = [slow_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in set(fps) for b in set(fps) if bin(a ^ b).count("1") <= 2]
    group = groups(pairs, set(fps))
    least = {}
    for (i, t), fp in zip(rows, fps, strict=True):
        if group[fp] not in least or (i is None, i or 0) < least[group[fp]][0]:
            least[group[fp]] = ((i is None, i or 0), i)
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs_of(rows)).collect()]
    assert len(kept) == len({group[slow_fingerprint(t)] for _, t in kept}) == len(least) == 10
    assert all(least[group[slow_fingerprint(t)]][1] == i and ((i, t) in rows) for i, t in kept)
    assert {t for i, t in kept if i == 7} == {text(10), text(11)} and (8, text(2)) in kept and (9, text(12)) in kept
    assert {t for i, t in kept if i is None} - {None, "", text(1) + "x"} <= {text(k) for k in (0, 1, 3, 4, 5)}


def test_one_of_each_with_clashing_columns(docs_of):
    docs = docs_of([(1, "a b c d"), (2, "a b c d"), (3, "other words here now")])
    odd = docs.selectExpr("*", "7 AS _id", "'x' AS _digest", "1 AS fp", "2 AS component", "'q' AS __kept_id", "5 AS __KEPT_own", "'r' AS first")
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], r["_id"], r["__kept_id"]) for r in kept.collect()) == [(1, 7, "q"), (3, 7, "q")]
