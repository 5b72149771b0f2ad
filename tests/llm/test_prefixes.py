"""The prefix tree against nested dictionaries, and the trie against its definition."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quillcheck.llm import prefixes

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    lent = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: lent[c]] + own[c][lent[c] :] for c in own}


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        children = lambda x: sum(len(q) == len(x) + 1 and q[: len(x)] == x for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children(p), sum(children(q) == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(rng, n, most):
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(0, 900), rng.randint(0, 9) * 100])
        if any(r[0] == c for r in rows):
            continue
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, "", "long text"])) for t in range(rng.randint(1, most))]
    return rows


@pytest.mark.parametrize("seed,chunk", [(0, 10), (1, 25), (2, 10_000)])
def test_random_conversations(spark, seed, chunk):
    rng = random.Random(seed)
    rows = tables(rng, 120, 9) + [(None, 0, "user", "a"), (None, None, None, None), (701, None, "user", "first"), (701, 3, None, "x"), (-150, 0, "user", "a")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "1 AS chunk", "2 AS depth", "'k' AS k1", "3 AS n")
    assert got(prefixes.prefix_tree(docs, chunk)) == brute(rows)


def sequences(convs):
    kind = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())]))
    return prefixes.Sequences(pa.array([[{"k1": t, "k2": -t, "n": t} for t in c] for c in convs], kind))


@pytest.mark.parametrize("seed", range(6))
def test_trie_by_definition(seed):
    """Nodes are where conversations part or end, each is filed under its two-fattest prefix, and no batch size changes them."""
    rng = random.Random(seed)
    convs = [[rng.randint(1, 2) for _ in range(rng.choice([0, 1, 3, 9, 40]))] for _ in range(150)]
    convs += [convs[3][:2], [1] * 130, [1] * 129 + [2], [1] * 64]
    seq = sequences(convs)
    whole = {tuple(c[:d]) for c in convs for d in range(len(c) + 1)}
    nodes = {p for p in whole if not p or p in map(tuple, convs) or sum((*p, t) in whole for t in (1, 2)) > 1}
    for batch in (1, 7, 1000):
        trie = prefixes.ZFastTrie(seq).insert_all(batch)
        assert {tuple(convs[i][:d]) for i, d in zip(trie.like, trie.depth, strict=True)} == nodes and len(trie.depth) == len(nodes)
        assert len(trie.handles) == len(trie.named) == len(nodes) - 1
        for key, node in trie.handles.items():
            top = trie.depth[trie.above[node]]
            best = max(range(top + 1, trie.depth[node] + 1), key=lambda d: d & -d)
            assert key == seq.of(trie.like[node], best)
        for i, c in enumerate(convs):
            assert trie.depth[trie.locate(i)] == len(c) and i in trie.ends[trie.locate(i)]


def test_two_fattest():
    for a in range(70):
        for b in range(a + 1, 71):
            assert prefixes.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_many_copies(spark, monkeypatch):
    """A group of copies is hashed run by run, in the order of numbers."""
    monkeypatch.setattr(prefixes, "_PIECE", 20)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 1500, 7) for t in range(2)] + [(10**9, 0, "user", "x")]
    assert got(prefixes.prefix_tree(spark.createDataFrame(rows, TURNS), 100)) == brute(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(5, t, "user", "same") for t in range(700)] + [(6, t, "user", "same") for t in range(640)]
    found = prefixes.prefix_tree(spark.createDataFrame(rows, TURNS)).collect()
    size = sorted(len(c) for c in rebuilt(rows).values())
    assert len(found) == size[1] + 1 and {r.n_leaves for r in found} == {1} and sum(r.n_convs == 2 for r in found) == size[0] + 1
    assert prefixes.prefix_tree(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixes.prefix_tree(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []


def test_query(spark):
    from harness import DATA

    from quillcheck.llm.queries import QUERIES

    found = QUERIES["op12_conversation_prefix_trie"](spark, f"{DATA}/sf0.001")
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(found) == brute(rows)
