"""Removal of repeated windows against counting all windows."""

import hashlib
import random
from collections import Counter

import pytest

from quillcheck.llm import substrings
from quillcheck.llm.words import Texts


def brute(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for p in range(i, i + size)}
        out.append((doc, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def got(docs, **kw):
    return sorted((tuple(r) for r in substrings.without_repeats(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("size", [2, 3, 5, 8, 35])
def test_random_texts(docs_of, size):
    rng = random.Random(size)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(size + rng.randint(-2, 12))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, None), (101, ""), (102, "  \n"), (None, passages[0]), (None, None), (103, rows[3][1]), (103, rows[3][1]), (104, "x\xa0y\x1cz " * (3 * size))]
    assert got(docs_of(rows), size=size, chunk_bytes=500) == brute(rows, size)


def test_whole_table(sample_docs):
    rows = [(r.doc_id, r.text) for r in sample_docs.collect()]
    want = brute(rows, 35)
    assert got(sample_docs) == want and sum(w[2] for w in want) > 1000


def test_one_hot_passage(docs_of):
    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(300)]
    found = got(docs_of(rows, 8), chunk_bytes=4000)
    assert all(r[1:] == (52, 50, f"a{r[0]} b{r[0]}") for r in found) and len(found) == 300


def test_empty_table_and_clashing_columns(docs_of):
    assert got(docs_of([])) == []
    extra = docs_of([(1, "a b")]).selectExpr("*", "'x' AS chunk", "1 AS bucket", "2 AS n_words", "'k' AS kept")
    assert got(extra) == [(1, 2, 0, "a b")]


def test_words_are_those_of_bytes_split():
    import pyarrow as pa

    texts = ["a b", "", None, "c\xa0d e", "\tf\n", "ß\x0bü", "end"]
    t = Texts(pa.array(texts)[1:])
    words = [[t.data[s:e].tobytes() for s, e in zip(t.starts[a:b], t.ends[a:b], strict=True)] for a, b in zip(t.first, t.first[1:])]
    assert words == [(x or "").encode().split() for x in texts[1:]]
    assert len(set(Texts(pa.array(["a b a ab ba"])).hashes().tolist())) == 4


def test_query_digest(spark):
    from harness import DATA

    from quillcheck.llm.queries import QUERIES

    found = {r.doc_id: r for r in QUERIES["op2_substring_dedup"](spark, f"{DATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    for doc, _, n, kept in brute([(r.doc_id, r.text) for r in docs], 35):
        assert found[doc].n_removed == n and found[doc].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
