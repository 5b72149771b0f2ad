"""The automaton's scores against a plain recursion over counts in dictionaries."""

import math
import random
import zlib
from collections import Counter

import pytest

from quillcheck.llm import ngrams

UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text):
    return [*(text or "").encode().translate(UPPER).split(), "end"]


def is_held_out(doc, folds=5, held=1):
    return zlib.crc32(str("" if doc is None else doc).encode()) % folds == held


def brute(rows, order, prior):
    counts, n = Counter(), 0
    for doc, text in rows:
        if not is_held_out(doc):
            t = ["start", *tokens(text)]
            n += len(t) - 1
            counts[("start",)] += 1
            counts.update((w,) for w in t[1:])
            counts.update(tuple(t[i : i + k]) for k in range(2, order + 1) for i in range(len(t) - k + 1))
    types = sum(len(k) == 1 and k != ("start",) for k in counts)

    def p(history, word):
        if not history:
            return (counts[(word,)] + 0.5) / (n + 0.5 * (types + 1))
        a = prior[min(len(history) - 1, len(prior) - 1)]
        return (counts[(*history, word)] + a * p(history[1:], word)) / (counts[history] + a)

    out = []
    for doc, text in rows:
        t = ["start", *tokens(text)]
        base = sum(math.log10(p((), w)) for w in t[1:])
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        out.append((doc, is_held_out(doc), len(t) - 1, sum(counts[(w,)] > 0 for w in t[1:]), n, base, score))
    return sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r) for r in got), key=str), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_random_texts(docs_of, order, monkeypatch):
    monkeypatch.setattr(ngrams, "_STEPS", 16)
    rng = random.Random(order)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice("aAbcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "a b c"), (None, None), (3, "a b a b"), (3, "a b a b"), (203, "never seen wörds \xa0 here"), (204, "a b " * 400)]
    same(ngrams.scored(docs_of(rows), order=order, chunk_bytes=700, range_bytes=900).collect(), brute(rows, order, ngrams.PRIOR))


def test_long_runs_begin_in_the_right_state(docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([3, 511, 512, 513, 2000])))) for i in range(20)]
    same(ngrams.scored(docs_of(rows)).collect(), brute(rows, 3, ngrams.PRIOR))


def test_whole_table(spark, sample_docs):
    from harness import DATA

    from quillcheck.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in sample_docs.collect()]
    want = brute(rows, ngrams.ORDER, ngrams.PRIOR)
    got = QUERIES["op13_lm_scoring"](spark, f"{DATA}/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    same(got, want)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hot_text_and_columns(docs_of):
    rows = [(i, "the same text again") for i in range(400)] + [(1000 + i, f"w{i}") for i in range(30)]
    docs = docs_of(rows, 8).selectExpr("*", "1 AS chunk", "true AS held_out", "2 AS n_tokens", "0.5 AS score", "'x' AS bucket")
    same(ngrams.scored(docs, chunk_bytes=300, range_bytes=700).collect(), brute(rows, 3, ngrams.PRIOR))


def test_empty_table_and_no_training_rows(docs_of):
    assert ngrams.scored(docs_of([])).collect() == []
    only = next(i for i in range(100) if is_held_out(i))
    same(ngrams.scored(docs_of([(only, "a b c")])).collect(), brute([(only, "a b c")], 3, ngrams.PRIOR))
