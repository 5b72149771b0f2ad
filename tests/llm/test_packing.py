"""Packing against the tokeniser itself, gapless sequences and the number of sequences."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillcheck.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, capacity):
    """``texts`` by doc_id; every document's ids come out once, in sequences without gaps."""
    ids = {i: np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    cut, by_sequence = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        cut.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(cut) == set(ids)
    for i, parts in cut.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(-(-len(ids[i]) // capacity)))
        assert [p[1] for p in parts] == [0, *np.cumsum([p[2] for p in parts])[:-1]] and sum(p[2] for p in parts) == len(ids[i])
        assert all(p[2] == capacity for p in parts[1:])
    for places in by_sequence.values():
        places.sort()
        ends = [0, *itertools.accumulate(n for _, n in places)]
        assert [o for o, _ in places] == ends[:-1] and ends[-1] <= capacity
    return len(by_sequence)


def test_whole_table(sample_docs):
    rows = packing.pack(sample_docs).collect()
    used = check(rows, {r.doc_id: r.text for r in sample_docs.collect()}, packing.CAPACITY)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_odd_rows(docs_of):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "x", 5: "x", 6: "tab\tand\x1cmore  blanks \n\n ends ", 7: "日本語のテキスト ١٢٣ é²³", 8: "<|endoftext|> in a text"}
    docs = docs_of(texts.items()).selectExpr("*", "1 AS piece", "2 AS length", "'a' AS part")
    check(packing.pack(docs).collect(), texts, packing.CAPACITY)


def test_empty_table_and_null_ids(docs_of):
    assert packing.pack(docs_of([])).collect() == []
    rows = packing.pack(docs_of([(None, "a b"), (7, "a b"), (7, "a b")])).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 3)]


def test_long_text_is_cut_like_the_tokeniser():
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "'s", "é", "12", "!?", " x"]) for _ in range(60_000))
    old, packing._SLAB = packing._SLAB, 1000
    try:
        assert packing.Encoder.at(None)(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    finally:
        packing._SLAB = old


def fewest(sizes, capacity):
    """The least number of bins, by trying everything."""
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[k] <= capacity:
                at = bins.index(b)
                go(k + 1, [*bins[:at], b + sizes[k], *bins[at + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_the_optimum(sizes):
    """What the rules fix, with an optimal packing of the rest, is an optimal packing of all."""
    counts = np.bincount(sizes, minlength=21)
    fixed, left = packing.reduce_by_dominance(counts, 20)
    rest = [s for s in range(21) for _ in range(left[s])]
    assert sorted(rest + [s for members, n in fixed for s in members for _ in range(n)]) == sorted(sizes)
    assert all(sum(members) <= 20 for members, _ in fixed)
    assert sum(n for _, n in fixed) + (fewest(sorted(rest, reverse=True), 20) if rest else 0) == fewest(sorted(sizes, reverse=True), 20)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    rooms: list[int] = []
    for s in sizes:
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms[rooms.index(min(fits))] -= s
        else:
            rooms.append(100 - s)
    made = packing.best_fit(np.bincount(sizes, minlength=101), 100)
    assert sum(n for _, n in made) == len(rooms)
    assert sorted(100 - sum(m) for m, n in made for _ in range(n)) == sorted(rooms)


def test_ids_of_odd_texts():
    """Long runs, special names and signs of all kinds, against the tokeniser itself."""
    rng = random.Random(5)
    signs = "aAé1 \n\t'sß中\x85\xa0 ½²^<|>\x00​😀ｓ́tll've"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["a" * 300_000, " " * 1_200_000 + "x", "x" + "\n" * 1_200_000, "x " * 700_000, "a<|endoftext|>b"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert packing.Encoder.at(None).quick is not None
    for t in texts:
        assert packing.Encoder.at(None)(t) == np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.Encoder.at(None, plain=True)(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert [len(b) for b in packing.Encoder.at(None).bytes_of[:256]] == [1] * 256
