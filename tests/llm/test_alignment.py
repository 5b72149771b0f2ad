"""Alignment against a byte-by-byte recount of all overlapping token pairs."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillcheck.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SIGNS = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
SIGNS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in SIGNS)}


def spans(ids, spelled):
    out, at = [], 0
    for i, s in zip(ids, spelled, strict=True):
        out.append((i, at, at + len(s)))
        at += len(s)
    return out


def tokens(text):
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(SIGNS[c] for c in A.id_to_token(i)) for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
        return [], []
    return spans(a, bytes_a), spans(b, bytes_b)


def brute(rows):
    of_text, counts = [], Counter()
    for doc, text in rows:
        a, b = tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(set(links))
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if s < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if s < y[2] <= e) for s, e in zip([0, *ends], ends)]
        of_text.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return sorted(((d, na, nb, ng, len(l), sum(counts[p] == highest[p[0]] for p in l), sum(counts[p] for p in l), h) for d, na, nb, ng, l, h in of_text), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_random_texts(docs_of, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "'s", "é", "12", "!?", " x", "the ", "日本", "😀", "\x00", "\t", "<|endoftext|>", "</s>", "<0x41>", "①", " running", "\xa0", "ﬁ", "é"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   "), (204, "a▁b"), (None, "the word"), (None, None), (205, rows[3][1]), (3, rows[3][1]), (206, "ends in a blank ")]
    want = brute(rows)
    assert got(alignment.aligned(docs_of(rows))) == want
    assert {r[0] for r in want if r[1] == 0} >= {200, 201, 204}


def test_whole_table(spark, sample_docs):
    from harness import DATA

    from quillcheck.llm.queries import QUERIES

    docs = sample_docs.collect()
    found = QUERIES["op11_cross_tokenizer_alignment"](spark, f"{DATA}/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 3000]
    assert got(alignment.aligned(sample_docs.where("coalesce(length(text), 0) < 3000"))) == brute(short)
    by_id = {r.doc_id: r for r in found.collect()}
    for r in docs:
        a, b = tokens(r.text)
        assert (by_id[r.doc_id].n_a, by_id[r.doc_id].n_b) == (len(a), len(b))
        assert by_id[r.doc_id].n_links == len({x[2] for x in a} | {y[2] for y in b})


@pytest.mark.parametrize("tail", ["", " ", "  ", "\n", " x"])
def test_long_texts_are_cut_without_a_trace(monkeypatch, tail):
    monkeypatch.setattr(alignment, "_SLAB", 50)
    rng = random.Random(4)
    pieces = alignment.Pieces.at(None)
    for _ in range(40):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "é", " running", "日", "\x00", "12"]) for _ in range(200)) + tail
        assert pieces([text]) == [B.encode(text)]
    assert pieces.may_cut


def test_empty_table_and_clashing_columns(docs_of):
    assert got(alignment.aligned(docs_of([]))) == []
    docs = docs_of([(1, "a b"), (2, "a b")]).selectExpr("*", "1 AS batch", "'k' AS kind", "2 AS n_a", "3 AS pair", "4 AS place")
    assert got(alignment.aligned(docs)) == brute([(1, "a b"), (2, "a b")])
