"""Personal data against Python's regular expressions, run one match at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillcheck.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def found(docs):
    rows = pii.with_spans(docs.select("doc_id", "text")).collect()
    return [(r.doc_id, r.text, [(s.kind, s.start, s.end, s.score) for s in r.pii]) for r in rows]


def assert_base(docs):
    rows = found(docs)
    for _, text, spans in rows:
        assert [s[:3] for s in spans if s[0] in pii.BASE] == base_spans(text), text
    return rows


HARD = [
    None, "", "x", "a@b.c", "a@b", "a@b.c_d@e.f", "a@b@c.de", ".@-.-", "a@b..c", "a@b.c.d.e.", "é@x.yz ü@", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.04",
    "01.2.3.4444", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111111 5", "0000000000000", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (234) 567-8901",
    "++12 3", "+1((((((", "+1.2.3.4.5.6.7.8.9.0.1.2.3.4.5", "\U0001f600 +49 30 1234567 a@b.cd", "+1 234 567 890 ) (", "5555 5555 5555 4444\n4111 1111", "1" * 30,
]


def test_hard_texts(docs_of):
    rows = assert_base(docs_of(list(enumerate(HARD)) + [(None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")]))
    assert len(rows) == len(HARD) + 3


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(docs_of, seed):
    rng = random.Random(seed)
    alphabet = ["a", "Z", "@", ".", "-", "_", "%", "+", "(", ")", " ", "\n", "é", "\U0001f600", "1", "9", "25", "255", "4111", "@b.", " +49 30", "0.0"]
    assert_base(docs_of([(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))) for i in range(1500)]))


def test_long_runs_are_linear(docs_of):
    units = ["a", "1", "1.", "a.b@", "1 ", "+1", "+", "+1 ", "-", "("]
    assert_base(docs_of([(i, u * 700) for i, u in enumerate(units)]))
    rows = found(docs_of([(i, u * 60_000) for i, u in enumerate(units)], 9))
    assert {i: len(spans) for i, _, spans in rows} == {0: 0, 1: 0, 2: 15_000, 3: 30_000, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}


def test_many_spans_are_masked(docs_of):
    many = "x " + "a@b.cd " * 3000
    assert [r.text for r in pii.redacted(docs_of([(1, many)])).collect()] == ["x " + "<EMAIL> " * 3000]


def test_whole_table(sample_docs):
    rows = assert_base(sample_docs)
    assert {s[0] for _, _, spans in rows for s in spans} >= set(pii.BASE)


def test_checksums_and_context(docs_of):
    texts = ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "DE89370400440532013000", "my ssn is 123-45-6789", "part 123-45-6789", "call +1 234 567 8901", "a +1 234 567 8901"]
    by = {r[0]: r[2] for r in found(docs_of(list(enumerate(texts))))}
    assert [s[0] for s in by[0]] == ["iban"] and "iban" not in [s[0] for s in by[1]] and by[2][0][:3] == ("iban", 0, 22)
    assert [s[0] for s in by[3]] == ["ssn"] and by[4] == []
    assert by[5][0][3] > by[6][0][3] >= pii.LEAST_SCORE


def test_masking(docs_of):
    texts = {1: "mail a@b.cd now", 2: None, 3: "none", 4: "1.2.3.4", 5: "é +1 234 567 8901, 4111 1111 1111 1111.", 6: "a@1.2.3.4.com x"}
    docs = docs_of(texts.items()).selectExpr("*", "7 AS pii", "8 AS pii_found", "9 AS `__pii_found`")
    rows = {r.doc_id: r for r in pii.redacted(docs, length_col="n_chars").collect()}
    assert pii.redacted(docs, length_col="n_chars").schema == docs.schema
    assert rows[1].text == "mail <EMAIL> now" and rows[1].n_chars == 16 and rows[2].text is None and rows[2].n_chars is None
    assert rows[3].text == "none" and rows[4].text == "<IP>" and rows[6].text == "<EMAIL> x"
    assert rows[5].text == "é <PHONE>, <CARD>." and (rows[5].pii, rows[5].pii_found) == (7, 8)
    assert pii.redacted(docs_of([])).collect() == []


def test_native(docs_of):
    plan = pii.with_spans(docs_of([(1, "a@b.c")]).select("doc_id", "text")).select(F.size("pii"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
