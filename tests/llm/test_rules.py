"""Statistics against plain Python, and what the decision list learns."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from quillcheck.llm import rules

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(triples)
    covered = {p for i, t in enumerate(triples) if seen[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def stats(docs):
    return [(r.doc_id, r.text_, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rules.statistics(docs).join(docs.selectExpr("doc_id", "text AS text_"), "doc_id").collect()]


def test_statistics(docs_of):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "é \xa0 \x1c z", "l\nl\n\nl \n|", "\x0b\x0ca\r\n", "a a a b a a a"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "|", "é", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    for _, text, found in stats(docs_of(list(enumerate(texts)))):
        assert found == brute(text), repr(text)


def test_statistics_of_whole_table(sample_docs):
    for _, text, found in stats(sample_docs):
        assert found == brute(text)


def test_learns_conjunctions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = ((x[:, 1] > 0.7) & (x[:, 4] < 0.5)) | (x[:, 2] > 0.9)
    learned = rules.learn(x, (~bad).astype(int))
    caught = np.any([rules._covers(r, x) for r in learned], axis=0)
    assert (caught == bad).mean() > 0.98 and (caught & ~bad).mean() < 0.01
    assert rules.learn(x, np.ones(len(x))) == [] and rules.learn(x[:0], np.ones(0)) == []


def test_verdicts(spark, sample_docs):
    from harness import DATA

    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = rules.judged(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in clean]) > 0.99 and np.mean([r.kept for r in junk]) < 0.1
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert rules.judged(docs_of([]), none).collect() == []
    docs = docs_of([(1, None), (None, "w " * 60), (2, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(60))))]).selectExpr("*", "1 AS quality", "2 AS n_words", "'h' AS hashes")
    labels = spark.createDataFrame([(1, None, 0), (None, 0, 0), (2, 1, 0), (2, 0, 0), (77, 0, 0)], LABELS)
    rows = rules.judged(docs, labels).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in rows) == [("1", True, False), ("2", False, True), ("2", False, True), ("None", True, False)]


def test_native(spark, docs_of):
    plan = rules.statistics(docs_of([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_ids_do_not_depend_on_the_partitions(spark, docs_of):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(200)] if (i + k) % 2 else ["#$%", "a", "b"], 80))) for i in range(120) for k in range(2)]
    labels = [(i, q, 0) for i in range(120) for q in ((i % 2,) if i % 7 else (0, 1))]
    got = []
    for parts in (1, 8):
        docs = docs_of([rows[k] for k in rng.permutation(len(rows))], parts)
        marked = spark.createDataFrame([labels[k] for k in rng.permutation(len(labels))], LABELS).repartition(parts)
        got.append(sorted((r.doc_id, r.n_symbols, r.kept) for r in rules.judged(docs, marked).collect()))
    assert got[0] == got[1] and any(r[2] for r in got[0]) and not all(r[2] for r in got[0])
    one = rules.judged(docs_of(rows), spark.createDataFrame(labels, LABELS), most_rules=0)
    assert all(r.kept != r.base_failed for r in one.collect())
