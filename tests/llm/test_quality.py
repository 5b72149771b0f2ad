"""Held-out accuracy, what may not enter a score, and odd tables."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from quillcheck.llm import quality
from quillcheck.llm.words import Texts

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def auc(score, truth):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = truth.sum()
    return (rank[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def test_held_out_accuracy(spark):
    from harness import DATA

    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    found = quality.scored(docs, labels).join(labels, "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    test = found[found.held_out]
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.97
    assert (test.predicted == test.quality).mean() > 0.97 and test[test.quality == 1].predicted.mean() > 0.99
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_labels_of_held_out_rows_change_nothing(spark, docs_of):
    rows = [(i, f"word{i % 7} other more {'!! XX' * (i % 2)} text " * 12) for i in range(200)]
    docs = docs_of(rows)
    one = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], LABELS)
    two = spark.createDataFrame([(i, (1 - i % 2) if zlib.crc32(str(i).encode()) % 5 else i % 2, 1) for i in range(200)], LABELS)
    scores = [{r.doc_id: r.score for r in quality.scored(docs, x).collect()} for x in (one, two)]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 1


def test_descriptions_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.WORDS, quality.DIM)).astype(np.float32)
    texts = pa.array([None, "", "one", "A b c " * 50, "x", "", "last WORDS!! here " * 30])
    whole = quality.describe(texts, vectors)
    alone = np.vstack([quality.describe(texts[i : i + 1], vectors) for i in range(len(texts))])
    monkeypatch.setattr(quality, "_SLAB", 8)
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole, quality.describe(texts, vectors), atol=1e-5)


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert quality.scored(docs_of([]), none).collect() == []
    docs = docs_of([(1, None), (None, "a b"), (2, ""), (2, "")]).selectExpr("*", "0.5D AS score", "1 AS quality")
    rows = quality.scored(docs, spark.createDataFrame([(None, 1, 0), (1, None, 0), (9, 0, 0)], LABELS)).collect()
    assert len(rows) == 4 and all(r.score > 0.99 and r.predicted == 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.accepted(docs, none).schema == docs.schema


def test_vocabulary_counts_not_only_shape(spark, docs_of):
    rng = np.random.default_rng(4)
    heads = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnprs"]
    rng.shuffle(heads)
    good, bad = ([h + "ino" for h in heads[k::2]] for k in (0, 1))
    rows = [(i, " ".join(rng.choice([*(good if i % 2 else bad), *["the", "of", "some"] * 10], 60))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], LABELS)
    held = [r for r in quality.scored(docs_of(rows), labels).collect() if r.held_out]
    assert len(held) > 80 and sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held) >= 0.95 * len(held)


def test_word_vectors_are_sums_of_neighbours(docs_of):
    texts = ["alpha beta alpha", "beta", None, "Gamma x9 alpha beta #"]
    want = np.zeros((quality.WORDS, quality.DIM))
    for t in texts:
        h = Texts(pa.array([t])).hashes()
        places, (at, sign) = quality.word_places(h), quality.word_index(h)
        for i in range(len(h) - 1):
            for a, b in ((i, i + 1), (i + 1, i)):
                np.add.at(want[places[a]], at[:, b], sign[:, b])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs_of(list(enumerate(texts)))), want, atol=1e-6) and want.any(axis=1).sum() == 5


def test_repeated_ids_do_not_depend_on_the_partitions(spark, docs_of):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bcdfgh" for b in range(30)]
    rows = [(i, " ".join(rng.choice(words[: 90 if (i + k) % 2 else 180], 60))) for i in range(150) for k in range(2)]
    labels = [(i, q, 0) for i in range(150) for q in ((i % 2,) if i % 7 else (0, 1))]
    got = []
    for parts in (1, 8):
        docs = docs_of([rows[k] for k in rng.permutation(len(rows))], parts)
        marked = spark.createDataFrame([labels[k] for k in rng.permutation(len(labels))], LABELS).repartition(parts)
        scores = quality.scored(docs, marked).select("doc_id", "score").collect()
        kept = quality.accepted(docs, marked).select("doc_id", "text").collect()
        got.append((sorted((r.doc_id, round(r.score, 9)) for r in scores), sorted(map(tuple, kept))))
    assert got[0] == got[1]


def test_temperature_lowers_the_loss_of_the_rows_kept_aside():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.5).astype(float)
    x = np.hstack([rng.normal(0, 1, (600, quality.WIDTH - 1)), (y + rng.normal(0, 1.5, 600))[:, None]])
    model = quality.fit(x, y, np.zeros((1, quality.DIM)))
    aside = np.random.default_rng(3).permutation(600)[:120]
    loss = lambda heat: np.logaddexp(0, np.where(y[aside] == 1, -1, 1) * model.logits(x[aside]) / heat).mean()
    assert model.temperature > 1.3  # an overfitted network is too sure of itself
    assert loss(model.temperature) <= min(loss(h) for h in (0.25, 0.5, 1, 2, 4, 8)) + 1e-9
    p = model.probability(x)
    assert ((p > 0.5) == (model.logits(x) > 0)).all()


def test_fewer_places(spark, sample_docs):
    from harness import DATA

    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    model = quality.trained(sample_docs, labels, places=64)
    assert model.words.shape == (64, quality.DIM) and sample_docs.select(model.score(sample_docs["text"]).alias("s")).where("s between 0 and 1").count() == sample_docs.count()
