"""Containment against sets of shingles, one pair at a time."""

import random

from pyspark.sql import types as T

from quillcheck.llm import contamination

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    sets = [(i, shingles(t)) for i, t in items]
    out = set()
    for d, t in docs:
        have = shingles(t)
        out |= {(d, i, len(s), len(s & have)) for i, s in sets if s and len(s & have) >= 0.8 * len(s) - 1e-9}
    return out


def found(docs, items):
    rows = contamination.contaminated(docs, items).collect()
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in rows]
    assert len(got) == len(set(got)) and all(abs(r.containment - r.n_found / r.n_shingles) < 1e-12 for r in rows)
    return set(got)


def test_edited_items(spark, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 200])))) for i in range(40)] + [(90, None), (91, ""), (5, "one more part of item five")]
    docs = []
    for d in range(300):
        parts = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or '').split() if rng.random() < 0.9 else []
            for _ in range(rng.randint(0, 3)):
                if own:
                    own[rng.randrange(len(own))] = word()
            at = rng.randint(0, len(parts))
            parts[at:at] = [w.upper() if rng.random() < 0.1 else w for w in own]
        docs.append((d, rng.choice([" ", "\n", "\t"]).join(parts)))
    docs += [(1000, None), (1001, ""), (None, items[6][1])]
    rows = docs_of(docs).selectExpr("*", "1 AS item_id", "'x' AS shingles")
    table = spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert found(rows, table) == want and len(want) > 50
    bad = {d for d, *_ in want}
    assert sorted(r.doc_id for r in contamination.clean(docs_of(docs), table).collect()) == sorted(d for d, _ in docs if d not in bad)


def test_whole_table(spark, sample_docs):
    from harness import DATA

    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in sample_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(sample_docs, items) == want and want


def test_empty_tables(spark, docs_of, sample_docs):
    none = spark.createDataFrame([], ITEMS)
    assert found(sample_docs, none) == set() and found(docs_of([]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)) == set()
    assert contamination.clean(sample_docs, none).count() == sample_docs.count()


def test_rows_without_id_are_told_apart(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    docs = docs_of([(None, "x a b c d e f g y"), (None, "clean"), (2, "a b c d e f g"), (2, "a b c d e f g")])
    assert [r.text for r in contamination.clean(docs, items).collect()] == ["clean"]
    assert found(docs, items) == {(None, 1, 3, 3), (2, 1, 3, 3)}


def test_items_without_id_are_searched_each_on_its_own(spark, docs_of):
    items = spark.createDataFrame([(None, "a b c d e f g"), (None, "h i j k l m n o"), (4, "p q r s t u v"), (None, None)], ITEMS)
    docs = docs_of([(1, "x a b c d e f g y"), (2, "h i j k l m n o"), (3, "P Q r s t u v"), (4, "clean words that hold no item")])
    assert found(docs, items) == {(1, None, 3, 3), (2, None, 4, 4), (3, 4, 3, 3)}
    assert [r.doc_id for r in contamination.clean(docs, items).collect()] == [4]


def test_rows_that_share_an_id_are_items_of_their_own(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n o p q r s t u v"), (1, "a b c d e f g")], ITEMS)
    docs = docs_of([(1, "x a b c d e f g y"), (2, "only h i j k l m n"), (3, "h i j k l m n o p q r s t u v")])
    assert found(docs, items) == {(1, 1, 3, 3), (3, 1, 11, 11)}
    assert [r.doc_id for r in contamination.clean(docs, items).collect()] == [2]
