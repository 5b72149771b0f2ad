"""The pipeline's stages against brute force, and the registered SQL."""

import pytest
from harness import DATA, bag, duck

import corpus_pipeline
from quillcheck.llm.queries import ORACLE_SQL, QUERIES
from quillcheck.session import settled

SF_DIR = f"{DATA}/sf0.001"


def test_stages(spark):
    from test_contamination import brute as contained
    from test_packing import check
    from test_pii import base_spans
    from test_simhash import groups, slow_fingerprint

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(kept[-1])
    good, distinct, free, masked = kept
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i in good for i in clean) >= 0.98 * len(clean) and len(good) < 200
    fps = {i: slow_fingerprint(r.text) for i, r in good.items()}
    want = groups([(a, b) for a in fps for b in fps if a > b and bin(fps[a] ^ fps[b]).count("1") <= 2], fps)
    assert set(distinct) == set(want.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert set(free) == set(distinct) - {d for d, *_ in contained([(i, r.text) for i, r in distinct.items()], items)}
    assert set(masked) == set(free)
    for i, r in masked.items():
        before = base_spans(free[i].text)
        assert (r.text == free[i].text) or before or "<" in r.text
        assert all(free[i].text[s:e] not in r.text for k, s, e in before if k == "email")
        assert r.n_chars == (len(r.text) if r.text != free[i].text else free[i].n_chars)
    check(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect(), {i: r.text for i, r in masked.items()}, 2048)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 50


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    con = duck(SF_DIR).execute(ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, con.fetchall())
