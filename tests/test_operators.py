"""Operators on small inputs whose answer is known, with hot keys and odd cases."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quillcheck.functions import text as tx
from quillcheck.operators import catalog as cat
from quillcheck.operators import clauses as cl
from quillcheck.operators import equivalence as eq
from quillcheck.operators import linking as ln
from quillcheck.operators import metrics as mt
from quillcheck.operators import ranking as rk
from quillcheck.operators import values as vals
from quillcheck.operators import vectors as vec
from quillcheck.operators.components import connected_minimum
from quillcheck.operators.ordering import running, with_ordinal
from quillcheck.plans import clause_queries
from quillcheck.plans.views import view
from quillcheck.sources import corpus
from quillcheck.sources.tables import Tables


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first()["r"]


def test_text_rules(spark):
    assert one(spark, "a\n\r b  <>   c", tx.one_line) == "a b != c"
    assert one(spark, "Sure: ```SELECT 1``` ok", tx.sql_in_reply) == "SELECT 1"
    assert one(spark, "no query", tx.sql_in_reply) == "no query"
    assert one(spark, "SELECT A FROM t WHERE x = 'Big City' AND Y = \"Z\"", tx.lower_outside_quotes) == (
        "select a from t where x = 'Big City' and y = \"Z\""
    )
    assert one(spark, "select DISTINCT a where b = 'distinct x'", tx.drop_distinct) == "select  a where b = 'distinct x'"
    assert one(spark, "year ( CURDATE ( ) ) > 1", tx.fix_current_year) == "2020> 1"
    assert one(spark, "MAX(a) LOWER(b) UPPER(c) LOWER(d)", tx.forbidden_functions) == ["LOWER", "UPPER"]
    assert one(spark, '"it""s"', tx.unquote) == 'it"s'
    assert one(spark, "SELECT t1.* , T4.*;", tx.plain_star) == "SELECT * , T4.*"
    assert " ".join(one(spark, "SELECT a FROM t1 WHERE T2.b = 'x y' AND c > 1.5 LIMIT 3", tx.masked_tokens)) == (
        "select a from t1 where t2 . b = valuerare and c > valuerare limit valuerare"
    )
    found = one(spark, "SELECT 1 WHERE Shop.City = 'Rome' AND T1.x >= 4 AND a.b between 1 and 2;", tx.comparisons)
    assert [tuple(x) for x in found] == [("shop", "CITY", "Rome"), (None, "X", "4"), ("a", "B", "1"), ("a", "B", "2")]


def test_type_families(spark):
    declared = ["VARCHAR(9)", "", "datetime", "uuid", "interval", "BOOLEAN", "blob", "year", "double", "longtext"]
    df = spark.createDataFrame([(d,) for d in declared], "d string")
    got = [r[0] for r in df.select(cat.type_family(F.col("d"))).collect()]
    assert got == ["text", "text", "time", "number", "number", "boolean", "others", "time", "number", "text"]


def test_running_totals_over_blocks_and_hot_keys(spark):
    rng = random.Random(5)
    rows = sorted((n, rng.randint(0, 9)) for n in rng.sample(range(5000), 800))
    df = spark.createDataFrame(rows, "n bigint, v bigint").repartition(7)
    got = {r["n"]: (r["s"], r["m"]) for r in running(df, "n", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, 64).collect()}
    total, top = 0, 0
    for n, v in rows:
        total, top = total + v, max(top, v)
        assert got[n] == (total, top)


def test_ordinal_is_dense_and_sorted(spark):
    rng = random.Random(6)
    rows = [(n, rng.randint(0, 3)) for n in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, k int").repartition(9)
    got = [(r["k"], r["id"]) for r in with_ordinal(df, [F.desc("k"), "id"]).orderBy("ordinal").collect()]
    assert got == sorted(((k, i) for i, k in rows), key=lambda x: (-x[0], x[1]))


def test_sessions_from_files(spark, tmp_path):
    # Three files, an empty session in the middle and one session with most of the lines.
    text = ["q1\tdb", "q2\tdb", "", "", *[f"long{i}\tdb" for i in range(300)], "", "last\tdb"]
    folder = tmp_path / "gold"
    folder.mkdir()
    (folder / "part-0").write_text("\n".join(text[:50]) + "\n")
    (folder / "part-1").write_text("\n".join(text[50:60]) + "\n")
    (folder / "part-2").write_text("\n".join(text[60:]) + "\n")
    lines = corpus.read_lines(spark, str(folder))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == text
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(len(text)))
    got = [(r["session_no"], r["turn_idx"], r["line"]) for r in corpus.sessions(lines, block=16).orderBy("line_no").collect()]
    want, session, turn = [], 0, 0
    for line in text:
        if line == "":
            session, turn = session + 1, 0
        else:
            want.append((session, turn, line))
            turn += 1
    assert got == want


def test_json_array_corpus(spark, tmp_path):
    rows = [{"db_id": "a", "question": "q", "query": "select 1", "sql": {"x": 1}}, {"db_id": "b", "question": None, "query": "s"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = {tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "c.json")).collect()}
    assert got == {("a", "q", "select 1"), ("b", None, "s")}


def test_equivalence_is_metamorphic(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 3), rng.choice("ab"), rng.random() < 0.5, 1.5) for _ in range(200)] + [(9, "hot", True, 0.5)] * 100
    gold = spark.createDataFrame(rows, "a int, b string, c boolean, d double")
    shuffled = gold.orderBy(F.rand(3))
    verdict = lambda g, p: eq.equal_up_to_columns(g, p).first()["equal"]
    assert verdict(gold, shuffled.select("d", "c", "b", "a"))
    assert verdict(gold, shuffled.select(F.col("a").cast("bigint"), "b", "c", "d"))
    assert not verdict(gold, shuffled.unionAll(gold.limit(1)))
    assert not verdict(gold, shuffled.withColumn("a", F.when(F.col("a") == 9, 8).otherwise(F.col("a"))))
    assert not verdict(gold, gold.select("a", "b", "c"))
    # The same cells column by column, but paired differently.
    left = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    right = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert not verdict(left, right)
    assert verdict(left, left.select("b", "a"))
    # Text never equals a number; two empty results are equal whatever their columns.
    assert not verdict(left.select("a"), spark.createDataFrame([("1",), ("2",)], "a string"))
    assert eq.bag_equal(left.filter("a > 5"), left.filter("a > 5").select("a")).first()["equal"]


def test_connected_minimum_of_a_chain(spark):
    edges = [(n, n + 1) for n in range(0, 9)] + [(100, 50), (50, 70)] + [(200, 300 + n) for n in range(50)]
    got = {r["node"]: r["canonical"] for r in connected_minimum(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[n] == 0 for n in range(10))
    assert {got[100], got[50], got[70]} == {50}
    assert all(got[300 + n] == 200 for n in range(50))


def test_hardness_table(spark):
    cases = {(1, 0, 0): "easy", (1, 0, 2): "medium", (2, 0, 1): "medium", (2, 0, 3): "hard", (3, 0, 2): "hard", (0, 1, 0): "hard",
             (2, 1, 0): "extra", (4, 0, 0): "extra", (3, 0, 3): "extra"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "c int, n int, o int, want string")
    got = df.select("want", cl.hardness(F.col("c"), F.col("n"), F.col("o")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_zero_f1_and_empty_rates(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0)], "a double, r double")
    assert [round(r[0], 6) for r in df.select(mt.f1(F.col("a"), F.col("r"))).collect()] == [1.0, 0.666667]


def test_negative_samples(spark):
    rows = [("hot", n, int(n % 50 == 0)) for n in range(1000)] + [("small", 1, 1), ("small", 2, 0)]
    df = spark.createDataFrame(rows, "g string, item bigint, label int").repartition(8)
    first = rk.with_negatives(df, "g", "item", "label").collect()
    again = rk.with_negatives(df.repartition(3), "g", "item", "label").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    labels = {(g, i): lab for g, i, lab in rows}
    per = {}
    for g, positive, item, label in map(tuple, first):
        assert labels[(g, item)] == label and labels[(g, positive)] == 1
        per.setdefault((g, positive), []).append(label)
    assert sorted(per[("small", 1)]) == [0, 1]
    assert len(per) == 21 and all(sorted(v) == [0, 0, 0, 1] for k, v in per.items() if k[0] == "hot")


def test_final_pick(spark):
    rows = [("none", None, None, None), ("first", 0, "a", 3), ("first", 1, "b", 4), ("alone", 0, "a", 0), ("second", 0, "a", 0),
            ("second", 1, "b", 0), ("failed", 0, "a", None), ("failed", 1, "b", None)]
    df = spark.createDataFrame(rows, "g string, pos int, text string, n int")
    got = {r["g"]: r["pick"] for r in rk.final_pick(df, "g", "pos", "text", "n").collect()}
    assert got == {"none": "None", "first": "a", "alone": "a", "second": "b", "failed": "a"}


def test_search_survives_nulls(spark):
    frame = spark.createDataFrame([("Rome", 1), (None, 2), ("Romme", None)], "city string, n int")
    index = vals.table_values(frame, "t", ["city", "n"])
    assert {tuple(r) for r in index.collect()} == {("t", "city", "Rome"), ("t", "city", "Romme"), ("t", "n", "1"), ("t", "n", "2")}
    probes = spark.createDataFrame([("t", "city", "rome"), ("t", "city", None)], "tbl string, col string, literal string")
    found = vals.search(probes, index.unionAll(spark.createDataFrame([("t", "city", None)], index.schema)), ["tbl", "col"], k=2)
    assert [(r["literal"], r["value"]) for r in found.orderBy("place").collect()] == [("rome", "Rome"), ("rome", "Romme")]


def test_null_vectors_score_least(spark):
    rows = [("x", 1, [1.0, 0.0]), ("x", 2, None), ("x", 3, [0.0, 1.0])]
    emb = spark.createDataFrame(rows, "label string, id int, vector array<double>")
    got = {r["id"]: (r["other_id"], r["score"]) for r in vec.nearest(emb, emb, ["label"], k=1, skip_same=True).collect()}
    assert got == {1: (3, 0.0), 2: (1, -1.0), 3: (1, 0.0)}


def test_java_suffixes_are_no_numbers(spark):
    for text, number in (("1d", None), ("1f", None), (" 1.50 ", 1.5), ("-.5", -0.5), ("1e3", 1000.0), ("", None), ("1.", 1.0)):
        assert one(spark, text, tx.number_or_null) == number


def test_longest_runs_are_the_earliest():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    at, size = ln.longest_runs(texts[:200], texts[200:])
    for a, b, x, n in zip(texts[:200], texts[200:], at, size):
        best = max((k for i in range(len(a)) for k in range(len(a) - i + 1) if a[i : i + k] in b), default=0)
        assert n == best and (not n or x == next(i for i in range(len(a)) if a[i : i + n] in b))


def test_equality_of_numbers_is_exact(spark):
    big = spark.createDataFrame([(9007199254740993,)], "a bigint")
    near = spark.createDataFrame([(9007199254740992.0,)], "a double")
    assert not eq.bag_equal(big, near).first()["equal"] and eq.bag_equal(big.selectExpr("a - 1 AS a"), near).first()["equal"]
    assert not eq.keyed_columns_equal(big.selectExpr("0 AS n", "a"), big.selectExpr("0 AS n", "a - 1 AS a"), "n").first()["equal"]
    assert eq.bag_equal(spark.sql("SELECT 1.50BD AS a"), spark.sql("SELECT 1.5D AS a")).first()["equal"]


def test_ordered_results_in_other_columns(spark):
    gold = spark.createDataFrame([(0, "a", 5), (1, "b", 4), (2, "a", 3)], "ordinal int, x string, n int")
    assert eq.ordered_equal(gold, gold.select("n", "ordinal", "x")).first()["equal"]
    turned = gold.selectExpr("2 - ordinal AS ordinal", "n", "x")
    assert not eq.ordered_equal(gold, turned).first()["equal"]
    # a column that holds the same numbers as the ordinal isn't taken for it
    same = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "ordinal int, n int")
    assert not eq.ordered_equal(same, same.selectExpr("n AS ordinal", "ordinal AS n").selectExpr("ordinal", "2 - n AS n")).first()["equal"]


def test_many_like_columns_take_few_jobs(spark):
    wide = spark.range(5).selectExpr(*[f"id AS c{i}" for i in range(8)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("like-columns", "")
    assert eq.equal_up_to_columns(wide, wide).first()["equal"]
    assert len(tracker.getJobIdsForGroup("like-columns")) <= 12  # three queries of a few stages each
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_results_count_in_a_suite(spark):
    rows = [(1, "a", "gold", 5), (1, "a", "pred", 5), (2, "a", "gold", 5)]
    results = spark.createDataFrame(rows, "query_id int, db_id string, role string, c0 int")
    roster = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in "ab"], "query_id int, db_id string")
    got = {r["query_id"]: (r["n_databases"], r["n_equal"], r["passed"]) for r in eq.suite_verdicts(results, roster).collect()}
    assert got == {1: (2, 2, True), 2: (2, 1, False), 3: (2, 2, True)}


def test_branches_of_any_depth(spark):
    base = spark.createDataFrame([(n, n != 6) for n in range(20)], "query_id bigint, same boolean")
    links = spark.createDataFrame([(n, n + 1, role, "union") for n in range(6) for role in ("gold", "pred")], "parent_id bigint, child_id bigint, role string, kind string")
    assert cl.nesting(links) == 6 and cl.nesting(links.filter("parent_id < 0")) == 0
    branches = cl.branch_pairs(links).withColumn("child", F.col("gold_id"))
    got = {r["query_id"]: r["exact"] for r in cl.exact_matches(base, branches).collect()}
    assert got == {n: n > 6 for n in range(20)}


UNITS = (
    "query_id bigint, role string, clause string, ordinal bigint, connector string, not_op boolean, op string, agg string, unit_op string, col string,"
    " is_distinct boolean, value string, value_kind string, direction string"
)


def unit(query, role, clause, col, ordinal=0, agg="none"):
    return (query, role, clause, ordinal, None, False, None, agg, "none", col, None, None, None, None)


def test_branches_with_ids_of_their_own(spark):
    """Chains of six set operators; the predicted branches have other ids, shared by no gold query."""
    kinds = ["union", "except", "intersect"]
    units, links, want = [], [], {}
    for case, wrong in enumerate([None, 6, 3, 0, "kind", "missing"]):
        start = 100 * case
        for n in range(7):
            gold, pred = start + n, start + n if n == 0 else start + 50 + n
            for q, role in ((gold, "gold"), (pred, "pred")):
                bad = role == "pred" and wrong == n
                units += [unit(q, role, "select", f"c{n}"), unit(q, role, "select", "other" if bad else "d", 1), unit(q, role, "from", "t")]
            if n:
                kind = kinds[n % 3]
                links.append((start + n - 1, gold, "gold", kind))
                if not (wrong == "missing" and n == 4):
                    links.append((start if n == 1 else start + 50 + n - 1, pred, "pred", kinds[(n + 1) % 3] if wrong == "kind" and n == 5 else kind))
        want[start] = (wrong is None, 1 if wrong in (None, 0) else 0)
    scored = cl.score(spark.createDataFrame(units, UNITS), spark.createDataFrame(links, "parent_id bigint, child_id bigint, role string, kind string"))
    got = {r["query_id"]: (r["exact"], r["overlap"]) for r in scored.collect()}
    assert {q: got[q] for q in want} == want
    assert all(r[0] is False for q, r in got.items() if q not in want)  # gold branches without a prediction of their id
    assert len(got) == 42


def test_a_branch_that_is_not_there(spark):
    """Links to a query without clauses, on both sides or on one, agree with nothing."""
    units = [unit(q, r, "select", "a") for q in (1, 2, 3) for r in ("gold", "pred")] + [unit(9, "gold", "select", "b")]
    links = [(1, 50, "gold", "union"), (1, 50, "pred", "union"), (2, 9, "gold", "union"), (2, 51, "pred", "union")]
    scored = cl.score(spark.createDataFrame(units, UNITS), spark.createDataFrame(links, "parent_id bigint, child_id bigint, role string, kind string"))
    got = {r["query_id"]: (r["exact"], r["label_total"], r["pred_total"], r["overlap"]) for r in scored.collect()}
    assert got == {1: (False, 1, 1, 0), 2: (False, 1, 1, 0), 3: (True, 0, 0, 0), 9: (False, 0, 0, 0)}


def test_a_branch_that_many_queries_share(spark):
    units = [unit(q, r, "select", "a") for q in range(40) for r in ("gold", "pred")] + [unit(900, "gold", "select", "b"), unit(901, "pred", "select", "b"), unit(902, "pred", "select", "z")]
    links = [(q, 900, "gold", "union") for q in range(40)] + [(q, 901 if q % 2 else 902, "pred", "union") for q in range(40)]
    scored = cl.score(spark.createDataFrame(units, UNITS), spark.createDataFrame(links, "parent_id bigint, child_id bigint, role string, kind string"))
    assert {r["query_id"]: r["exact"] for r in scored.where("query_id < 900").collect()} == {q: q % 2 == 1 for q in range(40)}


def brute_equal(gold, pred, ordered):
    from itertools import permutations

    if not gold and not pred:
        return True
    if len(gold) != len(pred) or len(gold[0]) != len(pred[0]):
        return False
    turned = ([tuple(r[i] for i in o) for r in pred] for o in permutations(range(len(gold[0]))))
    return any(t == gold if ordered else sorted(t) == sorted(gold) for t in turned)


def test_suite_against_all_permutations(spark):
    """Small results with many like columns, each compared with an altered copy, with and without order."""
    rng = random.Random(31)
    rows, run, want = [], [], {}
    for q in range(60):
        width, ordered = rng.randint(1, 4), q % 2 == 0
        for d in "ab":
            gold = [tuple(rng.choice("xy") for _ in range(width)) for _ in range(rng.randint(0, 5))]
            order = rng.sample(range(width), width)
            pred = [tuple(r[i] for i in order) for r in gold]
            turn = rng.random()
            if turn < 0.25:
                rng.shuffle(pred)
            elif turn < 0.45 and pred:
                at = rng.randrange(len(pred))
                pred[at] = tuple(rng.choice("xy") for _ in range(width))
            elif turn < 0.5:
                pred = pred[:-1]
            elif turn < 0.55:
                pred = [(*r, "x") for r in pred]
            run.append((q, d, ordered))
            want[q] = want.get(q, 0) + brute_equal(gold, pred, ordered)
            rows += [(q, d, role, n, list(r)) for role, side in (("gold", gold), ("pred", pred)) for n, r in enumerate(side)]
    # unlike columns that no signature tells apart: rows of a cyclic square and its mirror image
    square = [("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")]
    for q, other in ((100, [r[::-1] for r in square]), (101, square[::-1]), (102, [("x", "z", "y"), *square[1:]])):
        run.append((q, "a", False))
        want[q] = int(brute_equal(square, other, False))
        rows += [(q, "a", role, n, list(r)) for role, side in (("gold", square), ("pred", other)) for n, r in enumerate(side)]
    results = spark.createDataFrame(rows, "query_id int, db_id string, role string, ordinal int, cells array<string>").repartition(6)
    verdicts = eq.suite_verdicts(results, spark.createDataFrame(run, "query_id int, db_id string, ordered boolean")).collect()
    assert {r["query_id"]: r["n_equal"] for r in verdicts} == want and 20 < sum(want.values()) < 100


def test_equal_up_to_columns_against_all_permutations(spark):
    rng = random.Random(32)
    for _ in range(8):
        gold = [tuple(rng.choice("xy") for _ in range(4)) for _ in range(rng.randint(1, 5))]
        order = rng.sample(range(4), 4)
        pred = [tuple(r[i] for i in order) for r in gold]
        rng.shuffle(pred)
        if rng.random() < 0.5:
            pred[0] = tuple(rng.choice("xy") for _ in range(4))
        g, p = (spark.createDataFrame(x, "a string, b string, c string, d string") for x in (gold, pred))
        assert eq.equal_up_to_columns(g, p).first()["equal"] == brute_equal(gold, pred, False)


def test_unlike_columns_of_the_same_cells_take_few_jobs(spark):
    """Ten columns with the same bag of cells, each in its own arrangement: rows tell them apart."""
    rng = random.Random(33)
    values = [*range(12)]
    columns = [rng.sample(values, 12) for _ in range(10)]
    gold = spark.createDataFrame(list(zip(*columns)), [f"c{i}" for i in range(10)])
    order = rng.sample(range(10), 10)
    pred = gold.select(*[gold.columns[i] for i in order])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("unlike-columns", "")
    verdict = eq.equal_up_to_columns(gold, pred)
    assert len(tracker.getJobIdsForGroup("unlike-columns")) <= 10  # three queries of a few stages each
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert verdict.first()["equal"]
    wrong = spark.createDataFrame([tuple(r) for r in zip(*columns[:9], columns[9][::-1])], gold.columns)
    assert not eq.equal_up_to_columns(gold, wrong.select(*[wrong.columns[i] for i in order])).first()["equal"]


def test_variants_stop_at_the_first_that_passes(spark):
    """Rounds of variants: judged are those up to the round of the first that passes, and all where none does."""
    judged = []

    def judge(asked):
        judged.extend((r["query_id"], r["variant"]) for r in asked.select("query_id", "variant").collect())
        return asked.select("query_id", "variant", F.lit(0).alias("db_id"), (F.col("variant") >= F.col("good")).alias("equal"))

    queries = spark.createDataFrame([(1, 1, 0), (2, 400, 0), (3, 400, 5), (4, 400, 300), (5, 40, 99), (6, 1, 1)], "query_id int, n bigint, good int")
    got = {r["query_id"]: (r["n_variants"], r["first_variant"], r["passed"]) for r in eq.first_passing(queries, judge, 128).collect()}
    assert got == {1: (1, 0, True), 2: (400, 0, True), 3: (400, 5, True), 4: (400, 300, True), 5: (40, None, False), 6: (1, None, False)}
    assert len(judged) == len(set(judged))
    most = {q: max(v for p, v in judged if p == q) for q in got}
    assert most[2] == 0 and most[3] < 20 and most[4] >= 300 and most[5] == 39


def test_gold_values_in_predicted_slots(spark):
    pair = ("select a from t where b = 'x y' and c > 3", "SELECT a FROM t WHERE b = 'z' AND c > 1.5")
    row = spark.createDataFrame([pair], "gold string, pred string")
    c = row.select(F.col("pred"), tx.slot_segments(tx.masked_tokens(F.col("pred"))).alias("s"), tx.literal_set(F.col("gold")).alias("v"))
    n = c.select(tx.variant_count(F.col("s"), F.col("v")).alias("n")).first()["n"]
    got = [c.select(tx.variant_text(F.col("pred"), F.col("s"), F.col("v"), F.lit(k)).alias("r")).first()["r"] for k in range(n)]
    assert got[0] == pair[1] and sorted(got[1:]) == sorted(f"select a from t where b = {x} and c > {y}" for x in ("'x y'", "3") for y in ("'x y'", "3"))


def test_components_of_long_paths_hubs_and_odd_edges(spark, monkeypatch):
    from quillcheck.operators import components, skew

    monkeypatch.setattr(skew, "ROWS_PER_PART", 50)
    rounds = []
    written = components.settled
    monkeypatch.setattr(components, "settled", lambda df, label: rounds.append(label) or written(df, label))
    rng = random.Random(41)
    names = rng.sample(range(10**6, 2 * 10**6), 10_000)
    edges = list(zip(names, names[1:]))  # one path of 10,000 keys in no order
    edges += [(5, 10 + n) for n in range(400)] + [(5, 5), (3, 3), (7, None), (None, None), (11, 5)]
    got = {r["node"]: r["canonical"] for r in connected_minimum(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()}
    assert got == {n: min(names) for n in names} | {n: 5 for n in (5, *range(10, 410))} | {3: 3}
    assert len(rounds) < 20


def test_one_array_read_by_many_tasks(spark, tmp_path):
    """Braces, brackets, quotes and backslashes inside strings, across the borders of small file splits."""
    rng = random.Random(51)
    signs = ["{", "}", "[", "]", '"', "\\", ",", ":", "x", " ", "\n", "é", "}{", '\\"', "]}"]
    rows = [{"db_id": f"d{i}", "question": "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))), "query": rng.choice(["", None, "}", '"', "select {x}"]), "sql": {"a": [{"b": "}"}, []]}} for i in range(400)]
    rows[7]["question"] = 'a\\"b' * 30_000  # a long string without a brace
    (tmp_path / "a.json").write_text(json.dumps(rows[:300]))
    (tmp_path / "b.json").write_text(json.dumps(rows[300:], indent=2, ensure_ascii=False))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(' [ 1, "}", {"db_id": "last", "question": "\\\\", "query": "q"} , [ {"db_id": "inner"} ] ]\n')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in corpus.read_corpus(spark, str(tmp_path), block=64).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r[0] for r in got] == sorted([r["db_id"] for r in rows] + ["last"])
    want = {r["db_id"]: (r["question"], r["query"]) for r in rows} | {"last": ("\\", "q")}
    assert {r[0]: r[1:] for r in got} == want


def test_array_corpus_round_trip(spark, tmp_path):
    rows = [(f"d{i}", None if i % 7 == 0 else f'q "{i}" }} ] {{', "s") for i in range(200)]
    corpus.write_array(spark.createDataFrame(rows, corpus.CORPUS_SCHEMA).repartition(5), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "out")).collect()) == sorted(rows, key=str)
    files = list((tmp_path / "out").rglob("*.txt"))
    assert len(files) == 5 and sum(len(json.loads(f.read_text())) for f in files) == 200


def test_value_store_reads_new_files_only(spark, tmp_path):
    from quillcheck.operators.index_store import ValueStore

    store = ValueStore(spark, str(tmp_path / "index"))
    assert store.index().collect() == [] and store.refresh({"t": []}) == [] and store.index().collect() == []

    def drop(name, rows):
        spark.createDataFrame(rows, "a int, b string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
        return str(tmp_path / name)

    def fresh(tables):
        from collections import Counter

        found = Counter()
        for t, paths in tables.items():
            for r in (r for p in paths for r in spark.read.parquet(p).collect()):
                found.update((t, c, str(r[c])) for c in ("a", "b") if r[c] is not None)
        return {(*k, n) for k, n in found.items()}

    def index():
        return {tuple(r) for r in store.index().collect()}

    one, two, three = drop("one", [(1, "x"), (1, None), (2, "y")]), drop("two", [(1, "x"), (3, "z")]), drop("three", [(9, "x")])
    for tables, n in (({"t": [one, two]}, 2), ({"t": [one, two]}, 0), ({"t": [one, two, three]}, 1), ({"t": [two], "u": [three]}, 1), ({"t": [one, two], "u": [three]}, 1)):
        assert len(store.refresh(tables)) == n and index() == fresh(tables)
    drop("two", [(7, "changed"), (1, "x")])  # the same folder with another file
    tables = {"t": [one, two], "u": [three]}
    read = store.refresh(tables)
    assert len(read) == 1 and "/two/" in read[0] and index() == fresh(tables)
    assert store.refresh({"t": []}) == [] and index() == set()


def test_owner_of_a_possession(spark):
    cases = {"the Shop's price": "shop", "all shops' prices": None, "John's and Mary's": "john", "it's": None, "'s x": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", ln.owner(F.col("q")).alias("o")).collect()
    assert {r["q"]: r["o"] for r in rows} == cases


def test_clause_units_of_odd_rows(spark, tmp_path):
    """Nulls, keys below zero, repeated keys: the rows that are dealt out short are those of the view."""
    rng = random.Random(3)
    pick = lambda *values: rng.choice([None, *values])
    lines = [(pick(*range(-6, 12)), pick(1, 2, 3), pick(1, 2, 3), pick(*range(1, 8)), pick(1.0, 7.0, 35.5, 45.0), float(i), pick(0.01, 0.06), pick(0.01, 0.03, 0.07), pick("R", "N"), pick("O", "F")) for i in range(400)]
    orders = [(pick(*range(-6, 12)), pick("F", "O", "P"), pick(1000.0, 205000.0, 260000.0), pick("5-LOW", "2-HIGH")) for _ in range(40)]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    got, want = (Counter(map(tuple, df.collect())) for df in (clause_queries.units(t), view(t, "clause_units")))
    assert got == want and sum(want.values()) > 500
