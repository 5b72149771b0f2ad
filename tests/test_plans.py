"""What the physical plans must and must not hold."""

import re

import pytest
from harness import DATA

import quillcheck.plans.all  # noqa: F401
from quillcheck.plans.registry import PLANS

SF_DIR = f"{DATA}/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["v08_ranked_candidates", "l04_ratio", "q31_theta_join", "e01_bag_equal", "a07_select_overlap", "v11_best_elsewhere"])
def test_no_cross_join(spark, name):
    plan = physical(PLANS[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = PLANS["q05_comparisons"](spark, SF_DIR)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(l_quantity" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_rank_limit_is_pushed_below_the_shuffle(spark):
    assert "WindowGroupLimit" in physical(PLANS["d14_negative_samples"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["d03_encoded_columns", "d04_decoded_columns"])
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_the_column_ids_are_the_side_that_is_broadcast(spark, name, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = physical(PLANS[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BuildLeft" not in plan.split("FileScan")[0]


def test_units_are_compared_where_they_are_kept(spark):
    plan = physical(PLANS["a07_select_overlap"](spark, SF_DIR))
    assert not re.search(r"hashpartitioning\(query_id#\d+L, part#", plan) and "Bucketed: true" in plan


def test_verdicts_are_not_gathered(spark):
    plan = physical(PLANS["m03_exact_of_queries"](spark, SF_DIR))
    assert re.search(r"SortMergeJoin \[query_id#\d+L\], \[query_id#\d+L\], Inner", plan)


def test_rows_of_results_are_dealt_out_by_the_size_of_the_tables(spark):
    from quillcheck.session import parts_of

    plan = physical(PLANS["e01_bag_equal"](spark, SF_DIR))
    dealt = re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)
    assert dealt and set(dealt) == {str(parts_of(spark, SF_DIR))} and int(spark.conf.get("spark.sql.shuffle.partitions")) != parts_of(spark, SF_DIR)


def test_units_are_dealt_out_once_whatever_a_shuffle_has(spark):
    from quillcheck.plans import clause_queries as cq
    from quillcheck.session import parts_of
    from quillcheck.sources.tables import Tables

    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, parts = physical(cq.clause_units(Tables(spark, SF_DIR))), parts_of(spark, SF_DIR)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert parts == 40 and not re.search(r"hashpartitioning\(query_id#\d+L, \d+\), ENSURE_REQUIREMENTS", plan)


@pytest.mark.parametrize("name", ["a02_keywords", "a04_nested_count", "a08_where_overlap", "a12_and_or", "a14_keyword_overlap", "m07_f1"])
def test_links_come_to_the_units_of_their_query(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(PLANS[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(query_id#\d+L, role#", plan)


def test_a_verdict_is_worked_out_once(spark):
    from quillcheck.operators import clauses as cl

    sizes = ", ".join(f"1L AS `{part}:{side}`" for part in cl._PART_NAMES for side in "gpo")
    scored = spark.sql(f"SELECT 1L AS query_id, {sizes}, 1L AS label_total, 1L AS pred_total, 1L AS overlap FROM range(1)")
    made = next(x for x in cl.partial_scores(scored)._jdf.queryExecution().analyzed().toString().splitlines() if "Generate" in x)
    assert "f1, " not in made and cl.partial_scores(scored).count() == len(cl.COMPONENTS)


def test_values_are_made_distinct_before_they_are_text(spark):
    from quillcheck.operators import values as vals

    frame = spark.createDataFrame([(0.0, 7, "a"), (-0.0, 7, "a"), (float("nan"), None, ""), (float("nan"), 8, None), (1e20, 8, "A")], "d double, n int, s string")
    frame = frame.selectExpr("*", "array(n) AS many", "timestamp_seconds(1000000000 + n) AS at")
    index = vals.value_index({"t": frame}, {"t": ["d", "n", "s", "many", "at", "d"]})
    got = sorted((r.col, r.value) for r in index.collect())
    assert [v for c, v in got if c == "d"] == ["-0.0", "0.0", "1.0E20", "NaN"]
    assert [v for c, v in got if c == "n"] == ["7", "8"] and [v for c, v in got if c == "s"] == ["", "A", "a"]
    assert [v for c, v in got if c == "many"] == ["[7]", "[8]", "[null]"] and [v[:16] for c, v in got if c == "at"] == ["2001-09-09 01:46"] * 2
    assert len(set(re.findall(r"hashpartitioning\((v#\d+)(?:, zero#\d+)?, ", physical(index)))) == 3


def test_one_word_is_in_order(spark):
    from quillcheck.functions.similarity import token_sorted

    rows = spark.createDataFrame([("Ab_1",), ("b A",), ("Ab\n",), ("",), ("\u00e9B",), (None,)], "c string")
    assert [r[0] for r in rows.select(token_sorted(rows["c"])).collect()] == ["ab_1", "a b", "ab", "", "b", None]


def test_opened_blocks_stay_spread(spark):
    from quillcheck.operators import search as se
    from quillcheck.session import settled

    s = se.Searchable(spark.createDataFrame([("t", "c", f"value {i}") for i in range(50)], "tbl string, col string, value string"))
    pairs = settled(s.blocks.selectExpr("block", "0 AS bundle", "tbl", "'valeu 7' AS literal", "'7 valeu' AS asked"))
    found = se._opened(pairs, s, ["tbl"], [], 1, None, 1)
    assert found.collect() and re.search(r"hashpartitioning\(block#\d+L, bundle#\d+, \d+\), REPARTITION_BY_NUM", physical(found))
