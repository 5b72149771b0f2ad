"""The relational vocabulary: every clause a generated query may use, as a Spark query."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.plans.registry import plan


@plan("q01_scan_alias", "SELECT n.n_nationkey, n.n_name, n.n_regionkey FROM nation AS n")
def scan_alias(t) -> DataFrame:
    return t.nation.alias("n").select("n.n_nationkey", "n.n_name", "n.n_regionkey")


@plan("q02_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@plan("q03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(t):
    return t.part.select("p_brand", "p_type").distinct()


@plan(
    "q04_column_arithmetic",
    """SELECT p_partkey, round(p_retailprice + p_size, 4) AS plus, round(p_retailprice - p_size, 4) AS minus,
    round(p_retailprice * p_size, 4) AS times, round(p_retailprice / p_size, 4) AS ratio,
    p_partkey // p_size AS whole_ratio FROM part""",
)
def column_arithmetic(t):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return t.part.select(
        "p_partkey",
        F.round(price + size, 4).alias("plus"),
        F.round(price - size, 4).alias("minus"),
        F.round(price * size, 4).alias("times"),
        F.round(price / size, 4).alias("ratio"),
        F.expr("p_partkey div p_size").alias("whole_ratio"),
    )


@plan(
    "q05_comparisons",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40
    AND l_discount > 0.02 AND l_tax < 0.07 AND l_returnflag = 'A' AND l_linestatus != 'O'""",
)
def comparisons(t):
    return t.lineitem.filter(
        (F.col("l_quantity") >= 10)
        & (F.col("l_quantity") <= 40)
        & (F.col("l_discount") > 0.02)
        & (F.col("l_tax") < 0.07)
        & (F.col("l_returnflag") == "A")
        & (F.col("l_linestatus") != "O")
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@plan(
    "q06_between",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
)
def between(t):
    return t.orders.filter(F.col("o_totalprice").between(100000, 200000)).select("o_orderkey", "o_totalprice")


@plan(
    "q07_in_list",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    AND c_nationkey NOT IN (1, 2, 3)""",
)
def in_list(t):
    return t.customer.filter(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)
    ).select("c_custkey", "c_mktsegment")


@plan(
    "q08_in_subquery",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""",
)
def in_subquery(t):
    wanted = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))
    return t.customer.join(wanted, t.customer.c_custkey == wanted.o_custkey, "left_semi").select(
        "c_custkey", "c_name"
    )


@plan(
    "q09_not_in_subquery",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def not_in_subquery(t):
    # The key is taken as NOT NULL so that the planner can hash-join it; a null on either
    # side makes SQL's NOT IN unknown, so nulls are handled beside the anti join.
    done = t.orders.filter(F.col("o_orderstatus") == "F").select("o_custkey")
    has_null = done.filter(F.col("o_custkey").isNull()).limit(1).select(F.lit(True).alias("unknown"))
    keys = done.filter(F.col("o_custkey").isNotNull())
    kept = t.customer.filter(F.col("c_custkey").isNotNull()).join(
        keys, F.col("c_custkey") == F.col("o_custkey"), "left_anti"
    )
    return kept.join(F.broadcast(has_null), F.lit(True), "left_anti").select("c_custkey", "c_name")


@plan(
    "q10_exists",
    """SELECT s_suppkey, s_name FROM supplier WHERE EXISTS
    (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45 AND l_returnflag = 'R')""",
)
def exists(t):
    hits = t.lineitem.filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return t.supplier.join(hits, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(
        "s_suppkey", "s_name"
    )


@plan(
    "q11_like",
    """SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%RING%' AND p_type NOT ILIKE 'econ%'""",
)
def like(t):
    return t.part.filter(F.col("p_name").ilike("%RING%") & ~F.col("p_type").ilike("econ%")).select(
        "p_partkey", "p_name", "p_type"
    )


@plan(
    "q12_null_tests",
    """SELECT doc_id, quality IS NULL AS unlabelled, quality IS NOT NULL AS labelled
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def null_tests(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.col("quality").isNull().alias("unlabelled"),
        F.col("quality").isNotNull().alias("labelled"),
    )


@plan(
    "q13_and_or_chain",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000
    OR o_orderpriority = '5-LOW' AND o_totalprice < 20000 OR o_orderstatus = 'P'""",
)
def and_or_chain(t):
    return t.orders.filter(
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000))
        | ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 20000))
        | (F.col("o_orderstatus") == "P")
    ).select("o_orderkey")


@plan(
    "q14_scalar_subquery",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
)
def scalar_subquery(t):
    return t.sql(
        "SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})"
    )


@plan(
    "q15_inner_join",
    """SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 100000""",
)
def inner_join(t):
    return (
        t.orders.filter(F.col("o_totalprice") > 100000)
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name", "c_mktsegment")
    )


@plan(
    "q16_multi_join",
    """SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name""",
)
def multi_join(t):
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
        )
    )


@plan(
    "q17_comma_join",
    """SELECT s_suppkey, n_name, r_name FROM supplier, nation, region
    WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'""",
)
def comma_join(t):
    # A comma join written as in SQL; the WHERE clause turns it into two equi-joins.
    return t.sql(
        "SELECT s_suppkey, n_name, r_name FROM {supplier}, {nation}, {region} "
        "WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'"
    )


@plan(
    "q18_self_join",
    """SELECT a.l_orderkey, a.l_linenumber AS first_line, b.l_linenumber AS next_line, a.l_partkey
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'N'""",
)
def self_join(t):
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = line.filter(F.col("l_returnflag") == "R").alias("a")
    b = line.filter(F.col("l_returnflag") == "N").alias("b")
    return a.join(
        b,
        (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
        & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1),
    ).select(
        "a.l_orderkey",
        F.col("a.l_linenumber").alias("first_line"),
        F.col("b.l_linenumber").alias("next_line"),
        "a.l_partkey",
    )


@plan(
    "q19_derived_table",
    """SELECT n_orders, count(*) AS n_customers FROM
    (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) d GROUP BY n_orders""",
)
def derived_table(t):
    per_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return per_customer.groupBy("n_orders").agg(F.count("*").alias("n_customers"))


@plan(
    "q20_aggregates",
    """SELECT count(*) AS n, max(l_quantity) AS max_qty, min(l_shipdate) AS first_ship, sum(l_quantity) AS sum_qty,
    round(avg(l_extendedprice), 6) AS avg_price FROM lineitem""",
)
def aggregates(t):
    return t.lineitem.agg(
        F.count("*").alias("n"),
        F.max("l_quantity").alias("max_qty"),
        F.min("l_shipdate").alias("first_ship"),
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
    )


@plan(
    "q21_distinct_aggregates",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, sum(DISTINCT l_quantity) AS sum_qty
    FROM lineitem GROUP BY l_returnflag""",
)
def distinct_aggregates(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("n_suppliers"),
        F.sum_distinct("l_quantity").alias("sum_qty"),
    )


@plan(
    "q22_group_by",
    """SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_name) AS any_name FROM customer
    GROUP BY c_nationkey, c_mktsegment""",
)
def group_by(t):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count("*").alias("n"), F.min("c_name").alias("any_name")
    )


@plan(
    "q23_having",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
)
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter(F.col("n") > 12)


@plan(
    "q24_order_by",
    """SELECT row_number() OVER (ORDER BY n_regionkey DESC, n_name DESC) AS place, n_name, n_regionkey
    FROM nation ORDER BY n_regionkey DESC, n_name DESC""",
)
def order_by(t):
    # The ordinal comes from the sorted frame itself, see operators.ordering.
    from quillcheck.operators.ordering import with_ordinal

    placed = with_ordinal(
        t.nation.select("n_name", "n_regionkey"), [F.desc("n_regionkey"), F.desc("n_name")], "place"
    )
    return placed.select(F.col("place") + 1, "n_name", "n_regionkey").toDF("place", "n_name", "n_regionkey")


@plan("q25_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(7)


@plan(
    "q26_argmax",
    """SELECT c_name, sum_price FROM (SELECT c_name, round(sum(o_totalprice), 2) AS sum_price FROM orders
    JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name) d ORDER BY sum_price DESC, c_name LIMIT 1""",
)
def argmax(t):
    spent = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("sum_price"))
    return (
        spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_name", "sum_price")
        .orderBy(F.desc("sum_price"), "c_name")
        .limit(1)
    )


@plan(
    "q27_intersect",
    """SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT
    SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40""",
)
def intersect(t):
    a = t.lineitem.filter(F.col("l_returnflag") == "R").select("l_partkey")
    b = t.lineitem.filter((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)).select("l_partkey")
    return a.intersect(b)


@plan(
    "q28_union",
    "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
)
def union(t):
    return (
        t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()
    )


@plan(
    "q29_except",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
)
def except_(t):
    return t.customer.select("c_custkey").subtract(
        t.orders.filter(F.col("o_totalprice") > 200000).select("o_custkey")
    )


@plan(
    "q30_set_chain",
    """SELECT l_suppkey FROM lineitem WHERE l_quantity > 30 INTERSECT
    (SELECT s_suppkey FROM supplier WHERE s_acctbal > -500 EXCEPT
    (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000))""",
)
def set_chain(t):
    # Bracketed from the right, as the accepted grammar nests it.
    last = (
        t.lineitem.filter((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08))
        .select("l_suppkey")
        .union(t.supplier.filter(F.col("s_acctbal") > 9000).select("s_suppkey"))
        .distinct()
    )
    middle = t.supplier.filter(F.col("s_acctbal") > -500).select("s_suppkey").subtract(last)
    return t.lineitem.filter(F.col("l_quantity") > 30).select("l_suppkey").intersect(middle)


@plan(
    "q31_theta_join",
    """SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem
    ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice < o_totalprice""",
)
def theta_join(t):
    # The range tests ride on an equi key, so the join hashes or sorts instead of looping.
    return t.orders.join(
        t.lineitem,
        (F.col("o_orderkey") == F.col("l_orderkey"))
        & (F.col("l_shipdate") > F.col("o_orderdate"))
        & (F.col("l_extendedprice") < F.col("o_totalprice")),
    ).select("o_orderkey", "l_linenumber", "l_partkey")


@plan(
    "q32_column_comparison",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax",
)
def column_comparison(t):
    return t.lineitem.filter(F.col("l_discount") > F.col("l_tax")).select("l_orderkey", "l_linenumber")


@plan(
    "q33_aggregate_arithmetic",
    """SELECT l_suppkey, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_suppkey
    HAVING max(l_quantity) - min(l_quantity) > 40 ORDER BY count(*) DESC""",
)
def aggregate_arithmetic(t):
    return (
        t.lineitem.groupBy("l_suppkey")
        .agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.count("*").alias("n"))
        .filter(F.col("spread") > 40)
        .orderBy(F.desc("n"))
        .select("l_suppkey", "spread")
    )
