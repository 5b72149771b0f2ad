"""Pairs of real queries over the order lines, compared with each other."""

from pyspark.sql import functions as F

from quillcheck.operators import equivalence as eq
from quillcheck.operators.ordering import with_ordinal
from quillcheck.plans.registry import plan
from quillcheck.plans.text_queries import parsed_pairs, with_text
from quillcheck.plans.views import oracle
from quillcheck.session import parts_of, settled

_GOLD = "SELECT l_orderkey AS k, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_orderkey"
_SAME = """SELECT o_orderkey AS k, sum(l_quantity) AS qty, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 GROUP BY o_orderkey"""
_BAD = _SAME.replace("GROUP", "WHERE l_linestatus = 'F' OR l_returnflag <> 'R' GROUP")


def dealt(t, rows, key):
    """``rows`` dealt out by the order, in parts that grow in number with the tables: all that is counted per order stays in them."""
    return rows.repartition(parts_of(t.spark, t.root), key)


def gold(t):
    return dealt(t, t.lineitem, "l_orderkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


def joined(t, lines=None):
    lines = t.lineitem if lines is None else lines
    return (
        dealt(t, t.orders, "o_orderkey")
        .join(dealt(t, lines, "l_orderkey").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_orderkey").alias("k"))
        .agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    )


def altered(t):
    return joined(t, t.lineitem.filter((F.col("l_linestatus") == "F") | (F.col("l_returnflag") != "R")))


def _pair_sql(label: str, pred: str, gold_sql: str = _GOLD) -> str:
    return f"""SELECT '{label}' AS pair, (SELECT count(*) FROM ({gold_sql}) g) AS n_gold, (SELECT count(*) FROM ({pred}) p) AS n_pred,
    (SELECT count(*) FROM (({gold_sql}) EXCEPT ALL ({pred})) a) + (SELECT count(*) FROM (({pred}) EXCEPT ALL ({gold_sql})) b) AS n_unmatched,
    (SELECT count(*) FROM (({gold_sql}) EXCEPT ALL ({pred})) a) + (SELECT count(*) FROM (({pred}) EXCEPT ALL ({gold_sql})) b) = 0 AS equal"""


def _labelled(label, frame):
    return frame.select(F.lit(label).alias("pair"), *frame.columns)


_DUP = f"{_SAME} UNION ALL SELECT l_orderkey, CAST(50 AS DOUBLE), 1 FROM lineitem WHERE l_quantity = 50"


@plan("e01_bag_equal", " UNION ALL ".join([_pair_sql("same", _SAME), _pair_sql("altered", _BAD), _pair_sql("repeated", _DUP)]))
def bag_equal(t):
    heavy = dealt(t, t.lineitem.filter("l_quantity = 50"), "l_orderkey").select("l_orderkey", F.lit(50.0), F.lit(1).cast("bigint"))
    return eq.union_all(
        [
            _labelled("same", eq.bag_equal(gold(t), joined(t))),
            _labelled("altered", eq.bag_equal(gold(t), altered(t))),
            _labelled("repeated", eq.bag_equal(gold(t), joined(t).unionAll(heavy))),
        ]
    )


@plan(
    "e02_shape",
    f"""SELECT 'same' AS pair, (SELECT count(*) FROM ({_GOLD}) g) AS n_gold, (SELECT count(*) FROM ({_SAME}) p) AS n_pred, 3 AS gold_columns,
    3 AS pred_columns, 'open' AS decision UNION ALL SELECT 'altered', (SELECT count(*) FROM ({_GOLD}) g), (SELECT count(*) FROM ({_BAD}) p), 3, 3, 'different'
    UNION ALL SELECT 'narrow', (SELECT count(*) FROM ({_GOLD}) g), (SELECT count(*) FROM ({_SAME}) p), 3, 2, 'different'
    UNION ALL SELECT 'empty', 0, 0, 3, 2, 'equal'""",
)
def shape(t):
    none = gold(t).filter("n < 0")
    return eq.union_all(
        [
            _labelled("same", eq.shape(gold(t), joined(t))),
            _labelled("altered", eq.shape(gold(t), altered(t))),
            _labelled("narrow", eq.shape(gold(t), joined(t).select("k", "qty"))),
            _labelled("empty", eq.shape(none, none.select("k", "n"))),
        ]
    )


@plan(
    "e03_unordered_row",
    f"""SELECT k, array_to_string(list_sort([CAST(CAST(k AS DOUBLE) AS VARCHAR) || ':number', CAST(qty AS VARCHAR) || ':number',
    CAST(CAST(n AS DOUBLE) AS VARCHAR) || ':number', p || ':string']), '|') AS cells FROM ({_GOLD}) g
    JOIN (SELECT o_orderkey AS ok, o_orderpriority AS p FROM orders) o ON ok = k""",
)
def unordered_row(t):
    wide = gold(t).join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p")), "k")
    return wide.select("k", F.array_join(eq.unordered_row(wide), "|").alias("cells"))


def _reject_sql(label, pred, pred_order):
    left = f"SELECT list_sort([CAST(k AS DOUBLE), qty, CAST(n AS DOUBLE)]) AS r FROM ({_GOLD}) g"
    right = f"SELECT list_sort([CAST(k AS DOUBLE), qty, CAST(n AS DOUBLE)]) AS r FROM ({pred}) p"
    return f"""SELECT '{label}' AS pair, (SELECT count(*) FROM ({left}) a) AS n_gold, (SELECT count(*) FROM ({right}) b) AS n_pred,
    EXISTS(({left}) EXCEPT ALL ({right})) OR EXISTS(({right}) EXCEPT ALL ({left})) AS rejected"""


@plan("e04_quick_reject", _reject_sql("swapped", _SAME, "n, k, qty") + " UNION ALL " + _reject_sql("altered", _BAD, "k, qty, n"))
def quick_reject(t):
    return _labelled("swapped", eq.quick_reject(gold(t), joined(t).select("n", "k", "qty"))).unionAll(
        _labelled("altered", eq.quick_reject(gold(t), altered(t)))
    )


@plan(
    "e05_equal_up_to_columns",
    f"""SELECT pair, n_gold, n_pred, equal FROM ({_pair_sql("swapped", _SAME)} UNION ALL {_pair_sql("altered", _BAD)}) x""",
)
def equal_up_to_columns(t):
    swapped = joined(t).select("n", "k", "qty")
    return _labelled("swapped", eq.equal_up_to_columns(gold(t), swapped)).unionAll(
        _labelled("altered", eq.equal_up_to_columns(gold(t), altered(t).select("qty", "n", "k")))
    ).select("pair", "n_gold", "n_pred", "equal")


def _column_match_sql() -> str:
    pairs = []
    for i, g in enumerate(["k", "qty", "n"]):
        for j, p in enumerate(["n", "k", "qty"]):
            left, right = f"SELECT CAST({g} AS DOUBLE) FROM ({_GOLD}) g", f"SELECT CAST({p} AS DOUBLE) FROM ({_SAME}) p"
            pairs.append(f"SELECT {i} AS gold_pos, {j} AS pred_pos WHERE NOT EXISTS (({left}) EXCEPT ALL ({right}))")
    return " UNION ALL ".join(pairs)


@plan("e06_column_matches", _column_match_sql())
def column_matches(t):
    return eq.column_matches(gold(t), joined(t).select("n", "k", "qty"))


_BY_BALANCE = "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS ordinal, c_custkey, c_mktsegment FROM customer"


@plan(
    "e07_ordered_equal",
    " UNION ALL ".join(
        [
            _pair_sql("same order", _BY_BALANCE, _BY_BALANCE),
            _pair_sql("other columns", _BY_BALANCE, _BY_BALANCE),
            _pair_sql("other order", _BY_BALANCE.replace("DESC, c_custkey", "DESC, c_custkey DESC").replace("c_acctbal DESC", "floor(c_acctbal) DESC"), _BY_BALANCE),
        ]
    ),
)
def ordered_equal(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    best = with_ordinal(rows, [F.desc("c_acctbal"), "c_custkey"]).drop("c_acctbal")
    other = with_ordinal(rows, [F.desc(F.floor("c_acctbal")), F.desc("c_custkey")]).drop("c_acctbal")
    again = with_ordinal(t.customer.select("c_acctbal", "c_mktsegment", "c_custkey"), [F.desc("c_acctbal"), "c_custkey"])
    return eq.union_all(
        [
            _labelled("same order", eq.ordered_equal(best, again.select("ordinal", "c_custkey", "c_mktsegment"))),
            _labelled("other columns", eq.ordered_equal(best, again.select("c_mktsegment", "ordinal", "c_custkey"))),
            _labelled("other order", eq.ordered_equal(best, other)),
        ]
    )


@plan("e08_permute", f"SELECT n, k, qty FROM ({_GOLD}) g")
def permute(t):
    return eq.permute(gold(t), [2, 0, 1])


# Results of one query per nation on three databases: its customers' segments and balances, the best first. Predictions of every
# second nation have their columns swapped, those of every third their rows turned round, and some lose rows or cells.
_RESULTS = """SELECT c_nationkey AS query_id, 'db' || (c_custkey % 3) AS db_id, 'gold' AS role, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3
  ORDER BY c_acctbal DESC, c_custkey) AS ordinal, c_mktsegment AS c0, CAST(c_acctbal AS VARCHAR(30)) AS c1, c_custkey AS id FROM customer
 UNION ALL SELECT query_id, db_id, 'pred', ordinal, CASE WHEN query_id % 2 = 0 THEN c1 ELSE c0 END, CASE WHEN query_id % 2 = 0 THEN c0 ELSE c1 END, id FROM (
  SELECT c_nationkey AS query_id, 'db' || (c_custkey % 3) AS db_id, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3
   ORDER BY CASE WHEN c_nationkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END DESC, c_custkey) AS ordinal, c_mktsegment AS c0,
   CASE WHEN c_nationkey % 5 = 0 AND c_acctbal > 9900 THEN '0.0' ELSE CAST(c_acctbal AS VARCHAR(30)) END AS c1, c_custkey AS id
  FROM customer WHERE c_nationkey <> 6 OR c_mktsegment <> 'BUILDING') x"""


def results(t):
    return t.sql(_RESULTS.replace("FROM customer", "FROM {customer}")).drop("id")


@plan(
    "e09_suite_verdicts",
    f"""WITH r AS ({_RESULTS}), run AS (SELECT n_nationkey AS query_id, 'db' || k AS db_id, n_nationkey % 4 = 0 AS ordered FROM nation, (SELECT unnest(range(4)) AS k) x),
    rows_ AS (SELECT r.query_id, r.db_id, role, CASE WHEN ordered THEN ordinal END AS place, c0, c1 FROM r JOIN run USING (query_id, db_id)),
    sides AS (SELECT query_id, db_id, place, role, c0, c1, 'same' AS v FROM rows_ UNION ALL SELECT query_id, db_id, place, role, c0, c1, 'swapped' FROM rows_ WHERE role = 'gold'
      UNION ALL SELECT query_id, db_id, place, role, c1, c0, 'swapped' FROM rows_ WHERE role = 'pred'),
    n AS (SELECT query_id, db_id, v, place, c0, c1, sum(CASE role WHEN 'gold' THEN 1 ELSE -1 END) AS net FROM sides GROUP BY ALL),
    tried AS (SELECT query_id, db_id, v, bool_and(net = 0) AS equal FROM n GROUP BY ALL),
    d AS (SELECT run.query_id, run.db_id, coalesce(bool_or(equal), true) AS equal FROM run LEFT JOIN tried ON tried.query_id = run.query_id AND tried.db_id = run.db_id GROUP BY ALL)
    SELECT query_id, count(*) AS n_databases, count(*) FILTER (WHERE equal) AS n_equal, bool_and(equal) AS passed FROM d GROUP BY query_id""",
)
def suite_verdicts(t):
    # a fourth database on which every query is empty; every fourth query sorts its rows
    databases = F.explode(F.array(*[F.lit(f"db{k}") for k in range(4)]))
    run = t.nation.select(F.col("n_nationkey").alias("query_id"), databases.alias("db_id"), (F.col("n_nationkey") % 4 == 0).alias("ordered"))
    return eq.suite_verdicts(results(t), run)


# What executing a variant gives: on one database or two, the gold result where the texts agree, and by chance now and then.
_EQUAL = "(lower(trim(regexp_replace(result, '\\s+', ' '{g}))) = lower(trim(regexp_replace(gold, '\\s+', ' '{g}))) OR (query_id + variant + db_id) % 5 = 0)"


@plan(
    "e10_any_variant",
    oracle(
        f"""WITH passes AS (SELECT query_id, variant, bool_and({_EQUAL.format(g=", 'g'")}) AS passed FROM
          (SELECT *, unnest(range(0, 1 + query_id % 2)) AS db_id FROM <<pair_variants>>) v GROUP BY query_id, variant)
        SELECT query_id, count(*) AS n_variants, min(variant) FILTER (WHERE passed) AS first_variant, bool_or(passed) AS passed FROM passes GROUP BY query_id"""
    ),
)
def any_variant(t):
    def judge(asked):
        on = with_text(asked).withColumn("db_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_id") % 2)))
        return on.select("query_id", "variant", "db_id", F.expr(_EQUAL.format(g="").replace("\\s", "\\\\s")).alias("equal"))

    return eq.first_passing(parsed_pairs(t), judge)


@plan(
    "e11_keyed_columns",
    f"""SELECT 'k' AS unit, count(*) AS n_gold, count(*) AS n_pred, 0 AS n_unmatched, true AS equal FROM ({_GOLD}) g
    UNION ALL SELECT 'qty', count(*), count(*), 2 * count(*) FILTER (WHERE o_orderstatus = 'P'), count(*) FILTER (WHERE o_orderstatus = 'P') = 0
    FROM ({_GOLD}) g JOIN orders ON o_orderkey = k
    UNION ALL SELECT 'n', count(*), count(*), 0, true FROM ({_GOLD}) g""",
)
def keyed_columns(t):
    status = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    changed = joined(t).join(status, "k").select(
        "n", "k", (F.col("qty") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("qty")
    )
    at = F.col("k").alias("ordinal")
    return eq.keyed_columns_equal(gold(t).select("*", at), changed.select("*", at), "ordinal")


_PAIRS = "SELECT o_orderstatus AS db_id, o_custkey AS gold, o_orderkey AS pred, o_totalprice > 250000 AS verdict, o_orderpriority FROM orders"


@plan(
    "e12_reused_verdicts",
    f"""SELECT db_id, gold, pred, CASE WHEN o_orderpriority = '1-URGENT' THEN NOT verdict ELSE verdict END AS verdict,
    o_orderpriority = '1-URGENT' AS reused FROM ({_PAIRS}) p""",
)
def reused_verdicts(t):
    pairs = t.sql(_PAIRS.replace("FROM orders", "FROM {orders}"))
    # The store knows the urgent ones, with verdicts that show where they came from.
    store = settled(
        pairs.filter("o_orderpriority = '1-URGENT'").select("db_id", "gold", "pred", (~F.col("verdict")).alias("verdict")), "verdicts"
    )
    asked = pairs.select("db_id", "gold", "pred")
    return eq.reuse(asked, store, lambda rest: rest.join(pairs.drop("o_orderpriority"), ["db_id", "gold", "pred"]))


@plan(
    "e13_outcomes",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'skip' WHEN l_discount < 0.01 OR l_linestatus = 'O' THEN 'fail'
    WHEN l_quantity > 10 THEN 'pass' ELSE 'fail' END AS outcome FROM lineitem""",
)
def outcomes(t):
    attempts = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_returnflag") != "R").alias("gold_ok"),
        (F.col("l_linestatus") != "O").alias("pred_ok"),
        (F.col("l_discount") >= 0.01).alias("readable"),
        (F.col("l_quantity") > 10).alias("equal"),
    )
    return eq.settle_status(attempts).select("l_orderkey", "l_linenumber", "l_partkey", "outcome")
