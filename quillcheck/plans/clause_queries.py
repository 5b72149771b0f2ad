"""Parsed queries, one per order, compared clause by clause with altered copies."""

from pyspark.sql import functions as F

from quillcheck.operators import catalog as cat
from quillcheck.operators import clauses as cl
from quillcheck.operators.components import connected_minimum as connected_minimum_of
from quillcheck.plans.catalog_queries import DATABASES, FK_SCHEMA, FOREIGN_KEYS
from quillcheck.plans.registry import plan
from quillcheck.plans.views import PARTS, oracle, view
from quillcheck.session import once, parts_of

_SHORT = {
    "select": "select", "select(no AGG)": "selectn", "where": "where", "where(no OP)": "wheren", "group(no Having)": "groupn",
    "group list": "gl", "having list": "hl", "order list": "ol", "limit": "li", "tables": "tb", "and/or": "ao", "keywords": "kw",
}
PARTS["wide"] = ", ".join(
    f"coalesce(CAST(sum({side}) FILTER (WHERE part = '{part}') AS BIGINT), 0) AS {short}_{side}"
    for part, short in _SHORT.items()
    for side in "gpo"
)


# What the view ``clause_units`` takes from a line and from an order, in few short columns; ``copy`` marks the rows under -query_id.
_LINES = """SELECT *, inline(if(in_pred AND l_orderkey > 0, array(named_struct('copy', false, 'query_id', l_orderkey), named_struct('copy', true, 'query_id', -l_orderkey)),
  array(named_struct('copy', false, 'query_id', l_orderkey)))) FROM (
 SELECT l_orderkey, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d, l_quantity AS q, CASE WHEN l_tax < 0.02 THEN 'or' WHEN l_tax < 0.05 THEN 'and' END AS tied,
 coalesce(l_returnflag = 'R' AND l_tax > 0.06, false) AS bare, coalesce(l_discount < 0.02, false) AS more,
 coalesce(NOT (l_linestatus = 'O' AND l_returnflag = 'R' AND l_discount > 0.05), false) AS in_pred FROM {lineitem}) x"""
_ORDERS = """SELECT bits, inline(if(o_orderkey > 0, array(named_struct('copy', false, 'query_id', o_orderkey), named_struct('copy', true, 'query_id', -o_orderkey)),
  array(named_struct('copy', false, 'query_id', o_orderkey)))) FROM (
 SELECT o_orderkey, 1 + if(o_orderpriority <> '5-LOW', 2, 0) + if(o_orderstatus <> 'P', 4, 0) + if(o_orderstatus = 'F', 8, 0) + if(o_totalprice > 200000, 16, 0)
  + if(o_totalprice > 210000, 32, 0) AS bits FROM {orders}) x"""
_COPIED = "SELECT DISTINCT -(o_orderkey + 1) AS query_id, true AS copied FROM {orders} WHERE o_totalprice > 250000 AND o_orderkey + 1 > 0"
_LINE_CLAUSE = "CASE WHEN a IN (1, 6) THEN 'select' WHEN a IN (2, 7) THEN 'where' WHEN a = 3 THEN 'groupBy' WHEN a = 4 THEN 'orderBy' ELSE 'having' END"
_LINE_UNITS = """SELECT query_id, role, clause, ordinal, CASE WHEN test THEN tied END AS connector, test AND q > 40 AS not_op,
 CASE WHEN test THEN CASE c % 5 WHEN 0 THEN '=' WHEN 1 THEN 'like' WHEN 2 THEN 'in' WHEN 3 THEN '>' ELSE 'between' END END AS op,
 CASE WHEN role = 'pred' AND bare THEN 'none' WHEN c % 3 = 0 THEN 'none' WHEN c % 3 = 1 THEN 'max' ELSE 'count' END AS agg,
 CASE WHEN q < 3 THEN '-' ELSE 'none' END AS unit_op,
 CASE b % 5 WHEN 0 THEN '__lineitem.l_orderkey__' WHEN 1 THEN '__lineitem.l_partkey__' WHEN 2 THEN '__orders.o_orderkey__'
  WHEN 3 THEN '__orders.o_custkey__' ELSE '__lineitem.l_tax__' END AS col, q > 30 AS is_distinct,
 CASE WHEN test THEN cast(cast(q AS bigint) + CASE WHEN role = 'pred' AND more THEN 1 ELSE 0 END AS varchar(9)) END AS value,
 CASE WHEN test THEN CASE WHEN q = 7 THEN 'nested' WHEN c % 2 = 0 THEN 'number' ELSE 'string' END END AS value_kind,
 CASE WHEN clause = 'orderBy' THEN CASE WHEN query_id % 2 = 0 THEN 'asc' ELSE 'desc' END END AS direction
FROM (SELECT *, clause IN ('where', 'having') AS test, inline(array(named_struct('role', 'gold', 'ordinal', in_gold - 1), named_struct('role', 'pred', 'ordinal', before - 1))) FROM (
  SELECT *, row_number() OVER w AS in_gold, cast(sum(if(in_pred, 1, 0)) OVER w AS int) AS before
  FROM {lines} WINDOW w AS (PARTITION BY query_id, copy, clause ORDER BY a, b, c, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) y) z
WHERE if(role = 'gold', NOT copy, in_pred)"""
_ORDER_UNITS = """SELECT query_id, role, clause, row_number() OVER (PARTITION BY query_id, copy, role, clause ORDER BY a) - 1 AS ordinal, cast(null AS string) AS connector, false AS not_op,
 cast(null AS string) AS op, 'none' AS agg, 'none' AS unit_op, col, false AS is_distinct, if(clause = 'limit', '1', null) AS value, if(clause = 'limit', 'number', null) AS value_kind,
 cast(null AS string) AS direction
FROM (SELECT query_id, copy, bits, inline(array(named_struct('bit', 1, 'role', 'gold', 'clause', 'from', 'a', 0, 'col', 'lineitem'), named_struct('bit', 2, 'role', 'pred', 'clause', 'from', 'a', 0, 'col', 'lineitem'),
 named_struct('bit', 4, 'role', 'gold', 'clause', 'from', 'a', 1, 'col', 'orders'), named_struct('bit', 8, 'role', 'pred', 'clause', 'from', 'a', 1, 'col', 'orders'),
 named_struct('bit', 16, 'role', 'gold', 'clause', 'limit', 'a', 0, 'col', null), named_struct('bit', 32, 'role', 'pred', 'clause', 'limit', 'a', 0, 'col', null))) FROM {orders_})
WHERE bits & bit > 0 AND (role = 'pred' OR NOT copy)"""


def clause_units(t):
    """The rows of the view ``clause_units``: lines and orders are dealt out by their query once, while they are short."""
    n = parts_of(t.spark, t.root)
    copied = t.sql(_COPIED).repartition(n, "query_id")

    def dealt(rows):
        known = rows.repartition(n, "query_id").join(copied.hint("shuffle_hash"), "query_id", "left")
        return known.where("NOT copy OR copied").drop("copied")

    lines = dealt(t.sql(_LINES).drop("l_orderkey")).withColumn("clause", F.expr(_LINE_CLAUSE))
    return t.sql(_LINE_UNITS, lines=lines).unionAll(t.sql(_ORDER_UNITS, orders_=dealt(t.sql(_ORDERS))))


def units(t):
    """The parsed queries, a clause table stored once per database, in buckets of the query."""
    return once(t.spark, t.root, "clause-units", lambda: clause_units(t), "query_id")


def links(t):
    return view(t, "query_links")


def canonical(t):
    return once(t.spark, t.root, "key-columns", lambda: key_columns(t))


def key_columns(t):
    """Key columns of the sales schema and the lowest column each is tied to."""
    frames = {"sales": {tbl: t.scan(tbl) for tbl in DATABASES["sales"]}}
    columns = cat.read_catalog(t.spark, frames)
    edges = t.spark.createDataFrame([e for e in FOREIGN_KEYS if e[0] == "sales"], FK_SCHEMA)
    numbered = cat.foreign_key_numbers(edges, columns).select(
        F.col("column_id").alias("a"), F.col("other_column_id").alias("b")
    )
    names = cat.numbered_columns(columns).select("number", cat.identifier(F.col("tbl"), F.col("col")).alias("name"))
    tied = connected_minimum_of(numbered)
    return (
        tied.join(names.toDF("node", "col"), "node")
        .join(names.toDF("canonical", "target"), "canonical")
        .select("col", F.col("target").alias("canonical"))
    )


def ready(t):
    """Units as they are compared: literals masked, key columns made canonical; stored once per database."""
    return once(t.spark, t.root, "ready-units", lambda: cl.canonical_columns(cl.mask_values(units(t)), canonical(t)), "query_id")


def scored(t):
    """The component totals and verdicts of all queries, which several reports read; stored once per database."""
    return once(t.spark, t.root, "scored", lambda: cl.score(ready(t), links(t)))


_OWN = """array_to_string(list_filter(['SELECT', 'FROM', CASE WHEN has_where THEN 'WHERE' END, CASE WHEN has_group THEN 'GROUP BY' END,
 CASE WHEN has_having THEN 'HAVING' END, CASE WHEN has_order THEN 'ORDER BY' END, CASE WHEN has_limit THEN 'LIMIT' END], lambda x: x IS NOT NULL), '-')"""


@plan(
    "a01_structure",
    oracle(
        f"""WITH own AS (SELECT query_id, role, {_OWN} AS own FROM <<unit_flags>>),
        walk AS (SELECT query_id AS root, query_id, role, own AS piece, [0] AS path FROM own
          UNION ALL SELECT w.root, c.query_id, w.role, upper(kind) || '-' || c.own, list_append(path, CASE kind WHEN 'intersect' THEN 1 WHEN 'union' THEN 2 ELSE 3 END)
          FROM walk w JOIN <<query_links>> l ON l.parent_id = w.query_id AND l.role = w.role AND kind <> 'where' JOIN own c ON c.query_id = l.child_id AND c.role = l.role)
        SELECT root AS query_id, role, string_agg(piece, '-' ORDER BY path) AS structure FROM walk GROUP BY root, role"""
    ),
)
def structure(t):
    return cl.structures(units(t), links(t))


@plan("a02_keywords", oracle("SELECT query_id, role, array_to_string(words, ',') AS keywords FROM <<keyword_sets>>"))
def keywords(t):
    return cl.keywords(units(t), links(t)).withColumn("keywords", F.array_join("keywords", ","))


@plan("a03_component_count", oracle("SELECT query_id, role, component1 FROM <<unit_counts>>"))
def component_count(t):
    return cl.counts(units(t), links(t)).select("query_id", "role", F.col("component1").cast("int").alias("component1"))


@plan("a04_nested_count", oracle("SELECT query_id, role, nested FROM <<unit_counts>>"))
def nested_count(t):
    return cl.counts(units(t), links(t)).select("query_id", "role", "nested")


@plan("a05_other_count", oracle("SELECT query_id, role, others FROM <<unit_counts>>"))
def other_count(t):
    return cl.counts(units(t), links(t)).select("query_id", "role", F.col("others").cast("int").alias("others"))


@plan("a06_hardness", oracle("SELECT query_id, role, hardness FROM <<levels>>"))
def hardness(t):
    return cl.difficulty(units(t), links(t)).select("query_id", "role", "hardness")


def _sizes_query(name, parts):
    names = ", ".join("'" + p + "'" for p in parts)

    @plan(
        name,
        oracle(f"SELECT query_id, component, label_total, pred_total, overlap, hit AS f1 FROM <<partial_rows>> WHERE component IN ({names})"),
    )
    def build(t):
        if "IUEN" in parts:
            kept = cl.partial_scores(scored(t), parts)
        else:
            kept = cl.partial_scores(cl.overlaps(ready(t), links(t)), parts)
        return kept.select("query_id", "component", "label_total", "pred_total", "overlap", "f1")

    return build


_sizes_query("a07_select_overlap", ["select", "select(no AGG)"])
_sizes_query("a08_where_overlap", ["where", "where(no OP)"])
_sizes_query("a09_group_overlap", ["group(no Having)"])
_sizes_query("a10_group_having", ["group"])
_sizes_query("a11_order", ["order"])
_sizes_query("a12_and_or", ["and/or"])
_sizes_query("a13_branches", ["IUEN"])
_sizes_query("a14_keyword_overlap", ["keywords"])


@plan(
    "a15_all_or_nothing",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN CAST(l_tax * 100 AS INT) = l_linenumber AND CAST(l_discount * 100 AS INT) = l_linenumber
    THEN 1 ELSE 0 END AS f1 FROM lineitem""",
)
def all_or_nothing(t):
    got = cl.all_or_nothing(F.round(F.col("l_discount") * 100).cast("int"), F.col("l_linenumber"), F.round(F.col("l_tax") * 100).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", got.alias("f1"))


@plan(
    "a16_partial_scores",
    oracle("SELECT query_id, component, label_total, pred_total, overlap, hit AS acc, hit AS rec, hit AS f1 FROM <<partial_rows>>"),
)
def partial_scores(t):
    return cl.partial_scores(scored(t))


@plan("a17_exact_match", oracle("SELECT query_id, exact FROM <<exact_all>>"))
def exact_match(t):
    return scored(t).select("query_id", "exact")


@plan(
    "a18_masked_values",
    oracle(
        """SELECT query_id, role, clause, ordinal, CASE WHEN value_kind = 'nested' THEN value END AS value,
        CASE WHEN value_kind = 'nested' THEN value_kind END AS value_kind FROM <<clause_units>>"""
    ),
)
def masked_values(t):
    masked = cl.mask_values(units(t))
    return masked.select("query_id", "role", "clause", F.col("ordinal").cast("bigint").alias("ordinal"), "value", "value_kind")


@plan(
    "a19_connected_minimum",
    """WITH s AS (SELECT o_custkey, min(o_orderkey) AS low FROM orders GROUP BY o_custkey)
    SELECT o_orderkey AS node, low AS canonical FROM orders JOIN s USING (o_custkey)
    UNION ALL SELECT -1 - o_custkey, low FROM s""",
)
def connected_minimum(t):
    # Orders of one customer hang together through the customer, numbered below zero.
    edges = t.orders.select(F.col("o_orderkey").alias("a"), (F.lit(-1) - F.col("o_custkey")).alias("b"))
    tied = connected_minimum_of(edges)
    by_customer = tied.filter("node >= 0").groupBy("canonical").agg(F.min("node").alias("low"))
    return tied.join(by_customer, "canonical").select("node", F.col("low").alias("canonical"))


@plan("a20_canonical_columns", oracle("SELECT query_id, role, clause, ordinal, col FROM <<ready_units>>"))
def canonical_columns(t):
    return ready(t).select("query_id", "role", "clause", F.col("ordinal").cast("bigint").alias("ordinal"), "col")


@plan(
    "a21_unreadable_prediction",
    oracle(
        """SELECT b.query_id, p.query_id IS NOT NULL AS readable, CASE WHEN p.query_id IS NULL THEN 0 ELSE n END AS n_units
        FROM (SELECT DISTINCT query_id FROM <<clause_units>> WHERE role = 'gold') b LEFT JOIN
        (SELECT query_id, count(*) AS n FROM <<clause_units>> WHERE role = 'pred' GROUP BY query_id) p ON p.query_id = b.query_id"""
    ),
)
def unreadable_prediction(t):
    sides = units(t).groupBy("query_id").agg(
        F.count_if(F.col("role") == "gold").alias("g"), F.count_if(F.col("role") == "pred").alias("n_units")
    )
    return sides.filter("g > 0").select("query_id", (F.col("n_units") > 0).alias("readable"), "n_units")


@plan(
    "a22_predicates",
    oracle("SELECT query_id, role, has_or, has_like, has_nested, has_arithmetic, has_aggregate FROM <<unit_flags>>"),
)
def predicates(t):
    flags = cl.predicates(units(t))
    return flags.select("query_id", "role", "has_or", "has_like", "has_nested", "has_arithmetic", "has_aggregate")
