"""Catalog and profile of the given tables, seen as three databases."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.operators import catalog as cat
from quillcheck.plans.registry import plan
from quillcheck.plans.views import oracle

DATABASES = {
    "sales": ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"],
    "web": ["events", "documents", "pages", "benchmark", "labels"],
    "talk": ["conversations", "embeddings"],
}

# The tables as they are declared, for the check.
DECLARED = """
region r_regionkey:int r_name:varchar
nation n_nationkey:int n_name:varchar n_regionkey:int
customer c_custkey:bigint c_name:varchar c_nationkey:int c_acctbal:double c_mktsegment:varchar
supplier s_suppkey:bigint s_name:varchar s_nationkey:int s_acctbal:double
part p_partkey:bigint p_name:varchar p_brand:varchar p_type:varchar p_size:int p_retailprice:double
orders o_orderkey:bigint o_custkey:bigint o_orderstatus:varchar o_totalprice:double o_orderdate:timestamp o_orderpriority:varchar
lineitem l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:varchar l_linestatus:varchar l_shipdate:timestamp
events event_id:bigint ts:timestamp user_id:bigint event_type:varchar value:double props:varchar
documents doc_id:bigint text:varchar lang:varchar source:varchar n_chars:bigint
pages page_id:bigint url:varchar html:varchar
benchmark item_id:bigint text:varchar
labels doc_id:bigint quality:int toxic:int
conversations conv_id:bigint turn:bigint role:varchar text:varchar
embeddings vec_id:bigint embedding:array<float> label:int
"""

FOREIGN_KEYS = [
    ("sales", "nation", "n_regionkey", "region", "r_regionkey"),
    ("sales", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("sales", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("sales", "orders", "o_custkey", "customer", "c_custkey"),
    ("sales", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("sales", "lineitem", "l_partkey", "part", "p_partkey"),
    ("sales", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("web", "labels", "doc_id", "documents", "doc_id"),
]
FK_SCHEMA = "db_id string, tbl string, col string, ref_tbl string, ref_col string"


def _catalog_sql() -> str:
    columns = {line.split()[0]: [c.split(":") for c in line.split()[1:]] for line in DECLARED.strip().splitlines()}
    rows, counts = [], []
    for db, tables in DATABASES.items():
        number = 0
        for table_id, tbl in enumerate(tables):
            for pos, (col, declared) in enumerate(columns[tbl]):
                number += 1
                rows.append(f"('{db}', {table_id}, '{tbl}', {pos}, '{col}', '{declared}', {number})")
                counts.append(f"SELECT '{tbl}', '{col}', count(*), count({col}) FROM {tbl}")
    return (
        "WITH columns_(db_id, table_id, tbl, pos, col, declared, number) AS (VALUES " + ", ".join(rows) + "), "
        "counts(tbl, col, n_rows, n_values) AS (" + " UNION ALL ".join(counts) + "), "
        "cat AS (SELECT * FROM columns_ JOIN counts USING (tbl, col)) "
    )


CATALOG_SQL = _catalog_sql()


def databases(t) -> dict:
    return {db: {tbl: t.scan(tbl) for tbl in tables} for db, tables in DATABASES.items()}


def profiled(t):
    """The catalog with the row and value counts of one scan per table."""
    dbs = databases(t)
    # The catalog has a row per column of the schema, so it is small by its nature.
    return cat.profile(dbs).join(cat.read_catalog(t.spark, dbs), ["db_id", "tbl", "col"])


def named(t):
    """The catalog with the rows of each table, which no column has to be read for."""
    dbs = databases(t)
    rows = [cat.row_counts(frames).withColumn("db_id", F.lit(db)) for db, frames in dbs.items()]
    return cat.read_catalog(t.spark, dbs).join(reduce(DataFrame.unionByName, rows), ["db_id", "tbl"])


@plan("c01_tables", CATALOG_SQL + "SELECT db_id, table_id, tbl, count(*) AS n_columns, max(n_rows) AS n_rows FROM cat GROUP BY ALL")
def tables(t):
    return named(t).groupBy("db_id", "table_id", "tbl").agg(
        F.count("*").alias("n_columns"), F.max("n_rows").alias("n_rows")
    )


@plan(
    "c02_columns",
    CATALOG_SQL
    + """SELECT db_id, number, table_id, tbl, col, n_values FROM cat UNION ALL
    SELECT DISTINCT db_id, 0, -1, NULL, '*', NULL FROM cat""",
)
def columns(t):
    dbs = databases(t)
    counts = cat.profile(dbs).select("db_id", "tbl", "col", "n_values")
    return cat.column_list(cat.read_catalog(t.spark, dbs)).join(counts, ["db_id", "tbl", "col"], "left")


@plan(
    "c03_type_families",
    CATALOG_SQL
    + """SELECT tbl, col, n_values, CASE WHEN declared = 'varchar' THEN 'text' WHEN declared = 'timestamp' THEN 'time'
    ELSE 'number' END AS family FROM cat""",
)
def type_families(t):
    return profiled(t).select("tbl", "col", "n_values", cat.type_family(F.col("declared")).alias("family"))


_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber", "events": "event_id", "documents": "doc_id",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id, turn", "embeddings": "vec_id",
}


@plan(
    "c04_primary_keys",
    "SELECT *, n_rows = n_keys AS is_key FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{k}' AS keys, count(*) AS n_rows, count(DISTINCT ({k})) AS n_keys FROM {t}" for t, k in _KEYS.items()
    )
    + ") c",
)
def primary_keys(t):
    checks = [
        cat.key_check(t.scan(tbl), keys.split(", ")).select(
            F.lit(tbl).alias("tbl"), F.lit(keys).alias("keys"), "n_rows", "n_keys", "is_key"
        )
        for tbl, keys in _KEYS.items()
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out


@plan(
    "c05_foreign_keys",
    " UNION ALL ".join(
        f"SELECT '{c}' AS tbl, '{cc}' AS col, '{p}' AS ref_tbl, '{pc}' AS ref_col, "
        f"(SELECT count(*) FROM {c} WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {p})) AS n_orphans"
        for _, c, cc, p, pc in FOREIGN_KEYS
    ),
)
def foreign_keys(t):
    out = None
    for _, c, cc, p, pc in FOREIGN_KEYS:
        one = cat.orphans(t.scan(c), cc, t.scan(p), pc).select(
            F.lit(c).alias("tbl"), F.lit(cc).alias("col"), F.lit(p).alias("ref_tbl"), F.lit(pc).alias("ref_col"), "n_orphans"
        )
        out = one if out is None else out.unionAll(one)
    return out


_FK_VALUES = ", ".join(str(e) for e in [*FOREIGN_KEYS, ("sales", "orders", "o_ghost", "customer", "c_custkey")])


@plan(
    "c06_foreign_key_numbers",
    CATALOG_SQL
    + f""", edges(db_id, tbl, col, ref_tbl, ref_col) AS (VALUES {_FK_VALUES})
    SELECT e.*, a.number AS column_id, b.number AS other_column_id, a.n_values FROM edges e
    JOIN cat a ON a.db_id = e.db_id AND a.tbl = e.tbl AND a.col = e.col
    JOIN cat b ON b.db_id = e.db_id AND b.tbl = e.ref_tbl AND b.col = e.ref_col""",
)
def foreign_key_numbers(t):
    dbs = databases(t)
    edges = t.spark.createDataFrame([*FOREIGN_KEYS, ("sales", "orders", "o_ghost", "customer", "c_custkey")], FK_SCHEMA)
    numbered = cat.foreign_key_numbers(edges, cat.read_catalog(t.spark, dbs))
    counts = cat.profile(dbs).select("db_id", "tbl", "col", "n_values")
    return counts.join(numbered, ["db_id", "tbl", "col"])


@plan(
    "c07_humanised_names",
    CATALOG_SQL + "SELECT tbl, col, replace(lower(tbl), '_', ' ') AS table_name, replace(lower(col), '_', ' ') AS column_name, n_rows FROM cat",
)
def humanised_names(t):
    return named(t).select(
        "tbl",
        "col",
        cat.humanised(F.col("tbl")).alias("table_name"),
        cat.humanised(F.col("col")).alias("column_name"),
        "n_rows",
    )


@plan(
    "c08_inherited_names",
    CATALOG_SQL
    + """SELECT db_id, tbl, col, n_rows, db_id <> 'talk' AS inherited, CASE WHEN db_id <> 'talk'
    THEN upper(tbl) || ' ' || upper(col) ELSE replace(lower(col), '_', ' ') END AS name FROM cat""",
)
def inherited_names(t):
    own = named(t)
    # The curated names miss one column of the database "talk", so that one keeps its own.
    curated = cat.read_catalog(t.spark, databases(t)).filter("col <> 'role'").select(
        "db_id", "table_id", "pos", F.concat_ws(" ", F.upper("tbl"), F.upper("col")).alias("name")
    )
    return cat.inherit_names(own, curated).select("db_id", "tbl", "col", "n_rows", "inherited", "name")


@plan(
    "c09_presence",
    """SELECT user_id, bool_or(present) AS present FROM (SELECT user_id, user_id IN (SELECT user_id FROM events
    WHERE event_type = 'purchase') AS present FROM events) e GROUP BY user_id""",
)
def presence(t):
    listed = t.events.select("user_id")
    return cat.presence(listed, t.events.filter(F.col("event_type") == "purchase").select("user_id"), "user_id")


@plan("c10_total_rows", CATALOG_SQL + "SELECT CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT tbl, max(n_rows) AS n FROM cat WHERE db_id = 'sales' GROUP BY tbl) x")
def total_rows(t):
    return cat.row_counts(databases(t)["sales"]).agg(F.sum("n_rows").alias("total_rows"))


@plan(
    "c11_identifiers",
    CATALOG_SQL + "SELECT tbl, col, '__' || lower(tbl) || '.' || lower(col) || '__' AS identifier, '__' || lower(tbl) || '__' AS table_identifier, n_rows FROM cat",
)
def identifiers(t):
    return named(t).select(
        "tbl",
        "col",
        cat.identifier(F.col("tbl"), F.col("col")).alias("identifier"),
        F.concat(F.lit("__"), F.lower("tbl"), F.lit("__")).alias("table_identifier"),
        "n_rows",
    )


@plan(
    "c12_lower_schema",
    CATALOG_SQL + "SELECT db_id, lower(tbl) AS tbl, string_agg(lower(col), ',' ORDER BY pos) AS columns, max(n_rows) AS n_rows FROM cat GROUP BY db_id, tbl",
)
def lower_schema(t):
    listed = cat.lower_schema(cat.read_catalog(t.spark, databases(t))).withColumn("columns", F.array_join("columns", ","))
    counts = named(t).groupBy("db_id", "tbl").agg(F.max("n_rows").alias("n_rows"))
    return counts.join(listed, ["db_id", "tbl"])


@plan(
    "c13_first_schema",
    """SELECT db_id, doc_id, lang, n_chars FROM (SELECT source AS db_id, doc_id, lang, n_chars,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1""",
)
def first_schema(t):
    rows = t.documents.select(F.col("source").alias("db_id"), "doc_id", "lang", "n_chars")
    return cat.first_per_database(rows, "doc_id")
