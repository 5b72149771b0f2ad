"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import re
import time
from collections import Counter

import duckdb

from quillcheck.sources.tables import TABLE_NAMES

TIMES = {"spark": 0.0, "sql": 0.0}
DATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "f:nan"
        return f"f:{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


# A theta join and a null-aware one by their definition, and joins with the one row of the only database.
PRODUCTS = {"q31_theta_join", "q09_not_in_subquery", "d03_encoded_columns", "d04_decoded_columns", "p01_table_text", "p02_table_text_with_keys", "p03_positional_schema", "p04_request_text"}
# Without rows on the smallest tables.
EMPTY = {"q29_except"}


def plan_problem(df, name: str) -> str | None:
    """What a physical plan must not hold: products, joins on constants, windows over a whole table.

    A window without partitions is fine over one row per block, partition or file, whose columns begin with ``__``.
    """
    text = df._jdf.queryExecution().executedPlan().toString()
    if name not in PRODUCTS and re.search("CartesianProduct|BroadcastNestedLoopJoin", text):
        return "a product of two tables"
    constant = set(re.findall(r"(?<![#\w.])(?:\d+|true) AS (\w+#\d+)", text))
    for keys in re.findall(r"Join \[([^\]]+)\], \[", text):
        if all(k.strip().rstrip("L") in constant for k in keys.split(",")):
            return f"a join on a constant: {keys}"
    for order in re.findall(r"windowspecdefinition\((\w+)#\d+L? (?:ASC|DESC)", text):
        if not order.startswith("__"):
            return f"a window over all rows, ordered by {order}"
    return None


def compare(spark, con, plan, sf_dir) -> str | None:
    """None when equal, else a short description of the difference."""
    began = time.time()
    df = plan(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    problem = plan_problem(df, plan.name)
    if problem:
        return problem
    TIMES["spark"] = time.time() - began
    got_cols, got = bag(df.columns, rows)
    began = time.time()
    rel = con.execute(plan.oracle)
    rows = rel.fetchall()
    TIMES["sql"] = time.time() - began
    want_cols, want = bag([d[0] for d in rel.description], rows)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only in spark {sum(extra.values())}: "
            f"{list(extra)[:2]}; only in sql {sum(missing.values())}: {list(missing)[:2]}"
        )
    if not got and plan.name not in EMPTY:
        return "no rows"
    return None
