"""A database schema as text, one string per question and table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.operators.linking import quoted

# The wording of the request.
SCHEMA_HEAD = "### The database contains the following tables:\n# "
TABLE_BREAK = "\n# "
QUESTION = "Question: {question}\n"
NOTE = (
    "Note that the content in [] after the column name are the values in that column. Use values that actually exist "
    "in the database, which are important for proper SQL execution.\n"
)
STRUCTURE_HINT = "Requirement: The SQL query must be in this format: {structure}.\n"
TABLE_HINT = "Requirement: The SQL query must consist of these tables: {table_list}.\n"
FUNCTION_HINT = (
    "the only functions you can use are: [max(), min(), count(), sum(), avg()], Do not use other functions, or the SQL "
    "will not execute correctly.\nSometimes commonsense knowledge is required to correctly understand the user question. "
    "Don't be careless!\nDo not alias tables in the SQL query.\n"
)
SELECT_HINT = 'Translate the question into a SQL query that starts with "{select} from". Only show the SQL query.\n'


def text_values(linked: DataFrame, text: str) -> DataFrame:
    """(text, found): all linked columns of a text as one map ``table.column`` -> values.

    A map holds at most one entry per column of the schema.
    """
    entry = F.struct(F.concat_ws(".", "tbl", "col").alias("k"), F.col("values").alias("v"))
    return linked.groupBy(text).agg(F.map_from_entries(F.collect_list(entry)).alias("found"))


def schema_rows(catalog: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """One row per database: its tables in order, each with columns, foreign keys and fallback values.

    Everything here is as large as the schema, not as the data.
    """
    cols = (
        catalog.join(shown.withColumnRenamed("values", "fallback"), ["tbl", "col"], "left")
        .groupBy("db_id", "table_id", "tbl")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "col", "fallback"))).alias("cols"))
    )
    number = catalog.select("db_id", "tbl", "col", "table_id", "pos")
    keyed = (
        edges.join(number.select("db_id", "tbl", "col", F.col("pos").alias("c1")), ["db_id", "tbl", "col"])
        .join(
            number.select(
                "db_id", F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"),
                F.col("table_id").alias("t2"), F.col("pos").alias("c2"),
            ),
            ["db_id", "ref_tbl", "ref_col"],
        )
        .groupBy("db_id", F.lower("tbl").alias("low"))
        .agg(F.array_sort(F.collect_list(F.struct("c1", "t2", "c2", "tbl", "col", "ref_tbl", "ref_col"))).alias("keys"))
    )
    joined = cols.withColumn("low", F.lower("tbl")).join(keyed, ["db_id", "low"], "left").drop("low")
    return joined.groupBy("db_id").agg(
        F.array_sort(F.collect_list(F.struct("table_id", "tbl", "cols", "keys"))).alias("tables")
    )


def with_schema(texts: DataFrame, linked: DataFrame, text: str, schema: DataFrame) -> DataFrame:
    """Bring to each row of ``texts`` its database's schema and its own linked values."""
    per_text = text_values(linked, text)
    # One row per database; the schema text is bounded by the number of its columns.
    return texts.join(per_text, text, "left").join(schema, "db_id")


def _values(found: Column, tbl: Column, col: Column) -> Column:
    return F.try_element_at(found, F.concat_ws(".", tbl, col))


def named_table(table: Column, found: Column, with_keys: bool) -> Column:
    """``name(col, col ["v1", "v2"], …) FOREIGN KEY: t.c = rt.rc, …``"""

    def column(c: Column) -> Column:
        values = F.coalesce(_values(found, table["tbl"], c["col"]), c["fallback"])
        # Without values the text is null as a whole, and the bare name stands.
        shown = F.concat(F.lower(c["col"]), F.lit(" ["), F.array_join(quoted(values), ", "), F.lit("]"))
        return F.coalesce(shown, F.lower(c["col"]))

    body = F.concat(F.lower(table["tbl"]), F.lit("("), F.array_join(F.transform(table["cols"], column), ", "), F.lit(")"))
    if not with_keys:
        return body

    def key(k: Column) -> Column:
        return F.concat(
            F.lit("FOREIGN KEY: "), k["tbl"], F.lit("."), F.lower(k["col"]), F.lit(" = "),
            F.lower(k["ref_tbl"]), F.lit("."), F.lower(k["ref_col"]),
        )

    return F.when(
        table["keys"].isNotNull(), F.concat(body, F.lit(" "), F.array_join(F.transform(table["keys"], key), ", "))
    ).otherwise(body)


def named_tables(rows: DataFrame, with_keys: bool) -> DataFrame:
    """One row per text and table with its string."""
    rest = [c for c in rows.columns if c not in ("tables", "found")]
    one = rows.select(*rest, "found", F.explode("tables").alias("t"))
    return one.select(
        *rest, F.col("t.table_id").alias("table_id"), F.col("t.tbl").alias("tbl"),
        named_table(F.col("t"), F.col("found"), with_keys).alias("table_text"),
    )


def positional_schema(rows: DataFrame) -> Column:
    """``Database: x. t0: name(c0: a (v), …) (c1) refers to t2(c0). t1: …``"""
    found = F.col("found")

    def table(t: Column) -> Column:
        def column(c: Column) -> Column:
            values = _values(found, t["tbl"], c["col"])
            plain = F.concat(F.lit("c"), c["pos"].cast("string"), F.lit(": "), F.lower(c["col"]))
            return F.coalesce(F.concat(plain, F.lit(" ("), F.array_join(values, ", "), F.lit(")")), plain)

        def key(k: Column) -> Column:
            return F.concat(
                F.lit("(c"), k["c1"].cast("string"), F.lit(") refers to t"), k["t2"].cast("string"),
                F.lit("(c"), k["c2"].cast("string"), F.lit(")"),
            )

        body = F.concat(
            F.lit("t"), t["table_id"].cast("string"), F.lit(": "), F.lower(t["tbl"]), F.lit("("),
            F.array_join(F.transform(t["cols"], column), ", "), F.lit(")"),
        )
        return F.when(
            t["keys"].isNotNull(), F.concat(body, F.lit(" "), F.array_join(F.transform(t["keys"], key), ", "))
        ).otherwise(body)

    return F.concat(F.lit("Database: "), F.col("db_id"), F.lit(". "), F.array_join(F.transform("tables", table), ". "))


def table_texts(rows: DataFrame, text: str, with_keys: bool = True) -> DataFrame:
    """Per distinct text of ``rows`` (from ``with_schema``): its tables' strings as (table_id, tbl, table_text), in order."""
    one = named_tables(rows.select(text, "tables", "found").dropDuplicates([text]), with_keys)
    listed = F.array_sort(F.collect_list(F.struct("table_id", "tbl", "table_text")))  # as many as the schema has tables
    return one.groupBy(text).agg(listed.alias("table_texts"))


def request_text(rows: DataFrame, table_lists: str, structure: str, select: str, text: str) -> DataFrame:
    """One request per row and candidate list of tables (``list_at``, ``table_list``); blank lists are left out.

    ``rows`` has ``table_texts``; only tables named in a blank-separated list are shown, in the schema's order.
    """
    rest = [c for c in rows.columns if c != table_lists]
    one = rows.select(*rest, F.posexplode(table_lists).alias("list_at", "table_list")).filter("table_list <> ''")
    wanted = F.split(F.col("table_list"), " ")
    kept = F.filter("table_texts", lambda t: F.array_contains(wanted, t["tbl"]))
    shown = F.array_join(F.transform(kept, lambda t: t["table_text"]), TABLE_BREAK)

    def fill(template: str, **parts: Column) -> list[Column]:
        (name, value), = parts.items()
        before, after = template.split("{" + name + "}")
        return [F.lit(before), value, F.lit(after)]

    whole = F.concat(
        F.lit(SCHEMA_HEAD), shown, F.lit("\n"), F.lit(NOTE),
        *fill(QUESTION, question=F.col(text)),
        *fill(STRUCTURE_HINT, structure=F.lower(F.col(structure))),
        *fill(TABLE_HINT, table_list=F.replace(F.col("table_list"), F.lit(" "), F.lit(", "))),
        F.lit(FUNCTION_HINT),
        *fill(SELECT_HINT, select=F.col(select)),
    )
    return one.withColumn("request", whole)
