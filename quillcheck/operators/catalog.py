"""What tables, columns, types and keys a set of databases holds."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "db_id string, table_id int, tbl string, pos int, col string, declared string"

# Parts of a declared type that decide its family; the first family that fits wins.
TYPE_FAMILIES = {
    "text": ["char", "text", "var"],
    "number": ["int", "numeric", "decimal", "number", "id", "real", "double", "float"],
    "time": ["date", "time", "year"],
    "boolean": ["boolean"],
}


def read_catalog(spark: SparkSession, databases: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """One row per (database, table, column), read from the schemas alone."""
    rows = [
        (db, table_id, tbl, pos, field.name, field.dataType.simpleString().replace("string", "varchar"))
        for db, frames in databases.items()
        for table_id, (tbl, frame) in enumerate(frames.items())
        for pos, field in enumerate(frame.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def profile(databases: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Rows per table and non-null values per column: one aggregate scan per table."""
    parts = []
    for db, frames in databases.items():
        for tbl, frame in frames.items():
            counts = frame.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in frame.columns])
            parts.append(
                counts.unpivot("n_rows", frame.columns, "col", "n_values").select(
                    F.lit(db).alias("db_id"), F.lit(tbl).alias("tbl"), "col", "n_rows", "n_values"
                )
            )
    return reduce(DataFrame.unionAll, parts)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [f.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("tbl"), "n_rows") for t, f in frames.items()]
    return reduce(DataFrame.unionAll, parts)


def table_list(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("db_id", "table_id", "tbl").agg(F.count("*").alias("n_columns"))


def column_list(catalog: DataFrame) -> DataFrame:
    """Columns numbered per database from 1; number 0 is ``*`` of table -1."""
    star = catalog.select("db_id").distinct().select(
        "db_id", F.lit(0).alias("number"), F.lit(-1).alias("table_id"), F.lit(None).cast("string").alias("tbl"), F.lit("*").alias("col")
    )
    return star.unionByName(numbered_columns(catalog).select("db_id", "number", "table_id", "tbl", "col"))


def numbered_columns(catalog: DataFrame) -> DataFrame:
    """Add ``number``, the 1-based place of the column within its database.

    A database's columns are few, so the window is bounded by its schema.
    """
    from pyspark.sql import Window

    place = Window.partitionBy("db_id").orderBy("table_id", "pos")
    return catalog.withColumn("number", F.row_number().over(place))


def type_family(declared: Column) -> Column:
    low = F.lower(declared)
    family = F.when(low == "", "text")
    for name, parts in TYPE_FAMILIES.items():
        family = family.when(reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in parts]), name)
    return family.otherwise("others")


def humanised(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(" "))


def identifier(tbl: Column, col: Column) -> Column:
    """``__table.column__``; ``__all__`` for the star."""
    return F.when(col == "*", "__all__").otherwise(
        F.concat(F.lit("__"), F.lower(tbl), F.lit("."), F.lower(col), F.lit("__"))
    )


def lower_schema(catalog: DataFrame) -> DataFrame:
    """Lower-cased table with its columns in order; the list is as long as the table is wide."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.lower("col").alias("col"))))
    return catalog.groupBy("db_id", F.lower("tbl").alias("tbl")).agg(
        F.transform(ordered, lambda x: x["col"]).alias("columns")
    )


def key_check(frame: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows and distinct keys; the map-side counts keep a hot key to one row per task."""
    per_key = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn(
        "is_key", F.col("n_rows") == F.col("n_keys")
    )


def orphans(child: DataFrame, col: str, parent: DataFrame, ref: str) -> DataFrame:
    """How many child rows point nowhere. Child keys are counted before the join."""
    per_key = child.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lost = per_key.join(parent.select(F.col(ref).alias("k")), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans"))


def foreign_key_numbers(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Name pairs to column numbers; an edge with an unknown side is dropped."""
    numbers = numbered_columns(catalog).select("db_id", "tbl", "col", "number")
    child = numbers.withColumnRenamed("number", "column_id")
    parent = numbers.select("db_id", F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), F.col("number").alias("other_column_id"))
    return (
        edges.join(child, ["db_id", "tbl", "col"])
        .join(parent, ["db_id", "ref_tbl", "ref_col"])
        .filter((F.col("column_id") > 0) & (F.col("other_column_id") > 0))
    )


def inherit_names(catalog: DataFrame, curated: DataFrame) -> DataFrame:
    """Take the curated names of a database whose table and column counts agree, else its own.

    ``curated`` has db_id, table_id, pos and name.
    """

    def sizes(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.groupBy("db_id").agg(
            F.count_distinct("table_id").alias(f"{prefix}_tables"), F.count(F.lit(1)).alias(f"{prefix}_columns")
        )

    verdict = (
        sizes(catalog, "own")
        .join(sizes(curated, "cur"), "db_id", "left")
        .select(
            "db_id",
            F.coalesce(
                (F.col("own_tables") == F.col("cur_tables")) & (F.col("own_columns") == F.col("cur_columns")), F.lit(False)
            ).alias("inherited"),
        )
    )
    names = curated.select("db_id", "table_id", "pos", F.col("name").alias("curated_name"))
    return (
        catalog.join(verdict, "db_id")
        .join(names, ["db_id", "table_id", "pos"], "left")
        .withColumn(
            "name", F.when(F.col("inherited"), F.col("curated_name")).otherwise(humanised(F.col("col")))
        )
        .drop("curated_name")
    )


def presence(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Every listed database with whether its file is there."""
    return listed.select(key).distinct().join(
        present.select(key).distinct().withColumn("present", F.lit(True)), key, "left"
    ).withColumn("present", F.coalesce("present", F.lit(False)))


def first_per_database(rows: DataFrame, order: str) -> DataFrame:
    """The first row seen of each database, by partial aggregation."""
    rest = [c for c in rows.columns if c != "db_id"]
    return rows.groupBy("db_id").agg(*[F.min_by(c, order).alias(c) for c in rest])
