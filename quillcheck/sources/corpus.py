"""Corpora, gold and predicted queries in files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.operators.ordering import file_line_numbers, running
from quillcheck.session import settled

CORPUS_SCHEMA = "db_id string, question string, query string"

# The perturbed test splits a corpus may name besides train and validation.
PERTURBED_SPLITS = [
    "DB_DBcontent_equivalence", "DB_schema_abbreviation", "DB_schema_synonym",
    "NLQ_keyword_synonym", "NLQ_keyword_carrier", "NLQ_column_synonym", "NLQ_column_carrier", "NLQ_column_attribute",
    "NLQ_column_value", "NLQ_value_synonym", "NLQ_multitype", "NLQ_others",
    "SQL_comparison", "SQL_sort_order", "SQL_NonDB_number", "SQL_DB_text", "SQL_DB_number",
]


_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?'  # takes whole runs at once, so that long strings need no stack


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, one_array: bool = True, block: int = 1 << 20) -> DataFrame:
    """A JSON corpus: one array of objects per file, or one object per line.

    An array may fill one large file on one line: it is read by as many tasks as the file has splits. The text is cut at
    every closing brace, wherever it stands; a running total of quotes tells which pieces begin inside a string, a
    running total of brackets outside strings where an element of the array ends, and the pieces of an element are
    put together again. Elements that aren't objects are passed over.
    """
    if not one_array:
        return spark.read.schema(schema).json(path)
    pieces = file_line_numbers(spark.read.option("lineSep", "}").text(path), "piece", "file")
    last = pieces.groupBy("file").agg(F.max("piece").alias("last"))  # a row per file
    pieces = settled(pieces.join(last, "file").select("piece", "value", (F.col("piece") == F.col("last")).alias("ends")), "pieces")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', ""))
    told = running(pieces, "piece", {"quotes": ("sum", quotes)}, block)
    # A piece that begins inside a string is read as if it began with the quote that opened it
    inside = (F.col("quotes") - quotes) % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(""), "value"), _STRING, "")
    closed = ~F.col("ends") & (F.col("quotes") % 2 == 0)  # the brace that ends the piece is no part of a string
    levels = F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", "")) - closed.cast("int")
    told = settled(told.select("piece", "value", "ends", closed.alias("closed"), levels.cast("long").alias("levels")), "levels")
    deep = running(told, "piece", {"depth": ("sum", F.col("levels"))}, block)
    done = F.when(F.col("closed") & (F.col("depth") == 1), 1).otherwise(0)
    deep = settled(deep.select("piece", "value", "ends", done.cast("long").alias("done")), "depths")
    numbered = running(deep, "piece", {"until": ("sum", F.col("done"))}, block)
    element = (F.col("until") - F.col("done")).alias("element")
    parts = numbered.where(~F.col("ends")).select(element, "piece", "value", "done")
    whole = parts.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("parts"), F.max("done").alias("done"))
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    objects = whole.where("done = 1").select(F.regexp_replace(text, r"^[^{]*", "").alias("text"))
    return objects.select(F.from_json("text", schema).alias("row")).select("row.*")


def write_array(df: DataFrame, path: str) -> None:
    """One JSON array per task: a file that begins with a bracket, holds a row per line and ends with a bracket."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), F.monotonically_increasing_id().alias("at"))
    low = F.col("at").bitwiseAND((1 << 33) - 1)
    part = settled(rows.select("value", low.alias("at"), F.shiftright("at", 33).alias("part")), "rows")
    ends = part.groupBy("part").agg(F.max("at").alias("last"))
    lined = part.join(ends, "part").select("part", "at", F.concat(F.when(F.col("at") == 0, F.lit("[")).otherwise(","), "value", F.when(F.col("at") == F.col("last"), F.lit("]")).otherwise("")).alias("value"))
    n = max(1, ends.count())
    lined.repartition(n, "part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON lines, spread over the tasks that hold the rows."""
    df.write.partitionBy(*by).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) in file order."""
    return file_line_numbers(spark.read.text(path)).select("line_no", F.col("value").alias("line"))


def gold_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``query<TAB>database`` lines as two columns; blank lines stay, with nulls."""
    fields = F.split(F.trim(line), "\t")
    blank = F.trim(line) == ""
    return lines.select(
        *[c for c in lines.columns if c != line],
        F.when(~blank, F.get(fields, F.lit(0))).alias("query"),
        F.when(~blank, F.get(fields, F.lit(1))).alias("db_id"),
    )


def predicted_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.select(*[c for c in lines.columns if c != line], F.trim(line).alias("query"))


def sessions(lines: DataFrame, order: str = "line_no", line: str = "line", block: int = 1 << 20) -> DataFrame:
    """Lines with ``session_no`` and ``turn_idx``; a blank line closes a session and goes.

    ``order`` is a unique integer, gaps allowed. Both numbers come from running totals over
    blocks of it, so a session of any length is spread like the rest.
    """
    blank = F.trim(F.col(line)) == ""
    numbered = running(
        lines, order, {"session_no": ("sum", F.when(blank, 1).otherwise(0)), "__text": ("sum", F.when(blank, 0).otherwise(1))}, block
    )
    closed = running(numbered, order, {"__before": ("max", F.when(blank, F.col("__text")).otherwise(F.lit(0)))}, block)
    return (
        closed.filter(~blank)
        .withColumn("turn_idx", F.col("__text") - F.col("__before") - 1)
        .drop("__text", "__before")
    )


def write_aligned(picks: DataFrame, order: str, gold: str, pred: str, db: str, path: str) -> None:
    """Gold and predicted queries as two text folders whose lines match by number.

    Each folder is sorted by the unique ``order`` as a whole, so line n of one belongs to
    line n of the other whatever the cuts between their files.
    """
    pairs = picks.select(order, F.concat_ws("\t", F.col(gold), F.col(db)).alias("gold"), F.col(pred).alias("predict"))
    for side in ("gold", "predict"):
        pairs.select(order, side).orderBy(order).select(side).write.text(f"{path}/{side}")


def registry(names: DataFrame, name: str, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Add data_path, db_path and output_path, by the first rule whose prefix fits the name.

    A rule is (prefix, data path, database path, output path) with ``{name}`` for the name.
    """

    def pick(i: int) -> Column:
        chosen = None
        for rule in rules:
            parts = rule[i].split("{name}")
            value = F.concat_ws("", *[c for p in parts[:-1] for c in (F.lit(p), F.col(name))], F.lit(parts[-1]))
            fits = F.startswith(F.col(name), F.lit(rule[0]))
            chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
        return chosen

    return names.select("*", pick(1).alias("data_path"), pick(2).alias("db_path"), pick(3).alias("output_path"))


def wanted_split(data_set: Column) -> Column:
    """A perturbed set is its own split; every other one is judged on its validation split."""
    return F.when(data_set.isin(*PERTURBED_SPLITS), data_set).otherwise("validation")


def read_split(spark: SparkSession, path: str, data_set: str) -> DataFrame:
    """One split of a corpus stored by split; the other folders are not read."""
    split = data_set if data_set in PERTURBED_SPLITS else "validation"
    return spark.read.parquet(path).filter(F.col("split") == split)


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Add new verdicts, keyed by (db_id, gold, pred), to the store."""
    verdicts.select("db_id", "gold", "pred", "verdict").write.mode("append").parquet(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("db_id string, gold bigint, pred bigint, verdict boolean").parquet(path)
