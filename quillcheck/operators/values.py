"""Which column really holds a literal: value index, search, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, FractionalType, IntegralType, StringType

from quillcheck.functions.text import number_or_null
from quillcheck.operators import vectors
from quillcheck.operators.ordering import with_ordinal
from quillcheck.operators.search import Searchable, search, search_elsewhere
from quillcheck.session import settled

# Fixed value: the score a fuzzy hit must exceed.
ACCEPT_ABOVE = 0.65
# What the feedback says of a predicate, by verdict.
WRONG_VALUE = '%d. Column %s does not contain the value "%s", but it contains a value "%s" '
WRONG_COLUMN = '%d. Column %s does not contain value "%s", but the column %s contains value "%s"'


# ---- index -----------------------------------------------------------------------------


def picklist(frame: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column as strings."""
    return frame.select(F.col(col).cast("string").alias("value")).distinct()


def table_values(frame: DataFrame, tbl: str, cols: Sequence[str]) -> DataFrame:
    """(tbl, col, value), distinct."""
    return value_index({tbl: frame}, {tbl: cols})


def value_index(frames: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(tbl, col, value), distinct, of a database; null values have no entry.

    Each column is a scan of its own, which reads no more of a columnar file and lets columns be worked on side by
    side. Its values are made distinct as what they are and only then written as text,
    but for kinds of which several values may have one text (as an hour that comes twice where clocks are put back).
    """
    each = [_texts(frames[t], c).select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), "value") for t, cols in columns.items() for c in dict.fromkeys(cols)]
    return reduce(DataFrame.unionAll, each)


def _texts(frame: DataFrame, col: str) -> DataFrame:
    """(value): the distinct texts of a column."""
    some = frame.select(F.col(f"`{col}`").alias("v")).where("v IS NOT NULL")
    kind, text = some.schema["v"].dataType, F.col("v").cast("string")
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):  # the two zeros are equal, but their texts aren't
        zero = F.when(F.col("v") == 0, text).alias("zero")
        return some.select("v", zero).distinct().select(F.coalesce("zero", text).alias("value"))
    if kind == StringType() or isinstance(kind, (IntegralType, DecimalType, BooleanType, DateType)):  # one text each
        return some.distinct().select(text.alias("value"))
    return some.select(text.alias("value")).where("value IS NOT NULL").distinct()


def inverted(index: DataFrame, by: Sequence[str]) -> DataFrame:
    """value -> its columns. The lists are no longer than the tables are wide."""
    return index.groupBy(*by).agg(F.array_sort(F.collect_set("col")).alias("cols"))


def gated(index: DataFrame, counts: DataFrame, gate: int | None = None) -> DataFrame:
    """Give the index up when the database has more than ``gate`` rows; off by default."""
    if gate is None:
        return index
    return index.filter(counts.agg((F.sum("n_rows") <= gate).alias("small")).scalar())


def match_key(c: Column) -> Column:
    return F.lower(F.trim(c))


# ---- stages ----------------------------------------------------------------------------


def exact_in_column(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Probes whose own column holds the literal, ignoring case and outer blanks."""
    keyed = index.select("tbl", "col", match_key(F.col("value")).alias("key"), "value")
    best = keyed.groupBy("tbl", "col", "key").agg(F.min("value").alias("value"))
    return probes.withColumn("key", match_key(F.col("literal"))).join(best, ["tbl", "col", "key"]).drop("key")


def best_in_table(probes: DataFrame, index: DataFrame | Searchable, exclude_own: bool = False, above: float | None = None, near: DataFrame | None = None) -> DataFrame:
    """Best (score, value, found_col) of the probe's table; its own column (``own_col``) may be left out."""
    if exclude_own:
        found = search(probes, index, ["tbl"], differ=["col"], above=above, near=near)
        return found.select("tbl", F.col("__p_col").alias("own_col"), "literal", "score", "value", F.col("col").alias("found_col"))
    return search(probes, index, ["tbl"], above=above, near=near).select("tbl", "literal", "score", "value", F.col("col").alias("found_col"))


def best_elsewhere(probes: DataFrame, index: DataFrame | Searchable, above: float | None = None, near: DataFrame | None = None) -> DataFrame:
    """Best (score, table, column, value) outside the probe's table."""
    index = index if isinstance(index, Searchable) else Searchable(index)
    found = search_elsewhere(probes, index, "tbl", above=above, near=near)
    return found.select(F.col("__p_tbl").alias("tbl"), "literal", "score", "value", F.col("tbl").alias("found_tbl"), F.col("col").alias("found_col"))


def number_checked(literal: Column, candidate: Column) -> Column:
    """The candidate, or null when both are numbers."""
    both = number_or_null(literal).isNotNull() & number_or_null(candidate).isNotNull()
    return F.when(~both, candidate)


class ByText:
    """The best candidates by token-sort score."""

    def __init__(self, index: Searchable):
        self.index = index

    def prepare(self, left: DataFrame) -> None:
        self.near = settled(self.index.near(left), "near")

    def in_column(self, left: DataFrame) -> DataFrame:
        return search(left, self.index, ["tbl", "col"], near=self.near).select("tbl", "col", "literal", "score", "value")

    def in_table(self, left: DataFrame) -> DataFrame:
        return best_in_table(left, self.index, above=ACCEPT_ABOVE, near=self.near).select("tbl", "literal", "value", "found_col")

    def elsewhere(self, left: DataFrame) -> DataFrame:
        return best_elsewhere(left, self.index, above=ACCEPT_ABOVE, near=self.near).select("tbl", "literal", "value", "found_tbl", "found_col")


class ByVector:
    """The best candidates by the cosine of mean word vectors (``token_vectors``: token, embedding); -1 where one has none.

    A value that equals the literal is preferred to others of the same vector. Values without a vector score -1 with every
    literal, which only counts for a column's best however poor: the least of each column that is asked for is enough.
    """

    def __init__(self, index: Searchable, token_vectors: DataFrame):
        self.entries, self.tokens = index.entries.select("tbl", "col", "value"), token_vectors

    def prepare(self, left: DataFrame) -> None:
        tokens = settled(self.tokens.where("embedding IS NOT NULL"), "token-vectors")
        means = settled(vectors.known_means(self.entries.select("value"), tokens), "means")
        columns = settled(left.select("tbl", "col").distinct(), "columns")
        others = self.entries.join(columns, ["tbl", "col"], "left_semi").join(means, "value", "left_anti")
        least = others.groupBy("tbl", "col").agg(F.min("value").alias("value"))
        held = settled(self.entries.join(means.select("value"), "value", "left_semi").unionByName(least), "held")
        self.values = settled(with_ordinal(held, ["value", "tbl", "col"], "id").join(means, "value", "left"), "value-vectors")
        asked = left.select("literal").distinct()
        means = vectors.mean_of_tokens(asked.select(F.col("literal").alias("value")), tokens).withColumnRenamed("value", "literal")
        self.asked = settled(with_ordinal(means, ["literal"], "id"), "literal-vectors")
        self.by_column, self.by_table = (vectors.VectorIndex(self.values.select(*on, "id", "vector"), on) for on in (["tbl", "col"], ["tbl"]))
        self.named = self.values.select(F.col("id").alias("other_id"), F.col("tbl").alias("found_tbl"), F.col("col").alias("found_col"), "value")

    def _best(self, left: DataFrame, index: vectors.VectorIndex, per: Sequence[str] = ()) -> DataFrame:
        probes = left.distinct().join(self.asked, "literal")
        found = vectors.nearest(probes.drop("literal"), index, index.on, per=per)
        return found.join(self.asked.select("id", "literal"), "id").join(self.named, "other_id")

    def in_column(self, left: DataFrame) -> DataFrame:
        return self._best(left.select("tbl", "col", "literal"), self.by_column).select("tbl", "col", "literal", "score", "value")

    def in_table(self, left: DataFrame) -> DataFrame:
        return self._best(left.select("tbl", "literal"), self.by_table).where(F.col("score") > ACCEPT_ABOVE).select("tbl", "literal", "value", "found_col")

    def elsewhere(self, left: DataFrame) -> DataFrame:
        places = [r[0] for r in self.by_table.blocks.select("tbl").distinct().collect()]  # as many as the database has tables
        everywhere = F.array(*[F.lit(x) for x in places]) if places else F.array().cast("array<string>")
        own = left.select(F.col("tbl").alias("own"), "literal").distinct()
        asked = own.select("own", "literal", F.explode(everywhere).alias("tbl")).where("tbl <> own")
        best = self._best(asked, self.by_table, ["own"]).where(F.col("score") > ACCEPT_ABOVE).select("own", "literal", "value", "found_tbl", "found_col")
        same = self.values.where("vector IS NOT NULL").select("value", F.col("tbl").alias("found_tbl"), F.col("col").alias("found_col"), match_key(F.col("value")).alias("key"))
        equal = own.withColumn("key", match_key(F.col("literal"))).join(same, "key").where("found_tbl <> own")
        equal = equal.groupBy("own", "literal").agg(F.min(F.struct("value", "found_tbl", "found_col")).alias("hit")).select("own", "literal", "hit.*")
        rest = best.join(equal, ["own", "literal"], "left_anti")
        return equal.unionByName(rest).withColumnRenamed("own", "tbl")


def calibrate(probes: DataFrame, index: DataFrame | Searchable, by: ByText | ByVector | None = None) -> DataFrame:
    """For each probe the column and value it most likely means.

    probes: tbl, col, literal (and anything else). Adds stage, match_tbl, match_col and
    match_value, null where nothing should be replaced. Stages, first that applies:
    1 exact in the column, 2 exact in the table, 3 column score, 4 table score, 5 score
    in another table, 6 the column's best however poor. Work is done per distinct probe,
    and each stage searches only for what the cheaper ones left over. ``by`` is what scores them, token-sort score unless
    another way is given.
    """
    searched = index if isinstance(index, Searchable) else Searchable(index)
    index = searched.entries
    unique = settled(probes.select("tbl", "col", "literal").distinct(), "unique-probes")
    keyed = unique.withColumn("key", match_key(F.col("literal")))
    values = index.select("tbl", F.col("col").alias("found"), "value", match_key(F.col("value")).alias("key"))
    values = values.join(keyed.select("tbl", "key"), ["tbl", "key"], "left_semi")  # only these move, if the probes are few
    hits = keyed.join(values, ["tbl", "key"], "left").groupBy("tbl", "col", "literal")
    own = F.when(F.max(F.col("found") == F.col("col")), F.lit(True))
    hit = F.min(F.when(F.col("found").isNotNull(), F.struct("value", F.col("found").alias("col"))))
    looked_up = settled(hits.agg(own.alias("own"), hit.alias("hit")), "looked-up")

    own_tbl, own_col, none = F.col("tbl"), F.col("col"), F.lit(None).cast("string")

    def answer(df: DataFrame, stage: int, tbl: Column, col: Column, value: Column) -> DataFrame:
        return df.select(
            "tbl", "col", "literal", F.lit(stage).alias("stage"),
            tbl.alias("match_tbl"), col.alias("match_col"), value.alias("match_value"),
        )

    first = answer(looked_up.filter("own"), 1, own_tbl, own_col, none)
    second = answer(
        looked_up.filter("own IS NULL AND hit IS NOT NULL"), 2, own_tbl, F.col("hit.col"), F.col("hit.value")
    )
    left = looked_up.filter("own IS NULL AND hit IS NULL").select("tbl", "col", "literal")
    by = ByText(searched) if by is None else by
    by.prepare(left)

    # A probe whose column holds no value at all gets no candidate and a null answer.
    column_best = settled(
        left.join(
            by.in_column(left).select("tbl", "col", "literal", F.col("score").alias("col_score"), F.col("value").alias("col_value")),
            ["tbl", "col", "literal"],
            "left",
        )
    )
    checked = number_checked(F.col("literal"), F.col("col_value"))
    third = answer(column_best.filter(F.col("col_score") > ACCEPT_ABOVE), 3, own_tbl, own_col, checked)
    left = column_best.filter(F.coalesce(F.col("col_score"), F.lit(0.0)) <= ACCEPT_ABOVE)

    table_best = settled(
        left.join(
            by.in_table(left),
            ["tbl", "literal"],
            "left",
        )
    )
    found = number_checked(F.col("literal"), F.col("value"))
    fourth = answer(
        table_best.filter("value IS NOT NULL"), 4, own_tbl,
        F.when(found.isNull(), own_col).otherwise(F.col("found_col")), found,
    )
    left = table_best.filter("value IS NULL").drop("value", "found_col")

    other_best = left.join(
        by.elsewhere(left),
        ["tbl", "literal"],
        "left",
    )
    hit = F.col("value").isNotNull()
    last = other_best.select(
        "tbl", "col", "literal",
        F.when(hit, 5).otherwise(6).alias("stage"),
        F.when(hit & found.isNotNull(), F.col("found_tbl")).otherwise(own_tbl).alias("match_tbl"),
        F.when(hit & found.isNotNull(), F.col("found_col")).otherwise(own_col).alias("match_col"),
        F.when(hit, found).otherwise(checked).alias("match_value"),
    )
    answers = first.unionAll(second).unionAll(third).unionAll(fourth).unionAll(last)
    return probes.join(answers, ["tbl", "col", "literal"])


def mismatch(answered: DataFrame) -> DataFrame:
    """Add ``verdict``: value wrong, column wrong or fine."""
    same = (F.col("match_tbl") == F.col("tbl")) & (F.col("match_col") == F.col("col"))
    has = F.col("match_value").isNotNull()
    return answered.withColumn(
        "verdict",
        F.when(same & has & (F.col("match_value") != F.col("literal")), "value wrong")
        .when(~same & has, "column wrong")
        .otherwise("fine"),
    )


def feedback(judged: DataFrame, query: str, order: str) -> DataFrame:
    """One numbered text per query naming the wrong predicates."""
    from pyspark.sql import Window

    wrong = judged.filter(F.col("verdict") != "fine").withColumn(
        "n", F.row_number().over(Window.partitionBy(query).orderBy(order))
    )
    own = F.concat_ws(".", "tbl", "col")
    in_column = F.format_string(WRONG_VALUE, "n", own, "literal", "match_value")
    in_other = F.format_string(WRONG_COLUMN, "n", own, "literal", F.concat_ws(".", "match_tbl", "match_col"), "match_value")
    line = F.when(F.col("verdict") == "value wrong", in_column).otherwise(in_other)
    lines = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return wrong.groupBy(query).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("feedback"))


def predicate_pairs(clauses: DataFrame) -> DataFrame:
    """One row per literal of a bar-separated list, in place of the ``literals`` column."""
    rest = [c for c in clauses.columns if c != "literals"]
    return clauses.select(*rest, F.posexplode(F.split("literals", r"\|")).alias("item", "literal"))


def eligible(predicates: DataFrame, sql: str = "sql_text", target: str = "target") -> DataFrame:
    """Predicates worth calibrating: no LIKE in the query, a ``table.column`` target, no dot in
    the literal. Double quotes are taken off the literal."""
    shaped = F.split(target, r"\.")
    return (
        predicates.filter(
            ~F.contains(F.lower(F.col(sql)), F.lit("like"))
            & (F.size(shaped) == 2)
            & ~F.contains(F.col("literal"), F.lit("."))
        )
        .withColumn("tbl", F.get(shaped, F.lit(0)))
        .withColumn("col", F.get(shaped, F.lit(1)))
        .withColumn("literal", F.translate("literal", '"', ""))
    )
