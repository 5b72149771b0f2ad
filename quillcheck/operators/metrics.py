"""Accuracy roll-ups by level, turn, session and database.

Every roll-up is a partial aggregate over a long score table; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.operators.ordering import running

LEVELS = ["easy", "medium", "hard", "extra", "all", "joint_all"]


def pair_turns(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold and prediction of the same session and turn; longer sessions are cut to the shorter."""
    return gold.join(pred, ["session_id", "turn_idx"])


def session_sizes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Turns per session on both sides, and whether they agree."""
    signed = gold.select("session_id", F.lit("g").alias("side")).unionAll(pred.select("session_id", F.lit("p").alias("side")))
    return signed.groupBy("session_id").agg(
        F.count_if(F.col("side") == "g").alias("n_gold"), F.count_if(F.col("side") == "p").alias("n_pred")
    ).withColumn("agree", F.col("n_gold") == F.col("n_pred"))


def rate(ok: Column) -> Column:
    return F.avg(ok.cast("double"))


def by_level(scores: DataFrame, ok: str, level: str = "level") -> DataFrame:
    """count and rate per level, and over all of them as level ``all``."""
    rolled = scores.rollup(level).agg(
        F.grouping(level).alias("__all"), F.count("*").alias("n"), rate(F.col(ok)).alias("rate")
    )
    name = F.when(F.col("__all") == 1, "all").otherwise(F.col(level))
    return rolled.select(name.alias("level"), "n", "rate")


def turn_bucket(turn_idx: Column) -> Column:
    return F.when(turn_idx > 3, "turn > 4").otherwise(F.concat(F.lit("turn "), (turn_idx + 1).cast("string")))


def by_turn(scores: DataFrame, oks: Sequence[str]) -> DataFrame:
    return scores.groupBy(turn_bucket(F.col("turn_idx")).alias("turn")).agg(
        F.count("*").alias("n"), *[rate(F.col(c)).alias(c) for c in oks]
    )


def joint(scores: DataFrame, oks: Sequence[str]) -> DataFrame:
    """A session counts only if every one of its turns is right."""
    per_session = scores.groupBy("session_id").agg(*[F.min(F.col(c).cast("int")).alias(c) for c in oks])
    return per_session.agg(F.count("*").alias("n"), *[rate(F.col(c)).alias(c) for c in oks])


def partial_rates(partial: DataFrame, level: str = "level") -> DataFrame:
    """Per level and component: acc over rows with a prediction, rec over rows with a label.

    A side without such rows has rate 0.
    """
    component, lev = F.col("component"), F.col(level)
    rolled = partial.groupingSets([[component, lev], [component]], component, lev).agg(
        F.grouping(level).alias("__all"),
        F.coalesce(F.avg(F.when(F.col("pred_total") > 0, F.col("acc").cast("double"))), F.lit(0.0)).alias("acc"),
        F.coalesce(F.avg(F.when(F.col("label_total") > 0, F.col("rec").cast("double"))), F.lit(0.0)).alias("rec"),
    )
    name = F.when(F.col("__all") == 1, "all").otherwise(F.col(level))
    return rolled.select("component", name.alias("level"), "acc", "rec")


def rates_of(totals: DataFrame, level: str = "level") -> DataFrame:
    """The same from totals per level and component: pred_hits, pred_n, label_hits, label_n."""
    component, lev = F.col("component"), F.col(level)
    rate_of = lambda side: F.coalesce(F.try_divide(F.sum(f"{side}_hits").cast("double"), F.sum(f"{side}_n")), F.lit(0.0))
    rolled = totals.groupingSets([[component, lev], [component]], component, lev).agg(F.grouping(level).alias("__all"), rate_of("pred").alias("acc"), rate_of("label").alias("rec"))
    name = F.when(F.col("__all") == 1, "all").otherwise(F.col(level))
    return rolled.select("component", name.alias("level"), "acc", "rec")


def f1(acc: Column, rec: Column, zero_f1: float = 1.0) -> Column:
    """F1 of two averaged rates; ``zero_f1`` where both are 0, as the established report has it."""
    return F.when((acc == 0) & (rec == 0), F.lit(zero_f1)).otherwise(2.0 * acc * rec / (acc + rec))


def report(measures: DataFrame, levels: Sequence[str] = tuple(LEVELS)) -> DataFrame:
    """(measure, level, value) as one line per measure and one column per level."""
    return measures.groupBy("measure").pivot("level", list(levels)).agg(F.first("value"))


def level_measures(scores: DataFrame, oks: Sequence[str]) -> DataFrame:
    """(measure, level, value) of counts and rates by level, overall and joint."""
    rolled = scores.rollup("level").agg(
        F.grouping("level").alias("__all"), F.count("*").cast("double").alias("count"), *[rate(F.col(c)).alias(c) for c in oks]
    )
    per_level = rolled.select(
        F.when(F.col("__all") == 1, "all").otherwise(F.col("level")).alias("level"), "count", *oks
    )
    together = joint(scores, oks).select(F.lit("joint_all").alias("level"), F.col("n").cast("double").alias("count"), *oks)
    return per_level.unionAll(together).unpivot("level", ["count", *oks], "measure", "value")


def wrong_items(scores: DataFrame, ok: str) -> DataFrame:
    return scores.filter(F.col(ok).cast("int") == 0).select("session_id", "turn_idx")


def by_database(scores: DataFrame, ok: str, subset: str | None = None) -> DataFrame:
    """Rate per database and overall (db_id null), of one database when ``subset`` is given."""
    kept = scores if subset is None else scores.filter(F.col("db_id") == subset)
    return kept.rollup("db_id").agg(F.count("*").alias("n"), rate(F.col(ok)).alias("rate"))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each distinct row. Rows travel as digests, not as whole texts."""
    cells = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    per_row = df.select(F.sha2(cells, 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return per_row.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn(
        "n_duplicates", F.col("n_rows") - F.col("n_distinct")
    )


def running_mean(df: DataFrame, order: str, value: Column, weight: Column, block: int = 1 << 20) -> DataFrame:
    """Weighted mean of all rows up to and including each, along the unique integer ``order``."""
    totals = running(df, order, {"__vw": ("sum", value * weight), "__w": ("sum", weight)}, block)
    return totals.withColumn("mean", F.col("__vw").cast("double") / F.col("__w").cast("double")).drop("__vw", "__w")


def mean_cost(df: DataFrame, cost: str) -> DataFrame:
    return df.agg(F.sum(cost).alias("total"), F.count("*").alias("items"), (F.sum(cost) / F.count("*")).alias("mean_cost"))


def scored_turns(scores: DataFrame) -> DataFrame:
    """Leave out the closing pairs, whose turn number is negative."""
    return scores.filter(F.col("turn_idx") >= 0)
