"""Candidate lists: fold, label, re-rank, choose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions.text import STRUCTURE_KEYWORDS

# Fixed value: how far the best score must lead the first candidate's to replace it.
GAP = 0.2


def placed(hypotheses: DataFrame, index: str, k: int) -> DataFrame:
    """Input and rank of hypotheses that come in one flat list, exactly k per input."""
    return hypotheses.withColumns({"input_id": F.floor(F.col(index) / k), "rank": F.col(index) % k})


def fold(hypotheses: DataFrame, item: str, rank: str, text: str) -> DataFrame:
    """Hypotheses as one list per input, by rank; as many as an input has."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("at"), F.col(text).alias("text"))))
    return hypotheses.groupBy(F.col(item).alias("input_id")).agg(F.transform(listed, lambda x: x["text"]).alias("topk"))


def best(hypotheses: DataFrame, item: str, rank: str, text: str) -> DataFrame:
    """The first hypothesis of each input, by partial aggregation."""
    return hypotheses.groupBy(F.col(item).alias("input_id")).agg(F.min_by(text, rank).alias("best"))


def regroup(rows: DataFrame, index: str, payload: str, names: Sequence[str]) -> DataFrame:
    """Consecutive task rows of a question side by side, one column per task."""
    n = len(names)
    return rows.groupBy(F.floor(F.col(index) / n).alias("question_id")).agg(
        *[F.max(F.when(F.col(index) % n == i, F.col(payload))).alias(name) for i, name in enumerate(names)]
    )


def select_items(select: Column) -> Column:
    """The items of a select text, sorted; the leading ``select `` is skipped."""
    return F.array_sort(F.split(F.substr(select, F.lit(8)), ", "))


def same_select(a: Column, b: Column) -> Column:
    return select_items(a) == select_items(b)


def usable_structures(structures: Column, keep: int = 2) -> Column:
    """The first structures made of known keywords only; a single one is repeated."""
    known = F.array(*map(F.lit, STRUCTURE_KEYWORDS))
    kept = F.slice(F.filter(structures, lambda s: F.size(F.array_except(F.split(s, "-"), known)) == 0), 1, keep)
    return F.when(F.size(kept) == 1, F.concat(kept, kept)).otherwise(kept)


def known_table_lists(lists: Column, known: Column) -> Column:
    """Lists that name only known tables; blank ones go."""
    return F.filter(lists, lambda x: (x != "") & (F.size(F.array_except(F.split(x, " "), known)) == 0))


def pairs(rows: DataFrame, selects: str, structures: str, select_labels: str | None = None, structure_labels: str | None = None) -> DataFrame:
    """Every select with every structure of the same row; both lists are short by their nature.

    With the two lists of labels (booleans) a pair's ``label`` is true where both of its parts are right; a missing label
    counts as wrong.
    """
    lists = [c for c in (selects, structures, select_labels, structure_labels) if c is not None]
    rest = [c for c in rows.columns if c not in lists]
    kept = [c for c in (structures, structure_labels, select_labels) if c is not None]
    one = rows.select(*rest, *kept, F.posexplode(selects).alias("select_at", "select_text"))
    both = one.select(*one.columns, F.posexplode(structures).alias("structure_at", "structure_text"))
    out = both.select(*rest, "select_at", "select_text", "structure_at", "structure_text", *[c for c in kept if c != structures])
    if select_labels is None or structure_labels is None:
        return out
    right = F.coalesce(F.get(select_labels, F.col("select_at")) & F.get(structure_labels, F.col("structure_at")), F.lit(False))
    return out.withColumn("label", right).drop(select_labels, structure_labels)


def pair_text(select: Column, structure: Column) -> Column:
    """A select and the words of a structure behind its first one, set apart by dots."""
    parts = F.split(structure, "-")
    return F.concat_ws(" ", select, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " … "))


def positive_probability(negative: Column, positive: Column) -> Column:
    """Softmax of two logits, second class."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(negative - positive))


def gap_choice(candidates: DataFrame, group: str, pos: str, score: str, gap: float = GAP) -> DataFrame:
    """Per group the best-scored place if it leads the first candidate by ``gap``, else place 0."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"))).alias("top")
    per_group = candidates.groupBy(group).agg(top, F.min_by(score, pos).alias("first"))
    lead = F.col("top.s") - F.col("first")
    return per_group.select(
        group, F.col("first").alias("first_score"), F.col("top.s").alias("best_score"),
        F.when(lead >= gap, -F.col("top.p")).otherwise(F.lit(0)).alias("chosen"),
    )


def decode_choice(chosen: Column, selects: Column, structures: Column) -> tuple[Column, Column]:
    """The select and the structure that a place in their pair list stands for."""
    width = F.size(structures)
    return F.get(selects, F.floor(chosen / width).cast("int")), F.get(structures, (chosen % width).cast("int"))


def tried(candidates: DataFrame, group: str, pos: str, n_rows: str) -> DataFrame:
    """Per group where the search stops: the first candidate with a non-empty result, else the last."""
    return candidates.groupBy(group).agg(
        F.min(F.when(F.col(n_rows) > 0, F.col(pos))).alias("hit"), F.max(pos).alias("last")
    ).select(group, F.coalesce("hit", "last").alias("stop"), F.col("hit").isNotNull().alias("found"))


def final_pick(candidates: DataFrame, group: str, pos: str, text: str, n_rows: str) -> DataFrame:
    """``None`` without candidates; the first when it has rows, is alone or the second failed; else the second.

    ``n_rows`` is null for a candidate that failed. Groups without candidates have a null ``pos``.
    """

    def at(i: int, what: str) -> Column:
        return F.max(F.when(F.col(pos) == i, F.col(what)))

    per_group = candidates.groupBy(group).agg(
        F.count(pos).alias("n"), at(0, text).alias("t0"), at(1, text).alias("t1"), at(0, n_rows).alias("r0"), at(1, n_rows).alias("r1")
    )
    first = (F.coalesce("r0", F.lit(0)) > 0) | (F.col("n") == 1) | F.col("r1").isNull()
    return per_group.select(
        group, F.when(F.col("n") == 0, "None").when(first, F.col("t0")).otherwise(F.col("t1")).alias("pick")
    )


def mixed_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups that hold both a right and a wrong candidate."""
    mixed = rows.groupBy(group).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = 0 AND hi = 1")
    return rows.join(mixed.select(group), group, "left_semi")


def with_negatives(rows: DataFrame, group: str, item: str, label: str, n: int = 3, seed: int = 1) -> DataFrame:
    """Each right candidate with ``n`` wrong ones of its group, as (group, positive, item, label).

    Which wrong ones is decided by a seeded hash, so a rerun draws the same. The rank filter
    is applied before the shuffle as well, so a hot group sends only its few lowest hashes.
    """
    draw = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string"))), item)
    drawn = (
        rows.filter(F.col(label) == 0)
        .select(group, F.col(item).alias("negative"), F.row_number().over(draw).alias("r"))
        .filter(F.col("r") <= n)
        .groupBy(group)
        .agg(F.collect_list("negative").alias("negatives"))
    )
    right = rows.filter(F.col(label) == 1).select(group, F.col(item).alias("positive"))
    both = right.join(drawn, group)
    entries = F.concat(
        F.array(F.struct(F.col("positive").alias("item"), F.lit(1).alias("label"))),
        F.transform("negatives", lambda x: F.struct(x.alias("item"), F.lit(0).alias("label"))),
    )
    return both.select(group, "positive", F.inline(entries))
