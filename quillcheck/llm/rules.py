"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones.

Statistics are Spark expressions. Sequential covering learns on a bounded sample of their labelled rows: a rule is a
conjunction of thresholds, grown literal by literal on one part of the sample by information gain and pruned on the
other; the rows it covers are set aside before the next rule is grown. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.session import settled

BLANKS = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "distinct_share", "line_words")
SAMPLE = 20_000  # most labelled rows that rules are learned from
MIN_WORDS = 50
LEAST_PRECISION = 0.97
MOST_RULES = 12
MOST_LITERALS = 4


def _windows(words: Column, n: Column, size: int) -> Column:
    """A hash of the words from each place on; of texts shorter than a window none."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size)))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not at every place where it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column, size: int) -> Column:
    """The number of words that lie in windows found twice or more."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = _let(order, lambda o: F.filter(o, lambda x, i: same(x, F.get(o, i - 1)) | same(x, F.get(o, i + 1))))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
    step = lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(size))).cast("long").alias("n"), i.alias("last"))
    return F.aggregate(places, begin, step, lambda s: s["n"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ``FEATURES`` of every row.

    A null text has no words; of an empty text all are zero. Windows of three words are compared by 64-bit hashes
    within their own text. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", "text", F.split(F.btrim("text", F.lit(_TRIM)), BLANKS).alias("words"))
    n = F.when((F.size("words") == 1) & (F.get("words", F.lit(0)) == ""), 0).otherwise(F.size("words"))
    d = d.select("*", n.alias("n"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "text", "n", "words", _windows(F.col("words"), F.col("n"), 3).alias("hashes"), lines.alias("lines"))
    repeated = F.size("hashes") > F.size(F.array_distinct("hashes"))
    d = d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(repeated, _covered(F.col("hashes"), 3)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        F.when(F.col("n") > 0, F.size(F.array_distinct("words"))).otherwise(0).cast("long").alias("n_distinct"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_shouts", "n_words").alias("shout_share"),
        share("n_distinct", "n_words").alias("distinct_share"), share("n_words", "n_lines").alias("line_words"),
    )


def base_failed(s: DataFrame) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Literal:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(FEATURES[self.feature])
        return c >= self.threshold if self.above else c <= self.threshold


Rule = tuple[Literal, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _best_literal(x: np.ndarray, bad: np.ndarray) -> Literal | None:
    """The threshold with the highest gain: covered bad rows times the rise of the log share of bad rows."""
    now = math.log2(bad.mean())
    best, gain = None, 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between cut and cut + 1
        if not len(cut):
            continue
        p = np.cumsum(b)
        for above in (False, True):
            covered = len(v) - cut - 1 if above else cut + 1
            hits = p[-1] - p[cut] if above else p[cut]
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(hits > 0, hits * (np.log2(hits / covered) - now), 0)
            at = int(np.argmax(g))
            if g[at] > gain:
                gain, best = float(g[at]), Literal(f, above, float((v[cut[at]] + v[cut[at] + 1]) / 2))
    return best


def _precision(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    covered = _covers(rule, x)
    return (bad[covered].sum() + 0.5) / (covered.sum() + 1)


def learn(x: np.ndarray, quality: np.ndarray, most_rules: int = MOST_RULES, most_literals: int = MOST_LITERALS) -> list[Rule]:
    """An ordered list of rules; a row that one of them covers is of low quality.

    Bounds that a user may move: ``most_rules`` rules, each of ``most_literals`` thresholds.
    """
    bad = np.asarray(quality) == 0
    part = np.arange(len(x)) % 3 < 2
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < most_rules:
        grow, prune = left & part, left & ~part
        if bad[grow].sum() < 5 or not (bad & prune).any():
            break
        rule: Rule = ()
        while len(rule) < most_literals:
            at = np.flatnonzero(grow)[_covers(rule, x[grow])]
            literal = None if bad[at].all() else _best_literal(x[at], bad[at])
            if literal is None:
                break
            rule = (*rule, literal)
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: (_precision(r, x[prune], bad[prune]), len(r)))
        covered = _covers(rule, x) & left
        if _precision(rule, x[prune], bad[prune]) < LEAST_PRECISION and bad[covered].mean() < LEAST_PRECISION or bad[covered].sum() < 5:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule covers: the rules in order as one conditional expression."""
    out = None
    for rule in rules:
        condition = F.lit(True)
        for literal in rule:
            condition = condition & literal.column()
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_rules: int = MOST_RULES, most_literals: int = MOST_LITERALS
) -> DataFrame:
    """Statistics of every row, base_failed and kept.

    Rules are learned from at most ``sample`` labelled rows, those whose id has the least hash; ids or qualities that
    are null don't count, nor do labels without document; without labels there are no rules. An id with unlike labels
    counts with the least, rows that share an id as the one with the least statistics. Empty texts fail the base; an
    empty table gives no rows. At most ``most_rules`` rules of at most ``most_literals`` thresholds are learned.
    The statistics (a few numbers per row) are written once to the shared folder, so every text is read once.
    """
    found = settled(statistics(docs, id_col, text_col), "statistics")
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = found.where(f"n_words >= {MIN_WORDS}").join(F.broadcast(few), "doc_id")
    rows = seen.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("row")).select("row.*").collect()  # at most ``sample`` rows
    x = np.array([r[1:] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, dtype=int)
    rules = learn(x[order], np.array([r[0] for r in rows], dtype=int)[order], most_rules, most_literals) if rows else []
    failed = base_failed(found)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
