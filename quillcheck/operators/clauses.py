"""Structure, difficulty and clause-by-clause comparison of parsed queries.

A parsed query is a set of rows, one per clause unit:

query_id, role (gold or pred), clause (select, from, where, groupBy, having, orderBy, limit),
ordinal (place among the units of its clause), connector (and/or before a condition, else null),
not_op, op, agg, unit_op, col, is_distinct, value, value_kind, direction.

A nested query is a query of its own, tied to its parent by a link row:
parent_id, child_id, role, kind (intersect, union, except, or the clause that holds it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.session import settled

SET_OPS = ["intersect", "union", "except"]
CONDITION_CLAUSES = ["from", "where", "having"]

# The ten compared components, in report order.
COMPONENTS = [
    "select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order", "and/or", "IUEN", "keywords",
]

_QUERY = ["query_id", "role"]


# Expressions over unit rows are written as SQL text: they are many, and one parsed text is
# much quicker to build than the same expression put together call by call.
_CONDITION = "(clause IN ('where', 'having') OR (clause = 'from' AND op IS NOT NULL))"
_TABLE = "(clause = 'from' AND op IS NULL)"


# What a query has, each by its bit: all of them are one number of an aggregate.
_FEATURES = {
    **{f"has_{n}": f"clause = '{c}'" for n, c in {"where": "where", "group": "groupBy", "having": "having", "order": "orderBy", "limit": "limit"}.items()},
    "has_or": "connector = 'or'",
    "has_not": f"{_CONDITION} AND not_op",
    "has_in": f"{_CONDITION} AND op = 'in'",
    "has_like": f"{_CONDITION} AND op = 'like'",
    "has_nested": f"{_CONDITION} AND value_kind = 'nested'",
    "has_arithmetic": "unit_op <> 'none'",
    "has_aggregate": "agg <> 'none'",
    # The only two directions there are: the maximum of a text can't be kept in a hash aggregate and sorts all units.
    "asc": "clause = 'orderBy' AND direction = 'asc'",
    "desc": "clause = 'orderBy' AND direction = 'desc'",
}
_BIT = {name: 1 << i for i, name in enumerate(_FEATURES)}


def _features(units: DataFrame) -> DataFrame:
    bits = " | ".join(f"if({condition}, {_BIT[name]}, 0)" for name, condition in _FEATURES.items())
    return units.groupBy(*_QUERY).agg(F.expr(f"bit_or({bits}) AS features"))


_DIRECTION = f"CASE WHEN features & {_BIT['desc']} > 0 THEN 'desc' WHEN features & {_BIT['asc']} > 0 THEN 'asc' END"


def predicates(units: DataFrame) -> DataFrame:
    """Per query: which clauses and features it has, from one aggregate."""
    flags = [F.expr(f"features & {bit} > 0 AS {name}") for name, bit in _BIT.items() if name not in ("asc", "desc")]
    return _features(units).select(*_QUERY, F.expr(f"{_DIRECTION} AS direction"), *flags)


def _with_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (query_id, role, …) with ``kinds``, a bit for each set operator by which the query holds another, and ``n_nested``, how many it holds.

    Both sides of a query's links are one row, joined by the query alone, so rows kept in buckets of it stay where they are.
    """
    kind = "CASE kind " + " ".join(f"WHEN '{k}' THEN {1 << i}" for i, k in enumerate(SET_OPS)) + " ELSE 0 END"
    sides = [e for r in ("gold", "pred") for e in (F.expr(f"bit_or(if(role = '{r}', {kind}, 0)) AS __kinds_{r}"), F.expr(f"count_if(role = '{r}') AS __nested_{r}"))]
    held = links.groupBy(F.col("parent_id").alias("query_id")).agg(*sides)
    own = lambda c: F.expr(f"coalesce(if(role = 'gold', __{c}_gold, __{c}_pred), 0)")
    return rows.join(held.hint("shuffle_hash"), "query_id", "left").select(*rows.columns, own("kinds").alias("kinds"), own("nested").alias("n_nested"))


def nesting(links: DataFrame) -> int:
    """How deep set-operator branches nest: the number of links of the longest chain.

    Follows the ends of chains, a level at a time, until none goes on; only set-operator links are read, once.
    """
    steps = settled(links.filter(F.col("kind").isin(*SET_OPS)).select("role", "parent_id", "child_id").distinct(), "links")
    most = steps.count()  # a chain longer than that runs in a circle
    ends, depth = steps.select("role", "child_id"), 0
    while depth < most and not ends.isEmpty():
        depth += 1
        on = ends.distinct().withColumnRenamed("child_id", "parent_id")
        ends = settled(steps.join(on, ["role", "parent_id"]).select("role", "child_id"), "ends")
    return depth


def structures(units: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """``SELECT-FROM-WHERE-…``; a set operator is followed by the structure of its branch.

    ``depth`` is how far branches nest, found from the links unless the caller knows it. A query has at most three
    branches, so the lists built here are short.
    """
    depth = nesting(links) if depth is None else depth
    parts = {"where": "WHERE", "group": "GROUP BY", "having": "HAVING", "order": "ORDER BY", "limit": "LIMIT"}
    words = ", ".join(f"if(has_{n}, '{w}', null)" for n, w in parts.items())
    own = predicates(units).select(*_QUERY, F.expr(f"concat_ws('-', 'SELECT', 'FROM', {words}) AS own"))
    branches = links.filter(F.col("kind").isin(*SET_OPS))
    kinds = F.array(*map(F.lit, SET_OPS))
    full = own.withColumnRenamed("own", "structure")
    for _ in range(depth):
        child = full.select(F.col("query_id").alias("child_id"), "role", "structure")
        entry = F.struct(F.array_position(kinds, F.col("kind")).alias("at"), F.concat_ws("-", F.upper("kind"), "structure").alias("text"))
        tails = branches.join(child, ["child_id", "role"]).groupBy(F.col("parent_id").alias("query_id"), "role").agg(
            F.array_sort(F.collect_list(entry)).alias("tail")
        )
        text = F.concat_ws("-", "own", F.transform("tail", lambda x: x["text"]))
        full = own.join(tails, _QUERY, "left").select(*_QUERY, text.alias("structure"))
    return full


_KEYWORDS = ["where", "group", "having", "order", "limit", "except", "union", "intersect", "or", "not", "in", "like"]
_KEYWORD = {n: f"kinds & {1 << SET_OPS.index(n)} > 0" if n in SET_OPS else f"features & {_BIT['has_' + n]} > 0" for n in _KEYWORDS}


def keywords(units: DataFrame, links: DataFrame) -> DataFrame:
    """Per query the sorted set of keywords it uses."""
    words = ", ".join(f"if({_KEYWORD[n]}, '{n}', null)" for n in _KEYWORDS)
    return _with_links(_features(units), links).select(*_QUERY, F.expr(f"array_sort(array_compact(array({_DIRECTION}, {words}))) AS keywords"))


def counts(units: DataFrame, links: DataFrame, compat: bool = True) -> DataFrame:
    """component1, nested and others: the three counts that difficulty is read from.

    With ``compat`` an aggregate in WHERE or HAVING is counted as the established scorer
    does: by the NOT flag of a condition, and by every connector of HAVING.
    """

    if compat:
        aggregates = (
            "count_if(clause IN ('select', 'groupBy', 'orderBy') AND agg <> 'none' OR clause IN ('where', 'having') AND not_op)"
            " + count_if(clause = 'having' AND connector IS NOT NULL)"
        )
    else:
        aggregates = "count_if(clause IN ('select', 'groupBy', 'orderBy', 'where', 'having') AND agg <> 'none')"
    present = " + ".join(f"int(bool_or(clause = '{c}'))" for c in ("where", "groupBy", "orderBy", "limit"))
    several = " + ".join(f"int(count_if(clause = '{c}') > 1)" for c in ("select", "where", "groupBy"))
    sizes = units.groupBy(*_QUERY).agg(
        F.expr(
            f"{present} + greatest(count_if({_TABLE}) - 1, 0) + count_if(connector = 'or')"
            f" + count_if({_CONDITION} AND op = 'like') AS component1"
        ),
        F.expr(f"int({aggregates} > 1) + {several} AS others"),
    )
    return _with_links(sizes, links).select(*_QUERY, "component1", F.col("n_nested").alias("nested"), "others")


# The thresholds of the four levels of difficulty, as the established scorer has them.
def hardness(component1: Column, nested: Column, others: Column) -> Column:
    c, n, o = component1, nested, others
    flat = n == 0
    return (
        F.when((c <= 1) & (o == 0) & flat, "easy")
        .when(((o <= 2) & (c <= 1) & flat) | ((c <= 2) & (o < 2) & flat), "medium")
        .when(
            ((o > 2) & (c <= 2) & flat) | ((c > 2) & (c <= 3) & (o <= 2) & flat) | ((c <= 1) & (o == 0) & (n <= 1)),
            "hard",
        )
        .otherwise("extra")
    )


def difficulty(units: DataFrame, links: DataFrame, compat: bool = True) -> DataFrame:
    return counts(units, links, compat).withColumn(
        "hardness", hardness(F.col("component1"), F.col("nested"), F.col("others"))
    )


def mask_values(units: DataFrame) -> DataFrame:
    """Forget literals before comparison; only nested values keep their place."""
    keep = F.col("value_kind") == "nested"
    return units.withColumn("value", F.when(keep, F.col("value"))).withColumn("value_kind", F.when(keep, F.col("value_kind")))


def canonical_columns(units: DataFrame, canonical: DataFrame) -> DataFrame:
    """Replace key columns by their canonical one where their table is in FROM; drop DISTINCT.

    canonical: col, canonical; one row per key column of the schema, hence broadcast.
    """
    # Lists as short as a FROM; joined by the query alone, so units kept in buckets of it stay where they are.
    tables = units.filter(_TABLE).groupBy("query_id").agg(F.collect_set(F.struct("role", F.lower("col").alias("tbl"))).alias("__from"))
    tied = canonical.withColumn("__owner", F.regexp_extract("col", r"^__([^.]+)\.", 1))
    known = units.join(tables.hint("shuffle_hash"), "query_id", "left")
    held = F.col("canonical").isNotNull() & F.coalesce(~F.expr(_TABLE), F.lit(False)) & F.array_contains("__from", F.struct("role", F.col("__owner").alias("tbl")))
    return (
        known.join(F.broadcast(tied), "col", "left")
        .withColumn("col", F.when(held, F.col("canonical")).otherwise(F.col("col")))
        .withColumn("is_distinct", F.lit(None).cast("boolean"))
        .select(*units.columns)
    )


# ---- comparison ------------------------------------------------------------------------


def _key(cols: Sequence[str], nulls: Sequence[str] | None = None) -> str:
    """Compared within one query and part only. Nulls are skipped by the hash, so those of ``nulls`` (all, if not given) go in by their place."""
    bits = " | ".join(f"if({c} IS NULL, {1 << i}, 0)" for i, c in enumerate(cols) if nulls is None or c in nulls)
    return "xxhash64(" + ", ".join([*cols, bits or "0"]) + ")"


# Keys that several parts take in, made once per unit: of the expression, with its aggregate, of a whole condition.
_SHARED = {
    "expression": _key(["unit_op", "col", "is_distinct"]),
    "aggregated": _key(["agg", "expression"], ["agg"]),
    "test": f"if(clause IN ('where', 'having'), {_key(['not_op', 'op', 'value', 'aggregated'], ['not_op', 'op', 'value'])}, null)",
}

# clause -> part -> the key that is compared of each of its rows
_PARTS = {
    "select": {"select": "aggregated", "select(no AGG)": "expression"},
    "where": {"where": "test", "where(no OP)": "aggregated", "and/or": _key(["connector"])},
    "groupBy": {"group(no Having)": "xxhash64(coalesce(substring_index(col, '.', -1), '\\u0002'))", "group list": _key(["ordinal", "col"])},
    "having": {"having list": _key(["ordinal", "connector", "test"], ["ordinal", "connector"])},
    "orderBy": {"order list": _key(["ordinal", "direction", "aggregated"], ["ordinal", "direction"])},
    "from": {"tables": "xxhash64(coalesce(lower(col), '\\u0002'))"},
    "limit": {"limit": "0L"},
}
_PART_NAMES = [part for parts in _PARTS.values() for part in parts] + ["keywords"]
# Parts in which a key counts once.
_SETS = ["limit", "and/or", "keywords"]


def _comparable(units: DataFrame) -> DataFrame:
    """(query_id, role, part, key): what each component but the keywords compares, as bags of hashed keys; ``part`` by its number."""

    branches = " ".join(
        f"WHEN '{clause}' THEN array(" + ", ".join(f"named_struct('part', {_PART_NAMES.index(part)}, 'key', {key})" for part, key in parts.items()) + ")"
        for clause, parts in _PARTS.items()
    )
    keyed = units.filter(f"clause <> 'from' OR {_TABLE}").select(*_QUERY, "clause", "ordinal", "connector", "direction", "col", "not_op", "op", "value", "unit_op", "is_distinct", "agg")
    for name, key in _SHARED.items():
        keyed = keyed.withColumn(name, F.expr(key))
    return (
        keyed.select(*_QUERY, "connector", F.expr(f"inline(CASE clause {branches} END)"))
        .filter(f"part <> {_PART_NAMES.index('and/or')} OR connector IS NOT NULL")
        .select(*_QUERY, "part", "key")
    )


def overlaps(units: DataFrame, links: DataFrame) -> DataFrame:
    """Per gold query and part: gold size, predicted size and bag overlap, side by side.

    Rows are counted per key before they are counted per query, so a key that fills a third
    of the table shrinks to one row per task. Units kept in buckets of their query are counted where they are; keywords,
    a short set per query and side, come to them. Columns are named ``<part>:g``, ``:p``, ``:o``.
    """
    sets = ", ".join(str(_PART_NAMES.index(p)) for p in _SETS)
    most = f"if(part IN ({sets}), 1L, {2**62}L)"
    per_key = (
        _comparable(units)
        .groupBy("query_id", "part", "key")
        .agg(F.expr("count_if(role = 'gold') AS g"), F.expr("count_if(role = 'pred') AS p"))
        .selectExpr("query_id", "part", f"least(g, {most}) AS g", f"least(p, {most}) AS p")
    )
    totals = [
        F.expr(f"coalesce(sum(if(part = {number}, {value}, null)), 0L) AS `{part}:{side}`")
        for number, part in enumerate(_PART_NAMES)
        if part != "keywords"
        for side, value in (("g", "g"), ("p", "p"), ("o", "least(g, p)"))
    ]
    counted = per_key.groupBy("query_id").agg(*totals, F.expr("sum(g) AS gold_rows"))
    # A word is one bit, so the words of both sides are two numbers of a hash aggregate.
    told = {"asc": f"{_DIRECTION} = 'asc'", "desc": f"{_DIRECTION} = 'desc'", **_KEYWORD}
    bits = " | ".join(f"if({condition}, {1 << i}, 0)" for i, condition in enumerate(told.values()))
    words = _with_links(_features(units), links).select(*_QUERY, F.expr(bits).alias("bits")).groupBy("query_id").agg(
        *[F.expr(f"coalesce(bit_or(if(role = '{role}', bits, null)), 0) AS {role}_words") for role in ("gold", "pred")]
    )
    sides = {"g": "gold_words", "p": "pred_words", "o": "gold_words & pred_words"}
    words = words.select("query_id", *[F.expr(f"bigint(bit_count({bit})) AS `keywords:{side}`") for side, bit in sides.items()])
    both = words.join(counted, "query_id", "left").fillna(0)  # every query with units has a row of words
    return both.filter("gold_rows + `keywords:g` > 0").drop("gold_rows")


def _same(part: str) -> str:
    return f"(`{part}:g` = `{part}:p` AND `{part}:o` = `{part}:g`)"


def all_or_nothing(overlap: Column, pred_total: Column, label_total: Column) -> Column:
    """1 when both sides have the same size and all of it agrees, else 0."""
    return ((pred_total == label_total) & (overlap == pred_total)).cast("int")


def _component(name: str) -> tuple[str, str, str]:
    """(label_total, pred_total, overlap) of one component."""
    if name == "IUEN":
        return "label_total", "pred_total", "overlap"
    if name == "group":
        both = f"`group list:g` > 0 AND {_same('group list')} AND {_same('having list')}"
        return "bigint(`group list:g` > 0)", "bigint(`group list:p` > 0)", f"bigint({both})"
    if name == "order":
        both = f"`order list:g` > 0 AND {_same('order list')} AND {_same('limit')}"
        return "bigint(`order list:g` > 0)", "bigint(`order list:p` > 0)", f"bigint({both})"
    if name == "and/or":
        # Equal sets count as one of one; else the two sizes stand, in the established, swapped order.
        same = _same("and/or")
        return f"if({same}, 1L, `and/or:p`)", f"if({same}, 1L, `and/or:g`)", f"bigint({same})"
    return f"`{name}:g`", f"`{name}:p`", f"`{name}:o`"


def _hit(name: str) -> str:
    label, pred, overlap = _component(name)
    return f"({pred} = {label} AND {overlap} = {pred})"


def branch_pairs(links: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Set-operator branches of gold and prediction side by side: query_id, kind, gold_id, pred_id.

    Without ``parents`` a query is compared with the prediction of its own id; with ``parents`` (pair, gold_id, pred_id)
    the branches of each such pair, and query_id is the pair's.
    """
    steps = links.filter(F.col("kind").isin(*SET_OPS))
    if parents is None:
        steps = steps.withColumn("query_id", F.col("parent_id"))
    else:
        sides = [parents.select(F.col("pair").alias("query_id"), F.lit(r).alias("role"), F.col(f"{r}_id").alias("parent_id")) for r in ("gold", "pred")]
        steps = steps.join(sides[0].unionAll(sides[1]), ["role", "parent_id"])
    return steps.groupBy("query_id", "kind").agg(
        F.max(F.when(F.col("role") == "gold", F.col("child_id"))).alias("gold_id"),
        F.max(F.when(F.col("role") == "pred", F.col("child_id"))).alias("pred_id"),
    )


def unlike_pairs(links: DataFrame) -> tuple[DataFrame, int]:
    """(pair, gold_id, pred_id) of all branches that are stored under an id of their own on either side, and how far they nest.

    A level at a time, from the branches of like ids down to the branches of what was found, each pair once. ``pair``
    numbers are below zero and far from any id.
    """
    links = settled(links.filter(F.col("kind").isin(*SET_OPS)).distinct(), "links")
    unlike = (F.col("gold_id") != F.col("pred_id")).alias("unlike")
    numbered = lambda df: df.select((F.lit(-(2**62)) + F.monotonically_increasing_id()).alias("pair"), "gold_id", "pred_id")
    found = settled(numbered(branch_pairs(links).where(unlike).select("gold_id", "pred_id").distinct()), "unlike")
    newest, levels = found, 0
    while not newest.isEmpty():
        levels += 1
        below = branch_pairs(links, newest).where(unlike).select("gold_id", "pred_id").distinct()
        below = below.join(found, ["gold_id", "pred_id"], "left_anti")
        newest = settled(below.select((F.lit(-(2**62) + (levels << 56)) + F.monotonically_increasing_id()).alias("pair"), "gold_id", "pred_id"), "unlike")
        found = found.unionByName(newest)
    return found, levels


def _of_pairs(rows: DataFrame, pairs: DataFrame, query: str) -> DataFrame:
    """Units or links of both sides of unlike pairs, under the pair's number instead of the query's."""
    # Both sides at once and by the query alone, so units kept in buckets of it stay where they are
    sides = [pairs.select(F.col(f"{r}_id").alias(query), *[(F.col("pair") if r == s else F.lit(None).cast("long")).alias(f"__{s}") for s in ("gold", "pred")]) for r in ("gold", "pred")]
    met = rows.join(sides[0].unionAll(sides[1]).hint("shuffle_hash"), query).withColumn(query, F.expr("if(role = 'gold', __gold, __pred)"))
    return met.where(F.col(query).isNotNull()).select(*rows.columns)


def exact_matches(base: DataFrame, branches: DataFrame) -> DataFrame:
    """Per node: exact match including its branches, and the branch totals.

    ``base`` has query_id and ``same``, whether everything but the branches agrees; ``branches`` has query_id, gold_id,
    pred_id and child, the node that compares the two (null where a side is missing). Only nodes with branches and their
    children are followed: from those that differ themselves upwards, a level at a time, until nothing new differs.
    """
    totals = branches.groupBy("query_id").agg(F.count("gold_id").alias("label_total"), F.count("pred_id").alias("pred_total"), F.count("child").alias("both"))
    followed = branches.select("query_id").unionAll(branches.select("child").where("child IS NOT NULL")).distinct()
    own = followed.join(base.select("query_id", "same"), "query_id", "left").join(totals, "query_id", "left")
    own = own.fillna(0, ["label_total", "pred_total", "both"]).fillna(False, ["same"])  # a branch that isn't there agrees with nothing
    whole = F.col("same") & (F.col("label_total") == F.col("pred_total")) & (F.col("both") == F.col("pred_total"))
    nodes = settled(own.select("query_id", "label_total", "pred_total", whole.alias("whole")), "nodes")
    up = settled(branches.where("child IS NOT NULL").select("query_id", "child"), "up")
    unlike = nodes.where("NOT whole").select("query_id")
    newest = unlike
    while True:
        above = up.join(newest.withColumnRenamed("query_id", "child"), "child", "left_semi").select("query_id").distinct()
        newest = settled(above.join(unlike, "query_id", "left_anti"), "unlike")
        if newest.isEmpty():
            break
        unlike = unlike.unionAll(newest)
    exact = nodes.join(unlike.withColumn("differs", F.lit(True)), "query_id", "left").select("query_id", "label_total", "pred_total", F.col("differs").isNull().alias("whole"))
    hits = up.join(exact.where("whole").select(F.col("query_id").alias("child")), "child").groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))
    told = exact.join(hits, "query_id", "left")
    out = base.join(told, "query_id", "left").fillna(0, ["label_total", "pred_total", "overlap"])
    return out.withColumn("exact", F.coalesce("whole", "same")).drop("whole")


def _base(units: DataFrame, links: DataFrame) -> DataFrame:
    same = " AND ".join(_hit(name) for name in COMPONENTS if name != "IUEN")
    return overlaps(units, links).withColumn("same", F.expr(f"{same} AND (`tables:g` = 0 OR {_same('tables')})"))


def score(units: DataFrame, links: DataFrame) -> DataFrame:
    """Per gold query the ten component totals and the exact-match verdict.

    A gold query without a readable prediction has no predicted rows and scores 0. Branches of the same operator are
    compared by their own clauses and branches, whatever their ids.
    """
    pairs, levels = unlike_pairs(links)
    branches = branch_pairs(links).select("query_id", "gold_id", "pred_id")
    base = _base(units, links)
    if levels:  # the sides of unlike pairs, apart from all others, which stay where they are kept
        branches = branches.unionByName(branch_pairs(links, pairs).select("query_id", "gold_id", "pred_id"))
        below = _of_pairs(links.filter(F.col("kind").isin(*SET_OPS)), pairs, "parent_id")
        base = base.unionByName(_base(_of_pairs(units, pairs, "query_id"), below))
    node = F.when(F.col("gold_id") == F.col("pred_id"), F.col("gold_id")).otherwise(F.col("pair")).alias("child")
    branches = settled(branches.join(pairs, ["gold_id", "pred_id"], "left").select("query_id", "gold_id", "pred_id", node), "branches")
    found = exact_matches(settled(base, "clauses"), branches)
    return found.filter(F.col("query_id") > -(2**61)) if levels else found


def partial_scores(scored: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """One row per (query, component): totals, overlap, acc, rec and f1.

    ``scored`` comes from ``score``; where IUEN is not asked for, ``overlaps`` will do.
    """
    rows = []
    for name in components:
        label, pred, overlap = _component(name)
        rows.append(f"named_struct('component', '{name}', 'label_total', {label}, 'pred_total', {pred}, 'overlap', {overlap})")
    hit = F.expr("int(pred_total = label_total AND overlap = pred_total)")
    each = scored.select("query_id", F.expr(f"inline(array({', '.join(rows)}))"))
    return each.select("*", *[hit.alias(rate) for rate in ("acc", "rec", "f1")])


def partial_totals(scored: DataFrame, level: str, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """(level, component, hits and sizes): what rates are averaged from, added up side by side and only then set one below another.

    ``pred_hits`` of ``pred_n`` rows with a prediction, ``label_hits`` of ``label_n`` rows with a label.
    """
    sums = []
    for i, name in enumerate(components):
        label, pred, _ = _component(name)
        hit = f"int({_hit(name)})"
        for side, total in (("pred", pred), ("label", label)):
            sums += [F.expr(f"sum(if({total} > 0, {hit}, 0)) AS {side}_hits_{i}"), F.expr(f"count_if({total} > 0) AS {side}_n_{i}")]
    rows = ", ".join(f"named_struct('component', '{name}', " + ", ".join(f"'{c}', {c}_{i}" for c in ("pred_hits", "pred_n", "label_hits", "label_n")) + ")" for i, name in enumerate(components))
    return scored.groupBy(level).agg(*sums).select(level, F.expr(f"inline(array({rows}))"))
