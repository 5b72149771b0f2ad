"""Candidates of every order, folded, labelled, re-ranked and picked."""

from pyspark.sql import functions as F

from quillcheck.operators import ranking as rk
from quillcheck.plans.registry import plan
from quillcheck.plans.views import oracle, view


def candidates(t):
    return view(t, "candidates")


def beams(t):
    return view(t, "beams")


@plan(
    "r01_folded",
    oracle("SELECT item_id AS input_id, string_agg(text, '|' ORDER BY pos) AS topk FROM <<candidates>> GROUP BY item_id"),
)
def folded(t):
    return rk.fold(candidates(t), "item_id", "pos", "text").withColumn("topk", F.array_join("topk", "|"))


@plan("r02_best", oracle("SELECT item_id AS input_id, text AS best FROM <<candidates>> WHERE pos = 0"))
def best(t):
    return rk.best(candidates(t), "item_id", "pos", "text")


@plan(
    "r03_regrouped",
    """SELECT event_id // 3 AS question_id, max(props) FILTER (WHERE event_id % 3 = 0) AS structure, max(props) FILTER (WHERE event_id % 3 = 1) AS select_text,
    max(props) FILTER (WHERE event_id % 3 = 2) AS tables FROM events GROUP BY 1""",
)
def regrouped(t):
    return rk.regroup(t.events, "event_id", "props", ["structure", "select_text", "tables"])


@plan(
    "r04_select_label",
    oracle(
        """SELECT input_id, place, list_sort(string_split(substring(hyp, 8), ', ')) = list_sort(string_split(substring(gold_select, 8), ', ')) AS label
        FROM (SELECT input_id, gold_select, unnest(selects) AS hyp, unnest(range(len(selects))) AS place FROM <<beams>>) x"""
    ),
)
def select_label(t):
    rows = beams(t).select("input_id", "gold_select", F.posexplode("selects").alias("place", "hyp"))
    return rows.select("input_id", F.col("place").cast("bigint").alias("place"), rk.same_select(F.col("hyp"), F.col("gold_select")).alias("label"))


_WORDS = "['SELECT', 'FROM', 'WHERE', 'GROUP BY', 'HAVING', 'ORDER BY', 'LIMIT', 'INTERSECT', 'UNION', 'EXCEPT']"
_KEPT = f"list_slice(list_filter(structures, lambda s: len(list_filter(string_split(s, '-'), lambda w: NOT list_contains({_WORDS}, w))) = 0), 1, 2)"


@plan(
    "r05_structures",
    oracle(f"SELECT input_id, array_to_string(CASE WHEN len(k) = 1 THEN list_concat(k, k) ELSE k END, '|') AS structures FROM (SELECT input_id, {_KEPT} AS k FROM <<beams>>) x"),
)
def structures(t):
    return beams(t).select("input_id", F.array_join(rk.usable_structures(F.col("structures")), "|").alias("structures"))


@plan(
    "r06_table_lists",
    oracle(
        """SELECT input_id, array_to_string(list_filter(table_lists, lambda l: l <> '' AND len(list_filter(string_split(l, ' '), lambda w: NOT list_contains(
        ['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem'], w))) = 0), '|') AS table_lists FROM <<beams>>"""
    ),
)
def table_lists(t):
    known = F.array(*map(F.lit, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]))
    return beams(t).select("input_id", F.array_join(rk.known_table_lists(F.col("table_lists"), known), "|").alias("table_lists"))


@plan(
    "r07_pairs",
    oracle(
        """SELECT input_id, select_at, structure_at, selects[select_at + 1] || ' ' || array_to_string(list_slice(string_split(structures[structure_at + 1], '-'), 2, 99), ' … ') AS pair,
        selects[select_at + 1] = gold_select AND structures[structure_at + 1] = 'SELECT-FROM-WHERE' AS label
        FROM (SELECT *, unnest(range(len(structures))) AS structure_at FROM (SELECT *, unnest(range(len(selects))) AS select_at FROM
        (SELECT input_id, gold_select, list_append(selects, gold_select) AS selects, structures FROM <<beams>>) w) x) y"""
    ),
)
def pairs(t):
    rows = beams(t).select("input_id", "gold_select", F.array_append("selects", F.col("gold_select")).alias("selects"), "structures")
    labels = [F.transform("selects", lambda s: s == F.col("gold_select")).alias("right"), F.transform("structures", lambda s: s == "SELECT-FROM-WHERE").alias("fits")]
    made = rk.pairs(rows.select("input_id", "selects", "structures", *labels), "selects", "structures", "right", "fits")
    return made.select(
        "input_id",
        F.col("select_at").cast("bigint").alias("select_at"),
        F.col("structure_at").cast("bigint").alias("structure_at"),
        rk.pair_text(F.col("select_text"), F.col("structure_text")).alias("pair"),
        "label",
    )


@plan(
    "r08_probability",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(exp(l_tax * 10) / (exp(l_discount * 10) + exp(l_tax * 10)), 9) AS p FROM lineitem""",
)
def probability(t):
    p = rk.positive_probability(F.col("l_discount") * 10, F.col("l_tax") * 10)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(p, 9).alias("p"))


_CHOICE = """SELECT item_id, max(score) FILTER (WHERE pos = 0) AS first_score, max(score) AS best_score,
 CASE WHEN max(score) - max(score) FILTER (WHERE pos = 0) >= 0.2 THEN arg_min(pos, [-score, pos]) ELSE 0 END AS chosen FROM <<candidates>> GROUP BY item_id"""


@plan("r09_gap_choice", oracle(_CHOICE))
def gap_choice(t):
    return rk.gap_choice(candidates(t), "item_id", "pos", "score").withColumn("chosen", F.col("chosen").cast("bigint"))


@plan(
    "r10_decoded_choice",
    oracle(
        f"""SELECT input_id, selects[1 + (chosen % 8) // len(structures)] AS select_text, structures[1 + (chosen % 8) % len(structures)] AS structure
        FROM <<beams>> JOIN ({_CHOICE}) c ON item_id = input_id"""
    ),
)
def decoded_choice(t):
    chosen = rk.gap_choice(candidates(t), "item_id", "pos", "score").select(F.col("item_id").alias("input_id"), (F.col("chosen") % 8).alias("chosen"))
    select_text, structure = rk.decode_choice(F.col("chosen"), F.col("selects"), F.col("structures"))
    return beams(t).join(chosen, "input_id").select("input_id", select_text.alias("select_text"), structure.alias("structure"))


@plan(
    "r11_tried",
    oracle(
        """SELECT item_id, coalesce(min(pos) FILTER (WHERE n_rows > 0), max(pos)) AS stop, count(*) FILTER (WHERE n_rows > 0) > 0 AS found
        FROM <<candidates>> GROUP BY item_id"""
    ),
)
def tried(t):
    return rk.tried(candidates(t), "item_id", "pos", "n_rows").withColumn("stop", F.col("stop").cast("bigint"))


@plan(
    "r12_final_pick",
    oracle(
        """SELECT o_orderkey AS item_id, CASE WHEN n IS NULL THEN 'None' WHEN r0 > 0 OR n = 1 OR r1 IS NULL THEN t0 ELSE t1 END AS pick FROM orders LEFT JOIN
        (SELECT item_id, count(*) AS n, max(text) FILTER (WHERE pos = 0) AS t0, max(text) FILTER (WHERE pos = 1) AS t1, max(n_rows) FILTER (WHERE pos = 0) AS r0,
        max(n_rows) FILTER (WHERE pos = 1) AS r1 FROM <<candidates>> GROUP BY item_id) c ON item_id = o_orderkey"""
    ),
)
def final_pick(t):
    every = t.orders.select(F.col("o_orderkey").alias("item_id")).join(candidates(t), "item_id", "left")
    return rk.final_pick(every, "item_id", "pos", "text", "n_rows")


@plan("r13_first_two", oracle("SELECT input_id, array_to_string(list_slice(table_lists, 1, 2), '|') AS kept FROM <<beams>>"))
def first_two(t):
    return beams(t).select("input_id", F.array_join(F.slice("table_lists", 1, 2), "|").alias("kept"))
