"""Accuracy reports over the turns of the conversations and the scored clause tables."""

from pyspark.sql import functions as F

from quillcheck.operators import clauses as cl
from quillcheck.operators import metrics as mt
from quillcheck.plans.clause_queries import links, scored, units
from quillcheck.plans.registry import plan
from quillcheck.plans.views import oracle, view


def turns(t):
    return view(t, "turns")


def gold(t):
    return turns(t).select("session_id", "turn_idx", F.col("level").alias("gold"))


def pred(t):
    return turns(t).filter("role = 'user' OR exec_ok = 1").select("session_id", "turn_idx", F.col("role").alias("pred"))


@plan(
    "m01_paired_turns",
    oracle("SELECT session_id, turn_idx, level AS gold, role AS pred FROM <<turns>> WHERE role = 'user' OR exec_ok = 1"),
)
def paired_turns(t):
    return mt.pair_turns(gold(t), pred(t))


@plan(
    "m01_session_sizes",
    oracle(
        """SELECT session_id, count(*) AS n_gold, count(*) FILTER (WHERE role = 'user' OR exec_ok = 1) AS n_pred,
        count(*) = count(*) FILTER (WHERE role = 'user' OR exec_ok = 1) AS agree FROM <<turns>> GROUP BY session_id"""
    ),
)
def session_sizes(t):
    return mt.session_sizes(gold(t), pred(t))


def _level_sql(ok: str, source: str = "<<turns>>") -> str:
    return oracle(f"""SELECT level, count(*) AS n, round(avg({ok}), 6) AS rate FROM {source} GROUP BY level
    UNION ALL SELECT 'all', count(*), round(avg({ok}), 6) FROM {source}""")


@plan("m02_execution_by_level", _level_sql("exec_ok"))
def execution_by_level(t):
    return mt.by_level(turns(t), "exec_ok").withColumn("rate", F.round("rate", 6))


@plan("m03_exact_by_level", _level_sql("exact_ok"))
def exact_by_level(t):
    return mt.by_level(turns(t), "exact_ok").withColumn("rate", F.round("rate", 6))


@plan(
    "m03_exact_of_queries",
    oracle(
        """WITH s AS (SELECT e.query_id, CAST(exact AS INT) AS ok, hardness AS level FROM <<exact_all>> e JOIN <<levels>> l
          ON l.query_id = e.query_id AND l.role = 'gold')
        SELECT level, count(*) AS n, round(avg(ok), 6) AS rate FROM s GROUP BY level UNION ALL SELECT 'all', count(*), round(avg(ok), 6) FROM s"""
    ),
)
def exact_of_queries(t):
    levels = cl.difficulty(units(t), links(t)).filter("role = 'gold'").select("query_id", F.col("hardness").alias("level"))
    verdicts = scored(t).select("query_id", F.col("exact").cast("int").alias("ok"))
    # Two columns of a file of many look small enough to be gathered, with a row per query
    return mt.by_level(verdicts.join(levels.hint("merge"), "query_id"), "ok").withColumn("rate", F.round("rate", 6))


@plan(
    "m04_by_turn",
    oracle(
        """SELECT CASE WHEN turn_idx > 3 THEN 'turn > 4' ELSE 'turn ' || (turn_idx + 1) END AS turn, count(*) AS n,
        round(avg(exec_ok), 6) AS exec_ok, round(avg(exact_ok), 6) AS exact_ok FROM <<turns>> GROUP BY 1"""
    ),
)
def by_turn(t):
    found = mt.by_turn(turns(t), ["exec_ok", "exact_ok"])
    return found.withColumn("exec_ok", F.round("exec_ok", 6)).withColumn("exact_ok", F.round("exact_ok", 6))


@plan(
    "m05_joint",
    oracle(
        """SELECT count(*) AS n, round(avg(exec_ok), 6) AS exec_ok, round(avg(exact_ok), 6) AS exact_ok FROM
        (SELECT min(exec_ok) AS exec_ok, min(exact_ok) AS exact_ok FROM <<turns>> GROUP BY session_id) s"""
    ),
)
def joint(t):
    found = mt.joint(turns(t), ["exec_ok", "exact_ok"])
    return found.withColumn("exec_ok", F.round("exec_ok", 6)).withColumn("exact_ok", F.round("exact_ok", 6))


_RATES = """SELECT component, level, coalesce(avg(hit) FILTER (WHERE pred_total > 0), 0) AS acc, coalesce(avg(hit) FILTER (WHERE label_total > 0), 0) AS rec
 FROM (SELECT p.*, unnest([hardness, 'all']) AS level FROM <<partial_rows>> p JOIN <<levels>> l ON l.query_id = p.query_id AND l.role = 'gold') x GROUP BY component, level"""


def partial_rates(t):
    levels = cl.difficulty(units(t), links(t)).filter("role = 'gold'").select("query_id", F.col("hardness").alias("level"))
    return mt.rates_of(cl.partial_totals(scored(t).join(levels.hint("merge"), "query_id"), "level"))


@plan("m06_partial_rates", oracle(f"SELECT component, level, round(acc, 6) AS acc, round(rec, 6) AS rec FROM ({_RATES}) r"))
def partial(t):
    return partial_rates(t).select("component", "level", F.round("acc", 6).alias("acc"), F.round("rec", 6).alias("rec"))


@plan(
    "m07_f1",
    oracle(f"SELECT component, level, round(CASE WHEN acc = 0 AND rec = 0 THEN 1.0 ELSE 2 * acc * rec / (acc + rec) END, 6) AS f1 FROM ({_RATES}) r"),
)
def f1(t):
    return partial_rates(t).select("component", "level", F.round(mt.f1(F.col("acc"), F.col("rec")), 6).alias("f1"))


_LEVEL_COLUMNS = ", ".join(f"round(max(value) FILTER (WHERE level = '{v}'), 6) AS {v}" for v in mt.LEVELS)


@plan(
    "m08_report",
    oracle(
        f"""SELECT measure, {_LEVEL_COLUMNS} FROM (SELECT level, unnest(['count', 'exec_ok', 'exact_ok']) AS measure,
        unnest([CAST(n AS DOUBLE), exec_ok, exact_ok]) AS value FROM (
        SELECT level, count(*) AS n, avg(exec_ok) AS exec_ok, avg(exact_ok) AS exact_ok FROM <<turns>> GROUP BY level
        UNION ALL SELECT 'all', count(*), avg(exec_ok), avg(exact_ok) FROM <<turns>>
        UNION ALL SELECT 'joint_all', count(*), avg(a), avg(b) FROM (SELECT min(exec_ok) AS a, min(exact_ok) AS b FROM <<turns>> GROUP BY session_id) j) l) m
        GROUP BY measure"""
    ),
)
def report(t):
    made = mt.report(mt.level_measures(turns(t), ["exec_ok", "exact_ok"]))
    return made.select("measure", *[F.round(v, 6).alias(v) for v in mt.LEVELS])


@plan("m09_wrong_items", oracle("SELECT session_id, turn_idx FROM <<turns>> WHERE exec_ok = 0"))
def wrong_items(t):
    return mt.wrong_items(turns(t), "exec_ok")


@plan(
    "m10_by_database",
    """SELECT o_orderstatus AS db_id, count(*) AS n, round(avg(CAST(o_totalprice > 250000 AS INT)), 6) AS rate FROM orders GROUP BY ROLLUP (o_orderstatus)""",
)
def by_database(t):
    verdicts = t.orders.select(F.col("o_orderstatus").alias("db_id"), (F.col("o_totalprice") > 250000).cast("int").alias("ok"))
    return mt.by_database(verdicts, "ok").withColumn("rate", F.round("rate", 6))


@plan(
    "m11_string_match",
    oracle("SELECT count(*) AS n, round(avg(CAST(lower(literal) = lower(p_name) AS INT)), 6) AS exact_match FROM <<probes>> JOIN part ON probe_id = p_partkey"),
)
def string_match(t):
    rows = view(t, "probes").join(t.part, F.col("probe_id") == F.col("p_partkey"))
    return rows.agg(
        F.count("*").alias("n"), F.round(mt.rate(mt.same_text(F.col("literal"), F.col("p_name"))), 6).alias("exact_match")
    )


@plan(
    "m12_rank_accuracy",
    oracle(
        """SELECT count(*) AS n, round(avg(first_label), 6) AS before_rank, round(avg(label), 6) AS after_rank FROM (
        SELECT item_id, max(label) FILTER (WHERE pos = 0) AS first_label, max(label) FILTER (WHERE pos = chosen) AS label FROM <<candidates>> JOIN
        (SELECT item_id, CASE WHEN max(score) - max(score) FILTER (WHERE pos = 0) >= 0.2 THEN arg_min(pos, [-score, pos]) ELSE 0 END AS chosen
         FROM <<candidates>> GROUP BY item_id) c USING (item_id) GROUP BY item_id) x"""
    ),
)
def rank_accuracy(t):
    from quillcheck.operators import ranking as rk

    rows = view(t, "candidates")
    chosen = rk.gap_choice(rows, "item_id", "pos", "score").select("item_id", "chosen")
    both = rows.join(chosen, "item_id")
    return both.agg(
        F.count_if(F.col("pos") == 0).alias("n"),
        F.round(F.avg(F.when(F.col("pos") == 0, F.col("label"))), 6).alias("before_rank"),
        F.round(F.avg(F.when(F.col("pos") == F.col("chosen"), F.col("label"))), 6).alias("after_rank"),
    )


@plan(
    "m13_duplicates",
    """SELECT n_rows, n_distinct, n_rows - n_distinct AS n_duplicates FROM (SELECT count(*) AS n_rows FROM documents) a,
    (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT text, lang FROM documents) d) b""",
)
def duplicates(t):
    return mt.duplicate_count(t.documents, ["text", "lang"])


@plan(
    "m14_running_mean",
    """SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18, 4)) * (user_id + 1)) OVER w AS DOUBLE) / sum(user_id + 1) OVER w, 6) AS mean
    FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_mean(t):
    found = mt.running_mean(t.events, "event_id", F.col("value").cast("decimal(18,4)"), (F.col("user_id") + 1).cast("decimal(18,0)"))
    return found.select("event_id", F.round("mean", 6).alias("mean"))


@plan("m15_mean_cost", "SELECT CAST(sum(n_chars) AS BIGINT) AS total, count(*) AS items, round(sum(n_chars) / count(*), 6) AS mean_cost FROM documents")
def mean_cost(t):
    return mt.mean_cost(t.documents, "n_chars").withColumn("mean_cost", F.round("mean_cost", 6))


@plan(
    "m16_scored_turns",
    _level_sql("exact_ok", "(SELECT * FROM <<turns>> WHERE turn_idx >= 1)"),
)
def scored_turns(t):
    shifted = turns(t).withColumn("turn_idx", F.col("turn_idx") - 1)
    return mt.by_level(mt.scored_turns(shifted), "exact_ok").withColumn("rate", F.round("rate", 6))
