"""Building evaluation sets from the orders, and the readers and writers around them."""

from pyspark.sql import functions as F

from quillcheck.operators import catalog as cat
from quillcheck.operators import datasets as ds
from quillcheck.operators import ranking as rk
from quillcheck.plans.catalog_queries import DATABASES
from quillcheck.plans.registry import plan
from quillcheck.plans.views import oracle, view
from quillcheck.session import scratch_path
from quillcheck.sources import corpus
from quillcheck.streaming import resume

_SALES = DATABASES["sales"]


def select_texts(t):
    return view(t, "select_texts")


def templates(t):
    return view(t, "templates")


def with_ids(t):
    frames = {"sales": {tbl: t.scan(tbl) for tbl in _SALES}}
    # One row per database, as large as its schema; else the orders might be the side that is gathered, each row with a copy of the maps.
    return select_texts(t).join(F.broadcast(ds.column_ids(cat.read_catalog(t.spark, frames))), "db_id")


@plan(
    "d01_tables_mentioned",
    oracle(
        f"""SELECT idx, array_to_string(list_filter({_SALES}, lambda t: list_contains(string_split(lower(regexp_replace(query, ';$', '')), ' '), t)), ' ') AS tables
        FROM <<select_texts>>"""
    ),
)
def tables_mentioned(t):
    known = F.array(*map(F.lit, _SALES))
    return select_texts(t).select("idx", F.array_join(ds.tables_mentioned(F.col("query"), known), " ").alias("tables"))


@plan(
    "d02_three_tasks",
    oracle(
        f"""SELECT idx, unnest([0, 1, 2]) AS task_no, unnest(['structure', 'select', 'table']) AS task, unnest([query, select_text, table_list]) AS target,
        unnest([{", ".join("'" + x.replace("{question}", "' || question || '").replace("{schema}", "' || schema_text || '") + "'" for x in ds.TASK_INPUTS.values())}]) AS input
        FROM (SELECT idx, query, s.select_text, s.table_list, question, 'Database: ' || s.db_id || '. ' || s.table_list AS schema_text
        FROM <<select_texts>> s JOIN <<questions>> q ON q_id = idx) x"""
    ),
)
def three_tasks(t):
    asked = view(t, "questions").select(F.col("q_id").alias("idx"), "question")
    schema = F.concat(F.lit("Database: "), F.col("db_id"), F.lit(". "), F.col("table_list")).alias("schema_text")
    rows = select_texts(t).select("idx", "query", "select_text", "table_list", schema).join(asked, "idx")
    return ds.three_tasks(rows, "query", "select_text", "table_list", "question", "schema_text")


_ENCODED = """CASE WHEN starts_with(select_text, 'select o_orderkey') THEN CASE WHEN contains(table_list, 't5') THEN 'select t5.c0 , max(t5.c3), count(t5.c1)' ELSE select_text END
 WHEN starts_with(select_text, 'select o_totalprice') THEN CASE table_list WHEN 't5' THEN 'select t5.c3, c_name' WHEN 't2 t5' THEN 'select t5.c3, t2.c1' ELSE 'select o_totalprice, t2.c1' END
 ELSE CASE table_list WHEN 't5' THEN 'select customer.c_name , avg( c_acctbal ), t5.c4' WHEN 't2 t5' THEN 'select t2.c1 , avg( t2.c3 ), t5.c4'
  ELSE 'select t2.c1 , avg( t2.c3 ), o_orderdate' END END"""


@plan("d03_encoded_columns", oracle(f"SELECT idx, {_ENCODED} AS encoded FROM <<select_texts>>"))
def encoded_columns(t):
    encoded = ds.encode_columns(F.col("select_text"), F.split("table_list", " "), F.col("by_name"))
    return with_ids(t).select("idx", encoded.alias("encoded"))


@plan(
    "d04_decoded_columns",
    oracle(
        f"""SELECT idx, replace(replace(replace(replace(replace(replace(e, 't5.c0', 'orders.o_orderkey'), 't5.c1', 'orders.o_custkey'), 't5.c3', 'orders.o_totalprice'),
        't5.c4', 'orders.o_orderdate'), 't2.c1', 'customer.c_name'), 't2.c3', 'customer.c_acctbal') AS decoded,
        replace(replace(table_list, 't5', 'orders'), 't2', 'customer') AS tables FROM (SELECT idx, table_list, {_ENCODED} AS e FROM <<select_texts>>) x"""
    ),
)
def decoded_columns(t):
    encoded = with_ids(t).withColumn("e", ds.encode_columns(F.col("select_text"), F.split("table_list", " "), F.col("by_name")))
    decoded, tables = ds.decode_columns(F.col("e"), F.col("by_id")), ds.decode_tables(F.col("table_list"), F.col("by_table"))
    return encoded.select("idx", decoded.alias("decoded"), tables.alias("tables"))


@plan("d05_capped", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def capped(t):
    return ds.capped(t.documents.select("doc_id", "lang", "source"), "doc_id", 100)


@plan(
    "d06_attached",
    oracle("SELECT s.idx, s.query, o_custkey AS align_select FROM <<select_texts>> s JOIN orders ON o_orderkey = s.idx"),
)
def attached(t):
    extra = t.orders.select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("align_select"))
    return ds.attach(select_texts(t).select("idx", "query"), extra, "idx")


@plan(
    "d07_per_sentence",
    oracle(
        "SELECT orig_idx, unnest(range(len(sentences))) AS sentence_no, unnest(sentences) AS sentence FROM <<templates>>"
    ),
)
def per_sentence(t):
    made = ds.per_sentence(templates(t).select("orig_idx", "sentences"), "sentences")
    return made.withColumn("sentence_no", F.col("sentence_no").cast("bigint"))


@plan("d08_test_rows", oracle("SELECT orig_idx, db_id, split FROM <<templates>> WHERE split = 'test' OR db_id IN ('small')"))
def test_rows(t):
    return ds.test_rows(templates(t).select("orig_idx", "db_id", "split"), ["small"])


@plan(
    "d09_patched",
    oracle(
        """SELECT orig_idx, db_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 'SELECT fixed FROM ' || db_id ELSE query END AS query
        FROM <<templates>> JOIN orders ON o_orderkey = orig_idx"""
    ),
)
def patched(t):
    rows = templates(t).select("orig_idx", "db_id", "query")
    urgent = t.orders.filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("orig_idx"))
    fixes = urgent.join(rows, "orig_idx").select("orig_idx", "db_id", F.concat(F.lit("SELECT fixed FROM "), "db_id").alias("query"))
    return ds.patched(rows, fixes, ["orig_idx", "db_id"], "query")


_VARS = "list_sort(list_distinct(list_filter(string_split(translate([[c]], '\"%', ''), ' '), lambda w: regexp_matches(w, '^[a-z_]+[0-9]+$') AND NOT contains(w, 'alias'))))"


def _vars_sql(c: str) -> str:
    return _VARS.replace("[[c]]", c)


@plan(
    "d10_variables",
    oracle(f"SELECT orig_idx, array_to_string({_vars_sql('query')}, ',') AS in_query, array_to_string({_vars_sql('sentences[1]')}, ',') AS in_text FROM <<templates>>"),
)
def variables(t):
    names = lambda c: F.array_join(F.array_sort(ds.variables(c)), ",")
    return templates(t).select(
        "orig_idx", names(F.col("query")).alias("in_query"), names(F.get("sentences", F.lit(0))).alias("in_text")
    )


def sentence_rows(t):
    one = templates(t).withColumn(
        "examples",
        F.array(
            F.struct(F.lit("status_name0").alias("name"), F.col("status_example").alias("example")),
            F.struct(F.lit("price0").alias("name"), F.col("price_example").alias("example")),
        ),
    )
    return ds.per_sentence(one.select("orig_idx", "query", "examples", "sentences"), "sentences")


@plan(
    "d11_problems",
    oracle(
        """SELECT t.orig_idx, s.n AS sentence_no, contains(t.query, 'unknown7') OR contains(t.query, '" status_name0 "') AS problem
        FROM <<templates>> t, (SELECT unnest([0, 1]) AS n) s"""
    ),
)
def problems(t):
    known = F.transform("examples", lambda e: e["name"])
    return sentence_rows(t).select(
        "orig_idx", "sentence_no", ds.problems(F.col("sentence"), F.col("query"), known).alias("problem")
    )


@plan(
    "d12_filled",
    oracle(
        """SELECT orig_idx, n AS sentence_no, replace(replace(replace(sentences[n + 1], '" status_name0 "', 'status_name0'), 'status_name0', status_example), 'price0', price_example) AS text,
        replace(replace(query, 'status_name0', status_example), 'price0', price_example) AS query FROM (SELECT *, unnest([0, 1]) AS n FROM <<templates>>) x"""
    ),
)
def filled(t):
    return sentence_rows(t).select(
        "orig_idx",
        "sentence_no",
        ds.fill(ds.without_inner_blanks(F.col("sentence")), F.col("examples")).alias("text"),
        ds.fill(F.col("query"), F.col("examples")).alias("query"),
    )


@plan(
    "d13_mixed_groups",
    oracle(
        """SELECT item_id, pos, label FROM <<candidates>> WHERE item_id IN (SELECT item_id FROM <<candidates>> GROUP BY item_id
        HAVING min(label) = 0 AND max(label) = 1)"""
    ),
)
def mixed_groups(t):
    rows = view(t, "candidates").select("item_id", F.col("pos").cast("bigint").alias("pos"), "label")
    return rk.mixed_groups(rows, "item_id", "label")


@plan(
    "d14_negative_samples",
    oracle(
        """WITH drawn AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY md5('1:' || pos), pos) AS r FROM <<candidates>> WHERE label = 0),
        wrong AS (SELECT item_id, pos FROM drawn WHERE r <= 3), good AS (SELECT item_id, pos AS positive FROM <<candidates>> WHERE label = 1)
        SELECT item_id, positive, pos, 0 AS label FROM good JOIN wrong USING (item_id)
        UNION ALL SELECT item_id, positive, positive, 1 FROM good WHERE item_id IN (SELECT item_id FROM wrong)"""
    ),
)
def negative_samples(t):
    rows = view(t, "candidates").select("item_id", "pos", "label")
    return rk.with_negatives(rows, "item_id", "pos", "label").withColumnRenamed("item", "pos")


@plan(
    "d15_remaining",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def remaining(t):
    done = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ds.remaining(t.orders.select("o_orderkey", "o_totalprice"), done, "o_orderkey")


@plan("d15_resumed_stream", "SELECT event_id, event_type, value * 2 AS doubled FROM events")
def resumed_stream(t):
    # The events arrive in two drops; the second run takes up only the new one.
    work = scratch_path(t.spark, "stream")
    drop = t.events.select("event_id", "event_type", "value")
    step = lambda df: df.select("event_id", "event_type", (F.col("value") * 2).alias("doubled"))
    for part in ("event_type = 'click'", "event_type <> 'click' OR event_type IS NULL"):
        drop.filter(part).write.mode("append").parquet(f"{work}/in")
        out = resume.process_new(t.spark, f"{work}/in", drop.schema, f"{work}/out", f"{work}/checkpoint", step)
    return out


# ---- readers and writers ---------------------------------------------------------------


@plan("s01_scan", "SELECT * FROM supplier")
def scan(t):
    return t.scan("supplier")


def _corpus(t):
    return select_texts(t).select(F.col("db_id"), F.concat(F.lit("question "), F.col("idx").cast("string")).alias("question"), "query")


@plan("s02_json_corpus", oracle("SELECT db_id, 'question ' || idx AS question, query FROM <<select_texts>>"))
def json_corpus(t):
    path = scratch_path(t.spark, "corpus")
    corpus.write_array(_corpus(t), path)
    return corpus.read_corpus(t.spark, path)


@plan(
    "s03_gold_lines",
    oracle(
        """SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, nullif(string_split(trim(line, ' ' || chr(9)), chr(9))[1], '') AS query,
        nullif(string_split(trim(line, ' ' || chr(9)), chr(9))[2], '') AS db_id FROM <<session_lines>>"""
    ),
)
def gold_lines(t):
    path = scratch_path(t.spark, "gold")
    view(t, "session_lines").orderBy("line_no").select("line").write.text(path)
    return corpus.gold_lines(corpus.read_lines(t.spark, path))


@plan(
    "s04_sessions",
    oracle(
        """SELECT line_no, line, session_id AS session_no, turn_idx FROM (SELECT line_no, line, line_no // 1000000000 AS conv_id, line_no % 1000000000 AS turn_idx
        FROM <<session_lines>> WHERE trim(line) <> '') l JOIN (SELECT session_id AS conv_id, row_number() OVER (ORDER BY session_id) - 1 AS session_id
        FROM (SELECT DISTINCT session_id FROM <<turns>>) x) s USING (conv_id)"""
    ),
)
def sessions(t):
    return corpus.sessions(view(t, "session_lines"))


@plan("s05_predicted_lines", oracle("SELECT row_number() OVER (ORDER BY idx) - 1 AS line_no, trim(query) AS query FROM <<select_texts>>"))
def predicted_lines(t):
    path = scratch_path(t.spark, "predict")
    padded = F.concat(F.lit("  "), "query", F.lit(" "))
    select_texts(t).select("idx", padded.alias("line")).orderBy("idx").select("line").write.text(path)
    return corpus.predicted_lines(corpus.read_lines(t.spark, path))


# name prefix, data, databases, output
RULES = [
    ("web", "data/{name}/test.json", "data/{name}/databases", "data/{name}/prediction.json"),
    ("DB", "data/perturbed/{name}/questions.json", "data/perturbed/{name}/database_post", "data/perturbed/{name}/prediction.json"),
    ("NLQ", "data/perturbed/{name}/questions.json", "data/perturbed/{name}/databases", "data/perturbed/{name}/prediction.json"),
    ("SQL", "data/perturbed/{name}/questions.json", "data/perturbed/{name}/databases", "data/perturbed/{name}/prediction.json"),
]
_NAME = "concat(CASE lang WHEN 'en' THEN 'DB_' WHEN 'fr' THEN 'NLQ_' WHEN 'de' THEN 'SQL_' ELSE 'web' END, source)"


@plan(
    "s06_registry",
    f"""SELECT doc_id, name, 'data/' || CASE WHEN starts_with(name, 'web') THEN '' ELSE 'perturbed/' END || name || CASE WHEN starts_with(name, 'web')
    THEN '/test.json' ELSE '/questions.json' END AS data_path, 'data/' || CASE WHEN starts_with(name, 'web') THEN '' ELSE 'perturbed/' END || name ||
    CASE WHEN starts_with(name, 'DB') THEN '/database_post' ELSE '/databases' END AS db_path, 'data/' || CASE WHEN starts_with(name, 'web') THEN '' ELSE 'perturbed/' END
    || name || '/prediction.json' AS output_path FROM (SELECT doc_id, {_NAME} AS name FROM documents) d""",
)
def registry(t):
    names = t.documents.select("doc_id", F.expr(f"{_NAME} AS name"))
    return corpus.registry(names, "name", RULES)


_SPLIT = "CASE WHEN lang = 'en' THEN 'validation' WHEN lang = 'fr' THEN 'DB_schema_synonym' WHEN lang = 'de' THEN 'NLQ_others' ELSE 'train' END"


@plan(
    "s07_splits",
    f"""SELECT doc_id, source, split FROM (SELECT doc_id, source, {_SPLIT} AS split FROM documents) d WHERE split IN ('validation', 'NLQ_others')""",
)
def splits(t):
    path = scratch_path(t.spark, "splits")
    t.documents.select("doc_id", "source", F.expr(f"{_SPLIT} AS split")).write.partitionBy("split").parquet(path)
    plain = corpus.read_split(t.spark, path, "other set")
    return plain.unionByName(corpus.read_split(t.spark, path, "NLQ_others")).select("doc_id", "source", "split")


@plan("s08_json_sink", "SELECT doc_id, lang, text FROM documents")
def json_sink(t):
    path = scratch_path(t.spark, "json")
    corpus.write_json(t.documents.select("doc_id", "lang", "text"), path)
    return t.spark.read.schema("doc_id bigint, lang string, text string").json(path)


@plan(
    "s09_aligned_text",
    oracle(
        """SELECT row_number() OVER (ORDER BY idx) - 1 AS line_no, query AS gold, replace(select_text, '''', '"') || idx AS pred FROM <<select_texts>>"""
    ),
)
def aligned_text(t):
    path = scratch_path(t.spark, "aligned")
    picks = select_texts(t).select("idx", "query", "db_id", F.concat("select_text", F.col("idx").cast("string")).alias("pick"))
    corpus.write_aligned(picks, "idx", "query", "pick", "db_id", path)
    gold = corpus.gold_lines(corpus.read_lines(t.spark, f"{path}/gold")).select("line_no", F.col("query").alias("gold"))
    return gold.join(corpus.read_lines(t.spark, f"{path}/predict").withColumnRenamed("line", "pred"), "line_no")


@plan("s10_verdict_store", "SELECT o_orderstatus AS db_id, o_custkey AS gold, o_orderkey AS pred, o_totalprice > 250000 AS verdict FROM orders")
def verdict_store(t):
    path = scratch_path(t.spark, "verdicts")
    verdicts = t.orders.select(
        F.col("o_orderstatus").alias("db_id"), F.col("o_custkey").alias("gold"), F.col("o_orderkey").alias("pred"),
        (F.col("o_totalprice") > 250000).alias("verdict"),
    )
    keys = ["db_id", "gold", "pred"]
    corpus.append_verdicts(verdicts.filter("db_id = 'F'"), path)
    # Only pairs that the store does not know are appended.
    corpus.append_verdicts(verdicts.join(corpus.read_verdicts(t.spark, path).select(keys), keys, "left_anti"), path)
    return corpus.read_verdicts(t.spark, path)
