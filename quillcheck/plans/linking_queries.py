"""Which indexed values the questions mention, and the schema text built from them."""

from pyspark.sql import functions as F

from quillcheck.functions.wordlists import STOP_WORDS
from quillcheck.operators import catalog as cat
from quillcheck.operators import linking as ln
from quillcheck.operators import serialize as ser
from quillcheck.operators import values as vals
from quillcheck.operators.skew import salted_join
from quillcheck.plans.catalog_queries import DATABASES, DECLARED, FK_SCHEMA, FOREIGN_KEYS
from quillcheck.plans.registry import plan
from quillcheck.plans.value_queries import searchable
from quillcheck.plans.views import VIEWS, PARTS, oracle, view
from quillcheck.session import once, settled


def _sql_text(s: str) -> str:
    return s.replace("'", "''")


def _parts() -> None:
    columns = {line.split()[0]: [c.split(":")[0] for c in line.split()[1:]] for line in DECLARED.strip().splitlines()}
    order = DATABASES["sales"]
    PARTS["stop"] = _sql_text(" ".join(STOP_WORDS))
    PARTS["columns"] = ", ".join(
        f"({i}, '{t}', {p}, '{c}')" for i, t in enumerate(order) for p, c in enumerate(columns[t])
    )
    PARTS["keys"] = ", ".join(
        f"('{t}', {columns[t].index(c)}, {order.index(rt)}, {columns[rt].index(rc)}, '{c}', '{rt}', '{rc}')"
        for db, t, c, rt, rc in FOREIGN_KEYS
        if db == "sales"
    )


_parts()


def questions(t):
    return view(t, "questions")


def index(t):
    """All values of all columns, written once."""
    return searchable(t).entries.select("tbl", "col", "value")


def keys(t):
    """The values' index by grams; each part is written once per session and state of the tables."""
    distinct = once(t.spark, t.root, "keys", lambda: ln.keys_of(index(t)))
    return ln.key_index(distinct, write=lambda label, make: once(t.spark, t.root, f"keys-{label}", make))


def question_spans(t):
    return ln.spans(questions(t), "question", ln.Sieve.of(keys(t)))


def pairs(t):
    return ln.scored_pairs(question_spans(t), keys(t))


@plan("l01_longest_run", oracle("SELECT span, key, run_at, run_size FROM <<usable_pairs>>"))
def longest_run(t):
    return pairs(t).select("span", "key", F.col("run_at").cast("bigint"), F.col("run_size").cast("bigint"))


@plan(
    "l02_word_spans",
    oracle(VIEWS["question_spans"].replace(" AND length(span) <= 60", "")),
)
def word_spans(t):
    texts = questions(t).select("question").distinct()
    return ln.of_text(texts, "question", ln.spans(texts, "question"))


@plan(
    "l03_head_gate",
    oracle(
        """SELECT doc_id, left(regexp_replace(text, '^[''"()`,.?! ]+', ''), 1) AS head, lower(left(regexp_replace(text, '^[''"()`,.?! ]+', ''), 1)) = left(lang, 1) AS same
        FROM documents"""
    ),
)
def head_gate(t):
    head = ln.head(F.col("text"))
    return t.documents.select("doc_id", head.alias("head"), (F.lower(head) == ln.head(F.col("lang"))).alias("same"))


@plan("l04_ratio", oracle("SELECT span, key, round(score, 6) AS score FROM <<span_pairs>>"))
def ratio(t):
    return ln.close_pairs(question_spans(t).select("span").distinct(), keys(t)).withColumn("score", F.round("score", 6))


@plan(
    "l05_possessive",
    oracle(
        """SELECT q_id, regexp_extract(lower(question), '([^''"()`,.?! ]+)''s ', 1) AS owner FROM <<questions>>"""
    ),
)
def possessive(t):
    return questions(t).select("q_id", ln.owner(F.col("question")).alias("owner"))


@plan(
    "l06_word_filters",
    oracle(
        """SELECT s.span, s.key, u.span IS NOT NULL AS usable FROM <<span_pairs>> s
        LEFT JOIN <<usable_pairs>> u ON u.span = s.span AND u.key = s.key"""
    ),
)
def word_filters(t):
    run = ln.longest_run(F.col("key"), F.col("span"))
    close = ln.close_pairs(question_spans(t).select("span").distinct(), keys(t)).withColumn("r", run)
    text = F.trim(F.substr("key", F.col("r.at") + 1, F.col("r.size")))
    return close.select("span", "key", ln.usable(text, F.col("span"), F.col("key"), F.col("score")).alias("usable"))


@plan(
    "l07_all_upper",
    oracle(
        """SELECT p.span, v.tbl, v.col, v.value, score >= 1 OR NOT (upper(value) = value AND lower(value) <> value) AS kept
        FROM <<usable_pairs>> p JOIN <<value_index>> v ON lower(trim(v.value)) = p.key"""
    ),
)
def all_upper(t):
    values = index(t)
    named = values.select("tbl", "col", "value", F.lower(F.trim("value")).alias("key"))
    kept = (F.col("score") >= 1) | ~ln.all_upper(F.col("value"))
    return pairs(t).join(named, "key").select("span", "tbl", "col", "value", kept.alias("kept"))


def mentioned(t):
    return ln.mentions(questions(t), "question", index(t), keys=keys(t))


@plan(
    "l08_mentions",
    oracle("SELECT question, tbl, col, value, round(score, 6) AS score, run_size FROM <<mentions>>"),
)
def mentions(t):
    return mentioned(t).withColumn("score", F.round("score", 6)).withColumn("run_size", F.col("run_size").cast("bigint"))


@plan("l09_top_mentions", oracle("SELECT question, tbl, col, place, value FROM <<top_mentions>>"))
def top_mentions(t):
    top = ln.top_mentions(mentioned(t), "question")
    return top.select("question", "tbl", "col", F.col("place").cast("bigint").alias("place"), "value")


@plan("l10_always_shown", oracle("SELECT tbl, col, array_to_string(vals, '|') AS vals FROM <<always_shown>>"))
def always_shown(t):
    return ln.always_shown(index(t)).select("tbl", "col", F.array_join("values", "|").alias("vals"))


@plan(
    "l11_quoted_values",
    oracle(
        "SELECT question, tbl, col, array_to_string(list_transform(vals, lambda v: '\"' || v || '\"'), ', ') AS vals FROM <<linked>>"
    ),
)
def quoted_values(t):
    linked = ln.linked_values(questions(t), "question", index(t), keys(t))
    return linked.select("question", "tbl", "col", F.array_join(ln.quoted(F.col("values")), ", ").alias("vals"))


@plan(
    "l12_linked_questions",
    oracle(
        "SELECT q_id, tbl, col, array_to_string(vals, '|') AS vals FROM <<questions>> JOIN <<linked>> USING (question)"
    ),
)
def linked_questions(t):
    linked = ln.linked_values(questions(t), "question", index(t), keys(t))
    return salted_join(questions(t).select("q_id", "question"), linked, ["question"]).select("q_id", "tbl", "col", F.array_join("values", "|").alias("vals"))


def sales_schema(t, values, fallback: bool = True):
    frames = {"sales": {tbl: t.scan(tbl) for tbl in DATABASES["sales"]}}
    shown = ln.always_shown(values)
    if not fallback:
        shown = shown.filter(F.lit(False))
    edges = t.spark.createDataFrame([e for e in FOREIGN_KEYS if e[0] == "sales"], FK_SCHEMA)
    return ser.schema_rows(cat.read_catalog(t.spark, frames), edges, shown)


def with_schema(t, fallback: bool = True):
    """The schema and the linked values of each distinct question; texts are made for these and joined to the rows."""
    values = index(t)
    distinct = questions(t).select("question", "db_id").distinct()
    linked = ln.linked_values(distinct, "question", values, keys(t))
    return ser.with_schema(distinct, linked, "question", sales_schema(t, values, fallback))


@plan(
    "p01_table_text",
    oracle("SELECT q_id, tbl, plain AS table_text FROM <<questions>> JOIN <<table_texts>> USING (question)"),
)
def table_text(t):
    texts = ser.named_tables(with_schema(t), with_keys=False).select("question", "tbl", "table_text")
    return salted_join(questions(t).select("q_id", "question"), texts, ["question"]).select("q_id", "tbl", "table_text")


@plan(
    "p02_table_text_with_keys",
    oracle("SELECT q_id, tbl, table_text FROM <<questions>> JOIN <<keyed_texts>> USING (question)"),
)
def table_text_with_keys(t):
    texts = ser.named_tables(with_schema(t), with_keys=True).select("question", "tbl", "table_text")
    return salted_join(questions(t).select("q_id", "question"), texts, ["question"]).select("q_id", "tbl", "table_text")


@plan(
    "p03_positional_schema",
    oracle(
        """WITH t AS (SELECT question, table_id, tbl, 't' || table_id || ': ' || lower(tbl) || '(' || string_agg('c' || pos || ': ' || lower(col) ||
          CASE WHEN vals IS NULL THEN '' ELSE ' (' || array_to_string(vals, ', ') || ')' END, ', ' ORDER BY pos) || ')' AS plain
          FROM (SELECT q.question, c.*, l.vals FROM (SELECT DISTINCT question FROM <<questions>>) q CROSS JOIN <<sales_columns>> c
          LEFT JOIN <<linked>> l ON l.question = q.question AND l.tbl = c.tbl AND l.col = c.col) x GROUP BY question, table_id, tbl),
        k AS (SELECT tbl, string_agg('(c' || c1 || ') refers to t' || t2 || '(c' || c2 || ')', ', ' ORDER BY c1) AS fk FROM <<sales_keys>> GROUP BY tbl),
        s AS (SELECT question, 'Database: sales. ' || string_agg(plain || coalesce(' ' || fk, ''), '. ' ORDER BY table_id) AS schema_text
          FROM t LEFT JOIN k USING (tbl) GROUP BY question)
        SELECT q_id, schema_text FROM <<questions>> JOIN s USING (question)"""
    ),
)
def positional_schema(t):
    rows = with_schema(t, fallback=False)
    texts = rows.select("question", ser.positional_schema(rows).alias("schema_text"))
    return salted_join(questions(t).select("q_id", "question"), texts, ["question"]).select("q_id", "schema_text")


def _request_sql() -> str:
    note, functions = _sql_text(ser.NOTE), _sql_text(ser.FUNCTION_HINT)
    return (
        """SELECT q_id, list_at, '### The database contains the following tables:' || chr(10) || '# ' || shown || chr(10) || '"""
        + note
        + """' || 'Question: ' || question || chr(10) || 'Requirement: The SQL query must be in this format: ' || lower(structure) || '.' || chr(10)
        || 'Requirement: The SQL query must consist of these tables: ' || replace(table_list, ' ', ', ') || '.' || chr(10) || '"""
        + functions
        + """' || 'Translate the question into a SQL query that starts with "' || select_text || ' from". Only show the SQL query.' || chr(10) AS request
        FROM (SELECT q.q_id, q.list_at, q.question, q.structure, q.table_list, q.select_text, string_agg(k.table_text, chr(10) || '# ' ORDER BY table_id) AS shown
        FROM (SELECT q_id, question, structure, select_text, unnest([table_list, 'customer orders', '']) AS table_list, unnest([0, 1, 2]) AS list_at FROM <<questions>>) q JOIN <<keyed_texts>> k ON k.question = q.question AND list_contains(string_split(q.table_list, ' '), k.tbl) GROUP BY ALL) x"""
    )


@plan("p04_request_text", oracle(_request_sql()))
def request_text(t):
    rows = questions(t).select("q_id", "question", "structure", "select_text", F.array("table_list", F.lit("customer orders"), F.lit("")).alias("lists"))
    made = ser.request_text(salted_join(rows, ser.table_texts(with_schema(t), "question"), ["question"]), "lists", "structure", "select_text", "question")
    return made.select("q_id", "list_at", "request")


def wide_index(t):
    """The values of the sales tables and of some columns of the documents and events."""
    more = vals.value_index({"documents": t.documents, "events": t.events}, {"documents": ["lang", "source"], "events": ["event_type"]})
    return index(t).unionByName(more)


@plan("l13_linked_documents")
def linked_documents(t):
    """Whole documents against the full index; a brute-force test stands in for SQL, which would pair all runs with all values."""
    write = lambda label, make: once(t.spark, t.root, f"wide-{label}", make)
    grams = ln.key_index(write("keys", lambda: ln.mentionable(ln.keys_of(wide_index(t)))), write=write)
    linked = ln.named_linked_values(t.documents.select("text"), "text", wide_index(t), grams)
    named = settled(t.documents.select("doc_id", ln.digest(F.col("text"))), "digests")
    return salted_join(named, linked, ["of"]).select("doc_id", "tbl", "col", F.array_join("values", "|").alias("vals"))
