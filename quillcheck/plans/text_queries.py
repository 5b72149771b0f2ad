"""Text clean-up over a column of SQL texts, one per order."""

from pyspark.sql import functions as F

from quillcheck.functions import text as tx
from quillcheck.plans.registry import plan
from quillcheck.plans.views import PARTS, oracle, view

_SQ, _DQ = "''", '"'
_QUOTED = "''[^'']*''|\"[^\"]*\""
_TOKENS = (
    "list_filter(regexp_split_to_array(regexp_replace(sql_text, '" + _QUOTED + "', 'VALUERARE', 'g'), '\\s+'),"
    " lambda x: x <> '')"
)
_NUMBER = "regexp_matches(x, '^[(<>=!,+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)$')"
_MASKED = (
    "string_split(array_to_string(list_transform(" + _TOKENS + ", lambda x: CASE WHEN " + _NUMBER
    + " THEN 'valuerare' WHEN regexp_matches(x, '[Tt][0-9]+\\.') THEN lower(replace(x, '.', ' . ')) ELSE lower(x) END), ' '), ' ')"
)
_LITERALS = (
    "list_sort(list_distinct(list_concat(regexp_extract_all(sql_text, '" + _QUOTED + "'), list_filter("
    + _TOKENS + ", lambda x: " + _NUMBER + "))))"
)
_UNQUOTE = "replace(replace(replace(regexp_replace(regexp_replace([[v]], '^[`''\"]', ''), '[`''\"]$', ''), '``', '`'), '''''', ''''), '\"\"', '\"')"


def texts(t):
    """The SQL texts."""
    return view(t, "sql_text")


def _column_query(name: str, make, sql: str):
    """A query that applies one text function to every SQL text."""

    @plan(name, oracle(f"SELECT query_id, {sql} AS result FROM <<sql_text>>"))
    def build(t):
        return texts(t).select("query_id", make(F.col("sql_text")).alias("result"))

    return build


_column_query(
    "t01_one_line", tx.one_line,
    "replace(regexp_replace(translate(sql_text, chr(13) || chr(10), '  '), ' +', ' ', 'g'), '<>', '!=')",
)
_column_query(
    "t02_sql_in_reply", lambda c: tx.sql_in_reply(tx.one_line(c)),
    """(SELECT CASE WHEN lower(s[1:6]) = 'select' THEN s WHEN contains(s, '```') THEN string_split(s, '```')[2]
    WHEN contains(s, 'SELECT') THEN substring(s, strpos(s, 'SELECT')) WHEN contains(s, 'select')
    THEN substring(s, strpos(s, 'select')) ELSE s END FROM (SELECT replace(regexp_replace(
    translate(sql_text, chr(13) || chr(10), '  '), ' +', ' ', 'g'), '<>', '!=') AS s) w)""",
)
_column_query(
    "t03_lower_outside_quotes", tx.lower_outside_quotes,
    """(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE
    WHEN regexp_matches(coalesce(CASE WHEN i > 1 THEN p[i - 1] END, ''), '[''"]$')
      OR regexp_matches(coalesce(p[i + 1], ''), '^[''"]') THEN p[i] ELSE lower(p[i]) END), '')
    FROM (SELECT regexp_extract_all(sql_text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS p) w)""",
)
_column_query(
    "t04_squeeze", tx.squeeze,
    "replace(trim(regexp_replace(sql_text, '\\s+', ' ', 'g')), ' , ', ', ')",
)
_column_query(
    "t05_join_operators", tx.join_operators,
    "replace(replace(replace(sql_text, '> =', '>='), '< =', '<='), '! =', '!=')",
)
_column_query(
    "t06_drop_last_semicolon", tx.drop_last_semicolon,
    "CASE WHEN ends_with(sql_text, ';') THEN left(sql_text, length(sql_text) - 1) ELSE sql_text END",
)
_column_query(
    "t07_drop_distinct", tx.drop_distinct,
    "array_to_string(list_transform(regexp_extract_all(sql_text, '" + _QUOTED + "|[^''\"]+|[''\"]'), lambda p: "
    "CASE WHEN regexp_matches(p, '^[''\"]') THEN p ELSE regexp_replace(p, '\\bdistinct\\b', '', 'gi') END), '')",
)
_column_query(
    "t08_current_year", tx.fix_current_year,
    "regexp_replace(sql_text, 'YEAR\\s*\\(\\s*CURDATE\\s*\\(\\s*\\)\\s*\\)\\s*', '2020', 'gi')",
)
_column_query(
    "t09_forbidden_functions", lambda c: F.array_join(F.array_sort(tx.forbidden_functions(c)), ","),
    "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(sql_text, '([A-Z]+)\\(', 1), lambda f: "
    "f NOT IN ('AVG', 'MAX', 'SUM', 'COUNT', 'MIN')))), ',')",
)
_column_query(
    "t10_mask_literals", lambda c: F.array_join(tx.masked_tokens(c), " "), f"array_to_string({_MASKED}, ' ')"
)
_column_query(
    "t11_literal_set", lambda c: F.array_join(tx.literal_set(c), "|"), f"array_to_string({_LITERALS}, '|')"
)


# Gold values in the slots of predictions: variant 0 is the prediction as it is.
PARTS["pair_variants"] = """
 SELECT query_id, gold, 0 AS variant, pred AS result FROM sql_pairs UNION ALL
 SELECT n.query_id, any_value(gold), v.variant + 1, string_agg(CASE WHEN tok = 'valuerare' THEN vals[1 + CAST((v.variant // CAST(pow(len(vals), slots - slot) AS BIGINT)) % len(vals) AS BIGINT)]
  ELSE tok END, ' ' ORDER BY pos) FROM (
  SELECT *, sum(CASE WHEN tok = 'valuerare' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos) AS slot, sum(CASE WHEN tok = 'valuerare' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS slots
  FROM (SELECT query_id, gold, vals, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT query_id, gold, [[masked]] AS toks, [[literals]] AS vals FROM sql_pairs) a) b) n
 JOIN (SELECT query_id, unnest(range(CAST(pow(len(vals), n) AS BIGINT))) AS variant FROM (SELECT query_id, [[literals]] AS vals, len(list_filter([[masked]], lambda x: x = 'valuerare')) AS n
  FROM sql_pairs) c) v ON n.query_id = v.query_id GROUP BY n.query_id, v.variant""".replace("[[masked]]", _MASKED.replace("sql_text", "pred")).replace("[[literals]]", _LITERALS.replace("sql_text", "gold"))


def parsed_pairs(t):
    """(query_id, gold, pred, segments, vals, n): the predictions cut at their slots and the values of their gold queries."""
    pairs = view(t, "sql_pairs")
    parsed = pairs.select("*", tx.slot_segments(tx.masked_tokens(F.col("pred"))).alias("segments"), tx.literal_set(F.col("gold")).alias("vals"))
    return parsed.withColumn("n", tx.variant_count(F.col("segments"), F.col("vals")))


def with_text(asked):
    return asked.withColumn("result", tx.variant_text(F.col("pred"), F.col("segments"), F.col("vals"), F.col("variant")))


@plan("t12_fill_slots", oracle("SELECT query_id, variant, result FROM <<pair_variants>>"))
def fill_slots(t):
    # Numbers are dealt out in two steps, so that no array is longer than the root of their count
    step = F.ceil(F.sqrt("n")).cast("bigint")
    dealt = parsed_pairs(t).select("*", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, step)).alias("first"))
    dealt = dealt.select("*", F.explode(F.sequence("first", F.least(F.col("first") + F.col("step"), F.col("n")) - 1)).alias("variant"))
    return with_text(dealt).select("query_id", "variant", "result")


_column_query("t13_drop_inner", tx.drop_inner, "replace(replace(sql_text, 'INNER ', ''), 'inner ', '')")
_column_query(
    "t14_plain_star", tx.plain_star,
    "regexp_replace(translate(trim(sql_text), ';' || chr(9), ''), '[tT][1-3]\\.\\*', '*', 'g')",
)


@plan(
    "t15_unquote",
    oracle(
        "SELECT query_id, pos, [[u]] AS result FROM (SELECT query_id, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS pos "
        "FROM (SELECT query_id, regexp_extract_all(sql_text, '[[q]]') AS l FROM <<sql_text>>) a) b",
        u=_UNQUOTE.replace("[[v]]", "v"),
        q=_QUOTED,
    ),
)
def unquote(t):
    found = texts(t).select(
        "query_id", F.posexplode(F.regexp_extract_all("sql_text", F.lit(tx.QUOTED), F.lit(0))).alias("pos", "v")
    )
    return found.select("query_id", F.col("pos").cast("bigint").alias("pos"), tx.unquote(F.col("v")).alias("result"))


_CMP = (
    "\\b(?:([a-z_][a-z0-9_]*)\\.)?([a-z_][a-z0-9_]*)\\b\\s*(?:>=|<=|!=|<>|=|<|>|\\blike\\b)\\s*"
    "(''[^'']*''|\"[^\"]*\"|-?[0-9]+(?:\\.[0-9]+)?)"
)
_END = "(''[^'']*''|\"[^\"]*\"|[-+]?[0-9]+(?:\\.[0-9]+)?|[a-z_][a-z0-9_.]*)"
_BTW = f"\\b(?:([a-z_][a-z0-9_]*)\\.)?([a-z_][a-z0-9_]*)\\s+between\\s+{_END}\\s+and\\s+{_END}"


@plan(
    "t16_typed_comparisons",
    oracle(
        """WITH texts AS (SELECT query_id, sql_text FROM <<sql_text>>),
        c AS (SELECT query_id, unnest(regexp_extract_all(sql_text, '[[c]]', 1, 'i')) AS tbl,
          unnest(regexp_extract_all(sql_text, '[[c]]', 2, 'i')) AS col,
          unnest(regexp_extract_all(sql_text, '[[c]]', 3, 'i')) AS v FROM texts),
        b AS (SELECT query_id, unnest(regexp_extract_all(sql_text, '[[b]]', 1, 'i')) AS tbl,
          unnest(regexp_extract_all(sql_text, '[[b]]', 2, 'i')) AS col,
          unnest(regexp_extract_all(sql_text, '[[b]]', 3, 'i')) AS lo,
          unnest(regexp_extract_all(sql_text, '[[b]]', 4, 'i')) AS hi FROM texts)
        SELECT query_id, CASE WHEN tbl <> '' AND NOT regexp_matches(tbl, '^[tT][0-9]$') THEN lower(tbl) END AS tbl,
          upper(col) AS col, [[u]] AS literal FROM c
        UNION ALL SELECT query_id, lower(nullif(tbl, '')), upper(col), lo FROM b
        UNION ALL SELECT query_id, lower(nullif(tbl, '')), upper(col), hi FROM b""",
        c=_CMP,
        b=_BTW,
        u=_UNQUOTE.replace("[[v]]", "v"),
    ),
)
def typed_comparisons(t):
    return texts(t).select("query_id", F.inline(tx.comparisons(F.col("sql_text"))))


@plan(
    "t17_select_text",
    oracle(
        """SELECT query_id, CASE WHEN has1 THEN replace(s2, 't1', 'orders') ELSE s2 END AS result FROM
        (SELECT query_id, CASE WHEN kind = 5 THEN replace(head, 't2', 'customer') WHEN kind = 2 THEN replace(head, 't2', 'orders')
          ELSE head END AS s2, kind IN (0, 5) AS has1 FROM
        (SELECT query_id, query_id % 7 AS kind, string_split(lower(sql_text), ' from ')[1] AS head FROM <<sql_text>>) a) b"""
    ),
)
def select_text(t):
    c = F.col("sql_text")
    return texts(t).select("query_id", tx.select_text(c, tx.alias_entries(c)).alias("result"))


_column_query("t18_double_quotes", tx.double_quotes, "replace(sql_text, '''', '\"')")
_column_query("t19_value_word", tx.value_word_to_one, "replace(sql_text, 'value', '1')")


@plan(
    "t20_tolerant_decode",
    """SELECT doc_id, md5(s) AS digest, length(s) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text
    ELSE regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g') END AS s FROM documents) d""",
)
def tolerant_decode(t):
    # Every second text is stored as Latin-1 bytes, which are mostly not valid UTF-8.
    latin = F.encode(F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?"), "ISO-8859-1")
    stored = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin)
    decoded = t.documents.select("doc_id", tx.tolerant_decode(stored).alias("s"))
    return decoded.select("doc_id", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("n"))
