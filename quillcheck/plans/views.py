"""Input views derived from the given tables.

The text is plain SQL that Spark and DuckDB read alike. ``{orders}`` marks a table; other
views are named in double angle brackets and are pulled in as common table expressions.
Every view covers its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quillcheck.sources.tables import TABLE_NAMES, Tables

# Texts filled into views by the modules that own them, as ``[[name]]``.
PARTS: dict[str, str] = {}

VIEWS: dict[str, str] = {
    # One text of SQL, or of a reply holding SQL, per order.
    "sql_text": """
SELECT o_orderkey AS query_id, CASE o_orderkey % 7
 WHEN 0 THEN concat('SELECT  DISTINCT COUNT( o_orderkey ) , Max(T1.o_totalprice) FROM orders AS T1 WHERE o_orderstatus = ''',
   o_orderstatus, ''' AND o_totalprice > = ', cast(cast(floor(o_totalprice) AS bigint) AS varchar(20)), ' ;')
 WHEN 1 THEN concat('Here is the query:', chr(10), '```', chr(13), chr(10), 'SELECT o_orderkey', chr(10),
   'FROM orders WHERE o_totalprice <> ', cast(o_custkey AS varchar(20)), '.25', chr(10), '```', chr(10), 'Done')
 WHEN 2 THEN concat('Sure: SELECT T2.* FROM customer AS T1 INNER JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_custkey BETWEEN ',
   cast(o_custkey AS varchar(20)), ' AND ', cast(o_custkey + 9 AS varchar(20)), ' and customer.c_name like "Customer#%"')
 WHEN 3 THEN concat('select c_name from customer where YEAR( CURDATE( ) ) - 1990 > 5 and STRFTIME(o_orderdate) ! = "',
   o_orderpriority, '"   AND  UPPER(LOWER(c_name)) <> ''Distinct It''''s''')
 WHEN 4 THEN concat('no query, only the value ', cast(o_orderkey AS varchar(20)))
 WHEN 5 THEN concat('SELECT t1.o_orderpriority , t2.c_name FROM orders AS t1 JOIN customer AS t2 WHERE orders.o_orderpriority = "',
   o_orderpriority, '" OR o_orderstatus = ''', o_orderstatus, ''' ORDER BY LOWER(o_orderstatus)', chr(9), ';')
 ELSE concat('Select Count(*) , Avg(o_totalprice) From orders Where o_custkey = ', cast(o_custkey AS varchar(20)),
   ' Group By o_orderstatus Having Count(*) > ', cast(o_orderkey % 10 AS varchar(20))) END AS sql_text
FROM {orders}""",
    # Each text beside that of another order with the same pattern, as gold query and prediction; and the texts tried for each pair.
    "sql_pairs": """
SELECT g.query_id, g.sql_text AS gold, p.sql_text AS pred FROM <<sql_text>> g JOIN <<sql_text>> p ON p.query_id = g.query_id + 7""",
    "pair_variants": """
SELECT * FROM ([[pair_variants]]) v CROSS JOIN (SELECT 1 FROM <<sql_pairs>> LIMIT 1) x""",
    # All values of all columns of the sales tables: (table, column, value), distinct.
    "value_index": """
SELECT * FROM ([[all_values]]) u WHERE value IS NOT NULL""",
    # One literal per part, aimed at a column: exact, other case, swapped words, a letter lost, wrong column, a number,
    # a value of another table, no such value, stray blanks; some customers and suppliers misspelt, and some nulls.
    "probes": """
SELECT p_partkey AS probe_id, 'part' AS tbl,
 CASE WHEN p_partkey % 9 IN (4, 6, 7) THEN 'p_type' ELSE 'p_name' END AS col,
 CASE WHEN p_partkey % 40 = 39 THEN NULL WHEN p_partkey % 40 = 17 THEN concat('Custmer#', cast(p_partkey % 1500 AS varchar(12)))
   WHEN p_partkey % 40 = 18 THEN concat('supplier#0000000', cast(p_partkey % 100 AS varchar(12)))
   ELSE CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
   WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
   WHEN 3 THEN substring(p_name, 1, length(p_name) - 1)
   WHEN 4 THEN p_brand WHEN 5 THEN cast(p_size AS varchar(12))
   WHEN 6 THEN CASE p_size % 5 WHEN 0 THEN 'Household' WHEN 1 THEN 'BILDING' WHEN 2 THEN 'midle east'
     WHEN 3 THEN 'urgent 1' ELSE 'furnitures' END
   WHEN 7 THEN concat('zzz qq', cast(p_size AS varchar(12)))
   ELSE concat(' ', p_name, ' ') END END AS literal
FROM {part}""",
    # Token-sorted texts of literals and values; of a value (up to 63 letters) also the bits of each letter's places.
    "literal_norms": """
SELECT literal, array_to_string(list_sort(string_split(trim(lower(regexp_replace(regexp_replace(literal, '[^\\x00-\\x7f]', '', 'g'), '[^A-Za-z0-9_]+', ' ', 'g'))), ' ')), ' ') AS a
FROM (SELECT DISTINCT literal FROM <<probes>> WHERE literal IS NOT NULL) p""",
    "value_norms": """
SELECT value, b, length(b) AS n, map_from_entries(list_transform(list_distinct(string_split(b, '')), lambda c: {'k': c, 'v': list_sum(list_transform(range(1, length(b) + 1),
 lambda i: CASE WHEN substring(b, i, 1) = c THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END))::UBIGINT})) AS m
FROM (SELECT value, array_to_string(list_sort(string_split(trim(lower(regexp_replace(regexp_replace(value, '[^\\x00-\\x7f]', '', 'g'), '[^A-Za-z0-9_]+', ' ', 'g'))), ' ')), ' ') AS b
 FROM (SELECT DISTINCT value FROM <<value_index>>) v) r""",
    # A vector for some of the words of part names.
    "token_vectors": """
SELECT t.token, e.embedding FROM (SELECT token, dense_rank() OVER (ORDER BY token) AS rn FROM <<name_words>>) t LEFT JOIN {embeddings} e ON e.vec_id = t.rn * 3""",
    "name_words": """
SELECT DISTINCT token FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM {part}) u WHERE token <> ''""",
    # Mean vectors of texts, and the cascade by their cosine.
    "text_vectors": """
SELECT text, list(x ORDER BY dim) AS vector FROM (SELECT text, dim, avg(x) AS x FROM (SELECT text, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM
 (SELECT DISTINCT text, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS token FROM
  (SELECT DISTINCT literal AS text FROM <<probes>> WHERE literal IS NOT NULL UNION SELECT DISTINCT value FROM <<value_index>>) a) b JOIN <<token_vectors>> USING (token) WHERE embedding IS NOT NULL) c
 GROUP BY text, dim) d GROUP BY text""",
    "in_table_vectors": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col, literal ORDER BY stage, score DESC, exact DESC, mval, mcol) AS rn FROM (
 SELECT tbl, col, literal, tbl AS mtbl, mcol, mval, score, exact, CASE WHEN mcol = col AND exact THEN 1 WHEN exact THEN 2 WHEN mcol = col AND score > 0.65 THEN 3
   WHEN score > 0.65 THEN 4 ELSE 6 END AS stage FROM (
  SELECT p.tbl, p.col, p.literal, v.col AS mcol, v.value AS mval, lower(trim(p.literal)) = lower(trim(v.value)) AS exact,
   coalesce(round(list_cosine_similarity(a.vector, b.vector), 6), -1) AS score
  FROM <<unique_probes>> p JOIN <<value_index>> v ON v.tbl = p.tbl LEFT JOIN <<text_vectors>> a ON a.text = p.literal LEFT JOIN <<text_vectors>> b ON b.text = v.value) x
 WHERE mcol = col OR exact OR score > 0.65) y) z WHERE rn = 1""",
    "in_database_vectors": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col, literal ORDER BY score DESC, exact DESC, mval, mtbl, mcol) AS rn FROM (
 SELECT p.tbl, p.col, p.literal, v.tbl AS mtbl, v.col AS mcol, v.value AS mval, lower(trim(p.literal)) = lower(trim(v.value)) AS exact,
  round(list_cosine_similarity(a.vector, b.vector), 6) AS score
 FROM (SELECT * FROM <<unique_probes>> u WHERE NOT EXISTS (SELECT 1 FROM <<in_table_vectors>> i WHERE i.tbl = u.tbl AND i.col = u.col AND i.literal = u.literal AND stage < 6)) p
 JOIN <<text_vectors>> a ON a.text = p.literal JOIN <<value_index>> v ON v.tbl <> p.tbl JOIN <<text_vectors>> b ON b.text = v.value) x
 WHERE score > 0.65) y WHERE rn = 1""",
    "calibrated_vectors": """
SELECT tbl, col, literal, stage, CASE WHEN stage IN (4, 5) AND kept IS NULL THEN tbl ELSE mtbl END AS match_tbl,
 CASE WHEN stage IN (4, 5) AND kept IS NULL THEN col ELSE mcol END AS match_col, CASE WHEN stage = 1 THEN NULL WHEN stage = 2 THEN mval ELSE kept END AS match_value
FROM (SELECT *, CASE WHEN TRY_CAST(trim(literal) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(mval) AS DOUBLE) IS NOT NULL THEN NULL ELSE mval END AS kept FROM (
 SELECT u.tbl, u.col, u.literal, CASE WHEN d.literal IS NOT NULL THEN 5 ELSE coalesce(i.stage, 6) END AS stage,
  CASE WHEN d.literal IS NOT NULL THEN d.mtbl ELSE u.tbl END AS mtbl, CASE WHEN d.literal IS NOT NULL THEN d.mcol ELSE coalesce(i.mcol, u.col) END AS mcol,
  CASE WHEN d.literal IS NOT NULL THEN d.mval ELSE i.mval END AS mval
 FROM <<unique_probes>> u LEFT JOIN <<in_table_vectors>> i ON i.tbl = u.tbl AND i.col = u.col AND i.literal = u.literal
 LEFT JOIN <<in_database_vectors>> d ON d.tbl = u.tbl AND d.col = u.col AND d.literal = u.literal) w) z""",
    # The calibration cascade over the distinct probes, written over the scores of all values.
    "unique_probes": """
SELECT DISTINCT tbl, col, literal FROM <<probes>> WHERE literal IS NOT NULL""",
    "in_table": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col, literal ORDER BY stage, score DESC, exact DESC, mval, mcol) AS rn FROM (
 SELECT tbl, col, literal, tbl AS mtbl, mcol, mval, score, exact, CASE WHEN mcol = col AND exact THEN 1 WHEN exact THEN 2 WHEN mcol = col AND score > 0.65 THEN 3
   WHEN score > 0.65 THEN 4 ELSE 6 END AS stage FROM (
  SELECT p.tbl, p.col, p.literal, v.col AS mcol, v.value AS mval, lower(trim(p.literal)) = lower(trim(v.value)) AS exact, [[score]] AS score
  FROM <<unique_probes>> p JOIN <<value_index>> v ON v.tbl = p.tbl JOIN <<literal_norms>> l ON l.literal = p.literal JOIN <<value_norms>> n ON n.value = v.value) x
 WHERE mcol = col OR exact OR score > 0.65) y) z WHERE rn = 1""",
    "in_database": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col, literal ORDER BY score DESC, exact DESC, mval, mtbl, mcol) AS rn FROM (
 SELECT p.tbl, p.col, p.literal, v.tbl AS mtbl, v.col AS mcol, v.value AS mval, lower(trim(p.literal)) = lower(trim(v.value)) AS exact, [[score]] AS score
 FROM (SELECT * FROM <<unique_probes>> u WHERE NOT EXISTS (SELECT 1 FROM <<in_table>> i WHERE i.tbl = u.tbl AND i.col = u.col AND i.literal = u.literal AND stage < 6)) p
 JOIN <<value_index>> v ON v.tbl <> p.tbl JOIN <<literal_norms>> l ON l.literal = p.literal JOIN <<value_norms>> n ON n.value = v.value) x
 WHERE score > 0.65) y WHERE rn = 1""",
    "calibrated": """
SELECT tbl, col, literal, stage, CASE WHEN stage IN (4, 5) AND kept IS NULL THEN tbl ELSE mtbl END AS match_tbl,
 CASE WHEN stage IN (4, 5) AND kept IS NULL THEN col ELSE mcol END AS match_col, CASE WHEN stage = 1 THEN NULL WHEN stage = 2 THEN mval ELSE kept END AS match_value
FROM (SELECT *, CASE WHEN TRY_CAST(trim(literal) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(mval) AS DOUBLE) IS NOT NULL THEN NULL ELSE mval END AS kept FROM (
 SELECT u.tbl, u.col, u.literal, CASE WHEN d.literal IS NOT NULL THEN 5 ELSE coalesce(i.stage, 6) END AS stage,
  CASE WHEN d.literal IS NOT NULL THEN d.mtbl ELSE u.tbl END AS mtbl, CASE WHEN d.literal IS NOT NULL THEN d.mcol ELSE coalesce(i.mcol, u.col) END AS mcol,
  CASE WHEN d.literal IS NOT NULL THEN d.mval ELSE i.mval END AS mval
 FROM <<unique_probes>> u LEFT JOIN <<in_table>> i ON i.tbl = u.tbl AND i.col = u.col AND i.literal = u.literal
 LEFT JOIN <<in_database>> d ON d.tbl = u.tbl AND d.col = u.col AND d.literal = u.literal) w) z""",
    # Predicates of made-up queries: a bar-separated literal list per probe, grouped by size.
    "predicates": """
SELECT probe_id, probe_id DIV 3 AS query_id, concat(tbl, CASE WHEN probe_id % 17 = 0 THEN '' ELSE '.' END, col) AS target,
 concat(coalesce(literal, 'nothing'), CASE WHEN probe_id % 4 = 0 THEN '|1.5' WHEN probe_id % 5 = 0 THEN '|"red" ring' ELSE '' END) AS literals,
 CASE WHEN (probe_id DIV 3) % 7 = 0 THEN 'select p_name from part where p_type LIKE 1' ELSE 'select p_name from part' END AS sql_text
FROM <<probes>>""",
    # One question per order about its customer's segment, its status and its priority.
    "questions": """
SELECT o_orderkey AS q_id, 'sales' AS db_id, concat('How many ', lower(c_mktsegment), '''s orders, status ', o_orderstatus,
 ', have priority "', o_orderpriority, '"', CASE o_orderkey % 5 WHEN 0 THEN ' in the Midle East?' WHEN 1 THEN ' (id 12) with a re ring?'
 WHEN 2 THEN ', 1-urgent, or ECONOMI type?' WHEN 3 THEN ' of Brand#2 and brand#21?' ELSE '?' END) AS question,
 CASE o_orderkey % 4 WHEN 0 THEN 'orders customer' WHEN 1 THEN 'lineitem' WHEN 2 THEN 'region nation part' ELSE '' END AS table_list,
 concat('SELECT-FROM', CASE o_orderkey % 2 WHEN 0 THEN '-WHERE' ELSE '' END) AS structure, 'select count(*)' AS select_text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # All runs of whole words of each distinct question.
    "question_spans": """
SELECT DISTINCT question, span FROM (SELECT question, regexp_replace(array_to_string(list_slice(p, i, i + n), ''), '[''"()`,.?! ]+$', '') AS span
 FROM (SELECT question, p, i, unnest(range(0, len(p) - i + 1)) AS n FROM (SELECT question, p, unnest(range(1, len(p) + 1)) AS i
 FROM (SELECT DISTINCT question, regexp_extract_all(lower(trim(question)), '[^''"()`,.?! ]+[''"()`,.?! ]*') AS p FROM <<questions>>) a) b) c) d
WHERE length(span) > 1 AND length(span) <= 60""",
    "span_pairs": """
SELECT span, key, score, run_at, run_size, trim(substring(key, run_at + 1, run_size)) AS run FROM (
 SELECT span, key, score, CAST(list_max(hits).size AS BIGINT) AS run_size, CAST(-list_max(hits).at AS BIGINT) AS run_at FROM (
 SELECT *, list_filter(flatten(list_transform(range(1, length(key) + 1), lambda z: list_transform(range(0, length(key) - z + 1),
   lambda i: CASE WHEN contains(span, substring(key, i + 1, z)) THEN {'size': z, 'at': -i} END))), lambda h: h IS NOT NULL) AS hits
 FROM (SELECT *, 2.0 * (n - bit_count(list_reduce(string_split(span, ''), lambda r, c: ((r + (r & coalesce(m[c], 0::UBIGINT))) | (r - (r & coalesce(m[c], 0::UBIGINT))))
    & ((1::UBIGINT << n::UBIGINT) - 1), (1::UBIGINT << n::UBIGINT) - 1))) / (length(span) + n) AS score
  FROM (SELECT DISTINCT span, left(span, 1) AS head FROM <<question_spans>>) s JOIN (SELECT key, left(key, 1) AS head, length(key) AS n, map_from_entries(list_transform(
   list_distinct(string_split(key, '')), lambda c: {'k': c, 'v': list_sum(list_transform(range(1, length(key) + 1),
    lambda i: CASE WHEN substring(key, i, 1) = c THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END))::UBIGINT})) AS m
   FROM (SELECT DISTINCT lower(trim(value)) AS key FROM <<value_index>> WHERE trim(value) <> '') d) k USING (head)
  WHERE 2 * least(length(span), length(key)) >= 0.85 * (length(span) + length(key)) - 0.000001) x
 WHERE score >= 0.85) y) w""",
    "usable_pairs": """
SELECT * FROM (SELECT *, [run, span, key] AS three FROM <<span_pairs>>) u
WHERE length(run) > 0 AND TRY_CAST(replace(run, ',', '') AS DOUBLE) IS NULL AND run <> 'id'
 AND NOT list_has_any(three, string_split('[[stop]]', ' ')) AND (NOT list_has_any(three, ['no', 'yes', 'many']) OR score >= 1)""",
    "mentions": """
SELECT question, tbl, col, max(value) AS value, arg_max(score, value) AS score, arg_max(run_size, value) AS run_size FROM (
 SELECT question, tbl, col, value, substring(value, run_at + 1, run_size) AS run, score, run_size, row_number() OVER (PARTITION BY question, tbl, col, value
  ORDER BY score DESC, run_size DESC, substring(value, run_at + 1, run_size) DESC) AS rn
 FROM <<question_spans>> JOIN <<usable_pairs>> USING (span) JOIN <<value_index>> ON lower(trim(value)) = key
 WHERE score >= 1 OR NOT (upper(value) = value AND lower(value) <> value)) m WHERE rn = 1 GROUP BY question, tbl, col, run""",
    "top_mentions": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, tbl, col ORDER BY score DESC, run_size DESC, value) AS place FROM <<mentions>>
 WHERE NOT contains(col, 'name') OR score >= 1) t WHERE place <= 2""",
    "always_shown": """
SELECT tbl, col, CASE WHEN low = high THEN [low] ELSE [low, high] END AS vals FROM (SELECT tbl, col, count(*) AS n, min(value) AS low, max(value) AS high
 FROM <<value_index>> GROUP BY tbl, col) a WHERE n = 1 AND low <> '' OR n = 2 AND (length(low) <= 3 OR lower(low) IN ('male', 'female'))""",
    "linked": """
SELECT question, tbl, col, list(value ORDER BY place) AS vals FROM <<top_mentions>> GROUP BY question, tbl, col""",
    # (table_id, tbl, pos, col) of the sales tables, and their foreign keys by position.
    "sales_columns": """
SELECT * FROM (VALUES [[columns]]) AS c(table_id, tbl, pos, col)""",
    "sales_keys": """
SELECT * FROM (VALUES [[keys]]) AS k(tbl, c1, t2, c2, col, ref_tbl, ref_col)""",
    "table_texts": """
SELECT question, table_id, tbl, lower(tbl) || '(' || string_agg(lower(col) || CASE WHEN vals IS NULL THEN '' ELSE ' [' ||
  array_to_string(list_transform(vals, lambda v: '"' || v || '"'), ', ') || ']' END, ', ' ORDER BY pos) || ')' AS plain
FROM (SELECT q.question, c.table_id, c.tbl, c.pos, c.col, coalesce(l.vals, s.vals) AS vals FROM (SELECT DISTINCT question FROM <<questions>>) q
 CROSS JOIN <<sales_columns>> c LEFT JOIN <<linked>> l ON l.question = q.question AND l.tbl = c.tbl AND l.col = c.col
 LEFT JOIN <<always_shown>> s ON s.tbl = c.tbl AND s.col = c.col) x GROUP BY question, table_id, tbl""",
    "keyed_texts": """
SELECT question, table_id, tbl, plain || coalesce(' ' || fk, '') AS table_text FROM <<table_texts>> LEFT JOIN
 (SELECT tbl, string_agg('FOREIGN KEY: ' || tbl || '.' || col || ' = ' || ref_tbl || '.' || ref_col, ', ' ORDER BY c1) AS fk FROM <<sales_keys>> GROUP BY tbl) k USING (tbl)""",
    # Clause units: gold from the lines of an order, prediction an altered copy.
    "clause_lines": """
SELECT 'gold' AS role, l.* FROM {lineitem} l UNION ALL
SELECT 'pred', l.* FROM {lineitem} l WHERE NOT (l_linestatus = 'O' AND l_returnflag = 'R' AND l_discount > 0.05)""",
    # Half of the predicted branches are stored under ids of their own, below zero.
    "clause_units": """
SELECT * FROM <<own_units>> UNION ALL
SELECT -query_id, role, clause, ordinal, connector, not_op, op, agg, unit_op, col, is_distinct, value, value_kind, direction FROM <<own_units>>
WHERE role = 'pred' AND query_id > 0 AND query_id - 1 IN (SELECT o_orderkey FROM {orders} WHERE o_totalprice > 250000)""",
    "own_units": """
SELECT query_id, role, clause, row_number() OVER (PARTITION BY query_id, role, clause ORDER BY a, b, c, d) - 1 AS ordinal, connector, not_op, op,
 agg, unit_op, col, is_distinct, value, value_kind, direction FROM (
SELECT l_orderkey AS query_id, role, clause, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d,
 CASE WHEN clause IN ('where', 'having') THEN CASE WHEN l_tax < 0.02 THEN 'or' WHEN l_tax < 0.05 THEN 'and' END END AS connector,
 clause IN ('where', 'having') AND l_quantity > 40 AS not_op,
 CASE WHEN clause IN ('where', 'having') THEN CASE l_suppkey % 5 WHEN 0 THEN '=' WHEN 1 THEN 'like' WHEN 2 THEN 'in' WHEN 3 THEN '>' ELSE 'between' END END AS op,
 CASE WHEN role = 'pred' AND l_returnflag = 'R' AND l_tax > 0.06 THEN 'none' WHEN l_suppkey % 3 = 0 THEN 'none' WHEN l_suppkey % 3 = 1 THEN 'max' ELSE 'count' END AS agg,
 CASE WHEN l_quantity < 3 THEN '-' ELSE 'none' END AS unit_op,
 CASE l_partkey % 5 WHEN 0 THEN '__lineitem.l_orderkey__' WHEN 1 THEN '__lineitem.l_partkey__' WHEN 2 THEN '__orders.o_orderkey__'
  WHEN 3 THEN '__orders.o_custkey__' ELSE '__lineitem.l_tax__' END AS col,
 l_quantity > 30 AS is_distinct,
 CASE WHEN clause IN ('where', 'having') THEN cast(cast(l_quantity AS bigint) + CASE WHEN role = 'pred' AND l_discount < 0.02 THEN 1 ELSE 0 END AS varchar(9)) END AS value,
 CASE WHEN clause IN ('where', 'having') THEN CASE WHEN l_quantity = 7 THEN 'nested' WHEN l_suppkey % 2 = 0 THEN 'number' ELSE 'string' END END AS value_kind,
 CASE WHEN clause = 'orderBy' THEN CASE WHEN l_orderkey % 2 = 0 THEN 'asc' ELSE 'desc' END END AS direction
FROM (SELECT *, CASE WHEN l_linenumber IN (1, 6) THEN 'select' WHEN l_linenumber IN (2, 7) THEN 'where' WHEN l_linenumber = 3 THEN 'groupBy'
  WHEN l_linenumber = 4 THEN 'orderBy' ELSE 'having' END AS clause FROM <<clause_lines>>) x
UNION ALL SELECT o_orderkey, role, 'from', 0, 0, 0, 0.0, NULL, false, NULL, 'none', 'none', 'lineitem', false, NULL, NULL, NULL
 FROM (SELECT o_orderkey, 'gold' AS role FROM {orders} UNION ALL SELECT o_orderkey, 'pred' FROM {orders} WHERE o_orderpriority <> '5-LOW') a
UNION ALL SELECT o_orderkey, role, 'from', 1, 0, 0, 0.0, NULL, false, NULL, 'none', 'none', 'orders', false, NULL, NULL, NULL
 FROM (SELECT o_orderkey, 'gold' AS role FROM {orders} WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'pred' FROM {orders} WHERE o_orderstatus = 'F') b
UNION ALL SELECT o_orderkey, role, 'limit', 0, 0, 0, 0.0, NULL, false, NULL, 'none', 'none', NULL, false, '1', 'number', NULL
 FROM (SELECT o_orderkey, 'gold' AS role FROM {orders} WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'pred' FROM {orders} WHERE o_totalprice > 210000) c) y""",
    "query_links": """
SELECT o_orderkey AS parent_id, o_orderkey + 1 AS child_id, 'gold' AS role, kind FROM <<order_links>> WHERE o_totalprice > 240000
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -(o_orderkey + 1) ELSE o_orderkey + 1 END, 'pred', kind FROM <<order_links>> WHERE o_totalprice > 250000
UNION ALL SELECT -o_orderkey, -(o_orderkey + 1), 'pred', kind FROM <<order_links>> WHERE o_totalprice > 250000 AND o_orderkey > 0""",
    "order_links": """
SELECT o_orderkey, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 'intersect' WHEN '2-HIGH' THEN 'union' WHEN '3-MEDIUM' THEN 'except' ELSE 'where' END AS kind FROM {orders}""",
    # Key columns of the schema and the lowest column each is tied to by foreign keys.
    "canonical_columns": """
SELECT * FROM (VALUES ('__lineitem.l_orderkey__', '__orders.o_orderkey__'), ('__lineitem.l_partkey__', '__part.p_partkey__'),
 ('__orders.o_custkey__', '__customer.c_custkey__')) AS m(col, canonical)""",
    "ready_units": """
SELECT u.query_id, u.role, clause, ordinal, connector, not_op, op, agg, unit_op, CASE WHEN f.tbl IS NOT NULL THEN coalesce(m.canonical, u.col) ELSE u.col END AS col,
 CASE WHEN value_kind = 'nested' THEN value END AS value, CASE WHEN value_kind = 'nested' THEN value_kind END AS value_kind, direction
FROM <<clause_units>> u LEFT JOIN <<canonical_columns>> m ON m.col = u.col
LEFT JOIN (SELECT DISTINCT query_id, role, col AS tbl FROM <<clause_units>> WHERE clause = 'from') f
 ON f.query_id = u.query_id AND f.role = u.role AND starts_with(u.col, '__' || f.tbl || '.')""",
    "unit_flags": """
SELECT query_id, role, bool_or(clause = 'where') AS has_where, bool_or(clause = 'groupBy') AS has_group, bool_or(clause = 'having') AS has_having,
 bool_or(clause = 'orderBy') AS has_order, bool_or(clause = 'limit') AS has_limit, max(CASE WHEN clause = 'orderBy' THEN direction END) AS direction,
 coalesce(bool_or(connector = 'or'), false) AS has_or, coalesce(bool_or(not_op), false) AS has_not, coalesce(bool_or(op = 'in'), false) AS has_in,
 coalesce(bool_or(op = 'like'), false) AS has_like, coalesce(bool_or(value_kind = 'nested'), false) AS has_nested,
 bool_or(unit_op <> 'none') AS has_arithmetic, bool_or(agg <> 'none') AS has_aggregate FROM <<clause_units>> GROUP BY query_id, role""",
    "link_flags": """
SELECT parent_id AS query_id, role, bool_or(kind = 'intersect') AS has_intersect, bool_or(kind = 'union') AS has_union, bool_or(kind = 'except') AS has_except,
 count(*) AS n_nested FROM <<query_links>> GROUP BY parent_id, role""",
    "keyword_sets": """
SELECT query_id, role, list_sort(list_filter([direction, CASE WHEN has_where THEN 'where' END, CASE WHEN has_group THEN 'group' END, CASE WHEN has_having THEN 'having' END,
 CASE WHEN has_order THEN 'order' END, CASE WHEN has_limit THEN 'limit' END, CASE WHEN has_except THEN 'except' END, CASE WHEN has_union THEN 'union' END,
 CASE WHEN has_intersect THEN 'intersect' END, CASE WHEN has_or THEN 'or' END, CASE WHEN has_not THEN 'not' END, CASE WHEN has_in THEN 'in' END,
 CASE WHEN has_like THEN 'like' END], lambda x: x IS NOT NULL)) AS words FROM <<unit_flags>> LEFT JOIN <<link_flags>> USING (query_id, role)""",
    "unit_counts": """
SELECT u.query_id, u.role, CAST(component1 AS INT) AS component1, coalesce(n_nested, 0) AS nested, CAST(others AS INT) AS others FROM (
 SELECT query_id, role, CAST(bool_or(clause = 'where') AS INT) + CAST(bool_or(clause = 'groupBy') AS INT) + CAST(bool_or(clause = 'orderBy') AS INT)
  + CAST(bool_or(clause = 'limit') AS INT) + greatest(count(*) FILTER (WHERE clause = 'from') - 1, 0) + count(*) FILTER (WHERE connector = 'or')
  + count(*) FILTER (WHERE op = 'like') AS component1,
  CAST(count(*) FILTER (WHERE clause IN ('select', 'groupBy', 'orderBy') AND agg <> 'none' OR clause IN ('where', 'having') AND not_op)
   + count(*) FILTER (WHERE clause = 'having' AND connector IS NOT NULL) > 1 AS INT) + CAST(count(*) FILTER (WHERE clause = 'select') > 1 AS INT)
  + CAST(count(*) FILTER (WHERE clause = 'where') > 1 AS INT) + CAST(count(*) FILTER (WHERE clause = 'groupBy') > 1 AS INT) AS others
 FROM <<clause_units>> GROUP BY query_id, role) u LEFT JOIN <<link_flags>> l ON l.query_id = u.query_id AND l.role = u.role""",
    "levels": """
SELECT *, CASE WHEN component1 <= 1 AND others = 0 AND nested = 0 THEN 'easy'
 WHEN nested = 0 AND (others <= 2 AND component1 <= 1 OR component1 <= 2 AND others < 2) THEN 'medium'
 WHEN nested = 0 AND (others > 2 AND component1 <= 2 OR component1 = 3 AND others <= 2) OR component1 <= 1 AND others = 0 AND nested <= 1 THEN 'hard'
 ELSE 'extra' END AS hardness FROM <<unit_counts>>""",
    # Every gold query beside the prediction of its id, and their branches side by side, whatever the ids.
    "query_pairs": """
SELECT query_id AS gold_id, query_id AS pred_id FROM <<gold_ids>>
UNION SELECT g.child_id, p.child_id FROM query_pairs q JOIN <<query_links>> g ON g.parent_id = q.gold_id AND g.role = 'gold' AND g.kind <> 'where'
 JOIN <<query_links>> p ON p.parent_id = q.pred_id AND p.role = 'pred' AND p.kind = g.kind""",
    "gold_ids": """
SELECT DISTINCT query_id FROM <<clause_units>> WHERE role = 'gold'""",
    "pair_units": """
SELECT gold_id, pred_id, u.* FROM <<query_pairs>> JOIN <<ready_units>> u ON u.query_id = gold_id WHERE role = 'gold'
UNION ALL SELECT gold_id, pred_id, u.* FROM <<query_pairs>> JOIN <<ready_units>> u ON u.query_id = pred_id WHERE role = 'pred'""",
    "pair_words": """
SELECT gold_id, pred_id, role, words FROM <<query_pairs>> JOIN <<keyword_sets>> u ON u.query_id = gold_id WHERE role = 'gold'
UNION ALL SELECT gold_id, pred_id, role, words FROM <<query_pairs>> JOIN <<keyword_sets>> u ON u.query_id = pred_id WHERE role = 'pred'""",
    # Per gold query and component: sizes and bag overlap.
    "part_sizes": """
SELECT gold_id, pred_id, part, sum(g) AS g, sum(p) AS p, sum(least(g, p)) AS o FROM (
 SELECT gold_id, pred_id, part, key, count(*) FILTER (WHERE role = 'gold') AS g, count(*) FILTER (WHERE role = 'pred') AS p FROM (
  SELECT gold_id, pred_id, role, 'select' AS part, CAST([agg, unit_op, col] AS VARCHAR) AS key FROM <<pair_units>> WHERE clause = 'select'
  UNION ALL SELECT gold_id, pred_id, role, 'select(no AGG)', CAST([unit_op, col] AS VARCHAR) FROM <<pair_units>> WHERE clause = 'select'
  UNION ALL SELECT gold_id, pred_id, role, 'where', CAST([CAST(not_op AS VARCHAR), op, agg, unit_op, col, value] AS VARCHAR) FROM <<pair_units>> WHERE clause = 'where'
  UNION ALL SELECT gold_id, pred_id, role, 'where(no OP)', CAST([agg, unit_op, col] AS VARCHAR) FROM <<pair_units>> WHERE clause = 'where'
  UNION ALL SELECT gold_id, pred_id, role, 'group(no Having)', string_split(col, '.')[-1] FROM <<pair_units>> WHERE clause = 'groupBy'
  UNION ALL SELECT gold_id, pred_id, role, 'group list', ordinal || col FROM <<pair_units>> WHERE clause = 'groupBy'
  UNION ALL SELECT gold_id, pred_id, role, 'having list', CAST([CAST(ordinal AS VARCHAR), connector, CAST(not_op AS VARCHAR), op, agg, unit_op, col, value] AS VARCHAR) FROM <<pair_units>> WHERE clause = 'having'
  UNION ALL SELECT gold_id, pred_id, role, 'order list', CAST([CAST(ordinal AS VARCHAR), direction, agg, unit_op, col] AS VARCHAR) FROM <<pair_units>> WHERE clause = 'orderBy'
  UNION ALL SELECT DISTINCT gold_id, pred_id, role, 'limit', '' FROM <<pair_units>> WHERE clause = 'limit'
  UNION ALL SELECT gold_id, pred_id, role, 'tables', col FROM <<pair_units>> WHERE clause = 'from'
  UNION ALL SELECT DISTINCT gold_id, pred_id, role, 'and/or', connector FROM <<pair_units>> WHERE clause = 'where' AND connector IS NOT NULL
  UNION ALL SELECT DISTINCT gold_id, pred_id, role, 'query', '' FROM <<pair_units>>
  UNION ALL SELECT gold_id, pred_id, role, 'keywords', unnest(words) FROM <<pair_words>>) k GROUP BY gold_id, pred_id, part, key) c GROUP BY gold_id, pred_id, part""",
    "wide_sizes": """
SELECT q.gold_id, q.pred_id, [[wide]] FROM <<query_pairs>> q LEFT JOIN <<part_sizes>> s ON s.gold_id = q.gold_id AND s.pred_id = q.pred_id
WHERE q.gold_id IN (SELECT query_id FROM <<gold_ids>>) GROUP BY q.gold_id, q.pred_id""",
    "component_sizes": """
SELECT gold_id, pred_id, unnest(['select', 'select(no AGG)', 'where', 'where(no OP)', 'group(no Having)', 'group', 'order', 'and/or', 'keywords']) AS component,
 unnest([select_g, selectn_g, where_g, wheren_g, groupn_g, CAST(gl_g > 0 AS BIGINT), CAST(ol_g > 0 AS BIGINT), CASE WHEN ao_same THEN 1 ELSE ao_p END, kw_g]) AS label_total,
 unnest([select_p, selectn_p, where_p, wheren_p, groupn_p, CAST(gl_p > 0 AS BIGINT), CAST(ol_p > 0 AS BIGINT), CASE WHEN ao_same THEN 1 ELSE ao_g END, kw_p]) AS pred_total,
 unnest([select_o, selectn_o, where_o, wheren_o, groupn_o, CAST(gl_g > 0 AND gl_g = gl_p AND gl_o = gl_g AND hl_g = hl_p AND hl_o = hl_g AS BIGINT),
  CAST(ol_g > 0 AND ol_g = ol_p AND ol_o = ol_g AND li_g = li_p AS BIGINT), CAST(ao_same AS BIGINT), kw_o]) AS overlap
FROM (SELECT *, ao_g = ao_p AND ao_o = ao_g AS ao_same FROM <<wide_sizes>>) w""",
    "base_match": """
SELECT gold_id, pred_id, bool_and(label_total = pred_total AND overlap = pred_total) AND bool_and(tb_g = 0 OR tb_g = tb_p AND tb_o = tb_g) AS same
FROM <<component_sizes>> JOIN <<wide_sizes>> USING (gold_id, pred_id) GROUP BY gold_id, pred_id""",
    # The branches of each pair by kind, what decides a pair apart from its branches, the pairs below each one, and all together.
    "branch_kinds": """
SELECT q.gold_id, q.pred_id, l.kind, max(CASE WHEN l.role = 'gold' THEN l.child_id END) AS gold_child, max(CASE WHEN l.role = 'pred' THEN l.child_id END) AS pred_child
FROM <<query_pairs>> q JOIN <<query_links>> l ON l.kind <> 'where' AND (l.role = 'gold' AND l.parent_id = q.gold_id OR l.role = 'pred' AND l.parent_id = q.pred_id)
GROUP BY q.gold_id, q.pred_id, l.kind""",
    "branch_local": """
SELECT b.gold_id, b.pred_id, same, count(gold_child) AS label_total, count(pred_child) AS pred_total,
 same AND count(gold_child) = count(pred_child) AND count(*) FILTER (WHERE gold_child IS NOT NULL AND pred_child IS NOT NULL) = count(pred_child) AS local
FROM <<base_match>> b LEFT JOIN <<branch_kinds>> p ON p.gold_id = b.gold_id AND p.pred_id = b.pred_id GROUP BY b.gold_id, b.pred_id, same""",
    "branch_reach": """
SELECT gold_id AS root_gold, pred_id AS root_pred, gold_id, pred_id FROM <<query_pairs>>
UNION SELECT r.root_gold, r.root_pred, p.gold_child, p.pred_child FROM branch_reach r JOIN <<branch_kinds>> p ON p.gold_id = r.gold_id AND p.pred_id = r.pred_id
WHERE p.gold_child IS NOT NULL AND p.pred_child IS NOT NULL""",
    "branch_exact": """
SELECT root_gold AS gold_id, root_pred AS pred_id, bool_and(coalesce(local, false)) AS exact
FROM <<branch_reach>> r LEFT JOIN <<branch_local>> l ON l.gold_id = r.gold_id AND l.pred_id = r.pred_id GROUP BY root_gold, root_pred""",
    "exact_all": """
SELECT l.gold_id AS query_id, l.same, l.label_total, l.pred_total, count(*) FILTER (WHERE c.exact) AS overlap, e.exact
FROM <<branch_local>> l JOIN <<branch_exact>> e ON e.gold_id = l.gold_id AND e.pred_id = l.pred_id LEFT JOIN <<branch_kinds>> p ON p.gold_id = l.gold_id AND p.pred_id = l.pred_id
LEFT JOIN <<branch_exact>> c ON c.gold_id = p.gold_child AND c.pred_id = p.pred_child WHERE l.gold_id = l.pred_id
GROUP BY l.gold_id, l.same, l.label_total, l.pred_total, e.exact""",
    "partial_rows": """
SELECT query_id, component, label_total, pred_total, overlap, CAST(label_total = pred_total AND overlap = pred_total AS INT) AS hit FROM (
 SELECT gold_id AS query_id, component, label_total, pred_total, overlap FROM <<component_sizes>> WHERE gold_id = pred_id
 UNION ALL SELECT query_id, 'IUEN', label_total, pred_total, overlap FROM <<exact_all>>) p""",
    "turns": """
SELECT conv_id AS session_id, turn AS turn_idx, role, text, CASE WHEN length(text) % 5 <> 0 THEN 1 ELSE 0 END AS exec_ok,
 CASE WHEN length(text) % 3 <> 0 THEN 1 ELSE 0 END AS exact_ok,
 CASE length(text) % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extra' END AS level FROM {conversations}""",
    # Turns as lines of a file, a blank line after each session.
    "session_lines": """
SELECT session_id * 1000000000 + turn_idx AS line_no, concat(level, ' ', role, chr(9), 'db', exec_ok) AS line FROM <<turns>>
UNION ALL SELECT DISTINCT session_id * 1000000000 + 999999999, '  ' FROM <<turns>>""",
    "candidates": """
SELECT l_orderkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
 l_discount * 5 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
 concat('select ', l_linestatus, ', ', l_returnflag) AS text, CASE WHEN l_tax = 0.08 THEN NULL WHEN l_quantity > 25 THEN 0 ELSE l_quantity END AS n_rows
FROM {lineitem}""",
    # Beams of one input side by side: select, structure and table candidates of an order.
    "beams": """
SELECT o_orderkey AS input_id, concat('select ', lower(o_orderpriority), ', ', lower(o_orderstatus)) AS gold_select,
 array(concat('select ', lower(o_orderstatus), ', ', lower(o_orderpriority)), concat('select ', lower(o_orderstatus)), concat('select ', lower(o_orderpriority), ', p'), 'select f') AS selects,
 CASE o_orderstatus WHEN 'F' THEN array('SELECT-FROM-WHRE', 'SELECT-FROM-WHERE', 'SELECT-FROM', 'SELECT-FROM-GROUP BY') WHEN 'O' THEN array('SELECT-FROM', 'SELECT_FROM')
  ELSE array('SELECT-FROM-UNION-SELECT-FROM', 'SELECT-FROM-ORDER BY', 'SELECT') END AS structures,
 CASE o_orderpriority WHEN '1-URGENT' THEN array('orders', 'orders custmer', 'customer orders') WHEN '2-HIGH' THEN array('', 'part') ELSE array('lineitem', 'region nation', 'nation') END AS table_lists
FROM {orders}""",
    # Templates with variables, their examples and sentences.
    "templates": """
SELECT o_orderkey AS orig_idx, CASE o_orderstatus WHEN 'F' THEN 'small' WHEN 'O' THEN 'large' ELSE 'other' END AS db_id,
 CASE WHEN o_totalprice > 200000 THEN 'test' ELSE 'train' END AS split,
 concat('SELECT n FROM orders AS ordersalias0 WHERE s = ', CASE WHEN o_totalprice > 400000 THEN '" status_name0 "' ELSE '"status_name0"' END, ' AND k > price0',
  CASE WHEN o_orderpriority = '5-LOW' THEN ' AND x = unknown7' ELSE '' END) AS query,
 array(concat('orders with " status_name0 " above price0'), concat('give me price0 of ', lower(o_orderpriority))) AS sentences,
 o_orderstatus AS status_example, cast(o_custkey AS varchar(20)) AS price_example FROM {orders}""",
    # Select texts with the tables they come from.
    "select_texts": """
SELECT o_orderkey AS idx, 'sales' AS db_id, CASE o_orderstatus WHEN 'F' THEN 'select o_orderkey , max(o_totalprice), count(orders.o_custkey)'
 WHEN 'O' THEN 'select o_totalprice, c_name' ELSE 'select customer.c_name , avg( c_acctbal ), o_orderdate' END AS select_text,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 't5' WHEN o_orderpriority = '2-HIGH' THEN 't2 t5' ELSE 't2' END AS table_list,
 CASE o_orderstatus WHEN 'F' THEN 'SELECT max(o_totalprice) FROM Orders JOIN lineitem ;' WHEN 'O' THEN 'select 1 from part , nation where part.p_size = 1;'
  ELSE 'select c_name from customer' END AS query FROM {orders}""",
}

_REF = re.compile(r"<<(\w+)>>")


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in _REF.findall(text):
        if name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def oracle(text: str, **parts: str) -> str:
    """SQL for the check: ``<<view>>`` references become common table expressions."""
    for key, value in parts.items():
        text = text.replace(f"[[{key}]]", value)
    ctes = ", ".join(f"{n} AS ({_REF.sub(r'\1', VIEWS[n])})" for n in _needed(text, []))
    body = _REF.sub(r"\1", text)
    if ctes:
        stripped = body.lstrip()
        if stripped[:5].upper() == "WITH ":
            body = f"WITH RECURSIVE {ctes}, {stripped[5:]}"
        else:
            body = f"WITH RECURSIVE {ctes} {body}"
    for key, value in PARTS.items():
        body = body.replace(f"[[{key}]]", value)
    for name in TABLE_NAMES:
        body = body.replace("{" + name + "}", name)
    return body.replace(" DIV ", " // ").replace(" array(", " list_value(")


def view(tables: Tables, name: str) -> DataFrame:
    """The same view as a DataFrame."""
    return tables.sql(oracle_text_for_spark(name))


def oracle_text_for_spark(name: str) -> str:
    text = VIEWS[name]
    ctes = ", ".join(f"{n} AS ({_REF.sub(r'\1', VIEWS[n])})" for n in _needed(text, []))
    body = _REF.sub(r"\1", text)
    return f"WITH {ctes} {body}" if ctes else body
