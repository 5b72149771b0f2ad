"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.llm import alignment, contamination, licenses, ngrams, packing, pii, prefixes, quality, rules, secrets, ship, simhash, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(spans: str, kinds: tuple[str, ...]):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _counts(spans: str, kinds: tuple[str, ...]):
    return [F.size(_of(spans, (k,))).cast("long").alias(f"n_{k}") for k in kinds]


@query("op1_pii")
def personal_data(spark, sf_dir):
    d = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(pii.written(_of("pii", pii.BASE)), 256).alias("base_sha256")
    return d.select("doc_id", *_counts("pii", pii.BASE), base, pii.written(F.col("pii")).alias("spans"))


@query(
    "op2_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) x),
    repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM windows) x WHERE c > 1),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM repeated) x),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
             FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def substring_dedup(spark, sf_dir):
    d = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_decontamination",
    r"""
    WITH words AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
                   UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
    shingles AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5) x),
    sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id),
    met AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM shingles d JOIN shingles i ON d.s = i.s WHERE d.side = 'd' AND i.side = 'i' GROUP BY d.id, i.id)
    SELECT doc_id, item_id, sizes.n AS n_shingles, met.n AS n_found, CAST(met.n AS DOUBLE) / sizes.n AS containment
    FROM met JOIN sizes ON item_id = sizes.id WHERE met.n >= 0.8 * sizes.n - 1e-9
    """,
)
def decontamination(spark, sf_dir):
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _canonical_sql(x: str) -> str:
    out = rf"(' ' || regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ')"
    for rare, usual in licenses.SPELLINGS.items():
        out = f"replace({out}, ' {rare} ', ' {usual} ')"
    return f"trim({out})"


def _lines_sql(text: str) -> str:
    line = f"{{'line': {_canonical_sql('x')}, 'c': regexp_matches(lower(x), '{licenses.COPYRIGHT}')}}"
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {line}), lambda s: s.line <> '')"


def _license_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [("text", k, v) for k, v in licenses.TEXTS.items()] + [("notice", k, v) for k, vs in licenses.NOTICES.items() for v in vs]
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    digests = ", ".join("(" + ", ".join(map(quoted, (k, x))) + ")" for k, ds in licenses.DIGESTS.items() for x in ds)
    whole = "array_to_string(list_transform(list_filter(lines, lambda s: NOT s.c), lambda s: s.line), ' ')"
    return f"""
    WITH known AS (SELECT kind, license, {_lines_sql('t')} AS lines FROM (VALUES {values}) v(kind, license, t)),
    texts AS (SELECT min(license) AS license, digest FROM (SELECT license, sha256({whole}) AS digest FROM known WHERE kind = 'text' UNION ALL VALUES {digests}) k GROUP BY digest),
    notices AS (SELECT min(license) AS license, lines[1].line AS line FROM known WHERE kind = 'notice' GROUP BY 2),
    d AS (SELECT doc_id, lines, {whole} AS said FROM (SELECT doc_id, {_lines_sql('text')} AS lines FROM documents) x),
    named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
              FROM (SELECT doc_id, unnest(list_transform(lines, lambda s: s.line)) AS line FROM d) x JOIN notices USING (line) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.said <> '' THEN sha256(d.said) END AS digest, texts.license, coalesce(named.notices, '') AS notices
    FROM d LEFT JOIN texts ON texts.digest = sha256(d.said) LEFT JOIN named ON named.doc_id = d.doc_id"""


@query("op4_license_scan", _license_sql())
def license_scan(spark, sf_dir):
    return licenses.licensed(table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_secret_scan")
def secret_scan(spark, sf_dir):
    d = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.sha2(secrets.written(_of("secrets", secrets.KINDS[:3])), 256).alias("base_sha256")
    return d.select("doc_id", *_counts("secrets", secrets.KINDS[:3]), base, secrets.written(F.col("secrets")).alias("spans"))


@query("op8_quality_rules")
def quality_rules(spark, sf_dir):
    d = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_quality_classifier")
def quality_classifier(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op10_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
      CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
    FROM q
    """,
)
def archives(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents"))


@query(
    "op12_conversation_prefix_trie",
    """
    WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
                         FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM t),
    crc AS (SELECT c, s, 0 AS step, CAST(4294967295 AS BIGINT) AS v FROM ids
            UNION ALL SELECT c, s, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
            FROM (SELECT c, s, step, CASE WHEN step % 8 = 0 THEN xor(v, CAST(ascii(substr(s, step // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x FROM crc WHERE step < 8 * length(s)) y),
    lent AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE step = 8 * length(s)),
    moved AS (SELECT c, 0 AS own, i, role, text FROM lent JOIN t ON conv_id = c - c % 100 AND i <= h
              UNION ALL SELECT c, 1, i, role, text FROM lent JOIN t ON conv_id = c AND i > h),
    turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, text, sha256(length(role) || ':' || role || text) AS k FROM moved),
    p AS (SELECT c, d, text, string_agg(k, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM turns UNION ALL SELECT c, 0, '', '' FROM ids),
    last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
    node AS (SELECT p.d, p.k, min(p.c) AS conv_id, count(*) AS n, max(length(text)) AS size, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE p.d = last.d) AS ends
             FROM p JOIN last ON p.c = last.c GROUP BY p.d, p.k),
    up AS (SELECT node.*, parent.conv_id AS parent_conv_id, parent.k AS parent_k FROM node
           LEFT JOIN p ON p.c = node.conv_id AND p.d = node.d - 1 LEFT JOIN node parent ON parent.d = p.d AND parent.k = p.k),
    kids AS (SELECT d - 1 AS d, parent_k AS k, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2),
    under AS (SELECT p.d, p.k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((node.n - 1) * node.size) AS saved
              FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k JOIN p ON p.c = node.conv_id AND p.d <= node.d GROUP BY p.d, p.k)
    SELECT up.conv_id, CAST(up.d AS BIGINT) AS depth, up.parent_conv_id, CAST(up.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
      CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM up LEFT JOIN kids ON kids.d = up.d AND kids.k = up.k JOIN under ON under.d = up.d AND under.k = up.k
    """,
)
def conversation_prefix_trie(spark, sf_dir):
    return prefixes.prefix_tree(table(spark, sf_dir, "conversations"))


@query("op13_lm_scoring")
def lm_scoring(spark, sf_dir):
    return ngrams.scored(table(spark, sf_dir, "documents"))
