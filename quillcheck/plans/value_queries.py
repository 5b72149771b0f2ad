"""Value index, literal search and calibration."""

from pyspark.sql import functions as F

from quillcheck.functions import similarity as sim
from quillcheck.functions.text import number_or_null
from quillcheck.operators import catalog as cat
from quillcheck.operators import values as vals
from quillcheck.operators import vectors as vec
from quillcheck.operators.index_store import ValueStore
from quillcheck.operators.ordering import with_ordinal
from quillcheck.operators.search import Searchable, search
from quillcheck.plans.catalog_queries import DATABASES, DECLARED
from quillcheck.plans.registry import plan
from quillcheck.plans.views import PARTS, oracle, view
from quillcheck.session import once, scratch_path

# The columns of the sales tables as declared, for the SQL; the query takes them from the tables.
ALL_COLUMNS = {line.split()[0]: [c.split(":")[0] for c in line.split()[1:]] for line in DECLARED.split("\n") if line.split() and line.split()[0] in DATABASES["sales"]}


def sales(t) -> dict:
    return {tbl: t.scan(tbl) for tbl in DATABASES["sales"]}


def index(t):
    """All values of all columns of the sales tables."""
    frames = sales(t)
    return vals.value_index(frames, {tbl: f.columns for tbl, f in frames.items()})


def searchable(t):
    """The index ready for search; each part is written once per session and state of the tables."""
    return Searchable(index(t), lambda label, make: once(t.spark, t.root, f"values-{label}", make), unique=True)


PARTS["all_values"] = " UNION ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in ALL_COLUMNS.items() for c in cs)
# The score of the literal ``a`` against a value of ``n`` letters, whose places are bits by letter in ``m``.
PARTS["score"] = """CASE WHEN a = '' OR n = 0 THEN 0.0 ELSE round_even(100 * (2.0 * (n - bit_count(list_reduce(string_split(a, ''), lambda r, c:
 ((r + (r & coalesce(m[c], 0::UBIGINT))) | (r - (r & coalesce(m[c], 0::UBIGINT)))) & ((1::UBIGINT << n::UBIGINT) - 1), (1::UBIGINT << n::UBIGINT) - 1))) / (length(a) + n)), 0) / 100 END"""


def probes(t):
    return view(t, "probes")


def token_vectors(t):
    """A vector for some of the words of part names, by the word's place among them."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("token")).where("token <> ''").distinct()
    numbered = with_ordinal(words, ["token"], "place").withColumn("vec_id", (F.col("place") + 1) * 3)
    return numbered.join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left").select("token", "embedding")


@plan("v01_picklist", "SELECT DISTINCT c_name AS value FROM customer")
def picklist(t):
    return vals.picklist(t.customer, "c_name")


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@plan(
    "v02_table_index",
    "SELECT value, string_agg(DISTINCT col, ',' ORDER BY col) AS cols FROM ("
    + " UNION ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM part" for c in _PART)
    + ") u GROUP BY value",
)
def table_index(t):
    found = vals.inverted(vals.table_values(t.part, "part", _PART), ["value"])
    return found.select("value", F.array_join("cols", ",").alias("cols"))


@plan(
    "v03_database_index",
    "SELECT value, tbl, string_agg(DISTINCT col, ',' ORDER BY col) AS cols FROM ("
    + PARTS["all_values"]
    + ") u WHERE value IS NOT NULL GROUP BY value, tbl",
)
def database_index(t):
    found = vals.inverted(index(t), ["value", "tbl"])
    return found.select("value", "tbl", F.array_join("cols", ",").alias("cols"))


_ORDER_COLUMNS = ALL_COLUMNS["orders"]


@plan(
    "v03_refreshed_index",
    "SELECT col, value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM orders WHERE o_orderkey % 3 > 0" for c in _ORDER_COLUMNS)
    + ") u WHERE value IS NOT NULL GROUP BY col, value",
)
def refreshed_index(t):
    """The orders come in three drops; the first is lost when the third arrives, which alone is read then."""
    work = scratch_path(t.spark, "drops")
    for k in range(3):
        t.orders.where(f"o_orderkey % 3 = {k}").write.parquet(f"{work}/drop{k}")
    store = ValueStore(t.spark, f"{work}/index")
    for drops in ((0, 1), (1, 2)):
        store.refresh({"orders": [f"{work}/drop{k}" for k in drops]})
    return store.index().select("col", "value", "n")


@plan(
    "v04_gated_index",
    oracle("SELECT * FROM <<value_index>>"),
)
def gated_index(t):
    """The gate is off unless a caller names a number of rows."""
    return vals.gated(index(t), cat.row_counts(sales(t)))


_PAIR_LCS = (
    "list_extract(list_reduce(string_split(a, ''), lambda prev, c: list_reduce(range(1, length(b) + 1), lambda cur, j: "
    "list_append(cur, CASE WHEN substring(b, j, 1) = c THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0::BIGINT]), "
    "list_transform(range(0, length(b) + 1), lambda z: 0::BIGINT)), -1)"
)


@plan(
    "v05_token_sort_score",
    oracle(
        """SELECT probe_id, CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE
        round_even(100 * (2.0 * [[lcs]] / (length(a) + length(b))), 0) / 100 END AS score
        FROM (SELECT probe_id, array_to_string(list_sort(string_split(trim(lower(regexp_replace(literal, '[^A-Za-z0-9_]+', ' ', 'g'))), ' ')), ' ') AS a,
        array_to_string(list_sort(string_split(trim(lower(regexp_replace(p_name || ' ' || p_type, '[^A-Za-z0-9_]+', ' ', 'g'))), ' ')), ' ') AS b
        FROM <<probes>> JOIN part ON probe_id = p_partkey) x""",
        lcs=_PAIR_LCS,
    ),
)
def token_sort_score(t):
    pairs = probes(t).join(t.part, F.col("probe_id") == F.col("p_partkey"))
    other = F.concat_ws(" ", "p_name", "p_type")
    return pairs.select("probe_id", sim.token_sort_score(F.col("literal"), other).alias("score"))


@plan(
    "v06_nearest_vector",
    """SELECT vec_id, label, other_id, score FROM (SELECT a.vec_id, a.label, b.vec_id AS other_id,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id
    ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rn
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) x WHERE rn = 1""",
)
def nearest_vector(t):
    emb = t.embeddings.select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = vec.nearest(emb, emb, ["label"], k=1, skip_same=True)
    return near.select(F.col("id").alias("vec_id"), "label", "other_id", "score")


@plan(
    "v07_mean_vector",
    oracle(
        """SELECT p_name AS value, dim, round(avg(x), 6) AS mean FROM (SELECT p_name, unnest(embedding) AS x,
        generate_subscripts(embedding, 1) - 1 AS dim FROM (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS token FROM part) w
        JOIN <<token_vectors>> USING (token)) y GROUP BY p_name, dim"""
    ),
)
def mean_vector(t):
    names = t.part.select(F.col("p_name").alias("value")).distinct()
    mean = vec.mean_of_tokens(names, token_vectors(t)).filter(F.col("vector").isNotNull())
    return mean.select("value", F.posexplode("vector").alias("dim", "mean")).select(
        "value", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean")
    )


_PAIRS = "JOIN <<literal_norms>> l ON l.literal = p.literal JOIN <<value_norms>> n ON n.value = v.value"


@plan(
    "v08_ranked_candidates",
    oracle(
        f"""SELECT tbl, col, literal, place, value, score FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col, literal ORDER BY score DESC, exact DESC, value) AS place
        FROM (SELECT p.tbl, p.col, p.literal, v.value, [[score]] AS score, lower(trim(p.literal)) = lower(trim(v.value)) AS exact
        FROM (SELECT DISTINCT tbl, col, literal FROM <<probes>>) p JOIN <<value_index>> v ON v.tbl = p.tbl AND v.col = p.col {_PAIRS}) y) x WHERE place <= 3"""
    ),
)
def ranked_candidates(t):
    found = search(probes(t), searchable(t), ["tbl", "col"], k=3)
    return found.select("tbl", "col", "literal", F.col("place").cast("bigint").alias("place"), "value", "score")


@plan(
    "v09_exact_hit",
    oracle(
        """SELECT probe_id, p.tbl, p.col, literal, min(value) AS value FROM <<probes>> p JOIN <<value_index>> v
        ON v.tbl = p.tbl AND v.col = p.col AND lower(trim(value)) = lower(trim(literal)) GROUP BY ALL"""
    ),
)
def exact_hit(t):
    return vals.exact_in_column(probes(t), searchable(t).entries)


@plan(
    "v10_best_in_table",
    oracle(
        f"""SELECT tbl, literal, score, value, found_col FROM (SELECT *, row_number() OVER (PARTITION BY tbl, literal ORDER BY score DESC, exact DESC, value, found_col) AS rn
        FROM (SELECT p.tbl, p.literal, v.value, v.col AS found_col, [[score]] AS score, lower(trim(p.literal)) = lower(trim(v.value)) AS exact
        FROM (SELECT DISTINCT tbl, literal FROM <<probes>>) p JOIN <<value_index>> v ON v.tbl = p.tbl {_PAIRS}) y) x WHERE rn = 1"""
    ),
)
def best_in_table(t):
    return vals.best_in_table(probes(t), searchable(t))


@plan(
    "v10_best_in_other_columns",
    oracle(
        f"""SELECT tbl, own_col, literal, score, value, found_col FROM (SELECT *, row_number() OVER (PARTITION BY tbl, own_col, literal
        ORDER BY score DESC, exact DESC, value, found_col) AS rn FROM (SELECT p.tbl, p.col AS own_col, p.literal, v.value, v.col AS found_col, [[score]] AS score,
        lower(trim(p.literal)) = lower(trim(v.value)) AS exact FROM (SELECT DISTINCT tbl, col, literal FROM <<probes>>) p
        JOIN <<value_index>> v ON v.tbl = p.tbl AND v.col <> p.col {_PAIRS}) y) x WHERE rn = 1"""
    ),
)
def best_in_other_columns(t):
    return vals.best_in_table(probes(t), searchable(t), exclude_own=True)


@plan(
    "v11_best_elsewhere",
    oracle(
        f"""SELECT tbl, literal, score, value, found_tbl, found_col FROM (SELECT *, row_number() OVER (PARTITION BY tbl, literal
        ORDER BY score DESC, exact DESC, value, found_tbl, found_col) AS rn FROM (SELECT p.tbl, p.literal, v.value, v.tbl AS found_tbl, v.col AS found_col, [[score]] AS score,
        lower(trim(p.literal)) = lower(trim(v.value)) AS exact FROM (SELECT DISTINCT tbl, literal FROM <<probes>>) p
        JOIN <<value_index>> v ON v.tbl <> p.tbl {_PAIRS}) y) x WHERE rn = 1"""
    ),
)
def best_elsewhere(t):
    return vals.best_elsewhere(probes(t), searchable(t))


@plan(
    "v12_number_check",
    oracle(
        """SELECT probe_id, literal, other, CASE WHEN TRY_CAST(trim(literal) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(other) AS DOUBLE) IS NOT NULL
        THEN NULL ELSE other END AS replacement FROM (SELECT probe_id, literal, CASE WHEN p_partkey % 2 = 0 THEN p_brand
        ELSE CAST(p_partkey AS VARCHAR) END AS other FROM <<probes>> JOIN part ON probe_id = p_partkey) x"""
    ),
)
def number_check(t):
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string"))
    pairs = probes(t).join(t.part, F.col("probe_id") == F.col("p_partkey")).select("probe_id", "literal", other.alias("other"))
    return pairs.withColumn("replacement", vals.number_checked(F.col("literal"), F.col("other")))


def calibrated(t):
    return vals.calibrate(probes(t), searchable(t))


@plan(
    "v13_calibration",
    oracle(
        """SELECT p.probe_id, p.tbl, p.col, p.literal, c.stage, c.match_tbl, c.match_col, c.match_value
        FROM <<probes>> p JOIN <<calibrated>> c ON c.tbl = p.tbl AND c.col = p.col AND c.literal = p.literal"""
    ),
)
def calibration(t):
    return calibrated(t)


@plan(
    "v13_calibration_vectors",
    oracle(
        """SELECT p.probe_id, p.tbl, p.col, p.literal, c.stage, c.match_tbl, c.match_col, c.match_value
        FROM <<probes>> p JOIN <<calibrated_vectors>> c ON c.tbl = p.tbl AND c.col = p.col AND c.literal = p.literal"""
    ),
)
def calibration_by_vectors(t):
    index = searchable(t)
    return vals.calibrate(probes(t), index, vals.ByVector(index, token_vectors(t)))


_VERDICT = """CASE WHEN match_tbl = p.tbl AND match_col = p.col AND match_value <> p.literal THEN 'value wrong'
 WHEN (match_tbl <> p.tbl OR match_col <> p.col) AND match_value IS NOT NULL THEN 'column wrong' ELSE 'fine' END"""


@plan(
    "v14_mismatch",
    oracle(
        """SELECT p.probe_id, p.literal, match_tbl, match_col, match_value, [[v]] AS verdict FROM <<probes>> p
        JOIN <<calibrated>> c ON c.tbl = p.tbl AND c.col = p.col AND c.literal = p.literal""",
        v=_VERDICT,
    ),
)
def mismatch(t):
    return vals.mismatch(calibrated(t)).select("probe_id", "literal", "match_tbl", "match_col", "match_value", "verdict")


@plan(
    "v15_feedback",
    oracle(
        """SELECT query_id, string_agg(n || '. Column ' || tbl || '.' || col || CASE WHEN verdict = 'value wrong'
          THEN ' does not contain the value "' || literal || '", but it contains a value "' || match_value || '" '
          ELSE ' does not contain value "' || literal || '", but the column ' || match_tbl || '.' || match_col || ' contains value "' || match_value || '"' END,
          '' ORDER BY n) AS feedback
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probe_id) AS n FROM (
        SELECT p.probe_id, p.probe_id // 3 AS query_id, p.tbl, p.col, p.literal, match_tbl, match_col, match_value, [[v]] AS verdict FROM <<probes>> p
        JOIN <<calibrated>> c ON c.tbl = p.tbl AND c.col = p.col AND c.literal = p.literal) x WHERE verdict <> 'fine') y GROUP BY query_id""",
        v=_VERDICT,
    ),
)
def feedback(t):
    judged = vals.mismatch(calibrated(t)).withColumn("query_id", F.expr("probe_id div 3"))
    return vals.feedback(judged, "query_id", "probe_id")


@plan(
    "v16_eligible",
    oracle(
        """SELECT query_id, probe_id, split_part(target, '.', 1) AS tbl, split_part(target, '.', 2) AS col, replace(literal, '"', '') AS literal
        FROM (SELECT *, unnest(string_split(literals, '|')) AS literal FROM <<predicates>>) x
        WHERE NOT contains(lower(sql_text), 'like') AND len(string_split(target, '.')) = 2 AND NOT contains(literal, '.')"""
    ),
)
def eligible(t):
    pairs = vals.predicate_pairs(view(t, "predicates"))
    return vals.eligible(pairs).select("query_id", "probe_id", "tbl", "col", "literal")


@plan(
    "v17_predicate_pairs",
    oracle(
        """SELECT query_id, probe_id, target, unnest(range(len(l))) AS item, unnest(l) AS literal
        FROM (SELECT *, string_split(literals, '|') AS l FROM <<predicates>>) x"""
    ),
)
def predicate_pairs(t):
    pairs = vals.predicate_pairs(view(t, "predicates"))
    return pairs.select("query_id", "probe_id", "target", F.col("item").cast("bigint").alias("item"), "literal")
