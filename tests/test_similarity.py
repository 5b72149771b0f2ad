"""Similarity, search and linking against brute force on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import similarity as sim
from quillcheck.operators import linking as ln
from quillcheck.operators import search as srch
from quillcheck.operators import values as vals
from quillcheck.operators import vectors as vec


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b):
            nxt.append(row[j] + 1 if x == y else max(row[j + 1], nxt[j]))
        row = nxt
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def words(rng, n, letters="abcde", longest=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_kernel_equals_plain_recurrence():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 90))) for _ in range(120)] + ["", "a" * 64, "ab" * 40]
    block = sim.ValueBlock(texts)
    for probe in texts[::7]:
        expected = [lcs(probe, t) for t in texts]
        assert block.lcs(probe).tolist() == expected
        assert [sim.lcs_length(probe, t) for t in texts] == expected


@pytest.mark.parametrize("most", [0, 20_000])
def test_search_is_the_true_best(spark, monkeypatch, most):
    monkeypatch.setattr(srch, "VALUES_PER_BLOCK", 7)
    monkeypatch.setattr(srch, "PROBES_PER_GROUP", 9)
    monkeypatch.setattr(srch, "MOST_CANDIDATES", most)
    monkeypatch.setattr(srch, "BLOCKS_PER_PART", 3)
    monkeypatch.setattr(srch, "FIRST_BLOCKS", 1)
    rng = random.Random(2)
    index = sorted({(c, w) for c in ("x", "y") for w in words(rng, 60)})
    probes = sorted({(c, w) for c in ("x", "y") for w in words(rng, 25)})
    i = spark.createDataFrame(index, "col string, value string")
    p = spark.createDataFrame(probes, "col string, literal string")

    def score(a, b):
        return round(100 * ratio(a, b)) / 100

    def ranked(col, literal):
        found = [(-score(literal, v), v != literal, v) for c, v in index if c == col]
        return sorted(found)

    best = {(r["col"], r["literal"]): (-r["score"], not r["exact"], r["value"]) for r in vals.search(p, i, ["col"]).collect()}
    assert best == {k: ranked(*k)[0] for k in probes}
    top3 = {}
    for r in vals.search(p, i, ["col"], k=3).collect():
        top3.setdefault((r["col"], r["literal"]), {})[r["place"]] = r["value"]
    assert top3 == {k: {n + 1: x[2] for n, x in enumerate(ranked(*k)[:3])} for k in probes}
    above = {(r["col"], r["literal"]): r["value"] for r in vals.search(p, i, ["col"], above=0.65).collect()}
    assert above == {k: ranked(*k)[0][2] for k in probes if -ranked(*k)[0][0] > 0.65}


def test_near_values_are_all_found(spark):
    """Every pair at the near score comes out of the gram index, whatever the lengths."""
    rng = random.Random(12)
    stems = words(rng, 40, "abcd12_", 16)
    def twisted(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and w:
                w[min(at, len(w) - 1)] = rng.choice("abcd ")
            elif rng.random() < 0.5:
                w.insert(at, rng.choice("abcd12"))
            else:
                del w[at : at + 1]
        return "".join(w)
    values = sorted({(rng.choice("xy"), twisted(w)) for w in stems for _ in range(6)} | {("x", "aaaaaaaa"), ("x", "aaaaaaab"), ("y", ""), ("y", "--"), ("x", "é")})
    literals = sorted({twisted(w) for w in stems for _ in range(2)} | {"aaaaaaa", "", "a", "ab", "ba"})
    s = srch.Searchable(spark.createDataFrame(values, "col string, value string"))
    got = {(r["literal"], r["col"], r["value"], r["score"]) for r in s.near(spark.createDataFrame([(x,) for x in literals], "literal string")).collect()}
    norm = lambda t: " ".join(sorted("".join(c if c.isascii() and (c.isalnum() or c == "_") else "" if not c.isascii() else " " for c in t).lower().split()))
    score = lambda a, b: round(100 * ratio(norm(a), norm(b))) / 100 if norm(a) and norm(b) else 0.0
    want = {(x, c, v, score(x, v)) for x in literals for c, v in values if score(x, v) >= srch.NEAR}
    assert got == want and len(want) > 100


def test_search_in_other_tables_and_columns(spark, monkeypatch):
    monkeypatch.setattr(srch, "VALUES_PER_BLOCK", 5)
    rng = random.Random(13)
    values = sorted({(t, c, w) for t in ("s", "t", "u") for c in ("x", "y") for w in words(rng, 30, "abc", 6)})
    probes = [(t, c, w) for t in ("s", "t") for c in ("x", "y") for w in words(rng, 12, "abcz", 7)] + [("s", "x", "zzz"), ("v", "x", "abc"), ("s", "x", None), ("s", "y", "")]
    index = spark.createDataFrame([*values, ("s", "x", None)], "tbl string, col string, value string")
    asked = spark.createDataFrame(probes, "tbl string, col string, literal string")
    score = lambda a, b: round(100 * ratio(a, b)) / 100 if a and b else 0.0

    def best(literal, rows):
        return min(((-score(literal, v), v != literal, v, t, c) for t, c, v in rows), default=None)

    for above in (None, 0.65):
        keep = lambda b: b is not None and (above is None or -b[0] > above)  # noqa: E731, B023
        got = {(r["tbl"], r["literal"]): (-r["score"], r["value"], r["found_tbl"], r["found_col"]) for r in vals.best_elsewhere(asked, index, above=above).collect()}
        want = {(t, w): best(w, [r for r in values if r[0] != t]) for t, _, w in probes if w is not None}
        assert got == {k: (b[0], *b[2:]) for k, b in want.items() if keep(b)}
        got = {(r["tbl"], r["own_col"], r["literal"]): (-r["score"], r["value"], r["found_col"]) for r in vals.best_in_table(asked, index, exclude_own=True, above=above).collect()}
        want = {(t, c, w): best(w, [r for r in values if r[0] == t and r[1] != c]) for t, c, w in probes if w is not None}
        assert got == {k: (b[0], b[2], b[4]) for k, b in want.items() if keep(b)}


def test_linking_loses_no_pair(spark):
    rng = random.Random(3)
    spans = sorted(set(words(rng, 400, "ab", 14) + words(rng, 200, "abc ", 20)))
    spans = [s for s in spans if s.strip() == s]
    keys = sorted(set(words(rng, 300, "ab", 14) + words(rng, 100, "abc ", 20)))
    keys = [k for k in keys if k.strip() == k]
    for threshold in (0.85, 0.7):
        found = ln.close_pairs(
            spark.createDataFrame([(s,) for s in spans], "span string"), spark.createDataFrame([(k,) for k in keys], "key string"), threshold
        )
        got = {(r["span"], r["key"]) for r in found.collect()}
        want = {(s, k) for s in spans for k in keys if s[0] == k[0] and ratio(s, k) >= threshold}
        assert got == want


def test_mentions_of_a_sentence(spark):
    texts = spark.createDataFrame([("Show the furniture's price in St. Louis, or New Yorke?",)], "question string")
    index = spark.createDataFrame(
        [("shop", "kind", "Furniture"), ("shop", "city", "St. Louis"), ("shop", "city", "New York"), ("shop", "city", "NEW YORKER"),
         ("shop", "city_name", "New York"), ("shop", "kind", "the"), ("shop", "kind", "id")],
        "tbl string, col string, value string",
    )
    found = ln.top_mentions(ln.mentions(texts, "question", index), "question")
    got = {(r["col"], r["value"], r["place"]) for r in found.collect()}
    # A near match does not count for a column of names, nor for a value in capitals.
    assert got == {("kind", "Furniture", 1), ("city", "St. Louis", 1), ("city", "New York", 2)}


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("skip", [True, False])
def test_nearest_vector(spark, monkeypatch, k, skip):
    """Against all pairs, with clusters, copies, null vectors and vectors without direction on both sides."""
    monkeypatch.setattr(vec, "VECTORS_PER_BLOCK", 5)
    monkeypatch.setattr(vec, "PIVOTS", 6)
    monkeypatch.setattr(vec, "FIRST_BLOCKS", 1)
    rng = random.Random(4)
    centres = [[rng.random() - 0.5 for _ in range(4)] for _ in range(5)]
    some = lambda: [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]
    rows = [(n % 2, n, some() if n % 3 else [rng.random() - 0.5 for _ in range(4)]) for n in range(90)]
    rows += [(0, 100, rows[0][2]), (0, 101, rows[0][2]), (0, 102, None), (1, 103, None), (0, 104, [0.0] * 4), (2, 105, None), (2, 106, [1.0, 0.0, 0.0, 0.0]), (3, 107, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "label int, id bigint, vector array<double>").repartition(3)

    def cosine(a, b):
        if a is None or b is None:
            return -1.0
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    want = {}
    for label, n, v in rows:
        others = sorted((-cosine(v, w), m) for lab, m, w in rows if lab == label and not (skip and m == n))
        want[n] = [m for _, m in others[:k]]
    got = {n: [] for n in want}
    for r in vec.nearest(df, df, ["label"], k=k, skip_same=skip).orderBy("id", F.desc("score"), "other_id").collect():
        got[r["id"]].append(r["other_id"])
    assert got == want


def test_vectors_meet_in_full_blocks_and_small_tiles(spark, monkeypatch):
    """Rows spread over many tasks are not cut into as many blocks; tiles of few probes and blocks lose no pair."""
    monkeypatch.setattr(vec, "VECTORS_PER_BLOCK", 20)
    monkeypatch.setattr(vec, "PIVOTS", 2)
    monkeypatch.setattr(vec, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(vec, "BLOCKS_PER_TILE", 2, raising=False)
    monkeypatch.setattr(vec, "PROBES_PER_TILE", 7, raising=False)
    rng = random.Random(6)
    rows = [(n % 2, n, [rng.gauss(0, 1) for _ in range(12)]) for n in range(240)]
    df = spark.createDataFrame(rows, "label int, id bigint, vector array<double>").repartition(16)
    assert vec.VectorIndex(df, ["label"]).blocks.count() <= 32

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)

    want = {n: min((-cosine(v, w), m) for lab, m, w in rows if lab == label and m != n)[1] for label, n, v in rows}
    assert {r["id"]: r["other_id"] for r in vec.nearest(df, df, ["label"], skip_same=True).collect()} == want


def test_nearest_over_several_tables(spark, monkeypatch):
    """With ``per`` the best is taken over all places that a probe is asked for."""
    monkeypatch.setattr(vec, "VECTORS_PER_BLOCK", 3)
    rng = random.Random(5)
    values = [(t, n, [rng.gauss(0, 1) for _ in range(3)]) for n, t in enumerate("abc" * 12)]
    index = spark.createDataFrame(values, "tbl string, id bigint, vector array<double>")
    probes = [(own, t, n, values[n][2][::-1]) for own in "ab" for n in range(8) for t in "abc" if t != own]
    found = vec.nearest(spark.createDataFrame(probes, "own string, tbl string, id bigint, vector array<double>"), index, ["tbl"], per=["own"]).collect()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = {(own, n): max((round(cosine(values[n][2][::-1], w), 6), -m) for t, m, w in values if t != own) for own in "ab" for n in range(8)}
    assert {(r["own"], r["id"]): (r["score"], -r["other_id"]) for r in found} == want


def test_calibration_stages(spark):
    index = spark.createDataFrame(
        [("shop", "city", "Paris"), ("shop", "city", "Rome"), ("shop", "kind", "bakery"), ("bank", "place", "Geneva"), ("shop", "size", "12")],
        "tbl string, col string, value string",
    )
    probes = spark.createDataFrame(
        [(1, "shop", "city", " paris "), (2, "shop", "city", "Bakery"), (3, "shop", "city", "Pariss"), (4, "shop", "city", "bakry"),
         (5, "shop", "city", "Genevaa"), (6, "shop", "city", "zzz"), (7, "shop", "size", "13"), (8, "shop", "void", "qqq")],
        "id int, tbl string, col string, literal string",
    )
    got = {r["id"]: (r["stage"], r["match_tbl"], r["match_col"], r["match_value"]) for r in vals.calibrate(probes, index).collect()}
    assert got[1] == (1, "shop", "city", None)
    assert got[2] == (2, "shop", "kind", "bakery")
    assert got[3] == (3, "shop", "city", "Paris")
    assert got[4] == (4, "shop", "kind", "bakery")
    assert got[5] == (5, "bank", "place", "Geneva")
    assert got[6][:3] == (6, "shop", "city") and got[6][3] in ("Paris", "Rome")
    # Two numbers are never replaced by each other.
    assert got[7] == (6, "shop", "size", None)
    # A column without values has no candidate.
    assert got[8] == (6, "shop", "void", None)


def test_mentions_are_those_of_all_runs(spark, monkeypatch):
    """Mentions of random texts against every run of words and every value, with a hot run."""
    from quillcheck.functions.wordlists import COMMON_WORDS, DATABASE_TERMS, STOP_WORDS
    from quillcheck.operators import skew

    monkeypatch.setattr(skew, "ROWS_PER_PART", 3)
    rng = random.Random(21)
    vocabulary = ["blue anvil", "Red Ring", "KNOT", "id", "the", "12", "St. Louis", "new yorker", "many", "b", "Économie", "a'b", "name", "yes"]
    index = [("t", c, v) for c in ("c", "d_name") for v in rng.sample(vocabulary, 9)] + [("u", "e", v) for v in vocabulary] + [("u", "e", None)]
    said = ["blue", "anvil", "blu", "anvill", "red", "ring", "rings,", "knot", "st.", "louis", "st", "new", "yorkers", "id", "the", "many", "économi", "b", "12", "a'b", "yes?", "é"]
    texts = [" ".join(rng.choice(said) for _ in range(rng.randint(0, 14))) for _ in range(40)] + ["", " ", None, "blue anvil", "blue anvil", "x blue anvil y"]

    def run_of(key, span):
        best = max((n, -i) for n in range(1, len(key) + 1) for i in range(len(key) - n + 1) if key[i : i + n] in span) if set(key) & set(span) else (0, 0)
        return -best[1], best[0]

    def usable(key, span, score):
        at, n = run_of(key, span)
        run = key[at : at + n].strip(" ")
        three = {run, span, key}
        number = run.replace(",", "").isdigit()
        return n and run and not number and run not in DATABASE_TERMS and not three & set(STOP_WORDS) and (not three & set(COMMON_WORDS) or score >= 1)

    want = set()
    for text in {t for t in texts if t is not None}:
        spans = set(ln.runs(text))
        found = {}
        for tbl, col, value in index:
            if value is None:
                continue
            value, key = value.strip(" "), value.strip(" ").lower()
            hits = []
            for s in spans:
                score = ratio(s, key)
                if s[0] == key[0] and score >= 0.85 and usable(key, s, score) and (score >= 1 or not (value.upper() == value and value.lower() != value)):
                    at, n = run_of(key, s)
                    hits.append((score, n, value[at : at + n]))
            if hits:
                score, n, run = max(hits)
                found.setdefault((tbl, col, run), []).append((value, score, n))
        want |= {(text, tbl, col, *max(v)) for (tbl, col, _), v in found.items()}
    i = spark.createDataFrame(index, "tbl string, col string, value string")
    got = ln.mentions(spark.createDataFrame([(t,) for t in texts], "q string"), "q", i)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40


def test_runs_of_words():
    text = " The (big) House's, end.. "
    assert list(ln.runs(text)) == ["the", "the (big", "the (big) house", "the (big) house's", "the (big) house's, end", "big", "big) house", "big) house's", "big) house's, end", "house", "house's", "house's, end", "s, end", "end"]
    assert list(ln.runs(text, [3, 5])) == ["the", "big", "house", "end"] and list(ln.runs(text, [])) == [] and list(ln.runs("")) == []


def test_the_sieve_keeps_all_runs_with_a_partner_and_few_others(spark):
    rng = random.Random(8)
    keys = ["blue anvil", "économie", "customer#000000012", "5-low", "12345.67", "ab", "?!", "a" * 40, "Ñandú 𝒳 y"]
    said = ["blue", "anvill", "anvil,", "blu", "économi", "customer#000000021", "5-low", "12345.76", "ab", "ba", "a" * 38, "the", "tion", "anvthil", "Ñandú", "𝒳", "y", "b.", ""]
    texts = [" ".join(rng.choice(said) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", " ", "blue anvil"]
    index = ln.key_index(spark.createDataFrame([(k,) for k in keys], "key string"))
    sieve = ln.Sieve.of(index)
    got = list(sieve.runs(texts))
    every = {(k, run) for k, t in enumerate(texts) for run in ln.runs(t, ln.span_lengths(index))}
    want = {(k, run) for k, run in every if any(run[0] == key.lstrip(ln.SEPARATORS)[:1] and ratio(run, key) >= ln.THRESHOLD for key in keys)}
    assert len(got) == len(set(got)) and want <= set(got) <= every and 4 * len(got) < len(every) and len(want) > 100
    named = spark.createDataFrame([(t,) for t in texts + [None]], "q string")
    assert {r["span"] for r in ln.spans(named, "q", sieve).collect()} == {run for _, run in got}


def test_pairs_that_share_one_rare_gram_alone_are_not_scored(spark, monkeypatch):
    from quillcheck.operators import grams

    numbers = [f"{rng_.randint(10**7, 10**8 - 1)}" for rng_ in [random.Random(4)] for _ in range(400)]
    asked, held = sorted(set(numbers[:200])), sorted(set(numbers[200:] + numbers[:20]))
    index = grams.GramIndex(spark.createDataFrame([(h,) for h in held], "text string"), 0.85)
    tried = spark.sparkContext.accumulator(0)
    real = grams._scored

    def counted(ratio_):
        def each(batches):
            for batch in batches:
                tried.add(batch.num_rows)
                yield from real(ratio_)(iter([batch]))

        return each

    monkeypatch.setattr(grams, "_scored", counted)
    got = {(r["asked"], r["text"]) for r in index.partners(spark.createDataFrame([(a,) for a in asked], "asked string")).collect()}
    assert got == {(a, h) for a in asked for h in held if ratio(a, h) >= 0.85} and len(got) >= 20
    assert tried.value < 1000


def test_numbers_are_never_scored_for_mentions(spark, monkeypatch):
    """A piece of a number is a number, which is no mention; texts full of numbers meet an index full of them."""
    from quillcheck.operators import grams

    rng = random.Random(9)
    prices = [f"{rng.choice(['', '-'])}{rng.randint(100, 99999)}.{rng.randint(0, 99)}" for _ in range(300)] + [str(rng.randint(10**6, 10**7)) for _ in range(300)]
    others = ["1.25E7", "1995-01-02 00:00:00", "12,5", "1.2.3", "5-LOW", "+12", "1e", "7\n", "Brand#7", "12 34", "٣٤"]
    index = spark.createDataFrame([("t", "price", p) for p in prices] + [("t", "other", o) for o in others], "tbl string, col string, value string")
    near = [*others, "1995-01-03 00:00:00", "brand#77", "1.26e7"]
    texts = [" ".join(rng.choice(prices if rng.random() < 0.7 else near) for _ in range(30)) for _ in range(20)]
    asked = spark.createDataFrame([(t,) for t in texts], "q string")
    tried = spark.sparkContext.accumulator(0)
    real = grams._scored

    def counted(ratio_):
        def each(batches):
            for batch in batches:
                tried.add(batch.num_rows)
                yield from real(ratio_)(iter([batch]))

        return each

    monkeypatch.setattr(grams, "_scored", counted)
    got = {tuple(r) for r in ln.mentions(asked, "q", index).collect()}
    few = tried.value
    want = {tuple(r) for r in ln.mentions(asked, "q", index, keys=ln.key_index(ln.keys_of(index))).collect()}
    assert got == want and len(got) > 30 and {"5-LOW", "1995-01-02 00:00:00"} <= {r[3] for r in got}
    assert 0 < few and few * 4 < tried.value - few


def test_the_run_of_a_number_and_a_near_text_is_a_number(spark):
    rng = random.Random(10)
    keys, near = [], []
    for _ in range(6000):
        key = rng.choice(["", "-"]) + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 12))) + rng.choice(["", "." + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 12)))])
        text = list(key)
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randint(0, len(text)), rng.choice("x-.,1 ")) if rng.random() < 0.6 or not text else text.pop(rng.randrange(len(text)))
        keys.append(key)
        near.append("".join(text))
    at, size = ln.longest_runs(keys, near)
    runs = [k[a : a + n] for k, t, a, n in zip(keys, near, at, size) if len(t) > 1 and ratio(k, t) >= ln.THRESHOLD]
    told = spark.createDataFrame([(r,) for r in set(runs)], "run string").select(F.min(ln.is_number(F.col("run")))).first()[0]
    assert told and len(runs) > 2000
    assert ln.mentionable(spark.createDataFrame([(k,) for k in keys], "key string")).count() == 0
    assert ln.mentionable(spark.createDataFrame([("1.5",), ("15",)], "key string"), 0.5).collect() == [("1.5",)]


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("skip", [True, False])
def test_values_without_vector_are_in_no_block(spark, monkeypatch, k, skip):
    """They, and probes without vector or direction, are answered by the least ids; a vector with a NaN or infinity in it is none."""
    monkeypatch.setattr(vec, "VECTORS_PER_BLOCK", 4)
    monkeypatch.setattr(vec, "FIRST_BLOCKS", 1)
    rng = random.Random(12)
    none = [None, [float("nan"), 1.0], [float("inf"), 0.0], [None, 2.0]]
    rows = [(n % 4, n, rng.choice(none) if n % 5 or n % 4 == 3 else [0.0, 0.0] if n % 25 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1)]) for n in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "label int, id bigint, vector array<double>").repartition(3)
    index = vec.VectorIndex(df, ["label"])
    held = {n: v for _, n, v in rows if v is not None and None not in v and all(abs(x) < 1e9 for x in v)}
    assert sorted(n for r in index.blocks.collect() for n in r["ids"]) == sorted(held) and 30 < len(held) < 60

    def cosine(m, n):
        if m not in held or n not in held:
            return -1.0
        a, b = held[m], held[n]
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    want = {}
    for label, n, _ in rows:
        want[n] = [(m, -c) for c, m in sorted((-cosine(n, m), m) for other, m, _ in rows if other == label and not (skip and m == n))[:k]]
    got = {n: [] for n in want}
    for r in vec.nearest(df, index, ["label"], k=k, skip_same=skip).orderBy("id", F.desc("score"), "other_id").collect():
        got[r["id"]].append((r["other_id"], r["score"]))
    assert got == want


def test_calibration_by_vectors_holds_few_values_without_vector(spark):
    entries = [("shop", "name", f"Item {n:03d}") for n in range(200)] + [("shop", "kind", v) for v in ("red ring", "red red knot", "b", "", "zz")]
    entries += [("shop", "size", "12"), ("bank", "place", "blue ring"), ("bank", "place", "Ring"), ("bank", "code", "aa")]
    tokens = spark.createDataFrame([("red", [1.0, 0.0]), ("ring", [0.0, 1.0]), ("blue", [-1.0, 0.0]), ("b", [1.0, 1.0]), ("zz", None)], "token string, embedding array<double>")
    searched = srch.Searchable(spark.createDataFrame(entries, "tbl string, col string, value string"))
    by = vals.ByVector(searched, tokens)
    asked = [(1, "shop", "name", "nothing"), (2, "shop", "kind", "rings red"), (3, "shop", "name", "rings blue"), (4, "shop", "name", "RING!"), (5, "shop", "size", "13"), (6, "shop", "name", "knot"), (7, "shop", "void", "x"), (8, "shop", "kind", "abc")]
    probes = spark.createDataFrame(asked, "id int, tbl string, col string, literal string")
    got = {r["id"]: (r["stage"], r["match_tbl"], r["match_col"], r["match_value"]) for r in vals.calibrate(probes, searched, by).collect()}
    assert got == {
        1: (6, "shop", "name", "Item 000"),  # no vector: the least value of the column
        2: (3, "shop", "kind", "red red knot"),  # "red" alone is known of both
        3: (5, "bank", "place", "blue ring"),
        4: (4, "shop", "kind", "b"),  # as near as "red ring", and before it
        5: (6, "shop", "size", None),  # a number for a number
        6: (6, "shop", "name", "Item 000"),
        7: (6, "shop", "void", None),
        8: (3, "shop", "kind", "b"),  # by its one known letter
    }
    rows = by.values.collect()
    assert {(r["col"], r["value"]) for r in rows if r["vector"] is None} <= {("name", "Item 000"), ("kind", ""), ("size", "12")} and len(rows) < 12
    means = {r["value"]: r["vector"] for r in vec.mean_of_tokens(spark.createDataFrame([(v,) for v in ("red Red, blue", "abba", "b ring", "zz", "", None, "abba")], "value string"), tokens).collect()}
    third = pytest.approx(1 / 3)
    assert means.pop("red Red, blue") == [third, 0.0] and means == {"abba": [1.0, 1.0], "b ring": [0.5, 1.0], "zz": None, "": None, None: None}


def test_linked_values_are_named_by_digests(spark):
    """Copies of a text and texts without a mention; the text itself comes back with the digest only."""
    index = spark.createDataFrame([("t", "kind", "Furniture"), ("t", "city", "St. Louis"), ("t", "city", "Rome")], "tbl string, col string, value string")
    texts = spark.createDataFrame([(1, "furnitures in rome"), (2, "furnitures in rome"), (3, "nothing"), (4, None), (5, "St. Louis, Rome")], "id int, q string")
    found = ln.named_linked_values(texts, "q", index)
    assert found.columns == ["of", "tbl", "col", "values"]
    by_id = {tuple(r)[:3] + (tuple(r["values"]),) for r in texts.select("id", ln.digest(F.col("q"))).join(found, "of").select("id", "tbl", "col", "values").collect()}
    assert by_id == {(n, "t", c, v) for n in (1, 2) for c, v in (("kind", ("Furniture",)), ("city", ("Rome",)))} | {(5, "t", "city", ("St. Louis", "Rome"))}
    assert {r["q"] for r in ln.linked_values(texts, "q", index).collect()} == {"furnitures in rome", "St. Louis, Rome"}
