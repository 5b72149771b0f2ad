"""Clean-up of SQL and text held in a string column.

All functions are Column -> Column and stay inside the JVM: a text is taken apart with
``regexp_extract_all`` and put together again inside its own row, so nothing shuffles.
The patterns use only what Java's and RE2's regular expressions share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask word, the allowed aggregate functions and the structure keywords.
SLOT = "valuerare"
ALLOWED_FUNCTIONS = ["AVG", "MAX", "SUM", "COUNT", "MIN"]
STRUCTURE_KEYWORDS = [
    "SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "INTERSECT", "UNION", "EXCEPT",
]
CURRENT_YEAR = "2020"

QUOTED = r"""'[^']*'|"[^"]*\""""
QUOTED_OR_NOT = QUOTED + r"""|[^'"]+|['"]"""
WORD_OR_NOT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
YEAR_NOW = r"(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)\s*"
COMPARISON = (
    r"(?i)\b(?:([a-z_][a-z0-9_]*)\.)?([a-z_][a-z0-9_]*)\b\s*(?:>=|<=|!=|<>|=|<|>|\blike\b)\s*"
    r"""('[^']*'|"[^"]*"|-?[0-9]+(?:\.[0-9]+)?)"""
)
_BOUND = r"""('[^']*'|"[^"]*"|[-+]?[0-9]+(?:\.[0-9]+)?|[a-z_][a-z0-9_.]*)"""
BETWEEN = rf"(?i)\b(?:([a-z_][a-z0-9_]*)\.)?([a-z_][a-z0-9_]*)\s+between\s+{_BOUND}\s+and\s+{_BOUND}"
NUMBER_TOKEN = r"^[(<>=!,+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"  # with an operator or bracket that sticks to it


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_line(c: Column) -> Column:
    """Line breaks to blanks, runs of blanks to one, ``<>`` to ``!=``."""
    return F.replace(F.regexp_replace(F.translate(c, "\r\n", "  "), " +", " "), F.lit("<>"), F.lit("!="))


def sql_in_reply(c: Column) -> Column:
    """The query inside a chatty reply: a fenced part first, else from the first SELECT on."""

    def from_word(word: str) -> Column:
        return F.substr(c, F.instr(c, word))

    return (
        F.when(F.lower(F.left(c, F.lit(6))) == "select", c)
        .when(F.contains(c, F.lit("```")), F.element_at(F.split(c, "```"), 2))
        .when(F.contains(c, F.lit("SELECT")), from_word("SELECT"))
        .when(F.contains(c, F.lit("select")), from_word("select"))
        .otherwise(c)
    )


def lower_outside_quotes(c: Column) -> Column:
    """Lower-case every word that does not touch a quotation mark."""

    def join(parts: Column) -> Column:
        def cased(part: Column, i: Column) -> Column:
            before = F.coalesce(F.get(parts, i - 1), F.lit(""))
            after = F.coalesce(F.get(parts, i + 1), F.lit(""))
            free = ~F.right(before, F.lit(1)).isin("'", '"') & ~F.left(after, F.lit(1)).isin("'", '"')
            return F.when(free, F.lower(part)).otherwise(part)

        return F.array_join(F.transform(parts, cased), "")

    return let(_all(c, WORD_OR_NOT), join)


def squeeze(c: Column) -> Column:
    """One blank between words and none before commas."""
    return F.replace(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(" , "), F.lit(", "))


def join_operators(c: Column) -> Column:
    for apart, joined in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        c = F.replace(c, F.lit(apart), F.lit(joined))
    return c


def drop_last_semicolon(c: Column) -> Column:
    return F.regexp_replace(c, ";$", "")


def drop_distinct(c: Column) -> Column:
    """Remove the word DISTINCT wherever it stands outside quotation marks."""
    parts = F.transform(
        _all(c, QUOTED_OR_NOT),
        lambda p: F.when(p.rlike("^['\"]"), p).otherwise(F.regexp_replace(p, r"(?i)\bdistinct\b", "")),
    )
    return F.array_join(parts, "")


def fix_current_year(c: Column) -> Column:
    return F.regexp_replace(c, YEAR_NOW, CURRENT_YEAR)


def forbidden_functions(c: Column) -> Column:
    """Names called as functions that are not among the allowed aggregates."""
    return F.array_except(_all(c, r"([A-Z]+)\(", 1), F.array(*map(F.lit, ALLOWED_FUNCTIONS)))


def _bare_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, QUOTED, SLOT.upper()), r"\s+"), lambda x: x != "")


def _is_number_token(x: Column) -> Column:
    return x.rlike(NUMBER_TOKEN)


def masked_tokens(c: Column) -> Column:
    """Lower-case tokens with every literal replaced by the slot word."""
    return F.split(
        F.array_join(
            F.transform(
                _bare_tokens(c),
                lambda x: F.when(_is_number_token(x), F.lit(SLOT))
                .when(x.rlike(r"[Tt][0-9]+\."), F.lower(F.replace(x, F.lit("."), F.lit(" . "))))
                .otherwise(F.lower(x)),
            ),
            " ",
        ),
        " ",
    )


def literal_set(c: Column) -> Column:
    """Distinct string, decimal and integer literals, sorted."""
    numbers = F.filter(_bare_tokens(c), _is_number_token)
    return F.array_sort(F.array_distinct(F.concat(_all(c, QUOTED), numbers)))


def slot_segments(tokens: Column) -> Column:
    """The masked text cut at its slots: one segment more than there are slots."""
    marked = F.transform(tokens, lambda x: F.when(x == SLOT, F.lit("\x01")).otherwise(x))
    return F.split(F.array_join(marked, " "), "\x01")


def filled(segments: Column, values: Column, variant: Column) -> Column:
    """Fill the slots with the ``variant``-th combination; the last slot changes fastest."""
    n_values = F.size(values).cast("bigint")

    def piece(segment: Column, i: Column) -> Column:
        digit = F.floor(variant / F.pow(n_values, F.size(segments) - 1 - i)) % n_values
        return F.when(i == 0, segment).otherwise(F.concat(F.get(values, digit.cast("int")), segment))

    return F.array_join(F.transform(segments, piece), "")


def variant_count(segments: Column, values: Column) -> Column:
    """How many texts there are to try: the unchanged one and each way of filling the slots, one if there are none."""
    return (F.pow(F.size(values), F.size(segments) - 1) + 1).cast("bigint")


def variant_text(own: Column, segments: Column, values: Column, variant: Column) -> Column:
    """Number 0 is the text as it is, number n the (n - 1)-th combination of values in its slots."""
    return F.when(variant == 0, own).otherwise(filled(segments, values, variant - 1))


def drop_inner(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("INNER "), F.lit("")), F.lit("inner "), F.lit(""))


def plain_star(c: Column) -> Column:
    """``T1.*`` to ``*``; semicolons and tabs go."""
    return F.regexp_replace(F.translate(F.trim(c), ";\t", ""), r"[tT][1-3]\.\*", "*")


def unquote(c: Column) -> Column:
    """Strip one quotation mark at each end, then undouble the rest."""
    c = F.regexp_replace(F.regexp_replace(c, "^[`'\"]", ""), "[`'\"]$", "")
    for mark in "`'\"":
        c = F.replace(c, F.lit(mark * 2), F.lit(mark))
    return c


def comparisons(c: Column) -> Column:
    """array<struct<tbl, col, literal>> of typed comparisons and both ends of each BETWEEN."""

    def part(x: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(x, pattern, group)

    def row(tbl: Column, x: Column, pattern: str, literal: Column) -> Column:
        return F.struct(
            F.lower(tbl).alias("tbl"), F.upper(part(x, pattern, 2)).alias("col"), literal.alias("literal")
        )

    def typed(x: Column) -> Column:
        tbl = part(x, COMPARISON, 1)
        known = F.when((tbl != "") & ~tbl.rlike("^[tT][0-9]$"), tbl)
        return row(known, x, COMPARISON, unquote(part(x, COMPARISON, 3)))

    def both_ends(x: Column) -> Column:
        known = F.nullif(part(x, BETWEEN, 1), F.lit(""))
        return F.array(*(row(known, x, BETWEEN, unquote(part(x, BETWEEN, end))) for end in (3, 4)))

    # One pass finds the few comparisons of a text; their parts are read from the short hits.
    # Most texts hold no BETWEEN, and the plain test spares them the costlier pattern.
    has_between = F.contains(F.lower(c), F.lit("between"))
    return F.concat(
        F.transform(_all(c, COMPARISON), typed),
        F.when(has_between, F.flatten(F.transform(_all(c, BETWEEN), both_ends))).otherwise(
            F.array().cast("array<struct<tbl:string,col:string,literal:string>>")
        ),
    )


def alias_entries(c: Column) -> Column:
    """array<struct<alias, tbl>> of every ``<table> AS t1`` … ``t4``."""
    low = F.lower(c)
    pattern = r"\b([a-z_][a-z0-9_]*)\b as (t[1-4])\b"
    return F.arrays_zip(_all(low, pattern, 2).alias("alias"), _all(low, pattern, 1).alias("tbl"))


def select_text(c: Column, aliases: Column) -> Column:
    """Lower-cased text before the first `` from ``, with aliases spelled out."""
    head = F.substring_index(F.lower(c), " from ", 1)
    wanted = F.filter(aliases, lambda e: F.contains(head, e["alias"]))
    return F.aggregate(F.array_sort(wanted), head, lambda acc, e: F.replace(acc, e["alias"], e["tbl"]))


def double_quotes(c: Column) -> Column:
    return F.translate(c, "'", '"')


def value_word_to_one(c: Column) -> Column:
    return F.replace(c, F.lit("value"), F.lit("1"))


def tolerant_decode(c: Column) -> Column:
    """Binary to string: UTF-8 where the bytes are valid, else Latin-1."""
    as_text = c.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(c, "ISO-8859-1"))


def number_or_null(c: Column) -> Column:
    """The text as a number, null when it is none; a Java suffix (1d, 1f) makes it none."""
    return F.when(F.trim(c).rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), F.trim(c).try_cast("double"))
