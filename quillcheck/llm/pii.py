"""Personal data in texts, with Spark's own functions only.

Patterns propose spans; number rules and checksums (Luhn for cards, mod 97 for IBANs) confirm them; words in front of a
span adjust its score. Places come from the text between the matches of a pattern: what ``split`` and
``regexp_extract_all`` return by turns adds up to the text.

The patterns take whole runs at once (possessive), so a scan is linear in the length of the text and needs no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.llm import free_prefix

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
NEAR = 40  # characters in front of a span, back to the match before, in which context counts
LEAST_SCORE = 0.5
_BLOCK = 256

PATTERNS = {
    # from the first character of a run, or right after the last match: later places of a run fare no better
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_HINT = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}  # a text without it has no match
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_CONTEXT = {
    "email": r"mail|contact|write|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|téléphone|teléfono|appel|llam",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|social-security",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The check of an IBAN without blanks: moved by four, letters as 10 to 35, the number leaves 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda m: m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return lambda m: F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return lambda m: mod97(F.replace(m, F.lit(" "), F.lit("")))
    return lambda m: F.lit(True)


def _zip(fields: str, *arrays: Column) -> Column:
    """Arrays of one length as an array of structs; ``fields`` names and types them."""
    return F.arrays_zip(*arrays).cast(f"array<struct<{fields}>>")


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of a non-empty array of longs (from 0), in two levels, so that none is copied very often."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long"))
    n_blocks = F.ceil(F.size(values) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    inner = F.transform(blocks, lambda block: F.aggregate(block, none, lambda out, x: F.concat(out, F.array(combine(last(out), x)))))
    totals = F.aggregate(inner, F.array(F.lit(0).cast("long")), lambda out, block: F.concat(out, F.array(combine(last(out), last(block)))))
    both = _zip("own:array<bigint>,before:bigint", inner, F.slice(totals, F.lit(1), n_blocks))
    return F.flatten(F.transform(both, lambda z: F.transform(z["own"], lambda x: combine(x, z["before"]))))


def _places(matches: Column, between: Column) -> Column:
    """Array of (start, end, match, before) of a pattern's matches, from what it matches and what lies between."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string>>")
    gaps = F.slice(between, F.lit(1), F.size(matches))
    steps = F.transform(_zip("match:string,gap:string", matches, gaps), lambda z: (F.length(z["match"]) + F.length(z["gap"])).cast("long"))
    ends = _running(steps, lambda a, b: a + b)

    def place(z: Column) -> Column:
        return F.struct((z["end"] - F.length(z["match"])).alias("start"), z["end"].alias("end"), z["match"].alias("match"), F.right(z["gap"], F.lit(NEAR)).alias("before"))

    return F.when(F.size(matches) > 0, F.transform(_zip("match:string,gap:string,end:bigint", matches, gaps, ends), place)).otherwise(none)


def _scored(kind: str, places: Column) -> Column:
    def score(s: Column) -> Column:
        points = F.lit(_SCORE[kind]) + F.when(s["before"].rlike(f"(?i)(?:{_CONTEXT[kind]})"), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(points, F.lit(1.0)).alias("score"))

    kept = F.transform(F.filter(places, lambda s: _confirmed(kind)(s["match"])), score)
    return kept if _SCORE[kind] >= LEAST_SCORE else F.filter(kept, lambda s: s["score"] >= LEAST_SCORE)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` and a column ``out``: the spans found in each whole text, by kind as in ``KINDS``, then by start.

    Places are code points, ends exclusive. A null or empty text has no spans (an empty array). Every row is judged on
    its own, so nulls elsewhere, repeated rows and an empty table need no rule; helper columns have names that the
    table doesn't. The patterns of ``BASE`` are never dropped for their score.
    """
    tag = free_prefix(docs.columns, "__" + out)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.withColumns(
        {
            f"{tag}_m_{k}": F.when(F.contains(text, F.lit(_HINT[k])), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)))
            if k in _HINT
            else F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))
            for k in KINDS
        }
    )
    found = lambda k: F.col(f"{tag}_m_{k}")
    held = held.withColumns({f"{tag}_p_{k}": F.when(F.size(found(k)) > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    held = held.withColumns({f"{tag}_s_{k}": _places(found(k), F.col(f"{tag}_p_{k}")) for k in KINDS})
    every = F.concat(*(_scored(k, F.col(f"{tag}_s_{k}")) for k in KINDS)).cast(SPANS)
    return held.withColumn(out, every).select(*(f"`{c}`" for c in docs.columns), out)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first (and longest).

    ``spans`` are sorted by start, then longest first.
    """
    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    done = F.slice(F.concat(F.array(F.lit(0).cast("long")), ends), F.lit(1), F.size(spans))  # how far the spans before reach
    both = _zip("span:struct<kind:string,start:bigint,end:bigint,score:double>,done:bigint", spans, done)
    cuts = F.transform(both, lambda z: F.struct(z["done"].alias("done"), z["span"]["start"].alias("start"), F.greatest(z["span"]["end"], z["done"]).alias("end"), z["span"]["kind"].alias("kind")))

    def clear(block: Column) -> Column:  # a block of spans: its own part of the text is cut out once
        begin = F.get(block, F.lit(0))["done"]
        part = F.substring(text, (begin + 1).cast("int"), (F.get(block, F.size(block) - 1)["end"] - begin).cast("int"))

        def piece(c: Column, own: Column) -> Column:
            kept = F.substring(own, (c["done"] - begin + 1).cast("int"), F.greatest(c["start"] - c["done"], F.lit(0)).cast("int"))
            return F.concat(kept, F.when(c["start"] >= c["done"], F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise(""))

        return F.flatten(F.transform(F.array(part), lambda own: F.transform(block, lambda c: piece(c, own))))

    def joined(all_cuts: Column) -> Column:
        n_blocks = F.ceil(F.size(all_cuts) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(all_cuts, b * _BLOCK + 1, F.lit(_BLOCK)))
        rest = F.substring(text, (F.get(all_cuts, F.size(all_cuts) - 1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.flatten(F.transform(blocks, clear)), ""), rest)

    # transform over an array of one names a value, so that it is worked out once
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(cuts), joined), F.lit(0))).otherwise(text)


def in_order(spans: Column) -> Column:
    """Spans sorted by start, of those that begin together the longest first."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; a null text stays null, all rows and columns stay.

    ``length_col``: a column that holds the length of the text, set anew where the text has changed.
    """
    found = free_prefix(docs.columns, "pii_found")
    d = with_spans(docs, text_col, found).withColumn(found, in_order(F.col(found)))
    d = d.withColumn(found + "_text", masked(F.col(text_col), F.col(found)))
    changed = {text_col: F.col(found + "_text")}
    if length_col in docs.columns:
        length = F.length(found + "_text").cast(docs.schema[length_col].dataType)
        changed[length_col] = F.when(F.size(found) > 0, length).otherwise(F.col(length_col))
    return d.withColumns(changed).drop(found, found + "_text")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
