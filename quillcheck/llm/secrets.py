"""Secrets in texts: three kinds of patterns, and credential values judged by how many guesses they would take.

A value that stands where a credential stands ("pwd: ...", "Authorization: Bearer ...") counts as a secret if the
cheapest way to guess it is dear. The cost is the minimum over all segmentations of the value into common words, dates,
repeats, keyboard walks and brute-force characters, found by dynamic programming from left to right.

Words are ranked: some usual parts of passwords by themselves, and the commonest words of the corpus by the number of their
occurrences, which Spark counts over all texts; a word's guesses are the better of its two ranks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.operators.ordering import with_ordinal

KINDS = ("assign", "access", "hex", "guess")  # the first three are patterns alone
LEAST_GUESSES = 8.0  # log10; fewer are placeholders or prose
SPANS = "array<struct<kind: string, start: long, end: long, log10_guesses: double>>"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:phrase|code)?|pwd|pin|credentials?|auth(?:orization)?|bearer|basic|private[_ -]?key|"""
    r"""access[_ -]?key|client[_ -]?secret)["']?\x20*(?:[:=]|\x20is)\x20*(?:bearer\x20+|basic\x20+)?["']?([^\s"',;]{6,})""",
    re.I | re.A,
)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
_CONTEXT_HINTS = ("pass", "pwd", "pin", "credential", "auth", "bearer", "basic", "key")

# Common parts of passwords, most common first.
_COMMON = (
    "password pass admin welcome login user test guest root secret token key master changeme letmein default example "
    "hello love dragon monkey sunshine princess football baseball summer winter spring autumn monday friday january "
    "december abc qwerty iloveyou trustno1 shadow superman batman michael jordan hunter ranger buster soccer hockey "
    "killer george pepper ginger tigger charlie thomas robert daniel access server system oracle mysql service "
    "company office internet secure private public demo temp sample your none null true false"
).split()
_RANK = {w: i + 1 for i, w in enumerate(_COMMON)}
MOST_WORDS = 20_000  # words of the corpus that are ranked: what every worker holds, under a megabyte
LEAST_SEEN = 10  # occurrences that make a word of the corpus common
WORD_SIZES = range(3, 17)
_MOST_COUNTED = 200_000  # distinct words that a task counts before it passes them on
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
# The rows of a keyboard, each shifted to the right of the one above.
_KEYS = ((0.0, "1234567890"), (0.5, "qwertyuiop"), (0.75, "asdfghjkl"), (1.25, "zxcvbnm"))
_PLACE = {key: (x + i, y) for y, (x, row) in enumerate(_KEYS) for i, key in enumerate(row)}
_DIRECTION = {  # from a key to each of its neighbours
    (a, b): (math.copysign(1, bx - ax) if bx != ax else 0, by - ay)
    for a, (ax, ay) in _PLACE.items() for b, (bx, by) in _PLACE.items() if a != b and abs(bx - ax) <= 1 and abs(by - ay) <= 1
}
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_DIRECTION_ABC = {pair: step for a, b in zip(_ALPHABET, _ALPHABET[1:], strict=False) for pair, step in (((a, b), 1), ((b, a), -1))}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
YEAR = 2025  # years are guessed from here on, the nearest first
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_SHORT = 8  # of a longer run only its last 3 to 8 characters and the whole are tried


def _runs(low: str, steps: Mapping) -> tuple[list[int], list[int]]:
    """For each character the steps of the walk that ends there, and its turns so far."""
    run, turns, way = [0] * len(low), [0] * len(low), None
    for i in range(1, len(low)):
        now = steps.get((low[i - 1], low[i]))
        if now is not None:
            run[i] = run[i - 1] + 1
            turns[i] = turns[i - 1] + (run[i - 1] > 0 and now != way)
        way = now
    return run, turns


def _sizes(run: int) -> Iterator[int]:
    yield from range(3, min(run + 1, _SHORT) + 1)
    if run + 1 > _SHORT:
        yield run + 1


def _date_guesses(part: str) -> float:
    year = _YEAR.search(part)
    far = max(abs(int(year.group()) - YEAR), 20) if year else 50
    return math.log10(far) if len(part) <= 4 else math.log10(365 * far)


def guesses(value: str, rank: Mapping[str, int] = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; linear in its length."""
    low, n = value.lower(), len(value)
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    same, _ = _runs(low, _SAME)
    walk, turns = _runs(low, _DIRECTION)
    alphabet, alphabet_turns = _runs(low, _DIRECTION_ABC)
    dates: dict[int, list[int]] = {}
    for a in range(n):
        if low[a].isdigit() and (m := _DATE.match(low, a)):
            dates.setdefault(m.end(), []).append(a)
            if m.end() - a > 4 and _YEAR.match(low, a):
                dates.setdefault(a + 4, []).append(a)
    best = [0.0] * (n + 1)
    for end in range(1, n + 1):
        cost = best[end - 1] + 1.0
        for size in WORD_SIZES:
            if size > end:
                break
            said = low[end - size : end]
            found = rank.get(said)
            straight = found is not None
            if found is None:
                found = rank.get(plain[end - size : end])
            if found is not None:
                twists = (value[end - size : end] != said) + (not straight)
                cost = min(cost, best[end - size] + math.log10(found + 1) + 0.6 * twists)
        last = end - 1
        for size in _sizes(same[last]):
            cost = min(cost, best[end - size] + math.log10(12 * size))
        for run, turn in ((walk, turns), (alphabet, alphabet_turns)):
            for size in _sizes(run[last]):
                turned = turn[last] - turn[end - size + 1]
                cost = min(cost, best[end - size] + math.log10(40 * size) + turned * math.log10(3))
        for a in dates.get(end, ()):
            cost = min(cost, best[a] + _date_guesses(low[a:end]))
        for size in (2, 3, 4):  # a short unit said again
            if end >= 2 * size and low[end - size : end] == low[end - 2 * size : end - size]:
                cost = min(cost, best[end - size] + 0.3)
        best[end] = cost
    return best[n]


class _Equal(dict):
    """A step from each character to itself."""

    def get(self, pair, default=None):  # noqa: ANN001
        return 0 if pair[0] == pair[1] else default


_SAME = _Equal()


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> dict[str, int]:
    """The ``most`` commonest words of all texts (runs of 3 to 16 ASCII letters, small, seen ``LEAST_SEEN`` times) and their ranks from 1.

    Words of equal count are ranked in the order of their letters. Tasks count their own words and pass them on before
    they hold too many.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = [w for w in seen if len(w) in WORD_SIZES]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(text.as_py().encode().translate(_LETTERS).split())
                    if len(seen) > _MOST_COUNTED:
                        yield told()
                        seen.clear()
        yield told()

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = with_ordinal(counts.where(F.col("n") >= LEAST_SEEN), [F.desc("n"), "word"], "place")  # a limit would bring as many words of each task
    return {r["word"]: r["place"] + 1 for r in ranked.where(F.col("place") < most).collect()}


def secrets_of(text: str | None, least: float = LEAST_GUESSES, rank: Mapping[str, int] = _RANK) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 of guesses), by start, then kind. Places are code points, ends exclusive."""
    text = text or ""
    low = text.lower()
    found: list[tuple[str, int, int, float]] = []
    if any(h in low for h in _ASSIGN_HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end() - m.start(1) >= 6:
                found.append(("assign", m.start(), m.end(), guesses(m.group(1), rank)))
    taken = [(s, e) for _, s, e, _ in found]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), guesses(m.group(), rank)) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), guesses(m.group(), rank)) for m in _HEX.finditer(text)]
    if any(h in low for h in _CONTEXT_HINTS):
        at = 0
        for m in _CONTEXT.finditer(text):
            s, e = m.span(1)
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at < len(taken) and taken[at][0] < e:
                continue
            cost = guesses(m.group(1), rank)
            if cost >= least:
                found.append(("guess", s, e, cost))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_GUESSES, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id and ``secrets``, the array of (kind, start, end, log10_guesses), for every row.

    A null or empty text has none; a null id stays null; repeated rows give repeated results; an empty table gives no
    rows; other columns are not read. Whole texts are searched, of any length. ``most_words`` bounds the words of the corpus
    that are ranked; every text counts for them.
    """
    common = ranked_words(docs, text_col, most_words)
    ranks = docs.sparkSession.sparkContext.broadcast({w: min(common.get(w, r), _RANK.get(w, r)) for w, r in (common | _RANK).items()})
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
    names = ("kind", "start", "end", "log10_guesses")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in secrets_of(t.as_py(), least, ranks.value)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], names=["doc_id", "secrets"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(search, f"doc_id {kind}, secrets {SPANS}")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
