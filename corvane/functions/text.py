"""Scalar text functions as Column expressions.

Patterns run in Java: ``(?U)`` makes blanks and digits those of Unicode, ``(?d)`` lets the dot exclude only the line feed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import schema as S

_BLANK = r"[\s\x1c-\x1f]"


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){_BLANK}+", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def is_single_paragraph(text: Column) -> Column:
    """False for null, for a blank line anywhere, and for a bullet or number with a full stop at the very start."""
    return F.coalesce(~text.rlike(rf"(?Ud)(\n{_BLANK}*\n)|(\A{_BLANK}*[-•\d]+\.)"), F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping n-grams of the text without blanks; empty if it is shorter."""
    t = without_blanks(text)
    return array_ngrams(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "")), n, "")


def _punctuation() -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(S.PUNCTUATION))


def char_shares(text: Column, lengths: tuple[int, ...]) -> Column:
    """For each of ``lengths``, at most 3, the share of distinct ones among the n-grams of :func:`char_tokens`, null if there are none; an array of doubles.

    N-grams are numbers, a code point behind the other, so a text costs a sort of its numbers and no strings are made.
    """

    signs = dict.fromkeys(map(ord, S.PUNCTUATION))

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            c = np.frombuffer("".join((t or "").split()).translate(signs).encode("utf-32-le"), np.uint32).astype(np.uint64)
            found: list[float | None] = []
            for n in lengths:
                size = len(c) - n + 1
                grams = sum((c[k : k + size] << np.uint64(21 * k) for k in range(n)), np.zeros(max(size, 0), np.uint64)) if size > 0 else c[:0]
                found.append(len(np.unique(grams)) / size if size > 0 else None)
            out.append(found)
        return pd.Series(out, dtype=object)

    return run(text)


def char_tokens(text: Column) -> Column:
    """The characters in order, without blanks and punctuation."""
    t = F.regexp_replace(without_blanks(text), f"[{_punctuation()}]", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def char_set(text: Column) -> Column:
    """The distinct characters without punctuation; blanks outside the punctuation set count."""
    t = F.regexp_replace(text, f"[{_punctuation()}]", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(t, "")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct elements; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def array_ngrams(tokens: Column, n: int, between: str = "\x01") -> Column:
    """Overlapping runs of n tokens as strings; by default token borders are marked, so runs differ if their tokens do."""
    none = F.array().cast("array<string>")

    def runs(t: Column) -> Column:
        out = t
        for k in range(1, n):  # each step appends the k-th next token to all runs
            out = F.zip_with(F.slice(out, F.lit(1), F.size(t) - k), F.slice(t, F.lit(k + 1), F.size(t) - k), lambda a, b: F.concat(a, F.lit(between), b))
        return out

    return bound(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(none))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def key_text(parts: Iterable[Column]) -> Column:
    """The text that stands for a record in duplicate search; null parts read as ``None``."""
    return F.concat_ws(S.KEY_SEPARATOR, *(F.coalesce(p, F.lit("None")) for p in parts))


def polarity(text: Column) -> Column:
    """Mean weight of the level words in ``text``; a longer word counts with the shorter ones in it."""
    total, n = F.lit(0.0), F.lit(0)
    for word, weight in S.POLARITY.items():
        c = F.regexp_count(text, F.lit(word))
        total, n = total + c * weight, n + c
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def psychology_polarity(text: Column) -> Column:
    """Mean weight of the levels after the two state words and of the graded risk mentions; mentions don't overlap."""
    total, n = F.lit(0.0), F.lit(0)
    for key in ("综合心理状况", "幸福指数"):
        found = F.regexp_extract_all(text, F.lit(f"(?d){key}.{{0,8}}?(高|较高|中上|中|较低|低)"), F.lit(1))
        weights = F.create_map(*[F.lit(x) for kv in S.POLARITY.items() for x in kv])
        total = total + F.aggregate(found, F.lit(0.0), lambda a, w: a + F.element_at(weights, w))
        n = n + F.size(found)
    for word, weight in S.RISK_WORDS.items():
        c = F.regexp_count(text, F.lit(f"(?d)(抑郁风险|焦虑风险).{{0,8}}?{word}"))
        total, n = total + c * weight, n + c
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def lowish_count(text: Column) -> Column:
    """Mentions of a middle level that isn't upper middle, and of low levels."""
    return F.regexp_count(text, F.lit("(?<!中)中(?!上)")) + F.regexp_count(text, F.lit("较低|低"))


def dimension_level(text: Column, dimension: str, words: str = "高|较高|中上|中(?!上)|较低|低") -> Column:
    """The first level word within 12 characters after the first place of ``dimension`` that has one; else empty."""
    return F.regexp_extract(text, f"(?d){dimension}.{{0,12}}?({words})", 1)


def ascii_bar(share: Column, width: int = 40) -> Column:
    """A bar of ``width`` cells, ``share`` of them full."""
    full = F.least(F.greatest((share * width).cast("int"), F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def normalised_level(level: Column, target: Column) -> Column:
    """A strict level from any text that holds a short one, in the order high to poor; the target overrides it."""
    found = level
    for short, strict in reversed(S.LEVEL_SHORT.items()):
        found = F.when(F.contains(level, F.lit(short)), F.lit(strict)).otherwise(found)
    return F.coalesce(F.when(target != "", target), found)


def parse_level_mix(text: str | None) -> dict[str, float]:
    """Shares of the four levels from ``name:weight`` pairs; anything unusable gives equal shares."""
    even = {x: 0.25 for x in S.LEVELS}
    found: dict[str, float] = {}
    for pair in (text or "").split(","):
        name, colon, weight = pair.partition(":")
        level = S.LEVEL_ALIAS.get(name.strip(), name.strip())
        if colon and level in S.LEVELS:
            try:
                found[level] = float(weight)
            except ValueError:
                return even
    total = sum(found.values())
    return {x: found.get(x, 0.0) / total for x in S.LEVELS} if total > 0 else even
