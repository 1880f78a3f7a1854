"""Text analogues of descriptors and of substructure patterns, all column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(s: Column) -> Column:
    """One string for all spellings that differ in case and white space only; null for blank."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), F.lit(""))


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def descriptors(s: Column) -> dict[str, Column]:
    """Counts and ratios of a string; 0 for null."""
    t = F.coalesce(s, F.lit(""))
    n = F.length(t).cast("double")
    words = F.size(tokens(t)).cast("double")
    share = lambda pattern: F.coalesce(F.try_divide(n - F.length(F.regexp_replace(t, pattern, "")), n), F.lit(0.0))
    return {
        "length": n,
        "words": words,
        "distinct_words": F.size(F.array_distinct(tokens(t))).cast("double"),
        "letter_share": share("[A-Za-z]"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
    }


def ascii_pattern(pattern: str) -> str:
    r"""The pattern for Java's matcher with the sense that SQL engines give it: \b and \B by ASCII word characters, and all but \n matched by a dot."""
    edge = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}
    # quoted stretches and escaped characters are stepped over whole
    return "(?d)" + re.sub(r"\\Q.*?(?:\\E|\Z)|\\(.)", lambda m: edge.get(m[1], m[0]), pattern, flags=re.S)


def _occurs(s: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(s, F.lit(ascii_pattern(pattern))), F.lit(False))


def match_any(s: Column, patterns: Sequence[str]) -> Column:
    """1 if some pattern occurs; stops at the first."""
    return reduce(lambda a, p: a | _occurs(s, p), patterns, F.lit(False)).cast("int")


def match_all(s: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, p: a & _occurs(s, p), patterns, F.lit(True)).cast("int")


def pattern_filter(s: Column, patterns: Sequence[str]) -> tuple[Column, Column]:
    """(0 if some pattern occurs else 1, the patterns that do, joined by commas)."""
    hits = F.array_compact(F.array(*[F.when(_occurs(s, p), F.lit(p)) for p in patterns]).cast("array<string>"))
    return F.when(F.size(hits) > 0, 0).otherwise(1), F.array_join(hits, ",")


def unseen_share(bits: Column, known: Column) -> Column:
    """Share of a bit set that a reference doesn't have; 1 for no bits."""
    return F.coalesce(F.try_divide(F.size(F.array_except(bits, known)), F.size(F.array_distinct(bits))).cast("double"), F.lit(1.0))
