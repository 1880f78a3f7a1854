"""Similarity of bit sets, count vectors, strings and formulas, as column expressions.

Bit sets are arrays of 64-bit words, so that a common count is a handful of
`bit_count(a & b)`, whatever the number of set bits. The measures are closed
forms of a, b (bits on each side), c (common bits) and n (length).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_from_vector(v: Column, length: int) -> Column:
    """Bit i is set iff v[i] > 0."""
    n = -(-length // 64)
    bit = lambda i: F.when(F.get(v, F.lit(i)) > 0, F.lit(_signed(1 << (i % 64)))).otherwise(F.lit(0).cast("long"))
    out = []
    for k in range(n):
        word = F.lit(0).cast("long")
        for i in range(64 * k, min(64 * (k + 1), length)):
            word = word.bitwiseOR(bit(i))
        out.append(word)
    return F.array(*out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_from_bits(bits: Column, length: int) -> Column:
    """Words of an array of set positions; positions fold by modulo `length`, as hashed prints do."""
    n = -(-length // 64)
    folded = F.transform(bits, lambda b: F.pmod(b, F.lit(length)).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.aggregate(F.filter(folded, lambda b: F.floor(b / 64) == k), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64))))),
    )


def on_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def common_bits(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, n: s + n)


def measures(a: Column, b: Column, c: Column, n) -> dict[str, Column]:
    """The twelve coefficients by name; 0 where a denominator is 0."""
    a, b, c = (x.cast("double") for x in (a, b, c))
    n = n.cast("double") if isinstance(n, Column) else F.lit(float(n))
    d = n - a - b + c
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return {
        "Tanimoto": ratio(c, a + b - c),
        "Dice": ratio(2 * c, a + b),
        "Cosine": ratio(c, F.sqrt(a * b)),
        "Sokal": ratio(c, 2 * a + 2 * b - 3 * c),
        "Russel": ratio(c, n),
        "OnBit": ratio(c, a + b - c),
        "Kulczynski": ratio(c * (a + b), 2 * a * b),
        "McConnaughey": ratio(c * (a + b) - a * b, a * b),
        "Asymmetric": ratio(c, F.least(a, b)),
        "BraunBlanquet": ratio(c, F.greatest(a, b)),
        "RogotGoldberg": ratio(c, a + b) + ratio(d, 2 * n - a - b),
        "AllBit": ratio(n - (a + b - 2 * c), n),
    }


#: Measures for bit sets of no fixed length, and for counts.
SPARSE_BITS = ("Tanimoto", "Dice", "Cosine", "Sokal", "Russel", "Kulczynski", "McConnaughey", "Asymmetric", "BraunBlanquet", "RogotGoldberg")
COUNTS = ("Tanimoto", "Dice")


def bit_similarity(x: Column, y: Column, measure: str = "Tanimoto", length: int = 64) -> Column:
    return measures(on_bits(x), on_bits(y), common_bits(x, y), length)[measure]


def count_similarity(x: Column, y: Column, measure: str = "Tanimoto") -> Column:
    """Of two maps from key to count: sums of minima stand for common bits."""
    if measure not in COUNTS:
        raise ValueError(f"counts allow {', '.join(COUNTS)}")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    both = F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + F.least(F.coalesce(F.try_element_at(x, k), F.lit(0)), F.coalesce(F.try_element_at(y, k), F.lit(0))))
    return measures(total(x), total(y), both, 1)[measure]


def to_references(x: Column, references: list[Column], one, reduce: str = "max", threshold: float | None = None) -> tuple[Column, list[Column]]:
    """(mean or max over references, the similarity to each), optionally binarised at a threshold."""
    each = [one(x, r) for r in references]
    if threshold is not None:
        each = [F.when(s >= threshold, 1.0).otherwise(0.0) for s in each]
    if reduce == "max":
        return (F.greatest(*each) if len(each) > 1 else each[0]), each
    out = each[0]
    for s in each[1:]:
        out = out + s
    return out / float(len(each)), each


def levenshtein_similarity(s: Column, reference: str) -> Column:
    """1 - edits / length of the reference, at least 0."""
    return F.greatest(F.lit(0.0), 1.0 - F.levenshtein(s, F.lit(reference)) / float(max(1, len(reference))))


def formula_counts(formula: Column) -> Column:
    """Map from element to count of a formula such as C9H10N2O2."""
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([A-Z][a-z]?)", 1).alias("e"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(p, "([0-9]+)$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(1)).alias("n")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["e"]))
    return F.map_from_arrays(names, F.transform(names, lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda s, p: s + p["n"])))


def isomer_score(formula: Column, target: dict[str, int]) -> Column:
    """Geometric mean of a bell per element (width 1) and one for the number of atoms (width 2)."""
    counts = formula_counts(formula)
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda s, v: s + v)
    bell = lambda x, mu, sigma: -0.5 * F.pow((x - F.lit(float(mu))) / float(sigma), F.lit(2.0))
    logs = [bell(F.coalesce(F.try_element_at(counts, F.lit(e)), F.lit(0)).cast("double"), n, 1.0) for e, n in target.items()]
    logs.append(bell(total.cast("double"), sum(target.values()), 2.0))
    s = logs[0]
    for x in logs[1:]:
        s = s + x
    return F.exp(s / float(len(logs)))
