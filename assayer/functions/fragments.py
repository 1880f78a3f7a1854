"""Scores from tables of fragment weights, and count prints.

Which fragments a structure has is a toolkit's work; from there on the scores are
joins with a table of weights and arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_weight(counts: DataFrame, weights: DataFrame, key: str, missing: float = 0.0) -> DataFrame:
    """(key, weight): the mean weight of a candidate's fragments.

    counts: (key, fragment, n). weights: (fragment, weight), each fragment once; a
    fragment that isn't there weighs `missing`. Fragments that very many candidates
    have are looked up once for each (key, fragment) row, and the sums are taken
    before the shuffle.
    """
    w = F.coalesce("weight", F.lit(missing))
    known = counts.join(weights, "fragment", "left")
    return known.groupBy(key).agg(F.try_divide(F.sum(w * F.col("n")), F.sum("n")).alias("weight"))


def ease(weight: Column, size: Column, kinds: Column, stereo: Column | int = 0, spiro: Column | int = 0, bridges: Column | int = 0, large_ring: Column | int = 0) -> Column:
    """Synthetic accessibility from 1 (easy) to 10.

    weight: the mean fragment weight; size: atoms; kinds: distinct fragments; the
    others are counts of what makes a structure hard, large_ring 0 or 1.
    """
    log10 = lambda x: F.log10(F.lit(x).cast("double") + 1 if isinstance(x, int) else x.cast("double") + 1)
    size, kinds = size.cast("double"), kinds.cast("double")
    ring = F.lit(large_ring).cast("double") if isinstance(large_ring, int) else large_ring.cast("double")
    hard = (F.pow(size, 1.005) - size) + log10(stereo) + log10(spiro) + log10(bridges) + ring * F.log10(F.lit(2.0))
    alike = F.when(size > kinds, 0.5 * F.ln(F.try_divide(size, kinds))).otherwise(0.0)
    scaled = 11.0 - (weight - hard + alike + 4.0 + 1.0) / (2.5 + 4.0) * 9.0
    smooth = F.when(scaled > 8.0, 8.0 + F.ln(scaled + 1.0 - 9.0)).otherwise(scaled)
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), smooth))


def compressed(score: Column, edge: float = 4.0) -> Column:
    """A score whose part beyond +-edge is on a logarithmic scale."""
    return F.when(score > edge, edge + F.log10(score - edge + 1)).when(score < -edge, -edge - F.log10(-edge - score + 1)).otherwise(score)


def penalised(value: Column, cost: Column, largest_ring: Column) -> Column:
    """A property less its cost, and less the members of the largest ring beyond six."""
    return value - cost - F.greatest(largest_ring - 6, F.lit(0))


def folded(counts: Column, places: int) -> Column:
    """A map from bit to count, bits folded by remainder; counts that meet are added."""
    bits = F.array_distinct(F.transform(F.map_keys(counts), lambda k: F.pmod(k, F.lit(places))))
    total = lambda b: F.aggregate(F.map_values(F.map_filter(counts, lambda k, _: F.pmod(k, F.lit(places)) == b)), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
    return F.map_from_arrays(bits, F.transform(bits, total))
