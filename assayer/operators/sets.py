"""Comparisons of one candidate set with another: keys, bags, distributions, domains."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def novelty(gen: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """(n, n_new, value): distinct keys of `gen`, those that `ref` doesn't have, their share."""
    own = gen.select(key).where(F.col(key).isNotNull()).distinct()
    marked = own.join(ref.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("long").alias("n_new"), F.avg(F.when(F.col("_hit").isNull(), 1.0).otherwise(0.0)).alias("value"))


def rediscovered(gen: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(n, value): distinct keys of `target` that `gen` has, and their share."""
    own = target.select(key).where(F.col(key).isNotNull()).distinct()
    marked = own.join(gen.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    hit = F.when(F.col("_hit").isNotNull(), 1).otherwise(0)
    return marked.agg(F.sum(hit).cast("long").alias("n"), F.avg(hit.cast("double")).alias("value"))


def set_operation(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """Distinct keys in both (intersect), in one alone (subtract) or in either (union)."""
    a, b = a.select(key), b.select(key)
    return {"intersect": a.intersect, "subtract": a.subtract, "union": lambda x: a.union(x).distinct()}[how](b)


def fraction_unique(rows: DataFrame, key: str, order: str | None = None, first: int | None = None) -> DataFrame:
    """(n, n_unique, value), of the first rows by `order` if a number is given."""
    if first is not None:
        rows = rows.orderBy(order).limit(first)
    return rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_unique"), F.try_divide(F.count_distinct(key), F.count("*")).alias("value"))


def fraction_passing(rows: DataFrame, cond: Column) -> DataFrame:
    """(n, n_pass, value)."""
    ok = F.coalesce(cond, F.lit(False)).cast("int")
    return rows.agg(F.count("*").alias("n"), F.sum(ok).cast("long").alias("n_pass"), F.avg(ok.cast("double")).alias("value"))


def bag_counts(rows: DataFrame, bag: Column) -> DataFrame:
    """(key, n): how often each element of an array column occurs over all rows."""
    return rows.select(F.explode(bag).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def richness(counts: DataFrame) -> DataFrame:
    """(keys, total, value): distinct elements over occurrences."""
    return counts.agg(F.count("*").alias("keys"), F.sum("n").cast("long").alias("total"), F.try_divide(F.count("*"), F.sum("n")).alias("value"))


def cosine_of_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value): cosine of two count vectors; NULL if one is empty.

    Elements with a third of all occurrences are one row on each side by then.
    """
    both = a.select("key", F.col("n").alias("x")).join(b.select("key", F.col("n").alias("y")), "key", "full_outer")
    x, y = F.coalesce("x", F.lit(0)).cast("double"), F.coalesce("y", F.lit(0)).cast("double")
    return both.agg(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("value"))


def wasserstein(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(value): first Wasserstein distance of two samples, as the area between their CDFs.

    Equal values are one row before any ordering. The ordering is by range: a
    range's rows get the sums of the ranges before it, so no task sees all values.
    """
    count = lambda df, k: df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias(k))
    merged = count(a, "u").join(count(b, "v"), "x", "full_outer").fillna(0, ["u", "v"])
    totals = merged.agg(F.sum("u").alias("nu"), F.sum("v").alias("nv"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    parts = 1024
    rows = merged.crossJoin(F.broadcast(totals))  # one row
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_cell", cell)
    per = rows.groupBy("_cell").agg(F.sum("u").alias("_cu"), F.sum("v").alias("_cv"), F.min("x").alias("_first"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows at most
    per = per.select("_cell", F.coalesce(F.sum("_cu").over(before), F.lit(0)).alias("_bu"), F.coalesce(F.sum("_cv").over(before), F.lit(0)).alias("_bv"), F.lead("_first").over(Window.orderBy("_cell")).alias("_next"))
    w = Window.partitionBy("_cell").orderBy("x")
    rows = rows.withColumns({"_su": F.sum("u").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_sv": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.lead("x").over(w)})
    rows = rows.join(F.broadcast(per), "_cell")
    gap = F.coalesce("_after", "_next") - F.col("x")
    apart = F.abs(F.try_divide(F.col("_bu") + F.col("_su"), F.col("nu")) - F.try_divide(F.col("_bv") + F.col("_sv"), F.col("nv")))
    return rows.agg(F.sum(apart * gap).alias("value"))


#: Partial sums that the driver adds up.
MOMENT_PARTS = 8


def frechet(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Frechet distance of two sets of vectors: of their means and covariances (ddof 1).

    Each side is one aggregate of sums and products; the square root of the
    covariances' product is taken on the driver, on matrices of the vectors' width.
    """
    return frechet_of(_moments(a, vector), _moments(b, vector))


def frechet_of(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """The distance of two (mean, covariance), such as kept statistics of a reference set."""
    (m1, s1), (m2, s2) = one, other
    values, vectors = eigen(s1)
    root = vectors @ np.diag(np.sqrt(np.clip(values, 0, None))) @ vectors.T
    middle, _ = eigen(root @ s2 @ root)
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.clip(middle, 0, None)).sum())


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix, by Jacobi rotations.

    In place of a threaded LAPACK, which can hang beside the JVM. A sweep turns
    disjoint pairs of axes at once, a round-robin of all pairs.
    """
    a, n = (a + a.T) / 2, len(a)
    vectors, seats = np.eye(n), np.arange(n + n % 2)
    scale = np.sqrt((a * a).sum()) or 1.0
    for _ in range(sweeps):
        if np.sqrt(((a - np.diag(np.diag(a))) ** 2).sum()) <= 1e-13 * scale:
            break
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            keep = (p < n) & (q < n)
            p, q = np.minimum(p, q)[keep], np.maximum(p, q)[keep]
            angle = 0.5 * np.arctan2(2 * a[p, q], a[q, q] - a[p, p])
            c, s = np.cos(angle), np.sin(angle)
            ap, aq = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
            ap, aq = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = vectors[:, p].copy(), vectors[:, q].copy()
            vectors[:, p], vectors[:, q] = c * vp - s * vq, s * vp + c * vq
            seats[1:] = np.roll(seats[1:], 1)
    return np.diag(a).copy(), vectors


def _moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    def run(batches):
        n, total, products = 0, None, None
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None], dtype=np.float64)
            if len(x):
                n, total, products = n + len(x), x.sum(0) + (0 if total is None else total), x.T @ x + (0 if products is None else products)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([products.ravel().tolist()])], names=["n", "s", "p"])

    def fold(batches):
        n, total, products = 0, 0.0, 0.0
        for b in batches:
            for k, s, p in zip(*(c.to_pylist() for c in b.columns)):
                n, total, products = n + k, total + np.array(s), products + np.array(p)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([products.tolist()])], names=["n", "s", "p"])

    n, total, products = 0, 0.0, 0.0
    schema = "n long, s array<double>, p array<double>"
    # a row for each partition, then one for each of a few
    for r in df.select(vector).mapInArrow(run, schema).repartition(MOMENT_PARTS).mapInArrow(fold, schema).collect():
        s = np.array(r["s"])
        n, total, products = n + r["n"], total + s, products + np.array(r["p"]).reshape(len(s), len(s))
    mean = total / n
    return mean, (products - n * np.outer(mean, mean)) / (n - 1)


def property_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value, n): the values that each property takes, and how often."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "value")
    return long.groupBy("metric", "value").agg(F.count("*").alias("n"))


def outlier_bits(gen: DataFrame, ref: DataFrame, key: str, bits: str) -> DataFrame:
    """(value): mean share of a row's bits that no row of `ref` has; a row without bits counts 1."""
    known = ref.select(F.explode(bits).alias("_b")).distinct().withColumn("_known", F.lit(1))
    own = gen.select(key, F.explode_outer(F.array_distinct(bits)).alias("_b")).join(known, "_b", "left")
    per = own.groupBy(key).agg(F.avg(F.when(F.col("_known").isNull(), 1.0).otherwise(0.0)).alias("_s"))
    return per.agg(F.avg("_s").alias("value"))


def applicability_domain(gen: DataFrame, ref: DataFrame, features: Sequence[str]) -> DataFrame:
    """`gen` with `in_domain` (0/1): every feature within the reference's range; NULL is outside."""
    ranges = ref.agg(*[f(c).alias(f"_{c}_{k}") for c in features for k, f in (("lo", F.min), ("hi", F.max))])
    joined = gen.crossJoin(F.broadcast(ranges))  # one row
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).between(F.col(f"_{c}_lo"), F.col(f"_{c}_hi"))
    return joined.withColumn("in_domain", F.coalesce(ok, F.lit(False)).cast("int")).drop(*ranges.columns)


def target_filter(gen: DataFrame, ref: DataFrame, features: Sequence[str], deviations: float = 4.0, at_most: Mapping[str, float] | None = None) -> DataFrame:
    """`gen` with `passes` (0/1): features within so many population deviations of the reference's mean, others at most a bound."""
    stats = ref.agg(*[f(c).alias(f"_{c}_{k}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = gen.crossJoin(F.broadcast(stats))  # one row
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).between(F.col(f"_{c}_m") - deviations * F.col(f"_{c}_s"), F.col(f"_{c}_m") + deviations * F.col(f"_{c}_s"))
    for c, most in (at_most or {}).items():
        ok = ok & (F.col(c) <= most)
    return joined.withColumn("passes", F.coalesce(ok, F.lit(False)).cast("int")).drop(*stats.columns)


def range_filter(gen: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """`gen` with `passes` (0/1): every property within its fixed range."""
    ok = F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            ok = ok & (F.col(c) >= low)
        if high is not None:
            ok = ok & (F.col(c) <= high)
    return gen.withColumn("passes", F.coalesce(ok, F.lit(False)).cast("int"))


def alert_rules(gen: DataFrame, rules: DataFrame, column: str, key: str, sets: Sequence[str] = ()) -> DataFrame:
    """`gen` with `passes` (0/1) and `broken`, the descriptions of the rules that match more than `max` times.

    rules: (rule_id, pattern, max, description, rule_set); a table that people write,
    whose size is checked, so its patterns become one array literal.
    """
    own = rules.where("pattern is not null and max is not null")
    if sets:
        own = own.where(F.col("rule_set").isin(list(sets)))
    rows = own.orderBy("rule_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 rules")
    if not rows:
        return gen.withColumns({"passes": F.lit(1), "broken": F.lit("")})
    table = F.array(*[F.struct(F.lit(r["pattern"]).alias("p"), F.lit(int(r["max"])).alias("m"), F.lit(r["description"]).alias("d")) for r in rows])
    text = F.coalesce(F.col(column), F.lit(""))
    hit = F.filter(table, lambda r: F.regexp_count(text, r["p"]) > r["m"])
    broken = F.array_join(F.transform(hit, lambda r: r["d"]), ",")
    return gen.withColumn("broken", broken).withColumn("passes", F.when(F.col("broken") == "", 1).otherwise(0))


def member(gen: DataFrame, ref: DataFrame, key: str, out: str = "inside") -> DataFrame:
    """`gen` with an exact membership flag (0/1)."""
    known = ref.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_in", F.lit(1))
    return gen.join(known, gen[key] == known["_k"], "left").withColumn(out, F.coalesce("_in", F.lit(0))).drop("_k", "_in")


def bloom_size(n: int, error: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for n keys at an error rate."""
    bits = max(64, math.ceil(-n * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def bloom_build(ref: DataFrame, key: str, error: float = 0.01, capacity: int | None = None) -> tuple[DataFrame, int, int]:
    """(words, bits, hashes): the filter as a table (word, value) of 64-bit words that have a bit set."""
    bits, hashes = bloom_size(capacity or ref.count(), error)
    at = ref.where(F.col(key).isNotNull()).select(F.explode(_bloom_bits(F.col(key), bits, hashes)).alias("_b"))
    words = at.groupBy(F.expr("_b div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_b", F.lit(64)).cast("int"))).alias("value"))
    return words, bits, hashes


def _bloom_bits(key: Column, bits: int, hashes: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(key.cast("string"), F.lit(k)), F.lit(bits)) for k in range(hashes)]))


def bloom_member(gen: DataFrame, bloom: tuple[DataFrame, int, int], key: str, row: str, out: str = "inside") -> DataFrame:
    """`gen` with `out` (0/1): no false negatives, false positives at the filter's error rate. `row` is gen's key."""
    words, bits, hashes = bloom
    ask = gen.where(F.col(key).isNotNull()).select(row, F.explode(_bloom_bits(F.col(key), bits, hashes)).alias("_b"))
    ask = ask.withColumn("word", F.expr("_b div 64")).join(words, "word", "left")
    set_ = F.coalesce(F.call_function("getbit", F.col("value"), F.pmod("_b", F.lit(64)).cast("int")).cast("int"), F.lit(0))
    hit = ask.groupBy(row).agg(F.min(set_).cast("int").alias("_in"))
    return gen.join(hit, row, "left").withColumn(out, F.coalesce("_in", F.lit(0))).drop("_in")


def neighbour_overlap(a: DataFrame, b: DataFrame, limit: float) -> DataFrame:
    """(pairs): how many points (x, y, z, radius) of two sets are closer than the sum of radii less `limit`.

    A grid of cells as wide as the largest reach turns the distance join into an equi-join over neighbouring cells.
    """
    reach = a.agg(F.max("radius")).crossJoin(b.agg(F.max("radius").alias("r2"))).first()
    width = max(float(reach[0] or 0) + float(reach[1] or 0) - limit, 1e-6)
    cell = lambda c: F.floor(F.col(c) / width)
    cells = [cell(c).alias(f"_{c}") for c in "xyz"]
    own = a.select(*[F.col(c).alias(f"a{c}") for c in "xyz"], F.col("radius").alias("ar"), *cells)
    around = b.select(*[F.col(c).alias(f"b{c}") for c in "xyz"], F.col("radius").alias("br"), *cells)
    for c in "xyz":
        around = around.withColumn(f"_{c}", F.explode(F.array(F.col(f"_{c}") - 1, F.col(f"_{c}"), F.col(f"_{c}") + 1)))
    d = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"))
    return own.join(around, ["_x", "_y", "_z"]).where(d < F.col("ar") + F.col("br") - limit).agg(F.count("*").alias("pairs"))


def corrected(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """(metric, value, n): averages over calls, weighted by n; `new` holds the latest calls'."""
    rows = new.select("metric", "value", "n")
    if state is not None:
        rows = state.select("metric", "value", "n").unionByName(rows)
    return rows.groupBy("metric").agg(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("value"), F.sum("n").alias("n"))
