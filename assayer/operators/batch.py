"""What happens to a batch of candidates before and after its properties are computed.

A run's rows have an explicit, unique idx: it is the order in which candidates
arrived, and every rule that says "first" goes by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import canonical


def parse(df: DataFrame, column: str = "smiles", canonicalise=canonical, parsed: Column | None = None) -> DataFrame:
    """`df` with `column` in its canonical form, `valid`, `valid_score` and `mol_id`.

    Blank and null strings are invalid; where `canonicalise` gives null the raw string
    stays and the row is invalid. None: all given strings count as valid. A mol_id
    that is there stays, else it is the string. parsed: another test of validity.
    """
    x = F.col(column)
    given = x.isNotNull() & (F.trim(x) != "")
    if canonicalise is None:
        out, valid = x, given
    else:
        c = canonicalise(x)
        out, valid = F.coalesce(c, x), given & c.isNotNull()
    if parsed is not None:
        valid = valid & F.coalesce(parsed, F.lit(False))
    df = df.withColumns({column: out, "valid": valid})
    df = df.withColumn("valid_score", F.col("valid").cast("int"))
    return df if "mol_id" in df.columns else df.withColumn("mol_id", F.col(column).cast("string"))


def first_occurrence(run: DataFrame) -> DataFrame:
    """`run` with `unique` (first time this mol_id is seen) and `occurrences` (times before); nulls are one id."""
    n = F.row_number().over(Window.partitionBy("mol_id").orderBy("idx"))
    run = run.withColumn("_n", n)
    return run.withColumns({"unique": F.col("_n") == 1, "occurrences": (F.col("_n") - 1).cast("long")}).drop("_n")


def first_occurrence_after(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The same for a batch whose earlier rows are in `log` (mol_id, idx): counts only move, not rows.

    The log is cut down to the batch's ids before it is counted.
    """
    ids = batch.select("mol_id").distinct()
    seen = log.join(ids, log["mol_id"].eqNullSafe(ids["mol_id"]), "left_semi").groupBy("mol_id").agg(F.count("*").alias("_seen"))
    here = first_occurrence(batch)
    joined = here.join(seen.withColumnRenamed("mol_id", "_id"), F.col("mol_id").eqNullSafe(F.col("_id")), "left")
    times = F.col("occurrences") + F.coalesce("_seen", F.lit(0))
    return joined.withColumns({"occurrences": times, "unique": times == 0}).drop("_seen", "_id")


def score_eligible(batch: DataFrame, score_invalids: bool = False, recalculate: bool = False, by: Sequence[str] = ("step",)) -> DataFrame:
    """The rows whose properties have to be computed: valid and unique ones.

    score_invalids: unique ones; recalculate: valid ones. A batch without any sends
    its first row, so that functions always get one.
    """
    if score_invalids and recalculate:
        ok = F.lit(True)
    elif score_invalids:
        ok = F.col("unique")
    elif recalculate:
        ok = F.col("valid")
    else:
        ok = F.col("valid") & F.col("unique")
    first = batch.groupBy(*by).agg(F.max(F.when(ok, 1).otherwise(0)).alias("_any"), F.min("idx").alias("_first"))
    joined = batch.join(first, list(by))
    return joined.where(ok | ((F.col("_any") == 0) & (F.col("idx") == F.col("_first")))).drop("_any", "_first")


def merge_results(results: Sequence[DataFrame], key: str = "mol_id") -> DataFrame:
    """Results of several functions side by side, one row for each key; a key without a result has nulls there."""
    out = None
    for r in results:
        one = r.dropDuplicates([key])
        out = one if out is None else out.join(one, key, "full_outer")
    return out


def attach_results(batch: DataFrame, results: DataFrame, key: str = "mol_id", fill: float = 0.0) -> DataFrame:
    """`batch` with the results of its keys; result columns win over those of the batch, and missing numbers are `fill`."""
    new = [c for c in results.columns if c != key]
    kept = batch.drop(*[c for c in new if c in batch.columns])
    one = results.dropDuplicates([key])
    joined = kept.join(one.withColumnRenamed(key, "_key"), kept[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    numbers = [c for c, t in results.dtypes if c in new and t in ("double", "float", "int", "bigint")]
    return joined.fillna(fill, numbers)


def attach_with_cache(batch: DataFrame, results: DataFrame, log: DataFrame, columns: Sequence[str], key: str = "mol_id") -> DataFrame:
    """Results for new ids, and for ids seen in earlier batches the values of their first row in `log`."""
    ids = batch.select(key).distinct()
    first = log.join(ids, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), "idx").alias("_first"))
    cached = first.select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])
    fresh = results.select(key, *columns).join(cached.select(key), key, "left_anti")
    return attach_results(batch, cached.unionByName(fresh), key)


def running_extrema(run: DataFrame, columns: Sequence[str], by: str = "step", start: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """`run` with <column>_min and <column>_max over all batches up to a row's own.

    Values given at the start only widen. One aggregate for each batch, then a
    window over the batches, which are few.
    """
    start = start or {}
    per = run.groupBy(by).agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("min", F.min), ("max", F.max))])
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in columns:
        low, high = start.get(c, (None, None))
        out[f"{c}_min"] = F.least(F.min(f"{c}_min").over(w), F.lit(low).cast("double"))
        out[f"{c}_max"] = F.greatest(F.max(f"{c}_max").over(w), F.lit(high).cast("double"))
    return run.join(per.withColumns(out), by)


def purge_history(batch: DataFrame, history: DataFrame, key: str = "mol_id") -> DataFrame:
    """Valid rows, the first of each key, that `history` doesn't have."""
    own = first_occurrence(batch.where("valid")).where("unique").drop("unique", "occurrences")
    return own.join(history.select(key).distinct(), key, "left_anti")
