"""Aggregation of a row's transformed properties into one score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.transforms import ObjectiveError


def _sum(columns) -> Column:
    return reduce(add, columns)


def product(columns: Sequence[Column]) -> Column:
    """The product; 1 of nothing."""
    return reduce(mul, columns) if columns else F.lit(1.0)


def single(x: Sequence[Column], w=None) -> Column:
    if len(x) != 1:
        raise ObjectiveError("single takes exactly one metric")
    return x[0]


def amean(x: Sequence[Column], w=None) -> Column:
    return _sum(x) / float(len(x))


def gmean(x: Sequence[Column], w=None) -> Column:
    return F.exp(_sum(F.ln(c) for c in x) / float(len(x)))


def wsum(x: Sequence[Column], w: Sequence) -> Column:
    return _sum(c * k for c, k in zip(x, w)) / _total(w)


def prod(x: Sequence[Column], w=None) -> Column:
    return product(x)


def wprod(x: Sequence[Column], w: Sequence) -> Column:
    return F.exp(_sum(F.ln(c) * k for c, k in zip(x, w)) / _total(w))


def _total(w):
    return _sum(w) if any(isinstance(k, Column) for k in w) else float(sum(w))


ROW = {f.__name__: f for f in (single, amean, gmean, wsum, prod, wprod)}
#: Methods whose weights come from the batch.
BATCH = ("auto_wsum", "auto_wprod")


def aggregate(method: str, x: Sequence[Column], w: Sequence) -> Column:
    """Score of a row by one of the row-wise methods; 1 without metrics."""
    if method not in ROW:
        raise ObjectiveError(f"unknown aggregation {method!r}")
    return ROW[method](x, w) if x else F.lit(1.0)


def auto_weights(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> dict[str, Column]:
    """Weight of each column within its batch: P(x < 0.5) / P(x >= 0.5), as a window over `by`.

    A column that never reaches 0.5 has infinite weight, which makes the batch's
    scores NaN. All rows of the batch count, invalid and repeated ones too.
    """
    w = Window.partitionBy(*by)
    out = {}
    for c in columns:
        low, high = (F.sum(F.when(cond, 1.0).otherwise(0.0)).over(w) for cond in (F.col(c) < 0.5, F.col(c) >= 0.5))
        out[c] = F.when(high > 0, F.try_divide(low, high)).otherwise(F.lit(float("inf")))
    return out


def auto_aggregate(df: DataFrame, method: str, columns: Sequence[str], by: Sequence[str], out: str) -> DataFrame:
    """`df` with `out`, the batch-adaptive weighted sum or product of `columns` over batches `by`.

    The weights are one aggregate with a row for each batch, joined back.
    """
    if method not in BATCH:
        raise ObjectiveError(f"unknown batch aggregation {method!r}")
    shares = [F.avg(F.when(F.col(c) < 0.5, 1.0).otherwise(0.0)).alias(f"_low_{i}") for i, c in enumerate(columns)]
    shares += [F.avg(F.when(F.col(c) >= 0.5, 1.0).otherwise(0.0)).alias(f"_high_{i}") for i, c in enumerate(columns)]
    per = df.groupBy(*by).agg(*shares)
    weights = [F.when(F.col(f"_high_{i}") > 0, F.try_divide(F.col(f"_low_{i}"), F.col(f"_high_{i}"))).otherwise(F.lit(float("inf"))) for i in range(len(columns))]
    per = per.select(*by, *[x.alias(f"_w_{i}") for i, x in enumerate(weights)])
    joined = df.join(per, list(by)) if by else df.crossJoin(F.broadcast(per))  # one row
    w, x = [F.col(f"_w_{i}") for i in range(len(columns))], [F.col(c) for c in columns]
    total = _sum(w)
    if method == "auto_wsum":
        score = _sum(c * k for c, k in zip(x, w)) / F.when(total == 0, F.lit(float("nan"))).otherwise(total)
    else:
        score = F.exp(_sum(F.ln(c) * k for c, k in zip(x, w)) / F.when(total == 0, F.lit(float("nan"))).otherwise(total))
    return joined.withColumn(out, score).drop(*[f"_w_{i}" for i in range(len(columns))])


def register(name: str, f) -> None:
    """Offer another row-wise method, f(columns, weights) to a column, to objectives."""
    if name in ROW or name in BATCH:
        raise ObjectiveError(f"{name!r} is taken")
    ROW[name] = f


def ensemble(predictions: Column) -> Column:
    """Mean of an array of models' predictions; missing ones don't count."""
    own = F.filter(predictions, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, x: s + x), F.size(own))


def multi_target(predictions: Column, how: str = "mean", thresholds: Sequence[float] | None = None) -> Column:
    """mean, median, max or min over targets' predictions, made 0 or 1 first if thresholds are given."""
    x = predictions
    if thresholds is not None:
        limits = F.array(*[F.lit(float(t)) for t in thresholds])
        x = F.zip_with(x, limits, lambda p, t: F.when(p >= t, 1.0).otherwise(0.0))
    if how == "max":
        return F.array_max(x)
    if how == "min":
        return F.array_min(x)
    if how == "mean":
        return ensemble(x)
    if how != "median":
        raise ObjectiveError("how is mean, median, max or min")
    s, n = F.sort_array(x), F.size(x)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
