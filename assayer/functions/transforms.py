"""Transforms of a property onto [0, 1], as column expressions.

Every transform maps NULL to NULL and NaN to NaN, whatever engine rules for
comparing NaN would say. A range of no width maps to 0 under `norm`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("maximize", "minimize", "range")


class ObjectiveError(ValueError):
    """An objective that can't be compiled."""


def _mode(mode: str, name: str) -> str:
    if mode not in MODES:
        raise ObjectiveError(f"{name}: mode is one of {', '.join(MODES)}, not {mode!r}")
    return mode


def _guard(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x), F.lit(float("nan"))).when(x.isNotNull(), y)


def raw(x: Column, **_) -> Column:
    return x.cast("double")


def norm(x: Column, objective: str = "maximize", min=None, max=None, **_) -> Column:
    """Linear between two extrema, which are numbers or columns."""
    x = x.cast("double")
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (min, max))
    if _mode(objective, "norm") == "range":
        raise ObjectiveError("norm: maximize or minimize")
    top, bottom = (x - low, high - low) if objective == "maximize" else (x - high, low - high)
    return _guard(x, F.coalesce(F.try_divide(top, bottom), F.lit(0.0)))


def lin_thresh(x: Column, objective: str = "maximize", upper: float = 0.0, lower: float = 0.0, buffer: float = 0.0, **_) -> Column:
    """1 on the good side of a threshold, a ramp of width `buffer` down to 0 beside it."""
    x = x.cast("double")
    upper, lower, buffer = float(upper), float(lower), float(buffer)

    def falling(distance: Column) -> Column:
        """1 at distance 0 or less, 0 from `buffer` on."""
        if buffer <= 0:
            return F.when(distance <= 0, 1.0).otherwise(0.0)
        return F.when(distance <= 0, 1.0).when(distance >= buffer, 0.0).otherwise(1.0 - distance / buffer)

    if _mode(objective, "lin_thresh") == "maximize":
        y = falling(upper - x)
    elif objective == "minimize":
        y = falling(x - lower)
    else:
        y = F.when(x < lower, falling(lower - x)).otherwise(falling(x - upper))
    return _guard(x, y)


def step(x: Column, objective: str = "maximize", upper: float = 0.0, lower: float = 0.0, **_) -> Column:
    x = x.cast("double")
    if _mode(objective, "step") == "maximize":
        hit = x >= float(upper)
    elif objective == "minimize":
        hit = x <= float(lower)
    else:
        hit = (x >= float(lower)) & (x <= float(upper))
    return _guard(x, F.when(hit, 1.0).otherwise(0.0))


def gauss(x: Column, objective: str = "range", mu: float = 0.0, sigma: float = 1.0, **_) -> Column:
    x = x.cast("double")
    bell = F.exp(-0.5 * F.pow((x - float(mu)) / float(sigma), F.lit(2.0)))
    if _mode(objective, "gauss") == "maximize":
        bell = F.when(x >= float(mu), 1.0).otherwise(bell)
    elif objective == "minimize":
        bell = F.when(x <= float(mu), 1.0).otherwise(bell)
    return _guard(x, bell)


def sigmoid(x: Column, objective: str = "maximize", upper: float = 0.0, lower: float = 0.0, scale: float = 1.0, **_) -> Column:
    """A logistic curve that is within 1% of 1 at the threshold."""
    x = x.cast("double")
    upper, lower, scale = float(upper), float(lower), float(scale)

    def rising(distance: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(scale * distance + 5.0)))

    if _mode(objective, "sigmoid") == "maximize":
        y = rising(x - upper)
    elif objective == "minimize":
        y = rising(lower - x)
    else:
        y = F.when(x > upper, rising(upper - x)).when(x < lower, rising(x - lower)).otherwise(1.0)
    return _guard(x, y)


TRANSFORMS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (raw, norm, lin_thresh, step, gauss, sigmoid)}


def transform(name: str, x: Column, **parameters) -> Column:
    if name not in TRANSFORMS:
        raise ObjectiveError(f"unknown transform {name!r}")
    return TRANSFORMS[name](x, **parameters)


def clip(x: Column, least: float = 1e-6) -> Column:
    """`x`, at least `least`; NaN stays NaN and NULL stays NULL."""
    return F.when(F.isnan(x), x).when(x.isNotNull(), F.greatest(x, F.lit(least)))
