"""Fitted estimators as scoring functions.

An estimator is any object with predict(x) or predict_proba(x), as the usual
libraries make them. It is sent to each worker once and called on whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import SparkSession

from assayer.functions.registry import ScoringFunction

#: The largest pickled size of the estimators that are sent to every worker, in bytes.
LARGEST = 256 << 20


def estimator_function(spark: SparkSession, name: str, models: Sequence[object], features: Callable[[list[str]], Sequence[Sequence[float]]], proba: bool = False, default: float = 0.0) -> ScoringFunction:
    """A function with metrics pred, the models' mean, and spread, their standard deviation.

    features: from a batch of strings to a row of numbers each; a string that has
    none (None) gets defaults. proba: the probability of the second class in place
    of predict().
    """
    from pyspark import cloudpickle

    raw = cloudpickle.dumps((list(models), features))
    if len(raw) > LARGEST:
        raise ValueError("the estimators are too large to send to every worker")
    shared = spark.sparkContext.broadcast(raw)

    def build(**_):
        loaded: list = []

        def call(strings: list[str]) -> list[dict]:
            if not loaded:
                import pickle

                loaded.extend(pickle.loads(shared.value))
            own, describe = loaded
            rows = list(describe(strings))
            at = [i for i, r in enumerate(rows) if r is not None]
            out: list[dict] = [{} for _ in strings]
            if at:
                x = np.array([rows[i] for i in at], dtype=float)
                each = np.array([np.asarray(m.predict_proba(x))[:, 1] if proba else np.asarray(m.predict(x), float).reshape(len(at)) for m in own])
                for i, mean, spread in zip(at, each.mean(0), each.std(0)):
                    out[i] = {"pred": float(mean), "spread": float(spread)}
            return out

        return call

    return ScoringFunction(name, ("pred", "spread"), build, "arrow", default)
