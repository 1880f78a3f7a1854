"""Fragment scores, count prints and estimators against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import fragments
from assayer.functions.estimators import estimator_function
from assayer.functions.registry import apply


def test_mean_weight_counts_fragments_that_are_missing(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 4), (None, "x", 1)], "k string, fragment string, n long")
    weights = spark.createDataFrame([("x", 1.5), ("y", -2.0)], "fragment string, weight double")
    got = {r.k: r.weight for r in fragments.mean_weight(counts, weights, "k", -4.0).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": -4.0, None: 1.5}


@pytest.mark.parametrize("args", [(0.5, 20, 15, 0, 0, 0, 0), (-3.5, 60, 60, 4, 1, 2, 1), (2.0, 5, 5, 0, 0, 0, 0), (-4.0, 300, 10, 9, 0, 0, 1)])
def test_ease_is_the_formula(spark, args):
    weight, size, kinds, stereo, spiro, bridges, large = args
    raw = weight - (size**1.005 - size) - sum(math.log10(n + 1) for n in (stereo, spiro, bridges)) - large * math.log10(2)
    raw += 0.5 * math.log(size / kinds) if size > kinds else 0
    want = 11 - (raw + 5) / 6.5 * 9
    want = 8 + math.log(want - 8) if want > 8 else want
    df = spark.createDataFrame([args], "w double, size int, kinds int, stereo int, spiro int, bridges int, large int")
    got = df.select(fragments.ease(*[F.col(c) for c in df.columns]).alias("s")).first().s
    assert got == pytest.approx(min(10.0, max(1.0, want)))


def test_compressed_folded_and_penalised(spark):
    df = spark.createDataFrame([(5.0, 2.0, 8, {3: 2, 19: 1, 4: 7}), (-14.0, 0.0, 5, {}), (1.0, 1.0, 6, None)], "x double, c double, r int, m map<int,long>")
    got = df.select(fragments.compressed(F.col("x")).alias("s"), fragments.penalised(F.col("x"), F.col("c"), F.col("r")).alias("p"), fragments.folded(F.col("m"), 16).alias("f")).collect()
    assert [r.s for r in got] == pytest.approx([4 + math.log10(2), -4 - math.log10(11), 1.0])
    assert [r.p for r in got] == [1.0, -14.0, 0.0]
    assert [r.f for r in got] == [{3: 3, 4: 7}, {}, None]


def test_estimators_give_mean_and_spread(spark):
    class Half:
        def __init__(self, f):
            self.f = f

        def predict_proba(self, x):
            p = np.clip(self.f * x[:, 0], 0, 1)
            return np.column_stack([1 - p, p])

    f = estimator_function(spark, "Proba", [Half(0.1), Half(0.3)], lambda strings: [None if s == "bad" else [len(s)] for s in strings], proba=True, default=-1.0)
    df = spark.createDataFrame([("a",), ("bb",), ("bad",), (None,)], "smiles string")
    got = {r.smiles: (r.m_pred, r.m_spread) for r in apply(df, f, "m").collect()}
    assert got["a"] == pytest.approx((0.2, 0.1)) and got["bb"] == pytest.approx((0.4, 0.2))
    assert got["bad"] == got[None] == (-1.0, -1.0)
    assert apply(df.limit(0), f, "m").count() == 0
