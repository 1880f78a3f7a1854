"""An objective compiled into a plan over a batch whose properties are there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.aggregators import BATCH, aggregate, auto_aggregate, product
from assayer.functions.registry import REGISTRY, apply
from assayer.functions.transforms import ObjectiveError, clip, transform
from assayer.operators import diversity
from assayer.operators.pareto import reward
from assayer.sources.objectives import PARETO, MetricSpec, Objective


def check(objective: Objective, available: Sequence[str]) -> None:
    """Raise before anything runs if a metric has no column."""
    missing = [m.name for m in objective.metrics if m.name not in available]
    if missing:
        raise ObjectiveError(f"no such metrics: {', '.join(missing)}")


def result_columns(objective: Objective) -> list[str]:
    return [f"{f.prefix}_{m}" for f in objective.functions if f.run for m in REGISTRY.get(f.name).metrics]


def properties(df: DataFrame, objective: Objective, column: str = "smiles") -> DataFrame:
    """`df` with the columns of all functions of the objective that run."""
    for f in objective.functions:
        if f.run:
            parameters = {k: v for k, v in f.parameters.items() if k != "prefix"}
            df = apply(df, REGISTRY.get(f.name), f.prefix, column, **parameters)
    return df


def modified(m: MetricSpec, extrema: Mapping[str, tuple] | None = None) -> Column:
    """A metric's transform, clipped; `norm` takes the extrema of the run where they are known."""
    parameters = dict(m.parameters)
    if m.modifier == "norm" and extrema and m.name in extrema:
        parameters |= dict(zip(("min", "max"), extrema[m.name]))
    return clip(transform(m.modifier, F.col(m.name), **parameters))


def score(df: DataFrame, objective: Objective, extrema: Mapping[str, tuple] | None = None, batch: Sequence[str] = ("step",), words: str | None = None) -> DataFrame:
    """`df` with a column for each transformed metric, the aggregate, `filter` and `Score`.

    One projection, but for methods whose weights come from the batch.
    """
    check(objective, df.columns)
    df = df.withColumns({m.column: modified(m, extrema) for m in objective.metrics}) if objective.metrics else df
    names = [m.column for m in objective.scored]
    method = objective.method
    if method in BATCH and names:
        df = auto_aggregate(df, method, names, batch, method)
    elif method == PARETO and names:
        df = reward(df, names, by=batch, words=words, out=method)
    elif names:
        df = df.withColumn(method, aggregate(method, [F.col(c) for c in names], [m.weight for m in objective.scored]))
    else:
        df = df.withColumn(method, F.lit(1.0))
    df = df.withColumn("filter", product([F.col(m.column) for m in objective.filters]))
    return df.withColumn("Score", F.col(method) * F.col("filter"))


def reshape(df: DataFrame, objective: Objective, bucket: str = "scaffold", candidate: str = "smiles", words: str = "words", memory: DataFrame | None = None) -> DataFrame:
    """`df` with `Score (reshaped)` and `passes_diversity_filter`, by the objective's diversity filter."""
    spec = objective.diversity
    p = spec.parameters
    if not spec.run:
        return df.withColumns({"Score (reshaped)": F.col("Score"), "passes_diversity_filter": F.lit(True)})
    if spec.name == "Unique":
        df = df.withColumn("Score (reshaped)", diversity.unique_filter(df, "Score"))
    elif spec.name == "Occurrence":
        df = df.withColumn("Score (reshaped)", diversity.occurrence_filter(df, "Score", int(p.get("tolerance", 5)), int(p.get("buffer", 5))))
    else:
        kw = {"most": int(p.get("nbmax", 25)), "least": float(p.get("minscore", 0.6)), "mode": p.get("outputmode", "binary")}
        if spec.name == "Scaffold":
            df = diversity.scaffold_filter(df, "Score", bucket, candidate, memory=memory, **kw)
        elif spec.name == "CompoundSimilarity":
            df = diversity.similarity_filter(df, "Score", candidate, words, similar=float(p.get("minsimilarity", 0.6)), **kw)
        else:
            raise ObjectiveError(f"unknown diversity filter {spec.name!r}")
        df = df.withColumnRenamed("filtered", "Score (reshaped)")
    return df.withColumn("passes_diversity_filter", diversity.passes(F.col("Score (reshaped)"), F.col("Score")))
