"""Named sets of metrics over one run's log, as (metric, value) rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import runlog

TOP = (1, 10, 100)


def _rows(df: DataFrame, name: Column | str) -> DataFrame:
    return df.select((F.lit(name) if isinstance(name, str) else name).alias("metric"), F.col("value").cast("double").alias("value"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def top_bundle(scores: DataFrame, endpoint: str, budget: int, top_n: Sequence[int] = TOP, prefix: str = "") -> DataFrame:
    """Top-n averages and areas."""
    label = lambda what: F.concat(F.lit(f"{prefix}Top-"), F.col("n").cast("string"), F.lit(f" {what} {endpoint}"))
    return _union([_rows(runlog.top_n_avg(scores, endpoint, top_n), label("Avg")), _rows(runlog.top_n_auc(scores, endpoint, budget, top_n), label("AUC"))])


def diverse_bundle(scores: DataFrame, endpoint: str, budget: int, top_n: Sequence[int] = TOP, words: str = "words", prefix: str = "") -> DataFrame:
    """The same over a buffer of rows that differ."""
    from assayer.operators.diversity import diverse_top

    got = diverse_top(scores, endpoint, budget, top_n, words=words)
    label = lambda what: F.concat(F.lit(f"{prefix}Top-"), F.col("n").cast("string"), F.lit(f" {what} (Div) {endpoint}"))
    return _union([_rows(got.withColumn("value", F.col(c)), label(what)) for c, what in (("avg", "Avg"), ("auc", "AUC"))])


def mean_of_tops(scores: DataFrame, endpoint: str, top_n: Sequence[int] = TOP, name: str = "Mean of tops") -> DataFrame:
    """The mean of several top-n averages: what task suites score a goal by."""
    return _rows(runlog.top_n_avg(scores, endpoint, top_n).agg(F.avg("value").alias("value")), name)


def task_score(scores: DataFrame, endpoint: str, task: str) -> DataFrame:
    """A goal-directed suite's score: a formula's task asks for as many as there are isomers, a rediscovery for one."""
    # fixed values: the numbers of isomers that the published suite asks for
    isomers = {"C11H24": 159, "C9H10N2O2PF2Cl": 250}
    single = ("celecoxib", "troglitazone", "thiothixene")
    tops = (isomers[task],) if task in isomers else (1,) if task.lower().startswith(single) else TOP
    return mean_of_tops(scores, endpoint, tops, "Task score")


def task_quality(scores: DataFrame, endpoint: str, passes: str, n: int = 100) -> DataFrame:
    """Share of the n best rows that pass a quality filter; 0 with fewer rows."""
    best = runlog.pick(scores, endpoint, n)
    value = F.when(F.count("*") < n, 0.0).otherwise(F.avg(F.col(passes).cast("double")))
    return _rows(best.agg(value.alias("value")), "Task quality")


def library_bundle(scores: DataFrame, endpoint: str, activity: str, reaction: str | None = None, least: float = 0.4) -> DataFrame:
    """Number, share and mean score of rows at an activity; share whose reaction filter is satisfied."""
    hit = F.col(activity) >= least
    cols = {"Library N": F.count_if(hit), "Library yield": F.avg(hit.cast("double")), "Library mean score": F.avg(F.when(hit, F.col(endpoint)))}
    if reaction:
        cols["Library satisfied"] = F.avg((F.col(reaction) == 1.0).cast("double"))
    one = scores.agg(*[c.cast("double").alias(k) for k, c in cols.items()])
    return one.unpivot([], list(cols), "metric", "value")


def exploration_bundle(scores: DataFrame, budget: int, pattern: str = r"_Cmpd[0-9]*_Sim$", top_n: Sequence[int] = TOP) -> DataFrame:
    """Products, over all similarity endpoints that the log has, of top-n averages and areas."""
    endpoints = [c for c in scores.columns if re.search(pattern, c)]
    if not endpoints:
        raise ValueError("the log has no similarity endpoint")
    parts = []
    for what, make in (("Avg", lambda e: runlog.top_n_avg(scores, e, top_n)), ("AUC", lambda e: runlog.top_n_auc(scores, e, budget, top_n))):
        each = _union([make(e).select("n", "value") for e in endpoints])
        parts.append(_rows(each.groupBy("n").agg(F.product("value").alias("value")), F.concat(F.lit("Top-"), F.col("n").cast("string"), F.lit(f" {what} (Exp)"))))
    return _union(parts)


def hits_bundle(scores: DataFrame, endpoint: str, words: str = "words", threshold: float = 0.5, distance: float = 0.65) -> DataFrame:
    """How many hits are left when near ones are excluded."""
    from assayer.operators.diversity import sphere_exclusion

    kept = sphere_exclusion(scores.where(F.col(endpoint) >= threshold), distance, "idx", words)
    return _rows(kept.agg(F.count("*").alias("value")), f"Diverse hits {endpoint}")


def run_metrics(log: DataFrame, endpoint: str, budget: int, threshold: float = 0.8, scaffold: str | None = "scaffold", prefix: str = "", top_n: Sequence[int] = TOP, oracle_budget: bool = False) -> DataFrame:
    """The standard set: ratios, tops, areas and yields over the log's valid, unique rows."""
    ratios = runlog.ratios(log).unpivot([], ["valid_ratio", "unique_ratio"], "metric", "value")
    scores = runlog.preprocess(log, budget=budget, oracle_budget=oracle_budget)
    parts = [ratios, top_bundle(scores, endpoint, budget, top_n, prefix)]
    for s in [None, scaffold] if scaffold and scaffold in log.columns else [None]:
        tag = " Scaffold" if s else ""
        parts.append(_rows(runlog.threshold_yield(scores, endpoint, threshold, budget, s), f"{prefix}Yield{tag} {endpoint}"))
        parts.append(_rows(runlog.yield_auc(scores, endpoint, threshold, budget, scaffold=s), f"{prefix}Yield AUC{tag} {endpoint}"))
    return _union(parts)


def filtered_metrics(log: DataFrame, endpoint: str, budget: int, filters: dict[str, str], **kw) -> DataFrame:
    """The standard set for all rows, and for the rows that pass each named filter column, under its prefix."""
    parts = [run_metrics(log, endpoint, budget, **kw)]
    for name, column in filters.items():
        passing = log.where(F.col(column).cast("boolean"))
        parts.append(run_metrics(passing, endpoint, budget, prefix=f"{name} ", **kw).where(F.col("metric").startswith(name)))
        parts.append(_rows(log.where("valid and unique").agg(F.avg(F.col(column).cast("double")).alias("value")), f"{name} ratio"))
    return _union(parts)


def set_metrics(gen: DataFrame, refs: dict[str, DataFrame], key: str, bags: dict[str, str] | None = None, values: Sequence[str] = (), words: str | None = None) -> DataFrame:
    """Intrinsic metrics of a generated set, and extrinsic ones against each reference.

    key names a candidate; bags are array columns, values numeric ones, words bit vectors under column `id`.
    """
    from assayer.operators import sets, tiles

    parts = [_rows(sets.fraction_unique(gen, key).select("value"), "Uniqueness")]
    for name, bag in (bags or {}).items():
        parts.append(_rows(sets.richness(sets.bag_counts(gen, F.col(bag))).select("value"), f"{name} richness"))
    if words:
        own = gen.select("id", F.col(words).alias("words"))
        parts += [_rows(tiles.internal_diversity(own, p), f"IntDiv{p:.0f}") for p in (1.0, 2.0)]
    for ref_name, ref in refs.items():
        parts.append(_rows(sets.novelty(gen, ref, key).select("value"), f"Novelty {ref_name}"))
        for name, bag in (bags or {}).items():
            parts.append(_rows(sets.cosine_of_counts(sets.bag_counts(gen, F.col(bag)), sets.bag_counts(ref, F.col(bag))), f"{name} {ref_name}"))
        parts += [_rows(sets.wasserstein(gen, ref, v), f"{v} {ref_name}") for v in values]
        if words:
            other = ref.select("id", F.col(words).alias("words"))
            parts.append(_rows(tiles.mean_nearest(own, other), f"SNN {ref_name}"))
            both = tiles.analogues(own, other)
            parts += [_rows(both.select(F.col("gen").alias("value")), f"AnalogueSimilarity {ref_name}"), _rows(both.select(F.col("ref").alias("value")), f"AnalogueCoverage {ref_name}")]
    return _union(parts)
