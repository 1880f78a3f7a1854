"""Metrics over a run's log, one row for each candidate in the order of idx."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.order import position, rank, rolling, running, running_sum


def preprocess(log: DataFrame, valid: bool = True, unique: bool = True, budget: int | None = None, oracle_budget: bool = False) -> DataFrame:
    """The rows that count, with `pos`, their place among them.

    A total budget cuts before validity and uniqueness, an oracle budget after.
    """
    if budget and not oracle_budget:
        log = position(log, "idx", "_all").where(F.col("_all") <= budget).drop("_all")
    if valid:
        log = log.where("valid")
    if unique:
        log = log.where("unique")
    log = position(log, "idx", "pos")
    return log.where(F.col("pos") <= budget) if budget and oracle_budget else log


def ratios(log: DataFrame) -> DataFrame:
    """(valid_ratio, unique_ratio): valid of all rows, unique of the valid ones."""
    ok = F.when(F.col("valid"), 1.0).otherwise(0.0)
    both = F.when(F.col("valid") & F.col("unique"), 1.0).otherwise(0.0)
    return log.agg(F.avg(ok).alias("valid_ratio"), F.try_divide(F.sum(both), F.sum(ok)).alias("unique_ratio"))


def top_n_avg(scores: DataFrame, endpoint: str, top_n: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """(n, value): the mean of the n best, or of all if there are fewer.

    Only the best max(n) rows leave the executors' partial sorts.
    """
    best = scores.select(F.col(endpoint).alias("_s"), "idx").orderBy(F.desc("_s"), "idx").limit(max(top_n))
    ranked = best.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_s"), "idx")))
    wanted = ranked.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted(set(top_n))]))).where("_r <= n")
    return wanted.groupBy("n").agg(F.avg("_s").alias("value"))


def _checkpoints(scores: DataFrame, budget: int, window: int) -> DataFrame:
    """(cp, last, width): every `window` rows below the budget and the number of rows, then the last one, which sees all."""
    n = scores.agg(F.count("*").alias("n"))
    steps = n.select("n", F.explode(F.expr(f"case when least(n, {budget}) > {window} then sequence({window}L, least(n, {budget}) - 1, {window}L) else array() end")).alias("cp"))
    ends = n.select("n", F.col("n").alias("cp"), F.lit(True).alias("last"))
    every = steps.select("n", "cp", F.lit(False).alias("last")).unionByName(ends)
    return every.withColumn("before", F.coalesce(F.lag("cp").over(Window.orderBy("last", "cp")), F.lit(0)))


def _area(values: DataFrame, keys: Sequence[str], budget: int, extrapolate: bool) -> DataFrame:
    """Trapezoids from 0 over (cp, before, last, v), by keys, over the budget."""
    w = Window.partitionBy(*keys).orderBy("last", "cp")
    part = (F.col("cp") - F.col("before")) * (F.col("v") + F.coalesce(F.lag("v").over(w), F.lit(0.0))) / 2
    rest = F.when(F.col("last") & (F.col("cp") < budget), (F.lit(budget) - F.col("cp")) * F.col("v")).otherwise(0.0) if extrapolate else F.lit(0.0)
    return values.withColumn("_a", part + rest).groupBy(*keys).agg((F.sum("_a") / float(budget)).alias("value"))


def top_n_auc(scores: DataFrame, endpoint: str, budget: int, top_n: Sequence[int] = (1, 10, 100), window: int = 100, extrapolate: bool = False) -> DataFrame:
    """(n, value): area under the running top-n average, over the budget.

    `scores` has pos. Each bin of `window` rows keeps its best max(n) rows, and a
    checkpoint ranks those of the bins before it; the number of checkpoints is
    bounded by the budget, and rows beyond it are one bin.
    """
    most = max(top_n)
    cps = _checkpoints(scores, budget, window)
    late = -(-budget // window)
    bins = scores.select(F.col(endpoint).cast("double").alias("_s"), F.col("pos"), F.least(F.expr(f"(pos - 1) div {window}"), F.lit(late)).alias("_bin"))
    # the bin of late rows is dealt out before it is ranked
    bins = bins.withColumn("_part", F.when(F.col("_bin") == late, F.pmod(F.xxhash64("pos"), F.lit(1024))).otherwise(0))
    best = bins.withColumn("_r", F.row_number().over(Window.partitionBy("_bin", "_part").orderBy(F.desc("_s"), "pos"))).where(F.col("_r") <= most)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("_bin").orderBy(F.desc("_s"), "pos"))).where(F.col("_r") <= most)
    seen = best.join(F.broadcast(cps), F.col("last") | (F.expr(f"(_bin + 1) * {window}") <= F.col("cp")))
    ranked = seen.withColumn("_k", F.row_number().over(Window.partitionBy("cp", "last").orderBy(F.desc("_s"), "pos"))).where(F.col("_k") <= most)
    values = ranked.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sorted(set(top_n))]))).where("_k <= n")
    values = values.groupBy("n", "cp", "before", "last").agg(F.avg("_s").alias("v"))
    return _area(values, ["n"], budget, extrapolate)


def threshold_yield(scores: DataFrame, endpoint: str, threshold: float, budget: int, scaffold: str | None = None) -> DataFrame:
    """(value): hits, or distinct scaffolds of hits, over the budget."""
    hits = scores.where(F.col(endpoint) >= threshold)
    n = F.count("*") if scaffold is None else F.count_distinct(scaffold)
    return hits.agg((n / float(budget)).alias("value"))


def yield_auc(scores: DataFrame, endpoint: str, threshold: float, budget: int, window: int = 100, extrapolate: bool = True, scaffold: str | None = None) -> DataFrame:
    """(value): area under hits so far over rows so far, at every `window` rows.

    With scaffolds only the first hit of each counts. Bins are counted first, so the
    running sum has a row for each bin below the budget, and one for the rest.
    """
    hit = F.col(endpoint) >= threshold
    rows = scores.select("pos", hit.cast("int").alias("_h"), *([F.col(scaffold).alias("_sc")] if scaffold else []))
    if scaffold:
        first = rows.where("_h = 1 and _sc is not null").groupBy("_sc").agg(F.min("pos").alias("pos")).select("pos", F.lit(1).alias("_h"))
        rows = rows.select("pos", F.lit(0).alias("_h")).unionByName(first)
    late = -(-budget // window)
    bins = rows.groupBy(F.least(F.expr(f"(pos - 1) div {window}"), F.lit(late)).alias("_bin")).agg(F.sum("_h").alias("_h"))
    cps = _checkpoints(scores, budget, window)
    seen = bins.join(F.broadcast(cps), F.col("last") | (F.expr(f"(_bin + 1) * {window}") <= F.col("cp")))
    values = seen.groupBy("cp", "before", "last").agg((F.sum("_h") / F.col("cp")).alias("v"))
    return _area(values.withColumn("_one", F.lit(1)), ["_one"], budget, extrapolate).select("value")


def trends(log: DataFrame, value: str, size: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """`log` with the rolling mean and running extrema of `value`, by run if keys are given."""
    log = rolling(log, "pos", {"rolling_mean": F.avg(value)}, size, keys)
    log = running(log, "pos", F.col(value), "running_max", F.max, F.greatest, keys)
    return running(log, "pos", F.col(value), "running_min", F.min, F.least, keys)


def per_step(log: DataFrame, value: str, by: Column | None = None) -> DataFrame:
    """(step, n, mean, median, std, valid, unique) for each step, or each value of `by`."""
    key = F.col("step") if by is None else by
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return log.groupBy(key.alias("step")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), rate("valid").alias("valid"), rate("unique").alias("unique")
    )


def per_n(log: DataFrame, value: str, n: int) -> DataFrame:
    """The same for every n rows; a last, smaller group is left out."""
    return per_step(log, value, F.expr(f"(pos - 1) div {n}")).where(F.col("n") == n)


def early_stop(log: DataFrame, value: str, size: int = 500) -> DataFrame:
    """(step, batch_mean, rolling_mean, stalls): whether a batch's mean is below the mean of the last `size` rows at its end."""
    r = rolling(log, "pos", {"_roll": F.avg(value)}, size, full=True)
    out = r.groupBy("step").agg(F.avg(value).alias("batch_mean"), F.max_by("_roll", "pos").alias("rolling_mean"))
    return out.withColumn("stalls", F.coalesce(F.col("batch_mean") < F.col("rolling_mean"), F.lit(False)))


def termination(log: DataFrame, value: str, budget: int | None = None, oracle_budget: bool = False, threshold: float | None = None, patience: int | None = None, stop_early: bool = False) -> DataFrame:
    """(step, rows, ids, batch_mean, finished): the state of the stopping rules after every batch.

    An oracle budget counts distinct ids, invalid ones among them. Patience counts
    batches in a row without a new valid id (oracle budget), and in total batches
    below the rolling mean (stop_early) or at the threshold; without patience the
    first batch at the threshold ends the run.
    """
    per = log.groupBy("step").agg(
        F.count("*").alias("_n"), F.sum(F.when(F.col("unique"), 1).otherwise(0)).alias("_new"), F.sum(F.when(F.col("unique") & F.col("valid"), 1).otherwise(0)).alias("_fresh"), F.avg(value).alias("batch_mean")
    )
    if stop_early:
        per = per.join(early_stop(log, value).select("step", "stalls"), "step")
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row for each batch
    total = lambda c: F.sum(c).over(w)
    per = per.withColumns({"rows": total("_n"), "ids": total("_new")})
    done = F.lit(False)
    if budget:
        done = done | ((F.col("ids") if oracle_budget else F.col("rows")) >= budget)
    counters = []
    if oracle_budget:
        # the counter stands still on the batch that fills the budget, and falls to 0 with a new id
        per = per.withColumn("_run", total(F.when(F.col("_fresh") > 0, 1).otherwise(0)))
        idle = F.when((F.col("_fresh") == 0) & ((F.lit(budget).isNull()) | (F.col("ids") < (budget or 0))), 1).otherwise(0)
        counters.append(F.sum(idle).over(Window.partitionBy("_run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    if stop_early:
        counters.append(total(F.when(F.col("stalls"), 1).otherwise(0)))
    if threshold is not None:
        reached = F.col("batch_mean") >= threshold
        if patience:
            counters.append(total(F.when(reached, 1).otherwise(0)))
        else:
            done = done | reached
    if patience:
        for c in counters:
            done = done | (c >= patience)
    per = per.withColumn("_now", done.cast("int"))
    return per.select("step", "rows", "ids", "batch_mean", (F.max("_now").over(w) == 1).alias("finished"))


def replay_top(buffer: DataFrame | None, batch: DataFrame, endpoint: str, size: int, purge: bool = False) -> DataFrame:
    """The best `size` rows of buffer and batch, the earliest of each mol_id; purge leaves out what the diversity filter changed."""
    if purge:
        batch = batch.where("passes_diversity_filter")
    rows = batch if buffer is None else buffer.unionByName(batch, allowMissingColumns=True)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("mol_id").orderBy("idx"))).where("_n = 1").drop("_n")
    return first.orderBy(F.desc(endpoint), "idx").limit(size)


def replay_sample(buffer: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows of a replay buffer, at random."""
    return buffer.orderBy(F.rand(seed)).limit(n)


def pick(log: DataFrame, endpoint: str, n: int, how: str = "top", scaffold: str | None = None, window: tuple[int, int] | None = None, seed: int = 0, words: str = "words", like: Column | None = None) -> DataFrame:
    """n rows of a log: top, random, range (evenly spaced ranks), diverse (farthest first) or similar (nearest to `like`, words).

    Of a scaffold only its best row is taken.
    """
    if window is not None:
        log = log.where(F.col("idx").between(*window))
    if scaffold:
        w = Window.partitionBy(scaffold).orderBy(F.desc(endpoint), "idx")
        log = log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if how == "top":
        return log.orderBy(F.desc(endpoint), "idx").limit(n)
    if how == "random":
        return log.orderBy(F.rand(seed)).limit(n)
    if how == "diverse":
        from assayer.operators.diversity import maxmin

        return log.where(F.col("idx").isin(maxmin(log, n, seed or 123, "idx", words)))
    if how == "similar":
        from assayer.functions.similarity import bit_similarity

        return log.withColumn("_s", bit_similarity(F.col(words), like)).orderBy(F.desc("_s"), "idx").limit(n).drop("_s")
    if how != "range":
        raise ValueError("how is top, random, range, diverse or similar")
    total = log.count()
    if total <= n:
        return log
    ranks = sorted({round(k * (total - 1) / max(1, n - 1)) + 1 for k in range(n)})
    ranked = rank(log, [F.col(endpoint).cast("double").desc(), F.col("idx").asc()], "_rank")
    return ranked.where(F.col("_rank").isin(ranks)).drop("_rank")


def cumulative_hits(log: DataFrame, endpoint: str, threshold: float) -> DataFrame:
    """`log` with `hits`, the number of rows so far at or above the threshold."""
    return running_sum(log, "pos", F.when(F.col(endpoint) >= threshold, 1).otherwise(0), "hits")


def rolling_median(log: DataFrame, value: str, size: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """`log` with the median of `value` over the last `size` rows by pos."""
    out = rolling(log, "pos", {"_last": F.collect_list(value)}, size, keys).withColumn("_last", F.sort_array("_last"))  # `size` numbers
    n = F.size("_last")
    middle = (F.get("_last", F.floor((n - 1) / 2).cast("int")) + F.get("_last", F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("rolling_median", middle).drop("_last")


def top_page(log: DataFrame, metrics: dict[str, bool], n: int, method: str = "amean", by: Sequence[str] = ()) -> DataFrame:
    """The n best rows by several metrics, each scaled to [0, 1] over all rows (downwards if its flag is set) and aggregated.

    The extrema are one aggregate; of each group of `by`, if given.
    """
    from assayer.functions.aggregators import aggregate
    from assayer.functions.transforms import norm

    ends = log.groupBy(*by).agg(*[f(m).alias(f"_{m}_{k}") for m in metrics for k, f in (("lo", F.min), ("hi", F.max))])
    rows = log.join(ends, list(by)) if by else log.crossJoin(F.broadcast(ends))  # one row
    scaled = [norm(F.col(m), "minimize" if down else "maximize", min=F.col(f"_{m}_lo"), max=F.col(f"_{m}_hi")) for m, down in metrics.items()]
    rows = rows.withColumns({f"norm_{m}": c for m, c in zip(metrics, scaled)})
    rows = rows.withColumn("page_score", aggregate(method, [F.col(f"norm_{m}") for m in metrics], [1.0] * len(metrics))).drop(*[c for c in ends.columns if c not in by])
    return rows.orderBy(F.desc("page_score"), "idx").limit(n)


def first_rows(log: DataFrame, keys: Sequence[str], order: str = "idx") -> DataFrame:
    """The first row of each key: where a structure's file is looked up."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
