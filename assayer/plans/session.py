"""Live scoring with state: a session, a benchmark of sessions, a curriculum.

A session is a log table in a folder. Scoring a batch is one plan over the batch and
what the log knows about its candidates; the plan's result is appended, and
extrema, memory, replay buffer and the stopping rules are read off the log. Nothing
about a batch is kept on the driver but its scores, which the caller asked for.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import canonical
from assayer.operators import batch as B
from assayer.operators import runlog
from assayer.plans import compile as C
from assayer.sources import tables
from assayer.sources.objectives import Objective, load

SCHEMA = "batch_idx int, smiles string"


class Session:
    """Scores batches for one objective."""

    def __init__(self, spark: SparkSession, objective: Objective | str, folder: str, model: str = "model", replay_size: int = 0, replay_purge: bool = True, canonicalise=canonical, score_invalids: bool = False, recalculate: bool = False, bucket=None, resume: bool = False):
        self.spark, self.folder, self.model = spark, folder, model
        self.objective = load(objective) if isinstance(objective, str) else objective
        C.check(self.objective, C.result_columns(self.objective))
        self.replay_size, self.replay_purge = replay_size, replay_purge
        self.canonicalise, self.score_invalids, self.recalculate = canonicalise, score_invalids, recalculate
        #: What the scaffold filter groups by: a function of the candidate column.
        self.bucket = bucket or (lambda s: F.substring(s, 1, 1))
        self.run = uuid.uuid4().hex[:8]
        self.step, self.rows, self.finished, self.extrema = 0, 0, False, {}
        self.replay: DataFrame | None = None
        self.started = time.time()
        if resume:
            self._resume()

    @property
    def path(self) -> str:
        return f"{self.folder}/log"

    def log(self, task: str | None = None) -> DataFrame | None:
        """The rows scored so far for the current task, or another; None before the first."""
        if not self.rows:
            return None
        return tables.read_log(self.spark, self.path).where(F.col("task") == (task or self.objective.task_key)).where(F.col("step") <= self.step)

    def _resume(self) -> None:
        log = tables.read_log(self.spark, self.path)
        last = log.agg(F.max("step").alias("s"), F.max("idx").alias("i")).first()
        self.step, self.rows = last["s"] or 0, 0 if last["i"] is None else last["i"] + 1
        self._widen(self.log())
        if self.replay_size and self.rows:
            self.replay = runlog.replay_top(None, log, self.objective.method, self.replay_size, self.replay_purge)

    def _normed(self) -> list[str]:
        return [m.name for m in self.objective.metrics if m.modifier == "norm"]

    def _widen(self, rows: DataFrame | None) -> None:
        names = self._normed()
        for m in self.objective.metrics:
            if m.modifier == "norm" and m.name not in self.extrema and "min" in m.parameters and "max" in m.parameters:
                self.extrema[m.name] = (m.parameters["min"], m.parameters["max"])
        if not names or rows is None:
            return
        got = rows.agg(*[f(F.coalesce(c, F.lit(0.0))).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
        for c in names:
            low, high = got[f"lo{c}"], got[f"hi{c}"]
            if low is not None:
                old = self.extrema.get(c, (low, high))
                self.extrema[c] = (min(low, old[0]), max(high, old[1]))

    def score(self, smiles: Sequence[str | None], mol_ids: Sequence[str] | None = None) -> list[float]:
        """Scores of a batch in its order."""
        if mol_ids is not None and len(mol_ids) != len(smiles):
            raise ValueError("inputs differ in length")
        rows = [(i, s, *([mol_ids[i]] if mol_ids else [])) for i, s in enumerate(smiles)]
        df = self.spark.createDataFrame(rows, SCHEMA + (", mol_id string" if mol_ids else ""))
        done = self.score_frame(df)
        return [r["s"] for r in done.select("batch_idx", F.col("Score (reshaped)").alias("s")).orderBy("batch_idx").collect()]

    def score_frame(self, df: DataFrame, step: int | None = None) -> DataFrame:
        """The same for a frame (batch_idx, smiles), which may hold properties already. Returns the batch's part of the log."""
        o, began = self.objective, time.time()
        log = self.log()
        self.step = self.step + 1 if step is None else step
        df = B.parse(df, canonicalise=self.canonicalise)
        df = df.withColumns({"idx": F.col("batch_idx").cast("long") + self.rows, "step": F.lit(self.step), "task": F.lit(o.task_key), "model": F.lit(self.model)})
        df = B.first_occurrence(df) if log is None else B.first_occurrence_after(df, log)
        df = df.withColumn("scaffold", self.bucket(F.col("smiles")))
        names = C.result_columns(o)
        own = [c for c in names if c not in df.columns]
        if own:
            able = B.score_eligible(df, self.score_invalids, self.recalculate)
            results = C.properties(able.select("mol_id", "smiles").dropDuplicates(["mol_id"]), o).select("mol_id", *own)
            if log is None or self.recalculate:
                df = B.attach_results(df, results)
            else:
                df = B.attach_with_cache(df, results, log, own)
            if not self.score_invalids:
                df = df.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(0.0) for c in own})
        held = df.cache() if self._normed() else None
        if held is not None:
            df = held
            self._widen(df)
        df = C.score(df, o, self.extrema)
        memory = None
        if log is not None and o.diversity.run and o.diversity.name == "Scaffold":
            memory = log.where("recorded").select("scaffold", "smiles", F.col("idx").alias("ord"))
        df = C.reshape(df, o, memory=memory)
        now = time.time()
        df = df.withColumns({"absolute_time": F.lit(now - self.started), "score_time": F.lit(now - began)})
        tables.write_step(df, self.path)
        if held is not None:
            held.unpersist()
        done = self.spark.read.parquet(self.path).where((F.col("step") == self.step) & (F.col("task") == o.task_key))
        self.rows += done.count()
        if self.replay_size:
            self.replay = diversity_cut(runlog.replay_top(self.replay, done, o.method, self.replay_size, self.replay_purge))
        self._check()
        return done

    def score_only(self, smiles: Sequence[str | None]) -> list[float]:
        """Scores without validity, cache, state or log."""
        df = self.spark.createDataFrame([(i, s) for i, s in enumerate(smiles)], SCHEMA).withColumns({"step": F.lit(0), "idx": F.col("batch_idx").cast("long")})
        df = C.score(C.properties(df, self.objective), self.objective, self.extrema)
        return [r[0] for r in df.orderBy("batch_idx").select("Score").collect()]

    def _check(self) -> None:
        o = self.objective
        if not (o.budget or o.termination_threshold is not None or o.termination_patience):
            return
        ranked = self.log()
        if o.termination_early_stop:
            from assayer.operators.order import position

            ranked = position(ranked, "idx")
        states = runlog.termination(ranked, o.method, o.budget, o.oracle_budget, o.termination_threshold, o.termination_patience, o.termination_early_stop)
        self.finished = bool(states.orderBy(F.desc("step")).first()["finished"])

    def metrics(self, endpoint: str | None = None, budget: int | None = None, threshold: float = 0.8) -> DataFrame:
        """(metric, value) of the run so far."""
        from assayer.plans.bundles import run_metrics

        return run_metrics(self.log(), endpoint or "Score", budget or self.objective.budget or self.rows, threshold)


def diversity_cut(df: DataFrame) -> DataFrame:
    from assayer.operators.shared import cut

    return cut(df)


class Benchmark:
    """One session for each of several objectives; results side by side."""

    def __init__(self, spark: SparkSession, objectives: Sequence[Objective | str], folder: str, budget: int | None = None, **session):
        self.spark, self.folder, self.budget, self.options = spark, folder, budget, session
        self.objectives = [load(o) if isinstance(o, str) else o for o in objectives]
        self.results: list[DataFrame] = []

    def __iter__(self):
        from dataclasses import replace

        for o in self.objectives:
            o = replace(o, budget=self.budget or o.budget)
            s = Session(self.spark, o, f"{self.folder}/{o.task_key}", **self.options)
            yield s
            if s.rows:
                self.results.append(s.metrics().withColumn("task", F.lit(o.task_key)))

    def summary(self, write: bool = True) -> DataFrame:
        """One row for each task, one column for each metric; written as results.csv."""
        if not self.results:
            raise ValueError("no task has run")
        rows = self.results[0]
        for r in self.results[1:]:
            rows = rows.unionByName(r)
        names = sorted(r[0] for r in rows.select("metric").distinct().collect())  # the bundle's names
        out = rows.groupBy("task").pivot("metric", names).agg(F.first("value"))
        if write:
            out.write.mode("overwrite").csv(f"{self.folder}/results.csv", header=True)
        return out


class Curriculum(Session):
    """A session that goes on to the next objective when one has finished.

    Occurrences, cache and memory are those of the current task; the log and,
    unless it is reset, the replay buffer go on.
    """

    def __init__(self, spark: SparkSession, objectives: Sequence[Objective | str], folder: str, reset_replay: bool = False, **session):
        self.queue = [load(o) if isinstance(o, str) else o for o in objectives]
        self.reset_replay = reset_replay
        super().__init__(spark, self.queue.pop(0), folder, **session)

    def log(self, task: str | None = None) -> DataFrame | None:
        got = super().log(task)
        return None if got is None or got.isEmpty() else got

    def _check(self) -> None:
        super()._check()
        if self.finished and self.queue:
            self.objective, self.finished, self.extrema = self.queue.pop(0), False, {}
            if self.reset_replay:
                self.replay = None
