"""Line files, runs, rules and state tables, all through Spark's readers and writers."""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """A file of one string a line, compressed or not; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "")


def write_lines(df: DataFrame, path: str, column: str = "smiles", compression: str | None = None) -> None:
    df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).write.mode("overwrite").text(path, compression=compression)


def write_step(df: DataFrame, path: str) -> None:
    """Append a batch to a run's log, a folder for each task and step. A repeated step replaces itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task", "step").parquet(path)


def read_log(spark: SparkSession, path: str, constants: Mapping[str, object] | None = None) -> DataFrame:
    """A run's log, with constants as further columns."""
    log = spark.read.parquet(path)
    return log.withColumns({k: F.lit(v).cast("string") for k, v in (constants or {}).items()}) if constants else log


def write_scores(log: DataFrame, path: str, constants: Mapping[str, object] | None = None) -> None:
    """The final log as CSV with a header, constants added."""
    out = log.withColumns({k: F.lit(str(v)) for k, v in (constants or {}).items()}) if constants else log
    out.write.mode("overwrite").csv(path, header=True)


def read_scores(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A log from CSV; "true" and "True" are booleans again in valid, unique and passes_diversity_filter."""
    df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    flags = [c for c in ("valid", "unique", "passes_diversity_filter") if c in df.columns]
    return df.withColumns({c: F.lower(F.col(c).cast("string")) == "true" for c in flags}) if flags else df


def write_state(path: str, tables: Mapping[str, DataFrame], values: Mapping[str, object]) -> None:
    """A run's state: tables as Parquet, and step, clock, extrema and the like as one JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.range(1).select(F.lit(json.dumps(dict(values), default=str)).alias("value")).write.mode("overwrite").text(f"{path}/values")


def read_state(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], dict]:
    values = json.loads(spark.read.text(f"{path}/values").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, values


def write_moments(spark: SparkSession, path: str, mean, covariance) -> None:
    """Statistics of a reference set, so that a comparison needn't read it again."""
    row = [(list(map(float, mean)), [list(map(float, r)) for r in covariance])]
    spark.createDataFrame(row, "mu array<double>, sigma array<array<double>>").write.mode("overwrite").parquet(path)


def read_moments(spark: SparkSession, path: str):
    import numpy as np

    r = spark.read.parquet(path).first()
    return np.array(r["mu"]), np.array(r["sigma"])


def read_rules(spark: SparkSession, path: str, sets: Sequence[str] = ()) -> DataFrame:
    """Alert rules from CSV (rule_id, pattern, max, description, rule_set), incomplete ones left out."""
    df = spark.read.csv(path, header=True, schema="rule_id int, pattern string, max int, description string, rule_set string").dropna()
    return df.where(F.col("rule_set").isin(list(sets))) if sets else df


def read_structures(spark: SparkSession, path: str, parse) -> DataFrame:
    """(path, smiles) of structure files (mol, sdf, pdb and the like), by a parser from bytes and file name to a string."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(c.as_py(), n) for n, c in zip(names, b.column(1))], pa.string())], names=["path", "smiles"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, smiles string")


def write_buffer(buffer: DataFrame, path: str) -> None:
    """A replay buffer as CSV."""
    buffer.write.mode("overwrite").csv(path, header=True)


def write_memory(memory: DataFrame, path: str) -> None:
    """A diversity filter's memory as CSV and JSON lines."""
    memory.write.mode("overwrite").csv(f"{path}/csv", header=True)
    memory.write.mode("overwrite").json(f"{path}/json")


def new_rows(log: DataFrame, latest: int) -> DataFrame:
    """What a monitor that has seen rows up to `latest` is missing."""
    return log.where(F.col("idx") > latest)


def rename_run(log: DataFrame, old: str, new: str) -> DataFrame:
    return log.withColumn("run", F.when(F.col("run") == old, new).otherwise(F.col("run")))


def drop_run(log: DataFrame, name: str) -> DataFrame:
    return log.where(F.col("run") != name)


def melt(log: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long: (ids, metric, value)."""
    return log.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), "metric", "value")


class MockGenerator:
    """Seeded batches of strings from a list, some repeated, some shuffled into nonsense, some None."""

    def __init__(self, strings: Sequence[str], seed: int = 0, flawed: bool = True):
        self.strings, self.random, self.flawed = list(strings), random.Random(seed), flawed

    @classmethod
    def from_file(cls, path: str, **kw) -> MockGenerator:
        return cls([s for s in Path(path).read_text(encoding="utf-8").split("\n") if s], **kw)

    def sample(self, n: int) -> list[str | None]:
        out: list[str | None] = self.random.sample(self.strings, min(n, len(self.strings)))
        if self.flawed:
            tenth = max(1, len(out) // 10)
            at = self.random.sample(range(len(out)), min(len(out), 3 * tenth))
            for k, i in enumerate(at):
                if k < tenth:
                    out[i] = out[0]
                elif k < 2 * tenth:
                    out[i] = "".join(self.random.sample(s := out[i] or "", len(s)))
                else:
                    out[i] = None
        return out
