"""Named queries over the driver's tables, and the SQL that states each of them.

The tables hold no molecules, so a candidate is any keyed row: `events` is a run in
the order of event_id, `lineitem` and `part` are property tables, `embeddings` are
fingerprints (bit i is set iff value i is positive), texts stand for strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from assayer.plans import q_diversity, q_more, q_runlog, q_scoring, q_sets  # noqa: E402, F401
