"""Runs that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, session, checkpoint: str, key: str = "idx") -> StreamingQuery:
    """Scores every micro-batch with a session; a replayed batch replaces its own step, so nothing counts twice.

    Rows of a micro-batch are ordered by `key`. Stop the query when session.finished.
    """

    def one(df: DataFrame, epoch: int) -> None:
        if session.finished or df.isEmpty():
            return
        from assayer.operators.order import position

        rows = position(df, key, "_p").withColumn("batch_idx", (F.col("_p") - 1).cast("int")).drop("_p", "idx")
        step = int(epoch) + 1
        if step <= session.step:  # a replay: back to the state before it
            session.rows = session.spark.read.parquet(session.path).where(F.col("step") < step).count() if step > 1 else 0
            session.step = step - 1
        session.score_frame(rows, step)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def read_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they come, with the columns of `like`."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def monitor(stream: DataFrame, value: str, every: int = 100) -> DataFrame:
    """Live (bin, n, mean, best, valid) for each `every` rows of a run, updated as rows come."""
    return stream.groupBy(F.expr(f"idx div {every}").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("best"), F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)).alias("valid")
    )


def tumbling(events: DataFrame, time: str, size: str, late: str, aggregates: dict[str, Column], slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates over event-time windows, rows later than `late` left out once their window has closed. Beyond parity."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    kept = events.withWatermark(time, late) if events.isStreaming else events
    out = kept.groupBy(w.alias("w"), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over each key's sessions, which a gap ends. Beyond parity."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    out = kept.groupBy(F.session_window(time, gap).alias("w"), key).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, *aggregates)


def drain(query: StreamingQuery, after: Callable[[], None] | None = None) -> None:
    """Run a query until its source has nothing new, then stop it."""
    try:
        query.processAllAvailable()
        if after:
            after()
    finally:
        query.stop()
