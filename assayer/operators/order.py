"""Order-dependent building blocks that never put all rows into one task.

Positions, running values and rolling windows over a whole table work in two
levels: blocks of the order column in parallel, and a small table with a row for
each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.shared import cut

#: Order values in a block.
SPAN = 65_536


def _before(df: DataFrame, keys: Sequence[str], value: Column, order: str, span: int, fold=F.sum) -> DataFrame:
    """For each block, the fold of `value` over all blocks before it."""
    per = df.groupBy(*keys, F.expr(f"{order} div {span}").alias("_block")).agg(fold(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_block", fold("_v").over(w).alias("_before"))


def position(df: DataFrame, order: str, out: str = "pos", keys: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """`df` with the 1-based rank of `order` (unique, whole numbers) among its rows."""
    blocks = _before(df, keys, F.lit(1), order, span)
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    ranked = df.withColumn("_block", F.expr(f"{order} div {span}")).withColumn("_n", F.row_number().over(w))
    joined = ranked.join(blocks, [*keys, "_block"])
    return joined.withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_n")).drop("_block", "_n", "_before")


def rank(df: DataFrame, by: Sequence[Column], out: str = "rank") -> DataFrame:
    """`df` with the 1-based rank of its rows in the order of `by`, which has to tell all rows apart.

    The rows are sorted by ranges, one to a task; a row's number in its range and the
    ranges' sizes give the rank.
    """
    ranged = cut(df.orderBy(*by).withColumn("_m", F.monotonically_increasing_id()))
    block = F.shiftright("_m", 33)  # the partition's number stands in the upper bits
    sizes = ranged.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_block", block).join(F.broadcast(sizes), "_block")
    return placed.withColumn(out, (F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_m", "_block", "_before")


def running(df: DataFrame, order: str, value: Column, out: str, fold: Callable = F.max, combine: Callable = F.greatest, keys: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """`df` with the fold of `value` over all rows up to each one."""
    blocks = _before(df, keys, value, order, span, fold)
    w = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_block", F.expr(f"{order} div {span}")).withColumn("_own", fold(value).over(w))
    joined = own.join(blocks, [*keys, "_block"])
    return joined.withColumn(out, F.when(F.col("_before").isNull(), F.col("_own")).otherwise(combine(F.col("_before"), F.col("_own")))).drop("_block", "_own", "_before")


def running_sum(df: DataFrame, order: str, value: Column, out: str, keys: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    return running(df, order, value, out, F.sum, lambda a, b: a + b, keys, span)


def rolling(df: DataFrame, pos: str, aggregates: dict[str, Column], size: int, keys: Sequence[str] = (), full: bool = False, span: int = SPAN) -> DataFrame:
    """`df` with aggregates over the last `size` rows in the order of `pos` (dense from 1).

    Each block gets the `size` - 1 rows before it too. full: NULL until `size` rows have been seen.
    """
    span = max(span, size)
    first = F.expr(f"({pos} - 1) div {span}")
    spread = F.array_distinct(F.array(first, F.expr(f"({pos} + {size} - 2) div {span}")))
    wide = df.withColumn("_own", first).withColumn("_block", F.explode(spread))
    w = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-(size - 1), 0)
    wide = wide.withColumns({k: F.when(F.col(pos) >= size, c.over(w)) if full else c.over(w) for k, c in aggregates.items()})
    return wide.where("_own = _block").drop("_own", "_block")
