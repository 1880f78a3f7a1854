"""What the operators of this subpackage share: reading, checkpoints, components."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are broadcast at most, about 16 MB.
BROADCAST_KEYS = 500_000
#: Keys with very many rows that attach() broadcasts at most.
HOT = 2000
#: Rows that a key has to have at least for that.
OFTEN = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder, the one that the session's spark.checkpoint.dir names.

    Without that setting a session on one machine (master local, as in tests) gets a
    private folder; any other raises, as only a shared folder survives a lost executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="assayer-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """`df` read back from the shared checkpoint folder, without its lineage."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A frame as a Parquet table in the shared checkpoint folder, read back as `frame`.

    For loops: what checkpoint() gives back keeps the estimated sizes of the plan
    it came from, and these multiply with every join, round after round, until
    planning takes longer than the work. Tables that are left go with the
    application.
    """

    def __init__(self, df: DataFrame, folder: str | None = None):
        spark = df.sparkSession
        with_checkpoints(spark)
        folder = folder or f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        self.frame = spark.read.schema(df.schema).parquet(folder)
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path)

    def next(self, df: DataFrame, folder: str | None = None) -> Written:
        """`df` written in its turn; this table, which `df` may read, goes."""
        new = Written(df, folder)
        self.files.delete(self.path, True)
        return new


def without(rows: DataFrame, on: Column, keys: DataFrame) -> DataFrame:
    """`rows` that match none of `keys`, which is read more than once.

    Up to BROADCAST_KEYS keys (numbers) are broadcast, so that whole texts need no
    shuffle; beyond that both sides are shuffled.
    """
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_anti")


def ship(spark: SparkSession, value):
    """A broadcast of any object, with the code of its class: executors need no copy of this package. See opened()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    """What ship() sent, unpacked once in each worker process."""
    raw, cache = shared.value, worker_cache()
    key = ("opened", len(raw), hash(raw))
    if key not in cache:
        for k in [k for k in cache if k[0] == "opened"]:  # one at a time: earlier ones are of earlier jobs
            del cache[k]
        cache[key] = pickle.loads(raw)
    return cache[key]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process it is asked in."""
    return sys.__dict__.setdefault("_assayer_worker_cache", {})


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row.

    Catalyst may copy an expression into every iteration of a lambda that
    mentions it; a lambda's own variable is always a finished value.
    """
    return F.transform(F.array(value), body)[0]


def attach(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` joined with `table`, which has each key once and in n how many of the `total` rows have it.

    Keys with very many rows, at most HOT of them, are joined by broadcast, so that
    no task gets all rows of one key.
    """
    often = max(OFTEN, -(-total // HOT))
    if total < often:
        return rows.join(table.drop("n"), key)
    hot = cut(table.where(F.col("n") >= often).drop("n"))
    if hot.isEmpty():
        return rows.join(table.drop("n"), key)
    cold = table.where(F.col("n") < often).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of each node of an edge list, as the smallest node in it.

    edges: columns a and b of one orderable type; direction, repeats, loops and
    nulls don't matter. Returns (node, component), a row for every node that
    has an edge to another node.

    Alternating large-star and small-star steps: each joins the edge list with
    a minimum for every node, hubs by broadcast (see attach), so no node's
    neighbours are ever gathered in one place, and the number of edges doesn't
    grow. A round's edges are written, and the loop ends once every edge points to
    a root.
    """
    e = edges.select("a", "b").where("a <> b")
    table = Written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        e = table.frame
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            e.select(F.col("b").alias("n"), F.lit(0), F.lit(1))
        )
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        now = ends.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("edges"), F.max(F.expr("up > 1 or (up > 0 and down > 0)")).alias("open"), F.max(F.expr("up + down")).alias("most")).first()
        if not now["open"]:
            break
        hubs = now["most"] >= OFTEN
        with_low = lambda edges, low, key, total: attach(edges, low, key, total) if hubs else edges.join(low.drop("n"), key)
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_low(both, low, "u", 2 * now["edges"]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large) if hubs else large
        # small star: the smaller neighbours of u, and u, hang on the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_low(large, low, "a", now["edges"])
        small = small.select("a", F.col("m").alias("b")).unionAll(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        table = table.next(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b")).distinct())
