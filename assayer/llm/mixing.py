"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, form blocks. One slot takes one block. A
source of weight w (its share of all weights) gives its j-th block the window
from floor(j / w) to ceil((j + 1) / w), and earliest deadline first picks, for
every slot, among the blocks that are released. All windows can be met, so after
any number T of slots a source has had w T blocks, give or take less than one.

Weights are whole numbers, so the schedule repeats after as many slots as the
weights sum to. That cycle is planned once, from the weights and the number of
blocks of each source alone; a row's slot then follows from its number within its
source by arithmetic and two joins with tables whose sizes are bounded by
`MAX_SOURCES` and `MAX_CYCLE`, the second written to the shared folder. When a source
has run out, a new phase begins with the weights of the sources that are left, so
every row gets a slot.

The schedule holds `MAX_SOURCES` streams. Where there are more sources, those with a
weight of their own come first, then the larger ones; all others flow together as one
stream, in hash order, with the sum of their weights (as much of it as `MAX_CYCLE`
leaves). That stream keeps its target as any source does; its sources share it in
proportion to their rows.

Rows are numbered in two steps, within (source, hash bucket) and by the buckets'
running totals, so a source with any share of all rows is spread over many tasks.

Defined results: a null source is a source of its own; sources without a weight
get `default_weight`; repeated rows are rows; rows of equal hash and doc_id are
ordered by n_chars and text where they exist, and are alike otherwise; null doc_ids
are ordered by the hash of n_chars, if there is one; null, empty and very long texts don't
matter; other columns, whatever their names, come back; an empty table gives an
empty result; weights that aren't whole numbers from 1, or whose sum `MAX_CYCLE` can't
hold, raise.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping
from math import ceil, gcd, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import BROADCAST_KEYS, cut

#: Streams of the schedule; further sources share the last one.
MAX_SOURCES = 256
#: The largest sum of weights, which is the length of the schedule's cycle.
MAX_CYCLE = 8192
#: Rows that a hash bucket holds, about.
BUCKET_ROWS = 20_000

#: The registered query's target weights; other sources weigh 2.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 4, "src4": 4}


def cycle(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one cycle, by earliest deadline first.

    The cycle has sum(weights) / gcd(weights) slots. Equal deadlines go by name.
    """
    common = gcd(*weights.values())
    share = {s: w // common for s, w in weights.items()}
    length = sum(share.values())
    release = sorted((j * length // q, -(-(j + 1) * length // q), s) for s, q in share.items() for j in range(q))
    ready: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {s: [] for s in share}
    k = 0
    for slot in range(length):
        while k < len(release) and release[k][0] <= slot:
            heapq.heappush(ready, release[k][1:])
            k += 1
        deadline, source = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        slots[source].append(slot)
    return slots


def plan(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[dict]:
    """The phases: for each of its sources the first block, how many, and the cycle's slots.

    A phase ends with the slot that takes some source's last block.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    done, begin, phase, phases = dict.fromkeys(left, 0), 0, 0, []
    while left:
        slots = cycle({s: weights[s] for s in left})
        length = sum(map(len, slots.values()))
        slot_of = lambda s, j: j // len(slots[s]) * length + slots[s][j % len(slots[s])]
        end = min(slot_of(s, n - 1) for s, n in left.items()) + 1
        for s in list(left):
            n = end // length * len(slots[s]) + sum(x < end % length for x in slots[s])
            used = slots[s] if end >= length else slots[s][:n]
            phases.append({"phase": phase, "begin": begin, "length": length, "source": s, "first": done[s], "count": n, "share": len(slots[s]), "slots": used})
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        begin, phase = begin + end, phase + 1
    return phases


def _small(spark, rows: list[dict], schema: str) -> DataFrame:
    """A table from literals, by SQL functions alone."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


#: Rows of a plan's literal; longer tables are written piece by piece.
LITERAL = 20_000


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """The same for more rows: no plan holds more than LITERAL of them."""
    if len(rows) <= LITERAL:
        return _small(spark, rows, schema)
    pieces = [cut(_small(spark, rows[k : k + LITERAL], schema)) for k in range(0, len(rows), LITERAL)]
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionAll(p)
    return whole


def stream_weights(alone: list[str], given: Mapping[str, int], default_weight: int, others: int) -> dict[str, int]:
    """The weight of each stream: of the sources on their own, and of the one that `others` share."""
    if any(not isinstance(w, int) or w < 1 for w in (*given.values(), default_weight)):
        raise ValueError("weights are whole numbers from 1")
    weight = {s: given.get(s, default_weight) for s in alone}
    if others:
        weight[REST] = max(1, min(others * default_weight, MAX_CYCLE - sum(weight.values())))
    if sum(weight.values()) > MAX_CYCLE:
        raise ValueError(f"the weights' sum is at most {MAX_CYCLE}")
    return weight


#: The stream that sources beyond MAX_SOURCES share.
REST = "rest"


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default_weight: int = 2, block: int = 64) -> DataFrame:
    """Every row of `docs` (doc_id, source) as struct `row`, with its place in the mix.

    Columns: block (number within the source), phase, slot, place (within the
    block), position (slot * block + place, the order to read in), release and
    deadline (the block's window, in slots from the start of its phase).
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("s:"), F.col("row.source").cast("string")), F.lit("null"))
    more = [c for c in ("n_chars",) if c in docs.columns]
    keyed = docs.select(F.struct("*").alias("row")).select("row", name.alias("key"), hash_of(F.col("row.doc_id"), [F.col(f"row.{c}") for c in more]).alias("h"))

    total = docs.count()
    bits = min(20, max(6, ceil(log2(max(1, total) / BUCKET_ROWS)) if total > BUCKET_ROWS else 6))
    few = docs.select(F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")).alias("key"), bucket_of(hash_of(F.col("doc_id"), [F.col(c) for c in more]), bits).alias("bucket"))
    given = {f"s:{s}": w for s, w in weights.items()}
    # the largest sources and those with a weight; one row more tells whether there are others
    sizes = few.groupBy("key").agg(F.count("*").alias("n"))
    first = sizes.orderBy(~F.col("key").isin(list(given)), F.desc("n"), "key").limit(MAX_SOURCES).collect()
    if len(first) == MAX_SOURCES and (others := sizes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first())["k"] > MAX_SOURCES:
        alone = first[: MAX_SOURCES - 1]
        keep = F.broadcast(_small(spark, [{"key": r["key"]} for r in alone], "key string").withColumn("own", F.lit(True)))
        joint = lambda df: df.join(keep, "key", "left").withColumn("key", F.when(F.col("own"), F.col("key")).otherwise(REST)).drop("own")
        keyed, few = joint(keyed), joint(few)
        rows = {r["key"]: r["n"] for r in alone} | {REST: others["n"] - sum(r["n"] for r in alone)}
        weight = stream_weights([r["key"] for r in alone], given, default_weight, others["k"] - len(alone))
    else:
        rows = {r["key"]: r["n"] for r in first}
        weight = stream_weights(list(rows), given, default_weight, 0)
    per_bucket = few.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    phases = plan({s: -(-n // block) for s, n in rows.items()}, weight)

    spans = _table(spark, [{k: p[k] for k in ("source", "phase", "begin", "length", "first", "count", "share")} for p in phases], "source string, phase int, begin long, length int, first long, count long, share int")
    cycles = _table(spark, cycle_rows := [{"source": p["source"], "phase": p["phase"], "k": k, "at": x} for p in phases for k, x in enumerate(p["slots"])], "source string, phase int, k int, at int")

    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("key", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    ties = [F.col("row.doc_id"), *[F.col(f"row.{c}") for c in ("n_chars", "text") if c in docs.columns]]
    within = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h", *ties)) - 1
    numbered = keyed.withColumn("bucket", bucket_of(F.col("h"), bits)).withColumn("i", within).join(offsets, ["key", "bucket"])
    i = F.col("before") + F.col("i")
    placed = numbered.select("row", F.col("key"), F.expr(f"(before + i) div {block}").alias("block"), (i % block).cast("int").alias("place"))

    s = F.broadcast(spans.withColumnRenamed("source", "key"))
    placed = placed.join(s, "key").where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("count")))
    j = F.col("block") - F.col("first")
    placed = placed.withColumn("j", j).withColumn("k", (j % F.col("share")).cast("int"))
    cycles = cycles.withColumnRenamed("source", "key")
    placed = placed.join(F.broadcast(cycles) if len(cycle_rows) <= BROADCAST_KEYS else cycles, ["key", "phase", "k"])
    slot = F.col("begin") + F.expr("j div share") * F.col("length") + F.col("at")
    release = F.expr("(j * length) div share")
    deadline = F.expr("((j + 1) * length + share - 1) div share")
    return placed.select(
        "row", F.col("block").cast("long").alias("block"), "phase", slot.alias("slot"), "place", (slot * block + F.col("place")).alias("position"),
        release.alias("release"), deadline.alias("deadline"),
    )


def hash_of(doc_id: Column, more: list[Column]) -> Column:
    """What a source's rows are ordered by, before doc_id itself; `more` stands in for a null doc_id."""
    rest = F.md5(F.concat_ws(":", *[c.cast("string") for c in more]).cast("binary"))
    return F.coalesce(F.md5(doc_id.cast("string").cast("binary")), rest)


def bucket_of(h: Column, bits: int) -> Column:
    """The leading bits of a hash, so that buckets are in the order of the hashes."""
    return F.coalesce(F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32 - bits), F.lit(0).cast("long"))


def mix_order(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default_weight: int = 2, block: int = 64) -> DataFrame:
    """(doc_id, source) of every row of `docs` with its place in the mix."""
    m = mix(docs.select("doc_id", "source"), weights, default_weight, block)
    return m.select("row.*", *[c for c in m.columns if c != "row"])


def oracle_sql(weights: Mapping[str, int] = WEIGHTS, default_weight: int = 2, block: int = 64) -> str:
    """DuckDB SQL for `mix_order` over `documents` with unique doc_ids: the scheduler, a slot a step."""
    given = " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items())
    return f"""
WITH RECURSIVE src AS (SELECT source, coalesce('s:' || source, 'null') AS k, CASE source {given} ELSE {default_weight} END AS w, ceil(count(*) / {block}.0)::BIGINT AS b FROM documents GROUP BY source),
step AS (
  SELECT -1::BIGINT AS slot, 0 AS phase, 0::BIGINT AS start, 0 AS next_phase, 0::BIGINT AS next_start, list({{'k': k, 'w': w::BIGINT, 'b': b, 'g': 0::BIGINT, 'p': 0::BIGINT}} ORDER BY k) AS st,
    NULL::VARCHAR AS k, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline FROM src
  UNION ALL
  SELECT slot, phase, start, CASE WHEN ends THEN phase + 1 ELSE phase END, CASE WHEN ends THEN slot + 1 ELSE start END,
    list_transform(st, lambda x: {{'k': x.k, 'w': x.w, 'b': x.b, 'g': CASE WHEN x.k = pick.k THEN x.g + 1 ELSE x.g END, 'p': CASE WHEN ends THEN 0::BIGINT WHEN x.k = pick.k THEN x.p + 1 ELSE x.p END}}),
    pick.k, pick.g, pick.r, pick.d
  FROM (SELECT *, pick.g + 1 = pick.b AS ends FROM (
    SELECT slot, phase, start, st, list_sort(list_filter(list_transform(live, lambda x: {{'d': ((x.p + 1) * total + x.w - 1) // x.w, 'k': x.k, 'r': x.p * total // x.w, 'g': x.g, 'b': x.b}}), lambda x: x.r <= slot - start))[1] AS pick
    FROM (SELECT slot + 1 AS slot, next_phase AS phase, next_start AS start, st, list_filter(st, lambda x: x.g < x.b) AS live, list_sum(list_transform(list_filter(st, lambda x: x.g < x.b), lambda x: x.w))::BIGINT AS total FROM step)
    WHERE len(live) > 0))
), numbered AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS k, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS i FROM documents)
SELECT n.doc_id, n.source, s.block, s.phase, s.slot, (n.i % {block})::INT AS place, s.slot * {block} + n.i % {block} AS position, s.release, s.deadline
FROM numbered n JOIN step s ON s.k = n.k AND s.block = n.i // {block} AND s.slot >= 0
"""
