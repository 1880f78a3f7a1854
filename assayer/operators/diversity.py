"""Diversity filters and selections, most of them dependent on the order of arrival.

The filters that walk through a run with a growing memory have exact parallel
forms here: windows over (bucket, candidate), and for leaders the
lexicographically first maximal independent set, in rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.transforms import lin_thresh
from assayer.operators.order import rank
from assayer.operators.shared import cut
from assayer.operators.tiles import TILE, WORDS, _packed, near, tanimoto, within


def output(n: Column, most: int, mode: str = "binary") -> Column:
    """What is left of a score in a bucket of n: all of it (binary), less the fuller (linear, sigmoid), 0 beyond `most`."""
    f = n.cast("double") / float(most)
    left = {"binary": F.lit(1.0), "linear": 1.0 - f, "sigmoid": 1.0 - 1.0 / (1.0 + F.exp(-(2.0 * f - 1.0) / 0.15))}[mode]
    return F.when(n == 0, 1.0).when(n > most, 0.0).otherwise(left)


def unique_filter(run: DataFrame, score: str) -> Column:
    return F.when(F.col("unique"), F.col(score)).otherwise(0.0)


def occurrence_filter(run: DataFrame, score: str, tolerance: int, buffer: int) -> Column:
    """Falls linearly with the number of earlier occurrences beyond the tolerance."""
    return F.col(score) * lin_thresh(F.col("occurrences"), "minimize", upper=0, lower=tolerance, buffer=buffer)


def scaffold_filter(run: DataFrame, score: str, bucket: str, candidate: str, most: int = 25, least: float = 0.6, mode: str = "binary", memory: DataFrame | None = None) -> DataFrame:
    """`run` with `recorded`, `in_bucket` and `filtered`.

    The first time a candidate reaches `least` it is recorded in its bucket and its
    score multiplied by the output for the bucket's size; after that its repeats
    score 0. Other rows keep their score. memory: (bucket, candidate, ord) recorded
    in earlier batches.
    """
    rows = run.withColumn("_new", F.lit(True))
    if memory is not None:
        old = memory.select(F.col(bucket), F.col(candidate), (F.col("ord") - F.lit(1 << 62)).alias("idx"), F.lit(float("inf")).alias(score), F.lit(False).alias("_new"))
        rows = rows.unionByName(old, allowMissingColumns=True)
    same = Window.partitionBy(bucket, candidate)
    rows = rows.withColumn("_first", F.min(F.when(F.col(score) >= least, F.col("idx"))).over(same))
    rows = rows.withColumn("recorded", F.coalesce(F.col("idx") == F.col("_first"), F.lit(False)))
    # the running number of records: counted over records alone, so that a bucket's other rows don't pass through one task
    w = Window.partitionBy(bucket).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rec = rows.where("recorded").select(F.col(bucket), F.col("idx"), F.count("*").over(w).alias("_n"))
    rows = rows.join(rec.select(F.col("idx").alias("_i"), "_n"), F.col("idx") == F.col("_i"), "left").drop("_i")
    value = F.when(F.col("idx") > F.col("_first"), 0.0).when(F.col("recorded"), F.col(score) * output(F.col("_n"), most, mode)).otherwise(F.col(score))
    out = rows.withColumn("filtered", value).withColumn("in_bucket", F.coalesce("_n", F.lit(0)))
    return out.where("_new").drop("_new", "_first", "_n")


def passes(filtered: Column, raw: Column) -> Column:
    """Whether a filter left a score as it was; a raw score of 0 always passes."""
    return filtered == raw


# --- leaders -----------------------------------------------------------------


def near_pairs(rows: DataFrame, at_least: float, id: str = "idx", words: str = "words") -> DataFrame:
    """(a, b, sim) with a < b of all pairs at least so similar, compared in tiles."""
    x = rows.select(F.col(id).cast("long").alias("id"), F.col(words).alias("words"))
    n = max(1, -(-x.count() // TILE))
    block = x.withColumn("_t", F.pmod(F.xxhash64("id"), F.lit(n)))
    left = block.withColumn("_i", F.col("_t")).withColumn("_j", F.explode(F.sequence(F.col("_t"), F.lit(n - 1).cast("long"))))
    right = block.select(F.col("id").alias("rid"), F.col("words").alias("rwords"), F.col("_t").alias("_rj")).withColumn("_ri", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rj"))))

    def tile(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b, s = [], [], []
        if x.num_rows and y.num_rows:
            wx, wy, ix, iy = _packed(x), _packed(y, "rwords"), x.column("id").to_numpy(), y.column("rid").to_numpy()
            same = x.column("_i")[0].as_py() == y.column("_rj")[0].as_py()
            for k in range(0, len(wx), 256):
                sim = tanimoto(wx[k : k + 256], wy)
                i, j = np.nonzero(sim >= at_least)
                p, q = ix[k + i], iy[j]
                keep = p < q if same else np.ones(len(p), bool)
                a.append(np.minimum(p, q)[keep])
                b.append(np.maximum(p, q)[keep])
                s.append(sim[i, j][keep])
        cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
        return pa.table({"a": cat(a, np.int64), "b": cat(b, np.int64), "sim": cat(s, np.float64)})

    return left.select("id", "words", "_i", "_j").groupBy("_i", "_j").cogroup(right.groupBy("_ri", "_rj")).applyInArrow(tile, "a long, b long, sim double")


#: Pairs that one task walks at most, 16 bytes each.
ONE_TASK = 1_000_000


def _followers(table):
    """The rows with an earlier neighbour that leads, given all pairs a < b."""
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    order = np.lexsort((a, b))
    out: set[int] = set()
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if x not in out:  # all of x's own pairs have been seen, as x < y
            out.add(y)
    return pa.table({"id": pa.array(sorted(out), pa.int64())})


def leaders(ids: DataFrame, pairs: DataFrame, id: str = "idx", parallel_rounds: int = 50) -> DataFrame:
    """(id) of the rows that no earlier leader is near: the greedy pass, in rounds.

    Each round accepts undecided rows without an undecided earlier neighbour, and
    drops the neighbours of those. Once ONE_TASK pairs or fewer are left, one task
    walks them. Long chains of neighbours would take a round for every two of them:
    after `parallel_rounds`, a round is the walk over the earliest pairs, about
    ONE_TASK / 2 of them, so that any table is done in a bounded number of rounds.
    """
    pairs = cut(pairs.select("a", "b"))
    undecided = cut(ids.select(F.col(id).cast("long").alias("id")))
    walked = lambda p: p.groupBy(F.lit(1).alias("_g")).applyInArrow(_followers, "id long")
    chosen, rounds = None, 0
    while True:
        n = pairs.count()
        if n <= ONE_TASK:
            accepted = undecided.join(walked(pairs), "id", "left_anti")
            return cut(accepted if chosen is None else chosen.unionAll(accepted))
        if rounds < parallel_rounds:
            blocked = pairs.select(F.col("b").alias("id")).distinct()
            accepted = undecided.join(blocked, "id", "left_anti")
        else:
            until = pairs.approxQuantile("b", [min(1.0, ONE_TASK / 2 / n)], 0.25 * min(1.0, ONE_TASK / 2 / n))[0]
            accepted = undecided.where(F.col("id") <= until).join(walked(pairs.where(F.col("b") <= until)), "id", "left_anti")
        rounds += 1
        accepted = cut(accepted)
        chosen = accepted if chosen is None else chosen.unionAll(accepted)
        gone = pairs.join(accepted.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        out = accepted.unionAll(gone)
        undecided, chosen = cut(undecided.join(out, "id", "left_anti")), cut(chosen)
        if undecided.isEmpty():
            return chosen
        left = undecided
        pairs = cut(pairs.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))


def assign(ids: DataFrame, pairs: DataFrame, chosen: DataFrame, id: str = "idx", earlier: bool = True) -> DataFrame:
    """(id, leader): each row's most similar leader, the first on ties; of earlier ones only, or of all. Leaders lead themselves."""
    both = pairs.select(F.col("b").alias("id"), F.col("a").alias("leader"), "sim")
    if not earlier:
        both = both.unionAll(pairs.select(F.col("a").alias("id"), F.col("b").alias("leader"), "sim"))
    near = both.join(chosen.withColumnRenamed("id", "leader"), "leader", "left_semi")
    best = near.groupBy("id").agg(F.max_by("leader", F.struct("sim", -F.col("leader"))).alias("leader"))
    own = chosen.select("id", F.col("id").alias("leader"))
    rest = ids.select(F.col(id).cast("long").alias("id")).join(chosen, "id", "left_anti").join(best, "id")
    return rest.unionByName(own)


def similarity_filter(run: DataFrame, score: str, candidate: str, words: str = "words", most: int = 25, least: float = 0.6, similar: float = 0.6, mode: str = "binary", founder: str | None = None) -> DataFrame:
    """The scaffold filter with leader clusters as buckets; rows below `least` take no part.

    A candidate founds a cluster if no earlier founder is at least so similar.
    founder: what is compared instead of the candidate, such as its scaffold, which
    `words` then belong to.
    """
    founder = founder or candidate
    able = run.where(F.col(score) >= least)
    firsts = able.groupBy(founder).agg(F.min("idx").alias("idx"), F.min_by(words, "idx").alias(words))
    firsts = cut(firsts)
    pairs = cut(near_pairs(firsts, similar, "idx", words))
    cluster = assign(firsts, pairs, leaders(firsts, pairs))
    named = firsts.select(founder, "idx").join(cluster.withColumnRenamed("id", "idx"), "idx").select(F.col(founder).alias("_c"), F.col("leader").alias("cluster"))
    rows = run.join(named, (F.col(founder) == F.col("_c")) & (F.col(score) >= least), "left").drop("_c")
    bucket = rows.withColumn("_bucket", F.coalesce(F.col("cluster"), F.lit(-1)))
    return scaffold_filter(bucket, score, "_bucket", candidate, most, least, mode).drop("_bucket")


#: Vectors that one task walks at a time.
WALK = 16_384


def _kept(words: np.ndarray, at_least: float) -> list[int]:
    """Positions of the vectors that no earlier kept one is near."""
    kept: list[int] = []
    for k in range(0, len(words), 256):
        own = words[k : k + 256]
        free, among = np.ones(len(own), bool), np.zeros((len(own), len(own)), bool)
        for i, _, close in near(own, words[kept], at_least):
            free[i] &= ~close.any(1)
        for i, j, close in near(own, own, at_least):
            among[i, j : j + close.shape[1]] = close
        for i in range(len(own)):
            if free[i]:
                kept.append(k + i)
                free &= ~among[i]
    return kept


def _each(rows: DataFrame, id: str, words: str) -> DataFrame:
    """(words, id, n): every vector once, with the first id that has it and how many have."""
    return cut(rows.groupBy(F.col(words).alias("words")).agg(F.min(F.col(id).cast("long")).alias("id"), F.count("*").alias("n")))


def near_leaders(rows: DataFrame, at_least: float, id: str = "idx", words: str = "words") -> DataFrame:
    """(id, words) of the rows that no earlier leader is at least so similar to, from the vectors themselves, without their pairs.

    Copies are folded into the first of them. In turn, one task walks the earliest
    vectors left, WALK at most, and all others are compared with the leaders that
    it finds; what is near one is left out of further rounds. Each round takes
    WALK / 2 vectors at least.
    """
    return _leaders_of(_each(rows, id, words), at_least)


def _leaders_of(each: DataFrame, at_least: float) -> DataFrame:
    """near_leaders of vectors without copies."""

    def walk(table: pa.Table) -> pa.Table:
        table = table.select(["id", "words"]).sort_by("id")
        table = table.take(_kept(_packed(table), at_least))
        return table.set_column(1, "words", table.column("words").cast(WORDS))

    left = each.select("id", "words")
    chosen, rounds = None, 0
    while True:
        n = left.count()
        until = left.approxQuantile("id", [0.75 * WALK / n], 0.2 * WALK / n)[0] if n > WALK else None
        first = left if until is None else left.where(F.col("id") <= until)
        found = cut(first.groupBy(F.lit(1).alias("_g")).applyInArrow(walk, "id long, words array<long>"))
        chosen, rounds = found if chosen is None else chosen.unionAll(found), rounds + 1
        if until is None:
            return cut(chosen)
        if rounds % 16 == 0:
            chosen = cut(chosen)
        rest = within(left.where(F.col("id") > until), found.withColumn("n", F.lit(1)), at_least)
        left = cut(rest.where("hits = 0").select("id", "words"))


def sphere_exclusion(rows: DataFrame, distance: float = 0.65, id: str = "idx", words: str = "words") -> DataFrame:
    """(id): a greedy set in which all are more than `distance` apart, in the order of id."""
    return near_leaders(rows, 1.0 - distance, id, words).select("id")


def sphere_exclusion_diversity(rows: DataFrame, distance: float = 0.65, normalize: bool = True, k: int | None = None, seed: int = 123, id: str = "idx", words: str = "words") -> float:
    """How many rows a sphere exclusion leaves, of all rows or of a seeded sample of k; as a share if normalised."""
    if k is not None:
        rows = seeded_sample(rows, k, seed, id)
    n = rows.count()
    if n == 0:
        return 0.0
    kept = sphere_exclusion(rows, distance, id, words).count()
    return kept / n if normalize else float(kept)


def seeded_sample(rows: DataFrame, k: int, seed: int = 123, id: str = "idx") -> DataFrame:
    """k rows without replacement at numpy's legacy positions for the seed, in the order of id; all rows if there are fewer."""
    n = rows.count()
    if n <= k:
        return rows
    at = np.random.RandomState(seed).choice(n, k, replace=False)
    from assayer.operators.order import position

    want = rows.sparkSession.createDataFrame([(int(i) + 1,) for i in at], "_pos long")
    return position(rows, id, "_pos").join(F.broadcast(want), "_pos").drop("_pos")


def _named(rows: DataFrame, found: DataFrame, id: str, words: str) -> DataFrame:
    """(id, leader) of `rows`, given that of their vectors (words, leader)."""
    return rows.select(F.col(id).cast("long").alias("id"), F.col(words).alias("words")).join(found, "words").select("id", "leader")


def sphere_exclusion_clusters(rows: DataFrame, distance: float = 0.65, id: str = "idx", words: str = "words") -> DataFrame:
    """(id, leader): every row with its nearest leader."""
    return _named(rows, _led(rows, distance, id, words).select("words", "leader"), id, words)


def sphere_exclusion_sizes(rows: DataFrame, distance: float = 0.65, id: str = "idx", words: str = "words") -> DataFrame:
    """(leader, size) of the same clusters, from every vector once and its number of rows, without naming each row's leader."""
    return _led(rows, distance, id, words).groupBy("leader").agg(F.sum("n").alias("size"))


def _led(rows: DataFrame, distance: float, id: str, words: str) -> DataFrame:
    """(words, leader, n): every vector with its nearest leader and its number of rows.

    Each is at least 1 - distance like one, so only what is so near is weighed.
    """
    each = _each(rows, id, words)
    chosen = _leaders_of(each, 1.0 - distance).withColumn("n", F.lit(1))
    return within(each, chosen, 1.0 - distance, nearest=True, keep=["n"]).select("words", F.col("best").alias("leader"), "n")


def butina_within(rows: DataFrame, at_least: float, id: str = "idx", words: str = "words") -> DataFrame:
    """(id, leader): butina without reordering, of vectors at least so similar, from the vectors themselves.

    Neighbours are counted, never listed; copies are compared once and counted as often as there are.
    """
    each = cut(rows.groupBy(F.col(words).alias("words")).agg(F.count("*").alias("n"), F.max(F.col(id).cast("long")).alias("id")))
    degree = cut(within(each, each, at_least).select("id", "words", "hits"))
    order = cut(rank(degree, [F.desc("hits"), F.desc("id")], "r").select("id", "words", "r"))
    chosen = near_leaders(order, at_least, "r")
    led = within(order.select(F.col("r").alias("id"), "words"), chosen.withColumn("n", F.lit(1)), at_least)
    found = led.join(order.select(F.col("id").alias("leader"), F.col("r").alias("first")), "first").select("words", "leader")
    return _named(rows, found, id, words)


def butina(rows: DataFrame, pairs: DataFrame, id: str = "idx", reordering: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(id, leader): the row with the most neighbours leads them, then the next of the rest; later rows first on ties.

    pairs: (a, b) within the threshold. Without reordering neighbours are counted
    once, and the clusters are those of leaders in that order. With it, they are
    counted anew after each cluster.
    """
    ids = rows.select(F.col(id).cast("long").alias("id"))
    both = cut(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    if not reordering:
        degree = both.groupBy("a").agg(F.count("*").alias("d"))
        ranked = ids.join(degree.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
        order = cut(rank(ranked, [F.desc("d"), F.desc("id")], "r"))
        p = both.join(order.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(order.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
        p = cut(p.where("ra < rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        chosen = leaders(order.select(F.col("r").alias("idx")), p)
        near = p.join(chosen.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("l")).withColumnRenamed("b", "id")
        all_ = near.join(chosen, "id", "left_anti").unionByName(chosen.select("id", F.col("id").alias("l")))
        name = order.select(F.col("r").alias("_r"), F.col("id").alias("_name"))
        out = all_.join(name, all_["id"] == name["_r"]).select(F.col("_name").alias("id"), "l")
        name = order.select(F.col("r").alias("l"), F.col("id").alias("leader"))
        return out.join(name, "l").select("id", "leader")
    left, done = cut(ids), None
    for _ in range(max_rounds):
        degree = both.groupBy("a").agg(F.count("*").alias("d")).withColumnRenamed("a", "id")
        top = left.join(degree, "id", "left").agg(F.max(F.struct(F.coalesce("d", F.lit(0)), "id"))["id"].alias("leader")).first()["leader"]
        if top is None:
            return done if done is not None else ids.select("id", F.col("id").alias("leader"))
        members = both.where(F.col("a") == top).select(F.col("b").alias("id")).unionAll(ids.where(F.col("id") == top)).distinct()
        mine = cut(members.select("id", F.lit(top).cast("long").alias("leader")))
        done = mine if done is None else done.unionAll(mine)
        left = cut(left.join(mine, "id", "left_anti"))
        both = cut(both.join(mine.select(F.col("id").alias("a")), "a", "left_anti").join(mine.select(F.col("id").alias("b")), "b", "left_anti"))
    raise RuntimeError("butina did not settle")


def levenshtein_pairs(rows: DataFrame, text: str, distance: int = 3, id: str = "idx") -> DataFrame:
    """(a, b) with a < b of strings within an edit distance.

    Strings that are near share one of distance + 1 pieces, at a place moved by
    the distance at most; that equi-join comes before the edit distance. Equal
    strings are compared once.
    """
    named = rows.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("s"))
    words = named.select("s").distinct().withColumn("n", F.length("s"))
    short = words.where(F.col("n") <= distance)
    k = distance + 1

    def piece(i: int, n: Column) -> tuple[Column, Column]:
        begin = F.floor(n * i / k).cast("int")
        return begin, F.floor(n * (i + 1) / k).cast("int") - begin

    cuts = words.where(F.col("n") > distance).select("s", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), piece(i, F.col("n"))[0].alias("at"), F.substring("s", piece(i, F.col("n"))[0] + 1, piece(i, F.col("n"))[1]).alias("p")) for i in range(k)])).alias("c"))
    cuts = cuts.select("s", "n", "c.i", "c.p", "c.at")
    probe = words.select(F.col("s").alias("t"), F.col("n").alias("m"))
    ask = probe.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(k), F.col("m") - distance), F.greatest(F.lit(k), F.col("m") + distance)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    begin, size = F.floor(F.col("n") * F.col("i") / k).cast("int"), (F.floor(F.col("n") * (F.col("i") + 1) / k) - F.floor(F.col("n") * F.col("i") / k)).cast("int")
    ask = ask.withColumns({"_b": begin, "_l": size}).withColumn("_at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_b") - distance), F.col("_b") + distance)))
    ask = ask.select("t", "n", "i", F.expr("substring(t, _at + 1, _l)").alias("p")).distinct()
    found = cuts.join(ask, ["n", "i", "p"]).select("s", "t")
    tiny = short.select("s").crossJoin(F.broadcast(probe.where(F.col("m") <= 2 * distance).select("t"))) if not short.isEmpty() else found.limit(0)
    found = found.unionAll(tiny)
    found = found.unionAll(found.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
    near = found.where(F.levenshtein("s", "t") <= distance)
    left = named.select(F.col("id").alias("a"), "s")
    right = named.select(F.col("id").alias("b"), F.col("s").alias("t"))
    return near.join(left, "s").join(right, "t").where("a < b").select("a", "b")


def pick_clusters(clusters: DataFrame, n: int, how: str = "largest") -> DataFrame:
    """(leader, size) of n clusters: the largest, the smallest, or evenly spaced in size; ties go to the smaller leader."""
    return pick_sizes(clusters.groupBy("leader").agg(F.count("*").alias("size")), n, how)


def pick_sizes(sizes: DataFrame, n: int, how: str = "largest") -> DataFrame:
    """pick_clusters of clusters given as (leader, size)."""
    if how == "largest":
        return sizes.orderBy(F.desc("size"), "leader").limit(n)
    if how == "smallest":
        return sizes.orderBy("size", "leader").limit(n)
    if how != "range":
        raise ValueError("how is largest, smallest or range")
    total = sizes.count()
    at = sorted({int(x) + 1 for x in np.linspace(0, total - 1, n)}) if total else []
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy("size", "leader")))
    return ranked.where(F.col("_r").isin(at)).drop("_r")


def maxmin(rows: DataFrame, n: int, seed: int = 123, id: str = "idx", words: str = "words") -> list[int]:
    """n ids, each the farthest from those before; the first by seed, the smallest id on ties.

    A pick is one aggregate over the rows with their distance so far.
    """
    x = cut(rows.select(F.col(id).cast("long").alias("id"), F.col(words).alias("words")))
    total = x.count()
    if total == 0:
        return []
    from assayer.functions.similarity import bit_similarity
    from assayer.operators.order import position

    at = int(np.random.RandomState(seed).randint(total)) + 1
    first = position(x, "id", "_p").where(F.col("_p") == at).first()
    picked, last = [first["id"]], first["words"]
    x = x.withColumn("far", F.lit(2.0))
    while len(picked) < min(n, total):
        x = x.withColumn("far", F.least("far", 1.0 - bit_similarity(F.col("words"), F.array(*[F.lit(w) for w in last]))))
        if len(picked) % 16 == 0:
            x = cut(x)
        best = x.where(~F.col("id").isin(picked)).agg(F.max(F.struct("far", -F.col("id"), "words")).alias("b")).first()["b"]
        picked.append(-best[1])
        last = best["words"]
    return picked


class Buffer:
    """The best scores among vectors that differ, in the order of arrival.

    The first `size` rows fill it. A later row below its lowest score is ignored;
    one like a centroid raises that centroid's score, if better, and joins it;
    any other replaces the lowest.
    """

    def __init__(self, size: int, similar: float):
        self.size, self.similar = size, similar
        self.ids: list[int] = []
        self.members: list[int] = []
        self.scores, self.prints = np.zeros(size), None

    def add(self, i: int, score: float, words: np.ndarray) -> None:
        if self.prints is None:
            self.prints = np.zeros((self.size, len(words)), np.uint64)
        n = len(self.ids)
        if n < self.size:
            self.ids.append(i)
            self.members.append(0)
            self.scores[n], self.prints[n] = score, words
        elif score >= self.scores.min():
            near = tanimoto(words[None, :], self.prints)[0]
            k = int(near.argmax())
            if near[k] > self.similar:
                self.scores[k] = max(self.scores[k], score)
                self.members[k] += 1
            else:
                k = int(self.scores.argmin())
                self.ids[k], self.scores[k], self.prints[k], self.members[k] = i, score, words, 0

    def top(self, n: int) -> float:
        own = np.sort(self.scores[: len(self.ids)])[::-1][:n]
        return float(own.mean()) if len(own) else float("nan")


def _walk(table: pa.Table, buffer: Buffer, each=None) -> None:
    for b in table.sort_by("_o").to_batches(max_chunksize=10_000):
        part = pa.Table.from_batches([b])
        for o, s, w in zip(part.column("_o").to_pylist(), part.column("_s").to_pylist(), _packed(part)):
            if each:
                each(buffer)
            buffer.add(o, s, w)


def diverse_buffer(rows: DataFrame, score: str, size: int = 100, similar: float = 0.35, order: str = "idx", words: str = "words", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, centroid, score, members): the buffer after all rows, for each run of `keys`.

    A run is walked in its order by one task: what a row does depends on all before it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "centroid long, score double, members long"
    x = rows.select(*keys, F.col(order).cast("long").alias("_o"), F.col(score).cast("double").alias("_s"), F.col(words).alias("words"))

    def whole(key, table):
        buffer = Buffer(size, similar)
        _walk(table, buffer)
        n = len(buffer.ids)
        own = {k: pa.array([v.as_py()] * n) for k, v in zip(keys, key)}
        return pa.table({**own, "centroid": pa.array(buffer.ids, pa.int64()), "score": buffer.scores[:n], "members": pa.array(buffer.members, pa.int64())})

    if keys:
        return x.groupBy(*keys).applyInArrow(whole, schema)
    return x.groupBy(F.lit(1).alias("_g")).applyInArrow(lambda table: whole((), table), schema)


def diverse_top(rows: DataFrame, score: str, budget: int, top_n: Sequence[int] = (1, 10, 100), window: int = 100, extrapolate: bool = False, similar: float = 0.35, words: str = "words") -> DataFrame:
    """(n, avg, auc): top-n averages of a buffer of max(n) after all rows, and the area under them over the budget.

    `rows` have pos, dense from 1. For the area the buffer sees the rows below the budget only.
    """
    from assayer.operators.runlog import _area

    x = rows.select(F.col("pos").cast("long").alias("_o"), F.col(score).cast("double").alias("_s"), F.col(words).alias("words"))
    tops = sorted(set(top_n))

    def trace(table):
        total, values = table.num_rows, []
        buffer, seen = Buffer(max(tops), similar), 0
        marks = range(window, min(total, budget), window)

        def mark(b, cp, before, last):
            values.extend((n, cp, before, last, b.top(n)) for n in tops)

        def each(b):
            nonlocal seen
            if seen and seen in marks:
                mark(b, seen, seen - window, False)
            if seen == budget:
                mark(b, total, (len(marks)) * window, True)
            seen += 1

        _walk(table, buffer, each)
        if seen <= budget:
            mark(buffer, total, len(marks) * window, True)
        values.extend((n, -1, 0, True, buffer.top(n)) for n in tops)
        cols = list(zip(*values))
        return pa.table({"n": pa.array(cols[0], pa.int32()), "cp": pa.array(cols[1], pa.int64()), "before": pa.array(cols[2], pa.int64()), "last": pa.array(cols[3]), "v": pa.array(cols[4], pa.float64())})

    traced = cut(x.groupBy(F.lit(1).alias("_g")).applyInArrow(trace, "n int, cp long, before long, last boolean, v double"))
    area = _area(traced.where("cp >= 0"), ["n"], budget, extrapolate).withColumnRenamed("value", "auc")
    return traced.where("cp < 0").select("n", F.col("v").alias("avg")).join(area, "n")


def _solved_ones(a: np.ndarray) -> np.ndarray:
    """x of a x = 1, whose sum is that of a's inverse.

    By elimination with pivots in place of a threaded LAPACK, which can hang beside the JVM.
    """
    a = np.hstack([a, np.ones((len(a), 1))])
    n = len(a)
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        a[[k, p]] = a[[p, k]]
        a[k + 1 :, k:] -= (a[k + 1 :, k] / a[k, k])[:, None] * a[k, k:]
    x = a[:, n].copy()
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (a[k, k + 1 : n] * x[k + 1 :]).sum()) / a[k, k]
    return x


def solow_polasky(rows: DataFrame, words: str = "words", normalize: bool = True, k: int = 1000, seed: int = 123, id: str = "idx") -> float:
    """Sum of the inverse of exp(-10 d) over distinct rows of distances, of a seeded sample of k rows at most."""
    got = seeded_sample(rows, k, seed, id).orderBy(id).select(words).toArrow()  # k rows
    x = np.array(got.column(0).to_pylist(), dtype=np.int64).view(np.uint64)
    if not len(x):
        return 0.0
    d = 1.0 - tanimoto(x, x)
    _, first = np.unique(d, axis=0, return_index=True)
    d = d[np.sort(first)][:, np.sort(first)]
    total = float(_solved_ones(np.exp(-10.0 * d)).sum())
    return total / len(x) if normalize else total
