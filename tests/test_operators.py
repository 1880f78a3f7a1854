import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import batch, diversity, order, pareto, runlog, sets, tiles


# --- order -------------------------------------------------------------------


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_positions_and_running_values(spark, span):
    rng = random.Random(span)
    rows = [(i, rng.random()) for i in rng.sample(range(0, 3000, 3), 200)]
    df = spark.createDataFrame(rows, "idx long, x double")
    got = order.position(df, "idx", span=span)
    got = order.running(got, "idx", F.col("x"), "top", span=span)
    got = order.running_sum(got, "idx", F.lit(1), "n", span=span)
    got = sorted(order.rolling(got, "pos", {"mean": F.avg("x"), "seen": F.count("*")}, 9, span=span).collect())
    rows.sort()
    for k, r in enumerate(got):
        last = [x for _, x in rows[max(0, k - 8) : k + 1]]
        assert (r.idx, r.pos, r.n, r.seen) == (rows[k][0], k + 1, k + 1, len(last))
        assert r.top == max(x for _, x in rows[: k + 1]) and r.mean == pytest.approx(sum(last) / len(last))
    full = order.rolling(order.position(df, "idx"), "pos", {"mean": F.avg("x")}, 9, full=True, span=span)
    assert full.where("mean is null").count() == 8


# --- batches -----------------------------------------------------------------


def test_parse_marks_validity(spark):
    df = spark.createDataFrame([(0, " A  B "), (1, ""), (2, None), (3, "x")], "batch_idx int, smiles string")
    got = {r.batch_idx: (r.smiles, r.valid, r.valid_score, r.mol_id) for r in batch.parse(df, parsed=F.col("smiles") != "x").collect()}
    assert got == {0: ("a b", True, 1, "a b"), 1: ("", False, 0, ""), 2: (None, False, 0, None), 3: ("x", False, 0, "x")}
    raw = batch.parse(df, canonicalise=None).collect()
    assert [r.valid for r in raw] == [True, False, False, True] and raw[0].smiles == " A  B "


def test_occurrences_with_nulls_and_history(spark):
    rows = [(i, m) for i, m in enumerate(["a", None, "a", "b", None, "a", "c", "b"])]
    df = spark.createDataFrame(rows, "idx long, mol_id string")
    seen, want = {}, []
    for i, m in rows:
        want.append((i, m, seen.get(m, 0) == 0, seen.get(m, 0)))
        seen[m] = seen.get(m, 0) + 1
    pick = lambda d: [tuple(r) for r in d.select("idx", "mol_id", "unique", "occurrences").orderBy("idx").collect()]
    assert pick(batch.first_occurrence(df)) == want
    assert pick(batch.first_occurrence_after(df.where("idx >= 3"), df.where("idx < 3"))) == want[3:]
    assert pick(batch.first_occurrence(df.limit(0))) == []


def test_eligible_rows(spark):
    rows = [(0, 1, True, True), (1, 1, True, False), (2, 1, False, True), (3, 2, False, True), (4, 2, False, False)]
    df = spark.createDataFrame(rows, "idx long, step int, valid boolean, unique boolean")
    ids = lambda **k: sorted(r.idx for r in batch.score_eligible(df, **k).collect())
    assert ids() == [0, 3] and ids(score_invalids=True) == [0, 2, 3] and ids(recalculate=True) == [0, 1, 3]
    assert ids(score_invalids=True, recalculate=True) == [0, 1, 2, 3, 4]


def test_results_are_attached(spark):
    b = spark.createDataFrame([(0, "a", 9.0), (1, "b", 9.0), (2, "a", 9.0), (3, None, 9.0)], "idx long, mol_id string, p double")
    res = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0)], "mol_id string, p double")
    got = {r.idx: r.p for r in batch.attach_results(b, res).collect()}
    assert got[1] == 0.0 and got[0] == got[2] and got[0] in (1.0, 2.0) and got[3] == 5.0
    merged = batch.merge_results([res, spark.createDataFrame([("z", 1)], "mol_id string, q int")])
    assert merged.count() == 3


# --- run log -----------------------------------------------------------------


def brute_auc(scores, budget, n, window=100, extrapolate=False):
    total, prev, called = 0.0, 0.0, 0
    top = lambda s: sum(sorted(s, reverse=True)[:n]) / min(n, len(s))
    for at in range(window, min(len(scores), budget), window):
        now = top(scores[:at])
        total, prev, called = total + window * (now + prev) / 2, now, at
    now = top(scores)
    total += (len(scores) - called) * (now + prev) / 2
    if extrapolate and len(scores) < budget:
        total += (budget - len(scores)) * now
    return total / budget


@pytest.mark.parametrize("n, budget, extrapolate", [(50, 1000, False), (50, 1000, True), (100, 100, True), (437, 437, False), (437, 200, False), (437, 1000, True), (400, 300, False), (1, 10, True)])
def test_top_n_auc(spark, n, budget, extrapolate):
    rng = random.Random(n)
    scores = [rng.random() for _ in range(n)]
    df = spark.createDataFrame([(i + 1, i, s) for i, s in enumerate(scores)], "pos long, idx long, s double")
    got = {r.n: r.value for r in runlog.top_n_auc(df, "s", budget, extrapolate=extrapolate).collect()}
    for k in (1, 10, 100):
        assert got[k] == pytest.approx(brute_auc(scores, budget, k, extrapolate=extrapolate)), k


@pytest.mark.parametrize("scaffold", [None, "sc"])
@pytest.mark.parametrize("n, budget", [(60, 500), (437, 300), (437, 437), (350, 1000)])
def test_yield_auc(spark, n, budget, scaffold):
    rng = random.Random(n)
    rows = [(i + 1, rng.random(), rng.choice([None, *range(40)])) for i in range(n)]
    total, prev, called = 0.0, 0.0, 0

    def rate(part):
        hits = [sc for _, s, sc in part if s >= 0.6]
        return (len({h for h in hits if h is not None}) if scaffold else len(hits)) / len(part)

    for at in range(100, min(n, budget), 100):
        now = rate(rows[:at])
        total, prev, called = total + 100 * (now + prev) / 2, now, at
    now = rate(rows)
    total += (n - called) * (now + prev) / 2 + (max(0, budget - n) * now)
    df = spark.createDataFrame(rows, "pos long, s double, sc int")
    assert runlog.yield_auc(df, "s", 0.6, budget, scaffold=scaffold).first().value == pytest.approx(total / budget)


def test_termination_rules(spark):
    rows, idx = [], 0
    for step, (scores, new, valid) in enumerate([([0.1, 0.2], 2, 2), ([0.9, 0.9], 0, 2), ([0.2, 0.2], 0, 2), ([0.8, 0.8], 1, 0), ([0.9, 0.8], 1, 2)], 1):
        for k, s in enumerate(scores):
            rows.append((idx, step, s, k < new, k < valid))
            idx += 1
    df = spark.createDataFrame(rows, "idx long, step int, s double, unique boolean, valid boolean")
    flags = lambda **k: [r.finished for r in runlog.termination(df, "s", **k).orderBy("step").collect()]
    assert flags(budget=5) == [False, False, True, True, True]
    assert flags(budget=3, oracle_budget=True) == [False, False, False, True, True]
    assert flags(threshold=0.85) == [False, True, True, True, True]
    assert flags(threshold=0.75, patience=2) == [False, False, False, True, True]
    assert flags(budget=100, oracle_budget=True, patience=3) == [False, False, False, True, True]
    assert flags() == [False] * 5


def test_replay_and_picks(spark):
    rows = [(0, "a", 0.5, True, "x"), (1, "b", 0.9, False, "x"), (2, "a", 0.8, True, "y"), (3, "c", 0.7, True, "y"), (4, "d", 0.7, True, "z")]
    df = spark.createDataFrame(rows, "idx long, mol_id string, s double, passes_diversity_filter boolean, sc string")
    ids = lambda d: [r.idx for r in d.collect()]
    assert ids(runlog.replay_top(None, df, "s", 3)) == [1, 3, 4]
    assert ids(runlog.replay_top(None, df, "s", 3, purge=True)) == [3, 4, 0]
    assert ids(runlog.replay_top(df.where("idx = 0"), df.where("idx > 1"), "s", 9)) == [3, 4, 0]
    assert sorted(ids(runlog.pick(df, "s", 2, scaffold="sc"))) == [1, 2]
    assert sorted(ids(runlog.pick(df, "s", 3, "range"))) == [0, 1, 3] and len(ids(runlog.pick(df, "s", 2, "random"))) == 2
    assert len(ids(runlog.replay_sample(df, 3))) == 3
    near = df.withColumn("words", F.array(F.col("idx")))
    assert len(ids(runlog.pick(near, "s", 3, "diverse"))) == 3
    assert ids(runlog.pick(near, "s", 1, "similar", like=F.array(F.lit(3).cast("long")))) == [3]
    with pytest.raises(ValueError):
        runlog.pick(df, "s", 1, "odd")


# --- sets --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_wasserstein(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.normal(size=150), seed + 1), np.round(rng.normal(1, 2, size=90), seed + 1)
    q = np.unique(np.concatenate([np.arange(1, 151) / 150, np.arange(1, 91) / 90]))
    step = np.diff(np.concatenate([[0], q]))
    inverse = lambda x, p: np.sort(x)[np.minimum(np.ceil(p * len(x) - 1e-9).astype(int) - 1, len(x) - 1)]
    want = float((np.abs(inverse(a, q) - inverse(b, q)) * step).sum())
    df = lambda x: spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    assert sets.wasserstein(df(a), df(b), "v").first().value == pytest.approx(want)
    assert sets.wasserstein(df([1.0]), df([1.0, 1.0]), "v").first().value in (None, 0.0)


def test_frechet_equals_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(80, 5)), rng.normal(0.5, 1.5, size=(60, 5))
    s1, s2 = np.cov(a.T), np.cov(b.T)
    root = np.real(np.sqrt(np.linalg.eigvals(s1 @ s2).astype(complex))).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * root
    df = lambda x: spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    assert sets.frechet(df(a), df(b), "v") == pytest.approx(want)
    assert sets.frechet(df(a), df(a), "v") == pytest.approx(0, abs=1e-8)


def test_bloom_has_no_false_negatives(spark):
    ref = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    gen = spark.range(3000).select("id", F.col("id").alias("k")).unionByName(spark.createDataFrame([(-1, None)], "id long, k long"))
    got = {r.id: r.inside for r in sets.bloom_member(gen, sets.bloom_build(ref, "k", 0.02), "k", "id").collect()}
    assert all(got[k] == 1 for k in range(0, 3000, 3)) and got[-1] == 0
    assert sum(got[k] for k in range(3000) if k % 3) / 2000 < 0.05
    assert sets.bloom_size(1000, 0.01) == (9586, 7)


def test_corrected_and_cosine(spark):
    one = spark.createDataFrame([("m", 1.0, 10)], "metric string, value double, n long")
    two = spark.createDataFrame([("m", 4.0, 20), ("k", 2.0, 5)], "metric string, value double, n long")
    got = {r.metric: (r.value, r.n) for r in sets.corrected(sets.corrected(None, one), two).collect()}
    assert got == {"m": (3.0, 30), "k": (2.0, 5)}
    bag = lambda x: spark.createDataFrame(x, "key string, n long")
    assert sets.cosine_of_counts(bag([("a", 3), ("b", 4)]), bag([("a", 3), ("c", 4)])).first().value == pytest.approx(9 / 25)
    assert sets.cosine_of_counts(bag([("a", 3)]), bag([])).first().value is None


# --- pairs and diversity -----------------------------------------------------


def vectors(n, seed, bits=64, ones=14):
    rng = np.random.default_rng(seed)
    centres = [rng.choice(bits, ones, replace=False) for _ in range(max(3, n // 12))]
    out = []
    for _ in range(n):
        on = set(centres[rng.integers(len(centres))].tolist())
        for b in rng.integers(0, bits, 5):
            on ^= {int(b)}
        out.append(frozenset(on))
    return out


def words(on):
    x = sum(1 << b for b in on)
    return [x - (1 << 64) if x >> 63 else x]


def sim(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def frame(spark, vs, scores=None, id="idx"):
    scores = scores or [0.0] * len(vs)
    return spark.createDataFrame([(i, words(v), s) for i, (v, s) in enumerate(zip(vs, scores))], f"{id} long, words array<long>, score double")


@pytest.mark.parametrize("tile", [7, 4096])
def test_pairwise_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    a, b = [*vectors(30, 1), frozenset()], [*vectors(25, 2), frozenset()]
    got = {r.id: r for r in tiles.pairwise(frame(spark, a, id="id"), frame(spark, b, id="id"), 0.3, 2.0).collect()}
    for i, x in enumerate(a):
        s = [sim(x, y) for y in b]
        assert got[i].n == len(b) and got[i].total == pytest.approx(sum(v * v for v in s)) and got[i].best == pytest.approx(max(s))
        assert got[i].best_id == s.index(max(s)) and got[i].hits == sum(v > 0.3 for v in s)


@pytest.mark.parametrize("seed, one_task", [(0, 0), (1, 0), (2, 10**6), (3, 10**6)])
def test_leaders_and_clusters(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(diversity, "ONE_TASK", one_task)
    vs = vectors(80, seed)
    kept = []
    for i, v in enumerate(vs):
        if all(1 - sim(v, vs[k]) > 0.6 for k in kept):
            kept.append(i)
    df = frame(spark, vs)
    assert sorted(r.id for r in diversity.sphere_exclusion(df, 0.6).collect()) == kept
    assert diversity.sphere_exclusion_diversity(df, 0.6) == pytest.approx(len(kept) / 80)
    got = {r.id: r.leader for r in diversity.sphere_exclusion_clusters(df, 0.6).collect()}
    for i, v in enumerate(vs):
        best = max(kept, key=lambda k: (sim(v, vs[k]), -k))
        assert got[i] == (i if i in kept else best)


@pytest.mark.parametrize("one_task, rounds", [(0, 3), (300, 0), (10**6, 50)])
def test_leaders_of_a_long_chain(spark, monkeypatch, one_task, rounds):
    monkeypatch.setattr(diversity, "ONE_TASK", one_task)
    n = 40 if one_task == 0 else 1000
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    got = diversity.leaders(spark.range(n + 1).withColumnRenamed("id", "idx"), pairs, parallel_rounds=rounds)
    assert sorted(r.id for r in got.collect()) == list(range(0, n + 1, 2))


def test_rank_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(5) + 0.5) for k in range(500)]
    df = spark.createDataFrame(rows, "idx long, v double").repartition(7)
    got = {r.idx: r.rank for r in order.rank(df, [F.desc("v"), F.col("idx").asc()]).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_eigen_is_the_decomposition(n):
    a = np.random.default_rng(n).normal(size=(n, max(1, n - 2)))
    a = a @ a.T
    values, vectors = sets.eigen(a)
    assert np.sort(values) == pytest.approx(np.linalg.eigvalsh(a), abs=1e-9)
    assert vectors @ np.diag(values) @ vectors.T == pytest.approx(a, abs=1e-9)


@pytest.mark.parametrize("mode", ["binary", "linear", "sigmoid"])
def test_scaffold_filter_is_the_walk(spark, mode):
    rng = random.Random(mode)
    rows = [(i, rng.randrange(6), f"c{rng.randrange(25)}", round(rng.random(), 3)) for i in range(300)]
    memory, want = {}, []

    def left(n):
        f = n / 3
        return 0.0 if n > 3 else {"binary": 1.0, "linear": 1 - f, "sigmoid": 1 - 1 / (1 + math.exp(-(2 * f - 1) / 0.15))}[mode]

    for i, b, c, s in rows:
        own = memory.setdefault(b, {})
        if c in own:
            want.append(0.0)
        elif s >= 0.4:
            own[c] = s
            want.append(s * left(len(own)))
        else:
            want.append(s)
    df = spark.createDataFrame(rows, "idx long, b int, c string, s double")
    got = diversity.scaffold_filter(df, "s", "b", "c", 3, 0.4, mode).orderBy("idx").collect()
    assert [r.filtered for r in got] == pytest.approx(want)
    first = diversity.scaffold_filter(df.where("idx < 120"), "s", "b", "c", 3, 0.4, mode)
    memory = first.where("recorded").select("b", "c", F.col("idx").alias("ord"))
    rest = diversity.scaffold_filter(df.where("idx >= 120"), "s", "b", "c", 3, 0.4, mode, memory).orderBy("idx").collect()
    assert [r.filtered for r in rest] == pytest.approx(want[120:])


@pytest.mark.parametrize("seed", range(2))
def test_similarity_filter_is_the_walk(spark, seed):
    rng = random.Random(seed)
    vs = vectors(90, seed)
    vs = [vs[rng.randrange(60)] if k > 60 else v for k, v in enumerate(vs)]
    scores = [round(rng.random(), 3) for _ in vs]
    founders, members, want = {}, {}, []
    for v, s in zip(vs, scores):
        name = str(sorted(v))
        if s < 0.3:
            want.append(s)
            continue
        if name in founders:
            cluster = name
        else:
            best = max(founders, key=lambda f: sim(v, founders[f]), default=None)
            cluster = best if best is not None and sim(v, founders[best]) >= 0.45 else name
        if name in members.get(cluster, set()):
            want.append(0.0)
            continue
        founders.setdefault(cluster, v)
        members.setdefault(cluster, set()).add(name)
        n = len(members[cluster])
        want.append(s * (0.0 if n > 3 else 1 - n / 3))
    df = spark.createDataFrame([(i, str(sorted(v)), words(v), s) for i, (v, s) in enumerate(zip(vs, scores))], "idx long, smiles string, words array<long>, score double")
    got = diversity.similarity_filter(df, "score", "smiles", "words", 3, 0.3, 0.45, "linear").orderBy("idx").collect()
    assert [r.filtered for r in got] == pytest.approx(want)


@pytest.mark.parametrize("reordering", [False, True])
def test_butina(spark, reordering):
    vs = vectors(40, 4)
    near = {i: {j for j in range(40) if i != j and sim(vs[i], vs[j]) >= 0.4} for i in range(40)}
    left, want = set(range(40)), {}
    degree = {i: len(n) for i, n in near.items()}
    while left:
        if reordering:
            degree = {i: len(near[i] & left) for i in left}
        top = max(left, key=lambda i: (degree[i], i))
        for m in ({top} | near[top]) & left:
            want[m] = top
        left -= {top} | near[top]
    df = frame(spark, vs)
    got = {r.id: r.leader for r in diversity.butina(df, diversity.near_pairs(df, 0.4), reordering=reordering).collect()}
    assert got == want


def _no_pairs(*_):
    raise AssertionError("pairs are listed")


@pytest.mark.parametrize("walk, tile, slice_", [(16, 7, 60), (16_384, 4096, 2_000_000)])
def test_clusters_without_pairs(spark, monkeypatch, walk, tile, slice_):
    monkeypatch.setattr(diversity, "near_pairs", _no_pairs)
    monkeypatch.setattr(diversity, "WALK", walk)
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "SLICE", slice_)
    vs = vectors(70, 5)
    vs += [vs[3]] * 40 + [vs[60]] * 2 + [frozenset()] * 3  # copies
    n, df = len(vs), frame(spark, vs)
    kept = []
    for i, v in enumerate(vs):
        if all(sim(v, vs[k]) < 0.4 for k in kept):
            kept.append(i)
    assert sorted(r.id for r in diversity.sphere_exclusion(df, 0.6).collect()) == kept
    got = {r.id: r.leader for r in diversity.sphere_exclusion_clusters(df, 0.6).collect()}
    want = {i: i if i in kept else max(kept, key=lambda k: (sim(v, vs[k]), -k)) for i, v in enumerate(vs)}
    assert got == want
    sizes = sorted(((list(want.values()).count(k), -k) for k in kept), reverse=True)[:4]
    assert [(r.size, -r.leader) for r in diversity.pick_clusters(diversity.sphere_exclusion_clusters(df, 0.6), 4).collect()] == sizes
    near = {i: {j for j in range(n) if i != j and sim(vs[i], vs[j]) >= 0.4} for i in range(n)}
    left, want = set(range(n)), {}
    while left:
        top = max(left, key=lambda i: (len(near[i]), i))
        for m in ({top} | near[top]) & left:
            want[m] = top
        left -= {top} | near[top]
    assert {r.id: r.leader for r in diversity.butina_within(df, 0.4).collect()} == want


def test_picker_lists_no_pairs(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(diversity, "near_pairs", _no_pairs)
    got = entry.queries()["se_picker"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 10 and [r.size for r in got] == sorted((r.size for r in got), reverse=True)


def _no_tiles(*_, **__):
    raise AssertionError("vectors are copied for each tile")


def test_picker_sizes_without_tiles(spark, monkeypatch):
    """Many leaders, in several slices and tiles: copies for each pair of tiles grow with rows times leaders."""
    for module in (tiles, diversity):
        monkeypatch.setattr(module, "pairwise", _no_tiles, raising=False)
    monkeypatch.setattr(tiles, "TILE", 7)
    monkeypatch.setattr(tiles, "SLICE", 60)
    monkeypatch.setattr(diversity, "WALK", 32)
    vs = vectors(150, 8, ones=3)
    vs += [vs[0]] * 5 + [vs[40]] * 5 + [frozenset()] * 4
    kept = []
    for i, v in enumerate(vs):
        if all(sim(v, vs[k]) < 0.4 for k in kept):
            kept.append(i)
    led = [max(kept, key=lambda k: (sim(v, vs[k]), -k)) for v in vs]
    want = sorted((-led.count(k), k) for k in kept)
    assert len(kept) > 40
    df = frame(spark, vs)
    assert sorted((-r.size, r.leader) for r in diversity.sphere_exclusion_sizes(df, 0.6).collect()) == want
    assert {r.id: r.leader for r in diversity.sphere_exclusion_clusters(df, 0.6).collect()} == dict(enumerate(led))
    for how, picks in (("largest", want[:5]), ("smallest", sorted((-n, k) for n, k in want)[:5])):
        got = [(r.size, r.leader) for r in diversity.pick_sizes(diversity.sphere_exclusion_sizes(df, 0.6), 5, how).collect()]
        assert got == [(abs(n), k) for n, k in picks]


def test_picker_query_without_tiles(spark, monkeypatch):
    import __spark_entry__ as entry

    for module in (tiles, diversity):
        monkeypatch.setattr(module, "pairwise", _no_tiles, raising=False)
    assert sum(r.size for r in entry.queries()["se_picker"](spark, "/root/testdata/sf0.01").collect()) > 0


def test_pairwise_keeps_all_rows_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 7)
    df = frame(spark, vectors(60, 6), id="id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which makes one partition of a small table
    try:
        assert tiles.pairwise(df, df).where("n = 60").count() == 60
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_similar_enough_by_counts():
    rng = np.random.default_rng(3)
    for columns in (1, 5):
        a, b = (rng.integers(0, 2**64, (k, columns), dtype=np.uint64) & rng.integers(0, 2**64, (k, columns), dtype=np.uint64) for k in (150, 5000))
        a[0] = b[0] = 0
        for at_least in (0.0, 0.2, 0.42, 0.5, 1.0):
            got = np.zeros((150, 5000), bool)
            for i, j, close in tiles.near(a, b, at_least):
                got[i, j : j + close.shape[1]] = close
            assert (got == (tiles.tanimoto(a, b) >= at_least)).all()


def test_levenshtein_pairs(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    s = ["".join(rng.choices("abc", k=rng.randrange(0, 12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(s)), "idx long, s string")
    got = {(r.a, r.b) for r in diversity.levenshtein_pairs(df, "s", 3).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if edits(s[i], s[j]) <= 3}


def test_diverse_buffer_is_the_walk(spark):
    rng = random.Random(2)
    vs = vectors(200, 6)
    scores = [round(rng.random(), 3) for _ in vs]
    ids, kept, prints = [], [], []
    for i, (v, s) in enumerate(zip(vs, scores)):
        if len(ids) < 12:
            ids.append(i), kept.append(s), prints.append(v)
        elif s >= min(kept):
            near = [sim(v, p) for p in prints]
            k = near.index(max(near))
            if near[k] > 0.35:
                kept[k] = max(kept[k], s)
            else:
                k = kept.index(min(kept))
                ids[k], kept[k], prints[k] = i, s, v
    got = diversity.diverse_buffer(frame(spark, vs, scores), "score", 12, 0.35).collect()
    assert sorted((r.centroid, r.score) for r in got) == sorted(zip(ids, kept))
    by = frame(spark, vs, scores).withColumn("run", F.col("idx") % 2)
    assert diversity.diverse_buffer(by, "score", 12, 0.35, keys=["run"]).count() == 24


@pytest.mark.parametrize("n, budget, extrapolate", [(230, 1000, True), (230, 150, False), (200, 200, False), (40, 100, True)])
def test_diverse_top(spark, n, budget, extrapolate):
    rng = random.Random(n)
    vs, scores = vectors(n, 3), [round(rng.random(), 3) for _ in range(n)]

    def top(rows, k):
        kept, prints = [], []
        for v, s in rows:
            if len(kept) < 12:
                kept.append(s), prints.append(v)
            elif s >= min(kept):
                near = [sim(v, p) for p in prints]
                i = near.index(max(near))
                if near[i] > 0.35:
                    kept[i] = max(kept[i], s)
                else:
                    i = kept.index(min(kept))
                    kept[i], prints[i] = s, v
        best = sorted(kept, reverse=True)[:k]
        return sum(best) / len(best)

    rows = list(zip(vs, scores))
    df = frame(spark, vs, scores).withColumn("pos", F.col("idx") + 1)
    got = {r.n: r for r in diversity.diverse_top(df, "score", budget, (1, 12), 50, extrapolate).collect()}
    for k in (1, 12):
        total, prev, called = 0.0, 0.0, 0
        for at in range(50, min(n, budget), 50):
            now = top(rows[:at], k)
            total, prev, called = total + 50 * (now + prev) / 2, now, at
        now = top(rows[:budget], k)
        total += (n - called) * (now + prev) / 2 + (max(0, budget - n) * now if extrapolate else 0)
        assert got[k].auc == pytest.approx(total / budget) and got[k].avg == pytest.approx(top(rows, k))


def test_scaffold_founders(spark):
    rows = [(0, "a", "s1", 1, 0.9), (1, "b", "s1", 1, 0.9), (2, "a", "s2", 3, 0.9), (3, "c", "s3", 1 << 40, 0.9), (4, "a", "s1", 1, 0.9), (5, "d", "s1", 1, 0.1)]
    df = spark.createDataFrame([(i, c, s, [w], x) for i, c, s, w, x in rows], "idx long, smiles string, scaffold string, words array<long>, score double")
    got = diversity.similarity_filter(df, "score", "smiles", "words", 2, 0.5, 0.5, founder="scaffold").orderBy("idx").collect()
    # s2 joins s1, so its a is a repeat; s3 is a cluster of its own; the last row takes no part
    assert [r.cluster for r in got] == [0, 0, 0, 3, 0, None]
    assert [r.filtered for r in got] == [0.9, 0.9, 0.0, 0.9, 0.0, 0.1]


def test_maxmin_and_solow_polasky(spark):
    vs = vectors(60, 8)
    df = frame(spark, vs)
    got = diversity.maxmin(df, 6)
    far = [min(1 - sim(v, vs[got[0]]) for _ in [0]) for v in vs]
    for p in got[1:]:
        rest = [(far[i], -i) for i in range(60) if i not in got[: got.index(p)]]
        assert (far[p], -p) == max(rest)
        far = [min(f, 1 - sim(v, vs[p])) for f, v in zip(far, vs)]
    d = np.array([[1 - sim(a, b) for b in vs] for a in vs])
    _, first = np.unique(d, axis=0, return_index=True)
    d = d[np.sort(first)][:, np.sort(first)]
    assert diversity.solow_polasky(df, normalize=False) == pytest.approx(np.linalg.inv(np.exp(-10 * d)).sum())
    assert diversity.solow_polasky(df.limit(0)) == 0.0


def test_seeded_sample_is_numpy_s(spark):
    df = spark.range(500).select((F.col("id") * 3).alias("idx"))
    got = sorted(r.idx for r in diversity.seeded_sample(df, 20).collect())
    np.random.seed(123)
    assert got == sorted(int(i) * 3 for i in np.random.choice(list(range(500)), 20, replace=False))


# --- Pareto ------------------------------------------------------------------


def test_fronts(spark):
    rng = random.Random(0)
    rows = [(i, i % 2, rng.randrange(8), rng.randrange(8), rng.randrange(4)) for i in range(160)]
    better = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    want = {}
    for g in (0, 1):
        left, k = {i: r[2:] for i, *r in [(x[0], x[0], *x[1:]) for x in rows] if r[1] == g}, 1
        left = {r[0]: r[2:] for r in rows if r[1] == g}
        while left:
            front = [i for i in left if not any(better(left[j], left[i]) for j in left)]
            want |= dict.fromkeys(front, k)
            left, k = {i: v for i, v in left.items() if i not in front}, k + 1
    df = spark.createDataFrame(rows, "idx long, g int, a int, b int, c int")
    assert {r.idx: r.front for r in pareto.fronts(df, ["a", "b", "c"], ["g"]).collect()} == want


def test_reward(spark):
    rng = random.Random(1)
    rows = [(i, i // 40, round(rng.random(), 1), round(rng.random(), 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "idx long, step int, a double, b double")
    got = {r.idx: r.pareto_front for r in pareto.reward(df, ["a", "b"]).collect()}
    for step in (0, 1):
        x = {i: (a, b) for i, s, a, b in rows if s == step}
        left, ranked = dict(x), []
        better = lambda a, b: all(p >= q for p, q in zip(a, b)) and a != b
        while left:
            front = sorted(i for i in left if not any(better(left[i], left[j]) for j in left))
            ranked += front
            left = {i: v for i, v in left.items() if i not in front}
        good = [i for i in x if min(x[i]) >= 0.5]
        bad = len(x) - len(good)
        for i in x:
            k = ranked.index(min(j for j in x if x[j] == x[i]))
            assert got[i] == pytest.approx(0.5 + (k - bad) / len(good) if i in good else k / (2 * bad))
    assert pareto.crowding(np.array([[1], [3], [7]], dtype=np.uint64)).max() >= 1e4
