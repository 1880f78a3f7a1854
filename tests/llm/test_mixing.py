from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assayer.llm import mixing as M


def simulate(weights, length):
    """Plain earliest-deadline-first over Pfair windows, a slot at a time."""
    total, given, out = sum(weights.values()), Counter(), []
    for t in range(length):
        ready = []
        for s, w in weights.items():
            j = given[s]
            if j * total // w <= t:
                ready.append((-(-(j + 1) * total // w), s))
        deadline, s = min(ready)
        assert t < deadline
        given[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 5, "c": 3, "d": 2}, {f"s{k}": 1 + k * k % 11 for k in range(20)}])
def test_cycle_is_the_schedule_and_keeps_within_a_block(weights):
    slots = M.cycle(weights)
    length = sum(map(len, slots.values()))
    flat = {t: s for s, ts in slots.items() for t in ts}
    assert [flat[t] for t in range(length)] == simulate(weights, length)
    total, had = sum(weights.values()), Counter()
    for t in range(length):
        had[flat[t]] += 1
        assert all(abs(had[s] - Fraction(w * (t + 1), total)) < 1 for s, w in weights.items())


def check(rows, weights, default, block):
    """Rows are all placed, blocks are windows' apart from no slot, and each phase keeps its weights."""
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, []).append(r)
    assert sorted(by_slot) == list(range(len(by_slot)))
    phase, had = -1, Counter()
    last = {s: max(r.slot for r in rows if r.source == s) for s in {r.source for r in rows}}
    for slot in sorted(by_slot):
        own = by_slot[slot]
        assert len({(r.source, r.block, r.phase) for r in own}) == 1
        assert sorted(r.place for r in own) == list(range(len(own))) and len(own) <= block
        r = own[0]
        if r.phase != phase:
            phase, had, start = r.phase, Counter(), slot
            live = {s: weights.get(s, default) for s, t in last.items() if t >= slot}
        had[r.source] += 1
        assert r.release <= slot - start < r.deadline
        total = sum(live.values())
        assert all(abs(had[s] - Fraction(w * (slot - start + 1), total)) < 1 for s, w in live.items())
    return by_slot


def test_mix_places_every_row(spark, docs):
    rows = [(k, "t", "en", "hot" if k % 3 == 0 else None if k % 31 == 0 else f"s{k % 7}") for k in range(2000)]
    got = M.mix_order(docs(rows), {"hot": 5, "s1": 3}, 2, 8).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    check(got, {"hot": 5, "s1": 3}, 2, 8)
    assert len({r.position for r in got}) == 2000


def test_odd_tables(spark, docs):
    assert M.mix_order(docs([])).count() == 0
    same = M.mix_order(docs([(1, "x", "en", "a")] * 5 + [(None, None, None, None)] * 3), {"a": 1}, 1, 2).collect()
    assert len(same) == 8 and len({r.position for r in same}) == 8
    df = docs([(1, "x", "en", "a"), (2, "y", "en", "b")]).selectExpr("*", "1 as key", "2 as h", "3 as bucket", "4 as row", "5 as slot", "6 as block")
    assert M.mix(df).select("row.*").columns == df.columns


def test_limits_are_checked(spark, docs):
    with pytest.raises(ValueError):
        M.mix_order(docs([(1, "x", "en", "a")]), {"a": 0})
    with pytest.raises(ValueError):
        M.mix_order(docs([(1, "x", "en", "a")]), {"a": M.MAX_CYCLE + 1})


def test_thousands_of_sources(spark, docs):
    weights = {"s1999": 50, "s5": 3}
    rows = [(k, "t", "en", f"s{k % 2000}" if k % 3 else "hot") for k in range(6000)]
    got = M.mix_order(docs(rows), weights, 2, 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000)) and len({r.position for r in got}) == 6000
    largest = sorted(Counter(r.source for r in got).items(), key=lambda x: (x[0] not in weights, -x[1], f"s:{x[0]}"))
    alone = {s for s, _ in largest[: M.MAX_SOURCES - 1]}
    assert {"hot", *weights} <= alone
    joint = [Row(**r.asDict() | {"source": r.source if r.source in alone else M.REST}) for r in got]
    named = {s: weights.get(s, 2) for s in alone}
    check(joint, named | {M.REST: (2001 - len(alone)) * 2}, 2, 4)


def test_weights_of_many_kinds(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "LITERAL", 50)
    rows = [(k, "t", "en", f"s{k % 40}") for k in range(1500)]
    weights = {f"s{k}": 1 + k * k % 37 for k in range(40)}
    check(M.mix_order(docs(rows), weights, 2, 8).collect(), weights, 2, 8)


def test_null_ids_are_spread_over_buckets(spark, docs):
    df = docs([(None, f"text {k}" * (k % 50), "en", "a") for k in range(500)])
    m = M.mix(df, {"a": 1}, 1, 8).select("position", "row.text").collect()
    assert len({r.position for r in m}) == 500
    assert df.select(M.bucket_of(M.hash_of(F.col("doc_id"), [F.col("n_chars")]), 6).alias("b")).distinct().count() > 20


def test_plan_is_native(spark, docs):
    plan = M.mix_order(docs([(1, "x", "en", "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equals_sql(spark, docs):
    import duckdb
    import pandas as pd

    rows = [(k, "t", "en", "hot" if k % 3 == 0 else None if k % 31 == 0 else f"s{k % 7}") for k in range(700)]
    weights = {"hot": 5, "s1": 3}
    got = sorted(tuple(r) for r in M.mix_order(docs(rows), weights, 2, 8).collect())
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": [r[0] for r in rows], "source": [r[3] for r in rows]}))
    assert got == sorted(c.sql(M.oracle_sql(weights, 2, 8)).fetchall())
