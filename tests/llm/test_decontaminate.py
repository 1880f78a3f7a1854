import random
from collections import defaultdict

import pytest

from assayer.llm import decontaminate as D

BENCH = "item_id long, text string"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


def sentences(rng, n):
    w = words(rng, n)
    cut = rng.randrange(5, n - 5)
    return " ".join(w[:cut]).capitalize() + ". " + " ".join(w[cut:]).capitalize() + "."


def brute(texts, items, overlap=0.8):
    """Every document against every item: the item's parts have to lie in one window of the index's width."""
    out = set()
    indexes = D.build(items, overlap)
    for d, text in texts:
        w = D.words_of((text or "").lower())
        for index in indexes:
            for k, (item, q, a) in enumerate(index.items):
                for at in range(0, max(1, len(w) - index.width), index.width):
                    window = w[at : at + 2 * index.width]
                    share = []
                    for part in (D.shingles(q), D.shingles(a)):
                        if part:
                            n = len(next(iter(part)))
                            share.append(len(part & {tuple(window[i : i + n]) for i in range(len(window) - n + 1)}) / len(part))
                    if min(share) >= overlap:
                        out.add((d, item))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_returns_all_above_the_bound(seed):
    rng = random.Random(seed)
    index = D.build([(k, sentences(rng, rng.randrange(15, 60))) for k in range(150)], 0.8)[0]
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.vocab)), min(len(index.vocab), rng.choice([3, 30, 150]))))
        least = rng.choice([0.05, 0.3, 0.7, 1.0])
        scores = defaultdict(float)
        for t in terms:
            for i, x in zip(index.docs[t], index.impacts[t]):
                scores[i] += x
        got = index.search(terms, least)
        assert {i for i, _ in got} == {i for i, s in scores.items() if s >= least}
        assert all(s == pytest.approx(scores[i]) for i, s in got)


@pytest.mark.parametrize("seed", range(2))
def test_leaks_equal_brute_force(spark, docs, odd, seed):
    rng = random.Random(seed)
    items = [(k, sentences(rng, rng.randrange(12, 60))) for k in range(60)] + [(100, " ".join(words(rng, 180)) + ". End here."), (101, None), (102, ""), (103, "Tiny one."), (104, "!!!")]
    texts = list(odd)
    for k in range(120):
        body = words(rng, rng.randrange(5, 400))
        if k % 3 == 0:
            leak = D.words_of(items[k % 61][1].lower())
            for _ in range(k % 9 // 3 * 2):  # some words are changed
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(body) + 1)
            body = body[:at] + leak + body[at:]
        texts.append(" ".join(body))
    rows = list(enumerate(texts))
    got = D.find_leaks(docs(texts), spark.createDataFrame(items, BENCH)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) > 10
    assert all(r.score >= 1 - 1e-9 and min(r.question_overlap, r.answer_overlap) >= 0.8 for r in got)


def test_clean_documents_stay(spark, docs, odd):
    item = "Who wrote the old book about the long river and its many boats? It was the young captain of the last boat."
    texts = [*odd, "Some start. " + item + " Some end.", item.upper(), "who wrote the old book about something else entirely in another town far away"]
    df = docs(texts).selectExpr("*", "1 as key", "2 as id", "3 as row")
    kept = D.leaky_removed(df, spark.createDataFrame([(1, item)], BENCH))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {len(odd), len(odd) + 1}
    assert D.leaky_removed(df, spark.createDataFrame([], BENCH)).count() == len(texts)
    assert D.leaky_removed(docs([]), spark.createDataFrame([(1, item)], BENCH)).count() == 0


def test_shards_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(9)
    items = [(k, sentences(rng, 30)) for k in range(20)]
    texts = ["x " * 10 + t + " y" for _, t in items] + ["nothing to see"]
    bench = spark.createDataFrame(items, BENCH)
    whole = {(r.doc_id, r.item_id) for r in D.find_leaks(docs(texts), bench).collect()}
    monkeypatch.setattr(D, "SHARD_CHARS", 1000)
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs(texts), bench).collect()} == whole >= {(k, k) for k in range(20)}


def test_equals_sql(spark, docs, odd):
    import duckdb
    import pandas as pd

    rng = random.Random(4)
    items = [(k, sentences(rng, rng.randrange(12, 60))) for k in range(25)] + [(50, " ".join(words(rng, 120)) + ".\nIt ends."), (51, None), (52, ""), (53, "Tiny one."), (54, "Two words here")]
    texts = [t for t in odd if t is None or len(t) < 10_000]
    for k in range(60):
        leak = D.words_of((items[k % 30][1] or "").lower())
        for _ in range(k % 4 * 2):
            if leak:
                leak[rng.randrange(len(leak))] = "changed"
        body = words(rng, rng.randrange(0, 300))
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + leak + body[at:]))
    got = sorted((r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in D.find_leaks(docs(texts), spark.createDataFrame(items, BENCH)).collect())
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    c.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted(c.sql(D.oracle_sql()).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 15
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:], abs=2e-6)


def test_scores_do_not_depend_on_the_shards(spark, docs, monkeypatch):
    rng = random.Random(10)
    items = [(k, sentences(rng, rng.randrange(15, 90))) for k in range(60)]
    texts = ["x " * (k % 7) + t + " y" for k, (_, t) in enumerate(items)] * 2
    bench = spark.createDataFrame(items, BENCH)
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in D.find_leaks(docs(texts), bench).collect())
    whole = found()
    monkeypatch.setattr(D, "SHARD_CHARS", 3000)
    assert found() == whole and len(whole) >= 120


def test_the_index_is_packed():
    import pickle

    rng = random.Random(11)
    items = [(k, sentences(rng, 60)) for k in range(3000)]
    assert len(pickle.dumps(D.build(items, 0.8))) <= 8 * sum(len(t) for _, t in items)
