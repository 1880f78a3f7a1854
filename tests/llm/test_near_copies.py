import random

import numpy as np
import pytest

import corpus_pipeline as P
from assayer.llm import near_copies, simhash
from tests.llm.conftest import SENTENCE


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_kept(texts):
    sets, up = [brute_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    return {i for i, u in enumerate(up) if i == u}


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(words, places):
    words = list(words)
    for k in places:
        words[k] = f"new{k}"
    return " ".join(words)


def varied():
    texts = []
    for g in range(12):
        words = prose(g, 150 + 40 * g)
        texts += [" ".join(words), "  ".join(words).upper()]
        for c in range(8):
            rng = random.Random(100 * g + c)
            texts.append(edited(words, rng.sample(range(len(words)), rng.randrange(1, 9))))
    return texts


def test_pipeline_drops_copies_with_changed_words(spark, docs):
    words = prose(1, 300)
    texts = [" ".join(words), edited(words, [40, 150, 260]), edited(words, range(0, 300, 6)), " ".join(prose(2, 300))]
    assert bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).count("1") > 2
    assert {r.doc_id for r in P.deduplicate(spark, docs(texts), "").collect()} == {0, 2, 3}


@pytest.mark.parametrize("centres", [1, 8])
def test_kept_equal_brute_force(spark, docs, odd, monkeypatch, centres):
    monkeypatch.setattr(near_copies, "CENTRES", centres)
    texts = [*odd, *varied()]
    assert {r.doc_id for r in simhash.near_copies_removed(docs(texts)).collect()} == brute_kept(texts)


def test_a_chain_is_one_group(spark, docs):
    words = prose(3, 200)
    texts = [edited(words, range(10, 10 + 6 * k, 6)) for k in range(1, 30)]
    assert {r.doc_id for r in simhash.near_copies_removed(docs(texts)).collect()} == brute_kept(texts) == {0}


def test_a_centre_of_very_many_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(near_copies, "SPREAD", 10)
    words = prose(4, 200)
    texts = [edited(words, [k % 200]) + f" {k // 200}" for k in range(300)] + varied()
    assert {r.doc_id for r in simhash.near_copies_removed(docs(texts)).collect()} == brute_kept(texts)


def test_buckets_of_texts_that_are_not_alike(spark, docs):
    # a long passage in common: many share bands, few are near copies
    common = prose(5, 150)
    texts = [" ".join(common + prose(100 + k, 60)) for k in range(40)] + [" ".join(common + prose(100 + k % 7, 60) + [f"x{k}"]) for k in range(30)]
    assert {r.doc_id for r in simhash.near_copies_removed(docs(texts)).collect()} == brute_kept(texts)


@pytest.mark.parametrize("remove", [simhash.near_copies_removed, simhash.near_duplicates_removed])
def test_rows_that_share_a_doc_id(spark, docs, remove):
    a, b, c, d = (" ".join(prose(20 + k, 60)) for k in range(4))
    rows = [(1, a, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (7, c, "en", "x"), (7, d, "en", "x"), (7, d, "de", "y"), (None, a, "en", "x"), (None, None, "en", "x"), (8, None, "en", "x"), (8, "", "en", "x")]
    kept = sorted(((r.doc_id, r.text) for r in remove(docs(rows)).collect()), key=str)
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (7, c), (7, d), (None, a), (None, None), next(x for x in kept if x[0] == 8)], key=str)


def test_every_lost_row_has_a_copy_that_stays(spark, docs, odd):
    rng = random.Random(3)
    texts = [*odd, *varied()]
    rows = [(rng.choice([None, *range(30)]), t, "en", f"s{k}") for k, t in enumerate(texts * 2)]
    left = [r.source for r in simhash.near_copies_removed(docs(rows)).collect()]
    assert len(set(left)) == len(left)
    groups = {}
    sets, up = [brute_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(sets)):
        for j in range(i):
            if up[i] != up[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    for i, r in enumerate(rows):
        groups.setdefault(up[i], []).append(r)
    for group in groups.values():
        ids = [r[0] for r in group if r[0] is not None]
        stay = [r for r in group if r[3] in left]
        assert sum(r[0] is None for r in stay) == sum(r[0] is None for r in group)
        assert [r[0] for r in stay if r[0] is not None] == ([min(ids)] if ids else [])


def test_forest_connects_what_is_alike():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, rng.integers(1, 40))) for _ in range(80)] + [np.arange(30)] * 20
    found = near_copies.forest(sets, lambda i: np.ones(len(sets), bool), 0.4)
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j)]
    assert all(alike(i, j) for i, j in found) and len(found) < len(sets) < len(pairs)

    def parts(edges):
        up = list(range(len(sets)))
        for i, j in edges:
            low, high = sorted((up[i], up[j]))
            up = [low if u == high else u for u in up]
        return up

    assert parts(found) == parts(pairs)


def test_the_tree_gives_candidates_too(spark, docs, monkeypatch):
    # without any shared band, copies that the tree links at two bits are found all the same
    monkeypatch.setattr(near_copies, "bands", lambda hashes, times: np.random.default_rng(hashes[:8]).integers(0, 2**63, 4).astype(np.uint64))
    words = prose(8, 900)
    texts = [" ".join(words), *(edited(words, [k]) for k in range(0, 900, 30)), " ".join(prose(9, 900))]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert {r.doc_id: r.simhash for r in near_copies.sketches(docs([*texts, "", "one two"])).collect()} == {k: p - (p >> 63 << 64) for k, p in enumerate([*prints, 0, simhash.fingerprint("one two", 5)])}
    assert len(set(prints[:-1])) > 3
    left, linked = set(range(1, len(texts))), [0]
    while linked:
        k = linked.pop()
        near = {i for i in left if (prints[k] ^ prints[i]).bit_count() <= 2}
        left -= near
        linked += near
    assert len(left) < len(texts) - 10
    assert {r.doc_id for r in simhash.near_copies_removed(docs(texts)).collect()} <= {0} | left


def test_links_hold_exactly(spark, docs):
    texts = varied()
    df = docs(texts)
    rows = near_copies.sketches(df)
    of = {r.fp: r.doc_id for r in rows.collect()}
    links = near_copies.near_copy_links(df, rows).collect()
    assert links
    for r in links:
        a, b = brute_set(texts[of[r.a]]), brute_set(texts[of[r.b]])
        assert 5 * len(a & b) >= 4 * len(a | b)


def test_nothing_and_columns(spark, docs):
    df = docs([(5, SENTENCE, "en", "a"), (2, SENTENCE, "en", "b"), (None, SENTENCE, "en", "n")]).selectExpr("*", "1 as key", "2 as row", "3 as fp")
    kept = simhash.near_copies_removed(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert simhash.near_copies_removed(docs([])).count() == 0
