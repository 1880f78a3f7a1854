import numpy as np
import pytest
import xxhash

from assayer.llm import simhash
from assayer.llm.common import connected_components
from tests.llm.conftest import SENTENCE


def brute_fingerprint(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=2):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprint_is_the_contract(odd):
    for t in [*odd, "One two THREE four", "É È one", SENTENCE]:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t and t[:40]


def test_long_texts_are_hashed_in_slices():
    text = " ".join(str(k * k % 1009) for k in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(n, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, clusters, dtype=np.uint64)
    out = []
    for k in range(n):
        x = int(centres[k % clusters]) if k % 2 else int(rng.integers(0, 2**63, dtype=np.uint64))
        for b in rng.integers(0, 64, int(rng.integers(0, 4))):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("levels", [0, 1, 3, 6])
def test_every_near_pair_meets_in_a_shard(levels):
    fps = clustered(600, levels)
    points, radii = simhash.fit_tree(fps[::3], levels)
    at, shard, home = simhash.deal(fps, points, radii, levels, 2)
    assert sorted(at[home].tolist()) == list(range(len(fps)))
    held = {}
    for i, s, h in zip(at, shard, home):
        held.setdefault(s, ([], []))[0 if h else 1].append(i)
    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2:
                assert any((i in own and j in own) or (i in own and j in other) or (j in own and i in other) for own, other in held.values())


@pytest.mark.parametrize("block", [1, 50, 10_000_000])
def test_shard_links_span_the_components(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = clustered(400, 3)
    home = np.arange(len(fps)) % 3 > 0
    child, root = simhash.shard_links(fps, home, 2)
    assert len(child) < len(fps)
    sets = simhash.Forest(len(fps))
    sets.link(child, root)
    got = [sets.root(i) for i in range(len(fps))]
    want = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (home[i] or home[j]) and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2:
                want.link(np.array([i]), np.array([j]))
    assert [want.root(i) for i in range(len(fps))] == got


def test_dense_blocks_stay_exact(monkeypatch):
    base = 0x0123456789ABCDEF
    fps = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)] + [~base & (2**64 - 1)], dtype=np.uint64))
    child, _ = simhash.shard_links(fps, np.ones(len(fps), bool), 2)
    assert len(child) == len(fps) - 2


def test_components_equal_brute_force(spark, docs, odd):
    texts = [*odd, *[SENTENCE + f" tail {k}" for k in range(20)], *["totally other words " + str(k) * 3 for k in range(20)]]
    got = simhash.simhash_components(docs(texts)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = dict(zip(range(len(texts)), brute_components(range(len(texts)), fps)))
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_components_with_nulls_repeats_and_nothing(spark, docs):
    rows = [(None, SENTENCE, "en", "a"), (7, SENTENCE, "en", "a"), (7, SENTENCE, None, None), (9, None, "en", "a"), (3, "", "en", "a"), (None, "alone in the world it is", "en", "a")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(rows)).collect()}
    assert {(a, c) for a, _, c in got} == {(None, 7), (7, 7), (9, 3), (3, 3), (None, None)}
    assert simhash.simhash_components(docs([])).count() == 0


def test_removal_keeps_one_of_each_group(spark, docs):
    rows = [(5, SENTENCE, "en", "a"), (2, SENTENCE, "en", "b"), (2, SENTENCE, "en", "c"), (8, "something else altogether for sure", "en", "a"), (None, SENTENCE, "en", "n")]
    df = docs(rows).selectExpr("*", "1 as key", "2 as row", "map('a', 1) as component_id")
    kept = simhash.near_duplicates_removed(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source) for r in kept.select("doc_id", "source").collect())[:2] == [(False, 2, kept.where("doc_id = 2").first().source), (False, 8, "a")]
    assert kept.where("doc_id = 2").count() == 1 and kept.where("doc_id is null").count() == 1 and kept.count() == 3
    assert simhash.near_duplicates_removed(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + k, 501 + k) for k in range(60)] + [(k, 1000) for k in range(2000, 2100)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = sorted({x for e in edges for x in e if None not in e and e[0] != e[1]})
    label = {n: n for n in nodes}
    for _ in range(200):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(df.limit(0)).count() == 0


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    from assayer.llm import common

    monkeypatch.setattr(common, "OFTEN", 50)
    edges = [(k, 5000) for k in range(1, 3000)] + [(0, 2999), (6000, 6001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(3000), 5000], 0), 6000: 6000, 6001: 6000}
    table = spark.createDataFrame([(k, 2000 if k == 1 else 1, f"v{k}") for k in range(5)], "k long, n long, v string")
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, 0), (9, 0)], "k long, i long")
    assert sorted(common.attach(rows, table, "k", 2002).select("k", "i", "v").collect()) == sorted([(1, i, "v1") for i in range(2000)] + [(2, 0, "v2")])


def test_a_cluster_without_a_shared_folder_is_told(monkeypatch):
    from assayer.llm import common

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.with_checkpoints(Session())
