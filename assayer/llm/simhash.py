"""SimHash near-duplicates: exact search with vantage-point trees.

Fingerprints live in the Hamming space of 64 bits. A vantage-point tree, fitted
on a bounded sample, deals every distinct fingerprint to one home shard: at each
node it goes inside or outside the ball around the node's vantage point. By the
triangle bound, a fingerprint has to be shown to the other side too only when its
own distance to the vantage point is within the link radius of the ball's
surface; such boundary copies make the search exact. Each shard is then searched
with the same recursion, down to blocks small enough to compare outright.

Exact copies share one fingerprint and are folded before the search. A shard
returns a spanning forest of its links, never all pairs, and the forests are
joined by distributed connected components.

Defined results: null and wordless texts have fingerprint zero and link like any
other; very long texts are hashed whole, in slices; repeated rows stay; a null doc_id
gets its group's smallest doc_id, or null if there is none; a bit that half of the
hashes have is 0; an empty table gives an empty result; other columns of `docs`,
whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import near_copies
from assayer.llm.common import BROADCAST_KEYS, attach, connected_components, cut, without

SEED = 42
#: Distinct fingerprints that fit the tree, at most.
SAMPLE = 40_000
#: Distinct fingerprints at home in a shard, about.
SHARD = 40_000
#: Levels of the tree that deals out shards, where the sample allows it.
MIN_LEVELS, MAX_LEVELS = 5, 16
#: Pairs that a shard compares outright.
BLOCK = 1_500_000


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    elif size == 3:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 65_536):  # bounds the memory that a very long text takes
        raw = b"".join([digest(s, SEED) for s in shingles[i : i + 65_536]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, key, fp) of every row: the text's hash, and the fingerprint's bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return src.mapInArrow(run, "doc_id long, key long, fp long")


def _apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def fit_tree(sample: np.ndarray, levels: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete binary tree, node i's children at 2i+1 and 2i+2.

    The radius is the median distance of the sample that reaches a node, so that
    both sides hold about as many fingerprints.
    """
    n = 2**levels - 1
    points, radii, reach = np.zeros(n, np.uint64), np.zeros(n, np.int16), {0: sample}
    rng = np.random.default_rng(seed)
    for i in range(n):
        own = reach.pop(i)
        if len(own) == 0:
            inside = outside = own
        else:
            # the one of a few points whose median splits most evenly
            best = None
            for vp in own[rng.integers(0, len(own), 6)]:
                d = _apart(own, vp)
                r = int(np.median(d))
                for radius in (r, r - 1):
                    even = abs(int((d <= radius).sum()) * 2 - len(own))
                    if radius >= 0 and (best is None or even < best[0]):
                        best = (even, vp, radius, d)
            _, points[i], radii[i], d = best
            inside, outside = own[d <= radii[i]], own[d > radii[i]]
        if 2 * i + 2 < n:
            reach[2 * i + 1], reach[2 * i + 2] = inside, outside
    return points, radii


def deal(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, shard, at home) of every copy that a search of `radius` needs.

    Two linked fingerprints part at one node, the one inside and the other
    outside; it is enough that the one inside also looks outside, and from then
    on looks on both sides wherever the bound doesn't rule one out.
    """
    at, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    for _ in range(levels):
        d, r = _apart(fps[at], points[node]), radii[node]
        inside = d <= r
        crosses = np.where(inside, d > r - radius, ~home & (d <= r + radius))
        own = 2 * node + 1 + ~inside
        other = (2 * node + 1 + inside)[crosses]
        at = np.concatenate([at, at[crosses]])
        home = np.concatenate([home, np.zeros(len(other), bool)])
        node = np.concatenate([own, other])
    return at, node - (2**levels - 1), home


class Forest:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def _compare(fps, a, b, radius, sets: Forest) -> None:
    """Link all near pairs of two lists of positions, a slice at a time."""
    step = max(1, BLOCK // max(1, len(b)))
    for k in range(0, len(a), step):
        rows = a[k : k + step]
        near = _apart(fps[rows][:, None], fps[b][None, :]) <= radius
        while True:  # dense blocks: a row links to one neighbour of each set only
            i, j = np.nonzero(near)
            if len(i) <= 20_000:
                sets.link(rows[i], b[j])
                break
            first = near.argmax(1)
            hit = near[np.arange(len(rows)), first]
            sets.link(rows[hit], b[first[hit]])
            roots_a = np.array([sets.root(x) for x in rows.tolist()])
            roots_b = np.array([sets.root(x) for x in b.tolist()])
            near &= roots_a[:, None] != roots_b[None, :]


def _split(fps, base, others, radius, rng):
    """A vantage point of `base` that puts rows on both of its sides, or None."""
    for vp in fps[base[rng.integers(0, len(base), 4)]]:
        d = _apart(fps[base], vp)
        r = int(np.median(d))
        r = r if (d > r).any() else r - 1
        if (d <= r).any():
            return d, [_apart(fps[o], vp) for o in others], r
    return None


def _cross(fps, a, b, radius, sets, rng) -> None:
    """Links between two lists of positions."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if len(a) == 0 or len(b) == 0:
            continue
        got = _split(fps, a, [b], radius, rng) if len(a) * len(b) > BLOCK and len(a) > 1 else None
        if got is None:
            _compare(fps, a, b, radius, sets)
            continue
        da, (db,), r = got
        stack.append((b[db <= r + radius], a[da <= r]))
        stack.append((b[db > r - radius], a[da > r]))


def shard_links(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, root) of the links of a shard's own fingerprints with all that came."""
    sets, rng = Forest(len(fps)), np.random.default_rng(len(fps))
    own, visiting = np.flatnonzero(home), np.flatnonzero(~home)
    _cross(fps, own, visiting, radius, sets, rng)
    stack = [own]
    while stack:
        x = stack.pop()
        got = _split(fps, x, [], radius, rng) if len(x) ** 2 > BLOCK else None
        if got is None:
            _compare(fps, x, x, 0 if len(x) < 2 else radius, sets)
            continue
        d, _, r = got
        stack += [x[d <= r], x[d > r]]
        _cross(fps, x[(d <= r) & (d > r - radius)], x[(d > r) & (d <= r + radius)], radius, sets, rng)
    roots = np.array([sets.root(i) for i in range(len(fps))], dtype=np.int64)
    child = np.flatnonzero(roots != np.arange(len(fps)))
    return child, roots[child]


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all values of column fp within `radius` bits of each other.

    The rows of `distinct` have to differ. Equal values need no edge.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    share = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.lit(1 << 40)) < int(min(1.0, SAMPLE * 0.95 / max(n, 1)) * (1 << 40))
    sample = np.array(sorted(r[0] for r in distinct.where(share).select("fp").limit(SAMPLE).collect()), dtype=np.int64).view(np.uint64)
    levels = int(min(MAX_LEVELS, max(MIN_LEVELS, np.ceil(np.log2(max(n, 1) / SHARD)))))
    levels = min(levels, max(0, int(np.log2(max(len(sample), 1) / 8))))
    points, radii = fit_tree(sample, levels)
    tree = spark.sparkContext.broadcast((points, radii))  # 2^levels entries

    def route(batches):
        points, radii = tree.value
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, shard, home = deal(fps, points, radii, levels, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        child, root = shard_links(fps, table.column("home").to_numpy(zero_copy_only=False), radius)
        return pa.table({"a": fps[child].view(np.int64), "b": fps[root].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def labelled(rows: DataFrame, groups) -> DataFrame:
    """`rows` (doc_id, key, fp) with their component, its smallest doc_id as component_id, and the key of a row that has it.

    groups: from the distinct values of fp to (node, component) of those that are
    linked to others.
    """
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))
    distinct = cut(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    found = groups(distinct)
    member = cut(found.join(distinct.withColumnRenamed("fp", "node"), "node"))
    least = member.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("size")).withColumnRenamed("size", "n")
    linked = attach(member.drop("n"), least, "component", member.count()).select(F.col("node").alias("fp"), "component", "least")
    label = F.coalesce("least", "first")
    labels = cut(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), label["doc_id"].alias("component_id"), label["key"].alias("component_key")))
    return attach(rows, labels, "fp", rows.count())


def simhash_components(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links of at most `radius` differing
    bits reach, itself included.
    """
    out = labelled(cut(fingerprints(docs, size)), lambda distinct: connected_components(near_links(distinct, radius)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates_removed(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """The rows of `docs` without near copies: of each component one row stays, of its smallest doc_id.

    All columns of `docs` come back as they were, extra ones of any name among
    them. Rows are judged by doc_id and text: rows of one doc_id whose texts
    aren't near copies all stay; of rows alike in both one is kept. Rows without
    a doc_id can't be told apart and stay. An empty table gives an empty result.
    """
    return first_of_each(docs, labelled(cut(fingerprints(docs, size)), lambda distinct: connected_components(near_links(distinct, radius))))


def near_copies_removed(docs: DataFrame, least: float = near_copies.LEAST, size: int = near_copies.SIZE, radius: int = 2) -> DataFrame:
    """As near_duplicates_removed, for near copies by word shingles (see `near_copies`).

    The tree links the fingerprints as there, and each of its components is one
    more bucket of candidates; the shingle sets decide.
    """
    rows = cut(near_copies.sketches(docs, size))
    tree = connected_components(near_links(rows.select(F.col("simhash").alias("fp")).distinct(), radius))
    return first_of_each(docs, labelled(rows.select("doc_id", "key", "fp"), lambda _: near_copies.near_copy_groups(docs, rows, least, size, tree)))


def first_of_each(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `labels` (doc_id, key, component_id, component_key) leave: one of each component."""
    labels = cut(labels.select("doc_id", "key", ((F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("component_key"))).alias("stays")))
    mine = labels.groupBy(F.col("doc_id").alias("copy"), F.col("key").alias("copy_key"), "stays").count()
    text = F.xxhash64(F.col("text").cast("string"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("key"))
    same = (F.col("id") == F.col("copy")) & (F.col("key") == F.col("copy_key"))
    kept = without(whole, same, cut(mine.where("not stays").select("copy", "copy_key")))
    repeated = cut(mine.where("stays and count > 1").select("copy", "copy_key"))
    if not repeated.isEmpty():
        few = repeated.count() <= BROADCAST_KEYS
        again = kept.join(F.broadcast(repeated) if few else repeated, same, "left_semi")
        one = again.groupBy("id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = without(kept, same, repeated).select("row").unionByName(one.select("row"))
    return kept.select("row.*")
