"""Near copies by word shingles: MinHash candidates, then an exact Jaccard check.

Two texts are near copies when the sets of their five-word shingles have a Jaccard
similarity of at least 0.8. Such texts differ in about ten of a SimHash's 64 bits,
too many for the vantage-point tree's bounds to rule anything out, so candidates are
found another way here: they share a band of their MinHash sketches. With `BANDS`
bands of `ROWS` values a pair of similarity 0.8 is missed in 5 of a million cases, a
closer one more rarely. Every link is then checked on the shingle sets themselves, so
no pair below the threshold is ever linked.

SimHash fingerprints that the vantage-point tree links (see `simhash`) put texts into
one bucket too.

Texts of equal words are folded first. Of each candidate text it is counted how many of
its shingles no other candidate has: what two texts share is at most what the rest of
either leaves, so a text with too many of its own has no near copy. Texts that buckets
connect are a group. A group is dealt by the size of the sets, as near copies' sizes
differ by a quarter at most: each text is at home in one class of sizes and visits the
next. A task compares a class, or a tile of two blocks of a large one, on the sets
themselves, and returns a spanning forest of its near copies, never all pairs. So every
candidate pair is compared, and the rows are those of the texts, a few times over: in a
class of m texts twice m / `SPREAD` times.

Defined results: null and wordless texts are copies of each other; a text of fewer
than five words is one shingle; letters' case (ASCII) and spacing don't matter; very
long texts are sketched whole, in slices; an empty table has no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import BROADCAST_KEYS, Written, attach, connected_components, cut

#: Words of a shingle, and the least similarity of near copies.
SIZE, LEAST = 5, 0.8
SEED = 42
ROWS, BANDS = 6, 40
#: Tables into which small classes are packed at least.
CENTRES = 1
#: Texts of a block; a class of more is compared in tiles of two blocks.
SPREAD = 500
#: Shingles of a block, and texts and shingles of a table of small classes, about.
SHINGLES, PACKED = 1_000_000, 2_000


def simhash(hashes: np.ndarray) -> np.int64:
    """SimHash of a text's shingle hashes, repeats included, as a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):  # bounds the memory that a very long text takes
        ones += np.unpackbits(hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(">i8").astype(np.int64)[0]


def hashed(text: str | None, size: int = SIZE) -> tuple[int, np.ndarray, bool]:
    """Hash of the text's words, the hashes of its shingles in order, and whether it has a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - size + 1)
    raw = b"".join([digest(b" ".join(words[i : i + size]), SEED) for i in range(n)])
    return xxhash.xxh64_intdigest(b" ".join(words), SEED + 1), np.frombuffer(raw, ">u8").astype(np.uint64), bool(words)


def shingles(text: str | None, size: int = SIZE) -> tuple[int, np.ndarray]:
    """Hash of the text's words, and the sorted distinct hashes of its shingles."""
    fp, hashes, _ = hashed(text, size)
    return fp, np.unique(hashes)


def bands(hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sketch's bands, each as one number."""
    low = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):  # bounds the memory that a very long text takes
        low = np.minimum(low, (times[:, None] * hashes[None, i : i + 1024]).min(1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, key, fp, n, bands, simhash) of every row: its text's hash, its words' hash, its number of shingles, its sketch, its fingerprint."""
    times = multipliers()

    def run(batches):
        for b in batches:
            fp, n, sketch, prints = [], [], [], []
            for t in b.column(2):
                words, hashes, some = hashed(t.as_py(), size)
                own = np.unique(hashes)
                fp.append(words)
                n.append(len(own))
                sketch.append(bands(own, times))
                prints.append(simhash(hashes) if some else 0)
            fp = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array(n, pa.int64()), _lists(sketch), pa.array(prints, pa.int64())], names=["doc_id", "key", "fp", "n", "bands", "simhash"])

    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return src.mapInArrow(run, "doc_id long, key long, fp long, n long, bands array<long>, simhash long")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(fp, shingles) of the texts in `wanted` (fp)."""

    def run(batches):
        for b in batches:
            found = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([f for f, _ in found], np.uint64).view(np.int64)), _lists([s for _, s in found])], names=["fp", "shingles"])

    one = cut(rows.groupBy("fp").agg(F.min("key").alias("key")).join(wanted, "fp", "left_semi").select("key").distinct())
    few = one.count() <= BROADCAST_KEYS
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).join(F.broadcast(one) if few else one, "key", "left_semi")
    return texts.select("text").mapInArrow(run, "fp long, shingles array<long>").dropDuplicates(["fp"])


def forest(sets: list[np.ndarray], allowed, least: float) -> list[tuple[int, int]]:
    """Pairs of positions of sets at least so similar that connect all such pairs; allowed(i): which others i is compared with."""
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    flat, row = np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(flat) else np.empty(0, np.int64)
    many = np.diff(np.append(starts, len(flat)))
    of = np.empty(len(flat), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), many)
    holders, ends = row[order], np.cumsum(np.append(0, size))
    label, found = np.arange(m), []
    for i in range(m):
        run = of[ends[i] : ends[i + 1]]
        run = run[many[run] > 1]
        if not len(run):
            continue
        n = many[run]
        at = np.arange(n.sum()) + np.repeat(starts[run] - np.append(0, np.cumsum(n)[:-1]), n)
        shared = np.bincount(holders[at], minlength=m)
        hits = np.flatnonzero((shared >= least * (size[i] + size - shared)) & (label != label[i]) & allowed(i))
        if len(hits):
            others, one = np.unique(label[hits], return_index=True)
            found += [(i, int(j)) for j in hits[one]]
            label[np.isin(label, others)] = label[i]
    return found


def _compared(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect all near copies of each group; rows: (fp, size, group)."""
    width = float(np.log(1 / least)) + 1e-9  # the sizes of near copies are of one class or of two that follow each other
    own = F.floor(F.log("size") / F.lit(width))
    seats = F.array(F.struct(own.alias("class"), F.lit(True).alias("home")), F.struct((own + 1).alias("class"), F.lit(False).alias("home")))
    seated = cut(rows.select("fp", "size", "group", F.explode(seats).alias("seat")).select("fp", "size", F.xxhash64("group", "seat.class").alias("unit"), "seat.home"))
    units = seated.groupBy("unit").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.max("home").alias("some")).where("n > 1 and some")
    units = cut(units.select("unit", "n", "all", F.ceil(F.greatest(F.col("n") / SPREAD, F.col("all") / SHINGLES)).alias("blocks")))
    whole = units.agg(F.count("*").alias("units"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("all"), F.lit(0)).alias("all")).first()
    tables = max(CENTRES, -(-whole["rows"] // PACKED), -(-whole["all"] // SHINGLES))
    kind = units.drop("all")
    placed = seated.join(F.broadcast(kind.drop("n")), "unit") if whole["units"] <= BROADCAST_KEYS else attach(seated, kind, "unit", whole["rows"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    small = placed.where("blocks = 1").select("fp", "home", "block", F.pmod("unit", F.lit(tables)).alias("unit"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    large = placed.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.select("fp", "home", "block", "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fp, home, block = (table.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "home", "block"))
        lists = table.column("shingles").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        allowed = lambda i: (home | home[i]) & (fp != fp[i]) & ((block != block[i]) | (not across))
        found = forest([values[x:y] for x, y in zip(ends[:-1], ends[1:])], allowed, least)
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        return pa.table({"a": fp[a], "b": fp[b]})

    dealt = small.unionByName(large).join(sets, "fp")
    return dealt.groupBy("unit", "i", "j").applyInArrow(compare, "a long, b long")


def near_copy_links(docs: DataFrame, rows: DataFrame, least: float = LEAST, size: int = SIZE, tree: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of column fp that connect all candidate pairs of at least `least`.

    rows: the sketches of `docs`. tree: (node, component) of the fingerprints that are linked to others.
    """
    return _grown(docs, rows, least, size, tree)


def near_copy_groups(docs: DataFrame, rows: DataFrame, least: float = LEAST, size: int = SIZE, tree: DataFrame | None = None) -> DataFrame:
    """(node, component) of column fp: what these edges connect; a value without any has no row."""
    return connected_components(_grown(docs, rows, least, size, tree))


def _grown(docs: DataFrame, rows: DataFrame, least: float, size: int, tree: DataFrame | None) -> DataFrame:
    texts, near = rows.dropDuplicates(["fp"]).select("fp", "n", "bands", "simhash"), F.col("simhash")
    if tree is not None:
        texts = texts.join(tree.select(F.col("node").alias("simhash"), "component"), "simhash", "left")
        near = F.coalesce("component", "simhash")
    dealt = cut(texts.select("fp", "n", F.concat("bands", F.array(F.xxhash64(near, F.lit(SEED)))).alias("bands"))).select("fp", F.col("n").alias("size"), F.explode("bands").alias("band"))
    shared = Written(dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")).frame
    held = shared.agg(F.count("*").alias("bands"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    few = held["bands"] <= BROADCAST_KEYS
    members = dealt.join(F.broadcast(shared), "band") if few else attach(dealt, shared.withColumn("members", F.col("n")), "band", held["rows"]).withColumnRenamed("members", "n")
    members = Written(members.select("band", "fp", "size"))
    sets = cut(_sets(docs, rows, members.frame.select("fp").distinct(), size))
    # shingles that one text alone has
    alone = sets.select("fp", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).where("n = 1")
    alone = alone.groupBy("fp").agg(F.count("*").alias("alone"))
    able = members.frame.join(alone, "fp", "left").where(F.col("size") - F.coalesce("alone", F.lit(0)) >= least * F.col("size"))
    members = members.next(able.select("band", "fp", "size"))
    first = members.frame.groupBy("band").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = members.frame.join(F.broadcast(first), "band") if few else attach(members.frame, first, "band", held["rows"])
    group = connected_components(edges.select(F.col("fp").alias("a"), F.col("low").alias("b")))
    grouped = group.select(F.col("node").alias("fp"), F.col("component").alias("group")).join(members.frame.select("fp", "size").distinct(), "fp")
    return Written(_compared(grouped, sets, least)).frame
