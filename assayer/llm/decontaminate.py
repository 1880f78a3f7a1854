"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are the index, the training passages are the queries. Passages are
windows of twice the longest item's words, starting every such length, so that an
item's copy lies whole in one of them. Items are indexed by length class, so that
one long item doesn't widen the windows of the short ones.

Impacts are BM25 weights divided by the item's own threshold, so that one bound,
1, holds for all items. An item's threshold is the least BM25 score that a passage
can have which keeps enough of its five-word shingles to be verified: the item's
full score without the heaviest words that may be missing. WAND with block maxima
returns every item at or above it. What it returns is verified by the share of
five-word shingles of the item's question, and of its answer, that the passage
holds; both have to reach `overlap`. The answer is the item's last sentence, if
more than one has words.

The index is packed: posting lists and word numbers lie in flat arrays, about six
bytes for a character of item text. It is broadcast in shards of at most
`SHARD_CHARS` such characters; a larger benchmark takes more passes over the
documents, one shard after the other. Lengths and word frequencies are those of all
items of a class, so neither the pairs found nor their scores depend on the shards.

Defined results: null and empty texts match nothing; items without words match
nothing; parts of fewer than five words are one shingle; ties and repeated rows
stay, each with its own rows; very long texts are searched whole, window by window;
an empty table on either side gives an empty result; a null doc_id is carried as it
is; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, opened, ship, without

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
#: Items in a block of a posting list that share a maximum.
BLOCK = 8
#: Characters of item text in a shard of the index, which takes about six bytes for each.
SHARD_CHARS = 8_000_000
#: Runs of items with a coarse maximum for each word.
RUNS = 32
#: Longest item, in words, of each length class; longer items double on.
CLASSES = (64, 256, 1024)

words_of = re.compile(r"\w+").findall


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text.lower()) if (w := words_of(s))]
    if len(sentences) < 2:
        return [w for s in sentences for w in s], []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(words: list) -> set[tuple]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _may_miss(words: list, overlap: float) -> int:
    """Words that can be missing while `overlap` of the distinct shingles stay: each takes one at least."""
    return int((1 - overlap) * len(shingles(words)) + 1e-9)


class _Lists:
    """A list of lists as one flat array and where each of them begins."""

    def __init__(self, kind: str, lists):
        self.flat = array(kind)
        self.at = array("q", [0])
        for x in lists:
            self.flat.extend(x)
            self.at.append(len(self.flat))

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, i: int) -> list:
        return self.flat[self.at[i] : self.at[i + 1]].tolist()


class Statistics:
    """Of all items of a length class: how many there are, their mean words, and how many hold each word."""

    def __init__(self, items: int, mean: float, df):
        self.items, self.mean, self.df = items, mean, df

    @classmethod
    def of(cls, items: list[tuple[object, list[str], list[str]]]) -> Statistics:
        return cls(len(items), sum(len(q) + len(a) for _, q, a in items) / len(items), Counter(w for _, q, a in items for w in {*q, *a}))


class Index:
    """Posting lists of normalised impacts for items of one length class."""

    def __init__(self, items: list[tuple[object, list[str], list[str]]], width: int, overlap: float, all_items: Statistics | None = None):
        self.width, self.overlap, self.ids = width, overlap, [i for i, _, _ in items]
        self.vocab = {w: i for i, w in enumerate(sorted({w for _, q, a in items for w in q + a}))}
        self.questions = _Lists("i", ([self.vocab[w] for w in q] for _, q, _ in items))
        self.answers = _Lists("i", ([self.vocab[w] for w in a] for _, _, a in items))
        c = all_items or Statistics.of(items)
        #: The largest impact of each word, and 0 for a word of no item.
        self.upper = np.zeros(len(self.vocab) + 1)
        #: The same for each of a few runs of items: most passages fall below the bound in every run.
        run = max(BLOCK, -(-len(items) // RUNS))
        self.coarse = np.zeros((len(self.vocab) + 1, -(-len(items) // run)), np.float32)
        numbers, terms, values = array("i"), array("i"), array("d")
        for i, (_, q, a) in enumerate(items):
            bag, length = Counter(q + a), len(q) + len(a)
            impact = {w: log(1 + (c.items - c.df[w] + 0.5) / (c.df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / c.mean)) for w, n in bag.items()}
            gone = sorted(impact.values(), reverse=True)[: _may_miss(q, overlap) + _may_miss(a, overlap)]
            least = max(sum(impact.values()) - sum(gone), 1e-9)
            for w, x in impact.items():
                t = self.vocab[w]
                numbers.append(i)
                terms.append(t)
                values.append(x / least)
                self.upper[t] = max(self.upper[t], x / least)
                self.coarse[t, i // run] = max(self.coarse[t, i // run], x / least)
        order = np.argsort(np.frombuffer(terms, np.int32), kind="stable") if terms else np.zeros(0, np.int64)
        #: Where each word's list begins; its items, ascending, and their impacts.
        self.at = array("q", [0, *accumulate(np.bincount(np.frombuffer(terms, np.int32), minlength=len(self.vocab)).tolist())]) if terms else array("q", [0])
        self.numbers = array("i", np.frombuffer(numbers, np.int32)[order].tobytes()) if terms else array("i")
        self.values = array("d", np.frombuffer(values, np.float64)[order].tobytes()) if terms else array("d")
        #: The maxima of the lists' blocks, and where each list's begin.
        self.maxima = _Lists("d", ([max(self.values[k : min(k + BLOCK, hi)]) for k in range(lo, hi, BLOCK)] for lo, hi in zip(self.at, self.at[1:])))

    @property
    def items(self) -> list[tuple[object, list[str], list[str]]]:
        """The items that were indexed: (id, question's words, answer's words)."""
        words = list(self.vocab)
        return [(i, [words[t] for t in self.questions[k]], [words[t] for t in self.answers[k]]) for k, i in enumerate(self.ids)]

    @property
    def docs(self) -> list[list[int]]:
        return [self.numbers[lo:hi].tolist() for lo, hi in zip(self.at, self.at[1:])]

    @property
    def impacts(self) -> list[list[float]]:
        return [self.values[lo:hi].tolist() for lo, hi in zip(self.at, self.at[1:])]

    def search(self, terms: list[int], least: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
        """(item, score) of every item whose normalised score for distinct `terms` is at least `least`.

        Block-max WAND: the pivot is the first item at which the lists' maxima
        can reach the bound; if the maxima of the blocks that hold it can't, all
        lists before it skip to where the first of these blocks ends.
        """
        numbers, values, begin, upper = self.numbers, self.values, self.at, self.upper
        maxima, first = self.maxima.flat, self.maxima.at
        end, out = len(self.ids), []
        at = [[numbers[begin[t]], begin[t], t] for t in terms]
        while at:
            at.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(at):
                total += upper[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            # shallow move: the block of each list that could hold the pivot item
            bound, skip = 0.0, end
            for _, p, t in at[: pivot + 1]:
                lo, hi = begin[t], begin[t + 1]
                block = (bisect_left(numbers, item, p, hi) - lo) // BLOCK
                if first[t] + block < first[t + 1]:
                    bound += maxima[first[t] + block]
                    skip = min(skip, numbers[min(lo + (block + 1) * BLOCK, hi) - 1] + 1)
            if bound < least:
                target = max(item + 1, min(skip, at[pivot + 1][0] if pivot + 1 < len(at) else end))
            else:
                target = item + 1
                score = 0.0
                for _, p, t in at[: pivot + 1]:
                    p = bisect_left(numbers, item, p, begin[t + 1])
                    if p < begin[t + 1] and numbers[p] == item:
                        score += values[p]
                if score >= least:
                    out.append((item, score))
            for x in at[: pivot + 1]:
                x[1] = bisect_left(numbers, target, x[1], begin[x[2] + 1])
                x[0] = numbers[x[1]] if x[1] < begin[x[2] + 1] else end
            at = [x for x in at if x[0] < end]
        return out

    def leaks(self, words: list[str]) -> dict[int, tuple[float, float, float]]:
        """item to (score, question overlap, answer overlap), for the verified items of a text."""
        get, none = self.vocab.get, len(self.vocab)
        ids = np.array([get(w, none) for w in words], dtype=np.int32)
        # an upper bound of each window's score, repeats counted: below 1 nothing can be found
        sums = np.concatenate([[0.0], np.cumsum(self.upper[ids])])
        begin = np.arange(0, max(1, len(ids) - self.width), self.width)
        stop = np.minimum(begin + 2 * self.width, len(ids))
        found: dict[int, tuple[float, float, float]] = {}
        for k in np.flatnonzero(sums[stop] - sums[begin] >= 1.0 - 1e-6):
            window = ids[begin[k] : stop[k]]
            terms = np.unique(window)
            terms = terms[terms < none]
            if self.coarse[terms].sum(0).max(initial=0.0) < 1.0 - 1e-4:
                continue
            held: dict[int, set] = {}
            window = window.tolist()
            for item, score in self.search(terms.tolist()):
                share = []
                for part in (shingles(self.questions[item]), shingles(self.answers[item])):
                    if not part:
                        share.append(1.0)
                        continue
                    n = len(next(iter(part)))
                    if n not in held:
                        held[n] = {tuple(window[i : i + n]) for i in range(len(window) - n + 1)}
                    share.append(len(part & held[n]) / len(part))
                if min(share) >= self.overlap - 1e-9:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, *share))
        return found


def width_of(q: list[str], a: list[str]) -> int:
    """The length class of an item: the longest that its items may have."""
    n = len(q) + len(a)
    width = next((c for c in CLASSES if n <= c), CLASSES[-1])
    while width < n:
        width *= 2
    return width


def build(rows: list[tuple[object, str | None]], overlap: float, classes: dict[int, Statistics] | None = None) -> list[Index]:
    """Indexes of (item_id, text) rows, one for each length class that has items; `classes` are theirs if there are more items."""
    parted: dict[int, list] = {}
    for item, text in rows:
        q, a = parts(text or "")
        if q or a:
            parted.setdefault(width_of(q, a), []).append((item, q, a))
    return [Index(items, width, overlap, classes and classes[width]) for width, items in sorted(parted.items())]


def _described(items: DataFrame) -> DataFrame:
    """(shard, width, words, terms) of the items (shard, text) that have words."""

    def run(batches):
        for b in batches:
            out = []
            for shard, text in zip(b.column(0).to_pylist(), b.column(1)):
                q, a = parts(text.as_py() or "")
                if q or a:
                    out.append((shard, width_of(q, a), len(q) + len(a), sorted({*q, *a})))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["shard", "width", "words", "terms"])

    return items.select("shard", "text").mapInArrow(run, "shard long, width long, words long, terms array<string>")


def _matcher(shared):
    def run(batches):
        indexes = opened(shared)
        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if text:
                    words = words_of(text.lower())
                    for index in indexes:
                        rows += [(doc, index.ids[i], *x) for i, x in sorted(index.leaks(words).items())]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each item that a document holds.

    score is the BM25 score over the item's threshold. Documents without leaks have no row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(chars // SHARD_CHARS + 1)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def index(k: int, classes=None) -> list[Index]:
        rows = sorted(((r[0], r[1]) for r in items.where(F.col("shard") == k).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        return build(rows, overlap, classes)

    if shards == 1:
        return src.mapInArrow(_matcher(ship(spark, index(0))), schema)
    described = cut(_described(items))
    sizes = {r["width"]: (r["n"], r["words"] / r["n"]) for r in described.groupBy("width").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    terms = described.select("shard", "width", F.explode("terms").alias("term"))
    df = cut(terms.groupBy("width", "term").agg(F.count("*").alias("df")))
    out = []
    for k in range(shards):
        classes = {w: Statistics(n, mean, {}) for w, (n, mean) in sizes.items()}
        for r in terms.where(F.col("shard") == k).select("width", "term").distinct().join(df, ["width", "term"]).collect():  # a shard's words
            classes[r["width"]].df[r["term"]] = r["df"]
        shared = ship(spark, index(k, classes))
        out.append(cut(src.mapInArrow(_matcher(shared), schema)))
        shared.unpersist()  # one shard's index at a time
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole


def leaky_removed(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns.

    Rows without a doc_id are judged together and stay if none of them leaks.
    """
    bad = cut(find_leaks(docs, benchmark, overlap).select(F.col("doc_id").alias("key")).distinct())
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return without(whole, F.col("id").eqNullSafe(F.col("key")), bad).select("row.*")


def oracle_sql(overlap: float = OVERLAP) -> str:
    """DuckDB SQL for `find_leaks`, scores rounded to six places: every window against every item of its class."""
    n = SHINGLE
    width = f"CASE {' '.join(f'WHEN len(q) + len(a) <= {c} THEN {c}' for c in CLASSES)} ELSE {CLASSES[-1]} * pow(2, ceil(log2((len(q) + len(a)) / {CLASSES[-1]}.0)))::BIGINT END"
    shingled = lambda x: f"list_distinct(list_transform(range(1, len({x}) - least({n}, len({x})) + 2), lambda i: array_to_string({x}[i:i + least({n}, len({x})) - 1], ' ')))"
    held = lambda x: f"list_transform(range(1, len(w) - least({n}, len({x})) + 2), lambda i: array_to_string(w[i:i + least({n}, len({x})) - 1], ' '))"
    share = lambda x, s: f"CASE WHEN len({x}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({s}, {held(x)}))::DOUBLE / len({s}) END"
    may_miss = lambda s: f"floor((1 - {overlap}::DOUBLE) * len({s}) + 1e-9)::INT"
    return rf"""
WITH sentence AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')), lambda x: len(x) > 0) AS s FROM benchmark),
part AS (SELECT item_id, CASE WHEN len(s) < 2 THEN flatten(s) ELSE flatten(s[1:len(s) - 1]) END AS q, CASE WHEN len(s) < 2 THEN [] ELSE s[len(s)] END AS a FROM sentence WHERE len(s) > 0),
item AS (SELECT item_id, q, a, {width} AS width, {shingled("q")} AS qs, {shingled("a")} AS ans FROM part),
term AS (SELECT item_id, width, t, count(*) AS tf FROM (SELECT item_id, width, unnest(q || a) AS t FROM item) GROUP BY ALL),
stat AS (SELECT width, count(*) AS items, avg(len(q) + len(a)) AS mean FROM item GROUP BY width), df AS (SELECT width, t, count(*) AS df FROM term GROUP BY ALL),
impact AS (SELECT item_id, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * (len(q) + len(a)) / mean)) AS x FROM term JOIN df USING (width, t) JOIN stat USING (width) JOIN item USING (item_id)),
bound AS (SELECT item_id, list(t) AS ts, list(x) AS xs, list_sum(list(x)) - coalesce(list_sum((list(x ORDER BY x DESC))[1:any_value({may_miss("qs")} + {may_miss("ans")})]), 0) AS least FROM impact JOIN item USING (item_id) GROUP BY item_id),
doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE text <> ''),
win AS (SELECT doc_id, r, width, w[lo + 1:lo + 2 * width] AS w FROM (SELECT doc_id, r, width, w, unnest(range(0, greatest(1, len(w) - width), width)) AS lo FROM doc, (SELECT DISTINCT width FROM item))),
near AS (SELECT doc_id, r, item_id, w, q, a, qs, ans FROM win JOIN item USING (width) WHERE list_has_any(w, q)),
judged AS (SELECT doc_id, r, item_id, w, {share("q", "qs")} AS question, {share("a", "ans")} AS answer FROM near),
good AS (SELECT * FROM judged WHERE question >= {overlap}::DOUBLE - 1e-9 AND answer >= {overlap}::DOUBLE - 1e-9),
scored AS (SELECT doc_id, r, item_id, question, answer, list_sum(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN list_contains(w, ts[i]) THEN xs[i] ELSE 0 END)) / greatest(least, 1e-9) AS score FROM good JOIN bound USING (item_id)),
best AS (SELECT doc_id, r, item_id, max((score, question, answer)) AS m FROM scored GROUP BY ALL)
SELECT doc_id, item_id, round(m[1], 6) AS score, m[2] AS question_overlap, m[3] AS answer_overlap FROM best
"""
