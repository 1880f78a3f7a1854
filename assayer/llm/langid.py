"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of labelled texts by partition, sums them in Spark
and turns them into one matrix of log probabilities, languages by buckets, which
is broadcast (its size is languages times `BUCKETS`, and languages are bounded).
Scoring hashes a batch of texts at once in numpy and gathers only the matrix
columns of n-grams that occur.

Training takes at most about `per_language` texts of each language, chosen by the
hash of doc_id; class priors are counts over all labelled training rows. Whole
texts count, in training and in scoring.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is everything if no row has a label; rows with a null doc_id aren't learned
from and count as not held out; repeated rows are rows; ties go to the language
that sorts first; very long texts are scored whole, in slices; an empty table gives
an empty result; other columns, whatever their names, are not read; more than
`MAX_LANGUAGES` labels raise, as the matrix has a row for each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import opened, ship

BUCKETS = 1 << 15
ORDERS = (2, 3)
PER_LANGUAGE = 4_000
MAX_LANGUAGES = 256
ALPHA = 0.5
UNDETERMINED = "und"
#: Characters that are scored at once.
CHUNK = 1 << 19

_wordlike = re.compile(r"[^\W\d_]").finditer


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32(doc_id as text) leaves `part` when divided by `parts`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as fractions and superscripts are none."""
    return any(m[0].isalpha() for m in _wordlike(text))


def grams(text: str) -> np.ndarray:
    """Buckets of a text's n-grams: lower case, runs of other than letters as one blank."""
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    a = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(a) < n:
            continue
        h = np.full(len(a) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ a[k : len(a) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


class Model:
    """Log probabilities: languages sorted by name, buckets by languages, and priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray):
        self.languages = languages
        smooth = counts.astype(np.float64) + ALPHA
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
        self.prior = np.log((rows + ALPHA) / (rows + ALPHA).sum()) if languages else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [t is not None and has_letter(t) and bool(self.languages) for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            if waiting:
                ids = np.concatenate([g for _, g in waiting])
                begin = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
                np.add.at(total, [i for i, _ in waiting], np.add.reduceat(self.logp[ids], begin, axis=0, dtype=np.float64))
                waiting.clear()

        for i, t in enumerate(texts):
            if known[i]:
                g = grams(t)
                for k in range(0, len(g), CHUNK):
                    waiting.append((i, g[k : k + CHUNK]))
                    size += len(waiting[-1][1])
                    if size >= CHUNK:
                        flush()
                        size = 0
        flush()
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self.languages:
            total += self.prior
            best = total.argmax(1)
            with np.errstate(under="ignore"):
                p = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i in np.flatnonzero(known):
                names[i], scores[i] = self.languages[best[i]], float(min(1.0, p[i]))
        return names, scores


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows of `docs` (doc_id, text, lang) that aren't held out and have a label."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in names for x in (lang, int(min(1.0, per_language / sizes[lang]) * (1 << 30)))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang"))).where("text is not null")
    order = {lang: i for i, lang in enumerate(names)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                k = order[lang]
                if k not in sums:
                    sums[k] = np.zeros(BUCKETS, np.int64)
                sums[k] += np.bincount(grams(text.as_py()), minlength=BUCKETS)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "bucket", "n"])

    summed = some.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), BUCKETS), np.int64)
    got = summed.toArrow()  # at most languages times buckets
    counts[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(names, counts, np.array([sizes[x] for x in names], dtype=np.float64))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs` (doc_id, text, and lang to train from).

    score is the model's probability of lang_pred.
    """
    shared = ship(docs.sparkSession, model or train(docs))

    def run(batches):
        predict = opened(shared).predict
        for b in batches:
            names, scores = predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
