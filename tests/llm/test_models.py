import zlib

import numpy as np
import pytest

from assayer.llm import langid, quality_model
from assayer.llm.tokens import Counter, count_tokens, whole_tokens
from tests.llm.conftest import SENTENCE

SF = "/root/testdata/sf0.01"


# --- language ----------------------------------------------------------------


def brute_language(model, text):
    """Log probabilities by a loop over n-grams."""
    total = model.prior.copy()
    for g in langid.grams(text).tolist():
        total = total + model.logp[g].astype(float)
    p = np.exp(total - total.max())
    return model.languages[int(total.argmax())], float(p.max() / p.sum())


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {k for k, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scores_equal_a_loop_and_dont_see_labels(spark, docs, odd):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs_, per_language=30)
    texts = [*odd, "Der Hund und die Katze", "ein", SENTENCE * 200, "123 !!", "ß"]
    got = {r.doc_id: r for r in langid.identify(docs(texts).drop("lang"), model).collect()}
    for k, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
        else:
            lang, p = brute_language(model, t)
            assert got[k].lang_pred == lang and got[k].score == pytest.approx(p, abs=1e-4)


def test_language_without_labels(spark, docs):
    rows = [(1, "some text", None, "a"), (None, "more text", "en", "a")]
    assert {r.lang_pred for r in langid.identify(docs(rows)).collect()} == {"und"}
    assert langid.identify(docs([])).count() == 0


# --- quality -----------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in quality_model.score_quality(docs, labels).collect()}
    held = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {d for d, _ in held} <= {k for k, r in got.items() if r.held_out}
    right = [got[d].predicted == q for d, q in held]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_normal_equations_by_partition(spark):
    rng = np.random.default_rng(0)
    stats = rng.normal(size=(500, len(quality_model.statistics(""))))
    y = (stats[:, 0] + stats[:, 1] ** 2 > 1).astype(float)
    model = quality_model.Model(stats.mean(0), stats.std(0), None, None, None)
    df = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y)], "stats array<double>, y double").repartition(7)
    left, right = 0, 0
    for r in df.mapInArrow(quality_model._partition_sums(model), "left binary, right binary").collect():
        left, right = left + np.frombuffer(r.left).reshape(257, 257), right + np.frombuffer(r.right)
    f = model.features(stats)
    assert np.allclose(left, f.T @ f) and np.allclose(right, f.T @ y)


def test_isotonic():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    xs, ys = quality_model.isotonic(x, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(ys) >= 0).all() and len(xs) == 3
    assert ys[0] < 0.4 < ys[-1]


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, 16))
    model = quality_model.Model(np.zeros(16), np.ones(16), None, None, None)
    f = model.features(z)[:, :-1]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 16))
    assert np.abs(f @ f.T - want).mean() < 0.06


def test_quality_of_odd_tables(spark, docs, odd):
    labels = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    assert {r.score for r in quality_model.score_quality(docs(odd), none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1, None) for k in range(12)] + [(None, 0, 0), (3, None, 0)], labels)
    assert {r.score for r in quality_model.score_quality(docs(odd), one).collect()} == {1.0}
    mixed = spark.createDataFrame([(k, k % 2, 0) for k in range(13)] * 2, labels)
    got = quality_model.score_quality(docs([*odd, (None, "x", "en", "a")]), mixed).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score_quality(docs([]), mixed).count() == 0


# --- tokens ------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_whole_tokens_are_proven(tokenizer):
    whole = whole_tokens(tokenizer[1])
    assert len(whole) > 40_000
    for w in whole[::97]:
        assert len(tokenizer[1].encode(w, add_special_tokens=False).ids) == 1


def test_counts_equal_the_library(tokenizer):
    import random

    rng = random.Random(3)
    counter = Counter(tokenizer[1].to_str(), whole_tokens(tokenizer[1]))
    letters = "aé ñ\n\t <|endoftext|>'s 12³½   漢字😀​̀ЖꙮǅΩ_-!?.\r\n  "
    for _ in range(4000):
        t = "".join(rng.choice(letters) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(1, 14)))
        if rng.random() < 0.1:
            t += "<|endoftext|>" * rng.randrange(3) + " a"
        assert counter.tokens(t) == len(tokenizer[1].encode(t, add_special_tokens=False).ids), repr(t)


def test_rows_of_counts(spark, docs, odd, tokenizer):
    path, library = tokenizer
    got = {r.doc_id: r for r in count_tokens(docs(odd).selectExpr("*", "1 as n_bytes", "2 as n_tokens"), path).collect()}
    for k, t in enumerate(odd):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert count_tokens(docs([]), path).count() == 0


def test_numerals_are_no_letters(spark, docs):
    from assayer.llm import langid

    odd = ["\u00bd \u00b2", "\u2167 \u2460", "12 34", "_", "\U0001f642", "\u0e01", "a\u00bd"]
    rows = [(k, f"the old house by the river number {k}", "en", "s") for k in range(40)]
    got = {r.doc_id: r for r in langid.identify(docs(rows + [(100 + k, t, None, "s") for k, t in enumerate(odd)])).collect()}
    for k, t in enumerate(odd):
        letters = any(c.isalpha() for c in t)
        assert (got[100 + k].lang_pred == "en") == letters and (got[100 + k].score > 0) == letters, t


def test_other_tokenizer_files_are_counted_by_the_library(spark, docs, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from assayer.llm import tokens

    plain = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert tokens.is_plain(json.dumps(plain))
    texts = ["One two three. one TWO", " lead", "it's 12345 and\n\nmore", ""]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"truncation": {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}}):
        spec = json.dumps(plain | change)
        path = tmp_path / f"{next(iter(change))}.json"
        path.write_text(spec, encoding="utf-8")
        library = Tokenizer.from_str(spec)
        library.no_truncation()
        want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(texts), str(path)).collect()}
        assert [got[k] for k in range(len(texts))] == want
        assert tokens.is_plain(spec) == ("truncation" in change)


def test_sums_come_from_few_partitions(spark, docs):
    from assayer.llm import quality_model as Q

    good, bad = "The old house by the river is warm and the people in it are kind to all.", "$$$ ### buy now %%% !!! &&& ***"
    rows = [(k, (good if k % 2 else bad) * (1 + k % 5), "en", "s") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    got = Q.score_quality(docs(rows).repartition(60), labels).collect()
    assert sum((r.score > 0.5) == bool(r.doc_id % 2) for r in got) >= 195
