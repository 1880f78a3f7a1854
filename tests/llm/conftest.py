import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

SENTENCE = "the quick brown fox jumps over the lazy dog and then it runs far away from the old grey house on the hill"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source) tuples."""

    def make(rows):
        out = []
        for i, r in enumerate(rows):
            i, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", f"src{i % 3}")
            out.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(out, DOCS)

    return make


@pytest.fixture
def odd():
    """Texts of the kinds that break things: null, empty, blank, very long, repeated, odd characters."""
    long = " ".join(f"word{k % 977} and" for k in range(30_000))
    return [None, "", " \n\t ", "a", long, long, SENTENCE, SENTENCE, "é" * 50, "\x00\x0b\x0c\r", "🙂 🙂 🙂", "password=hunter22 " * 3, "x" * 5000]
