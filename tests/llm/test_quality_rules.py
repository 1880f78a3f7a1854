import re
from collections import Counter

import pytest

from assayer.llm import quality_rules as Q
from tests.llm.conftest import SENTENCE


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, docs, odd):
    texts = [*odd, "a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x", "a a a a a", "l1 x\nl1 x\n\n\nl2\nl1 x", "#*$%&|<>", SENTENCE * 3]
    for r in Q.quality_report(docs(texts)).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    "text, rule",
    [
        (" ".join(f"w{k}*#" for k in range(30)), "symbols_per_word"),
        (" ".join(f"WORD{k}!!" for k in range(30)), "marks_per_word"),
        (" ".join(chr(97 + k % 26) for k in range(12)) + " q", "mean_word_chars"),
        (" ".join(f"blah{k}x" for k in range(60)), "stop_word_rate"),
        (" ".join(str(10_000 + k) for k in range(20)), "digit_rate"),
        (SENTENCE, None),
    ],
)
def test_rules_name_what_they_reject(spark, docs, text, rule):
    r = Q.quality_report(docs([text])).first()
    assert r.failed_rule == rule and r.kept == (rule is None)


def test_rejected_rows_go_and_columns_stay(spark, docs, odd):
    df = docs([*odd, SENTENCE]).selectExpr("*", "1 as row", "2 as words", "3 as s", "4 as kept", "5 as v")
    out = Q.rejected_removed(df)
    assert out.columns == df.columns
    want = {r.doc_id for r in Q.quality_report(docs([*odd, SENTENCE])).collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == want and 13 in want
    assert Q.rejected_removed(docs([])).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark, docs):
    plan = Q.quality_report(docs([SENTENCE]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
