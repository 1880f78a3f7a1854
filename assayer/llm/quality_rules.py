"""Quality rules: a threshold table compiled into one projection.

Every rule is a ratio or count of a text and the range it has to lie in. The
table becomes one set of Spark expressions over the row: no Python, no shuffle,
no state between rows.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r.
Repeated five-word windows are found by 64-bit hashes of the windows within one
text; those whose hashes repeat are then compared word for word, so that the count
is exact.

Defined results: a null text has no words; texts without words fail the base rule;
rates over no words or no lines are 0; a value at a threshold keeps the text; very
long texts are judged whole; repeated rows stay; an empty table gives an empty
result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import let

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Frequent function words of the languages the rules know.
STOP_WORDS = (
    # English
    "the of and to in is was for that it with as on be are at by this from or an have not but "
    # German
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    # French
    "le la les des et en un une du est que qui dans pour pas sur au ne se il ce "
    # Spanish
    "el los las de que y a por con una su para es al lo como más o pero"
).split()


@dataclass(frozen=True)
class Rule:
    """A statistic that has to lie in [low, high], for texts of at least `min_words` words."""

    stat: str
    low: float | None = None
    high: float | None = None
    min_words: int = 10


#: The production thresholds, one row for each rule.
RULES = (
    Rule("mean_word_chars", 2.5, 14.0),
    Rule("symbols_per_word", high=0.25),
    Rule("marks_per_word", high=0.9),
    Rule("dup_line_rate", high=0.4),
    Rule("stop_word_rate", low=0.04, min_words=40),
    Rule("digit_rate", high=0.5),
)

_BLANK = r"[\x20\x09-\x0D]"
_MARKS = r"[!?*#&$%|~^=+{}\[\]]"


def statistics(text: Column, words: Column) -> Column:
    """The statistics as one struct, given a text and its words (an array).

    Whole texts are scanned by patterns that seldom match; what counts words
    walks the array.
    """
    n = F.size(words)
    chars = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    stops = F.size(F.filter(words, lambda w: bare(w).isin(STOP_WORDS)))
    lines = let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup")))
    counts = {"n": n, "chars": chars, "symbols": count(f"[{SYMBOLS}]"), "marks": count(_MARKS), "digits": count("[0-9]"), "stops": stops, "lines": lines, "repeat": repeated_words(words)}
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def named(c: Column) -> Column:
        out = {
            "n_words": c["n"].cast("long"),
            "word_chars": c["chars"].cast("long"),
            "n_symbols": c["symbols"].cast("long"),
            "n_dup_lines": c["lines"]["dup"].cast("long"),
            "n_repeat_words": c["repeat"].cast("long"),
            "mean_word_chars": rate(c["chars"], c["n"]),
            "symbols_per_word": rate(c["symbols"], c["n"]),
            "marks_per_word": rate(c["marks"], c["n"]),
            "dup_line_rate": rate(c["lines"]["dup"], c["lines"]["n"]),
            "stop_word_rate": rate(c["stops"], c["n"]),
            "digit_rate": rate(c["digits"], c["chars"]),
        }
        return F.struct(*[x.alias(k) for k, x in out.items()])

    return let(F.struct(*[c.alias(k) for k, c in counts.items()]), named)


def repeated_words(words: Column, size: int = 5) -> Column:
    """How many words lie in a window of `size` words that the text has twice or more."""

    def covered(starts: Column) -> Column:
        # starts of repeated windows in order: each adds what the next doesn't take
        total = F.aggregate(starts, F.struct(F.lit(0).alias("sum"), F.lit(-size).alias("last")), lambda s, i: F.struct((s["sum"] + F.least(F.lit(size), i - s["last"])).alias("sum"), i.alias("last")))
        return total["sum"]

    def starts(by: Column) -> Column:
        # of (h, i) in order of h: the places i whose h is there twice or more
        same = lambda k, j: F.get(by, k)["h"] == F.get(by, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(by) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda k: F.get(by, k)["i"]))

    def repeats(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # words hold no blanks, so that a window is its words joined by them
        spelt = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, size), " ").alias("h"), i.alias("i"))))
        exact = let(let(by_hash, starts), lambda at: F.when(F.size(at) > 0, let(spelt(at), starts)).otherwise(at))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(exact, covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(windows, repeats))


def judged(s: Column, rules: Sequence[Rule]) -> Column:
    """The base statistics with base_failed, failed_rule (the first that a text breaks) and kept."""
    n = s["n_words"]
    base = (n < 10) | (100 * s["n_repeat_words"] > 20 * n)
    broken = F.lit(None).cast("string")
    for r in reversed(rules):
        out_of_range = F.lit(False)
        if r.low is not None:
            out_of_range |= s[r.stat] < r.low
        if r.high is not None:
            out_of_range |= s[r.stat] > r.high
        broken = F.when((n >= r.min_words) & out_of_range, F.lit(r.stat)).otherwise(broken)
    kept = F.struct(base.alias("base_failed"), broken.alias("failed_rule"))
    return let(kept, lambda v: F.struct(*[s[c].alias(c) for c in BASE], v["base_failed"].alias("base_failed"), v["failed_rule"].alias("failed_rule"), (~v["base_failed"] & v["failed_rule"].isNull()).alias("kept")))


def verdict(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The whole rule table as one expression over a text: a struct of BASE, base_failed, failed_rule and kept.

    Words and statistics are lambda variables in it, so a filter on the verdict
    doesn't compute them twice.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return let(text, lambda t: let(F.array_remove(F.split(t, _BLANK + "+"), ""), lambda w: let(statistics(t, w), lambda s: judged(s, rules))))


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The statistics and verdict of every row of `docs` (doc_id, text)."""
    return docs.select("doc_id", verdict(F.col("text"), rules).alias("v")).select("doc_id", "v.*")


def rejected_removed(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    return docs.where(verdict(F.col("text"), rules)["kept"])


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for `quality_report` over `documents` with unique doc_ids."""
    broken = "CASE "
    for r in rules:
        bounds = [f"{r.stat} < {r.low}"] * (r.low is not None) + [f"{r.stat} > {r.high}"] * (r.high is not None)
        broken += f"WHEN n_words >= {r.min_words} AND ({' OR '.join(bounds)}) THEN '{r.stat}' "
    broken += "END"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '[!?*#&$%|~^=+{{}}\[\]]')) AS marks, len(regexp_extract_all(text, '[0-9]')) AS digits, len(lines) AS n_lines,
  len(list_filter(words, lambda w: lower(rtrim(w, '.,;:!?')) IN ({stops}))) AS stops FROM d LEFT JOIN repeated r USING (doc_id)),
s AS (SELECT *, {rate("word_chars", "n_words")} AS mean_word_chars, {rate("n_symbols", "n_words")} AS symbols_per_word, {rate("marks", "n_words")} AS marks_per_word,
  {rate("n_dup_lines", "n_lines")} AS dup_line_rate, {rate("stops", "n_words")} AS stop_word_rate, {rate("digits", "word_chars")} AS digit_rate FROM c),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {broken} AS failed_rule FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule, NOT base_failed AND failed_rule IS NULL AS kept FROM v
"""
