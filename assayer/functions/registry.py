"""Scoring functions: what an objective can refer to by name.

A function declares its prefix and the metrics it returns, so an objective is
checked before anything runs. Kinds, from the fastest: `columns` (expressions),
`arrow` (a batch of rows in, a batch out), `http` (one POST for each batch) and
`command` (one process for each batch, with a time limit). Functions whose library
is missing are left out when the registry is filled, and the reason is kept.
"""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.transforms import ObjectiveError


@dataclass(frozen=True)
class ScoringFunction:
    """name: how objectives call it. metrics: what it returns, in order. kind: columns or arrow.

    build: for columns, (parameters) -> {metric: Column}; for arrow, (parameters) ->
    function from a list of strings to a list of {metric: number}.
    default: the value of every metric for a row that has none.
    """

    name: str
    metrics: tuple[str, ...]
    build: Callable
    kind: str = "columns"
    default: float = 0.0
    parameters: dict = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.functions: dict[str, ScoringFunction] = {}
        self.missing: dict[str, str] = {}

    def register(self, f: ScoringFunction) -> ScoringFunction:
        self.functions[f.name] = f
        return f

    def optional(self, name: str, make: Callable[[], ScoringFunction]) -> None:
        """Register what `make` returns, unless a library that it imports is missing."""
        try:
            self.register(make())
        except ImportError as e:
            self.missing[name] = str(e)

    def get(self, name: str) -> ScoringFunction:
        if name in self.functions:
            return self.functions[name]
        why = f" ({self.missing[name]})" if name in self.missing else ""
        raise ObjectiveError(f"unknown scoring function {name!r}{why}")


REGISTRY = Registry()


def apply(df: DataFrame, f: ScoringFunction, prefix: str, column: str = "smiles", **parameters) -> DataFrame:
    """`df` with a column <prefix>_<metric> for every metric of `f` over `column`.

    Expressions become one projection. Arrow functions run once for each distinct
    string, in batches, and are joined back; place filters before them.
    """
    names = [f"{prefix}_{m}" for m in f.metrics]
    if f.kind == "columns":
        made = f.build(F.col(column), **parameters)
        return df.withColumns({n: F.coalesce(made[m].cast("double"), F.lit(f.default)) for n, m in zip(names, f.metrics)})
    call, metrics, default = f.build(**parameters), f.metrics, f.default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = call(b.column(0).to_pylist()) if b.num_rows else []
            if len(out) != b.num_rows:
                raise ValueError("a scoring function returns as many results as it gets rows, in their order")
            cols = [pa.array([float(default if (v := r.get(m)) is None else v) for r in out], pa.float64()) for m in metrics]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["_key", *names])

    keys = df.select(F.col(column).alias("_key")).where("_key is not null").distinct()
    scored = keys.mapInArrow(run, "_key string, " + ", ".join(f"`{n}` double" for n in names))
    return df.join(scored, df[column] == scored["_key"], "left").drop("_key").fillna(f.default, names)


def http_function(name: str, url: str, metrics: Sequence[str], timeout: float = 60.0, default: float = 0.0) -> ScoringFunction:
    """One POST of {"smiles": [...]} for each batch; the answer is a list of objects. An error gives defaults."""

    def build(**extra):
        def call(strings: list[str]) -> list[dict]:
            body = json.dumps({"smiles": strings, **extra}).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                    return json.loads(r.read())
            except OSError:
                return [{} for _ in strings]

        return call

    return ScoringFunction(name, tuple(metrics), build, "arrow", default)


def command_function(name: str, argv: Sequence[str], metrics: Sequence[str], timeout: float = 120.0, default: float = 0.0) -> ScoringFunction:
    """One process for each batch: a string a line in, a JSON object a line out. A failure or time-out gives defaults."""

    def build(**_):
        def call(strings: list[str]) -> list[dict]:
            try:
                done = subprocess.run(list(argv), input="\n".join(s.replace("\n", " ") for s in strings), capture_output=True, text=True, timeout=timeout, check=True)
                out = [json.loads(x) for x in done.stdout.splitlines()]
            except (OSError, subprocess.SubprocessError, ValueError):
                out = []
            return out if len(out) == len(strings) else [{} for _ in strings]

        return call

    return ScoringFunction(name, tuple(metrics), build, "arrow", default)


def expand(df: DataFrame, key: str, make: Callable[[str], Sequence[dict]], fields: dict[str, str]) -> DataFrame:
    """One to many: a row (key, variant, fields) for each variant that `make` gives for a distinct string.

    A string that fails has no variants. `fields` maps names to Spark types.
    """
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(0).to_pylist():
                try:
                    rows += [(s, k, *[v.get(f) for f in fields]) for k, v in enumerate(make(s))]
                except Exception:  # noqa: BLE001, S112 - a tool's failure is the candidate's, not the run's
                    continue
            cols = list(zip(*rows)) if rows else [()] * (2 + len(fields))
            types = [pa.string(), pa.int32(), *[kinds[t] for t in fields.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "variant", *fields])

    keys = df.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    return keys.mapInArrow(run, f"`{key}` string, variant int, " + ", ".join(f"`{f}` {t}" for f, t in fields.items()))


def best_variant(df: DataFrame, by: Sequence[str], score: str, order: str, default: float = 0.0) -> DataFrame:
    """Of each key's variants the one with the lowest score, with all its columns; ties go by `order`."""
    low = F.min_by(F.struct("*"), F.struct(F.coalesce(F.col(score), F.lit(float("inf"))), F.col(order))).alias("_best")
    rest = [c for c in df.columns if c not in by]
    out = df.groupBy(*by).agg(low)
    return out.select(*by, *[F.coalesce(F.col(f"_best.{c}"), F.lit(default)).alias(c) if c == score else F.col(f"_best.{c}").alias(c) for c in rest])


def _text_descriptors() -> ScoringFunction:
    from assayer.functions.text import descriptors

    names = ("length", "words", "distinct_words", "letter_share", "digit_share", "upper_share")
    return ScoringFunction("TextDescriptors", names, lambda x: descriptors(x))


def _levenshtein() -> ScoringFunction:
    from assayer.functions.similarity import levenshtein_similarity, to_references

    def build(x: Column, references: Sequence[str] = (), method: str = "max") -> dict[str, Column]:
        return {"Sim": to_references(x, list(references), levenshtein_similarity, method)[0]}

    return ScoringFunction("LevenshteinSimilarity", ("Sim",), build)


def _patterns() -> ScoringFunction:
    from assayer.functions.text import pattern_filter

    return ScoringFunction("PatternFilters", ("pass",), lambda x, patterns=(): {"pass": pattern_filter(x, patterns)[0]}, default=1.0)


def _isomer() -> ScoringFunction:
    from assayer.functions.similarity import isomer_score

    return ScoringFunction("Isomer", ("score",), lambda x, target=None: {"score": isomer_score(x, target)})


for _name, _make in {
    "TextDescriptors": _text_descriptors,
    "LevenshteinSimilarity": _levenshtein,
    "PatternFilters": _patterns,
    "Isomer": _isomer,
}.items():
    REGISTRY.optional(_name, _make)

from assayer.functions import chemistry  # noqa: E402

for _name, _make in chemistry.FUNCTIONS.items():
    REGISTRY.optional(_name, _make)
