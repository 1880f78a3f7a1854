"""Objectives: JSON in, checked dataclasses out."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from assayer.functions.aggregators import BATCH, ROW
from assayer.functions.transforms import TRANSFORMS, ObjectiveError

#: Batch method beside the weighted ones.
PARETO = "pareto_front"
FILTERS = ("Unique", "Occurrence", "Scaffold", "CompoundSimilarity")


@dataclass(frozen=True)
class FunctionSpec:
    name: str
    run: bool = True
    parameters: Mapping = field(default_factory=dict)

    @property
    def prefix(self) -> str:
        return str(self.parameters.get("prefix", self.name)).replace(" ", "_")


@dataclass(frozen=True)
class MetricSpec:
    name: str
    weight: float = 1.0
    modifier: str = "raw"
    filter: bool = False
    parameters: Mapping = field(default_factory=dict)

    @property
    def column(self) -> str:
        return f"{self.modifier}_{self.name}"


@dataclass(frozen=True)
class DiversitySpec:
    run: bool = False
    name: str | None = None
    parameters: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Objective:
    task: str
    method: str
    metrics: tuple[MetricSpec, ...]
    functions: tuple[FunctionSpec, ...] = ()
    diversity: DiversitySpec = DiversitySpec()
    output_dir: str | None = None
    load_from_previous: bool = False
    logging: bool = True
    starting_population: str | None = None
    budget: int | None = None
    oracle_budget: bool = False
    termination_threshold: float | None = None
    termination_patience: int | None = None
    termination_early_stop: bool = False

    @property
    def task_key(self) -> str:
        return self.task.replace(" ", "_")

    @property
    def scored(self) -> tuple[MetricSpec, ...]:
        return tuple(m for m in self.metrics if not m.filter)

    @property
    def filters(self) -> tuple[MetricSpec, ...]:
        return tuple(m for m in self.metrics if m.filter)


def parse(text: str, diversity: str | Mapping | None = None) -> Objective:
    """An objective from JSON text, in which line breaks and tabs don't matter.

    diversity: another diversity filter, by name or whole, in place of its own.
    """
    raw = json.loads(re.sub(r"[\r\n\t]", "", text))
    scoring = raw.get("scoring") or {}
    method = scoring.get("method", "single")
    if method not in ROW and method not in BATCH and method != PARETO:
        raise ObjectiveError(f"unknown aggregation {method!r}")
    metrics = tuple(
        MetricSpec(m["name"].replace(" ", "_"), float(m.get("weight", 1.0)), m.get("modifier", "raw"), bool(m.get("filter", False)), dict(m.get("parameters") or {})) for m in scoring.get("metrics", ())
    )
    for m in metrics:
        if m.modifier not in TRANSFORMS:
            raise ObjectiveError(f"{m.name}: unknown transform {m.modifier!r}")
    if method == "single" and sum(not m.filter for m in metrics) > 1:
        raise ObjectiveError("single takes exactly one metric")
    own = raw.get("diversity_filter") or {}
    if diversity is not None:
        own = {"run": True, "name": diversity, "parameters": {}} if isinstance(diversity, str) else dict(diversity)
    spec = DiversitySpec(bool(own.get("run")), own.get("name"), dict(own.get("parameters") or {}))
    extra = {k: raw[k] for k in ("output_dir", "load_from_previous", "logging", "budget", "oracle_budget", "termination_threshold", "termination_patience", "termination_early_stop") if raw.get(k) is not None}
    population = raw.get("starting_population")
    functions = tuple(FunctionSpec(f["name"], bool(f.get("run", True)), dict(f.get("parameters") or {})) for f in raw.get("scoring_functions", ()))
    return Objective(raw["task"], method, metrics, functions, spec, starting_population=resource(population) if population else None, **extra)


def resource(where: str | Sequence[str]) -> str:
    """A path, or the place of [package, file]."""
    if isinstance(where, str):
        return where
    from importlib.resources import files

    package, *rest = where
    return str(files(package).joinpath(*rest))


def load(where: str, presets: Mapping[str, str] | None = None, diversity=None) -> Objective:
    """From a .json path, or `category:task` among preset folders."""
    if where.endswith(".json"):
        return parse(Path(where).read_text(encoding="utf-8"), diversity)
    category, _, task = where.partition(":")
    if not task or category not in (presets or {}):
        raise ObjectiveError(f"{where!r} is neither a .json path nor a preset")
    for p in sorted(Path(presets[category]).glob("*.json")):
        if p.stem == task or parse(p.read_text(encoding="utf-8")).task == task:
            return parse(p.read_text(encoding="utf-8"), diversity)
    raise ObjectiveError(f"no task {task!r} in {category!r}")


def select(folder: str | None = None, tasks: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Paths of a benchmark's objectives: a folder's, or a list, by file stem; an error if none is left."""
    paths = list(tasks) or sorted(map(str, Path(folder).glob("*.json")))
    stem = lambda p: Path(p).stem
    kept = [p for p in paths if (not include or stem(p) in include) and stem(p) not in exclude]
    if not kept:
        raise ObjectiveError("no task is left to run")
    return kept


def numbered(paths: Sequence[str]) -> list[str]:
    """A curriculum's objectives in the order of the numbers that their names begin with."""
    return sorted(paths, key=lambda p: (int(re.match(r"\d*", Path(p).stem)[0] or 0), Path(p).stem))
