"""Pipelines of steps with dependencies: validation, order and the built-in ones."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Queue priorities, and the steps of the built-in pipelines in order.
PRIORITIES = {"background": 1000, "normal": 2000, "user": 5000, "critical": 10000}
INDEX_STEPS = ("scan", "chunks", "bm25", "code_embeddings", "page_images", "page_embeddings")
FULL_STEPS = (*INDEX_STEPS, "summary_embeddings", "api_docs", "architecture", "commit_description", "schema", "cookbook", "wiki")
AFTER = {"chunks": ("scan",), "bm25": ("chunks",), "code_embeddings": ("bm25",), "page_images": ("chunks",), "page_embeddings": ("page_images",), "summary_embeddings": ("code_embeddings",), "api_docs": ("summary_embeddings",), "architecture": ("api_docs",), "commit_description": ("architecture",), "schema": ("commit_description",), "cookbook": ("schema",), "wiki": ("cookbook",)}


@dataclass(frozen=True)
class Step:
    name: str
    kind: str
    depends_on: tuple[str, ...] = ()
    join_type: str = "all"


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...] = field(default=())


def topological(names: Iterable[str], after: Mapping[str, Iterable[str]]) -> list[str]:
    """An order in which every step follows what it needs; ties by the order given. A cycle is an error."""
    waiting, done, out = list(dict.fromkeys(names)), set(), []
    while waiting:
        ready = [n for n in waiting if set(after.get(n, ())) <= done]
        if not ready:
            raise ValueError(f"cycle among {sorted(waiting)}")
        out += ready
        done |= set(ready)
        waiting = [n for n in waiting if n not in done]
    return out


def depths(steps: DataFrame, needs: DataFrame, pipeline: str, step: str = "step", after: str = "after", most: int = 1000) -> DataFrame:
    """(pipeline, step, depth) of the steps of many pipelines: 0 without a known need, else one more than the deepest need.

    ``needs`` holds pipeline, step and the step it comes after; needs that name no step do not count.
    Each round moves one step on in all pipelines at once, so there are as many rounds as the longest
    chain has steps; a chain of more than ``most``, as of a cycle, is an error.
    """
    known = needs.join(steps.select(pipeline, F.col(step).alias(after)), [pipeline, after], "left_semi").distinct()
    found = [written(steps.select(pipeline, step).distinct().withColumn("depth", F.lit(0)), "depths")]
    while True:
        last = found[-1].select(pipeline, F.col(step).alias(after), "depth")
        moved = written(known.join(last, [pipeline, after]).groupBy(pipeline, step).agg((F.max("depth") + 1).alias("depth")), "depths")
        if moved.isEmpty():
            break
        if len(found) > most:
            raise ValueError("cycle")
        found.append(moved)
    return reduce(DataFrame.unionByName, found).groupBy(pipeline, step).agg(F.max("depth").alias("depth"))


def validate(pipeline: Pipeline) -> None:
    """Names once each, known dependencies, join types any or all, no cycle."""
    names = [s.name for s in pipeline.steps]
    if not pipeline.name:
        raise ValueError("a pipeline needs a name")
    if repeated := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"repeated steps {sorted(repeated)}")
    for step in pipeline.steps:
        if step.join_type not in ("all", "any"):
            raise ValueError(f"{step.name}: join type {step.join_type!r}")
        if unknown := set(step.depends_on) - set(names):
            raise ValueError(f"{step.name} depends on unknown {sorted(unknown)}")
    topological(names, {s.name: s.depends_on for s in pipeline.steps})


def operations(pipeline: Pipeline) -> list[str]:
    validate(pipeline)
    kinds = {s.name: s.kind for s in pipeline.steps}
    return [kinds[n] for n in topological(kinds, {s.name: s.depends_on for s in pipeline.steps})]


def built_in(name: str, steps: tuple[str, ...]) -> Pipeline:
    return Pipeline(name, tuple(Step(s, f"commit.{s}", tuple(d for d in AFTER.get(s, ()) if d in steps)) for s in steps))


class PipelineBook:
    """Named pipelines; built-in ones are put back to their steps at start."""

    def __init__(self, known: Iterable[Pipeline] = ()) -> None:
        self.pipelines = {p.name: p for p in known}

    def initialise(self) -> None:
        for pipeline in (built_in("default", INDEX_STEPS), built_in("full", FULL_STEPS)):
            self.pipelines[pipeline.name] = pipeline

    def create(self, pipeline: Pipeline) -> Pipeline:
        if pipeline.name in self.pipelines:
            raise ValueError(f"pipeline {pipeline.name!r} exists")
        validate(pipeline)
        return self.pipelines.setdefault(pipeline.name, pipeline)

    def update(self, pipeline: Pipeline) -> Pipeline:
        if pipeline.name not in self.pipelines:
            raise KeyError(pipeline.name)
        validate(pipeline)
        self.pipelines[pipeline.name] = pipeline
        return pipeline

    def delete(self, name: str) -> set[str]:
        """Drop a pipeline; returns the steps that no other one has."""
        gone = {s.name for s in self.pipelines.pop(name).steps}
        return gone - {s.name for p in self.pipelines.values() for s in p.steps}


def choose_commit(branches: Mapping[str, str], commits: Iterable[str], tracking: tuple[str, str] | None, default: str | None) -> str | None:
    """What a sync scans: the tracked branch's head, the tracked commit, the default branch's head, any head."""
    kind, name = tracking or ("", "")
    if kind == "branch" and name in branches:
        return branches[name]
    if kind == "commit" and name in set(commits):
        return name
    if default in branches:
        return branches[default]
    return next(iter(branches.values()), None)


def default_branch(names: Iterable[str], origin_head: str | None = None) -> str | None:
    names = list(names)
    for candidate in (origin_head, "main", "master"):
        if candidate in names:
            return candidate
    return names[0] if names else None
