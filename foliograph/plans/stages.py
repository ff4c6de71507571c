"""The analysis stages as a graph: order, time limits, consent, and a runner over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    depends_on: tuple[str, ...] = ()
    timeout_s: int = 120
    fatal: bool = False
    requires_consent: str | None = None


# Stages, what they need, and their limits.
PIPELINE = (
    Stage("parse", (), 120, True),
    Stage("enrich", ("parse",), 60, True),
    Stage("format", ("enrich",), 30),
    Stage("grammar", ("enrich",), 300),
    Stage("aigt", ("enrich",), 180),
    Stage("citations", ("enrich",), 300, False, "external_metadata"),
    Stage("embed", ("enrich",), 120),
    Stage("similarity", ("embed",), 600, False, "external_web"),
    Stage("aggregate", ("format", "grammar", "aigt", "citations", "similarity"), 10, True),
    Stage("report", ("aggregate",), 30),
)


def depths(stages: tuple[Stage, ...] = PIPELINE) -> dict[str, int]:
    """The longest way to each stage; ValueError for a cycle or a missing stage."""
    by_name, out = {s.name: s for s in stages}, {}

    def depth(name: str, path: tuple[str, ...]) -> int:
        if name in path or name not in by_name:
            raise ValueError(f"cycle or missing dependency at {name}")
        if name not in out:
            out[name] = 1 + max((depth(n, (*path, name)) for n in by_name[name].depends_on), default=-1)
        return out[name]

    for s in stages:
        depth(s.name, ())
    return out


def groups(stages: tuple[Stage, ...] = PIPELINE) -> list[list[str]]:
    """Stages that can run together, in order; names sorted within a group."""
    d = depths(stages)
    return [sorted(n for n in d if d[n] == k) for k in range(max(d.values(), default=-1) + 1)]


def groups_table(spark: SparkSession, stages: tuple[Stage, ...] = PIPELINE) -> DataFrame:
    d = depths(stages)
    rows = [(s.name, d[s.name], s.timeout_s, s.fatal, s.requires_consent) for s in stages]
    return spark.createDataFrame(rows, "name string, depth int, timeout_s int, fatal boolean, requires_consent string")


def run(work: dict[str, Callable[[dict], object]], consents: set[str] = frozenset(), stages: tuple[Stage, ...] = PIPELINE) -> tuple[dict, list[tuple[str, str, str]]]:
    """Run the stages that have work; (results, [(stage, status, detail)]).

    A stage without consent or work is skipped; a failed one stops the run only if it is fatal. Whatever
    ended in any way counts as done for the stages that need it.
    """
    by_name, results, log = {s.name: s for s in stages}, {}, []
    for group in groups(stages):
        for name in group:
            s = by_name[name]
            if s.requires_consent and s.requires_consent not in consents:
                log.append((name, "skipped", f"no consent: {s.requires_consent}"))
            elif name not in work:
                log.append((name, "skipped", "nothing to do"))
            else:
                try:
                    results[name] = work[name](results)
                    log.append((name, "done", ""))
                except Exception as e:
                    log.append((name, "failed", type(e).__name__))
                    if s.fatal:
                        return results, log
    return results, log
