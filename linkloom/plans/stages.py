"""Stages with named tables as inputs and outputs, and their runner."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from linkloom.operators.materialize import saved


@dataclass(frozen=True)
class Stage:
    """run takes the required tables by name and returns the produced ones by name."""

    name: str
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    run: Callable[..., dict[str, DataFrame]]
    #: Whether its tables are written and reread, so that later stages don't repeat its work.
    keep: bool = False


def check(stages: Sequence[Stage], given: Sequence[str]) -> None:
    """Raises if a stage needs a table that neither is given nor made by an earlier stage."""
    known = set(given)
    for stage in stages:
        if missing := [t for t in stage.requires if t not in known]:
            raise KeyError(f"stage {stage.name} needs {', '.join(missing)}")
        known |= set(stage.produces)


def run_stages(stages: Sequence[Stage], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the last stage. Nothing runs but what ``keep`` asks for: the rest is one plan."""
    check(stages, list(tables))
    tables = dict(tables)
    for stage in stages:
        made = stage.run(**{t: tables[t] for t in stage.requires})
        if set(made) != set(stage.produces):
            raise ValueError(f"stage {stage.name} made {sorted(made)} instead of {sorted(stage.produces)}")
        tables |= {k: saved(v) if stage.keep else v for k, v in made.items()}
    return tables
