"""The plug-in surface: discovery of queries, nodes of a pipeline, registries of rules."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from corpusmill.plans.registry import Query

RULES: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}


def discover(disabled: str = "") -> dict[str, Query]:
    """Every registered query but those that a comma-separated list of globs names."""
    from corpusmill.plans.catalog import QUERIES

    globs = [g.strip() for g in disabled.split(",") if g.strip()]
    return {n: q for n, q in QUERIES.items() if not any(fnmatch.fnmatchcase(n, g) for g in globs)}


def node(run: Callable[..., DataFrame], args: Mapping[str, str] | None = None, returns: Mapping[str, str] | None = None) -> Callable[[Mapping[str, DataFrame]], dict[str, DataFrame]]:
    """A step that takes named tables by `args` (parameter: table) and gives its result the names of `returns` (name: `result`)."""

    def step(state: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        out = run(**{p: state[t] for p, t in (args or {}).items()})
        return {n: out for n in (returns or {"result": "result"})}

    return step


def rule(category: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function from facts to findings under a category."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        RULES.setdefault(category, []).append(f)
        return f

    return add


def run_rules(facts: DataFrame, categories: list[str] | None = None) -> DataFrame | None:
    """Findings of all rules of the categories, put together by name."""
    out = None
    for c in categories or sorted(RULES):
        for f in RULES.get(c, []):
            found = f(facts)
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out
