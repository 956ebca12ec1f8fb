"""Fixed-point iteration over a node table.

A round is one job: it reads the last round's written table, writes the next, and sends
its convergence numbers back through an Observation on that same write. Totals that the
next round needs (dangling mass, a norm) travel the same way, as literals, so no round
has a cross join or a second action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation

from .cut import cut, drop


@dataclass
class Result:
    scores: DataFrame
    iterations: int
    converged: bool


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write `df`; return the table and the metrics taken on the way."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
    return out, seen.get


def run(start: DataFrame, first: dict[str, Column], step: Callable[[DataFrame, dict], tuple[DataFrame, dict[str, Column]]], done: Callable[[dict], bool], limit: int) -> tuple[DataFrame, dict, int, bool]:
    """Apply `step` until `done(metrics)` or `limit` rounds.

    step(table, metrics) gives the next table's plan and the metrics to take from it.
    """
    state, metrics = observed(start, **first)
    for i in range(1, limit + 1):
        plan, wanted = step(state, metrics)
        new, metrics = observed(plan, **wanted)
        drop(state)
        state = new
        if done(metrics):
            return state, metrics, i, True
    return state, metrics, limit, False
