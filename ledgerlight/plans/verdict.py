"""Outcomes of binding a query."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerlight.plans.query import Query


@dataclass
class Caveat:
    kind: str
    text: str
    assumption: bool = False


@dataclass
class BoundPlan:
    """A query that passed every check, with what was added to it: the only thing that gets executed."""

    query: Query
    group_by: list[str]
    time_grain: str | None
    partition_values: list[str] | None = None
    complete_only: bool = False
    revenue_column: str | None = None


@dataclass
class Verdict:
    """kind: answer, answer_with_caveats, clarify or refuse."""

    kind: str
    plan: BoundPlan | None = None
    reason: str = ""
    options: list[str] = field(default_factory=list)
    caveats: list[Caveat] = field(default_factory=list)
