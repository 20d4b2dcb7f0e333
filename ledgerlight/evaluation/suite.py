"""Golden cases with their confusion matrix, invariants of every answer, and what must happen when a column goes."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from ledgerlight.operators.profile import quoted
from ledgerlight.plans.binder import bind
from ledgerlight.plans.build import build
from ledgerlight.plans.execute import Answer, ask
from ledgerlight.plans.model import Claim, Model
from ledgerlight.plans.query import Query
from ledgerlight.plans.verdict import Verdict

ANSWERED = ("answer", "answer_with_caveats")


@dataclass
class Case:
    name: str
    query: dict
    kind: str
    rows: list[dict] | None = None


@dataclass
class Report:
    matrix: Counter = field(default_factory=Counter)
    wrong: list[str] = field(default_factory=list)
    false_answers: int = 0
    false_refusals: int = 0

    @property
    def false_answer_rate(self) -> float:
        """Share of the cases that must not be answered, but were."""
        n = sum(k for (e, _), k in self.matrix.items() if e not in ANSWERED)
        return self.false_answers / n if n else 0.0


def incoherent(answer: Answer) -> list[str]:
    """What doesn't fit together in an answer."""
    out = []
    if any(set(r) != set(answer.columns) for r in answer.rows):
        out.append("rows and columns differ")
    if (answer.kind == "answer_with_caveats") != bool(answer.caveats):
        out.append("the kind doesn't match the caveats")
    if "share" in answer.columns and any(r["share"] is not None and not -1e-9 <= abs(r["share"]) for r in answer.rows):
        out.append("a share isn't a number")
    if any(w not in answer.explanation for w in answer.filters):
        out.append("a filter isn't told")
    if any("period" in c.kind and "claims" in c.text for c in answer.caveats):
        out.append("a period is claimed that isn't applied")
    return out


def run(df: DataFrame, model: Model, cases: Iterable[Case]) -> Report:
    report = Report()
    for case in cases:
        out = ask(df, model, Query.of(case.query))
        report.matrix[case.kind, out.kind] += 1
        if out.kind != case.kind:
            report.wrong.append(f"{case.name}: {out.kind} for {case.kind}")
            report.false_answers += out.kind in ANSWERED and case.kind not in ANSWERED
            report.false_refusals += out.kind not in ANSWERED and case.kind in ANSWERED
        elif isinstance(out, Answer):
            report.wrong += [f"{case.name}: {x}" for x in incoherent(out)]
            if case.rows is not None and out.rows != case.rows:
                report.wrong.append(f"{case.name}: other rows")
    return report


def ablation(df: DataFrame, claims: list[Claim], query: dict) -> dict[str, str]:
    """The verdict on a query when each claimed column is missing in turn; one that the query needs must not be answered."""
    out = {}
    for c in claims:
        rest = df.drop(quoted(c.column))
        out[c.column] = bind(build(rest, "ablated", [x for x in claims if x.column != c.column]), Query.of(query)).kind
    return out


def stripped(df: DataFrame) -> DataFrame:
    """The table with names that tell nothing."""
    return df.toDF(*[f"col_{k}" for k in range(len(df.columns))])


def same_roles(df: DataFrame) -> bool:
    """Whether the heuristic finds the same roles when the names are gone."""
    a, b = build(df), build(stripped(df))
    place = {c: f"col_{k}" for k, c in enumerate(df.columns)}
    return {(place[x.column], x.role, x.status) for x in a.bindings} == {(x.column, x.role, x.status) for x in b.bindings}


def named_literals(folder: str, names: Iterable[str]) -> list[str]:
    """Places in code where a string is the name of a test column: the engine must not know any."""
    wanted, out = {n.lower() for n in names}, []
    for path in sorted(Path(folder).rglob("*.py")):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.lower() in wanted:
                out.append(f"{path.name}:{node.lineno}: {node.value}")
    return out


__all__ = ["Case", "Report", "Verdict", "ablation", "incoherent", "named_literals", "run", "same_roles", "stripped"]
