"""From a question in words to a typed query, by a provider. What it gives back is plain data that the binder checks like any other."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

from ledgerlight.plans.model import Model
from ledgerlight.plans.query import CATEGORICAL, COMPARISONS, FREQUENCY_OPS, FUNCTIONS, GRAINS, NUMERIC_OPS, Query, merge


def context(model: Model) -> dict[str, Any]:
    """What a provider is told about a data set: measures with their columns, what can be grouped by, values, grains."""
    kinds = {role: model.in_role(role) for role in ("dimension", "flag", "entity_key", "description")}
    return {
        "measures": [{"name": m.name, "formula": m.formula, "columns": m.columns} for m in model.measures if m.available],
        "dimensions": kinds["dimension"], "flags": kinds["flag"], "descriptions": kinds["description"],
        "entities": {c: model.binding(c).entity for c in kinds["entity_key"]},
        "values": {c: v.values for c, v in model.values.items() if v.exhaustive and c in kinds["dimension"]},
        "numeric": model.numeric(), "time": model.first("event_time"), "grains": list(GRAINS) if model.first("event_time") else [],
    }


def vocabulary() -> dict[str, Any]:
    """Fields of a query and the words that they may use."""
    return {"fields": [f.name for f in dataclasses.fields(Query)], "filters": CATEGORICAL, "numeric_filters": NUMERIC_OPS, "frequency": FREQUENCY_OPS, "aggregations": FUNCTIONS, "period_comparison": COMPARISONS, "grains": GRAINS}


def interpret(question: str, model: Model, provider: Callable[[dict], Any], before: Query | None = None) -> Query:
    """The query that a question asks for; of a follow-up only what changes is asked for and laid over the query before.

    Fields that aren't in the vocabulary are errors (ValueError), never dropped in silence.
    """
    request = {"task": "query" if before is None else "follow_up", "question": question, "data": context(model), "vocabulary": {k: list(v) for k, v in vocabulary().items()}}
    raw = provider(request if before is None else request | {"before": before.to_dict()})
    try:
        return Query.of(raw) if before is None else merge(before, raw)
    except (TypeError, KeyError) as e:
        raise ValueError(f"the provider's answer is no query: {e}") from e
