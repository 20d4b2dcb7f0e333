"""Checks a query against the model, in a fixed order, and gives a plan, a question back, or a refusal."""

from __future__ import annotations

import copy

from ledgerlight.plans.model import Model
from ledgerlight.plans.query import CATEGORICAL, COMPARISONS, FREQUENCY_OPS, FUNCTIONS, GRAINS, NUMERIC_OPS, Query, grain_of
from ledgerlight.plans.verdict import BoundPlan, Caveat, Verdict

REVENUE = ("net_revenue", "gross_revenue")
#: Coverage under which a used column's gaps are told.
COVERAGE = 0.98


def _column(model: Model, name: str | None) -> str | None:
    """The column meant by a column's, a role's or an entity's name."""
    if name is None or name in model.bound():
        return name
    return model.entity(name) or model.first(name) or name


def _refuse(reason: str) -> Verdict:
    return Verdict("refuse", reason=reason)


def _clarify(reason: str, options: list[str]) -> Verdict:
    return Verdict("clarify", reason=reason, options=options)


def bind(model: Model, query: Query) -> Verdict:
    q = copy.deepcopy(query)
    bound, event_time = set(model.bound()), model.first("event_time")
    if "basket_cooccurrence" in q.measures:
        q.basket, q.measures = True, [m for m in q.measures if m != "basket_cooccurrence"]
    q.distinct_count_of = _column(model, q.distinct_count_of)
    if q.frequency:
        q.frequency.entity, q.frequency.count_of = _column(model, q.frequency.entity), _column(model, q.frequency.count_of)

    if q.unmet_concepts:
        return _refuse("The data hold nothing on: " + ", ".join(q.unmet_concepts))
    if q.unmet_dimensions:
        groupable = [b.column for b in model.bindings if b.role in ("dimension", "entity_key", "description")]
        there = [d for d in q.unmet_dimensions if d in bound]
        return _clarify(("These columns can't be grouped by: " if there else "No column stands for: ") + ", ".join(there or q.unmet_dimensions), groupable)
    if not (q.measures or q.aggregations or q.distinct_count_of or q.basket or q.frequency):
        return _refuse("Nothing is asked for that can be computed")
    for a in q.aggregations:
        if a.func not in FUNCTIONS:
            return _refuse(f"{a.func} is no known aggregation")
        if a.func != "count" and a.column is None:
            return _refuse(f"{a.func} needs a column")
        if a.column is not None and a.column not in model.types:
            return _refuse(f"There is no column {a.column}")
        if a.func != "count" and a.column not in model.numeric():
            return _refuse(f"{a.column} isn't numeric")

    amounts = model.in_role("monetary_amount")
    if set(q.measures) & set(REVENUE) and len(amounts) > 1:
        return _clarify("Several columns could be the revenue", amounts)
    for name in q.measures:
        measure = model.measure(name)
        if measure is None:
            return _refuse(f"{name} is no known measure")
        if not measure.available:
            return _refuse(f"{name} can't be computed: it lacks " + ", ".join(measure.missing))
    if q.basket and not (model.first("transaction_key") and model.entity("product")):
        return _refuse("Baskets need a transaction key and a product key")
    for ref in (q.distinct_count_of, *((q.frequency.entity, q.frequency.count_of) if q.frequency else ())):
        if ref is not None and ref not in bound:
            return _refuse(f"{ref} isn't known")
    for column in (*q.group_by, *(f.column for f in q.filters), *(f.column for f in q.numeric_filters)):
        if column not in bound:
            return _refuse(f"{column} isn't known")
    if (q.time or q.period_comparison) and event_time is None:
        return _refuse("The data hold no time")

    wrong = [f.op for f in q.filters if f.op not in CATEGORICAL] + [f.op for f in q.numeric_filters if f.op not in NUMERIC_OPS]
    wrong += [q.frequency.op] if q.frequency and q.frequency.op not in FREQUENCY_OPS else []
    wrong += [q.period_comparison.kind] if q.period_comparison and q.period_comparison.kind not in COMPARISONS else []
    wrong += [g for g in (q.time and q.time.grain, q.period_comparison and q.period_comparison.grain) if g and g not in GRAINS]
    wrong += [q.top_k.direction] if q.top_k and q.top_k.direction not in ("asc", "desc") else []
    if wrong:
        return _refuse("Not in the vocabulary: " + ", ".join(wrong))
    for f in q.numeric_filters:
        if f.op == "between" and f.value2 is None:
            return _refuse("between needs two values")
        if model.types.get(f.column) not in (*("integer", "decimal"), "boolean"):
            return _refuse(f"{f.column} isn't numeric")
    if q.top_k and q.top_k.k < 1:
        return _refuse("k must be at least 1")
    if q.time and q.time.named_period and grain_of(q.time.named_period) is None:
        return _refuse(f"{q.time.named_period} is no period")
    if q.period_comparison and not (q.measures or q.aggregations):
        return _refuse("A comparison of periods needs a measure")
    if q.share_of_total and (q.distinct_count_of or any(a.func in ("avg", "min", "max") for a in q.aggregations) or "order_count" in q.measures):
        return _refuse("Shares need a measure that adds up")

    for f in q.filters:
        known = model.values.get(f.column)
        if known and known.exhaustive:
            fold = {v.casefold(): v for v in known.values}
            missing = [v for v in f.values if v not in known.values and v.casefold() not in fold]
            if missing:
                return _clarify(f"{f.column} holds no " + ", ".join(missing), known.values)
            f.values = [v if v in known.values else fold[v.casefold()] for v in f.values]
    if q.top_k and not (q.basket or q.frequency):
        names = {*q.measures, *(a.name for a in q.aggregations), *(["distinct_count"] if q.distinct_count_of else []), *(["share"] if q.share_of_total else [])}
        if q.top_k.measure not in names:
            return _refuse(f"{q.top_k.measure} isn't computed by this query")
    for note in q.notes:
        if "clarification" in note.lower():
            return _clarify(note, [])

    caveats: list[Caveat] = []
    if (q.time or q.period_comparison) and event_time in model.date_notes:
        caveats.append(Caveat("date_order", model.date_notes[event_time], True))
    if q.time and (q.time.start or q.time.end or q.time.named_period):
        caveats.append(Caveat("window", f"Only rows of {q.time.named_period or f'{q.time.start or "the start"} up to {q.time.end or "the end"}, which is left out,'} count", True))
    revenue = bool(set(q.measures) & set(REVENUE))
    if revenue and len(amounts) == 1 and not (model.first("additive_quantity") and model.first("monetary_rate")):
        checks = (b.checks for b in model.bindings if b.column == amounts[0])
        if not any(c.name == "stored_amount_identity" and c.passed for found in checks for c in found):
            caveats.append(Caveat("as_reported", f"{amounts[0]} is taken as reported: without a quantity and a rate it can't be checked, which isn't the same as a failed check", True))
    if "net_revenue" in q.measures and model.returns.kind != "none":
        caveats.append(Caveat("net_of_returns", "Returned lines are subtracted", True))
    plan = BoundPlan(q, list(q.group_by), None)
    if model.partition and model.partition.fact_value is not None and set(q.group_by) & model.product_columns():
        plan.partition_values = [model.partition.fact_value]
        caveats.append(Caveat("partition", f"Only lines whose {model.partition.column} is {model.partition.fact_value} count", False))
    if q.period_comparison and model.completeness:
        plan.complete_only = True
        caveats.append(Caveat("complete_periods", f"Periods that {model.completeness.flag} marks as incomplete are left out", False))
    used = {*q.group_by, *(f.column for f in q.filters), *(f.column for f in q.numeric_filters), *((q.frequency.entity, q.frequency.count_of) if q.frequency else ()), *([q.distinct_count_of] if q.distinct_count_of else [])}
    for name in q.measures:
        used |= set(model.measure(name).columns)
    for column in sorted(used):
        if (c := model.coverage.get(column, 1.0)) < COVERAGE:
            caveats.append(Caveat("coverage", f"{column} is known on {c:.1%} of the rows only"))
    if q.time and q.time.grain and not q.period_comparison:
        # a named period of the same or a coarser grain asks for its rows, not for a row each
        named = q.time.named_period and grain_of(q.time.named_period)
        if not (named and GRAINS.index(q.time.grain) >= GRAINS.index(named)):
            plan.time_grain = q.time.grain
    kind = "answer_with_caveats" if any(not c.assumption for c in caveats) else "answer"
    return Verdict(kind, plan, caveats=caveats)
