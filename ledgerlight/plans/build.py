"""Building the model: propose, test, discover, freeze."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ledgerlight.operators import verify
from ledgerlight.operators.profile import TOP, Profile, profile
from ledgerlight.plans import measures
from ledgerlight.plans.model import Binding, Claim, Model, Values
from ledgerlight.plans.propose import proposed

#: What is told about dates whose order had to be taken from the text.
DATE_NOTES = {"day_first": "Dates are read with the day first, as days over 12 show", "month_first": "Dates are read with the month first, as days over 12 show", "ambiguous": "Whether the day or the month comes first can't be told from the dates; the day is taken to"}


def build(df: DataFrame, dataset_id: str = "dataset", claims: list[Claim] | None = None, provider: Callable[[dict], Any] | None = None, known: Profile | None = None) -> Model:
    """The model of a table, from given claims or proposed ones. Queries never look at the whole data again."""
    p = known or profile(df)
    given = claims if claims is not None else proposed(p, provider)
    best: dict[str, Claim] = {}
    for c in given:
        if c.column in p.columns and (c.column not in best or c.confidence > best[c.column].confidence):
            best[c.column] = c
    bindings = [Binding(c.column, c.role, c.entity, c.confidence, c.source) for c in best.values()]

    def of(role: str) -> list[Binding]:
        return sorted((b for b in bindings if b.role == role), key=lambda b: -b.confidence)

    texts = [b.column for b in of("event_time") if p.columns[b.column].type == "text"]
    orders = verify.date_orders(df, texts)
    for b in of("event_time"):
        b.checks.append(verify.check_time(df, p, b.column, orders.get(b.column)))
    time = next((b.column for b in of("event_time") if b.status != "refuted"), None)
    for role, name in (("additive_quantity", "additive_quantity_structure"), ("monetary_rate", "monetary_rate_structure")):
        for b in of(role):
            b.checks.append(verify.check_numeric(p, b.column, name))
    for b in of("transaction_key"):
        if time:
            b.checks.append(verify.check_key(df, b.column, time, orders.get(time)))
    quantity = next((b.column for b in of("additive_quantity") if b.status != "refuted"), None)
    rate = next((b.column for b in of("monetary_rate") if b.status != "refuted"), None)
    for b in of("monetary_amount"):
        b.checks.append(verify.check_numeric(p, b.column, "monetary_amount_structure"))
        if quantity and rate and b.status != "refuted":
            b.checks.append(verify.check_amount(df, b.column, quantity, rate))
    for b in of("entity_key"):
        b.checks.append(verify.Check("entity_coverage", True, 1 - p.columns[b.column].null_rate))
    for b in bindings:
        if b.status == "refuted":
            b.confidence = 0.0

    model = Model(dataset_id, p.row_count, {c.name: c.type for c in p.columns.values()}, bindings, claims=list(best.values()))
    model.coverage = {c.name: round(1 - c.null_rate, 6) for c in p.columns.values()}
    model.scales = {c.name: c.scale for c in p.columns.values() if c.type == "decimal" and c.scale is not None}
    model.parsers = {c: o for c, o in orders.items() if o != "not_a_date" and model.binding(c).status != "refuted"}
    model.latest = verify.latest(df, p, time, model.parsers.get(time))
    model.date_notes = {c: DATE_NOTES[o] for c, o in model.parsers.items() if o in DATE_NOTES}
    flags, dimensions = model.in_role("flag"), model.in_role("dimension")
    model.returns = verify.returns(df, quantity, model.first("transaction_key"), flags, dimensions)
    model.period_columns = verify.period_columns(p, time, dimensions)
    model.partition = verify.partition(df, p, dimensions, flags, model.period_columns)
    model.labels = verify.labels(p, model.in_role("description"), model.in_role("entity_key"))
    model.completeness = verify.completeness(p, flags, model.period_columns)
    model.values = {c: Values([v for v, _ in p.columns[c].top], p.columns[c].distinct <= min(TOP, len(p.columns[c].top))) for c in model.bound() if c in p.columns}
    model.measures = measures.declared(model)
    return model
