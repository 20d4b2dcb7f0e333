"""The measures: columns made from roles, with the formula that tells what they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight.operators.profile import quoted
from ledgerlight.plans.model import Measure, Model


def exact(model: Model, column: str) -> Column:
    """A column's values for summing: decimals of two places are added exactly, in any order."""
    if model.types.get(column) == "integer":
        return quoted(column).cast("decimal(18,0)")
    return quoted(column).cast("decimal(18,2)") if model.scales.get(column) is not None else quoted(column)


def returned(model: Model) -> Column | None:
    """Whether a line is a return; null where that can't be told."""
    r = model.returns
    if r.kind == "explicit_flag":
        return F.coalesce(quoted(r.column).try_cast("int"), quoted(r.column).cast("string").isin("true").cast("int")) == 1
    if r.kind == "explicit_category":
        return quoted(r.column).cast("string").isin(r.values)
    if r.kind == "derived_key_prefix":
        return F.left(quoted(r.column).cast("string"), F.lit(1)).isin(r.values)
    return quoted(r.column) < 0 if r.kind == "derived_negative_quantity" else None


def revenue(model: Model) -> tuple[Column, str, list[str]] | None:
    """(value of a line, formula, columns): a verified stored amount, else quantity times rate, else a single stated amount."""
    amounts, quantity, rate = model.in_role("monetary_amount"), model.first("additive_quantity"), model.first("monetary_rate")
    proven = [a for a in amounts if model.binding(a).status == "verified"]
    if proven:
        return exact(model, proven[0]), proven[0], [proven[0]]
    if quantity and rate:
        value = quoted(quantity) * quoted(rate)
        both = model.scales.get(rate) is not None and model.types.get(quantity) == "integer"
        return (value.cast("decimal(18,2)") if both else value), f"{quantity} * {rate}", [quantity, rate]
    return (exact(model, amounts[0]), amounts[0], [amounts[0]]) if len(amounts) == 1 else None


def declared(model: Model) -> list[Measure]:
    """The measures that a model's roles allow, and what others lack."""
    value, out = revenue(model), []
    lacking = [] if value else ["monetary_amount, or additive_quantity and monetary_rate"]
    cols = value[2] if value else []
    out.append(Measure("net_revenue", f"sum({value[1]})" if value else "", cols, bool(value), True, lacking))
    gross = f"sum({value[1]} of lines that aren't returns)" if value and model.returns.kind != "none" else f"sum({value[1]})" if value else ""
    out.append(Measure("gross_revenue", gross, cols, bool(value), True, lacking, [] if model.returns.kind != "none" else ["no returns are known: as net_revenue"]))
    quantity, key, product = model.first("additive_quantity"), model.first("transaction_key"), model.entity("product")
    out.append(Measure("units_sold", f"sum({quantity})" if quantity else "", [quantity] if quantity else [], bool(quantity), True, [] if quantity else ["additive_quantity"]))
    out.append(Measure("order_count", f"count(distinct {key})" if key else "", [key] if key else [], bool(key), False, [] if key else ["transaction_key"]))
    lacks = [*([] if key else ["transaction_key"]), *([] if product else ["entity_key of a product"])]
    out.append(Measure("basket_cooccurrence", "count(distinct transactions with both)", [c for c in (key, product) if c], not lacks, False, lacks))
    return out


def column(model: Model, name: str) -> Column:
    """The aggregate of a measure."""
    if name in ("net_revenue", "gross_revenue"):
        value, back = revenue(model)[0], returned(model)
        if name == "gross_revenue" and back is not None:
            # a line of which that isn't known counts nothing
            value = F.when(~back, value).otherwise(F.lit(0))
        return F.sum(value).cast("double")
    if name == "units_sold":
        quantity = model.first("additive_quantity")
        total = F.sum(exact(model, quantity))
        return total.cast("long") if model.types.get(quantity) == "integer" else total.cast("double")
    if name == "order_count":
        return F.count_distinct(quoted(model.first("transaction_key")))
    raise KeyError(name)
