"""From a bound plan to rows: one DataFrame a query, and what must be told beside it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import periods
from ledgerlight.operators.profile import quoted
from ledgerlight.plans import measures
from ledgerlight.plans.binder import REVENUE, bind
from ledgerlight.plans.model import Model
from ledgerlight.plans.query import Query, bounds, grain_of
from ledgerlight.plans.verdict import BoundPlan, Caveat, Verdict

#: Texts that mark a period as complete, and the units that a rolling window counts in.
COMPLETE = ("true", "complete", "yes", "t", "y")
UNITS = {"day": ("days", 1), "week": ("weeks", 1), "month": ("months", 1), "quarter": ("months", 3), "year": ("years", 1)}
PAIRS, RANKED = 20, 10
#: A base under this share of all bases is called small; so many groups with a poor base are named.
SMALL_BASE, NAMED = 0.01, 3
#: Rows of an answer that are gathered; of more, the answer says so, and `Answer.frame` has all.
PAGE = 10_000


class NeedsClarification(Exception):
    def __init__(self, text: str, options: list[str]):
        super().__init__(text)
        self.options = options


class ClaimError(Exception):
    """An answer would tell of a restriction that its plan doesn't make."""


@dataclass
class Answer:
    kind: str
    rows: list[dict[str, Any]]
    columns: list[str]
    formula: str
    explanation: str
    filters: list[str]
    caveats: list[Caveat] = field(default_factory=list)
    assumptions: list[Caveat] = field(default_factory=list)
    plan: str = ""
    frame: DataFrame | None = None

    def to_dict(self) -> dict[str, Any]:
        out = {k: v for k, v in vars(self).items() if k != "frame"}
        return out | {k: [dict(vars(c)) for c in out[k]] for k in ("caveats", "assumptions")}


def event_time(model: Model) -> Column:
    """The time of a row; text is parsed in the order that was found for it."""
    c = model.first("event_time")
    return periods.parsed(quoted(c), model.parsers[c]) if c in model.parsers else quoted(c)


def _day(value: Any) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def window(df: DataFrame, model: Model, plan: BoundPlan) -> list[tuple[str, Column]]:
    """Predicates of the time window. Named periods become ranges, so that they reach the scan."""
    w = plan.query.time
    if not w:
        return []
    t, out = event_time(model), []
    if w.named_period:
        a, b = bounds(w.named_period)
        out += [(f"time in {w.named_period}", (t >= _day(a)) & (t < _day(b)))]
    if w.start:
        out.append((f"time from {w.start}", t >= _day(w.start)))
    if w.end:
        out.append((f"time before {w.end}", t < _day(w.end)))
    if w.last_n:
        unit, times = UNITS[w.grain or "year"]
        # counts back from the table's latest time, whatever else is asked for; the model knows it
        latest = model.latest or df.agg(F.max(t).alias("t")).collect()[0].t
        if latest is not None:
            out.append((f"last {w.last_n} {w.grain or 'year'}", t >= _day(latest) - F.expr(f"interval {w.last_n * times} {unit}")))
    return out


def predicates(df: DataFrame, model: Model, plan: BoundPlan) -> list[tuple[str, Column]]:
    """All predicates of a plan with their wording; the answer tells exactly these."""
    out = []
    for f in plan.query.filters:
        inside = quoted(f.column).cast("string").isin(f.values) if f.values else F.lit(None).cast("boolean")
        out.append((f"{f.column} {f.op.replace('_', ' ')} {f.values}", inside if f.op == "in" else ~inside))
    for f in plan.query.numeric_filters:
        v = quoted(f.column).cast("int") if model.types.get(f.column) == "boolean" else quoted(f.column)
        test = {"gt": v > f.value, "gte": v >= f.value, "lt": v < f.value, "lte": v <= f.value, "eq": v == f.value, "between": v.between(f.value, f.value2)}[f.op]
        out.append((f"{f.column} {f.op} {f.value}" + (f" and {f.value2}" if f.op == "between" else ""), test))
    if plan.partition_values is not None:
        out.append((f"{model.partition.column} in {plan.partition_values}", quoted(model.partition.column).cast("string").isin(plan.partition_values)))
    if plan.complete_only:
        flag = quoted(model.completeness.flag)
        yes = F.lower(F.trim(flag.cast("string"))).isin(*COMPLETE)
        out.append((f"{model.completeness.flag} is complete", F.coalesce(flag.cast("string").try_cast("int") == 1, F.lit(False)) | yes))
    return out + window(df, model, plan)


def needed(model: Model, plan: BoundPlan, disclosed: bool = False) -> set[str]:
    """The columns that a plan reads, and with `disclosed` what is told beside it: a view need not join what none of them comes from."""
    q = plan.query
    out = {*plan.group_by, *(f.column for f in q.filters), *(f.column for f in q.numeric_filters), *(a.column for a in q.aggregations if a.column)}
    for name in q.measures:
        out |= set(model.measure(name).columns)
    if q.frequency:
        out |= {q.frequency.entity, q.frequency.count_of}
    if q.distinct_count_of:
        out.add(q.distinct_count_of)
    if q.time or q.period_comparison:
        out.add(model.first("event_time"))
    if q.basket:
        out |= {model.first("transaction_key"), model.entity("product")}
    if model.partition and (q.basket or plan.partition_values is not None or disclosed and set(q.measures) & set(REVENUE)):
        out.add(model.partition.column)
    if model.returns.column and (q.basket or "gross_revenue" in q.measures):
        out.add(model.returns.column)
    if plan.complete_only:
        out.add(model.completeness.flag)
    return out


def scoped(df: DataFrame, found: list[tuple[str, Column]]) -> DataFrame:
    for _, p in found:
        df = df.filter(p)
    return df


def _aggregates(model: Model, q: Query) -> list[tuple[str, Column]]:
    out = [(name, measures.column(model, name)) for name in q.measures]
    for a in q.aggregations:
        if a.func == "count":
            out.append((a.name, F.count(quoted(a.column) if a.column else F.lit(1))))
        else:
            v = measures.exact(model, a.column) if a.func in ("sum", "avg") else quoted(a.column)
            value = getattr(F, a.func)(v)
            out.append((a.name, value.cast("long") if a.func == "sum" and model.types[a.column] == "integer" else value.cast("double") if a.func in ("sum", "avg") else value))
    if q.distinct_count_of:
        out.append(("distinct_count", F.count_distinct(quoted(q.distinct_count_of))))
    return out


def standard(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame:
    """Groups, a period label if asked for, measures, their share of the total, order and limit."""
    q, keys = plan.query, [quoted(c).alias(c) for c in plan.group_by]
    if plan.time_grain:
        keys = [periods.label(event_time(model), plan.time_grain).alias("period"), *keys]
    names = [*(["period"] if plan.time_grain else []), *plan.group_by]
    parts = _aggregates(model, q)
    out = scoped(df, predicates(df, model, plan)).groupBy(*keys).agg(*[c.alias(n) for n, c in parts])
    if q.share_of_total:
        # over all groups, before any limit; the grouped frame is small and read once
        first = F.coalesce(quoted(parts[0][0]).cast("double"), F.lit(0.0))
        total = out.agg(F.sum(first.cast("decimal(38,6)")).cast("double").alias("__total"))
        out = out.crossJoin(F.broadcast(total)).withColumn("share", first / F.nullif("__total", F.lit(0.0))).drop("__total")
    if q.top_k:
        m = quoted(q.top_k.measure)
        ties = [quoted(n).asc_nulls_last() for n in names]
        return out.orderBy(m.desc_nulls_last() if q.top_k.direction == "desc" else m.asc_nulls_last(), *ties).limit(q.top_k.k)
    return out.orderBy(*[quoted(n).asc_nulls_last() for n in names]) if plan.time_grain else out


def frequency(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame:
    """How many entities did something n times, their measure, that of all entities, and the share; one pass over the entities."""
    f, q = plan.query.frequency, plan.query
    measure = _aggregates(model, q)[0][1] if q.measures or q.aggregations else F.count(F.lit(1)).cast("double")
    per = scoped(df, [("", quoted(f.entity).isNotNull()), *predicates(df, model, plan)]).groupBy(quoted(f.entity).alias("e")).agg(F.count_distinct(quoted(f.count_of)).alias("times"), measure.cast("decimal(38,6)").alias("m"))
    hit = {"eq": F.col("times") == f.n, "lte": F.col("times") <= f.n, "gte": F.col("times") >= f.n}[f.op]
    sums = per.agg(F.count_if(hit).alias("entity_count"), F.sum(F.when(hit, F.col("m"))).cast("double").alias("group_measure"), F.sum("m").cast("double").alias("total_measure"))
    return sums.withColumn("share", F.coalesce(F.col("group_measure"), F.lit(0.0)) / F.nullif("total_measure", F.lit(0.0)))


def basket(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame:
    """Pairs of products by the transactions that hold both: facts only, no returns. Lines are made distinct before
    the join, so pairs are counted without distinct; a skewed transaction is left to adaptive execution."""
    scope = predicates(df, model, plan)
    if model.partition and model.partition.fact_value is not None and plan.partition_values is None:
        scope.append(("facts", quoted(model.partition.column).cast("string") == model.partition.fact_value))
    back = measures.returned(model)
    if back is not None:
        scope.append(("no returns", ~F.coalesce(back, F.lit(False))))
    lines = scoped(df, scope).select(quoted(model.first("transaction_key")).alias("txn"), quoted(model.entity("product")).alias("prod")).distinct()
    a, b = lines.select("txn", F.col("prod").alias("product_a")), lines.select("txn", F.col("prod").alias("product_b"))
    pairs = a.join(b, "txn").filter("product_a < product_b").groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("pair_count"))
    return pairs.orderBy(F.desc("pair_count"), "product_a", "product_b").limit(plan.query.top_k.k if plan.query.top_k else PAIRS)


def periods_of(df: DataFrame, model: Model, plan: BoundPlan) -> list[str]:
    """The labels that the plan's rows fall into, in order."""
    label = periods.label(event_time(model), plan.query.period_comparison.grain)
    return [r.p for r in scoped(df, predicates(df, model, plan)).select(label.alias("p")).filter("p is not null").distinct().orderBy("p").collect()]


def resolved(df: DataFrame, model: Model, plan: BoundPlan) -> tuple[str, str]:
    """The two periods: those named, else the last two that the rows fall into, which takes a look at all of them."""
    c = plan.query.period_comparison
    if named(plan):
        return c.period_a, c.period_b
    there = periods_of(df, model, plan)
    if len(there) < 2:
        raise NeedsClarification("There aren't two periods to compare", there)
    a, b = c.period_a or there[-2], c.period_b or there[-1]
    for p in (a, b):
        if p not in there:
            raise NeedsClarification(f"There is no period {p}", there)
    return a, b


def named(plan: BoundPlan) -> bool:
    """Whether both periods are named, in the grain asked for: then they are two ranges that reach the scan."""
    c = plan.query.period_comparison
    return bool(c.period_a and c.period_b) and grain_of(c.period_a) == c.grain == grain_of(c.period_b)


def without_rows(df: DataFrame, model: Model, plan: BoundPlan, a: str, b: str) -> list[str]:
    """Which of two named periods no row falls into."""
    t = event_time(model)
    inside = [(t >= _day(bounds(p)[0])) & (t < _day(bounds(p)[1])) for p in (a, b)]
    r = scoped(df, predicates(df, model, plan)).filter(inside[0] | inside[1]).agg(*[F.max(x).alias(f"p{k}") for k, x in enumerate(inside)]).collect()[0]
    return [p for k, p in enumerate((a, b)) if not r[f"p{k}"]]


def both_periods(df: DataFrame, model: Model, plan: BoundPlan, a: str, b: str) -> DataFrame:
    """Each group's measure in the two periods."""
    t = event_time(model)
    inside = [(bounds(p)[0], bounds(p)[1]) for p in (a, b)]
    either = [((t >= _day(x)) & (t < _day(y))) for x, y in inside]
    rows = scoped(df, predicates(df, model, plan)).filter(either[0] | either[1])
    per = rows.groupBy(*[quoted(c).alias(c) for c in plan.group_by], F.when(either[0], 1).otherwise(2).alias("__p")).agg(_aggregates(model, plan.query)[0][1].cast("double").alias("__m"))
    return per.groupBy(*[quoted(c) for c in plan.group_by]).agg(F.max(F.when(F.col("__p") == 1, F.col("__m"))).alias("period_a_value"), F.max(F.when(F.col("__p") == 2, F.col("__m"))).alias("period_b_value"))


def comparison(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame:
    """Growth, change or ratio of each group between two periods, ranked; growth over no or no positive base is null."""
    a, b = resolved(df, model, plan)
    x, y = F.col("period_a_value"), F.col("period_b_value")
    kind = plan.query.period_comparison.kind
    value = {"change": y - x, "ratio": F.when(x > 0, y / x), "growth": F.when(x > 0, (y - x) / x)}[kind]
    out = both_periods(df, model, plan, a, b).withColumn("growth", value)
    up = plan.query.top_k and plan.query.top_k.direction == "asc"
    rank = F.col("growth").asc_nulls_last() if up else F.col("growth").desc_nulls_last()
    return out.orderBy(rank, *[quoted(c).asc_nulls_last() for c in plan.group_by]).limit(plan.query.top_k.k if plan.query.top_k else RANKED)


def compiled(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame:
    """The plan's DataFrame; nothing but a bound plan is accepted."""
    q = plan.query
    shape = basket if q.basket else frequency if q.frequency else comparison if q.period_comparison else standard
    return shape(df, model, plan)


def non_facts(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame | None:
    """What a revenue holds of lines that are no facts, by their kind: value, amount, the greatest first."""
    name = next((m for m in plan.query.measures if m in REVENUE), None)
    part = model.partition
    if not name or not part or part.fact_value is None or plan.partition_values is not None or part.column in {f.column for f in plan.query.filters}:
        return None
    kind = quoted(part.column).cast("string")
    rows = scoped(df, predicates(df, model, plan)).filter(kind.isNotNull() & (kind != part.fact_value))
    return rows.groupBy(kind.alias("value")).agg(measures.column(model, name).alias("amount")).filter("amount <> 0").orderBy(F.desc(F.abs("amount")), "value")


def base_anomalies(both: DataFrame) -> DataFrame:
    """Groups with rows in both periods whose growth has no sound base: non_positive (not ranked) and small (under SMALL_BASE of all bases)."""
    there = both.filter("period_a_value is not null and period_b_value is not null")
    total = F.broadcast(there.agg(F.sum(F.col("period_a_value").cast("decimal(38,6)")).cast("double").alias("__all")))
    kind = F.when(F.col("period_a_value") <= 0, "non_positive").when((F.col("__all") > 0) & (F.col("period_a_value") < SMALL_BASE * F.col("__all")), "small")
    return there.crossJoin(total).withColumn("anomaly", kind).withColumn("base_share", F.when(F.col("__all") > 0, F.col("period_a_value") / F.col("__all"))).filter("anomaly is not null").drop("__all")


def told_anomalies(both: DataFrame, groups: list[str], period: str) -> list[Caveat]:
    """What is told of them: how many there are, and the first few by base, with name and figures."""
    label = F.concat_ws("/", *[quoted(g).cast("string") for g in groups]) if groups else F.lit("all rows")
    w = Window.partitionBy("anomaly")
    ranked = base_anomalies(both).select("anomaly", "period_a_value", "base_share", label.alias("label")).withColumn("position", F.row_number().over(w.orderBy("period_a_value", "label")))
    first = F.when(F.col("position") <= NAMED, F.struct("position", "label", "period_a_value", "base_share"))
    out = []
    for r in ranked.groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(first)).alias("first")).orderBy("anomaly").collect():
        names = ", ".join(f"{x.label} {x.period_a_value:,.2f}" + (f" ({x.base_share:.3%} of {period})" if r.anomaly == "small" else "") for x in r["first"])
        more = f", +{r.n - len(r['first'])} more" if r.n > len(r["first"]) else ""
        why = "growth over it says nothing, so they aren't ranked" if r.anomaly == "non_positive" else "growth over it is easily large"
        out.append(Caveat("base", f"{r.n} groups have a {r.anomaly.replace('_', '-')} base in {period}: {names}{more}; {why}"))
    return out


def unbacked(model: Model, plan: BoundPlan, caveats: list[Caveat], out: DataFrame) -> list[str]:
    """Restrictions that are told but that no filter of the DataFrame makes."""
    filters = [line for line in out._jdf.queryExecution().analyzed().toString().split("\n") if "Filter " in line]
    wanted = {"window": model.first("event_time"), "complete_periods": model.completeness and model.completeness.flag, "partition": model.partition and model.partition.column}
    told = {c.kind for c in caveats} | ({"window"} if plan.query.time and plan.query.time.last_n and model.latest else set())
    return sorted(k for k, column in wanted.items() if k in told and not any(f"{column}#" in line for line in filters))


def window_facts(df: DataFrame, model: Model, plan: BoundPlan) -> DataFrame:
    """first_day, last_day of the table, and whether the rolling window takes in all of it."""
    t = event_time(model)
    unit, times = UNITS[plan.query.time.grain or "year"]
    spans = df.agg(F.min(t).alias("a"), F.max(t).alias("b"))
    start = F.col("b") - F.expr(f"interval {plan.query.time.last_n * times} {unit}")
    return spans.select(F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day"), F.to_date(start).alias("window_start"), (F.to_date(start) <= F.to_date("a")).alias("whole"))


def execute(df: DataFrame, model: Model, verdict: Verdict) -> Answer:
    """Runs a bound plan and gathers its (small) answer with every disclosure."""
    plan, caveats = verdict.plan, list(verdict.caveats)
    q = plan.query
    scope = predicates(df, model, plan)
    compared = resolved(df, model, plan) if q.period_comparison else None
    if compared:
        q.period_comparison.period_a, q.period_comparison.period_b = compared
    out = compiled(df, model, plan)
    if false := unbacked(model, plan, caveats, out):
        raise ClaimError("told but not done: " + ", ".join(false))
    rows = [r.asDict() for r in out.limit(PAGE + 1).collect()]
    if len(rows) > PAGE:
        rows = rows[:PAGE]
        caveats.append(Caveat("page", f"There are more rows; these are the first {PAGE:,}"))
    if compared and not (any(r["period_a_value"] is not None for r in rows) and any(r["period_b_value"] is not None for r in rows)) and (gone := without_rows(df, model, plan, *compared)):
        raise NeedsClarification(f"There is no period {gone[0]}", periods_of(df, model, plan))
    if not plan.group_by and not plan.time_grain and scope and not (q.basket or q.period_comparison) and set(q.measures) | {a.func for a in q.aggregations} - {"count"} and scoped(df, scope).limit(1).isEmpty():
        caveats.append(Caveat("empty", "No row matches: this is an empty result, not a zero"))
    for c in plan.group_by:
        if rows and c in rows[0] and all(r[c] is None for r in rows):
            caveats.append(Caveat("all_null", f"{c} isn't known on any of these rows"))
    if q.time and q.time.last_n:
        f = window_facts(df, model, plan).collect()[0]
        caveats.append(Caveat("window", f"The window ends at the data's last day, {f.last_day}" + (f"; the data begin on {f.first_day}, so it takes in all of them" if f.whole else "")))
    others = non_facts(df, model, plan) if not (q.basket or q.frequency or q.period_comparison) else None
    if others is not None and (found := others.collect()):
        shown = ", ".join(f"{r.value} {r.amount:+,.2f}" for r in found[:3]) + (f", +{len(found) - 3} more" if len(found) > 3 else "")
        caveats.append(Caveat("partition", f"Holds {sum(r.amount for r in found):+,.2f} of {len(found)} kinds that aren't {model.partition.fact_value}: {shown}"))
    if q.basket:
        caveats.append(Caveat("basket_scope", "Only facts count, returned lines don't", True))
    if q.period_comparison:
        caveats += told_anomalies(both_periods(df, model, plan, *compared), plan.group_by, compared[0])
        if not model.completeness:
            caveats.append(Caveat("completeness", "Whether the periods are complete isn't known"))
    formula = "; ".join(m.formula for m in model.measures if m.name in q.measures) or ", ".join(a.name for a in q.aggregations)
    told = [w for w, _ in scope]
    kind = "answer_with_caveats" if any(not c.assumption for c in caveats) else "answer"
    text = f"{formula or 'rows'}" + (f" by {', '.join(plan.group_by)}" if plan.group_by else "") + (f", where {'; '.join(told)}" if told else "")
    return Answer(kind, rows, out.columns, formula, text, told, [c for c in caveats if not c.assumption], [c for c in caveats if c.assumption], out._jdf.queryExecution().simpleString(), out)


def ask(df: DataFrame, model: Model, query: Query) -> Answer | Verdict:
    """Binds and, if that succeeds, executes; a period that isn't there turns into a question."""
    verdict = bind(model, query)
    if verdict.plan is None:
        return verdict
    try:
        return execute(df, model, verdict)
    except NeedsClarification as e:
        return Verdict("clarify", reason=str(e), options=e.options)
