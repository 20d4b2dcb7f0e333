"""The registered queries over the star schema: a sales fact view, its model, and typed queries on it with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import periods
from ledgerlight.operators import profile as profiles
from ledgerlight.operators import verify
from ledgerlight.plans import execute
from ledgerlight.plans.binder import bind
from ledgerlight.plans.build import build
from ledgerlight.plans.model import Claim, Model
from ledgerlight.plans.propose import evidence
from ledgerlight.plans.query import Query
from ledgerlight.sources.tables import state, table

#: A dimension table is broadcast if it has so many rows at most; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000

CLAIMS = [
    Claim("order_id", "transaction_key"), Claim("order_date", "event_time"), Claim("order_quarter", "dimension"), Claim("is_complete_quarter", "flag"),
    Claim("part_id", "entity_key", "product"), Claim("part_label", "description"), Claim("line_type", "dimension"), Claim("is_product_line", "flag"),
    Claim("qty", "additive_quantity"), Claim("unit_price", "monetary_rate"), Claim("amount", "monetary_amount"), Claim("return_flag", "dimension"),
    Claim("customer_id", "entity_key", "customer"), Claim("segment", "dimension"), Claim("nation", "dimension"), Claim("region_name", "dimension"),
]
EVENT_CLAIMS = [Claim("ts", "event_time"), Claim("user_id", "entity_key", "customer"), Claim("event_type", "dimension"), Claim("event_id", "ignore"), Claim("value", "ignore"), Claim("props", "ignore")]


#: The tables that a sale's columns come from.
TABLES = ("lineitem", "orders", "part", "customer", "nation", "region")
_facts: dict[tuple, dict] = {}


def _facts_of(spark: SparkSession, folder: str) -> dict:
    """Facts of a folder's tables as they are, found once a session: the latest quarter, which dimensions are small, and
    which foreign keys are sound (every value there, once), so that a join which only adds columns can be left out."""
    key = spark.sparkContext.applicationId, folder, state(spark, folder, *TABLES)
    if key not in _facts:
        t = {n: table(spark, folder, n) for n in ("orders", "lineitem", "customer", "part")}
        latest = t["orders"].agg(periods.label(F.max("o_orderdate"), "quarter").alias("q")).collect()[0].q
        sizes = {n: t[n].count() for n in ("customer", "part")}

        def sound(many: DataFrame, foreign: str, one: DataFrame, primary: str) -> bool:
            once = one.groupBy(F.col(primary).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            loose = many.select(F.col(foreign).alias("k")).join(once, "k", "left").filter("n is null or n > 1")
            return loose.isEmpty() and once.filter("n > 1").isEmpty()

        places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        _facts[key] = {
            "latest": latest, "small": {n for n, k in sizes.items() if k <= BROADCAST_ROWS},
            "sound": {n for n, ok in (("part", lambda: sound(t["lineitem"], "l_partkey", t["part"], "p_partkey")), ("orders", lambda: sound(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey")), ("customer", lambda: sound(t["orders"], "o_custkey", t["customer"], "c_custkey") and sound(t["customer"], "c_nationkey", places, "n_nationkey"))) if ok()},
        }
    return _facts[key]


FROM_CUSTOMER, FROM_PART = ("segment", "nation", "region_name"), ("part_label", "line_type", "is_product_line")
FROM_ORDERS = ("order_date", "order_quarter", "is_complete_quarter", "customer_id", *FROM_CUSTOMER)


def sales(spark: SparkSession, folder: str, need: set[str] | None = None) -> DataFrame:
    """One row per line item, with its order, part, customer, nation and region; returned lines are negative.

    With `need`, joins that none of these columns needs are left out, where the keys are known to be sound.
    """
    facts = _facts_of(spark, folder)

    def wanted(columns: tuple[str, ...], name: str) -> bool:
        return need is None or name not in facts["sound"] or bool(need & set(columns))

    def small(df: DataFrame, name: str) -> DataFrame:
        return F.broadcast(df) if name in facts["small"] else df

    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    out = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), (sign * F.col("l_quantity")).cast("long").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (sign * F.col("l_extendedprice")).alias("amount"), F.col("l_returnflag").alias("return_flag"),
    )
    if wanted(FROM_PART, "part"):
        parts = table(spark, folder, "part").select("p_partkey", F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("part_label"), F.col("p_type").alias("line_type"), (F.col("p_type") == "STANDARD").cast("int").alias("is_product_line"))
        out = out.join(small(parts, "part"), F.col("part_id") == F.col("p_partkey")).drop("p_partkey")
    if wanted(FROM_ORDERS, "orders") or "customer" not in facts["sound"]:
        quarter = periods.label(F.col("o_orderdate"), "quarter")
        heads = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("order_date"), quarter.alias("order_quarter"), (quarter != F.lit(facts["latest"])).cast("int").alias("is_complete_quarter"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("customer_id"))
        if wanted(FROM_CUSTOMER, "customer"):
            place = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region_name"))
            customers = table(spark, folder, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("segment"), "nation", "region_name")
            heads = heads.join(small(customers, "customer"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
        out = out.join(heads.drop("o_custkey"), F.col("order_id") == F.col("o_orderkey")).drop("o_orderkey")
    return out


_models: dict[tuple, Model] = {}


def model_of(spark: SparkSession, folder: str, name: str = "sales") -> Model:
    """The frozen model of a folder's sales or events as they are, built once a session."""
    key = spark.sparkContext.applicationId, folder, name, state(spark, folder, *(TABLES if name == "sales" else ("events",)))
    if key not in _models:
        df, claims = (sales(spark, folder), CLAIMS) if name == "sales" else (table(spark, folder, "events"), EVENT_CLAIMS)
        # profiling reads the table some twenty times: the joins are done once, and redone where an executor is lost
        df = df.persist()
        _models[key] = build(df, name, claims)
        df.unpersist()
    return _models[key]


def _asked(raw: dict, rename: dict[str, str] | None = None, name: str = "sales") -> Callable[[SparkSession, str], DataFrame]:
    """A typed query, bound and compiled; one that doesn't bind is an error."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        model = model_of(spark, folder, name)
        verdict = bind(model, Query.of(raw))
        if verdict.plan is None:
            raise ValueError(f"{verdict.kind}: {verdict.reason}")
        df = sales(spark, folder, execute.needed(model, verdict.plan)) if name == "sales" else table(spark, folder, "events")
        out = execute.compiled(df, model, verdict.plan)
        return out.withColumnsRenamed(rename or {})

    return run


SALES_SQL = """
latest AS (SELECT year(MAX(o_orderdate)) || '-Q' || quarter(MAX(o_orderdate)) AS q FROM orders),
sales AS (SELECT l_orderkey AS order_id, o_orderdate AS order_date, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS order_quarter,
  CASE WHEN year(o_orderdate) || '-Q' || quarter(o_orderdate) <> (SELECT q FROM latest) THEN 1 ELSE 0 END AS is_complete_quarter,
  l_partkey AS part_id, p_name || '#' || CAST(l_partkey AS VARCHAR) AS part_label, p_type AS line_type, CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END AS is_product_line,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS qty, l_extendedprice / l_quantity AS unit_price,
  CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount, l_returnflag AS return_flag,
  CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS customer_id, c_mktsegment AS segment, n_name AS nation, r_name AS region_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
NET = "CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)"
GROSS = "CAST(SUM(CASE WHEN return_flag <> 'R' THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)"


def _sql(body: str, more: str = "") -> str:
    return f"WITH {SALES_SQL}{', ' + more if more else ''} {body}"


def _label(grain: str) -> str:
    return "year(order_date) || '-Q' || quarter(order_date)" if grain == "quarter" else "strftime(order_date, '" + {"day": "%Y-%m-%d", "week": "%Y-W%W", "month": "%Y-%m", "year": "%Y"}[grain] + "')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, raw: dict, sql: str, rename: dict[str, str] | None = None) -> None:
    QUERIES[name], SQL[name] = _asked(raw, rename), sql


_add("q01_top_products_net_revenue", {"measures": ["net_revenue"], "group_by": ["part_id"], "top_k": {"measure": "net_revenue", "k": 10}}, _sql(f"SELECT part_id, {NET} AS net_revenue FROM sales WHERE line_type = 'STANDARD' GROUP BY part_id ORDER BY net_revenue DESC, part_id LIMIT 10"))
_add("q02_revenue_total_net_gross", {"measures": ["net_revenue", "gross_revenue"]}, _sql(f"SELECT {NET} AS net_revenue, {GROSS} AS gross_revenue FROM sales"))
_add("q03_units_by_nation", {"measures": ["units_sold"], "group_by": ["nation"]}, _sql("SELECT nation, CAST(SUM(qty) AS BIGINT) AS units_sold FROM sales GROUP BY nation"))
_add("q04_order_count_by_segment", {"measures": ["order_count"], "group_by": ["segment"]}, _sql("SELECT segment, COUNT(DISTINCT order_id) AS order_count FROM sales GROUP BY segment"))
for _n, _g in (("q05_revenue_by_month", "month"), ("q06_revenue_by_week", "week"), ("q07_revenue_by_quarter", "quarter"), ("q08_revenue_by_year", "year"), ("q09_revenue_by_day", "day")):
    _add(_n, {"measures": ["net_revenue"], "time": {"grain": _g}}, _sql(f"SELECT {_label(_g)} AS period, {NET} AS net_revenue FROM sales GROUP BY 1"))
_add("q10_named_month", {"measures": ["net_revenue", "order_count"], "time": {"named_period": "1998-03"}}, _sql(f"SELECT {NET} AS net_revenue, COUNT(DISTINCT order_id) AS order_count FROM sales WHERE {_label('month')} = '1998-03'"))
_add("q11_named_quarter_by_month", {"measures": ["net_revenue"], "time": {"named_period": "1998-Q2", "grain": "month"}}, _sql(f"SELECT {_label('month')} AS period, {NET} AS net_revenue FROM sales WHERE {_label('quarter')} = '1998-Q2' GROUP BY 1"))
_add("q12_range_exclusive_end", {"measures": ["units_sold"], "group_by": ["region_name"], "time": {"start": "1997-01-01", "end": "1998-01-01"}}, _sql("SELECT region_name, CAST(SUM(qty) AS BIGINT) AS units_sold FROM sales WHERE order_date >= TIMESTAMP '1997-01-01' AND order_date < TIMESTAMP '1998-01-01' GROUP BY 1"))
_add("q13_last_2_years", {"measures": ["net_revenue"], "time": {"last_n": 2, "grain": "year"}}, _sql(f"SELECT {_label('year')} AS period, {NET} AS net_revenue FROM sales WHERE order_date >= (SELECT MAX(order_date) FROM sales) - INTERVAL '2 years' GROUP BY 1"))
_add("q14_last_3_quarters", {"measures": ["order_count"], "group_by": ["segment"], "time": {"last_n": 3, "grain": "quarter"}}, _sql(f"SELECT {_label('quarter')} AS period, segment, COUNT(DISTINCT order_id) AS order_count FROM sales WHERE order_date >= (SELECT MAX(order_date) FROM sales) - INTERVAL '9 months' GROUP BY 1, 2"))
_add("q15_in_filter", {"measures": ["net_revenue"], "group_by": ["nation"], "filters": [{"column": "region_name", "op": "in", "values": ["ASIA", "EUROPE"]}]}, _sql(f"SELECT nation, {NET} AS net_revenue FROM sales WHERE region_name IN ('ASIA', 'EUROPE') GROUP BY 1"))
_add("q16_not_in_filter", {"measures": ["units_sold"], "group_by": ["line_type"], "filters": [{"column": "return_flag", "op": "not_in", "values": ["R"]}]}, _sql("SELECT line_type, CAST(SUM(qty) AS BIGINT) AS units_sold FROM sales WHERE return_flag NOT IN ('R') GROUP BY 1"))
_add("q17_numeric_ops", {"aggregations": [{"func": "count"}], "group_by": ["segment"], "numeric_filters": [{"column": "qty", "op": "gt", "value": 10}, {"column": "amount", "op": "lte", "value": 50000}]}, _sql("SELECT segment, COUNT(*) AS row_count FROM sales WHERE qty > 10 AND amount <= 50000 GROUP BY 1"))
_add("q18_between", {"measures": ["order_count"], "group_by": ["nation"], "numeric_filters": [{"column": "qty", "op": "between", "value": 5, "value2": 15}]}, _sql("SELECT nation, COUNT(DISTINCT order_id) AS order_count FROM sales WHERE qty BETWEEN 5 AND 15 GROUP BY 1"))
_add("q19_distinct_customers_by_segment", {"distinct_count_of": "customer", "group_by": ["segment"]}, _sql("SELECT segment, COUNT(DISTINCT customer_id) AS distinct_count FROM sales GROUP BY 1"))
_add("q20_share_of_total_topk", {"measures": ["net_revenue"], "group_by": ["nation"], "share_of_total": True, "top_k": {"measure": "share", "k": 5}}, _sql("SELECT nation, net_revenue, net_revenue / (SELECT CAST(SUM(CAST(net_revenue AS DECIMAL(38,6))) AS DOUBLE) FROM g) AS share FROM g ORDER BY share DESC, nation LIMIT 5", f"g AS (SELECT nation, {NET} AS net_revenue FROM sales GROUP BY 1)"))
for _n, _op, _sign in (("q21_bought_once", "eq", "="), ("q22_bought_lte", "lte", "<="), ("q23_bought_gte", "gte", ">=")):
    _k = {"eq": 1, "lte": 3, "gte": 10}[_op]
    _add(_n, {"measures": ["net_revenue"], "frequency": {"entity": "customer", "count_of": "transaction_key", "op": _op, "n": _k}}, _sql(f"SELECT COUNT(*) FILTER (WHERE times {_sign} {_k}) AS entity_count, CAST(SUM(m) FILTER (WHERE times {_sign} {_k}) AS DOUBLE) AS group_measure, CAST(SUM(m) AS DOUBLE) AS total_measure, COALESCE(CAST(SUM(m) FILTER (WHERE times {_sign} {_k}) AS DOUBLE), 0) / CAST(SUM(m) AS DOUBLE) AS share FROM per", "per AS (SELECT customer_id, COUNT(DISTINCT order_id) AS times, SUM(CAST(amount AS DECIMAL(18,2))) AS m FROM sales WHERE customer_id IS NOT NULL GROUP BY 1)"))
_add("q24_basket_pairs", {"measures": ["basket_cooccurrence"], "top_k": {"measure": "pair_count", "k": 20}}, _sql("SELECT a.part_id AS product_a, b.part_id AS product_b, COUNT(*) AS pair_count FROM l a JOIN l b ON a.order_id = b.order_id AND a.part_id < b.part_id GROUP BY 1, 2 ORDER BY pair_count DESC, product_a, product_b LIMIT 20", "l AS (SELECT DISTINCT order_id, part_id FROM sales WHERE line_type = 'STANDARD' AND return_flag <> 'R')"))
_BOTH = "both_ AS (SELECT nation, CAST(MAX(CASE WHEN p = 'A' THEN m END) AS DOUBLE) AS period_a_value, CAST(MAX(CASE WHEN p = 'B' THEN m END) AS DOUBLE) AS period_b_value FROM (SELECT nation, CASE WHEN {label} = '{a}' THEN 'A' ELSE 'B' END AS p, {net} AS m FROM sales WHERE is_complete_quarter = 1 AND {label} IN ('{a}', '{b}') GROUP BY 1, 2) GROUP BY 1)"


def _compared(name: str, kind: str, direction: str, a: str, b: str, value: str) -> None:
    raw = {"measures": ["net_revenue"], "group_by": ["nation"], "period_comparison": {"grain": "quarter", "period_a": a, "period_b": b, "kind": kind}, "top_k": {"measure": "net_revenue", "k": 10, "direction": direction}}
    _add(name, raw, _sql(f"SELECT nation, period_a_value, period_b_value, {value} AS growth FROM both_ ORDER BY growth {direction} NULLS LAST, nation LIMIT 10", _BOTH.format(label=_label("quarter"), a=a, b=b, net=NET)))


_compared("q25_growth_desc", "growth", "desc", "1998-Q1", "1998-Q2", "CASE WHEN period_a_value > 0 THEN (period_b_value - period_a_value) / period_a_value END")
_compared("q26_change", "change", "desc", "1997-Q3", "1997-Q4", "period_b_value - period_a_value")
_compared("q27_ratio_asc", "ratio", "asc", "1999-Q1", "1999-Q2", "CASE WHEN period_a_value > 0 THEN period_b_value / period_a_value END")
_add("q28_generic_aggs", {"aggregations": [{"func": "count", "column": "customer_id"}, {"func": "sum", "column": "qty"}, {"func": "min", "column": "amount"}, {"func": "max", "column": "amount"}], "group_by": ["region_name"]}, _sql("SELECT region_name, COUNT(customer_id) AS count_customer_id, CAST(SUM(qty) AS BIGINT) AS sum_qty, MIN(amount) AS min_amount, MAX(amount) AS max_amount FROM sales GROUP BY 1"))
QUERIES["q29_grouped_avg_events"] = lambda spark, folder: _asked({"aggregations": [{"func": "avg", "column": "value"}, {"func": "count"}], "group_by": ["event_type"]}, name="events")(spark, folder).withColumn("avg_value", F.round("avg_value", 6))
SQL["q29_grouped_avg_events"] = "SELECT event_type, ROUND(AVG(value), 6) AS avg_value, COUNT(*) AS row_count FROM events GROUP BY 1"
_add("q30_row_count", {"aggregations": [{"func": "count"}]}, _sql("SELECT COUNT(*) AS row_count FROM sales"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the time as a day, which both engines write alike."""
    return table(spark, folder, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


def q31_profile_basic(spark: SparkSession, folder: str) -> DataFrame:
    df = _orders(spark, folder)
    distinct = profiles.value_counts(df, _ORDER_COLUMNS).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return profiles.statistics(df, _ORDER_COLUMNS).join(distinct, "column_name").select("column_name", "row_count", "non_null", "min_value", "max_value", "distinct_count")


def q32_profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    df = sales(spark, folder, {"customer_id"})
    return profiles.statistics(df, ["qty", "amount", "customer_id"]).select("column_name", "negatives", "zeros", "positives", (F.col("whole") / F.col("non_null")).alias("integer_ratio"))


def q33_top_values(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.top_values(profiles.value_counts(sales(spark, folder, {"nation", "line_type", "segment"}), ["nation", "line_type", "segment", "part_id"]))


def q34_samples(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.samples(profiles.value_counts(_orders(spark, folder), _ORDER_COLUMNS))


_PAIRS = (["order_id", "part_id", "line_type"], ["order_date", "part_label", "is_product_line", "segment"])


def q35_functional_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    df = sales(spark, folder).withColumn("order_date", F.to_date("order_date"))
    return profiles.dependencies(df, *_PAIRS).withColumn("strength", F.round("strength", 9))


def q36_stored_amount_identity(spark: SparkSession, folder: str) -> DataFrame:
    return verify.amount_identity(sales(spark, folder, set()), "amount", "qty", "unit_price")


def q37_key_shares_time(spark: SparkSession, folder: str) -> DataFrame:
    return verify.key_times(sales(spark, folder, {"order_date"}), "order_id", "order_date")


def q38_returns_category(spark: SparkSession, folder: str) -> DataFrame:
    return verify.negative_share(sales(spark, folder), "qty", ["return_flag", "line_type", "segment"])


def q39_partition_values(spark: SparkSession, folder: str) -> DataFrame:
    return verify.flagged_values(sales(spark, folder, {"line_type"}), "line_type", "is_product_line")


def q40_coverage(spark: SparkSession, folder: str) -> DataFrame:
    df = sales(spark, folder, {"customer_id", "segment"})
    return profiles.statistics(df, ["customer_id", "segment", "amount"]).select("column_name", F.round(F.col("non_null") / F.col("row_count"), 6).alias("coverage"))


def _bound(spark: SparkSession, folder: str, raw: dict) -> tuple:
    model = model_of(spark, folder)
    plan = bind(model, Query.of(raw)).plan
    return sales(spark, folder, execute.needed(model, plan, disclosed=True)), model, plan


def q41_non_fact_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return execute.non_facts(*_bound(spark, folder, {"measures": ["net_revenue"]}))


def q42_growth_base_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    df, model, plan = _bound(spark, folder, {"measures": ["net_revenue"], "group_by": ["part_id"], "period_comparison": {"grain": "quarter", "period_a": "1998-Q1", "period_b": "1998-Q2"}})
    return execute.base_anomalies(execute.both_periods(df, model, plan, *execute.resolved(df, model, plan)))


def q43_window_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return execute.window_facts(*_bound(spark, folder, {"measures": ["net_revenue"], "time": {"last_n": 10, "grain": "year"}}))


def q50_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What a provider of roles gets to see of a profile: types, rates, and which columns determine which."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), periods.label(F.col("o_orderdate"), "quarter").alias("quarter"), "o_orderpriority")
    seen = evidence(profiles.profile(orders))
    rows = [(c, e["type"], e["null_rate"], e["distinct"], e["uniqueness"], e["top"][0][0], ",".join(e["samples"]), ",".join(e["determines"])) for c, e in seen.items()]
    return spark.createDataFrame(rows, "column_name string, type string, null_rate double, distinct_count long, uniqueness double, most string, samples string, determines string")


def q51_discovered(spark: SparkSession, folder: str) -> DataFrame:
    """The conventions that the sales show: returns, facts among lines, periods and their completeness, names of keys."""
    m = model_of(spark, folder)
    rows = [("returns", m.returns.kind, m.returns.column, ",".join(m.returns.values)), ("partition", m.partition.column, m.partition.flag, m.partition.fact_value), ("completeness", m.completeness.flag, m.completeness.period, None)]
    rows += [("period", c, None, None) for c in m.period_columns] + [("label", x.label, x.entity, None) for x in m.labels]
    return spark.createDataFrame(rows, "what string, first string, second string, value string")


#: One query for each way a verdict comes about, in the order of the checks, with its outcome.
MATRIX: list[tuple[str, dict, str]] = [
    ("concept", {"unmet_concepts": ["profit"]}, "refuse"), ("dimension", {"measures": ["net_revenue"], "unmet_dimensions": ["colour"]}, "clarify"), ("nothing", {}, "refuse"),
    ("function", {"aggregations": [{"func": "median", "column": "qty"}]}, "refuse"), ("column", {"aggregations": [{"func": "sum", "column": "weight"}]}, "refuse"), ("text_sum", {"aggregations": [{"func": "sum", "column": "nation"}]}, "refuse"),
    ("measure", {"measures": ["margin"]}, "refuse"), ("distinct", {"distinct_count_of": "ship"}, "refuse"), ("group", {"measures": ["net_revenue"], "group_by": ["colour"]}, "refuse"),
    ("operator", {"measures": ["net_revenue"], "filters": [{"column": "nation", "op": "like", "values": ["A"]}]}, "refuse"), ("between", {"measures": ["net_revenue"], "numeric_filters": [{"column": "qty", "op": "between", "value": 1}]}, "refuse"),
    ("value", {"measures": ["net_revenue"], "filters": [{"column": "region_name", "op": "in", "values": ["ATLANTIS"]}]}, "clarify"), ("top", {"measures": ["net_revenue"], "group_by": ["nation"], "top_k": {"measure": "units_sold"}}, "refuse"),
    ("note", {"measures": ["net_revenue"], "notes": ["needs clarification"]}, "clarify"), ("total", {"measures": ["net_revenue"]}, "answer"), ("partition", {"measures": ["net_revenue"], "group_by": ["part_id"]}, "answer_with_caveats"),
    ("complete", {"measures": ["net_revenue"], "group_by": ["nation"], "period_comparison": {"grain": "quarter"}}, "answer_with_caveats"), ("coverage", {"distinct_count_of": "customer"}, "answer_with_caveats"), ("grain", {"measures": ["net_revenue"], "time": {"grain": "month"}}, "answer"),
    ("casefold", {"measures": ["net_revenue"], "filters": [{"column": "region_name", "op": "in", "values": ["asia"]}]}, "answer"), ("text_number", {"measures": ["net_revenue"], "numeric_filters": [{"column": "nation", "op": "gt", "value": 1}]}, "refuse"), ("share", {"measures": ["order_count"], "group_by": ["nation"], "share_of_total": True}, "refuse"),
]


def q44_verdict_matrix(spark: SparkSession, folder: str) -> DataFrame:
    model = model_of(spark, folder)
    return spark.createDataFrame([(case, bind(model, Query.of(raw)).kind) for case, raw, _ in MATRIX], "case_name string, verdict string")


def _per_column(columns: list[str], body: str, source: str) -> str:
    return " UNION ALL ".join(body.format(c=c) for c in columns) if not source else f"WITH {source} " + " UNION ALL ".join(body.format(c=c) for c in columns)


_O = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders)"
for _f in (q31_profile_basic, q32_profile_numeric, q33_top_values, q34_samples, q35_functional_dependencies, q36_stored_amount_identity, q37_key_shares_time, q38_returns_category, q39_partition_values, q40_coverage, q41_non_fact_disclosure, q42_growth_base_anomalies, q43_window_disclosure, q44_verdict_matrix, q50_evidence, q51_discovered):
    QUERIES[_f.__name__] = _f
SQL |= {
    "q31_profile_basic": _per_column(_ORDER_COLUMNS, "SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT({c}) AS non_null, CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value, COUNT(DISTINCT {c}) AS distinct_count FROM o", _O),
    "q32_profile_numeric": _per_column(["qty", "amount", "customer_id"], "SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} < 0) AS negatives, COUNT(*) FILTER (WHERE {c} = 0) AS zeros, COUNT(*) FILTER (WHERE {c} > 0) AS positives, CAST(COUNT(*) FILTER (WHERE {c} = FLOOR({c})) AS DOUBLE) / COUNT({c}) AS integer_ratio FROM sales", SALES_SQL),
    "q33_top_values": _per_column(["nation", "line_type", "segment", "part_id"], "(SELECT '{c}' AS column_name, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, value) AS INT) AS position, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM sales WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, value LIMIT 10)", SALES_SQL),
    "q34_samples": _per_column(_ORDER_COLUMNS, "(SELECT '{c}' AS column_name, CAST(ROW_NUMBER() OVER (ORDER BY value) AS INT) AS position, value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM o WHERE {c} IS NOT NULL) ORDER BY value LIMIT 5)", _O),
    "q35_functional_dependencies": f"WITH {SALES_SQL} " + " UNION ALL ".join(f"SELECT '{d}' AS determinant, '{c}' AS dependent, ROUND(AVG(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END), 9) AS strength, COUNT(*) AS support FROM (SELECT {d}, COUNT(DISTINCT {c}) AS k FROM sales WHERE {d} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)" for d in _PAIRS[0] for c in _PAIRS[1]),
    "q36_stored_amount_identity": _sql("SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE ABS(amount - qty * unit_price) <= 0.01 + 1e-9) AS equal FROM sales WHERE amount IS NOT NULL AND qty IS NOT NULL AND unit_price IS NOT NULL"),
    "q37_key_shares_time": _sql("SELECT COUNT(*) AS support, COUNT(*) FILTER (WHERE k <= 1) AS single FROM (SELECT order_id, COUNT(DISTINCT order_date) AS k FROM sales GROUP BY 1 HAVING COUNT(*) > 1)"),
    "q38_returns_category": _per_column(["return_flag", "line_type", "segment"], "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n, COUNT(*) FILTER (WHERE qty < 0) AS negative FROM sales WHERE {c} IS NOT NULL GROUP BY 2", SALES_SQL),
    "q39_partition_values": _sql("SELECT line_type AS value, MAX(is_product_line) = 1 AS fact FROM sales GROUP BY 1"),
    "q40_coverage": _per_column(["customer_id", "segment", "amount"], "SELECT '{c}' AS column_name, ROUND(CAST(COUNT({c}) AS DOUBLE) / COUNT(*), 6) AS coverage FROM sales", SALES_SQL),
    "q41_non_fact_disclosure": _sql(f"SELECT * FROM (SELECT line_type AS value, {NET} AS amount FROM sales WHERE line_type <> 'STANDARD' GROUP BY 1) WHERE amount <> 0"),
    "q42_growth_base_anomalies": _sql("SELECT b.*, CASE WHEN period_a_value <= 0 THEN 'non_positive' ELSE 'small' END AS anomaly, CASE WHEN s > 0 THEN period_a_value / s END AS base_share FROM both_ b, (SELECT CAST(SUM(CAST(period_a_value AS DECIMAL(38,6))) AS DOUBLE) AS s FROM both_ WHERE period_b_value IS NOT NULL) WHERE period_b_value IS NOT NULL AND (period_a_value <= 0 OR s > 0 AND period_a_value < 0.01 * s)", _BOTH.replace("nation", "part_id").replace("WHERE is_complete_quarter", "WHERE line_type = 'STANDARD' AND is_complete_quarter").format(label=_label("quarter"), a="1998-Q1", b="1998-Q2", net=NET)),
    "q43_window_disclosure": _sql("SELECT CAST(MIN(order_date) AS DATE) AS first_day, CAST(MAX(order_date) AS DATE) AS last_day, CAST(MAX(order_date) - INTERVAL '10 years' AS DATE) AS window_start, CAST(MAX(order_date) - INTERVAL '10 years' AS DATE) <= CAST(MIN(order_date) AS DATE) AS whole FROM sales"),
    "q44_verdict_matrix": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{v}')" for c, _, v in MATRIX) + ") AS t(case_name, verdict)",
}


def _strength(determinant: str, dependent: str, source: str) -> str:
    """SQL of the share of a determinant's repeated values that have one value of the dependent."""
    return f"(SELECT AVG(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END) FROM (SELECT COUNT(DISTINCT {dependent}) AS k FROM {source} WHERE {determinant} IS NOT NULL GROUP BY {determinant} HAVING COUNT(*) > 1) HAVING COUNT(*) >= 5)"


_SEEN = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_orderdate": "date", "quarter": "text", "o_orderpriority": "text"}


def _evidence_sql() -> str:
    parts = []
    for c, kind in _SEEN.items():
        pairs = " UNION ALL ".join(f"SELECT '{d}' AS d WHERE {_strength(c, d, 'o')} >= 0.95" for d in _SEEN if d != c)
        parts.append(
            f"SELECT '{c}' AS column_name, '{kind}' AS type, ROUND(1 - COUNT({c}) / COUNT(*), 6) AS null_rate, COUNT(DISTINCT {c}) AS distinct_count, ROUND(COUNT(DISTINCT {c}) / COUNT({c}), 6) AS uniqueness,"
            f" (SELECT CAST({c} AS VARCHAR) FROM o WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS most,"
            f" (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM o WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples,"
            f" CASE WHEN COUNT(DISTINCT {c}) >= 2 AND COUNT(DISTINCT {c}) < 0.99 * COUNT({c}) THEN COALESCE((SELECT string_agg(d, ',' ORDER BY d) FROM ({pairs})), '') ELSE '' END AS determines FROM o"
        )
    return "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, o_orderpriority FROM orders) " + " UNION ALL ".join(parts)


def _discovered_sql() -> str:
    dimensions, flags = [c.column for c in CLAIMS if c.role == "dimension"], [c.column for c in CLAIMS if c.role == "flag"]
    kinds = " UNION ALL ".join(f"SELECT {k} AS place, '{c}' AS c, CAST({c} AS VARCHAR) AS value FROM sales WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) >= 5 AND COUNT(*) FILTER (WHERE qty < 0) >= 0.9 * COUNT(*)" for k, c in enumerate([*dimensions, *flags]))
    aligned = " UNION ALL ".join(f"SELECT {k} AS place, '{f}' AS f FROM sales HAVING AVG(CASE WHEN ({f} = 1) = (qty < 0) THEN 1.0 ELSE 0.0 END) >= 0.99" for k, f in enumerate(flags))
    period = " UNION ALL ".join(f"SELECT '{d}' AS d WHERE {_strength('order_date', d, 'sales')} >= 0.99" for d in dimensions)
    split = " UNION ALL ".join(f"SELECT '{d}' AS d, '{f}' AS f, (SELECT MIN({d}) FROM sales WHERE {f} = 1) AS value WHERE {_strength(d, f, 'sales')} >= 0.99 AND (SELECT COUNT(DISTINCT {d}) FROM sales WHERE {f} = 1) = 1 AND (SELECT COUNT(DISTINCT {d}) FROM sales) > 1" for d in dimensions for f in flags)
    whole = " UNION ALL ".join(f"SELECT {k} AS place, '{f}' AS f, '{d}' AS d WHERE {_strength(d, f, 'sales')} >= 0.99 AND (SELECT COUNT(DISTINCT {f}) FROM sales) > 1" for k, f in enumerate(flags) for d in dimensions)
    return _sql(
        "SELECT 'returns' AS what, CASE WHEN (SELECT COUNT(*) FROM aligned) > 0 THEN 'explicit_flag' ELSE 'explicit_category' END AS first, COALESCE((SELECT MIN_BY(f, place) FROM aligned), MIN_BY(c, place)) AS second, string_agg(value, ',' ORDER BY value) AS value FROM kinds WHERE place = (SELECT MIN(place) FROM kinds)"
        " UNION ALL SELECT 'partition', MIN_BY(d, d), MIN(f), MIN(value) FROM split WHERE d NOT IN (SELECT d FROM period) HAVING COUNT(*) > 0"
        " UNION ALL SELECT 'completeness', MIN_BY(f, place), MIN_BY(d, place), NULL FROM whole WHERE d IN (SELECT d FROM period) HAVING COUNT(*) > 0"
        f" UNION ALL SELECT 'period', d, NULL, NULL FROM period UNION ALL SELECT 'label', 'part_label', k, NULL FROM (SELECT 'part_id' AS k WHERE GREATEST({_strength('part_label', 'part_id', 'sales')}, {_strength('part_id', 'part_label', 'sales')}) >= 0.95 UNION ALL SELECT 'customer_id' WHERE GREATEST({_strength('part_label', 'customer_id', 'sales')}, {_strength('customer_id', 'part_label', 'sales')}) >= 0.95)",
        f"kinds AS ({kinds}), aligned AS ({aligned}), period AS ({period}), split AS ({split}), whole AS ({whole})",
    )


SQL |= {"q50_evidence": _evidence_sql(), "q51_discovered": _discovered_sql()}
