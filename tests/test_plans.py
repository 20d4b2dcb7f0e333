import pytest

from ledgerlight.evaluation import suite
from ledgerlight.functions import periods
from ledgerlight.operators import profile as profiles
from ledgerlight.plans.binder import bind
from ledgerlight.plans.build import build
from ledgerlight.plans.execute import Answer, ask
from ledgerlight.plans.model import Claim, Model
from ledgerlight.plans.propose import Missing, Replay, heuristic, proposed
from ledgerlight.plans.query import Query, bounds, merge
from ledgerlight.sales import MATRIX, model_of

CLAIMS = [Claim("sku", "entity_key", "product"), Claim("kind", "dimension"), Claim("is_prod", "flag"), Claim("qty", "additive_quantity"), Claim("price", "monetary_rate"), Claim("inv", "transaction_key"), Claim("at", "event_time"), Claim("who", "entity_key", "customer")]


@pytest.fixture(scope="module")
def shop(spark):
    rows = []
    for p in range(6):
        rows += [(f"P{p}", "PRODUCT", 1, 2 + k, 1.5 + p, f"I{p}{k}", f"2024-0{k + 1}-05", None if p == 5 else f"C{p % 3}") for k in range(3)]
    for n, kind in enumerate(["POSTAGE", "FEE", "CARRIAGE", "SAMPLE"]):
        rows += [(f"X{n}", kind, 0, 1, (4 - n) * 1000.0, f"I{n}{k}", f"2024-0{k + 1}-05", f"C{n % 3}") for k in range(3)]
    rows += [("P0", "PRODUCT", 1, 1, 9.0, "I01", "2024-02-05", "C0"), ("P1", "PRODUCT", 1, 1, 9.0, "I01", "2024-02-05", "C0")]
    return spark.createDataFrame(rows, "sku string, kind string, is_prod int, qty long, price double, inv string, at string, who string").selectExpr("*", "cast(at as timestamp_ntz) t").drop("at").withColumnRenamed("t", "at")


@pytest.fixture(scope="module")
def model(shop):
    return build(shop, "shop", CLAIMS)


def test_model(model):
    assert model.partition.column == "kind" and model.partition.fact_value == "PRODUCT"
    assert model.returns.kind == "none" and model.values["kind"].exhaustive
    assert Model.from_json(model.to_json()).to_json() == model.to_json()


def test_product_ranking_counts_facts_only(shop, model):
    out = ask(shop, model, Query.of({"measures": ["net_revenue"], "group_by": ["sku"], "top_k": {"measure": "net_revenue", "k": 2}}))
    assert [r["sku"] for r in out.rows] == ["P5", "P4"] and out.kind == "answer_with_caveats"
    total = ask(shop, model, Query.of({"measures": ["net_revenue"]}))
    told = next(c.text for c in total.caveats if c.kind == "partition")
    assert "+30,000.00 of 4 kinds" in told and "POSTAGE +12,000.00, FEE +9,000.00, CARRIAGE +6,000.00, +1 more" in told


def test_frequency_leaves_out_unknown_entities(shop, model):
    out = ask(shop, model, Query.of({"frequency": {"entity": "customer", "count_of": "transaction_key", "op": "gte", "n": 1}}))
    assert out.rows[0]["entity_count"] == 3 and out.rows[0]["share"] == 1.0


def test_basket(shop, model):
    out = ask(shop, model, Query.of({"measures": ["basket_cooccurrence"]}))
    assert {"product_a": "P0", "product_b": "P1", "pair_count": 1} in out.rows
    assert not any(r["product_a"].startswith("X") for r in out.rows)


def test_comparison(shop, model):
    q = {"measures": ["units_sold"], "period_comparison": {"grain": "month"}, "group_by": ["kind"]}
    out = ask(shop, model, Query.of(q))
    assert out.rows[0]["period_a_value"] is not None and any(c.kind == "completeness" for c in out.caveats)
    assert ask(shop, model, Query.of(q | {"period_comparison": {"grain": "year"}})).kind == "clarify"
    assert ask(shop, model, Query.of(q | {"period_comparison": {"grain": "month", "period_a": "2020-01", "period_b": "2024-02"}})).kind == "clarify"


def test_empty_isn_t_zero(shop, model):
    out = ask(shop, model, Query.of({"measures": ["net_revenue"], "time": {"named_period": "1999"}}))
    assert any(c.kind == "empty" for c in out.caveats)
    none = ask(shop, model, Query.of({"measures": ["units_sold"], "filters": [{"column": "who", "op": "in", "values": []}]}))
    assert none.rows == [{"units_sold": None}]


def test_rolling_window_takes_in_all(shop, model):
    out = ask(shop, model, Query.of({"measures": ["units_sold"], "time": {"last_n": 5, "grain": "year"}}))
    assert any("takes in all" in c.text for c in out.caveats) and sum(r["units_sold"] for r in out.rows) == shop.selectExpr("sum(qty)").collect()[0][0]


def test_verdicts(spark, data):
    model = model_of(spark, data)
    assert [(c, bind(model, Query.of(raw)).kind) for c, raw, _ in MATRIX] == [(c, v) for c, _, v in MATRIX]


def test_ambiguous_revenue(spark):
    df = spark.createDataFrame([(k, 2 + k % 5, 1.5 + k % 7, (2 + k % 5) * (1.5 + k % 7), (2 + k % 5) * (1.5 + k % 7) * 1.05) for k in range(200)], "inv long, qty long, price double, cogs double, total double")
    claims = [Claim("qty", "additive_quantity"), Claim("price", "monetary_rate"), Claim("cogs", "monetary_amount"), Claim("total", "monetary_amount")]
    m = build(df, claims=claims)
    assert (m.binding("cogs").status, m.binding("total").status) == ("verified", "unverified")
    assert bind(m, Query.of({"measures": ["net_revenue"]})).kind == "clarify"


def test_returns(spark):
    from ledgerlight.operators.verify import returns

    rows = [(f"{'C' if k % 5 == 0 else ''}{k}", "refund" if k % 5 == 0 else "charge", int(k % 5 == 0), -1 if k % 5 == 0 else 2) for k in range(50)]
    df = spark.createDataFrame(rows, "key string, kind string, flag int, qty int")
    assert returns(df, "qty", "key", ["flag"], ["kind"]).kind == "explicit_flag"
    assert (r := returns(df, "qty", "key", ["kind"], [])).kind == "explicit_category" and r.values == ["refund"]
    assert returns(df, "qty", "key", [], []).kind == "derived_key_prefix"
    assert returns(df, "qty", None, [], []).kind == "derived_negative_quantity"
    assert returns(df.filter("qty > 0"), "qty", "key", ["flag"], []).kind == "none"


def test_dependencies(spark):
    rows = [(k // 2, "a" if k // 2 != 3 or k % 2 else "b", None, k) for k in range(40)]
    df = spark.createDataFrame(rows, "inv long, day string, empty string, line long")
    got = {(r.determinant, r.dependent): (r.strength, r.support) for r in profiles.dependencies(df, ["inv"], ["day", "empty", "line"]).collect()}
    assert got == {("inv", "day"): (0.95, 20), ("inv", "empty"): (1.0, 20), ("inv", "line"): (0.0, 20)}
    p = profiles.profile(df)
    assert p.columns["line"].distinct == 40 and p.columns["empty"].null_rate == 1.0 and p.columns["day"].top == [("a", 39), ("b", 1)]
    assert profiles.profile(df.limit(0)).row_count == 0


def test_periods(spark):
    df = spark.sql("select explode(sequence(date'2018-01-01', date'2026-12-31', interval 1 day)) d").selectExpr("cast(d as timestamp_ntz) t")
    for grain, fmt in (("week", "%Y-W%W"), ("month", "%Y-%m"), ("day", "%Y-%m-%d"), ("year", "%Y")):
        for r in df.select("t", periods.label(df.t, grain).alias("p")).collect():
            assert r.p == r.t.strftime(fmt)
            a, b = bounds(r.p)
            assert a <= r.t.date() < b
    assert bounds("2024-Q4")[1].isoformat() == "2025-01-01"


def test_merge():
    q = Query.of({"measures": ["net_revenue"], "notes": ["needs clarification"]})
    assert merge(q, {"group_by": ["nation"]}).notes == [] and merge(q, {}).notes[-1].startswith("The follow-up")


def test_proposals(spark, tmp_path):
    rows = [(f"O{k // 3}", f"2024-01-{1 + k // 3 % 28:02}", "abcde"[k % 5], 2 + k % 4, 1.25 + k % 7, k % 2 == 0) for k in range(90)]
    df = spark.createDataFrame(rows, "ref string, day string, sku string, units long, price double, paid boolean").selectExpr("*", "cast(day as date) on_day").drop("day")
    p = profiles.profile(df)
    roles = {c.column: c.role for c in heuristic(p)}
    assert roles == {"ref": "transaction_key", "on_day": "event_time", "sku": "dimension", "units": "additive_quantity", "price": "monetary_rate", "paid": "flag"}
    assert suite.same_roles(df)
    asked = []
    live = Replay(tmp_path, lambda request: asked.append(1) or [{"column": "sku", "role": "ignore"}, {"column": "nope", "role": "flag"}])
    assert [c.role for c in proposed(p, live)] == ["ignore"] == [c.role for c in proposed(p, Replay(tmp_path))] and len(asked) == 1
    with pytest.raises(Missing):
        Replay(tmp_path)({"other": 1})


def test_suite_and_ablation(shop, model):
    cases = [suite.Case(c, raw, kind) for c, raw, kind in [("a", {"measures": ["net_revenue"]}, "answer_with_caveats"), ("b", {"unmet_concepts": ["x"]}, "refuse"), ("c", {"measures": ["units_sold"], "group_by": ["kind"]}, "answer")]]
    report = suite.run(shop, model, cases)
    assert not report.wrong and report.false_answer_rate == 0.0
    query = {"measures": ["net_revenue"], "group_by": ["sku"]}
    assert {c for c, kind in suite.ablation(shop, [c for c in CLAIMS if c.column in ("sku", "price", "qty", "who")], query).items() if kind == "refuse"} == {"sku", "price", "qty"}
    assert isinstance(ask(shop, model, Query.of(query)), Answer)


def test_no_test_column_is_known_to_the_engine():
    assert suite.named_literals("ledgerlight/plans", ["order_ref", "l_quantity", "invoice_no", "is_prod", "sku"]) == []


def test_text_times(spark):
    df = spark.createDataFrame([("03/13/2011 10:00",), ("1/2/11",), ("x",), (None,)], "d string")
    assert [str(r.t) for r in df.select(periods.parsed(df.d, "month_first").alias("t")).collect()] == ["2011-03-13 10:00:00", "2011-01-02 00:00:00", "None", "None"]


def test_demonstration(spark):
    from ledgerlight.evaluation.__main__ import run

    report, known = run(spark)
    assert not report.wrong and not known and report.false_answer_rate == 0.0 and sum(report.matrix.values()) == 5


def test_what_is_told_must_be_done(shop, model, monkeypatch):
    from ledgerlight.plans import execute

    q = Query.of({"measures": ["net_revenue"], "group_by": ["sku"]})
    assert isinstance(ask(shop, model, q), Answer)
    monkeypatch.setattr(execute, "predicates", lambda *x: [])
    with pytest.raises(execute.ClaimError, match="partition"):
        ask(shop, model, q)
    with pytest.raises(execute.ClaimError, match="window"):
        ask(shop, model, Query.of({"measures": ["units_sold"], "time": {"named_period": "2024-01"}}))


def test_answers_are_paged(shop, model, monkeypatch):
    from ledgerlight.plans import execute

    monkeypatch.setattr(execute, "PAGE", 2)
    out = ask(shop, model, Query.of({"measures": ["units_sold"], "group_by": ["kind"]}))
    assert len(out.rows) == 2 and any(c.kind == "page" for c in out.caveats) and out.frame.count() == 5


def test_poor_bases_are_named(spark):
    rows = [(g, f"2024-0{m}-03", float(v)) for g, a, b in (("big", 900, 1000), ("tiny", 1, 50), ("debt", -20, 5), ("gone", 40, None), ("new", None, 7)) for m, v in ((1, a), (2, b)) if v is not None]
    df = spark.createDataFrame(rows, "shop string, day string, amount double").selectExpr("shop", "cast(day as timestamp_ntz) day", "amount")
    m = build(df, claims=[Claim("shop", "dimension"), Claim("day", "event_time"), Claim("amount", "monetary_amount")])
    out = ask(df, m, Query.of({"measures": ["net_revenue"], "group_by": ["shop"], "period_comparison": {"grain": "month", "period_a": "2024-01", "period_b": "2024-02"}}))
    told = {c.text for c in out.caveats if c.kind == "base"}
    assert any("debt -20.00" in t and t.startswith("1 groups have a non-positive base in 2024-01") for t in told) and any("tiny 1.00 (0.114% of 2024-01)" in t for t in told) and len(told) == 2
    assert any(c.kind == "as_reported" for c in out.assumptions)


def test_determinants_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(profiles, "GROUPS", 10)
    df = spark.range(90).selectExpr("id div 2 inv", "id div 4 day", "id % 3 kind", "id % 5 other")
    with_limit = {(d.determinant, d.dependent) for d in profiles.profile(df).dependencies}
    assert ("inv", "day") in with_limit
    monkeypatch.setattr(profiles, "GROUPS", 1000)
    assert {(d.determinant, d.dependent) for d in profiles.profile(df).dependencies} == with_limit
