import math
from datetime import date, datetime

import pytest

from ledgerlight.llm import distinct


@pytest.mark.parametrize("n", [1, 10, 3000, 40_000])
def test_estimate_within_its_error(spark, n):
    df = spark.range(3 * n).selectExpr("'g' g", f"cast(id % {n} as string) v", "id % 4 part")
    r = distinct.distinct(distinct.bitmaps(df, ["g", "part"], "v"), ["g"]).collect()[0]
    assert abs(r.estimate - n) <= max(r.margin, 1e-6) and r.rows == 3 * n
    small = distinct.distinct(distinct.bitmaps(df, ["g", "part"], "v", 1 << 14), ["g"], 1 << 14).collect()[0]
    assert abs(small.estimate - n) <= max(small.margin, 1e-6) + 1


def test_sizing():
    for n, target in ((1000, 0.01), (10**7, 0.01), (10**9, 0.02)):
        bits = distinct.bits_for(n, target)
        assert distinct.error(n, bits) <= target and (bits == 64 or distinct.error(n, bits // 2) > target)


def test_union_is_of_parts(spark):
    df = spark.range(500).selectExpr("'g' g", "cast(id % 77 as string) v", "id % 5 load")
    whole = distinct.bitmaps(df, ["g"], "v").collect()
    parts = distinct.merged(distinct.bitmaps(df, ["g", "load"], "v"), ["g"]).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    assert distinct.bitmaps(df.filter("v is null"), ["g"], "v").count() == 0


def test_repeated(spark):
    df = spark.range(9000).selectExpr("'g' g", "case when id < 3000 then cast(id as string) when id < 8000 then cast(3000 + id % 1000 as string) end v")
    r = distinct.repeated(df, ["g"], "v").collect()[0]
    assert abs(r.estimate - 1000) <= r.margin
    tight = distinct.repeated(df, ["g"], "v", 1 << 13).collect()[0]
    assert abs(tight.estimate - 1000) <= tight.margin and math.isfinite(tight.margin)


def test_wrong_figures(spark):
    at = datetime(2024, 5, 1, 10)
    lines = spark.createDataFrame([("f", "d", k % 2, at if k % 2 else None, None if k % 10 == 0 else "C", "P", f"c{k % 20}" if k % 4 else None, 1) for k in range(400)], "feed_id string, dataset_id string, load_no int, invoice_date timestamp_ntz, country string, line_type string, customer_id string, cell int")
    schema = "rollup_id long, feed_id string, sale_date date, country string, line_type string, column_name string, distinct_count long, uniqueness_ratio double"
    rows = [(1, "f", None, None, None, "customer_id", 15, 0.05), (2, "f", None, None, None, "customer_id", 18, 0.05), (3, "f", date(2024, 5, 1), None, None, "customer_id", 10, 0.05), (4, "f", None, None, None, "customer_id", 15, 0.08), (5, "f", None, "X", None, "customer_id", 3, 0.1), (6, "f", None, None, "P", "customer_id", None, None), (7, "f", None, None, None, "nothing", 3, 0.1), (8, None, None, None, None, "customer_id", 3, 0.1)]
    got = sorted(r[0] for r in distinct.wrong_rollups(lines, spark.createDataFrame(rows, schema)).collect())
    assert got == [2, 4]
    fds = spark.createDataFrame([(1, "f", "customer_id", 15), (2, "f", "customer_id", 12), (3, "g", "customer_id", 1), (4, "g", "customer_id", 0), (5, "f", "nothing", 1), (6, "f", "customer_id", None)], "fd_id long, feed_id string, determinant string, support long")
    assert sorted(r[0] for r in distinct.wrong_dependencies(lines, fds).collect()) == [2, 3]
    assert distinct.wrong_rollups(lines.limit(0), spark.createDataFrame(rows, schema)).count() == 0
    assert distinct.wrong_rollups(lines, spark.createDataFrame([], schema)).count() == 0


def test_full_bitmaps_have_no_margin(spark):
    df = spark.range(4000).selectExpr("'g' g", "cast(id as string) v", "0 part")
    assert distinct.distinct(distinct.bitmaps(df, ["g", "part"], "v", 64), ["g"], 64).collect()[0].margin is None
    assert distinct.repeated(df, ["g"], "v", 64).collect()[0].margin is None
    lines = df.selectExpr("g feed_id", "0 load_no", "cast(null as timestamp_ntz) invoice_date", "'C' country", "'P' line_type", "v customer_id")
    rollups = spark.createDataFrame([(1, "g", None, None, None, "customer_id", 300, 1.0), (2, "g", None, None, None, "customer_id", 4000, 1.0), (3, "g", None, None, None, "customer_id", None, None)], "rollup_id long, feed_id string, sale_date date, country string, line_type string, column_name string, distinct_count long, uniqueness_ratio double")
    assert [r[0] for r in distinct.wrong_rollups(lines, rollups, 64).collect()] == [1]


def test_bitmaps_are_sized_by_the_largest_group(spark):
    lines = spark.range(3000).selectExpr("if(id < 2900, 'g', 'h') feed_id")
    bits = distinct.sized(lines, "feed_id", 0.01)
    assert bits == distinct.bits_for(2900, 0.01) and distinct.error(2900, bits) <= 0.01
    assert distinct.sized(lines.limit(0), "feed_id") >= 64 and distinct.bits_for(100_000_000, distinct.TARGET) > distinct.BITS


def test_more_values_than_bits(spark):
    """Three values a bit: the estimate still lies within its margin, and statements far off or right are told without counting."""
    df = spark.range(40_000).selectExpr("'g' feed_id", "cast(id % 24000 as string) customer_id", "id % 3 load_no", "cast(null as timestamp_ntz) invoice_date", "'C' country", "'P' line_type")
    r = distinct.distinct(distinct.bitmaps(df, ["feed_id", "load_no"], "customer_id", 1 << 13), ["feed_id"], 1 << 13).collect()[0]
    assert abs(r.estimate - 24_000) <= r.margin < 24_000 * 0.1
    rollups = spark.createDataFrame([(k, "g", None, None, None, "customer_id", n, n / 40_000) for k, n in enumerate((24_000, 26_401, 26_399, 21_599, 12_000, 48_000))], "rollup_id long, feed_id string, sale_date date, country string, line_type string, column_name string, distinct_count long, uniqueness_ratio double")
    assert sorted(x[0] for x in distinct.wrong_rollups(df, rollups, 1 << 13).collect()) == [1, 3, 4, 5]


def test_only_open_cells_are_counted(spark, monkeypatch):
    """The verdict comes from the bitmaps where their error allows it."""
    counts = spark.createDataFrame([(1, 1000.0, 50.0, 1200), (2, 1000.0, None, 1200), (3, 0.0, 0.0, 0)], "k int, estimate double, margin double, rows long")
    for stated, want in ((1000, [(1, False, False), (2, False, True)]), (1120, [(1, False, True), (2, False, True)]), (1160, [(1, True, False), (2, False, True)]), (500, [(1, True, False), (2, False, True)]), (None, [(1, False, False), (2, False, False)])):
        off, left_open = distinct._verdict(distinct.F.lit(stated).cast("double"), distinct.F.col("rows"))
        assert [tuple(r) for r in counts.filter("k < 3").select("k", off, left_open).orderBy("k").collect()] == want


def test_counts_lie_within_their_margins(spark, data):
    from ledgerlight.llm import queries

    got = {r.rollup_id: r for r in queries.p2_counts(spark, data).collect()}
    con = __import__("duckdb").connect()
    rows = con.execute(f"""SELECT rollup_id, CASE p.column_name WHEN 'invoice_no' THEN COUNT(DISTINCT invoice_no) WHEN 'customer_id' THEN COUNT(DISTINCT customer_id) WHEN 'stock_code' THEN COUNT(DISTINCT stock_code) END AS t
        FROM '{data}/rollup_profiles.parquet' p JOIN '{data}/retail_lines.parquet' l ON l.feed_id = p.feed_id AND (sale_date IS NULL OR CAST(invoice_date AS DATE) = sale_date) AND (p.country IS NULL OR p.country = l.country) AND (p.line_type IS NULL OR p.line_type = l.line_type)
        GROUP BY rollup_id, p.column_name""").fetchall()
    assert {k for k, t in rows if t} == set(got)
    assert all(abs(got[k].estimate - t) <= got[k].margin for k, t in rows if t)
