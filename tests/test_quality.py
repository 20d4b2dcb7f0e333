import math
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import quality


@pytest.fixture(scope="module")
def lines(spark):
    rows = [("f", f"d{k % 5}", None if k % 4 == 0 else float(k % 7) - 2, "x" if k % 3 else None, k) for k in range(200)]
    return spark.createDataFrame(rows, "feed string, load string, amount double, name string, value int")


def test_profile_from_counts(lines, tmp_path):
    p = quality.profile(quality.counted(lines, ["load"], ["amount", "name", "value"]), ["load"], {"name": "y"}, f"file://{tmp_path}/ranges")
    rows = lines.collect()
    for r in p.collect():
        mine = [x[r.column_name] for x in rows if x.load == r.load]
        full = [v for v in mine if v is not None]
        assert (r.row_count, r.null_count, r.distinct_count) == (len(mine), len(mine) - len(full), len(set(full)))
        n = Counter(full)
        assert math.isclose(r.entropy, -sum(k / len(full) * math.log2(k / len(full)) for k in n.values()), abs_tol=1e-9)
        if r.column_name == "amount":
            assert r.median == median(full) and r.negatives == sum(v < 0 for v in full) and (r.min_number, r.max_number) == (min(full), max(full))
        if r.column_name == "name":
            assert r.violations == len(full) and r.max_text == "x" and r.negatives is None


def test_signed_deltas(spark, lines, tmp_path):
    store = quality.ValueCounts(spark, f"file://{tmp_path}/counts", ["load"])
    store.add(lines, ["amount", "name"], "a")
    more = lines.filter("value < 50")
    store.add(more, ["amount", "name"], "b")
    store.add(more, ["amount", "name"], "b")  # a repeated job counts once
    store.add(more, ["amount", "name"], "c", sign=-1)
    want = {k: sorted(map(str, t.collect())) for k, t in quality.counted(lines, ["load"], ["amount", "name"]).items()}
    assert {k: sorted(map(str, t.collect())) for k, t in store.tables().items()} == want
    store.compact("whole")
    store.add(more, ["amount", "name"], "b")  # was taken in: counts no more
    store.add(more, ["amount", "name"], "d")
    store.add(more, ["amount", "name"], "e", sign=-1)
    store.compact("again")
    assert {p.name for p in (tmp_path / "counts" / "text").iterdir() if not p.name.startswith(".")} == {"again", "b"}
    assert {k: sorted(map(str, t.collect())) for k, t in store.tables().items()} == want


def test_departures(spark, tmp_path):
    rows = []
    for load in range(5):
        for k in range(40):
            broken = load == 4
            rows.append(("f", f"d{load}", None if broken and k < 10 else f"{'X' if broken and k < 12 else ''}{k:03}", -1.0 if broken and k < 10 else 1.0 + k % 9, 100.0 if broken else 10.0 + k))
    df = spark.createDataFrame(rows, "feed string, load string, code string, amount double, price double")
    formats = {"code": "[0-9]{3}"}
    p = quality.profile(quality.counted(df, ["load"], ["code", "amount", "price"]), ["load"], formats, f"file://{tmp_path}/ranges").withColumn("feed", F.lit("f"))
    found = {tuple(r) for r in quality.departures(p, "feed", "load", ["amount"], ["price"], ["price"], formats).collect()}
    assert found == {("d4", "code", "null_rate"), ("d4", "code", "pattern"), ("d4", "amount", "negatives"), ("d4", "price", "shift"), ("d4", "price", "constant")}
    alone = p.filter("load = 'd4'")
    assert {r.kind for r in quality.departures(alone, "feed", "load", ["amount"], ["price"], ["price"], formats).collect()} == {"pattern"}


def test_misstated_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("d", None, 1.5), ("d", None, -0.0)], "load string, name string, amount double")
    p = quality.profile(quality.counted(df, ["load"], ["name", "amount"]), ["load"])
    right = [("d", "name", 2, 0, None, None, None), ("d", "amount", 0, 2, "0.0", "1.50", 0), ("e", "amount", 9, 9, "9", "9", 9)]
    schema = "load string, column_name string, null_count long, distinct_count long, min_value string, max_value string, negatives long"
    assert quality.misstated(p, spark.createDataFrame(right, schema), "load").count() == 0
    wrong = [("d", "name", 2, 0, "x", None, None), ("d", "amount", 0, 2, "oops", "1.50", 0)]
    assert quality.misstated(p, spark.createDataFrame(wrong, schema), "load").count() == 2
    empty = quality.profile(quality.counted(df.limit(0), ["load"], ["name", "amount"]), ["load"], folder=f"file://{tmp_path}/ranges")
    assert empty.count() == 0


def test_medians(spark, tmp_path, monkeypatch):
    """Exact for any numbers, near to each other or far apart, with weights, ties, both signs and NaN; by either join."""
    rng = random.Random(3)
    groups = {"one": [7.0], "two": [1.0, 2.0], "close": [1 + k * 2**-40 for k in range(101)], "ties": [3.0] * 50 + [4.0] * 50, "far": [10.0**k for k in range(-300, 300, 7)], "zero": [-0.0, 0.0, 0.0, -5e-324], "mixed": [rng.gauss(0, 5) for _ in range(400)], "nan": [1.0, math.nan, math.nan]}
    rows = [(g, v, n) for g, values in groups.items() for v, n in Counter(values).items()] + [("none", None, 4), ("one", None, 9)]
    df = spark.createDataFrame(rows, "g string, value double, n long")
    for k, limit in enumerate((quality.BROADCAST_RANGES, 0)):
        monkeypatch.setattr(quality, "BROADCAST_RANGES", limit)
        got = {r.g: r.median for r in quality.medians(df, ["g"], f"file://{tmp_path}/{k}").collect()}
        assert set(got) == set(groups) and math.isnan(got.pop("nan"))
        assert got == {g: median(v) for g, v in groups.items() if g != "nan"}


def test_either_way_to_the_median(spark, lines, tmp_path, monkeypatch):
    counts = quality.counted(lines, ["load"], ["amount"])
    sorted_ = quality.profile(counts, ["load"], folder=f"file://{tmp_path}/a").orderBy("load").collect()
    assert not (tmp_path / "a").exists()
    monkeypatch.setattr(quality, "SORTED", 2)
    assert quality.profile(counts, ["load"], folder=f"file://{tmp_path}/b").orderBy("load").collect() == sorted_ and (tmp_path / "b").exists() and all(r.median is not None for r in sorted_)


def test_whole_numbers_are_compared_as_such(spark):
    df = spark.createDataFrame([("d", 2**53), ("d", 2**53 + 1)], "load string, n long")
    p = quality.profile(quality.counted(df, ["load"], ["n"]), ["load"])
    schema = "load string, column_name string, null_count long, distinct_count long, min_value string, max_value string, negatives long"
    for last, wrong in ((2**53 + 1, 0), (2**53, 1)):
        assert quality.misstated(p, spark.createDataFrame([("d", "n", 0, 2, f"{2**53}.0", str(last), 0)], schema), "load").count() == wrong


def test_found_from_maintained_counts(spark, data, monkeypatch):
    from ledgerlight import loads

    kept = []

    class Kept(quality.ValueCounts):
        def tables(self):
            kept.append(self)
            return super().tables()

    monkeypatch.setattr(quality, "ValueCounts", Kept)
    found = {tuple(r) for r in loads.p4_found(spark, data).collect()}
    assert len(kept) == 1 and all(kept[0]._parts(k) for k in ("text", "integer", "decimal", "moment"))
    # a load that is sent again and withdrawn again leaves the counts as they were
    lines = spark.read.parquet(f"{data}/retail_lines.parquet").withColumn("quantity", F.col("quantity").cast("double"))
    columns = [c for c in lines.columns if c not in loads.LOAD_COLUMNS]
    before = {k: t.count() for k, t in kept[0].tables().items()}
    kept[0].add(lines, columns, "again")
    kept[0].add(lines, columns, "withdrawn", sign=-1)
    assert {k: t.count() for k, t in kept[0].tables().items()} == before and found
