import random
from collections import Counter

from ledgerlight.llm import frequent

SCHEMA = "column_name string, item_value string, item_count long, total string, cell int"


def exact(rows, share):
    n, t = Counter(), Counter()
    for c, v, k, *_ in rows:
        if v is not None:
            n[c, v] += k or 0
            t[c] += k or 0
    return {(c, v, k) for (c, v), k in n.items() if k >= share * t[c] and t[c] > 0}


def test_against_counting(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"v{int(rng.paretovariate(0.7))}" if rng.random() < 0.9 else None, rng.choice([1, 2, 7, None]), "x", 1) for _ in range(20_000)]
    rows += [("a", "V1", 5, "x", 1), ("a", " v1", 5, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for width in (8, 64, 4096):  # even where most cells are shared
        out = frequent.frequent(df, 0.01, width=width).collect()
        assert {(r.column_name, r.item_value, r.item_count) for r in out} == exact(rows, 0.01)
        assert all(r.lower <= r.item_count <= r.upper for r in out if r.lower is not None)


def test_hidden_values_are_counted(spark):
    # four equal values in two cells a row: votes cancel, and no cell names them all
    rows = [("a", f"v{k % 40}", 1, "x", 1) for k in range(4000)]
    out = frequent.frequent(spark.createDataFrame(rows, SCHEMA), 0.01, width=2).collect()
    assert len(out) == 40 and any(r.lower is None for r in out)


def test_merge_in_any_order(spark):
    rows = [("a", f"v{k % 13 if k % 3 else 0}", 1 + k % 4, "x", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [frequent.sketch(df.filter(f"item_count = {k}")) for k in (1, 2, 3, 4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    true = Counter()
    for _, v, k, *_ in rows:
        true[v] += k
    for r in frequent.merge(whole).filter("row >= 0").collect():
        assert r.surplus <= true[r.candidate] <= (r.total + r.surplus) / 2


def test_edges(spark):
    assert frequent.frequent(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "x", 3, "x", 1), (None, "y" * 100_000, 3, "x", 1), ("b", "neg", -5, "x", 1), ("b", "pos", 6, "x", 1), ("c", "zero", 0, "x", 1), ("d", None, 4, "x", 1)]
    out = {(r.column_name, r.item_value[:3], r.item_count) for r in frequent.frequent(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    assert out == {(None, "x", 3), (None, "yyy", 3), ("b", "pos", 6)}
