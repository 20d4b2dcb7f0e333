"""Tests of claims against the data, and the conventions that the data show. Each is one small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.periods import parsed
from ledgerlight.operators.profile import Profile, quoted
from ledgerlight.plans.model import NUMERIC, Check, Completeness, Label, Partition, Returns

#: Shares and numbers of rows from which a rule counts as holding.
HOLDS, IDENTITY, SIGN, LABEL, SUPPORT, CENT = 0.99, 0.99, 0.9, 0.95, 5, 0.01
#: A column whose values that go with negative quantities are more than these is no list of kinds of return.
LISTED = 1000


def amount_identity(df: DataFrame, amount: str, quantity: str, rate: str) -> DataFrame:
    """rows with all three, and those where the amount is quantity times rate to a cent: one row (n, equal)."""
    a, q, r = quoted(amount), quoted(quantity), quoted(rate)
    there = a.isNotNull() & q.isNotNull() & r.isNotNull()
    return df.agg(F.count_if(there).alias("n"), F.count_if(there & (F.abs(a - q * r) <= CENT + 1e-9)).alias("equal"))


def key_times(df: DataFrame, key: str, time: str, order: str | None = None) -> DataFrame:
    """Keys of several rows, and those of them that have one time at most: one row (support, single)."""
    t = parsed(quoted(time), order) if order else quoted(time)
    groups = df.filter(quoted(key).isNotNull()).groupBy(quoted(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("a"), F.max(t).alias("b")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("support"), F.count_if(F.coalesce(F.col("a") == F.col("b"), F.lit(True))).alias("single"))


def check_amount(df: DataFrame, amount: str, quantity: str, rate: str) -> Check:
    r = amount_identity(df, amount, quantity, rate).collect()[0]
    share = r.equal / r.n if r.n else 0.0
    return Check("stored_amount_identity", r.n > 0 and share >= IDENTITY, share, r.n, f"{amount} = {quantity} * {rate}", confirming=True)


def check_key(df: DataFrame, key: str, time: str, order: str | None = None) -> Check:
    r = key_times(df, key, time, order).collect()[0]
    share = r.single / r.support if r.support else 0.0
    return Check("transaction_key_shares_time", r.support >= SUPPORT and share >= HOLDS, share, r.support)


def check_numeric(profile: Profile, column: str, name: str) -> Check:
    return Check(name, profile.columns[column].type in NUMERIC)


def date_orders(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Order of day and month in each text column: iso, day_first, month_first, ambiguous or not_a_date; over all rows, in one pass."""
    if not columns:
        return {}
    pattern = r"^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})"
    parts = []
    for k, c in enumerate(columns):
        first, second = (F.regexp_extract(quoted(c), pattern, g).try_cast("int") for g in (1, 2))
        date = first.isNotNull()
        parts += [F.count(quoted(c)).alias(f"n{k}"), F.count_if(date).alias(f"d{k}"), F.count_if(date & (first > 31)).alias(f"i{k}"), F.count_if(date & first.between(13, 31)).alias(f"a{k}"), F.count_if(date & second.between(13, 31)).alias(f"b{k}")]
    r = df.agg(*parts).collect()[0]
    out = {}
    for k, c in enumerate(columns):
        n, d, iso, a, b = (r[f"{x}{k}"] for x in "ndiab")
        if not n or d < HOLDS * n:
            out[c] = "not_a_date"
        elif iso == d:
            out[c] = "iso"
        else:
            out[c] = "ambiguous" if bool(a) == bool(b) else "day_first" if a else "month_first"
    return out


def check_time(df: DataFrame, profile: Profile, column: str, order: str | None) -> Check:
    kind = profile.columns[column].type
    if kind in ("date", "timestamp"):
        return Check("event_time_temporal", True, 1.0)
    if kind != "text" or order in (None, "not_a_date"):
        return Check("event_time_temporal", False, 0.0)
    r = df.agg(F.count(quoted(column)).alias("n"), F.count(parsed(quoted(column), order)).alias("read")).collect()[0]
    share = r.read / r.n if r.n else 0.0
    return Check("event_time_temporal", share >= HOLDS, share, r.n, order)


def latest(df: DataFrame, profile: Profile, time: str | None, order: str | None) -> str | None:
    """The latest time of a table, as text; from the profile unless times are text."""
    if time is None or order is None:
        return time and profile.columns[time].max
    r = df.agg(F.max(parsed(quoted(time), order)).cast("string").alias("t")).collect()[0]
    return r.t


def negative_share(df: DataFrame, quantity: str, columns: list[str], prefix_of: str | None = None) -> DataFrame:
    """Of each value of `columns`, and of each first character of `prefix_of`: column_name, value, n, negative (rows with a negative quantity)."""
    pairs = [F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns]
    if prefix_of:
        pairs.append(F.struct(F.lit("").alias("column_name"), F.left(quoted(prefix_of).cast("string"), F.lit(1)).alias("value")))
    rows = df.select(quoted(quantity).alias("__q"), F.inline(F.array(*pairs)))
    return rows.filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__q") < 0).alias("negative"))


def returns(df: DataFrame, quantity: str | None, key: str | None, flags: list[str], dimensions: list[str]) -> Returns:
    """How returns show: a flag that goes with negative quantities, else values of a column that do, else first characters of the key, else the sign alone."""
    if quantity is None:
        return Returns()
    q = quoted(quantity)
    aligned = [F.avg(((quoted(f).cast("string").try_cast("int") == 1) == (q < 0)).cast("int")).alias(f"f{k}") for k, f in enumerate(flags)]
    r = df.agg(F.count_if(q < 0).alias("negative"), *aligned).collect()[0]
    if not r.negative:
        return Returns()
    for k, f in enumerate(flags):
        if (share := r[f"f{k}"]) is not None and share >= HOLDS:
            return Returns("explicit_flag", f, ["1"], share)
    columns = list(dict.fromkeys([*dimensions, *flags]))
    if not columns and not key:
        return Returns("derived_negative_quantity", quantity, [], 0.5)
    # one row a column: how many values go with negative quantities, and, of few, which
    shares = negative_share(df, quantity, columns, key).filter((F.col("n") >= SUPPORT) & (F.col("negative") >= SIGN * F.col("n")))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    few = shares.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= LISTED + 1)
    found = few.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("values"), F.min(F.col("negative") / F.col("n")).alias("share"), F.max_by(F.struct("value", (F.col("negative") / F.col("n")).alias("share")), -F.col("position")).alias("first"))
    mine = {x.column_name: x for x in found.collect()}
    for c in columns:
        if (x := mine.get(c)) and len(x["values"]) <= LISTED:
            return Returns("explicit_category", c, x["values"], x.share)
    if x := mine.get(""):
        return Returns("derived_key_prefix", key, [x["first"].value], x["first"].share)
    return Returns("derived_negative_quantity", quantity, [], 0.5)


def period_columns(profile: Profile, time: str | None, dimensions: list[str]) -> list[str]:
    """Dimensions that the time determines."""
    return [d for d in dimensions if time and (e := profile.strength(time, d)) and e.strength >= HOLDS]


def flagged_values(df: DataFrame, dimension: str, flag: str) -> DataFrame:
    """Each value of a dimension, and whether its flag is ever set: value, fact."""
    return df.filter(quoted(dimension).isNotNull()).groupBy(quoted(dimension).cast("string").alias("value")).agg((F.coalesce(F.max(quoted(flag).cast("string").try_cast("int")), F.lit(0)) == 1).alias("fact"))


def partition(df: DataFrame, profile: Profile, dimensions: list[str], flags: list[str], time_columns: list[str]) -> Partition | None:
    """The dimension that a flag splits into facts and others; one with a single fact value first."""
    found = []
    for d in dimensions:
        if d in time_columns:
            continue
        for f in flags:
            if (e := profile.strength(d, f)) and e.strength >= HOLDS:
                r = flagged_values(df, d, f).agg(F.count(F.lit(1)).alias("all"), F.count_if("fact").alias("facts"), F.min(F.when(F.col("fact"), F.col("value"))).alias("value")).collect()[0]
                if 0 < r.facts < r["all"]:
                    found.append(Partition(d, r.value if r.facts == 1 else None, f))
    return min(found, key=lambda p: p.fact_value is None, default=None)


def labels(profile: Profile, descriptions: list[str], keys: list[str]) -> list[Label]:
    """Descriptions that stand for a key, by a dependency in either direction."""
    out = []
    for d in descriptions:
        for k in keys:
            edges = [e for e in (profile.strength(d, k), profile.strength(k, d)) if e and e.strength >= LABEL]
            if edges:
                best = max(edges, key=lambda e: e.strength)
                out.append(Label(d, k, best.strength, best.support))
    return out


def completeness(profile: Profile, flags: list[str], time_columns: list[str]) -> Completeness | None:
    """The flag, not constant, that a period column determines."""
    for f in flags:
        for p in time_columns:
            if profile.columns[f].distinct > 1 and (e := profile.strength(p, f)) and e.strength >= HOLDS:
                return Completeness(f, p)
    return None
