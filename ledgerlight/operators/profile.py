"""Profile of a whole table in a few jobs: statistics, most frequent values, samples, functional dependencies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.plans.model import Dependency

#: How many values are listed, what determinants are tried and what dependencies count.
TOP, SAMPLES, KEYLIKE, STRENGTH, SUPPORT = 10, 5, 0.99, 0.95, 5
#: Determinants that share a scan; one with more values than GROUPS, whose rows a map task hardly pre-aggregates, gets its own.
DETERMINANTS, GROUPS = 25, 100_000


def type_of(kind: T.DataType) -> str:
    """integer, decimal, boolean, date, timestamp, text, or unknown for anything else."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "decimal"
    for t, name in ((T.BooleanType, "boolean"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"), (T.StringType, "text"), (T.VarcharType, "text"), (T.CharType, "text")):
        if isinstance(kind, t):
            return name
    return "unknown"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class ColumnProfile:
    name: str
    type: str
    null_rate: float = 0.0
    distinct: int = 0
    uniqueness: float = 0.0
    min: str | None = None
    max: str | None = None
    negatives: int | None = None
    zeros: int | None = None
    positives: int | None = None
    integer_ratio: float | None = None
    scale: int | None = None
    top: list[tuple[str, int]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)


@dataclass
class Profile:
    row_count: int
    columns: dict[str, ColumnProfile]
    dependencies: list[Dependency] = field(default_factory=list)

    def strength(self, determinant: str, dependent: str) -> Dependency | None:
        return next((d for d in self.dependencies if d.determinant == determinant and d.dependent == dependent), None)


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: column_name, row_count, non_null, min_value, max_value (as text), negatives, zeros,
    positives, whole, scaled (non-null values, by whether they are whole or have two decimals at most). One scan, one aggregate."""
    names = columns or df.columns
    parts = [F.count(F.lit(1)).alias("rows")]
    rows = []
    for k, c in enumerate(names):
        v, kind = quoted(c), type_of(df.schema[c].dataType)
        number = kind in ("integer", "decimal")
        plain = kind != "unknown"
        parts += [F.count(v).alias(f"n{k}"), (F.min(v).cast("string") if plain else F.lit(None).cast("string")).alias(f"l{k}"), (F.max(v).cast("string") if plain else F.lit(None).cast("string")).alias(f"h{k}")]
        if number:
            parts += [F.count_if(v < 0).alias(f"a{k}"), F.count_if(v == 0).alias(f"z{k}"), F.count_if(v > 0).alias(f"p{k}"), F.count_if(v == F.floor(v)).alias(f"w{k}")]
            parts.append((F.count_if(F.abs(v * 100 - F.round(v * 100)) < 1e-6) if kind == "decimal" else F.count(v)).alias(f"s{k}"))
        none = F.lit(None).cast("long")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), F.col(f"n{k}").alias("non_null"), F.col(f"l{k}").alias("min_value"), F.col(f"h{k}").alias("max_value"), *[(F.col(f"{p}{k}") if number else none).alias(n) for p, n in (("a", "negatives"), ("z", "zeros"), ("p", "positives"), ("w", "whole"), ("s", "scaled"))]))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (as text), n: how often each non-null value comes, in one pass over all columns."""
    names = [c for c in columns or df.columns if type_of(df.schema[c].dataType) != "unknown"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in names])
    return df.select(F.inline(pairs)).filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent values of each column, ties by value: column_name, position, value, n."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def samples(counts: DataFrame, k: int = SAMPLES) -> DataFrame:
    """The k least values of each column, as text: column_name, position, value."""
    return _least(counts, k).select("column_name", "position", "value")


def _least(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("column_name").orderBy("value")
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def dependencies(df: DataFrame, determinants: list[str], dependents: list[str]) -> DataFrame:
    """determinant, dependent, strength, support for each pair of columns.

    Over the determinant's values that more than one row has (support, null left out), the share with
    one value of the dependent at most, nulls not counted; null where support is 0. Values are compared by 64-bit
    hashes: a group has one value of a dependent if its least and greatest hash are equal. So all pairs come from
    one scan and one aggregate of constant state per group, without distinct values being kept or expanded.
    """
    spark = df.sparkSession
    if not determinants:
        return spark.createDataFrame([], "determinant string, dependent string, strength double, support long")
    hashes = {c: F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c))) for c in {*determinants, *dependents}}
    # hashed once, and not again for each determinant
    hashed = df.select(*[hashes[c].alias(f"d{k}") for k, c in enumerate(determinants)], *[hashes[c].alias(f"c{k}") for k, c in enumerate(dependents)])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("h")) for k in range(len(determinants))]))
    rows = hashed.select(each, *[F.col(f"c{k}") for k in range(len(dependents))]).filter("h is not null")
    groups = rows.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"), *[x for k in range(len(dependents)) for x in (F.min(f"c{k}").alias(f"l{k}"), F.max(f"c{k}").alias(f"h{k}"))]).filter("n > 1")
    whole = groups.groupBy("k").agg(F.count(F.lit(1)).alias("support"), *[F.count_if(F.coalesce(F.col(f"l{k}") == F.col(f"h{k}"), F.lit(True))).alias(f"s{k}") for k in range(len(dependents))])
    names = F.broadcast(spark.createDataFrame(list(enumerate(determinants)), "k int, determinant string"))
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("dependent"), F.col(f"s{k}").alias("single")) for k, c in enumerate(dependents)]))
    out = names.join(whole, "k", "left").select("determinant", F.coalesce("support", F.lit(0)).alias("support"), pairs).filter("determinant <> dependent")
    return out.select("determinant", "dependent", (F.col("single") / F.nullif("support", F.lit(0))).alias("strength"), "support")


def candidates(columns: dict[str, ColumnProfile]) -> list[list[str]]:
    """Determinants worth trying, of two values and more and not nearly unique, in lots that share a scan; the most
    repeated first. None is left out: one of many values is a lot of its own."""
    found = sorted((c for c in columns.values() if c.distinct >= 2 and c.uniqueness < KEYLIKE and c.type != "unknown"), key=lambda c: (c.uniqueness, c.name))
    few = [c.name for c in found if c.distinct <= GROUPS]
    return [few[k : k + DETERMINANTS] for k in range(0, len(few), DETERMINANTS)] + [[c.name] for c in found if c.distinct > GROUPS]


def profile(df: DataFrame) -> Profile:
    """The whole profile; an empty table has columns without values."""
    counts = value_counts(df)
    # two passes: one for the statistics, one for the value counts, from which all else follows; as all three
    # read the same columns of the counts, they share one shuffle
    listed = top_values(counts).select("column_name", F.lit("top").alias("what"), "position", "value", "n")
    least = _least(counts, SAMPLES).select("column_name", F.lit("sample").alias("what"), "position", "value", "n")
    each = F.sum(F.when((F.col("n") > 0) & F.col("value").isNotNull(), 1).otherwise(0))
    number = counts.groupBy("column_name").agg(each.alias("n")).select("column_name", F.lit("distinct").alias("what"), F.lit(0).alias("position"), F.lit("").alias("value"), "n")
    columns = {}
    rows = 0
    for r in statistics(df).collect():
        rows = r.row_count
        c = columns[r.column_name] = ColumnProfile(r.column_name, type_of(df.schema[r.column_name].dataType), 1 - r.non_null / rows if rows else 0.0, min=r.min_value, max=r.max_value)
        if r.negatives is not None:
            c.negatives, c.zeros, c.positives = r.negatives, r.zeros, r.positives
            c.integer_ratio = r.whole / r.non_null if r.non_null else None
            c.scale = 0 if r.whole == r.non_null else 2 if r.scaled == r.non_null else None
    for r in sorted(listed.unionByName(least).unionByName(number).collect(), key=lambda r: r.position):
        c = columns[r.column_name]
        if r.what == "top":
            c.top.append((r.value, r.n))
        elif r.what == "sample":
            c.samples.append(r.value)
        else:
            c.distinct = r.n
            c.uniqueness = r.n / max(1, round(rows * (1 - c.null_rate)))
    out = Profile(rows, columns)
    found = []
    for lot in candidates(columns):
        edges = dependencies(df, lot, [c.name for c in columns.values() if c.type != "unknown"])
        found += [Dependency(*r) for r in edges.filter((F.col("support") >= SUPPORT) & (F.col("strength") >= STRENGTH)).collect()]
    out.dependencies = sorted(found, key=lambda d: (-d.strength, -d.support, d.determinant, d.dependent))
    return out
