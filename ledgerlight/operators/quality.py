"""Column profiles from maintained value counts.

For every column of every load a table holds how often each value comes, null among them. A load adds
its counts, a withdrawn load adds them with the sign turned; exact null rates, distinct counts,
ranges, signs, medians and entropies follow from the counts alone, without reading lines again.
There is one such table for each kind of column: text, integer, decimal, moment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"text": "string", "integer": "long", "decimal": "double", "moment": "timestamp_ntz"}


def kind_of(kind: T.DataType) -> str:
    """The table that a column's values go to; types without an order of their own go as text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "decimal"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "moment"
    return "text"


def counted(df: DataFrame, keys: list[str], columns: list[str], sign: int = 1) -> dict[str, DataFrame]:
    """Value counts of the lines of `df`, as a signed delta: for each kind a table of `keys`, column_name, value, n.

    Nulls are counted as a value; an empty table gives empty tables. Each kind reads its own columns only.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    out = {}
    for kind, storage in KINDS.items():
        mine = [c for c in columns if kinds[c] == kind]
        pairs = [F.struct(F.lit(k).alias("number"), (F.to_json(F.struct(f"`{c}`")) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{c}`").cast(storage)).alias("value")) for k, c in enumerate(mine)]
        if mine:
            # columns go through the shuffle by number
            lines = df.select(*[F.col(f"`{k}`") for k in keys], F.inline(F.array(*pairs)))
            counts = lines.groupBy(*keys, "number", "value").agg((sign * F.count(F.lit(1))).alias("n"))
            out[kind] = counts.select(*[F.col(f"`{k}`") for k in keys], F.get(F.array(*[F.lit(c) for c in mine]), F.col("number")).alias("column_name"), "value", "n")
    return out


def applied(tables: dict[str, DataFrame], *deltas: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with deltas added; values whose counts come to 0 are gone."""
    out = {}
    for kind in {k for t in (tables, *deltas) for k in t}:
        parts = [t[kind] for t in (tables, *deltas) if kind in t]
        whole = reduce(DataFrame.unionByName, parts)
        out[kind] = whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n <> 0")
    return out


class ValueCounts:
    """Value-count tables kept in a folder: deltas are appended, and folded together by `compact`."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _parts(self, kind: str) -> list[str]:
        """Whole parts that no other whole part has taken in."""
        fs, path = self._fs()
        at = path(f"{self.folder}/{kind}")
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        whole = [p for p in found if not p.getName().startswith(".") and fs.exists(path(f"{p.toString()}/_SUCCESS"))]
        gone: set[str] = set()
        for p in whole:
            if fs.exists(path(f"{p.toString()}/_replaces")):
                stream = fs.open(path(f"{p.toString()}/_replaces"))
                gone |= set(bytes(stream.readAllBytes()).decode().split("\n"))
                stream.close()
        return sorted(p.toString() for p in whole if p.getName() not in gone)

    def add(self, df: DataFrame, columns: list[str], name: str, sign: int = 1) -> None:
        """Count lines as the delta `name`; the same name again replaces what it added, so a repeated job counts once."""
        for kind, delta in counted(df, self.keys, columns, sign).items():
            delta.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        """The tables as they are now. A part holds no value twice, so a kind of one part is whole as it stands."""
        parts = {k: p for k in KINDS if (p := self._parts(k))}
        read = {k: self.spark.read.parquet(*p) for k, p in parts.items()}
        return {k: t if len(parts[k]) == 1 else applied({k: t})[k] for k, t in read.items()}

    def compact(self, name: str) -> None:
        """One part instead of many. The new part says which ones it takes in, so readers count every delta once
        whenever this breaks off; the names it took in can't be added again."""
        fs, path = self._fs()
        for kind in KINDS:
            old = self._parts(kind)
            if len(old) < 2:
                continue
            draft = f"{self.folder}/{kind}/.{name}"
            applied({kind: self.spark.read.parquet(*old)})[kind].write.mode("overwrite").parquet(draft)
            names = [path(p).getName() for p in old]
            for p in old:  # what they took in stays taken in
                if fs.exists(path(f"{p}/_replaces")):
                    stream = fs.open(path(f"{p}/_replaces"))
                    names += bytes(stream.readAllBytes()).decode().split("\n")
                    stream.close()
            out = fs.create(path(f"{draft}/_replaces"), True)
            out.write(bytearray("\n".join(names).encode()))
            out.close()
            fs.rename(path(draft), path(f"{self.folder}/{kind}/{name}"))
            for p in old:
                fs.delete(path(p), True)


#: Where no column of a load has more different values, its values are sorted for the median; else they are counted by range first.
SORTED = 1_000_000
#: Ranges of a doubling of a number, by which a column's values are counted first for their median.
_RANGES = 16
#: Rows up to which the ranges that hold a middle value (about 60 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_RANGES = 200_000


def _range_of(value: Column) -> Column:
    """The range of a number, by its logarithm; ranges are in the order of their values, NaN last."""
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.rint(F.log2(F.abs(value)) * _RANGES) + 1100 * _RANGES))


def _middle(there: Column | None = None) -> Column:
    """The median, from `so_far`, the count up to each value, and `all`: the lower middle value is the first whose count reaches half, the upper the first that exceeds it."""
    reached, exceeded = 2 * F.col("so_far") >= F.col("all"), 2 * F.col("so_far") > F.col("all")
    ends = [F.min(F.when(c if there is None else there & c, F.col("value"))) for c in (reached, exceeded)]
    return (ends[0] + ends[1]) / 2


def medians(table: DataFrame, key: list[str], folder: str) -> DataFrame:
    """`key`, median: the exact median of each key's non-null values, from counts (value, n), with no task that has all values of a key.

    Values are counted by range first. In which ranges the two middle values lie follows from these counts, which are
    written to `folder`, a new one; only values of those ranges are ranked.
    """
    spark = table.sparkSession
    rows = table.filter("value is not null and n > 0").select(*key, F.col("value").cast("double").alias("value"), "n").withColumn("range", _range_of(F.col("value")))
    w = Window.partitionBy(*key)
    counts = rows.groupBy(*key, "range").agg(F.sum("n").alias("n"))
    sums = counts.withColumn("so_far", F.sum("n").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    # the lower middle value is the first whose count so far reaches half, the upper the first that exceeds it
    middle = sums.filter("2 * so_far >= all and 2 * (so_far - n) <= all").select(*key, "range", (F.col("so_far") - F.col("n")).alias("before"), "all")
    middle.write.parquet(folder)
    middle = spark.read.parquet(folder)
    near = rows.join(F.broadcast(middle) if middle.count() <= BROADCAST_RANGES else middle, [*key, "range"])
    so_far = F.col("before") + F.sum("n").over(Window.partitionBy(*key, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("so_far", so_far).groupBy(*key).agg(_middle().alias("median"))


def profile(tables: dict[str, DataFrame], keys: list[str], formats: dict[str, str] | None = None, folder: str | None = None) -> DataFrame:
    """Exact profile of each column under `keys`, from value counts.

    `keys`, column_name, row_count, null_count, null_rate, distinct_count, uniqueness_ratio, min_text,
    max_text, min_number, max_number (of decimal columns), min_whole, max_whole (of integer columns), min_moment,
    max_moment, negatives, zeros, positives, integer_ratio (null for text and moments), entropy (bits, of the non-null
    values), violations (values, by number of lines, that don't match the column's pattern in `formats`), and the exact
    median of decimal columns where `folder` names a new folder for the ranges by which it is found in columns of
    more than SORTED values. A column without a non-null value has null ranges and entropy 0.
    """
    out, key = [], [*keys, "column_name"]
    for kind, table in tables.items():
        there, n, number = F.col("value").isNotNull(), F.col("n"), kind in ("integer", "decimal")

        def count(condition: Column, n: Column = n) -> Column:
            return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

        def signed(condition: Column, number: bool = number, count=count) -> Column:
            return count(condition) if number else F.lit(None).cast("long")

        def only(wanted: str, names: str, kind: str = kind) -> list[Column]:
            return [(f("value") if kind == wanted else F.lit(None)).cast(KINDS[wanted]).alias(f"{end}_{names}") for f, end in ((F.min, "min"), (F.max, "max"))]

        v, broken = F.col("value"), F.lit(False)
        for column, pattern in (formats or {}).items():
            if kind == "text":
                broken = F.when(F.col("column_name") == column, there & ~v.rlike(rf"\A(?:{pattern})\z")).otherwise(broken)
        rows, full = F.sum("n"), count(there)
        middle, split = F.lit(None).cast("double"), False
        if folder and kind == "decimal":
            split = (table.groupBy(*key).agg(F.count(F.lit(1)).alias("values")).agg(F.max("values")).collect()[0][0] or 0) > SORTED
            if not split:  # the same shuffle serves for the sums
                w = Window.partitionBy(*key)
                weight = F.when(there, n).otherwise(0)
                so_far = F.sum(weight).over(w.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
                table = table.withColumn("so_far", so_far).withColumn("all", F.sum(weight).over(w))
                middle = _middle(there)
        p = table.groupBy(*key).agg(
            rows.alias("row_count"), (rows - full).alias("null_count"), F.count("value").alias("distinct_count"), *only("text", "text"), *only("decimal", "number"), *only("integer", "whole"), *only("moment", "moment"),
            *[signed((v.cast("double") < 0) if number else F.lit(False)).alias("negatives"), signed((v == 0) if number else F.lit(False)).alias("zeros"), signed((v.cast("double") > 0) if number else F.lit(False)).alias("positives")],
            (signed(v == F.floor(v)) / F.nullif(full, F.lit(0)) if number else F.lit(None).cast("double")).alias("integer_ratio"),
            F.sum(F.when(there, n * F.log2(n))).alias("weighted"), count(broken).alias("violations"), middle.alias("median"),
        )
        out.append(p.drop("median").join(medians(table, key, folder), key, "left") if split else p)
    whole = reduce(DataFrame.unionByName, out)
    full = F.col("row_count") - F.col("null_count")
    return whole.select(
        *key, "row_count", "null_count", (F.col("null_count") / F.col("row_count")).alias("null_rate"), "distinct_count", (F.col("distinct_count") / F.nullif(full, F.lit(0))).alias("uniqueness_ratio"),
        "min_text", "max_text", "min_number", "max_number", "min_whole", "max_whole", "min_moment", "max_moment", "negatives", "zeros", "positives", "integer_ratio",
        F.when(full > 0, F.greatest(F.log2(full) - F.col("weighted") / full, F.lit(0.0))).otherwise(0.0).alias("entropy"), "violations", "median",
    )


def _middles(value: str) -> Column:
    """The values next to the middle of a group, sorted: four of them, from which the median without any one element follows."""
    a = F.sort_array(F.collect_list(value))
    k = F.size(a)
    low, high = (F.floor((k - 2) / 2).cast("int"), F.floor((k - 1) / 2).cast("int"))
    return F.when(k > 1, F.array(*[F.get(a, i) for i in (low, low + 1, high, high + 1)]))


def _median_of_others(middles: str, mine: str) -> Column:
    """Median of a group without one element equal to `mine`; null if nothing is left or `mine` is null."""

    def kth(at: int) -> Column:
        a = F.get(F.col(middles), F.lit(at))
        return F.when(F.col(mine) > a, a).otherwise(F.get(F.col(middles), F.lit(at + 1)))

    return F.when(F.col(mine).isNotNull() & F.col(middles).isNotNull(), (kth(0) + kth(2)) / 2)


#: Thresholds of the departures: difference of null shares, of shares of negatives, factor of medians,
#: distinct values that the other loads must have, share of values against the format.
LIMITS = {"null_rate": 0.15, "negatives": 0.10, "shift": 3.0, "constant": 5, "pattern": 0.02}


def _departed(profiles: DataFrame, series: str, signs: list[str], shifts: list[str], constants: list[str], formats: dict[str, str], limits: dict[str, float]) -> tuple[Column, DataFrame]:
    """(the kinds of departure of each row, the rows)."""
    name, full = F.col("column_name"), F.col("row_count") - F.col("null_count")

    def among(columns: list[str], value: Column) -> Column:
        return F.when(name.isin(columns) & (full > 0), value.cast("double"))

    figures = {"null_rate": F.col("null_rate"), "negatives": among(signs, F.col("negatives") / F.nullif(full, F.lit(0))), "shift": among(shifts, F.col("median")), "constant": among(constants, F.col("distinct_count"))}
    p = profiles.select("*", *[f.alias(f"f_{k}") for k, f in figures.items()])
    # a series gives one row, not an array to each of its loads
    group = p.groupBy(F.col(series).alias("__series"), F.col("column_name").alias("__of")).agg(*[_middles(f"f_{k}").alias(f"a_{k}") for k in figures])
    p = p.join(group, p[series].eqNullSafe(F.col("__series")) & (p["column_name"] == F.col("__of"))).drop("__series", "__of")
    p = p.select("*", *[_median_of_others(f"a_{k}", f"f_{k}").alias(f"o_{k}") for k in figures])
    m, o = F.col("f_shift"), F.col("o_shift")
    kinds = {
        "null_rate": F.abs(F.col("f_null_rate") - F.col("o_null_rate")) > limits["null_rate"],
        "negatives": F.abs(F.col("f_negatives") - F.col("o_negatives")) > limits["negatives"],
        "shift": (m > o * limits["shift"]) | (m * limits["shift"] < o),
        "constant": (F.col("f_constant") == 1) & (F.col("o_constant") >= limits["constant"]),
        "pattern": name.isin(list(formats)) & (full > 0) & (F.col("violations") >= full * limits["pattern"]),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])), p


def departures(profiles: DataFrame, series: str, load: str, signs: list[str], shifts: list[str], constants: list[str], formats: dict[str, str], limits: dict[str, float] = LIMITS, stated: DataFrame | None = None) -> DataFrame:
    """Columns of a load that depart from the series' other loads or break their format: `load`, column_name, kind.

    Each figure is compared with the exact median over the other loads of the series, which follows from the four
    figures next to the series' middle. Profiles are read twice, so give them as a written table. Loads without a non-null value in
    the column are left out, but for the kind `null_rate`. A load without others isn't compared. With
    `stated`, columns whose statement there is false come out as the kind `stated`, in the same pass.
    """
    found, p = _departed(profiles, series, signs, shifts, constants, formats, limits)
    if stated is not None:
        p = _beside(p, stated, load, "left")
        found = F.concat(found, F.when(F.col("__load").isNotNull() & ~_holds(), F.array(F.lit("stated"))).otherwise(F.array().cast("array<string>")))
    out = p.select(F.col(load), "column_name", F.explode(found).alias("kind"))
    return out if stated is None else out.distinct()


def _beside(profiles: DataFrame, stated: DataFrame, load: str, how: str) -> DataFrame:
    s = stated.select(F.col(load).alias("__load"), F.col("column_name").alias("__column"), *[F.col(c).alias(f"s_{c}") for c in ("null_count", "distinct_count", "min_value", "max_value", "negatives")])
    return profiles.join(s, (F.col(load) == F.col("__load")) & (F.col("column_name") == F.col("__column")), how)


def _holds() -> Column:
    """Whether a statement is true of the profile beside it."""
    true = F.lit(True)
    for end in ("min", "max"):
        text = F.col(f"s_{end}_value")
        # whole numbers are compared as such: doubles don't tell those over 2 to the 53 apart
        kinds = {"whole": "decimal(38,6)", "number": "double", "moment": "timestamp_ntz"}
        held = text.eqNullSafe(F.col(f"{end}_text"))
        for name, storage in kinds.items():
            held = F.when(F.col(f"{end}_{name}").isNotNull(), text.try_cast(storage).eqNullSafe(F.col(f"{end}_{name}").cast(storage))).otherwise(held)
        true &= held
    for c in ("null_count", "distinct_count", "negatives"):
        true &= F.col(f"s_{c}").eqNullSafe(F.col(c))
    return true


def misstated(profiles: DataFrame, stated: DataFrame, load: str) -> DataFrame:
    """Columns whose stated null_count, distinct_count, min_value, max_value or negatives isn't the true one: `load`, column_name.

    Ranges are read as the column's type; text that can't be read so is false. Null equals null only.
    Statements about loads or columns without lines aren't judged; of repeated statements any false one counts.
    """
    return _beside(profiles, stated, load, "inner").filter(~_holds()).select(F.col(load), "column_name").distinct()
