"""Distinct counts over identifier sets too large to hold, by fixed bitmaps.

A value sets one bit, chosen by its hash, of a bitmap of `bits` bits. Bitmaps merge by bitwise union.
With n values the expected share of empty bits is exp(-n / bits), so n is estimated as
-bits * ln(empty share), with a standard error of sqrt(bits * (exp(t) - t - 1)), t = n / bits.
Bitmaps are kept as rows of (group, word number, 64 bits); words without a bit aren't stored, so a
small set costs no more than its values and a large one never more than bits / 64 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a bitmap where no size is known: a million, good for 8 million values within 1.3 % (one standard error).
BITS = 1 << 20
#: Relative standard error that bitmaps are sized for; small cells, too, then hardly ever have two values on one bit.
TARGET = 0.0007
#: An estimate's bound: so many standard errors, and so many values, which small sets can be off by where hardly any bits coincide.
SIGMAS, FEW = 6.0, 2.0
#: Up to so many cells of roll-ups are broadcast (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_CELLS = 200_000


def error(n: float, bits: int = BITS) -> float:
    """Relative standard error of the estimate for n values."""
    t = n / bits
    return math.sqrt(bits * max(math.expm1(t) - t, 0.0)) / n if n else 0.0


def bits_for(n: int, target: float) -> int:
    """The least power of two of bits, from 64 on, whose relative standard error for n values is at most `target`."""
    bits = 64
    while n / bits > 500 or error(n, bits) > target:
        bits *= 2
    return bits


def position(value: Column, bits: int = BITS) -> Column:
    """Number of the bit that a value sets; null for null."""
    return F.when(value.isNotNull(), F.xxhash64(value).bitwiseAND(F.lit(bits - 1)))


def bitmaps(df: DataFrame, groups: list[str], value: str, bits: int = BITS) -> DataFrame:
    """Partial bitmaps of `df`: the columns `groups`, `word`, `mask` and `rows`, the rows that set a bit of the word.

    Null values set no bit; repeated rows set the same one; an empty table gives no rows. The result
    can be written, added to by a union with other partials, and merged at any time.
    """
    p = position(F.col(f"`{value}`"), bits)
    words = df.select(*[F.col(f"`{g}`") for g in groups], p.alias("__p")).filter("__p is not null")
    words = words.select(*[F.col(f"`{g}`") for g in groups], F.shiftright("__p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(__p & 63 as int))").alias("bit"))
    return words.groupBy(*groups, "word").agg(F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("rows"))


def merged(partials: DataFrame, groups: list[str]) -> DataFrame:
    """Bitwise union of partial bitmaps, over all of their columns that aren't among `groups`."""
    return partials.groupBy(*groups, "word").agg(F.bit_or("mask").alias("mask"), F.sum("rows").alias("rows"))


def estimate(set_bits: Column, bits: int = BITS) -> Column:
    """Number of values from the number of set bits; a full bitmap counts as if one bit were empty."""
    return -F.log(F.greatest(F.lit(bits) - set_bits, F.lit(1)) / F.lit(float(bits))) * bits


def margin(n: Column, bits: int = BITS, sigmas: float = SIGMAS) -> Column:
    """Bound of the estimate's error: `sigmas` standard errors and FEW values.

    The chance that an estimate is further off is below 1e-6: of a large set by the normal distribution, of a small one,
    where coinciding bits are rare events with n * n / (2 * bits) as their mean, by Poisson's.
    """
    t = n / F.lit(float(bits))
    return F.sqrt(F.greatest(F.exp(t) - t - 1, F.lit(0.0)) * bits) * sigmas + FEW


def _bounded(off: Column, bits: int) -> Column:
    """A margin where an empty bit is left; a full bitmap says nothing of how many more values there are."""
    return F.when(F.col("set_bits") < bits, off)


def sized(lines: DataFrame, group: str, target: float = TARGET) -> int:
    """Bits for cells that lie within a `group`: by its largest number of rows, which no cell's values exceed."""
    rows = lines.groupBy(F.col(f"`{group}`")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0]
    return bits_for(max(rows or 0, 1), target)


def distinct(partials: DataFrame, groups: list[str], bits: int = BITS) -> DataFrame:
    """`groups`, set_bits, rows (with a value), estimate and margin, from partial bitmaps; groups without a value don't come out, and a full bitmap has no margin."""
    sums = merged(partials, groups).groupBy(*groups).agg(F.sum(F.bit_count("mask")).alias("set_bits"), F.sum("rows").alias("rows"))
    return sums.withColumn("estimate", estimate(F.col("set_bits"), bits)).withColumn("margin", _bounded(margin(F.col("estimate"), bits), bits))


def repeated(df: DataFrame, groups: list[str], value: str, bits: int = BITS) -> DataFrame:
    """How many values come more than once: `groups`, set_bits, again, estimate, margin.

    A second bitmap holds the bits that were set more than once. With E the share of empty bits and O
    that of bits set exactly once, bits * (-ln E - O / E) values come more than once.
    """
    p = position(F.col(f"`{value}`"), bits)
    lines = df.select(*[F.col(f"`{g}`") for g in groups], p.alias("__p")).filter("__p is not null").groupBy(*groups, "__p").agg(F.count(F.lit(1)).alias("__n"))
    sums = lines.groupBy(*groups).agg(F.count(F.lit(1)).alias("set_bits"), F.count_if(F.col("__n") > 1).alias("again"))
    empty = F.greatest(F.lit(bits) - F.col("set_bits"), F.lit(1)) / F.lit(float(bits))
    once = (F.col("set_bits") - F.col("again")) / F.lit(float(bits))
    sums = sums.withColumn("estimate", F.greatest(-F.log(empty) - once / empty, F.lit(0.0)) * bits)
    return sums.withColumn("margin", _bounded(2 * margin(estimate(F.col("set_bits"), bits), bits), bits))


def _area(day: Column, country: Column, line_type: Column) -> Column:
    """A number for a feed's part; null among the three means all."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("*")) for c in (day, country, line_type)]
    return F.xxhash64(F.col("feed_id"), *marked)


def _covered(lines: DataFrame, cells: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """Each line once for each cell that covers it: cell, load_no, value.

    A line lies in eight parts of its feed, as its day, country and line type are restricted or not;
    one equality join finds those that are asked for. Null countries and types lie in no restricted part.
    """
    day, country, kind = F.to_date("invoice_date"), F.col("country"), F.col("line_type")
    none = F.lit(None).cast("string")
    parts = [_area(day if w & 1 else none, country if w & 2 else none, kind if w & 4 else none) for w in range(8)]
    there = [F.lit(True), day.isNotNull(), country.isNotNull(), kind.isNotNull()]
    areas = F.array(parts[0], *[F.when(there[1 * bool(w & 1)] & there[2 * bool(w & 2)] & there[3 * bool(w & 4)], parts[w]) for w in range(1, 8)])
    seen = lines.select("load_no", *[F.col(f"`{c}`").cast("string").alias(f"v_{c}") for c in columns], F.explode(areas).alias("area")).filter("area is not null")
    value = none
    for c in columns:
        value = F.when(F.col("column_name") == c, F.col(f"`v_{c}`")).otherwise(value)
    known = cells.select(F.col("area"), "column_name", "cell")
    return seen.join(F.broadcast(known) if small else known, "area").select("cell", "load_no", value.alias("value"))


def _each(lines: DataFrame, columns: list[str]) -> DataFrame:
    """feed_id, column_name, value: each line once for each of `columns`."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return lines.select("feed_id", F.explode(pairs).alias("x")).select("feed_id", "x.column_name", "x.value").filter("value is not null")


def _verdict(stated: Column, rows: Column | None = None) -> tuple[Column, Column]:
    """Whether a stated number is surely more than a tenth off the true one, and whether the estimate leaves that open.

    The true number lies within the margin around the estimate, and, where there is one, there is a value at least and no more values than `rows`;
    without a margin, of a full bitmap, it may be any. A null stated number is neither.
    """
    low = F.greatest(F.col("estimate") - F.col("margin"), F.lit(0.0))
    high = F.col("estimate") + F.col("margin")
    if rows is not None:
        low, high = F.greatest(low, F.lit(1.0)), F.least(high, rows.cast("double"))
    # 10 * |stated - t| > t for all t from low to high, and for none
    slack = 1e-9 * (1 + F.abs(stated))
    surely = (stated > 1.1 * high + slack) | (stated < 0.9 * low - slack)
    never = (stated <= 1.1 * low - slack) & (stated >= 0.9 * high + slack)
    known = F.col("margin").isNotNull()
    return F.coalesce(known & surely, F.lit(False)), stated.isNotNull() & ~F.coalesce(known & (surely | never), F.lit(False))


def wrong_rollups(lines: DataFrame, rollups: DataFrame, bits: int | None = None) -> DataFrame:
    """rollup_id of the roll-ups of which distinct_count or uniqueness_ratio is more than a tenth off.

    Each load's lines give partial bitmaps; their union gives the count of each part of a feed that
    is asked for, with a known error. A stated figure that is more than a tenth off whatever the true count within
    that error is false, one that is off in no case is true; only cells that the error leaves open are
    counted exactly. Parts without a non-null value aren't cases; a null stated figure is no false one;
    unknown columns aren't counted. Three jobs: the columns, the number of cells, and the largest feed.
    """
    columns = sorted(r[0] for r in rollups.filter(F.col("column_name").isin(lines.columns)).select("column_name").distinct().collect())
    if not columns:
        return rollups.select("rollup_id").limit(0)
    stated = rollups.filter(F.col("column_name").isin(columns)).select("rollup_id", "column_name", "distinct_count", "uniqueness_ratio", _area(F.col("sale_date"), F.col("country"), F.col("line_type")).alias("area"))
    stated = stated.withColumn("cell", F.xxhash64("area", "column_name"))
    cells = stated.select("area", "column_name", "cell").distinct()
    small = cells.count() <= BROADCAST_CELLS
    bits = bits or sized(lines, "feed_id")
    counts = distinct(bitmaps(_covered(lines, cells, columns, small), ["cell", "load_no"], "value", bits), ["cell"], bits)
    (count_off, count_open), (ratio_off, ratio_open) = _verdict(F.col("distinct_count"), F.col("rows")), _verdict(F.col("uniqueness_ratio") * F.col("rows"), F.col("rows"))
    judged = stated.join(counts, "cell").withColumns({"off": count_off | ratio_off, "open": ~(count_off | ratio_off) & (count_open | ratio_open)})
    again = judged.filter("open").select("area", "column_name", "cell").distinct()
    exact = _covered(lines, again, columns, small).filter("value is not null").groupBy("cell", "value").agg(F.count(F.lit(1)).alias("v")).groupBy("cell").agg(F.count(F.lit(1)).alias("t"), F.sum("v").alias("v"))
    false = "off or coalesce(10 * abs(distinct_count - t) > t, false) or coalesce(10 * abs(uniqueness_ratio - t / v) > t / v, false)"
    return judged.join(exact, "cell", "left").filter(false).select("rollup_id")


def wrong_dependencies(lines: DataFrame, dependencies: DataFrame, bits: int | None = None) -> DataFrame:
    """fd_id of the dependencies whose support is more than a tenth off the number of non-null
    determinant values on more than one line of the feed; estimated and, where the error leaves it open,
    counted exactly, as roll-ups are. A null support is no false one; unknown columns aren't counted."""
    columns = sorted(r[0] for r in dependencies.filter(F.col("determinant").isin(lines.columns)).select("determinant").distinct().collect())
    if not columns:
        return dependencies.select("fd_id").limit(0)
    stated = dependencies.filter(F.col("determinant").isin(columns)).select("fd_id", "feed_id", F.col("determinant").alias("column_name"), "support")
    keys = ["feed_id", "column_name"]
    small = stated.select(*keys).distinct().count() <= BROADCAST_CELLS
    bits = bits or sized(lines, "feed_id")
    counts = repeated(_each(lines, columns), keys, "value", bits)
    # a feed without any value has support 0, for sure
    rated = stated.join(counts, keys, "left").withColumns({"estimate": F.coalesce("estimate", F.lit(0.0)), "margin": F.when(F.col("set_bits").isNull(), 0.0).otherwise(F.col("margin"))})
    off, left_open = _verdict(F.col("support"))
    judged = rated.withColumns({"off": off, "open": left_open})
    again = judged.filter("open").select(*keys).distinct()
    exact = _each(lines, columns).join(F.broadcast(again) if small else again, keys, "left_semi").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("t"))
    return judged.join(exact, keys, "left").filter("off or open and 10 * abs(support - coalesce(t, 0)) > coalesce(t, 0)").select("fd_id")


def rollup_counts(lines: DataFrame, rollups: DataFrame, bits: int | None = None) -> DataFrame:
    """rollup_id, estimate and margin of each roll-up whose part has a non-null value: the counts with their known error, as partial results give them."""
    columns = sorted(r[0] for r in rollups.filter(F.col("column_name").isin(lines.columns)).select("column_name").distinct().collect())
    if not columns:
        return rollups.select("rollup_id", F.lit(0.0).alias("estimate"), F.lit(0.0).alias("margin")).limit(0)
    stated = rollups.filter(F.col("column_name").isin(columns)).select("rollup_id", "column_name", _area(F.col("sale_date"), F.col("country"), F.col("line_type")).alias("area")).withColumn("cell", F.xxhash64("area", "column_name"))
    cells = stated.select("area", "column_name", "cell").distinct()
    bits = bits or sized(lines, "feed_id")
    partials = bitmaps(_covered(lines, cells, columns, cells.count() <= BROADCAST_CELLS), ["cell", "load_no"], "value", bits)
    return stated.join(distinct(partials, ["cell"], bits), "cell").select("rollup_id", "estimate", "margin")
