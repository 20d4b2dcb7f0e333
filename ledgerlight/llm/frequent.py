"""The most frequent values of columns too wide to count exactly, by a majority-vote sketch.

A sketch has ROWS rows of WIDTH cells per column. A cell holds the total weight that fell into it, a
candidate value and the candidate's surplus of votes. For any value x of a cell with total V and
surplus C: f(x) <= (V + C) / 2 if x is the candidate, else f(x) <= (V - C) / 2; and C <= f(candidate).
Cells merge by vote cancellation: the surpluses of each candidate are added, the greatest stays,
lessened by those of all others. This keeps both bounds, in any order of merging.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.sources.tables import scratch

#: Rows and cells a row (a power of two up to 2**16): 4 * 4096 cells are about 0.5 MB a column and task.
ROWS, WIDTH = 4, 4096
_CELLS = "column_name string, row int, cell int, total long, candidate string, surplus long"


def _partial(width: int):
    """Sketches of a partition's batches of (column_name, value, weight, hash); row -1 holds the net total."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = ROWS * width
        state: dict[str | None, list] = {}

        def out() -> Iterator[pd.DataFrame]:
            for column, (net, total, surplus, candidate) in state.items():
                at = np.flatnonzero(total)
                yield pd.DataFrame({"column_name": column, "row": at // width, "cell": at % width, "total": total[at], "candidate": candidate[at], "surplus": surplus[at]})
                yield pd.DataFrame({"column_name": [column], "row": [-1], "cell": [0], "total": [net], "candidate": [None], "surplus": [0]})
            state.clear()

        for batch in batches:
            for column, part in batch.groupby("column_name", dropna=False, sort=False):
                if column not in state and len(state) >= 64:
                    yield from out()
                s = state.setdefault(None if pd.isna(column) else column, [0, np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, None, object)])
                weight = part["weight"].to_numpy()
                s[0] += int(weight.sum())
                part, weight = part[weight > 0], weight[weight > 0]
                if not len(part):
                    continue
                code, values = pd.factorize(part["value"])
                count = np.bincount(code, weight, len(values)).astype(np.int64) if weight.sum() < 2**53 else pd.Series(weight).groupby(code).sum().to_numpy()
                first = np.empty(len(values), np.int64)
                first[code[::-1]] = part["hash"].to_numpy()[::-1]
                for row in range(ROWS):
                    at = row * width + ((first >> (16 * row)) & (width - 1))
                    order = np.lexsort((count, at))
                    cell, starts = np.unique(at[order], return_index=True)
                    best = order[np.append(starts[1:], len(order)) - 1]
                    total = np.add.reduceat(count[order], starts)
                    surplus = np.maximum(2 * count[best] - total, 0)
                    mine, votes = np.asarray(values, object)[best], s[2][cell]
                    same = s[3][cell] == mine
                    s[3][cell] = np.where(same | (votes >= surplus), s[3][cell], mine)
                    s[2][cell] = np.where(same, votes + surplus, np.abs(votes - surplus))
                    s[1][cell] += total
        yield from out()

    return run


def sketch(df: DataFrame, column: str = "column_name", value: str = "item_value", weight: str = "item_count", width: int = WIDTH) -> DataFrame:
    """Merged sketch of each column: column_name, row, cell, total, candidate, surplus.

    Null values aren't counted, null weights count as 0, weights below 0 only into the net total
    (row -1, cell 0). A task holds one sketch a column, 64 columns at most, then hands them on.
    """
    rows = df.select(F.col(f"`{column}`").cast("string").alias("column_name"), F.col(f"`{value}`").cast("string").alias("value"), F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0)).alias("weight")).filter("value is not null").withColumn("hash", F.xxhash64("value"))
    return merge(rows.mapInPandas(_partial(width), _CELLS))


def merge(cells: DataFrame) -> DataFrame:
    """Sketches (or several written ones in a union) merged cell by cell, by vote cancellation."""
    key = ["column_name", "row", "cell"]
    votes = cells.groupBy(*key, "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("votes"))
    return votes.groupBy(*key).agg(F.sum("total").alias("total"), F.max_by("candidate", F.struct("votes", "candidate")).alias("candidate"), F.greatest(2 * F.max("votes") - F.sum("votes"), F.lit(0)).alias("surplus"))


def frequent(df: DataFrame, share: float = 0.01, column: str = "column_name", value: str = "item_value", weight: str = "item_count", width: int = WIDTH) -> DataFrame:
    """Values with at least `share` of their column's weight: column_name, item_value, lower, upper, item_count.

    lower and upper are the sketch's bounds (null for a value that no cell names), item_count is the
    exact sum, from a second pass over the named values only. At most ROWS / share cells of a column
    can hold such a value; only those come to the driver. A value that lost the vote in each of its
    rows can only be frequent if all its cells could hide one ((V - C) / 2 at or above the
    threshold); where such cells exist in all rows, the second pass also counts what falls into
    them, so the result is complete for any input. An empty table gives no rows; ties all stay.
    """
    spark = df.sparkSession
    # the merged sketch is written, ROWS * width cells a column at most, so that its totals and cells come from one pass
    folder = f"{scratch(spark)}/sketch-{uuid.uuid4().hex}"
    sketch(df, column, value, weight, width).write.parquet(folder)
    merged = spark.read.schema(_CELLS).parquet(folder)
    totals = F.broadcast(merged.filter("row = -1").select(F.col("column_name").alias("c"), F.col("total").alias("net")))
    # a little less than the threshold, which is taken exactly below
    heavy = merged.join(totals, F.col("column_name").eqNullSafe(F.col("c"))).filter(((F.col("row") >= 0) & (F.col("net") > 0) & (F.col("total") >= F.col("net") * (share * (1 - 1e-9)))) | (F.col("row") == -1))
    cells = heavy.select("column_name", "row", "cell", "total", "candidate", "surplus", "net").collect()
    net = {c.column_name: c.net for c in cells if c.row == -1 and c.net > 0}
    threshold = {c: math.ceil(n * Fraction(str(share))) for c, n in net.items()}
    named: dict[tuple, list[int]] = {}
    hidden: dict = {}
    for c in cells:
        if c.row >= 0:
            upper, least = (c.total + c.surplus) // 2, threshold[c.column_name]
            if upper >= least:
                b = named.setdefault((c.column_name, c.candidate), [0, c.total])
                b[0], b[1] = max(b[0], c.surplus), min(b[1], upper)
            if (c.total - c.surplus) // 2 >= least:
                hidden.setdefault(c.column_name, [[] for _ in range(ROWS)])[c.row].append(c.cell)
    hidden = {k: v for k, v in hidden.items() if all(v)}
    rows = df.select(F.col(f"`{column}`").cast("string").alias("column_name"), F.col(f"`{value}`").cast("string").alias("item_value"), F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0)).alias("weight")).filter("item_value is not null")
    known = spark.createDataFrame([(c, v, *b, threshold[c]) for (c, v), b in named.items()], "c string, v string, lower long, upper long, least long")
    on = F.col("column_name").eqNullSafe(F.col("c")) & (F.col("item_value") == F.col("v"))
    found = rows.join(F.broadcast(known), on).groupBy("column_name", "item_value", "lower", "upper", "least").agg(F.sum("weight").alias("item_count"))
    if hidden:
        limits = spark.createDataFrame([(c, threshold[c], *v) for c, v in hidden.items()], "c string, least long, " + ", ".join(f"r{r} array<int>" for r in range(ROWS)))
        h = F.xxhash64("item_value")
        inside = F.lit(True)
        for r in range(ROWS):
            inside &= F.array_contains(f"r{r}", F.shiftright(h, 16 * r).bitwiseAND(F.lit(width - 1)).cast("int"))
        rest = rows.join(F.broadcast(limits), F.col("column_name").eqNullSafe(F.col("c"))).filter(inside).drop("c").join(F.broadcast(known.drop("least", "lower", "upper")), on, "left_anti")
        found = found.unionByName(rest.groupBy("column_name", "item_value", "least").agg(F.sum("weight").alias("item_count")).withColumns({"lower": F.lit(None).cast("long"), "upper": F.lit(None).cast("long")}))
    return found.filter("item_count >= least").select("column_name", "item_value", "lower", "upper", "item_count")
