"""The registered queries over delimited files: tables are written as files and loaded again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators import verify
from ledgerlight.sources import files
from ledgerlight.sources.tables import scratch, table


def _again(df: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """A table after it was written as delimited files, in the shared folder, and loaded from them."""
    folder = f"{scratch(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.write.csv(folder, header=True, escape='"', encoding=encoding)
    return files.load(df.sparkSession, folder)


def q46_wide_integers(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers of 19 and of 25 digits keep all of them."""
    key = F.col("o_orderkey")
    out = _again(table(spark, folder, "orders").select((key + 1234567890123000000).alias("id"), F.concat(F.lit("9000000000000000"), F.lpad(key.cast("string"), 9, "0")).alias("wide"), "o_totalprice"))
    return out.select("id", F.col("wide").cast("string").alias("wide"), "o_totalprice")


def q47_late_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The last records hold letters in one byte each; what comes before is ASCII, for more than what is sniffed at."""
    orders = table(spark, folder, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    noted = orders.crossJoin(F.broadcast(last)).select("o_orderkey", F.when(F.col("o_orderkey") > F.col("last") - 50, F.lit("Café Größe 5")).otherwise(F.repeat(F.lit("plain "), F.lit(30))).alias("note"))
    return _again(noted, "ISO-8859-1").select("o_orderkey", F.trim("note").alias("note"))


def q48_quoted_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with line breaks, delimiters and quotes."""
    said = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, F.lit('\nsaid "no", then')).otherwise(F.lit(", twice")), F.lit(" more"))
    return _again(table(spark, folder, "orders").select("o_orderkey", said.alias("said"), "o_orderstatus"))


def q49_date_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The order of day and month in text, which the days over 12 show."""
    at = F.col("o_orderdate")
    forms: dict[str, Column] = {"dmy": F.date_format(at, "dd/MM/yyyy"), "mdy": F.date_format(at, "MM/dd/yyyy"), "ymd": F.date_format(at, "yyyy-MM-dd"), "early": F.when(F.dayofmonth(at) <= 12, F.date_format(at, "dd/MM/yyyy")), "status": F.col("o_orderstatus")}
    df = _again(table(spark, folder, "orders").select(*[c.alias(n) for n, c in forms.items()]).withColumn("ymd", F.concat("ymd", F.lit(" 10:00 h"))))
    return spark.createDataFrame(sorted(verify.date_orders(df, list(forms)).items()), "column_name string, date_order string")


QUERIES = {f.__name__: f for f in (q46_wide_integers, q47_late_bytes, q48_quoted_breaks, q49_date_orders)}
SQL = {
    "q46_wide_integers": "SELECT o_orderkey + 1234567890123000000 AS id, '9000000000000000' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS wide, o_totalprice FROM orders",
    "q47_late_bytes": "SELECT o_orderkey, CASE WHEN o_orderkey > (SELECT MAX(o_orderkey) FROM orders) - 50 THEN 'Café Größe 5' ELSE trim(repeat('plain ', 30)) END AS note FROM orders",
    "q48_quoted_breaks": "SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'said \"no\", then' ELSE ', twice' END || ' more' AS said, o_orderstatus FROM orders",
    "q49_date_orders": """
WITH f AS (SELECT MAX(day(o_orderdate)) AS d, MAX(month(o_orderdate)) AS m FROM orders), e AS (SELECT MAX(day(o_orderdate)) AS d FROM orders WHERE day(o_orderdate) <= 12)
SELECT 'dmy' AS column_name, CASE WHEN d > 12 AND m <= 12 THEN 'day_first' ELSE 'ambiguous' END AS date_order FROM f
UNION ALL SELECT 'mdy', CASE WHEN d > 12 AND m <= 12 THEN 'month_first' ELSE 'ambiguous' END FROM f
UNION ALL SELECT 'ymd', CASE WHEN (SELECT MIN(year(o_orderdate)) FROM orders) > 31 THEN 'iso' END FROM f
UNION ALL SELECT 'early', CASE WHEN d > 12 THEN 'day_first' ELSE 'ambiguous' END FROM e
UNION ALL SELECT 'status', CASE WHEN COUNT(*) FILTER (WHERE regexp_matches(o_orderstatus, '[0-9]+[-/.][0-9]+')) = 0 THEN 'not_a_date' END FROM orders
""",
}
