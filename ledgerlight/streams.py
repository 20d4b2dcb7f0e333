"""The registered queries over streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.sources.tables import stream
from ledgerlight.streaming.rollup import drained, rollup


def q45_streamed_rollup(spark: SparkSession, folder: str) -> DataFrame:
    amounts = {"events": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(18,6)")).cast("double")}
    out = drained(rollup(stream(spark, folder, "events"), "ts", "1 day", ["event_type"], amounts), "rollup", ["period_start", "event_type"])
    return out.select(F.date_format("period_start", "yyyy-MM-dd").alias("day"), "event_type", "events", "total")


QUERIES = {"q45_streamed_rollup": q45_streamed_rollup}
SQL = {"q45_streamed_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"}
