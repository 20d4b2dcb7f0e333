"""Aggregates over a stream of events, by period and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.sources.tables import scratch


def rollup(events: DataFrame, time: str, length: str, keys: list[str], aggregates: dict[str, Column], late: str = "1 hour") -> DataFrame:
    """period_start, `keys` and `aggregates` of each window of `length`.

    The watermark stands `late` behind the latest time of the micro-batches before: windows that end before it leave
    the state, and rows that come for them are dropped. Rows without a time don't count.
    """
    stamped = events.withColumn("__at", F.col(time).cast("timestamp")).filter("__at is not null").withWatermark("__at", late)
    grouped = stamped.groupBy(F.window("__at", length).alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("__w.start").cast("timestamp_ntz").alias("period_start"), *keys, *aggregates)


def drained(stream: DataFrame, name: str, keys: list[str], timeout: int = 600) -> DataFrame:
    """A streamed aggregate after all that is there now was read: of each of `keys`, what was written last.

    A micro-batch writes the groups that it changed, under its number, so one that is repeated counts once. A stream
    that isn't through after `timeout` seconds is an error: it lacks rows.
    """
    import uuid

    spark = stream.sparkSession
    folder = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").foreachBatch(keep).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"the stream {name} wasn't read to its end within {timeout} seconds")
    finally:
        query.stop()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/changed")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):  # a stream without rows
        return spark.createDataFrame([], stream.schema)
    changed = spark.read.schema(f"{stream.schema.toDDL()}, batch long").option("basePath", f"{folder}/changed").parquet(f"{folder}/changed")
    values = [c for c in stream.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v"))
    return last.select(*[f"__v.{c}" if c in values else c for c in stream.columns])
