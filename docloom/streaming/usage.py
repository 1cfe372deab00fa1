"""G22 on a stream: calls and tokens by day and source, kept up to date in a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stored

SCHEMA = "created_at TIMESTAMP, source STRING, total_tokens INT"


def daily_usage(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """day, source, calls, tokens by windows of one day (in UTC) of event time. A day's state is let go once records `delay` later
    than its end have come; records of that day that come after that are dropped, as is one without a time."""
    windows = stream.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"), "source")
    sums = windows.agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").cast("long").alias("tokens"))
    return sums.select(F.to_date("w.start").alias("day"), "source", "calls", "tokens")


def usage_stream(spark: SparkSession, source: str, table: str, checkpoint: str, schema: str = SCHEMA, delay: str = "1 day", buckets: int = 16) -> StreamingQuery:
    """Reads new usage records (Parquet files under source) and puts the days and sources that they change into the stored
    table: only their buckets are rewritten. A batch that is tried again writes the same sums."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("key", F.concat_ws("|", F.date_format("day", "yyyy-MM-dd"), "source"))
        if stored.versions(spark, table):
            stored.upsert(spark, table, rows, "key")
        else:
            stored.create(rows, table, "key", buckets)

    stream = spark.readStream.schema(schema).parquet(source)
    return daily_usage(stream, delay).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_totals(daily: DataFrame) -> DataFrame:
    """The rows of usage_rollup() from the sums by day and source."""
    return daily.rollup("day", "source").agg(F.grouping_id().cast("int").alias("level"), F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
