"""The batch operators over arriving files: each key once, results kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from earshot.operators.sinks import upsert_table


def keep_current(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "parquet") -> StreamingQuery:
    """Process files that arrived since the last run and upsert their rows by key; a batch that is run again changes nothing.

    ``transform`` is any operator of this package from a DataFrame to a DataFrame.
    """
    rows = spark.readStream.schema(schema).format(form).load(source)

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            upsert_table(transform(df), target, keys)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_scores(rows: DataFrame, ts: str, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """Mean score and count per ticker over windows of event time; rows later than the watermark are dropped, repeated ids within it count once."""
    kept = rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(["chunk_id"])
    return kept.groupBy(F.window(ts, width), "ticker").agg(F.avg("lm_net_score").alias("score"), F.count("*").alias("n"))
