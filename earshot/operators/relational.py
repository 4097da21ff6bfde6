"""Deduplication, upsert, incremental selection, coverage and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should end in a tie-break. Null keys are a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Union by name in which a key of ``new`` replaces the one of ``existing``; missing columns become null."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, [F.desc("_batch"), *(order or [])]).drop("_batch")


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in ``done`` yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def having(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of keys with at least ``least`` rows."""
    return df.join(df.groupBy(*keys).count().filter(F.col("count") >= least).select(*keys), keys, "left_semi")


def coverage(df: DataFrame, row: str, column: str) -> DataFrame:
    """``(row, column, present)`` for every pair of values seen: both sides are distinct keys, so the grid is as large as the report."""
    seen = df.select(row, column).dropna().distinct()
    grid = seen.select(row).distinct().crossJoin(seen.select(column).distinct())
    return grid.join(seen.withColumn("_p", F.lit(1)), [row, column], "left").select(row, column, F.coalesce("_p", F.lit(0)).alias("present"))


def non_overlapping(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """The matches of each key kept greedily: sorted by start, longest first, each that begins at or after the end of the last one kept.

    A match that begins before the end of every longer run so far can't be kept, so a
    window first cuts the matches into runs that don't touch; only inside a run is
    the walk sequential, over its (start, end) pairs. Exact repeats of a match stay once.
    """
    m = df.dropDuplicates([*key, start, end])
    over = Window.partitionBy(*key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max(end).over(over) <= F.col(start), F.lit(True)).cast("int")
    run = F.sum("_f").over(Window.partitionBy(*key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, 0))
    runs = m.withColumn("_f", fresh).withColumn("_run", run)
    spans = runs.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), (-F.col(end)).alias("e")))).alias("_m"))
    zero = F.struct(F.lit(None).cast("long").alias("to"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("kept"))
    take = lambda a, x: F.struct((-x["e"]).cast("long").alias("to"), F.array_append(a["kept"], F.struct(x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"))).alias("kept"))
    walk = F.aggregate("_m", zero, lambda a, x: F.when(a["to"].isNull() | (x["s"] >= a["to"]), take(a, x)).otherwise(a))["kept"]
    kept = spans.select(*key, F.explode(walk).alias("_k")).select(*key, F.col("_k.s").cast(df.schema[start].dataType).alias(start), (-F.col("_k.e")).cast(df.schema[end].dataType).alias(end))
    return m.join(kept, [*key, start, end], "left_semi")


def top_bottom(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k rows greatest and the k least by a column, ties by ``tie``, with ``side`` and ``rank``."""
    rows = df.filter(F.col(by).isNotNull())
    high = rows.orderBy(F.desc(by), tie).limit(k).withColumn("side", F.lit("top"))
    low = rows.orderBy(by, tie).limit(k).withColumn("side", F.lit("bottom"))
    over = Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col(by)).otherwise(F.col(by)), tie)
    return high.unionByName(low).withColumn("rank", F.row_number().over(over))
