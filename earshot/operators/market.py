"""Prices around events: as-of rows, returns over trading days, abnormal returns and volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_prices(ticks: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``(key, date, close, volume)``: each day's last value and number of ticks."""
    x = ticks.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(ts).cast("date").alias("date"), F.col(value).alias("v"))
    return x.groupBy("key", "date").agg(F.max_by("v", F.struct("ts", "v")).alias("close"), F.count("*").alias("volume"))


def asof(events: DataFrame, prices: DataFrame, columns: list[str], forward: bool = False) -> DataFrame:
    """``events`` (key, date) with ``columns`` of the last price row at or before its date (or the first at or after).

    Both sides are put in one ordered stream per key and the last value seen is
    carried along, so the cost is one sort, whatever the gaps.
    """
    row = F.struct(F.col("date").alias("asof_date"), *columns)
    p = prices.select("key", "date", F.lit(0).alias("_e"), row.alias("_p"))
    both = p.unionByName(events.select("key", "date").distinct().withColumn("_e", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("key")
    seen = F.first("_p", ignorenulls=True).over(w.orderBy("date", F.desc("_e")).rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_p", ignorenulls=True).over(w.orderBy("date", "_e").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_p", seen).filter("_e = 1").select("key", "date", "_p.*")
    return events.join(found, ["key", "date"], "left")


def ahead(prices: DataFrame, windows: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Prices with the return from each row's close to that w rows later."""
    w = Window.partitionBy("key").orderBy("date")
    return prices.withColumns({f"ret_{n}d": F.lead("close", n).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1 for n in windows})


def event_returns(events: DataFrame, prices: DataFrame, windows: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Returns after the last trading row at or before each event."""
    return asof(events, ahead(prices, windows), [f"ret_{n}d" for n in windows])


def abnormal_returns(events: DataFrame, prices: DataFrame, benchmark: DataFrame, windows: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Event returns less those of the benchmark ``(date, close)`` at the same date; null if either is."""
    own = event_returns(events, prices, windows)
    dates = events.select(F.lit(0).cast(prices.schema["key"].dataType).alias("key"), "date").distinct()
    base = event_returns(dates, benchmark.withColumn("key", F.lit(0).cast(prices.schema["key"].dataType)), windows)
    base = base.select("date", *[F.col(f"ret_{n}d").alias(f"_b{n}") for n in windows])
    return own.join(base, "date", "left").withColumns({f"abnormal_ret_{n}d": F.col(f"ret_{n}d") - F.col(f"_b{n}") for n in windows}).drop(*[f"_b{n}" for n in windows])


def abnormal_volume(events: DataFrame, prices: DataFrame, lookback: int = 20, least: int = 5) -> DataFrame:
    """Volume of the first trading row at or after each event over the mean of up to ``lookback`` rows before it; null with fewer than ``least`` rows or a mean of 0."""
    w = Window.partitionBy("key").orderBy("date").rowsBetween(-lookback, -1)
    ratio = F.when(F.count("volume").over(w) >= least, F.col("volume") / F.nullif(F.avg("volume").over(w), F.lit(0.0)))
    return asof(events, prices.withColumn("abnormal_volume", ratio), ["abnormal_volume"], forward=True)


def simple_return(value: Column, before: Column) -> Column:
    return value / F.nullif(before, F.lit(0.0)) - 1


def log_return(value: Column, before: Column) -> Column:
    return F.when((value > 0) & (before > 0), F.ln(value / before))


def cumulative_return(ret: str, over) -> Column:
    """Running product of 1 + r, less 1; a total loss stays one."""
    wiped = F.max(F.when(F.col(ret) <= -1, 1).otherwise(0)).over(over)
    return F.when(wiped == 1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(over)) - 1)
