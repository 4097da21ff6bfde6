"""Statistics of returns: winsorising, quantile buckets, t tests, backtests, regressions, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from earshot.storage import stage

def quantiles(df: DataFrame, names: list[str], points: list[float]) -> DataFrame:
    """``(column, point, value)``: exact quantiles (linear interpolation) of each column, null and NaN left out.

    Distinct values are counted by column and value, ranged into ordered partitions
    that each sum their own, and only the two values around each quantile are
    picked, so no task holds a column. A column without values has no row.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in names])).alias("x")).select("x.column", "x.value").filter("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("_n"))
    ranged = stage(counts.repartitionByRange("column", "value").withColumn("_p", F.spark_partition_id()))
    parts = ranged.groupBy("column", "_p").agg(F.sum("_n").alias("_t"))  # a row per column and partition
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).withColumn("_all", F.sum("_t").over(Window.partitionBy("column")))
    own = Window.partitionBy("column", "_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    x = ranged.join(F.broadcast(parts), ["column", "_p"]).withColumn("_hi", F.col("_before") + F.sum("_n").over(own)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    x = x.withColumn("point", F.explode(F.array(*map(F.lit, points)))).withColumn("_at", F.col("point") * (F.col("_all") - 1))
    holds = lambda at: (F.col("_lo") <= at) & (at < F.col("_hi"))
    low, high = F.floor("_at"), F.ceil("_at")
    x = x.filter(holds(low) | holds(high))
    pick = x.groupBy("column", "point").agg(F.max("_at").alias("_at"), F.max(F.when(holds(low), F.col("value"))).alias("_a"), F.max(F.when(holds(high), F.col("value"))).alias("_b"))
    return pick.select("column", "point", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("value"))


def winsorize(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95, out: str = "winsorized") -> DataFrame:
    """Values held between two exact quantiles of the column (linear interpolation)."""
    at = quantiles(df, [value], [low, high])
    q = F.broadcast(at.agg(F.min("value").alias("_a"), F.max("value").alias("_b")))  # one row
    return df.join(q).withColumn(out, F.when(F.col(value).isNotNull(), F.greatest("_a", F.least("_b", F.col(value))))).drop("_a", "_b")


def qcut(df: DataFrame, value: str, n: int, out: str = "bucket") -> DataFrame:
    """Bucket 0 to n - 1 by quantiles of the column, right-closed, equal edges merged; null stays null."""
    at = quantiles(df, [value], [i / n for i in range(n + 1)])
    e = F.broadcast(at.agg(F.array_sort(F.collect_set("value")).alias("_e")))  # one row of n + 1 values
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    return df.join(e).withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda x: x < F.col(value))))).drop("_e")


def moments(value: str) -> list[Column]:
    c = F.col(value)
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")]


def t_statistic() -> Column:
    return F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n")))


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


def event_study(df: DataFrame, columns: list[str], level: float = 0.05) -> DataFrame:
    """``(window, n, mean, sd, t, p, significant)``: one-sample t of each return column, all in one pass; columns of fewer than 3 values have no t. ``p`` is two-sided, ``significant`` below ``level``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("window"), F.nanvl(c, F.lit(None).cast("double")).alias("r")) for c in columns])).alias("x")).select("x.window", "x.r")
    tested = long.groupBy("window").agg(*moments("r")).withColumn("t", t_statistic())  # a row per column
    return tested.withColumn("p", _t_p("t", F.col("n") - 1)).withColumn("significant", F.col("p") < level)


def portfolio_sort(df: DataFrame, feature: str, ret: str, n: int = 3) -> DataFrame:
    """``(bucket, n, mean, sd, feature_mean)`` of a return by quantile buckets of a feature, rows with either missing left out. Fewer than two rows a bucket give no result."""
    rows = df.select(F.nanvl(feature, F.lit(None).cast("double")).alias("f"), F.nanvl(ret, F.lit(None).cast("double")).alias("r")).dropna()
    got = qcut(rows, "f", n).groupBy("bucket").agg(*moments("r"), F.avg("f").alias("feature_mean"))  # at most n rows
    return got.withColumn("_all", F.sum("n").over(Window.partitionBy())).filter(F.col("_all") >= 2 * n).drop("_all")


def bucket_label(bucket: Column, names: tuple[str, ...] = ("Low", "Mid", "High")) -> Column:
    """The name of a bucket number, null beyond the names."""
    return F.get(F.array(*map(F.lit, names)), bucket)


def long_short(sorted_: DataFrame) -> DataFrame:
    """Spread of the highest over the lowest bucket and its pooled two-sample t."""
    lo, hi = F.min_by(F.struct("n", "mean", "sd"), "bucket").alias("lo"), F.max_by(F.struct("n", "mean", "sd"), "bucket").alias("hi")
    g = sorted_.agg(lo, hi)
    pooled = ((F.col("lo.n") - 1) * F.col("lo.sd") ** 2 + (F.col("hi.n") - 1) * F.col("hi.sd") ** 2) / (F.col("lo.n") + F.col("hi.n") - 2)
    spread = F.col("hi.mean") - F.col("lo.mean")
    return g.select(spread.alias("spread"), (spread / F.sqrt(pooled * (1 / F.col("lo.n") + 1 / F.col("hi.n")))).alias("t"), (F.col("lo.n") + F.col("hi.n")).alias("n"))


def backtest(df: DataFrame, period: str, feature: str, ret: str, least: int = 4) -> DataFrame:
    """Per period of enough rows: mean return at or above the feature's median, below it, the difference, and their running products."""
    rows = df.select(period, F.nanvl(feature, F.lit(None).cast("double")).alias("f"), F.nanvl(ret, F.lit(None).cast("double")).alias("r")).dropna()
    med = rows.groupBy(period).agg(F.median("f").alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    x = rows.join(med, period).groupBy(period).agg(F.first("n").alias("n"), F.avg(F.when(F.col("f") >= F.col("m"), F.col("r"))).alias("long"), F.avg(F.when(F.col("f") < F.col("m"), F.col("r"))).alias("short"))
    x = x.withColumn("short", F.coalesce("short", F.lit(0.0)))
    over = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per period
    return x.withColumn("spread", F.col("long") - F.col("short")).withColumn("cum_long", F.exp(F.sum(F.log1p("long")).over(over)) - 1).withColumn("cum_short", F.exp(F.sum(F.log1p("short")).over(over)) - 1)


def cumulative_abnormal(df: DataFrame, key: str, order: list[str], ret: str, window: int) -> DataFrame:
    """Sum of each key's first ``window`` returns in order, null where there are fewer."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.filter(F.col(ret).isNotNull()).withColumn("_r", rn).filter(F.col("_r") <= window)
    return first.groupBy(key).agg(F.when(F.count("*") >= window, F.sum(ret)).alias("car"))


def _rows(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(clean(y).alias("_y"), F.array(F.lit(1.0), *[clean(c) for c in xs]).alias("_x")).filter(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))


def _gram(rows: DataFrame, k: int, weight: Column | None = None) -> np.ndarray:
    """Sum of x x' (weighted) as one row of k(k+1)/2 partial sums."""
    w = F.lit(1.0) if weight is None else weight
    sums = rows.agg(*[F.sum(w * F.col("_x")[i] * F.col("_x")[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or 1e-300)
        c = (1 + n / c) or 1e-300
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if df > 0 else float("nan")


def f_p_value(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def ols(df: DataFrame, y: str, xs: list[str], lags: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``(term, coef, se, t, p, r2, adj_r2, f, n)`` of a least-squares fit, with Newey-West errors if ``order`` is given.

    The rows are summed into one k x k matrix on the executors; only that reaches
    the driver. With lags, products of a row with the one l before it in ``order``
    are summed likewise (default: the whole part of 4 (n / 100) ^ (2/9)).
    """
    k = len(xs) + 1
    src = df if order is None else df.withColumn("_o", F.struct(*order))
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    cols = [clean(y).alias("_y"), F.array(F.lit(1.0), *[clean(c) for c in xs]).alias("_x"), *([F.col("_o")] if order else [])]
    rows = src.select(*cols).filter(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    xx = _gram(rows, k)
    s = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") ** 2).alias("syy"), *[F.sum(F.col("_y") * F.col("_x")[i]).alias(f"xy{i}") for i in range(k)]).first()
    n, xy = s["n"], np.array([s[f"xy{i}"] or 0.0 for i in range(k)])
    inv = np.linalg.pinv(xx)
    b = inv @ xy
    sse = max((s["syy"] or 0.0) - b @ xy, 0.0)
    sst = (s["syy"] or 0.0) - (s["sy"] or 0.0) ** 2 / max(n, 1)
    r2 = 1 - sse / sst if sst > 0 else 0.0
    free = n - k
    if order is None:
        cov = inv * sse / max(free, 1)
    else:
        lags = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
        e = F.col("_y") - F.aggregate(F.zip_with("_x", F.array(*map(F.lit, b.tolist())), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
        g = rows.withColumn("_g", F.transform("_x", lambda v: v * e))
        if rows.groupBy("_o").count().filter("count > 1").limit(1).count():
            raise ValueError("a series needs one row per period")
        over = Window.orderBy("_o")  # a time series: one row per period, so as many rows as periods
        g = g.select("_g", *[F.lag("_g", i).over(over).alias(f"_l{i}") for i in range(1, lags + 1)])
        sums = g.agg(*[F.sum(F.col("_g")[i] * (F.col("_g") if lag == 0 else F.col(f"_l{lag}"))[j]).alias(f"m{lag}_{i}_{j}") for lag in range(lags + 1) for i in range(k) for j in range(k)]).first()
        meat = np.zeros((k, k))
        for lag in range(lags + 1):
            m = np.array([[sums[f"m{lag}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
            meat += m if lag == 0 else (1 - lag / (lags + 1)) * (m + m.T)
        cov = inv @ meat @ inv
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    f = (r2 / max(k - 1, 1)) / ((1 - r2) / max(free, 1)) if r2 < 1 and k > 1 else float("nan")
    out = []
    for name, c, e_ in zip(["const", *xs], b, se):
        t = float(c / e_) if e_ > 0 else float("nan")
        out.append((name, float(c), float(e_), t, float(t_p_value(t, free)), float(r2), float(1 - (1 - r2) * (n - 1) / max(free, 1)), float(f), float(f_p_value(f, k - 1, free)), int(n)))
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, t double, p double, r2 double, adj_r2 double, f double, f_p double, n long")


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 200, ci: float = 0.95, seed: int = 5) -> DataFrame:
    """``(mean, low, high)``: percentile interval of the mean over Poisson resamples.

    Each row draws its number of copies for every resample from a hash of its key,
    and only one pair of sums per resample leaves a task.
    """
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])
    rows = df.select(F.col(key).alias("k"), F.nanvl(value, F.lit(None).cast("double")).alias("v")).dropna()
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", "k"), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    x = rows.select("v", "k", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).select("v", "b", u.alias("u"))
    copies = F.lit(0)
    for e in edges:
        copies = copies + (F.col("u") > float(e)).cast("int")
    means = x.groupBy("b").agg((F.sum(copies * F.col("v")) / F.nullif(F.sum(copies), F.lit(0))).alias("m"))
    a = (1 - ci) / 2
    q = means.agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return rows.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).join(q).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
