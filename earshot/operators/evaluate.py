"""Everything that is asked of a feature matrix at once: the finance analysis and its evaluation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators import ml, panel, stats

#: What features are called. Fixed values, in the order of the measures reproduced here: for return models, evaluation and direction models.
RETURN_FEATURES = ("mean_", "mgmt_", "analyst_", "prepared_", "qa_", "sentiment_", "total_risk", "avg_risk", "num_risk")
EVALUATION_FEATURES = (*RETURN_FEATURES, "call_", "risk_delta")
DIRECTION_FEATURES = (*EVALUATION_FEATURES, "negative_emphasis", "neg_pos", "uncertainty_adj", "mgmt_analyst", "risk_sentiment", "qa_weighted")
SORTED_BY = ("mean_lm_net_score", "mean_vader_compound")


def _long(df: DataFrame, analysis: str, item: str) -> DataFrame:
    """Rows of a result as ``(analysis, item, measure, value)``."""
    names = [c for c, t in df.dtypes if c != item and t in ("double", "int", "bigint", "boolean")]
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(F.lit(analysis).alias("analysis"), F.col(item).cast("string").alias("item"), F.explode(cells).alias("x")).select("analysis", "item", "x.measure", "x.value")


def run_all(matrix: DataFrame, target: str = "abnormal_ret_1d", models: bool = True, trees: int = 100, rounds: int = 100) -> DataFrame:
    """``(analysis, item, measure, value)``: event study, sorts by two features with their spread, regression, and return models.

    The regression takes the features of ``RETURN_FEATURES`` present in 80 % of the
    rows. What can't be computed (too few rows, no such column) has no rows.
    """
    parts = [_long(stats.event_study(matrix, [c for c in ("abnormal_ret_1d", "abnormal_ret_3d", "abnormal_ret_5d") if c in matrix.columns]), "event_study", "window")]
    for f in SORTED_BY:
        if f in matrix.columns:
            by = stats.portfolio_sort(matrix, f, target)
            parts += [_long(by, f"portfolio_sort_{f}", "bucket"), _long(stats.long_short(by).withColumn("all", F.lit("spread")), f"long_short_{f}", "all")]
    features = panel.select_features(matrix, RETURN_FEATURES, 0.8)
    if features:
        parts.append(_long(stats.ols(matrix, target, features), "regression", "term"))
        if models:
            m = ml.return_models(matrix, features, target, trees=trees, rounds=rounds).withColumn("item", F.concat_ws(" ", "model", "feature"))
            parts.append(_long(m, "return_models", "item"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backtest_summary(matrix: DataFrame, feature: str, target: str) -> DataFrame:
    """One row: periods, mean and deviation of the spread, share of periods with a positive one, and the final running products."""
    b = stats.backtest(matrix, "quarter", feature, target)
    last = F.max_by(F.struct("cum_long", "cum_short"), "quarter")
    return b.agg(F.count("*").alias("periods"), F.avg("spread").alias("spread_mean"), F.stddev_samp("spread").alias("spread_sd"), F.avg((F.col("spread") > 0).cast("int")).alias("positive"), last["cum_long"].alias("cum_long"), last["cum_short"].alias("cum_short"))


def evaluate_finance(matrix: DataFrame, target: str = "abnormal_ret_1d", splits: int = 5, folds: int = 5, trees: int = 200, rounds: int = 200, least: int = 50) -> DataFrame:
    """``(analysis, item, measure, value)``: walk-forward R2, accuracies of the direction classifiers with their baseline, and backtests of two features.

    Fewer than ``least`` rows with a target give no rows. Features are those of
    ``EVALUATION_FEATURES`` present in 70 % of the rows.
    """
    y = panel.number(target)
    n = matrix.filter(y.isNotNull()).count()
    features = panel.select_features(matrix, EVALUATION_FEATURES, 0.7)
    empty = matrix.sparkSession.createDataFrame([], "analysis string, item string, measure string, value double")
    if n < least or not features:
        return empty
    parts = [_long(ml.walk_forward(matrix, features, target, "quarter", splits), "walk_forward", "split")]
    scores = ml.direction_models(matrix, features, target, folds=folds, trees=trees, rounds=rounds)
    parts.append(_long(ml.comparison(scores), "classification", "model"))
    parts += [_long(backtest_summary(matrix, f, target).withColumn("all", F.lit(f)), "backtest", "all") for f in SORTED_BY if f in matrix.columns]
    size = matrix.agg(F.count(y).cast("double").alias("n_samples"), F.lit(float(len(features))).alias("n_features"), F.greatest(F.avg((y > 0).cast("int")), 1 - F.avg((y > 0).cast("int"))).alias("baseline")).withColumn("all", F.lit("all"))
    out = _long(size, "data", "all")
    for p in parts:
        out = out.unionByName(p)
    return out


def as_json(results: DataFrame) -> str:
    """The results as nested JSON text: analyses, items, measures. They are a report of a few hundred rows."""
    out: dict = {}
    for r in results.collect():
        out.setdefault(r["analysis"], {}).setdefault(r["item"], {})[r["measure"]] = r["value"]
    return json.dumps(out, indent=2, sort_keys=True)
