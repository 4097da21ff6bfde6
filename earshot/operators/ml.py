"""Models of return direction, return size and speaker role, with leak-free folds."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.stats import quantiles
from earshot.storage import bounded_broadcast, stage


def prepared(df: DataFrame, features: list[str], target: str) -> DataFrame:
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(*[c for c in df.columns if c not in (*features, target)], *[clean(c).alias(c) for c in features], clean(target).alias("y")).filter("y is not null")


#: Rows that one task of a fit should hold; smaller tables are fitted by fewer tasks, whose rounds then cost less.
ROWS_A_TASK = 20_000


def packed(df: DataFrame, n: int) -> DataFrame:
    """``df`` in no more partitions than its number of rows calls for."""
    return df.coalesce(max(1, -(-n // ROWS_A_TASK)))


def steps(features: list[str], train: DataFrame) -> PipelineModel:
    """Median imputation, scaling by mean and population deviation, and assembly, fitted on ``train`` alone. A feature without values or spread is 0."""
    medians = {r["column"]: r["value"] for r in quantiles(train, features, [0.5]).collect()}  # one row per feature
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(medians.get(c, 0.0))) for c in features]
    m = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = []
    for i, c in enumerate(features):
        mean, sd = m[f"m{i}"] or 0.0, m[f"s{i}"] or 0.0
        value = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), {medians.get(c, 0.0)!r}D)"
        scaled.append(f"({value} - {mean!r}D) / {sd!r}D AS `_{i}`" if sd > 0 else f"0.0D AS `_{i}`")
    statement = SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")
    return PipelineModel(stages=[statement, VectorAssembler(inputCols=[f"_{i}" for i in range(len(features))], outputCol="features")])


def feature_vector(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(df).select("features", *keep)


def direction_models(df: DataFrame, features: list[str], target: str, folds: int = 5, trees: int = 200, rounds: int = 200, key: list[str] = ["ticker", "quarter"]) -> DataFrame:  # noqa: B006
    """``(model, fold, accuracy, baseline, n)`` of three classifiers of the target's sign, folds dealt evenly within each class by a hash order."""
    rows = prepared(df, features, target).withColumn("label", (F.col("y") > 0).cast("double"))
    n = rows.count()
    order = Window.partitionBy("label", F.pmod(F.xxhash64(*key), F.lit(64))).orderBy(F.xxhash64(*key, "y"), *key)
    rows = rows.withColumn("fold", F.pmod(F.row_number().over(order) + F.pmod(F.xxhash64(*key), F.lit(64)), F.lit(folds)).cast("int"))
    rows = stage(rows.select("label", "fold", *features))
    models = {
        "logistic_regression": LogisticRegression(maxIter=1000),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=5, seed=42),
        "gradient_boosting": GBTClassifier(maxIter=rounds, maxDepth=3, seed=42),
    }

    def fold_rows(fold: int) -> list[tuple]:
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        head = steps(features, train)
        train, test = packed(feature_vector(head, train, ["label"]), n).cache(), packed(feature_vector(head, test, ["label"]), n)
        out = []
        for name, model in models.items():
            hit = model.copy().fit(train).transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("a"), F.avg("label").alias("p"), F.count("*").alias("n")).first()
            if hit["n"]:
                out.append((name, fold, hit["a"], max(hit["p"], 1 - hit["p"]), hit["n"]))
        train.unpersist()
        return out

    with ThreadPoolExecutor(folds) as pool:  # a fit is a row of small jobs, so folds run beside each other
        out = [r for part in pool.map(inheritable_thread_target(fold_rows), range(folds)) for r in part]
    return df.sparkSession.createDataFrame(out, "model string, fold int, accuracy double, baseline double, n bigint")


def walk_forward(df: DataFrame, features: list[str], target: str, order: str, splits: int = 3, ridge: float = 1.0) -> DataFrame:
    """``(split, n, r2)``: out-of-sample R2 of a ridge regression trained on all periods before each test block of periods."""
    rows = stage(prepared(df, features, target))
    periods = [r[0] for r in rows.select(order).distinct().dropna().orderBy(order).collect()]  # one row per period
    step = max(1, len(periods) // (splits + 1))
    out = None
    for i in range(1, splits + 1):
        block = periods[i * step : (i + 1) * step if i < splits else None]
        train, test = rows.filter(F.col(order) < block[0]), rows.filter(F.col(order).isin(block))
        head = steps(features, train)
        model = LinearRegression(labelCol="y", regParam=ridge, elasticNetParam=0.0).fit(head.transform(train))
        p = model.transform(head.transform(test))
        p = p.withColumn("m", F.avg("y").over(Window.partitionBy()))
        r2 = F.when(F.sum((F.col("y") - F.col("m")) ** 2) > 0, 1 - F.sum((F.col("y") - F.col("prediction")) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2)).otherwise(0.0)
        one = p.agg(F.count("*").alias("n"), r2.alias("r2")).select(F.lit(i).alias("split"), "n", "r2")
        out = one if out is None else out.unionByName(one)
    return out


def return_models(df: DataFrame, features: list[str], target: str, key: list[str] = ["ticker", "quarter"], folds: int | None = None, trees: int = 100, rounds: int = 100) -> DataFrame:  # noqa: B006
    """``(model, cv_r2, feature, importance)`` of ridge, lasso, forest and boosting regressors, best mean fold R2 first; importances are absolute coefficients of the scaled features or impurity gains.

    ``folds`` is by default 5, or a third of the rows if that is less, and 2 at least.
    """
    rows = prepared(df, features, target)
    folds = folds or max(2, min(5, rows.count() // 3))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int"))
    rows = stage(rows.select("y", "fold", *features))
    n = rows.count()
    models = {
        "ridge": LinearRegression(labelCol="y", regParam=1.0, elasticNetParam=0.0),
        "lasso": LinearRegression(labelCol="y", regParam=0.001, elasticNetParam=1.0),
        "random_forest": RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=3, seed=42),
        "gradient_boosting": GBTRegressor(labelCol="y", maxIter=rounds, maxDepth=2, seed=42),
    }

    def fold_r2(fold: int) -> dict[str, float]:
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        head = steps(features, train)
        mean = test.agg(F.avg("y")).first()[0]
        train, test = packed(feature_vector(head, train, ["y"]), n).cache(), packed(feature_vector(head, test, ["y"]), n).withColumn("m", F.lit(mean))
        out = {}
        for name, model in models.items():
            e = model.copy().fit(train).transform(test).agg(F.sum((F.col("y") - F.col("prediction")) ** 2).alias("e"), F.sum((F.col("y") - F.col("m")) ** 2).alias("t")).first()
            out[name] = 1 - e["e"] / e["t"] if e["t"] else 0.0
        train.unpersist()
        return out

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(inheritable_thread_target(fold_r2), range(folds)))
    r2 = {name: [p[name] for p in parts] for name in models}
    whole, out = packed(feature_vector(steps(features, rows), rows, ["y"]), n).cache(), []
    for name, model in models.items():
        fit = model.fit(whole)
        weight = [abs(float(c)) for c in (fit.coefficients if hasattr(fit, "coefficients") else fit.featureImportances.toArray())]
        out += [(name, float(sum(r2[name]) / folds), f, w) for f, w in zip(features, weight)]
    whole.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, cv_r2 double, feature string, importance double").orderBy(F.desc("cv_r2"), "model", F.desc("importance"), "feature")


def comparison(results: DataFrame) -> DataFrame:
    """One row per model with its mean and sample deviation over folds, best first."""
    return results.groupBy("model").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"), F.avg("baseline").alias("baseline"), F.sum("n").alias("n")).orderBy(F.desc("mean"), "model")


@F.udf(VectorUDT())
def _sublinear(v):
    return Vectors.sparse(v.size, [(int(i), 1 + math.log(x)) for i, x in zip(v.indices, v.values)])


def train_role_classifier(df: DataFrame, text: str, label: str, key: str, terms: int = 5000, iterations: int = 1000) -> tuple[PipelineModel, PipelineModel]:
    """``(words, model)``: a balanced classifier of texts by their labels, in two parts between which counts are replaced by 1 + log.

    The vocabulary are the ``terms`` most frequent words and pairs of words found in 2
    texts and at most 95 % of them. Null texts and labels are left out, of several
    rows of one key one counts. ``sinks.save_model`` stores each part.
    """
    rows = df.select(key, F.col(text).alias("t"), F.col(label).alias("l")).dropna().dropDuplicates([key])
    weights = rows.groupBy("l").agg(F.count("*").alias("c"))
    total = rows.count()
    rows = stage(rows.join(bounded_broadcast(weights.select("l", (F.lit(float(total)) / F.col("c")).alias("w"))), "l"))
    split = Pipeline(stages=[
        RegexTokenizer(inputCol="t", outputCol="w1", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement="SELECT *, concat(w1, w2) AS w12 FROM __THIS__"),
        CountVectorizer(inputCol="w12", outputCol="f0", vocabSize=terms, minDF=2, maxDF=0.95),
    ])
    words = split.fit(rows)
    counted = words.transform(rows).select("l", "w", _sublinear("f0").alias("f")).cache()
    pipe = Pipeline(stages=[StringIndexer(inputCol="l", outputCol="label", handleInvalid="keep"), IDF(inputCol="f", outputCol="g"), Normalizer(inputCol="g", outputCol="features"), LogisticRegression(weightCol="w", maxIter=iterations, regParam=0.001)])
    model = pipe.fit(counted)
    counted.unpersist()
    return words, model


def predict_roles(models: tuple[PipelineModel, PipelineModel], df: DataFrame, text: str, least: float = 0.4, out: str = "predicted") -> DataFrame:
    """``df`` with the label of each text and its ``confidence``; below ``least``, and for null texts, ``Unknown``."""
    words, model = models
    labels = F.array(*map(F.lit, model.stages[0].labels))
    later = PipelineModel(stages=model.stages[1:])
    held = df.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(text).isNotNull().alias("_there"))  # names of df may clash with the pipeline's
    x = words.transform(held).withColumn("f", _sublinear("f0"))
    p = later.transform(x).withColumn("confidence", F.array_max(vector_to_array("probability")))
    sure = (F.col("confidence") >= least) & F.col("_there")
    guess = F.coalesce(F.get(labels, F.col("prediction").cast("int")), F.lit("Unknown"))
    return p.select("_row.*", F.when(sure, guess).otherwise(F.lit("Unknown")).alias(out), "confidence")


def role_classifier(df: DataFrame, text: str, label: str, key: str, terms: int = 5000, least: float = 0.4, iterations: int = 1000) -> DataFrame:
    """``(n, accuracy, confident)`` of the classifier on a held-out fifth of the keys; below ``least`` confidence nothing is claimed."""
    rows = df.select(key, text, label).dropna().dropDuplicates([key])
    held = F.pmod(F.xxhash64(key), F.lit(5)) == 0
    models = train_role_classifier(rows.filter(~held), text, label, key, terms, iterations)
    p = predict_roles(models, rows.filter(held), text, 0.0)
    return p.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("accuracy"), F.avg((F.col("confidence") >= least).cast("int")).alias("confident"))


def fit_direction(df: DataFrame, features: list[str], target: str, trees: int = 200, rounds: int = 200) -> dict[str, PipelineModel]:
    """The three classifiers of the target's sign fitted on all rows, each with its imputation and scaling in one pipeline for ``sinks.save_model``."""
    rows = stage(prepared(df, features, target).withColumn("label", (F.col("y") > 0).cast("double")).select("label", *features))
    head = steps(features, rows)
    vectors = packed(feature_vector(head, rows, ["label"]), rows.count()).cache()
    fits = {
        "logistic_regression": LogisticRegression(maxIter=1000),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=5, seed=42),
        "gradient_boosting": GBTClassifier(maxIter=rounds, maxDepth=3, seed=42),
    }
    out = {name: PipelineModel(stages=[*head.stages, m.fit(vectors)]) for name, m in fits.items()}
    vectors.unpersist()
    return out
