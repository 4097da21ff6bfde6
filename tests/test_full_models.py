"""The model queries are registered with the whole job."""

import pytest

from earshot.operators import ml
from earshot.plans import finance, search


def test_direction_and_return_models(spark, monkeypatch):
    calls = {}
    monkeypatch.setattr(search, "table", lambda *a: None)
    monkeypatch.setattr(search, "_features", lambda x: ["x"])
    for name in ("direction_models", "return_models"):
        monkeypatch.setattr(ml, name, lambda *a, _n=name, **k: calls.update({_n: k}))
        search.QUERIES[name](spark, "")
    assert calls == {"direction_models": {"folds": 5, "trees": 200, "rounds": 200}, "return_models": {"trees": 100, "rounds": 100}}


def test_resamples(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(finance, "table", lambda *a: spark.createDataFrame([("a", "q", "d", 1.0)], "ticker string, quarter string, earnings_date string, ret_1d double"))
    monkeypatch.setattr(finance.stats, "bootstrap_mean", lambda *a, **k: calls.append(k))
    finance.bootstrap_ci(spark, "")
    assert calls == [{"resamples": 1000}]


def test_boosting_rounds_are_not_a_share_of_the_trees(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def gbt(**k):
        seen.append(k["maxIter"])
        raise Stop

    monkeypatch.setattr(ml, "GBTClassifier", gbt)
    df = spark.createDataFrame([("a", "q", 1.0, 1.0)], "ticker string, quarter string, x double, r double")
    with pytest.raises(Stop):
        ml.direction_models(df, ["x"], "r")
    assert seen == [200]


def test_all_features_of_the_matrix_are_taken(spark):
    from earshot.operators import evaluate, panel

    names = ["mean_lm_net_score", "call_fog_index", "qa_filler_rate", "risk_delta", "neg_pos_ratio", "total_risk_count", "ret_1d"]
    df = spark.createDataFrame([tuple([1.0] * 5 + [None if i else 1.0, 1.0]) for i in range(4)], ", ".join(f"{c} double" for c in names))
    assert panel.select_features(df, evaluate.DIRECTION_FEATURES, 0.7) == names[:5]


def test_models_are_saved_with_their_scaling(spark, tmp_path):
    from earshot.operators import sinks

    rows = [(str(i), "q", float(i % 7), None if i % 5 == 0 else float(-(i % 7)), 1.0 if i % 7 > 3 else -1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "ticker string, quarter string, a double, b double, r double")
    models = ml.fit_direction(df, ["a", "b"], "r", trees=5, rounds=3)
    for name, model in models.items():
        sinks.save_model(model, str(tmp_path / name))
        again = sinks.load_model(str(tmp_path / name))
        want, got = ([x["prediction"] for x in m.transform(df).orderBy("ticker").collect()] for m in (model, again))
        assert want == got and sum((p == 1) == (x[4] > 0) for p, x in zip(want, sorted(rows))) == 80
    assert sinks.load_model(str(tmp_path / "none")) is None


def test_scaling_is_by_the_population(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "a double")
    got = [r["_0"] for r in ml.steps(["a"], df).transform(df).collect()]
    assert [round(x, 9) for x in got] == [round(x / 0.5**0.5, 9) for x in (-1, 1, 0, 0)]


def test_roles_are_predicted(spark):
    rows = [(str(i), "thank you operator next question" if i % 2 else "our revenue grew in the quarter", "Analyst" if i % 2 else "Management") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t string, l string")
    models = ml.train_role_classifier(df, "t", "l", "k", iterations=50)
    new = spark.createDataFrame([("a", "next question operator"), ("b", "revenue grew"), ("c", None)], "k string, t string")
    got = {r["k"]: r["predicted"] for r in ml.predict_roles(models, new, "t").collect()}
    assert got == {"a": "Analyst", "b": "Management", "c": "Unknown"}


def test_role_classifier(spark):
    rows = [(str(i), "thank you operator next question" if i % 2 else "our revenue grew in the quarter", "Analyst" if i % 2 else "Management") for i in range(60)]
    r = ml.role_classifier(spark.createDataFrame(rows, "k string, t string, l string"), "t", "l", "k").first()
    assert r["accuracy"] == 1.0 and r["confident"] == 1.0
