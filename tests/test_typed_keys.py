"""Keys as typed don't lose rows."""

from datetime import date

from pyspark.sql import functions as F

from earshot.functions import keys
from earshot.plans import finance, panel, search


def folder(spark, path):
    """Files, panel, market, chunks and companies whose keys are typed in several ways, and one that can't be read."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("manifest", [("f1", "a", "Q1 2021"), ("f2", "A", "2021-Q2"), ("f3", "A", "2021Q3"), ("f4", "Acme Inc.", "2021Q1")], "file_path string, ticker string, quarter string")
    typed = ["2021Q1", "Q1 2021", "2021-Q1", "FY2021Q1", "2021q1", "H1 2021"]
    panel_rows = [(" a", q, float(i), float(i) / 10, 0.5) for i, q in enumerate(typed)] + [("Acme Inc.", "2021Q2", 1.0, 0.1, 0.1)]
    put("feature_matrix", panel_rows, "ticker string, quarter string, mean_lm_net_score double, abnormal_ret_1d double, mean_vader_compound double")
    put("market_reactions", [("A", "2021Q2", date(2021, 1, 1)), ("a ", "2021q1", date(2021, 1, 2))], "ticker string, quarter string, earnings_date date")
    put("chunks_with_sentiment", [("a",), ("A",), ("B",), ("Acme Inc.",)], "ticker string")
    put("companies", [("A", "Energy"), ("b", "Retail")], "ticker string, sector string")
    return str(path)


def test_joins(spark, tmp_path):
    d = folder(spark, tmp_path)
    assert sorted(r["file_path"] for r in panel.incremental_anti_join(spark, d).collect()) == ["f2", "f3", "f4"]
    assert sorted((r["file_path"], r["quarter"], r["matched"]) for r in panel.semi_join_market(spark, d).collect()) == [("f1", "Q1 2021", True), ("f2", "2021-Q2", True), ("f4", "2021Q1", None)]
    assert {(r["ticker"], r["n"], r["matched"]) for r in panel.target_semi_join(spark, d).collect()} == {("A", 2, True), ("ACME INC.", 1, None)}
    assert {(r["sector"], r["n"]) for r in panel.company_sector_rollup(spark, d).collect()} == {("Energy", 6), (None, 1)}


def test_backtest(spark, tmp_path):
    rows = {r["quarter"]: r for r in finance.portfolio_backtest(spark, folder(spark, tmp_path)).collect()}
    assert set(rows) == {"2021Q1", "H12021"}
    assert rows["2021Q1"]["n"] == 5 and rows["2021Q1"]["long"] == 0.3 and rows["2021Q1"]["short"] == 0.05
    assert (rows["H12021"]["n"], rows["H12021"]["spread"]) == (1, None)


def test_walk_forward(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(search.ml, "walk_forward", lambda x, *a: seen.append(sorted(r["quarter"] for r in x.collect())) or spark.createDataFrame([(1, 2, 0.5)], "split int, n bigint, r2 double"))
    out = search.walk_forward(spark, folder(spark, tmp_path)).collect()
    assert seen == [["2021Q1"] * 5 + ["2021Q2"]]
    assert {(r["split"], r["n"]) for r in out} == {(1, 2), (None, 1)}


def test_readable(spark):
    x = spark.createDataFrame([("A",), ("BRK.B",), ("NYSE:A",), (None,)], "t string").select(keys.readable_ticker(F.col("t")).alias("r"))
    assert [r["r"] for r in x.collect()] == [True, True, False, False]
