"""The feature panel does all of its job, on a small fixture."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import panel

TEXTS = [
    "We expect a severe trade war next year. Revenue grew 5% to $3.2 million, up 20 bps from guidance!",
    "There are not any tariffs in the plan at all. The inevitable consideration of tariffs and inflation is unnecessary, they believe.",
    "Nothing to report here, thank you.",
]


@pytest.fixture(scope="module")
def rows(spark):
    schema = "chunk_id string, ticker string, quarter string, role string, section string, text string, chunk_index int, ingested_at timestamp, " + ", ".join(f"{c} double" for c in panel.SCORES + panel.FINBERT)
    score = [0.1] * len(panel.SCORES)
    data = [
        ("b", " a", "Q1 2021", "CEO", "Q&A", TEXTS[1], 1, datetime(2021, 1, 1), *score, 0.2, 0.3, 0.5),
        ("a", "A", "2021-Q1", "CEO", "Prepared Remarks", TEXTS[0], 0, datetime(2021, 1, 1), *score, 0.4, 0.1, 0.5),
        ("c", "A", "2021Q2", "CEO", "Prepared Remarks", TEXTS[2], 0, datetime(2021, 1, 1), *score, 0.5, 0.0, 0.5),
        ("a", "A", "2021Q1", "CEO", "Prepared Remarks", TEXTS[0], 0, datetime(2021, 1, 2), *score, 0.6, 0.2, 0.2),
    ]
    market = spark.createDataFrame([("A", "2021Q1", date(2021, 2, 1), 0.5)], "ticker string, quarter string, earnings_date date, abnormal_ret_1d double")
    return {r["quarter"]: r for r in panel.feature_panel(spark.createDataFrame(data, schema), market).collect()}


def test_risk_is_detected_not_guessed(rows):
    """trade war and the war in it (severe: high) in one chunk; tariffs and inflation in the other, whose first tariffs are negated; none in the next quarter. The second load of a chunk isn't counted."""
    r = rows["2021Q1"]
    assert (r["total_risk_count"], r["num_risk_categories"]) == (4, 2) and r["avg_risk_intensity"] == (3 + 3 + 2 + 2) / 2
    s = rows["2021Q2"]
    assert (s["total_risk_count"], s["avg_risk_intensity"], s["num_risk_categories"], s["risk_delta"]) == (0, 0, 0, -4)
    assert r["risk_sentiment_interaction"] == pytest.approx(0.4)


def test_finbert_answers_and_market(rows):
    assert rows["2021Q1"]["mean_finbert_positive"] == pytest.approx(0.3)
    assert rows["2021Q1"]["qa_avg_answer_length"] == 21
    assert rows["2021Q2"]["qa_pronoun_shift"] == rows["2021Q2"]["qa_specificity_drop"] == 0
    assert rows["2021Q1"]["earnings_date"] == date(2021, 2, 1) and rows["2021Q2"]["abnormal_ret_1d"] is None


@pytest.mark.parametrize("quarter,text", [("2021Q1", TEXTS[0] + " " + TEXTS[1]), ("2021Q2", TEXTS[2])])
def test_text_features_are_those_of_the_whole_call(spark, rows, quarter, text):
    c = F.col("t")
    want = spark.createDataFrame([(text,)], "t string").select(T.readability(c).alias("r"), T.forward_looking(c).alias("f"), T.specificity(c).alias("s")).first()
    names = {"fog_index": "fog", "flesch_kincaid": "flesch_kincaid", "avg_sentence_length": "sentence_length", "avg_word_length": "word_length", "vocab_richness": "richness"}
    for name, of in names.items():
        assert rows[quarter][f"call_{name}"] == pytest.approx(want["r"][of]), name
    for part in "fs":
        for name, value in want[part].asDict().items():
            assert rows[quarter][f"call_{name}"] == pytest.approx(value), name
