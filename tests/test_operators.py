"""Operators on small fixtures, against results worked out by hand or by brute force."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import keys, lexicons, text as T
from earshot.operators import graph, ingest, market, relational, retrieval, risk, sentiment, sinks, stats
from earshot.sources import transcripts
from earshot.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("typed,want", [("2021Q3", "2021Q3"), ("2021-Q3", "2021Q3"), ("FY2021Q3", "2021Q3"), ("Q3 2021", "2021Q3"), ("2021q3 ", "2021Q3"), ("H1 2021", "H12021"), (None, None)])
def test_quarters(spark, typed, want):
    assert one(spark, typed, keys.normalize_quarter) == want


@pytest.mark.parametrize("typed,want", [("Aug 27, 2020, 9:00 p.m. ET", date(2020, 8, 27)), ("Jan. 31, 2019 11:00 a.m. ET", date(2019, 1, 31)), ("January 5, 2021", date(2021, 1, 5)), ("2020-02-03", date(2020, 2, 3)), ("soon", None), ("", None), (None, None)])
def test_dates(spark, typed, want):
    assert one(spark, typed, keys.parse_date) == want


def test_text_measures(spark):
    assert one(spark, "für über", T.word_count) == 2
    assert one(spark, "One two. Three four five six! ok", lambda c: F.size(T.sentences(c))) == 1
    assert one(spark, "see [2], [1] and [2]", T.citations) == [1, 2]
    assert one(spark, "ideate", T.syllables) == 2  # ideat: i, ea
    assert one(spark, "", lambda c: T.readability(c)["fog"]) == 0.0
    assert one(spark, "strong and strong, weak", lambda c: T.lexicon_scores(c, ["strong"], ["weak"], [])["net"]) == 0.0


def test_risk_windows(spark):
    rows = spark.createDataFrame([(1, "we do not see tariffs"), (2, "we saw no tariffs"), (3, "a severe trade war, then wars"), (4, None), (5, "")], "id int, text string")
    found = risk.detect(rows, risks={"g": ["tariffs", "war", "trade war"]}, intensifiers=["severe"], diminishers=[], negators=["not", "no"]).collect()
    by = {(r["id"], r["keyword"], r["at"]): r for r in found}
    assert by[1, "tariffs", 14]["negated"] and not by[2, "tariffs", 10]["negated"]  # the window ends before the token in front of the phrase
    assert sorted(k for k in by if k[0] == 3) == [(3, "trade war", 9), (3, "war", 15), (3, "war", 25)]
    assert by[3, "trade war", 9]["severity"] == "high"


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    least = {}
    for n in parent:
        least[find(n)] = min(least.get(find(n), n), n)
    assert got == {n: least[find(n)] for n in parent}


def test_asof_and_returns(spark):
    p = spark.createDataFrame([("a", date(2024, 1, d), float(v), 10 * d) for d, v in ((2, 10), (3, 11), (5, 22), (8, 33))], "key string, date date, close double, volume long")
    ev = spark.createDataFrame([("a", date(2024, 1, 4)), ("a", date(2024, 1, 1)), ("a", date(2024, 1, 3)), ("b", date(2024, 1, 4))], "key string, date date")
    got = {(r["key"], r["date"].day): (r["close"], r["ret_1d"]) for r in market.event_returns(ev, p, (1,)).join(market.asof(ev, p, ["close"]).select("key", "date", "close"), ["key", "date"]).collect()}
    assert got == {("a", 4): (11.0, 1.0), ("a", 1): (None, None), ("a", 3): (11.0, 1.0), ("b", 4): (None, None)}
    assert [r["asof_date"] for r in market.asof(ev.filter("key = 'a'"), p, ["close"], forward=True).orderBy("date").collect()] == [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 5)]


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0), (998, 1.0, float("nan"), 1.0)], "i int, a double, b double, y double")
    m = np.column_stack([np.ones(200), x])
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    got = {r["term"]: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    assert np.allclose([got[t]["coef"] for t in ("const", "a", "b")], want) and got["a"]["n"] == 200
    e = y - m @ want
    g = m * e[:, None]
    lags = int(4 * 2 ** (2 / 9))
    meat = g.T @ g + sum((1 - k / (lags + 1)) * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:]) for k in range(1, lags + 1))
    inv = np.linalg.inv(m.T @ m)
    hac = {r["term"]: r["se"] for r in stats.ols(df, "y", ["a", "b"], order=["i"]).collect()}
    assert np.allclose([hac[t] for t in ("const", "a", "b")], np.sqrt(np.diag(inv @ meat @ inv)))


def test_p_values():
    assert abs(stats.t_p_value(1.989, 13477) - 0.0467) < 5e-4
    assert abs(stats.t_p_value(2.776445, 4) - 0.05) < 1e-6
    assert abs(stats.f_p_value(4.0, 2, 30) - 0.02885) < 1e-4


def test_qcut_merges_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3)] + [(None,)], "v double")
    assert sorted((r["v"] or 0, r["bucket"]) for r in stats.qcut(df, "v", 3).collect() if r["v"] is not None) == [(1.0, 0)] * 4 + [(2.0, 1), (3.0, 1)]
    assert stats.qcut(df, "v", 3).filter("v is null and bucket is null").count() == 1


def test_bootstrap_covers_mean(spark):
    r = stats.bootstrap_mean(spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v")), "v", "id").first()
    assert r["low"] < r["mean"] == 4.5 < r["high"] and r["high"] - r["low"] < 1.2


def test_missing_quarters(spark):
    df = spark.createDataFrame([("a", "2020Q4"), ("a", "2021Q3"), ("a", "x"), ("b", "2020Q1"), (None, None)], "t string, q string")
    assert sorted(tuple(r) for r in keys.missing_quarters(df, "t", "q").collect()) == [("a", "2021Q1"), ("a", "2021Q2")]


def test_chunker_keeps_every_sentence():
    text = " ".join(f"Sentence number {i} has a few more words in it." for i in range(200))
    chunks = ingest.chunk_sentences(text, 100, 20, 20)
    assert all(len(c.split()) <= 120 for c in chunks)
    assert all(f"number {i} has" in " ".join(chunks) for i in range(200))
    assert ingest.chunk_sentences("Too short.", 100, 20, 20) == [] and ingest.chunk_sentences("", 100, 20, 20) == []


def test_transcript_turns(spark):
    t = "Welcome.\nJane Doe -- Chief Financial Officer\nThank you all.\nMore words.\nOperator: Next question.\nJane Doe:\nSure."
    got = [(r["speaker"], r["role"], r["words"]) for r in ingest.turns(spark.createDataFrame([(1, t), (2, None)], "id int, text string"), ["id"]).orderBy("turn").collect()]
    assert got == [(None, "Unknown", "Welcome."), ("Jane Doe", "CFO", "Thank you all.\nMore words."), ("Operator", "Operator", "Next question."), ("Jane Doe", "CFO", "Sure.")]


def test_fuse_and_expand(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query int, id int, rank int")
    assert [r["id"] for r in retrieval.fuse(a, b).orderBy("rank").collect()] == [11, 10, 12]
    assert one(spark, "What is the outlook?", retrieval.expand) == ["What is the outlook?", "expect anticipate next quarter year guidance"]
    assert one(spark, "hello", retrieval.expand) == ["hello"]


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id long, v array<double>")
    q = df.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    got = {(r["query"], r["rank"]): r["id"] for r in retrieval.dense(df, q, "id", "v", 5, block=2).collect()}
    for i in (0, 20, 40):
        assert [got[i, k] for k in range(1, 6)] == list(np.argsort(-(v @ v[i]))[:5])


def test_upsert_sink_and_stream(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.parquet(src + "/1")
    schema = spark.read.parquet(src + "/1").schema
    run = lambda: incremental.keep_current(spark, src + "/*", schema, dst, str(tmp_path / "cp"), ["k"]).awaitTermination()
    run()
    spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int").write.parquet(src + "/2")
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(dst).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_files_and_sinks(spark, tmp_path):
    for root, body in (("r1", "first"), ("r2", "second")):
        d = tmp_path / root / "X"
        d.mkdir(parents=True)
        (d / "2021_Q3_abc_processed.txt").write_text(body)
        (d / "notes.txt").write_text("none")
    got = transcripts.text_files(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")]).collect()
    assert [(r["ticker"], r["quarter"], r["transcript_text"]) for r in got] == [("ABC", "2021Q3", "first")]
    assert transcripts.manifest(spark, str(tmp_path / "none.json")).count() == 0
    df = spark.createDataFrame([("a", [1, 2])], "k string, v array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["v"] == "[1,2]"
    assert one(spark, "Earnings Call Transcript\n1\tJane\tHello there\nBob\tHi", transcripts.clean_tabbed) == "Jane\nHello there\n\nBob\nHi"


def test_relational(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3)], "k string, v int")
    assert sorted(tuple(r) for r in relational.having(df, ["k"], 2).collect()) == [("a", 1), ("a", 2)]
    assert {r["k"]: r["v"] for r in relational.keep_one(df, ["k"], [F.desc("v")]).collect()} == {"a": 2, "b": 1, None: 3}
    assert relational.coverage(df, "k", "v").count() == 4
    assert math.isclose(lexicons.lexicon_table(spark, {"x": ["a", "b"]}).count(), 2)


def test_valence_rules(spark):
    v = lambda t: one(spark, t, lambda c: sentiment.valence(c, {"good": 2.0, "bad": -2.0}, ["very"], ["slightly"], ["not"])["compound"])
    assert 0 < v("slightly good") < v("good") < v("very good") and v("not good") < 0 and v("good but bad") < 0 and v("") == 0.0 and v("nothing") == 0.0


def test_model_scores(spark):
    def load():
        def model(texts):
            if "boom" in texts:
                raise ValueError
            return [("long" if len(t) > 3 else "short", 0.5) for t in texts]

        return model

    df = spark.createDataFrame([(1, "abcd"), (2, "ab"), (3, None)], "id int, t string")
    assert {r["id"]: r["r"]["label"] for r in df.select("id", sentiment.model_scores(load)("t").alias("r")).collect()} == {1: "long", 2: "short", 3: "short"}
    assert df.limit(1).select(sentiment.model_scores(load, batch=1)(F.lit("boom")).alias("r")).first()["r"]["label"] == "error"
    got = sentiment.sentence_scores(spark.createDataFrame([(1, "A first sentence. And a second one.")], "id int, t string"), ["id"], "t", sentiment.model_scores(load)).first()
    assert [s["sentence"] for s in got["sentences"]] == ["A first sentence.", "And a second one."]


def test_answer(spark):
    hits = spark.createDataFrame([(1, "alpha"), (2, "beta")], "rank int, text string")
    got = retrieval.answer("q?", hits, lambda prompt, history: f"see [2] and [9] of {len(history)}", [("a", "b")] * 6)
    assert got["answer"].endswith("of 4") and [s["text"] for s in got["cited_sources"]] == ["beta"]
    assert retrieval.answer("q?", hits.limit(0), None)["sources"] == []


def test_lexicon_of_full_size(spark, tmp_path):
    """Lists read from a file, a thousand words long: the same shares as sets in Python give."""
    import json
    import random

    from earshot.functions import lexicons, text as T

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    lists = {"pos": sorted({word() for _ in range(400)}), "neg": sorted({word() for _ in range(1000)}), "unc": sorted({word() for _ in range(200)})}
    (tmp_path / "lists.json").write_text(json.dumps(lists))
    table = lexicons.read_lexicon(spark, str(tmp_path / "lists.json"))
    read = {k: [x["term"] for x in table.filter(F.col("lexicon") == k).collect()] for k in lists}
    assert {k: sorted(v) for k, v in read.items()} == lists and lexicons.read_taxonomy(spark, str(tmp_path / "lists.json"))["neg"] == lists["neg"]
    texts = [" ".join(r.choice(lists[r.choice(list(lists))]) if r.random() < 0.5 else word() for _ in range(80)) for _ in range(20)] + ["", "  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.lexicon_scores(F.col("t"), read["pos"], read["neg"], read["unc"]).alias("s")).collect()
    for row in got:
        seen = set(row["t"].lower().split())
        n = max(len(seen), 1)
        p, m, u = (len(seen & set(lists[k])) for k in ("pos", "neg", "unc"))
        assert (row["s"]["pos"], row["s"]["neg"], row["s"]["unc"]) == (p / n, m / n, u / n) and abs(row["s"]["net"] - (p - m) / n) < 1e-12


def test_word_forms():
    from earshot.functions import lexicons

    assert lexicons.word_forms(["decline", "worry", "miss"], ["weak", "noisy", "stable"], ["loss", "penalty"], ["lost"]) == [
        "decline", "declines", "declined", "declining", "worry", "worries", "worried", "worrying", "miss", "misses", "missed", "missing", "weak", "weakly", "noisy", "noisily", "stable", "stably", "loss", "losses", "penalty", "penalties", "lost",
    ]


def test_quantiles_match_numpy(spark):
    import numpy as np

    from earshot.operators import stats

    r = np.random.default_rng(4)
    data = [(float(a), float(b), None) for a, b in zip(r.normal(size=501), r.integers(0, 5, 501))] + [(None, float("nan"), None)]
    got = {(x["column"], x["point"]): x["value"] for x in stats.quantiles(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"], [0.0, 0.05, 1 / 3, 0.5, 1.0]).collect()}
    for i, c in enumerate("ab"):
        values = [d[i] for d in data[:501]]
        for q in (0.0, 0.05, 1 / 3, 0.5, 1.0):
            assert abs(got[c, q] - np.quantile(values, q)) < 1e-12
    assert not any(k[0] == "c" for k in got)


def test_event_study_p_values(spark):
    from earshot.operators import stats

    rows = [(0.1, 0.5), (0.2, -0.4), (0.15, 0.1), (0.12, None)]
    got = {r["window"]: r for r in stats.event_study(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert got["a"]["significant"] and not got["b"]["significant"] and abs(got["a"]["p"] - stats.t_p_value(got["a"]["t"], 3)) < 1e-12
    assert abs(stats.t_p_value(2.262157, 9) - 0.05) < 1e-6


def test_components_of_a_long_chain(spark):
    """A chain that takes many rounds is one component; so are two chains two."""
    n = 3000
    edges = spark.range(n - 1).selectExpr("concat('a', id) a", "concat('a', id + 1) b").union(spark.range(50).selectExpr("concat('b', id) a", "concat('b', id + 1) b"))
    got = graph.connected_components(edges).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [51, n]


def test_many_tab_fields_and_lines(spark):
    """Speech after the 1,000th field and all lines stay."""
    text = "7\tAnn Lee\t" + "\t".join(f"w{i}" for i in range(1200))
    got = one(spark, "Earnings Call Transcript\n" + text + "\n" + "\n".join(["x\ty"] * 5), transcripts.clean_tabbed)
    assert got.startswith("Ann Lee\nw0 w1") and "w1199" in got and got.count("x\ny") == 5


def test_file_and_folder_keys(spark):
    assert one(spark, "2021_Q3_abc whatever.pdf", transcripts.file_quarter) == "2021Q3" and one(spark, "x2021_Q3_a.txt", transcripts.file_quarter) is None
    names = {"Acme": "ACM", "acme": "OTH", "Beta Co": "BET"}
    for folder, want in (("Acme", "ACM"), ("acme", "OTH"), ("ACME", "ACM"), ("beta co", "BET"), ("gamma", "GAMMA"), (None, None)):
        assert one(spark, folder, lambda c: transcripts.folder_ticker(c, names)) == want
    assert one(spark, "gamma", lambda c: transcripts.folder_ticker(c, {})) == "GAMMA"


def test_prices_are_fetched_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fetch(ticker):
        (calls / f"{ticker}-{len(list(calls.iterdir()))}").write_text("")
        if ticker == "BAD":
            raise OSError
        return [("2021-01-04T00:00:00-05:00", 10, 5), ("2021-01-05", 11.5, 6)]

    events = spark.createDataFrame([("A",), ("A",), ("BAD",), (None,)], "ticker string")
    path = str(tmp_path / "prices")
    for _ in range(2):
        got = transcripts.prices(spark, path, fetch, events, tries=2, wait=0.01)
        assert [(r["ticker"], str(r["date"]), r["close"]) for r in got.orderBy("date").collect()] == [("A", "2021-01-04", 10.0), ("A", "2021-01-05", 11.5)]
    assert len([f for f in calls.iterdir() if f.name.startswith("A")]) == 1 and transcripts.prices(spark, str(tmp_path / "none")).count() == 0


def test_dimension_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"ticker": "A", "name": "Acme"}, {"ticker": "B", "name": "Beta", "sector": "X", "more": 1}]')
    (tmp_path / "cal.csv").write_text('ticker,quarter,date\na,Q1 2021,"Jan. 5, 2021"\nb,2021Q2,soon\n')
    assert [tuple(r) for r in transcripts.companies(spark, str(tmp_path / "c.json")).orderBy("ticker").collect()] == [("A", "Acme", None, None), ("B", "Beta", "X", None)]
    assert [tuple(r) for r in transcripts.calendar(spark, str(tmp_path / "cal.csv")).collect()] == [("A", "2021Q1", date(2021, 1, 5))]
    spark.createDataFrame([("c", '["x"]', '[{"category": "x", "negated": false}]', 1)], "chunk_id string, risk_categories string, risk_details string, risk_count long").write.parquet(str(tmp_path / "r"))
    r = transcripts.chunks_with_risk(spark, str(tmp_path / "r")).first()
    assert r["risk_categories"] == ["x"] and r["risk_details"][0]["category"] == "x" and r["text"] is None


def test_swap_keeps_the_table_whatever_happens(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_table(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), path, ["k"], [F.desc("v")])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 2)]
    broken = spark.createDataFrame([("b", 1)], "k string, v int").withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        sinks.upsert_table(broken, path, ["k"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 2)]
    (tmp_path / "t").rename(tmp_path / "t.old-x")  # cut off between the two moves
    sinks.upsert_table(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 3)]


def test_a_file_per_row(spark, tmp_path):
    df = spark.createDataFrame([("A", "2021Q1", "hello"), ("B/C", "2021Q1", "héllo there"), ("A", "2021Q1", "hi")], "ticker string, quarter string, transcript_text string")
    out = {r["ticker"]: r["file_path"] for r in sinks.write_texts(df, str(tmp_path / "texts")).collect()}
    assert open(out["A"]).read() == "hello" and open(out["B/C"], encoding="utf-8").read() == "héllo there" and len(out) == 2


@pytest.mark.parametrize("seed", range(3))
def test_non_overlapping_matches_equal_the_greedy_walk(spark, seed):
    from earshot.operators import relational

    r = np.random.default_rng(seed)
    spans = sorted({(int(s), int(s + n)) for s, n in zip(r.integers(0, 60, 40), r.integers(1, 9, 40))}, key=lambda x: (x[0], -x[1]))
    want, to = [], -1
    for s, e in spans:
        if s >= to:
            want.append((s, e))
            to = e
    got = relational.non_overlapping(spark.createDataFrame([("k", s, e) for s, e in [*spans, spans[0]]], "k string, s int, e int"), ["k"], "s", "e")
    assert sorted((x["s"], x["e"]) for x in got.collect()) == want


def test_staged_folders_are_freed(spark):
    import os

    from earshot import storage

    mark = storage.staged()
    df = storage.stage(spark.range(5))
    path = storage._STAGED[-1][1].replace("file:", "").replace("//", "/")
    assert os.path.isdir(path) and df.count() == 5
    storage.free(mark)
    assert not os.path.isdir(path) and storage.staged() == mark


def test_roles_in_cascade(spark):
    """By title, by a title elsewhere, by the introduction, by how the call is opened, by a classifier; and one turn of an unknown speaker."""
    filler = "We talk about the quarter and the year at length. " * 12
    t = "\n".join([
        "Ann Lee:", "Good day, with me today are Bob Ray, our chief executive officer, and Cat Fox.", "Bob Ray:", "Thank you. " + filler, "Cat Fox (Chief Financial Officer)", "Numbers. " + filler, "DAN HILL: A question about margins.",
        "Cat Fox:", "Our answer. " + filler, "Operator: Next, please.", "Eve Moss, Northolt Bank Analyst Desk With A Very Long Name For Its Department Of Equities: Hello there.", "Safe Harbor:", "this is no name.",
    ])
    df = spark.createDataFrame([(1, t), (2, "Ann Lee:\nonly one label here"), (3, None), (4, "")], "id int, text string")
    classify = lambda c: F.when(F.contains(c, F.lit("margins")), "Analyst").otherwise("Unknown")
    got = {(r["id"], r["turn"]): (r["speaker"], r["role"]) for r in ingest.turns(df, ["id"], classify=classify).collect()}
    assert got == {
        (1, 1): ("Ann Lee", "IR"), (1, 2): ("Bob Ray", "CEO"), (1, 3): ("Cat Fox", "CFO"), (1, 4): ("DAN HILL", "Analyst"), (1, 5): ("Cat Fox", "CFO"), (1, 6): ("Operator", "Operator"), (1, 7): ("Eve Moss", "Analyst"), (2, 1): ("Unknown", "Unknown"),
    }


def test_parse_transcripts(spark):
    said = " ".join(f"This is sentence number {i} of our remarks today." for i in range(150))
    asked = " ".join(f"We answer point {i} with some care now." for i in range(40))
    t = f"Copyright 2021 of us\nJane Doe -- Chief Financial Officer\n{said}\nOperator: We'll now take questions. " + "Please wait for your turn and keep it short, thank you all very much. " * 5 + f"\nJane Doe:\n{asked}"
    got = ingest.parse_transcripts(spark.createDataFrame([("A", "2021Q1", t), ("A", "2021Q1", "x" * 120), ("B", "2021Q1", "short"), ("C", "2021Q1", None)], "ticker string, quarter string, transcript_text string")).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == [f"A_2021Q1_{i:04d}" for i in range(len(got))] and {r["ticker"] for r in got} == {"A"}
    assert [(r["speaker"], r["role"], r["section"]) for r in got][0] == ("Jane Doe", "CFO", "prepared_remarks") and (got[-1]["speaker"], got[-1]["role"], got[-1]["section"]) == ("Jane Doe", "CFO", "qa")
    assert all(len(r["text"].split()) <= 400 for r in got) and "Copyright" not in got[0]["text"]


def test_role_of_a_turn_by_its_first_characters(spark):
    row = spark.createDataFrame([("a" * 150 + "b" * 150 + "now our first question" + "c" * 150,)], "t string")
    r = row.select(T.qa_boundary(F.col("t")).alias("b"), "t").select(*[T.turn_section(F.lit(x), F.col("t"), F.col("b")).alias(n) for n, x in (("p", "b" * 120), ("q", "c" * 120), ("s", "cc"))]).first()
    assert (r["p"], r["q"], r["s"]) == ("prepared_remarks", "qa", "prepared_remarks")
