"""Queries of relational and panel operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import keys, text as T
from earshot.operators import panel, relational as R, stats
from earshot.plans import text as X
from earshot.sources.tables import table

CH, FM, MR = "chunks_with_sentiment", "feature_matrix", "market_reactions"
_SEC = "CASE WHEN regexp_replace(lower(section), '[^a-z]+', '', 'g') IN ('qa', 'questionsandanswers') THEN 'qa' WHEN regexp_replace(lower(section), '[^a-z]+', '', 'g') IN ('preparedremarks', 'prepared') THEN 'prepared_remarks' END"
_ROL = "CASE WHEN length(role) <= 3 THEN upper(role) ELSE upper(role[1:1]) || lower(role[2:]) END"


#: Repeated loads of a chunk are one chunk: the first load counts. A null id is no repeat of another.
_FIRST = f"(SELECT * FROM {CH} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"


def keyed_sql(of: str = _FIRST) -> str:
    return f"(SELECT * REPLACE ({X._TICK} AS ticker, {X._Q} AS quarter, {_SEC} AS section, {_ROL} AS role) FROM (SELECT *, {X._S} AS s FROM {of}))"


def market_sql() -> str:
    return f"(SELECT * FROM (SELECT * REPLACE ({X._TICK} AS ticker, {X._Q} AS quarter) FROM (SELECT *, {X._S} AS s FROM {MR})) QUALIFY row_number() OVER (PARTITION BY ticker, quarter ORDER BY earnings_date DESC, ret_1d DESC NULLS LAST, abnormal_ret_1d DESC NULLS LAST) = 1)"


def r9(c, a=None):
    return F.round(c, 9).alias(a or c)


def _chunks(spark, d):
    """The chunks under canonical keys, each once (the first load)."""
    return panel.keyed(panel.first_loads(table(spark, d, CH)))


def _market(spark, d):
    m = table(spark, d, MR).withColumn("ticker", keys.normalize_ticker(F.col("ticker"))).withColumn("quarter", keys.normalize_quarter(F.col("quarter")))
    return R.keep_one(m, ["ticker", "quarter"], [F.desc("earnings_date"), F.desc_nulls_last("ret_1d"), F.desc_nulls_last("abnormal_ret_1d")])


def sentiment_trends(spark, d):
    x = _chunks(spark, d)
    return x.groupBy("quarter").agg(*[r9(F.avg(panel.number(c)), c) for c in panel.SCORES])


def sentiment_aggregate_stats(spark, d):
    c = panel.number("lm_net_score")
    return _chunks(spark, d).groupBy("ticker").agg(r9(F.avg(c), "lm_net_score_mean"), r9(F.stddev_samp(c), "lm_net_score_std"), F.count(c).alias("lm_net_score_count"))


def prepared_vs_qa_divergence(spark, d):
    return panel.divergence(_chunks(spark, d), ["ticker", "quarter"], "lm_net_score").select("ticker", "quarter", r9("prepared"), r9("qa"), r9("divergence"))


def sentiment_panel(spark, d):
    p = panel.sentiment_panel(_chunks(spark, d))
    return p.select("ticker", "quarter", *[r9(c) for c in p.columns[2:]])


def lexicon_trend_momentum(spark, d):
    p = panel.sentiment_panel(_chunks(spark, d))
    return p.select("ticker", "quarter", r9(panel.momentum(p, "mean_lm_net_score"), "momentum"), r9(panel.momentum(p, "mean_vader_compound"), "vader_momentum"))


def qa_dynamics(spark, d):
    g = panel.qa_dynamics(_chunks(spark, d), ["ticker", "quarter"])
    return g.select("ticker", "quarter", *[r9(c) if c != "qa_deflection_count" else c for c in g.columns[2:]])


def call_text_concat(spark, d):
    x = _chunks(spark, d).filter("text is not null")
    g = x.groupBy("ticker", "quarter").agg(panel.call_text(x, [], "chunk_id").alias("call"), F.count("*").alias("chunks"))
    return g.select("ticker", "quarter", "chunks", F.length("call").alias("chars"), F.md5("call").alias("digest"), T.word_count(F.col("call")).alias("words"))


def quarter_summary(spark, d):
    return _chunks(spark, d).groupBy("quarter").agg(
        F.count("*").alias("chunks"), F.count_distinct("speaker").alias("speakers"), F.count_distinct("ticker").alias("tickers"), r9(F.avg(panel.number("lm_net_score")), "net"), r9(F.avg(panel.number("vader_compound")), "vader"),
        F.sum(F.when(F.col("section") == "qa", 1).otherwise(0)).alias("qa_chunks"), F.sum(F.when(F.col("role") == "Analyst", 1).otherwise(0)).alias("analyst_chunks"),
    )


def value_counts(spark, d):
    x = _chunks(spark, d)
    one = lambda c: x.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit(c))
    return one("section").unionByName(one("role")).unionByName(one("finbert_label"))


def speaker_role_counts(spark, d):
    return _chunks(spark, d).groupBy("speaker", "role").agg(F.count("*").alias("n"))


def having_min_count(spark, d):
    """Files of canonical tickers with at least five files. Keys are shown as typed."""
    return R.having(_typed(table(spark, d, "manifest")), ["ticker"], 5).select("file_path", F.col("typed_ticker").alias("ticker"), F.col("typed_quarter").alias("quarter"))


def topk_bottomk(spark, d):
    x = panel.first_loads(table(spark, d, CH))
    return R.top_bottom(x, "lm_net_score", "chunk_id", 10).select("side", "rank", "chunk_id", "lm_net_score")


def _feature_rows(spark, d):
    """One row of the feature matrix per canonical key: the latest event, then the greatest returns and score."""
    f = keys.canonical(table(spark, d, FM))
    return R.keep_one(f, ["ticker", "quarter"], [F.desc_nulls_last(c) for c in ("earnings_date", "ret_1d", "abnormal_ret_1d", "mean_lm_net_score", "mean_vader_compound")])


def panel_market_join(spark, d):
    f = table(spark, d, FM).select(keys.normalize_ticker(F.col("ticker")).alias("ticker"), keys.normalize_quarter(F.col("quarter")).alias("quarter"), "mean_lm_net_score")
    return f.join(_market(spark, d).select("ticker", "quarter", F.col("abnormal_ret_5d").alias("car_5d")), ["ticker", "quarter"], "left").select("ticker", "quarter", r9(panel.number("mean_lm_net_score"), "net"), r9("car_5d"))


def _typed(df):
    """``df`` under canonical keys, with the keys as typed beside them."""
    return keys.canonical(df.withColumn("typed_ticker", F.col("ticker")).withColumn("typed_quarter", F.col("quarter")))


def incremental_anti_join(spark, d):
    """Files whose canonical key isn't in the panel; keys that can't be read are never done, so they stay. Keys are shown as typed."""
    return R.unprocessed(_typed(table(spark, d, "manifest")), keys.canonical(table(spark, d, FM)), ["ticker", "quarter"]).select("file_path", F.col("typed_ticker").alias("ticker"), F.col("typed_quarter").alias("quarter"))


def semi_join_market(spark, d):
    """Files with a market reaction under their canonical key (``matched``), and those whose key can't be read (``matched`` null). Keys are shown as typed."""
    m = keys.canonical(table(spark, d, MR).select("ticker", "quarter")).distinct().withColumn("matched", F.lit(True))
    x = _typed(table(spark, d, "manifest")).join(m, ["ticker", "quarter"], "left")
    unread = ~keys.readable_ticker(F.col("ticker")) | keys.quarter_index(F.col("quarter")).isNull()
    return x.filter(F.col("matched") | unread).select("file_path", F.col("typed_ticker").alias("ticker"), F.col("typed_quarter").alias("quarter"), "matched")


def _companies(spark, d):
    """One sector per canonical ticker; of several spellings the canonical one counts."""
    c = table(spark, d, "companies").select(keys.normalize_ticker(F.col("ticker")).alias("ticker"), "sector", F.col("ticker").alias("typed"))
    return R.keep_one(c.filter("ticker is not null"), ["ticker"], [F.desc(F.col("typed") == F.col("ticker")), F.asc_nulls_last("sector"), F.col("typed")]).drop("typed")


def target_semi_join(spark, d):
    """Chunks per canonical ticker of the target companies (``matched``), and per ticker that can't be read (``matched`` null)."""
    target = _companies(spark, d).filter("sector = 'Energy'").select("ticker", F.lit(True).alias("matched"))
    n = keys.canonical(table(spark, d, CH).select("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))
    return n.join(target, "ticker", "left").filter(F.col("matched") | ~keys.readable_ticker(F.col("ticker"))).select("ticker", "n", "matched")


def coverage_matrix(spark, d):
    x = table(spark, d, "manifest").select(keys.normalize_ticker(F.col("ticker")).alias("ticker"), keys.normalize_quarter(F.col("quarter")).alias("quarter"))
    return R.coverage(x, "ticker", "quarter")


def dedup_keep_longest(spark, d):
    x = _chunks(spark, d)
    return R.keep_one(x, ["ticker", "quarter"], [F.desc_nulls_last(F.length("text")), F.col("chunk_id"), F.col("ingested_at")]).select("ticker", "quarter", "chunk_id", F.length("text").alias("chars"))


def upsert_keep_last(spark, d):
    x = table(spark, d, "manifest").select("ticker", "quarter", "date", "source", F.col("ingested_at").cast("string").alias("at"))
    old, new = x.filter("at < '2021-06-01'").drop("source"), x.filter("at >= '2021-06-01'")
    return R.upsert(old, new, ["ticker", "quarter"], [F.desc_nulls_last("at"), F.asc_nulls_first("date"), F.asc_nulls_first("source")])


def union_schema_merge(spark, d):
    a = table(spark, d, FM).select("ticker", "quarter", r9("ret_1d"))
    b = table(spark, d, MR).select("ticker", "quarter", r9("abnormal_volume"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("ticker").agg(F.count("*").alias("n"), F.count("ret_1d").alias("rets"), F.count("abnormal_volume").alias("vols"))


def feature_panel(spark, d):
    p = panel.feature_panel(table(spark, d, CH), _market(spark, d))
    return p.select(*[r9(c) if t == "double" else c for c, t in p.dtypes])


def feature_coverage(spark, d):
    f = table(spark, d, FM)
    names = [c for c, t in f.dtypes if t == "double"]
    return f.agg(F.count("*").alias("n"), *[F.count(panel.number(c)).alias(c) for c in names]).select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) >= 0.7 * F.col("n")).alias("kept"), F.col(c).alias("present")) for c in names])).alias("x")).select("x.feature", "x.kept", "x.present")


RANKED = ["mean_lm_net_score", "total_risk_count", "call_fog_index"]


def percentile_rank_history(spark, d):
    """Where each row stands among all rows in three measures, one row per measure; rows without a value are left out."""
    f = table(spark, d, FM)
    out = None
    for c in RANKED:
        one = panel.percentile_rank(f.select("ticker", "quarter", r9(panel.number(c), "value")), "value").select("ticker", "quarter", F.lit(c).alias("metric"), "value", r9("percentile"))
        out = one if out is None else out.unionByName(one)
    return out


def class_balance(spark, d):
    y = panel.number("abnormal_ret_1d")
    return table(spark, d, FM).filter(y.isNotNull()).agg(F.count("*").alias("n"), r9(F.avg((y > 0).cast("int")), "positive")).withColumn("majority", r9(F.greatest(F.col("positive"), 1 - F.col("positive")), "m"))


def median_imputation(spark, d):
    f = table(spark, d, FM)
    names = [c for c, t in f.dtypes if t == "double"]
    return stats.quantiles(f, names, [0.5]).select("column", r9("value", "median"))


def company_sector_rollup(spark, d):
    """Rows per sector under canonical tickers; those of no known company are under a null sector."""
    return keys.canonical(table(spark, d, FM)).join(_companies(spark, d), "ticker", "left").groupBy("sector").agg(F.count("*").alias("n"), r9(F.avg(panel.number("mean_vader_compound")), "vader"))


_N = lambda c: f"CASE WHEN {c}::VARCHAR = 'nan' THEN NULL ELSE {c} END"  # noqa: E731  (isnan is folded to false from a file's statistics)
_MEANS = ", ".join(f"round(avg({_N(c)}), 9) AS {c}" for c in panel.SCORES)
_PANEL = f"""(SELECT ticker, quarter, {", ".join(f"avg({_N(c)}) AS mean_{c}" for c in panel.SCORES)}, avg(CASE WHEN role IN ('CEO', 'CFO', 'COO', 'CTO') THEN {_N("lm_net_score")} END) AS mgmt_sentiment,
    avg(CASE WHEN role = 'Analyst' THEN {_N("lm_net_score")} END) AS analyst_sentiment, avg(CASE WHEN section = 'prepared_remarks' THEN {_N("lm_net_score")} END) AS prepared_sentiment,
    avg(CASE WHEN section = 'qa' THEN {_N("lm_net_score")} END) AS qa_sentiment FROM {keyed_sql()} GROUP BY ALL)"""
_KM = f"SELECT {X._TICK} AS ticker, {X._Q} AS quarter FROM (SELECT *, {X._S} AS s FROM manifest)"
_SECTORS = f"(SELECT ticker, sector FROM (SELECT {X._TICK} AS ticker, sector, ticker AS typed FROM companies WHERE ticker IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY typed = ticker DESC, sector NULLS LAST, typed) = 1)"
_TYPED = f"m AS (SELECT file_path, tt, tq, {X._TICK} AS ticker, {X._Q} AS quarter FROM (SELECT *, ticker AS tt, quarter AS tq, {X._S} AS s FROM manifest))"
_READ_T = "coalesce(regexp_full_match(ticker, '[A-Z][A-Z0-9]{0,5}(\\.[A-Z]{1,2})?'), false)"


def canonical_sql(of: str) -> str:
    """A table with its ticker and quarter under canonical keys."""
    return f"(SELECT * REPLACE ({X._TICK} AS ticker, {X._Q} AS quarter) FROM (SELECT *, {X._S} AS s FROM {of}))"


FEATURE_ROWS = f"(SELECT * FROM {canonical_sql(FM)} QUALIFY row_number() OVER (PARTITION BY ticker, quarter ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in ('earnings_date', 'ret_1d', 'abnormal_ret_1d', 'mean_lm_net_score', 'mean_vader_compound'))}) = 1)"

QUERIES = {
    f.__name__: f
    for f in (
        sentiment_trends, sentiment_aggregate_stats, prepared_vs_qa_divergence, sentiment_panel, lexicon_trend_momentum, qa_dynamics, call_text_concat, quarter_summary, value_counts, speaker_role_counts, having_min_count,
        topk_bottomk, panel_market_join, incremental_anti_join, semi_join_market, target_semi_join, coverage_matrix, dedup_keep_longest, upsert_keep_last, union_schema_merge, feature_panel, feature_coverage,
        percentile_rank_history, class_balance, median_imputation, company_sector_rollup,
    )
}

_c = lambda p: X.count(p, "lower(text)")
_one = lambda c: f"greatest({c}, 1)"
_sum = lambda c, w: f"coalesce(sum(CASE WHEN {w} THEN {c} END), 0)"
SQL = {
    "sentiment_trends": f"SELECT quarter, {_MEANS} FROM {keyed_sql()} GROUP BY quarter",
    "sentiment_aggregate_stats": f"SELECT ticker, round(avg(lm_net_score), 9) AS lm_net_score_mean, round(stddev_samp(lm_net_score), 9) AS lm_net_score_std, count(lm_net_score) AS lm_net_score_count FROM {keyed_sql()} GROUP BY ticker",
    "prepared_vs_qa_divergence": f"SELECT ticker, quarter, round(coalesce(prepared_sentiment, 0), 9) AS prepared, round(coalesce(qa_sentiment, 0), 9) AS qa, round(coalesce(prepared_sentiment, 0) - coalesce(qa_sentiment, 0), 9) AS divergence FROM {_PANEL}",
    "sentiment_panel": f"SELECT ticker, quarter, round(COLUMNS(* EXCLUDE (ticker, quarter)), 9) FROM {_PANEL}",
    "lexicon_trend_momentum": f"SELECT ticker, quarter, round(mean_lm_net_score - lag(mean_lm_net_score) OVER w, 9) AS momentum, round(mean_vader_compound - lag(mean_vader_compound) OVER w, 9) AS vader_momentum FROM {_PANEL} WINDOW w AS (PARTITION BY ticker ORDER BY quarter)",
    "qa_dynamics": f"""WITH x AS (SELECT ticker, quarter, coalesce(section = 'qa', false) AS qa, coalesce(section = 'prepared_remarks', false) AS pr, coalesce(regexp_matches(role, '(?i)CEO|CFO|COO|CTO|VP|Director|President'), false) AS m, coalesce(role = 'Analyst', false) AS a,
        {X.WC} AS w, (len(list_filter({X.L(T.DEFLECTIONS)}, lambda k: contains(lower(text), k))) > 0)::INT AS d, ({" + ".join(X.count(f, "lower(text)") for f in T.FILLERS)}) AS f, {_c(T.PASSIVE)} AS p, greatest(len({X.SENT}), 1) AS s,
        {_c(T.FIRST_PERSON)} AS i, {_c(T.THIRD_PERSON)} AS t, {X.count(T.NUMBER)} AS n FROM {keyed_sql()} WHERE text IS NOT NULL),
        g AS (SELECT ticker, quarter, {_sum("w", "qa AND m")} AS mw, {_sum("w", "qa AND a")} AS aw, {_sum("1", "qa AND m")} AS mn, {_sum("1", "qa AND a")} AS an, {_sum("d", "qa AND m")} AS md, {_sum("f", "qa AND m")} AS mf, {_sum("p", "qa AND m")} AS mp,
        {_sum("s", "qa AND m")} AS ms, {_sum("i", "qa AND m")} AS qi, {_sum("t", "qa AND m")} AS qt, {_sum("i", "pr AND m")} AS pi, {_sum("t", "pr AND m")} AS pt, {_sum("1", "pr AND m")} AS pm, {_sum("n", "qa")} AS qn, {_sum("s", "qa")} AS qs, {_sum("n", "pr")} AS pn, {_sum("s", "pr")} AS ps FROM x GROUP BY ALL)
        SELECT ticker, quarter, round(mw / {_one("mw + aw")}, 9) AS qa_mgmt_word_ratio, round(mw / {_one("mn")}, 9) AS qa_avg_answer_length, round(aw / {_one("an")}, 9) AS qa_avg_question_length,
        round((mw / {_one("mn")}) / greatest(aw / {_one("an")}, 1.0), 9) AS qa_answer_question_ratio, md::BIGINT AS qa_deflection_count, round(md / {_one("mn")}, 9) AS qa_deflection_rate, round(mf / {_one("mw")}, 9) AS qa_filler_rate, round(mp / {_one("ms")}, 9) AS qa_passive_rate,
        round(CASE WHEN pm > 0 THEN pi / {_one("pt")} - qi / {_one("qt")} ELSE 0 END, 9) AS qa_pronoun_shift, round(CASE WHEN ps > 0 THEN pn / {_one("ps")} - qn / {_one("qs")} ELSE 0 END, 9) AS qa_specificity_drop FROM g""",
    "call_text_concat": f"""WITH g AS (SELECT ticker, quarter, count(*) AS chunks, string_agg(text, ' ' ORDER BY chunk_id) AS text FROM {keyed_sql(_FIRST)} WHERE text IS NOT NULL GROUP BY ALL)
        SELECT ticker, quarter, chunks, length(text)::INTEGER AS chars, md5(text) AS digest, {X.WC}::INTEGER AS words FROM g""",
    "quarter_summary": f"""SELECT quarter, count(*) AS chunks, count(DISTINCT speaker) AS speakers, count(DISTINCT ticker) AS tickers, round(avg(lm_net_score), 9) AS net, round(avg(vader_compound), 9) AS vader,
        sum((coalesce(section, '') = 'qa')::INT)::BIGINT AS qa_chunks, sum((coalesce(role, '') = 'Analyst')::INT)::BIGINT AS analyst_chunks FROM {keyed_sql()} GROUP BY quarter""",
    "value_counts": " UNION ALL ".join(f"SELECT {c} AS value, count(*) AS n, '{c}' AS field FROM {keyed_sql()} GROUP BY {c}" for c in ("section", "role", "finbert_label")),
    "speaker_role_counts": f"SELECT speaker, role, count(*) AS n FROM {keyed_sql()} GROUP BY ALL",
    "having_min_count": f"WITH {_TYPED} SELECT file_path, tt AS ticker, tq AS quarter FROM m WHERE ticker IN (SELECT ticker FROM m GROUP BY ticker HAVING count(*) >= 5)",
    "topk_bottomk": f"""WITH x AS (SELECT * FROM {_FIRST} WHERE lm_net_score IS NOT NULL), a AS (SELECT 'top' AS side, chunk_id, lm_net_score, row_number() OVER (ORDER BY lm_net_score DESC, chunk_id)::INTEGER AS rank FROM x),
        b AS (SELECT 'bottom' AS side, chunk_id, lm_net_score, row_number() OVER (ORDER BY lm_net_score, chunk_id)::INTEGER AS rank FROM x) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 10""",
    "panel_market_join": f"""WITH f AS (SELECT {X._TICK} AS ticker, {X._Q} AS quarter, mean_lm_net_score AS v FROM (SELECT *, {X._S} AS s FROM {FM}))
        SELECT ticker, quarter, round({_N("v")}, 9) AS net, round(abnormal_ret_5d, 9) AS car_5d FROM f LEFT JOIN {market_sql()} USING (ticker, quarter)""",
    "incremental_anti_join": f"WITH {_TYPED}, f AS (SELECT DISTINCT ticker, quarter FROM {canonical_sql(FM)}) SELECT file_path, tt AS ticker, tq AS quarter FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ticker = m.ticker AND f.quarter = m.quarter)",
    "semi_join_market": f"""WITH {_TYPED}, r AS (SELECT DISTINCT ticker, quarter, true AS matched FROM {canonical_sql(MR)}) SELECT file_path, tt AS ticker, tq AS quarter, matched FROM m LEFT JOIN r USING (ticker, quarter)
        WHERE matched OR NOT {_READ_T} OR NOT coalesce(regexp_full_match(quarter, '[0-9]{{4}}Q[1-4]'), false)""",
    "target_semi_join": f"WITH c AS {_SECTORS}, n AS (SELECT ticker, count(*) AS n FROM {canonical_sql(CH)} GROUP BY ticker) SELECT ticker, n, CASE WHEN sector = 'Energy' THEN true END AS matched FROM n LEFT JOIN c USING (ticker) WHERE sector = 'Energy' OR NOT {_READ_T}",
    "coverage_matrix": f"WITH k AS (SELECT DISTINCT * FROM ({_KM}) WHERE ticker IS NOT NULL AND quarter IS NOT NULL), t AS (SELECT DISTINCT ticker FROM k), q AS (SELECT DISTINCT quarter FROM k) SELECT t.ticker, q.quarter, (k.ticker IS NOT NULL)::INTEGER AS present FROM t CROSS JOIN q LEFT JOIN k ON k.ticker = t.ticker AND k.quarter = q.quarter",
    "dedup_keep_longest": f"SELECT ticker, quarter, chunk_id, length(text)::INTEGER AS chars FROM {keyed_sql()} QUALIFY row_number() OVER (PARTITION BY ticker, quarter ORDER BY length(text) DESC NULLS LAST, chunk_id, ingested_at) = 1",
    "upsert_keep_last": """WITH x AS (SELECT ticker, quarter, date, source, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ts FROM manifest), b AS (SELECT ticker, quarter, date, NULL AS source, ts, 0 AS k FROM x WHERE ts < '2021-06-01' UNION ALL SELECT *, 1 AS k FROM x WHERE ts >= '2021-06-01')
        SELECT ticker, quarter, date, ts AS "at", source FROM b QUALIFY row_number() OVER (PARTITION BY ticker, quarter ORDER BY k DESC, ts DESC NULLS LAST, date ASC NULLS FIRST, source ASC NULLS FIRST) = 1""",
    "union_schema_merge": f"SELECT ticker, count(*) AS n, count(ret_1d) AS rets, count(abnormal_volume) AS vols FROM (SELECT ticker, ret_1d, NULL AS abnormal_volume FROM {FM} UNION ALL SELECT ticker, NULL, abnormal_volume FROM {MR}) GROUP BY ticker",
    "percentile_rank_history": " UNION ALL ".join(f"""SELECT * FROM (WITH f AS (SELECT ticker, quarter, round({_N(c)}, 9) AS value FROM {FM}), p AS (SELECT value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1),
        b AS (SELECT value, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER () AS al FROM p) SELECT ticker, quarter, '{c}' AS metric, value, round(below * 100.0 / al, 9) AS percentile FROM f JOIN b USING (value))""" for c in RANKED),
    "class_balance": f"SELECT count(*) AS n, round(avg((y > 0)::INT), 9) AS positive, round(greatest(round(avg((y > 0)::INT), 9), 1 - round(avg((y > 0)::INT), 9)), 9) AS majority FROM (SELECT {_N('abnormal_ret_1d')} AS y FROM {FM}) WHERE y IS NOT NULL",
    "median_imputation": f"SELECT col AS \"column\", round(median(v), 9) AS median FROM (UNPIVOT (SELECT COLUMNS(lambda c: c NOT IN ('ticker', 'quarter', 'earnings_date')) FROM {FM}) ON COLUMNS(*) INTO NAME col VALUE v) WHERE v::VARCHAR <> 'nan' GROUP BY col",
    "feature_coverage": f"SELECT feature, count(*) >= 0.7 * (SELECT count(*) FROM {FM}) AS kept, count(*) AS present FROM (UNPIVOT (SELECT COLUMNS(c -> c NOT IN ('ticker', 'quarter', 'earnings_date')) FROM {FM}) ON COLUMNS(*) INTO NAME feature VALUE v) WHERE v::VARCHAR <> 'nan' GROUP BY feature".replace("c -> c NOT", "lambda c: c NOT"),
    "company_sector_rollup": f"WITH c AS {_SECTORS} SELECT sector, count(*) AS n, round(avg({_N('mean_vader_compound')}), 9) AS vader FROM {canonical_sql(FM)} LEFT JOIN c USING (ticker) GROUP BY sector",
}
