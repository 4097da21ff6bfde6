"""Queries of risk, market and statistics operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.functions import keys, lexicons, text as T
from earshot.operators import market, panel, risk, stats
from earshot.plans.panel import CH, FEATURE_ROWS, FM, MR, _N, _PANEL, _chunks, _feature_rows, _market, canonical_sql, keyed_sql, market_sql
from earshot.plans import panel as P, text as X
from earshot.plans.text import L
from earshot.sources.tables import table


def r9(c, a=None):
    return F.round(c, 9).alias(a or c)


def _found(spark, d):
    return risk.detect(_chunks(spark, d).filter("text is not null").select("chunk_id", "ticker", "quarter", "text"))


def keyword_match_counts(spark, d):
    return _found(spark, d).groupBy("category", "keyword").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


def keyword_negation_severity(spark, d):
    return _found(spark, d).select("chunk_id", "category", "keyword", "at", "negated", "severity", "snippet")


def chunk_risk_rollup(spark, d):
    return risk.rollup(_found(spark, d), ["chunk_id"]).select("chunk_id", F.array_join("categories", ",").alias("categories"), "risk_count", "risk_intensity")


def call_risk_totals(spark, d):
    """Per call: detections, distinct categories over its chunks, and mean intensity of its chunks with one."""
    found = _found(spark, d)
    chunk = risk.rollup(found, ["chunk_id", "ticker", "quarter"])
    return chunk.groupBy("ticker", "quarter").agg(F.sum("risk_count").alias("total_risk_count"), r9(F.avg("risk_intensity"), "avg_risk_intensity"), F.size(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("num_risk_categories"))


def risk_heatmap(spark, d):
    return risk.heatmap(_found(spark, d), "ticker")


def risk_trend(spark, d):
    return risk.trends(_found(spark, d), ["ticker", "quarter"], _chunks(spark, d)).select("ticker", "quarter", "category", "n", "high", "total", r9("mean_intensity"))


def risk_summary_topk(spark, d):
    return risk.summary(_found(spark, d), ["ticker", "quarter"])


def _semantic(spark, d):
    """Embeddings against the centroids of their labels, each label standing for a risk category; the five first vectors of a label are its anchors."""
    names = F.array(*map(F.lit, sorted(lexicons.RISKS)))
    e = table(spark, d, "embeddings").withColumn("category", F.get(names, F.col("label").cast("int")))
    c = risk.centroids(e, "category", "embedding")
    after = F.create_map(*[F.lit(x) for a, b in zip(sorted(lexicons.RISKS), sorted(lexicons.RISKS)[-1:] + sorted(lexicons.RISKS)[:-1]) for x in (a, b)])
    safe = c.select(after[F.col("category")].alias("category"), F.col("centroid").alias("safe_centroid"))
    first = F.row_number().over(Window.partitionBy("category").orderBy("vec_id"))
    anchors = e.withColumn("_n", first).filter("_n <= 5").select("category", F.col("vec_id").alias("anchor"), F.col("embedding").alias("vector"))
    return risk.semantic(e, "embedding", c, safe, 0.2, 0.1, "vec_id", anchors)


def semantic_centroid_detect(spark, d):
    return _semantic(spark, d).select("vec_id", "category", r9("sim"), r9("differential"), "anchor")


def _phrase_counts(spark, d):
    """Phrases found in the documents, counted by document and category, under the number of the document's vector."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("vec_id"), "text")
    weight = F.create_map(*[F.lit(v) for kv in risk.WEIGHT.items() for v in kv])[F.col("severity")]
    return risk.detect(docs).filter("not negated").groupBy("vec_id", "category").agg(F.count("*").alias("n"), F.sum(weight).alias("intensity"))


def semantic_keyword_merge(spark, d):
    return risk.merge_semantic(_phrase_counts(spark, d), _semantic(spark, d), "vec_id")


def overlap_tallies(spark, d):
    return risk.overlap(_phrase_counts(spark, d), _semantic(spark, d), "vec_id").select("category", "kw", "sem", "both", "sem_only", "kw_only", r9("noise"))


def _prices(spark, d):
    return market.daily_prices(table(spark, d, "events"), "user_id", "ts", "value")


def _signups(spark, d):
    return table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("date")).distinct()


def _bench(spark, d):
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("close"))


def asof_base_price(spark, d):
    x = market.asof(_signups(spark, d).withColumn("date", F.date_sub("date", 1)), _prices(spark, d), ["close"])
    return x.select("key", F.col("date").cast("string").alias("date"), F.col("asof_date").cast("string").alias("asof_date"), r9("close"))


def event_returns(spark, d):
    return market.event_returns(_signups(spark, d), _prices(spark, d)).select("key", F.col("date").cast("string").alias("date"), *[r9(f"ret_{n}d") for n in (1, 3, 5)])


def abnormal_returns(spark, d):
    x = market.abnormal_returns(_signups(spark, d), _prices(spark, d), _bench(spark, d))
    return x.select("key", F.col("date").cast("string").alias("date"), *[r9(f"abnormal_ret_{n}d") for n in (1, 3, 5)])


def abnormal_volume(spark, d):
    return market.abnormal_volume(_signups(spark, d), _prices(spark, d)).select("key", F.col("date").cast("string").alias("date"), r9("abnormal_volume"))


def simple_log_cum_returns(spark, d):
    w = Window.partitionBy("key").orderBy("date")
    p = _prices(spark, d).filter("close > 1").withColumn("b", F.lag("close").over(w))
    p = p.withColumn("simple", market.simple_return(F.col("close"), F.col("b")) / 100).withColumn("logr", market.log_return(F.col("close"), F.col("b")))
    return p.select("key", F.col("date").cast("string").alias("date"), r9("simple"), r9("logr"), r9(market.cumulative_return("simple", w.rowsBetween(Window.unboundedPreceding, 0)), "cum"))


def winsorize(spark, d):
    x = table(spark, d, MR).select("ticker", "quarter", "ret_1d")
    return stats.winsorize(x, "ret_1d").select("ticker", "quarter", r9("winsorized"))


def qcut_sort(spark, d):
    return stats.portfolio_sort(_feature_rows(spark, d), "mean_lm_net_score", "abnormal_ret_1d").select("bucket", stats.bucket_label(F.col("bucket")).alias("label"), "n", r9("mean"), r9("sd"), r9("feature_mean"))


def long_short_t(spark, d):
    return stats.long_short(stats.portfolio_sort(_feature_rows(spark, d), "mean_vader_compound", "abnormal_ret_1d")).select(r9("spread"), r9("t"), "n")


def event_study_t(spark, d):
    return stats.event_study(_market(spark, d), ["abnormal_ret_1d", "abnormal_ret_3d", "abnormal_ret_5d"]).select("window", "n", r9("mean"), r9("sd"), r9("t"), "significant")


def event_study_p(spark, d):
    """The study with its p values, which SQL has no function for."""
    return stats.event_study(_market(spark, d), ["abnormal_ret_1d", "abnormal_ret_3d", "abnormal_ret_5d"])


def portfolio_backtest(spark, d):
    """Under canonical quarters; rows whose quarter can't be read have no place in time and are only counted, under their text."""
    x, read = keys.canonical(table(spark, d, FM)), keys.quarter_index(F.col("quarter")).isNotNull()
    b = stats.backtest(x.filter(read), "quarter", "mean_lm_net_score", "abnormal_ret_1d").select("quarter", "n", r9("long"), r9("short"), r9("spread"), r9("cum_long"), r9("cum_short"))
    return b.unionByName(x.filter(~read).groupBy("quarter").agg(F.count("*").alias("n")), allowMissingColumns=True)


def cumulative_abnormal_return(spark, d):
    return stats.cumulative_abnormal(_market(spark, d), "ticker", ["earnings_date", "quarter", "ret_1d"], "abnormal_ret_1d", 3).select("ticker", r9("car"))


def ols_closed_form(spark, d):
    x = stats.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return x.select("term", F.round("coef", 4).alias("coef"), F.round("r2", 6).alias("r2"), "n")


def ols_multi(spark, d):
    return stats.ols(table(spark, d, FM), "abnormal_ret_1d", ["mean_lm_net_score", "analyst_sentiment", "sentiment_divergence", "risk_delta"])


def newey_west(spark, d):
    m = table(spark, d, MR).groupBy("earnings_date").agg(F.avg("abnormal_ret_1d").alias("y"), F.avg("abnormal_volume").alias("x"))
    return stats.ols(m, "y", ["x"], order=["earnings_date"])


def bootstrap_ci(spark, d):
    x = table(spark, d, MR).withColumn("k", F.concat_ws("|", "ticker", "quarter", F.col("earnings_date").cast("string"), F.col("ret_1d").cast("string")))
    return stats.bootstrap_mean(x, "abnormal_ret_1d", "k", resamples=1000)


QUERIES = {
    f.__name__: f
    for f in (
        keyword_match_counts, keyword_negation_severity, chunk_risk_rollup, call_risk_totals, risk_heatmap, risk_trend, risk_summary_topk, semantic_centroid_detect, semantic_keyword_merge, overlap_tallies, asof_base_price, event_returns, abnormal_returns,
        abnormal_volume, simple_log_cum_returns, winsorize, qcut_sort, long_short_t, event_study_t, event_study_p, portfolio_backtest, cumulative_abnormal_return, ols_closed_form, ols_multi, newey_west, bootstrap_ci,
    )
}

_KW = ",".join(f"{{'category': '{c}', 'keyword': '{k.lower()}'}}" for c, ks in lexicons.RISKS.items() for k in ks)
_TOKS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
def det_sql(of: str, key: str = "chunk_id") -> str:
    """Common tables up to ``f``, the phrases found in the texts of a table."""
    return f"""WITH t AS (SELECT {key} AS chunk_id, ticker, quarter, text, lower(text) AS low FROM {of} WHERE text IS NOT NULL),
    k AS (SELECT unnest([{_KW}], recursive := true)), c AS (SELECT t.*, category, keyword FROM t JOIN k ON contains(low, keyword)),
    o AS (SELECT *, string_split(low, keyword) AS ps FROM c), u AS (SELECT *, unnest(range(1, len(ps))) AS j FROM o),
    p AS (SELECT *, list_sum(list_transform(ps[1:j], lambda x: length(x)))::BIGINT + (j - 1) * length(keyword) AS at0 FROM u WHERE NOT regexp_matches(CASE WHEN j > 1 THEN keyword ELSE '' END || ps[j], '[a-z0-9]$')
        AND regexp_matches(ps[j + 1] || CASE WHEN j + 1 < len(ps) THEN keyword ELSE '' END, '^(s|es|ed|ing)?([^a-z0-9]|$)')),
    q AS (SELECT *, {_TOKS.format(x="low")} AS ws, greatest(0, len({_TOKS.format(x="low[1:at0]")}) - 1) AS wp FROM p),
    f AS (SELECT chunk_id, ticker, quarter, category, keyword, at0::INTEGER AS "at", list_has_any(ws[greatest(0, wp - 3) + 1:wp], {L(lexicons.NEGATORS)}) AS negated,
        CASE WHEN list_has_any(ws[greatest(0, wp - 5) + 1:wp + 5], {L(lexicons.INTENSIFIERS)}) THEN 'high' WHEN list_has_any(ws[greatest(0, wp - 5) + 1:wp + 5], {L(lexicons.DIMINISHERS)}) THEN 'low' ELSE 'medium' END AS severity,
        regexp_replace(text[greatest(0, at0 - 50) + 1:at0 + length(keyword) + 50], '^\\s+|\\s+$', '', 'g') AS snippet FROM q)"""


_DET = det_sql(keyed_sql())
_W3 = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_PIV = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in sorted(lexicons.RISKS))
_DOT = "list_dot_product({a}, {b})"
_CATS = L(sorted(lexicons.RISKS))
_SEM = f"""e AS (SELECT vec_id, {_CATS}[label + 1] AS category, embedding::DOUBLE[] AS v FROM embeddings), fl AS (SELECT category, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
    m AS (SELECT category, i, avg(x) AS x FROM fl GROUP BY ALL), c0 AS (SELECT category, list(x ORDER BY i) AS ce FROM m GROUP BY category),
    s AS (SELECT {_CATS}[(list_position({_CATS}, category) + 8) % 10 + 1] AS category, ce AS z FROM c0),
    g AS (SELECT vec_id, c0.category, v, list_cosine_similarity(v, ce) AS sim, list_cosine_similarity(v, ce) - list_cosine_similarity(v, z) AS differential FROM e CROSS JOIN c0 JOIN s ON s.category = c0.category),
    h AS (SELECT * FROM g WHERE sim > 0.2 AND differential > 0.1)"""
_PR = "p AS (SELECT user_id AS key, ts::DATE AS date, arg_max(value, (ts, value)) AS close, count(*) AS volume FROM events GROUP BY ALL), ev AS (SELECT DISTINCT user_id AS key, ts::DATE AS date FROM events WHERE event_type = 'signup')"
_RET = ", ".join(f"lead(close, {n}) OVER w / nullif(close, 0) - 1 AS ret_{n}d" for n in (1, 3, 5))
#: Two-sided 5 % point of Student's t for n degrees of freedom, by its expansion around the normal's (right to 4 places from 10 on).
_CRITICAL = "(1.959964 + 2.372271 / {n} + 2.822499 / {n} ** 2 + 2.555852 / {n} ** 3)"
SQL = {
    "keyword_match_counts": f"{_DET} SELECT category, keyword, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM f GROUP BY ALL",
    "keyword_negation_severity": f'{_DET} SELECT chunk_id, category, keyword, "at", negated, severity, snippet FROM f',
    "chunk_risk_rollup": f"{_DET} SELECT chunk_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS risk_count, sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::BIGINT AS risk_intensity FROM f WHERE NOT negated GROUP BY chunk_id",
    "call_risk_totals": f"""{_DET}, cc AS (SELECT chunk_id, ticker, quarter, count(*) AS n, sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS i FROM f WHERE NOT negated GROUP BY ALL),
        kk AS (SELECT ticker, quarter, count(DISTINCT category)::INTEGER AS num_risk_categories FROM f WHERE NOT negated GROUP BY ALL) SELECT ticker, quarter, sum(n)::BIGINT AS total_risk_count, round(avg(i), 9) AS avg_risk_intensity, any_value(num_risk_categories) AS num_risk_categories FROM cc JOIN kk USING (ticker, quarter) GROUP BY ALL""",
    "risk_heatmap": f"{_DET} SELECT ticker, {_PIV} FROM f WHERE NOT negated GROUP BY ticker",
    "risk_trend": f"""{_DET}, n0 AS (SELECT ticker, quarter, category, count(*) AS n, sum((severity = 'high')::INT)::BIGINT AS high, sum({_W3}) AS w FROM f WHERE NOT negated GROUP BY ALL), ch AS (SELECT ticker, quarter, count(*) AS c FROM {keyed_sql()} GROUP BY ALL),
        wh AS (SELECT ticker, quarter, sum(n)::BIGINT AS total, sum(w) AS i FROM n0 GROUP BY ALL) SELECT ticker, quarter, category, n, high, total, round(i / c, 9) AS mean_intensity FROM n0 JOIN wh USING (ticker, quarter) JOIN ch USING (ticker, quarter)""",
    "risk_summary_topk": f"""{_DET}, g AS (SELECT ticker, quarter, category, count(*) AS n, arg_min(snippet, (chunk_id, "at", keyword)) AS example, sum((severity = 'high')::INT) AS h, sum((severity = 'medium')::INT) AS m, sum((severity = 'low')::INT) AS l FROM f WHERE NOT negated GROUP BY ALL)
        SELECT * EXCLUDE (h, m, l), (sum(n) OVER k)::BIGINT AS total, (sum(h) OVER k)::BIGINT AS high, (sum(m) OVER k)::BIGINT AS medium, (sum(l) OVER k)::BIGINT AS low, (row_number() OVER (PARTITION BY ticker, quarter ORDER BY n DESC, category))::INTEGER AS rank FROM g WINDOW k AS (PARTITION BY ticker, quarter) QUALIFY rank <= 5""",
    "semantic_centroid_detect": f"""WITH {_SEM}, an AS (SELECT category, vec_id AS anchor, v AS av FROM e QUALIFY row_number() OVER (PARTITION BY category ORDER BY vec_id) <= 5)
        SELECT h.vec_id, category, round(sim, 9) AS sim, round(differential, 9) AS differential, anchor FROM h JOIN an USING (category) QUALIFY row_number() OVER (PARTITION BY h.vec_id, category ORDER BY round(list_cosine_similarity(v, av), 9) DESC, anchor) = 1""",
    "semantic_keyword_merge": f"""{det_sql("documents", "doc_id")}, {_SEM}, kw AS (SELECT chunk_id AS vec_id, category, count(*) AS n, sum({_W3})::BIGINT AS intensity FROM f WHERE NOT negated GROUP BY ALL)
        SELECT coalesce(kw.vec_id, h.vec_id) AS vec_id, coalesce(kw.category, h.category) AS category, coalesce(n, 1) AS n, coalesce(intensity, 2) AS intensity, n IS NULL AS is_new, n IS NOT NULL AND h.vec_id IS NOT NULL AS is_confirmation FROM kw FULL JOIN h ON kw.vec_id = h.vec_id AND kw.category = h.category""",
    "overlap_tallies": f"""{det_sql("documents", "doc_id")}, {_SEM}, kw AS (SELECT DISTINCT chunk_id AS vec_id, category FROM f WHERE NOT negated),
        jj AS (SELECT coalesce(kw.category, h.category) AS category, (kw.vec_id IS NOT NULL)::INT AS k, (h.vec_id IS NOT NULL)::INT AS s FROM kw FULL JOIN h ON kw.vec_id = h.vec_id AND kw.category = h.category)
        SELECT category, sum(k)::BIGINT AS kw, sum(s)::BIGINT AS sem, sum(k * s)::BIGINT AS "both", sum(s * (1 - k))::BIGINT AS sem_only, sum(k * (1 - s))::BIGINT AS kw_only, CASE WHEN sum(s) > 0 THEN round(sum(s * (1 - k)) / sum(s), 9) ELSE 0 END AS noise FROM jj GROUP BY category""",
    "asof_base_price": f"WITH {_PR}, v AS (SELECT key, (date - 1)::DATE AS date FROM ev) SELECT v.key, v.date::VARCHAR AS date, p.date::VARCHAR AS asof_date, round(p.close, 9) AS close FROM v ASOF LEFT JOIN p ON v.key = p.key AND v.date >= p.date",
    "event_returns": f"WITH {_PR}, r AS (SELECT *, {_RET} FROM p WINDOW w AS (PARTITION BY key ORDER BY date)) SELECT ev.key, ev.date::VARCHAR AS date, round(ret_1d, 9) AS ret_1d, round(ret_3d, 9) AS ret_3d, round(ret_5d, 9) AS ret_5d FROM ev ASOF LEFT JOIN r ON ev.key = r.key AND ev.date >= r.date",
    "abnormal_returns": f"""WITH {_PR}, r AS (SELECT *, {_RET} FROM p WINDOW w AS (PARTITION BY key ORDER BY date)), m AS (SELECT ts::DATE AS date, avg(value) AS close FROM events GROUP BY ALL), b AS (SELECT date, {_RET} FROM m WINDOW w AS (ORDER BY date)),
        x AS (SELECT ev.key, ev.date, r.ret_1d, r.ret_3d, r.ret_5d FROM ev ASOF LEFT JOIN r ON ev.key = r.key AND ev.date >= r.date)
        SELECT x.key, x.date::VARCHAR AS date, {", ".join(f"round(x.ret_{n}d - b.ret_{n}d, 9) AS abnormal_ret_{n}d" for n in (1, 3, 5))} FROM x ASOF LEFT JOIN b ON x.date >= b.date""",
    "abnormal_volume": f"""WITH {_PR}, r AS (SELECT *, CASE WHEN count(volume) OVER w >= 5 THEN volume / nullif(avg(volume) OVER w, 0) END AS av FROM p WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        SELECT ev.key, ev.date::VARCHAR AS date, round(av, 9) AS abnormal_volume FROM ev ASOF LEFT JOIN r ON ev.key = r.key AND ev.date <= r.date""",
    "simple_log_cum_returns": f"""WITH {_PR}, a AS (SELECT *, lag(close) OVER (PARTITION BY key ORDER BY date) AS b FROM p WHERE close > 1), s AS (SELECT key, date, (close / nullif(b, 0) - 1) / 100 AS simple, ln(close / b) AS logr FROM a)
        SELECT key, date::VARCHAR AS date, round(simple, 9) AS simple, round(logr, 9) AS logr, round(exp(sum(ln(1 + simple)) OVER (PARTITION BY key ORDER BY date)) - 1, 9) AS cum FROM s""",
    "winsorize": f"WITH q AS (SELECT quantile_cont(ret_1d, 0.05) AS a, quantile_cont(ret_1d, 0.95) AS b FROM {MR}) SELECT ticker, quarter, CASE WHEN ret_1d IS NOT NULL THEN round(greatest(a, least(b, ret_1d)), 9) END AS winsorized FROM {MR}, q",
    "qcut_sort": f"""WITH x AS (SELECT {_N("mean_lm_net_score")} AS f, {_N("abnormal_ret_1d")} AS r FROM {FEATURE_ROWS}), y AS (SELECT * FROM x WHERE f IS NOT NULL AND r IS NOT NULL), e AS (SELECT quantile_cont(f, 1.0 / 3) AS a, quantile_cont(f, 2.0 / 3) AS b FROM y)
        SELECT (CASE WHEN f > a THEN 1 ELSE 0 END + CASE WHEN f > b THEN 1 ELSE 0 END)::INTEGER AS bucket, CASE WHEN f <= a THEN 'Low' WHEN f <= b THEN 'Mid' ELSE 'High' END AS label, count(*) AS n, round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS sd, round(avg(f), 9) AS feature_mean FROM y, e GROUP BY ALL""",
    "long_short_t": f"""WITH x AS (SELECT {_N("mean_vader_compound")} AS f, {_N("abnormal_ret_1d")} AS r FROM {FEATURE_ROWS}), y AS (SELECT * FROM x WHERE f IS NOT NULL AND r IS NOT NULL), e AS (SELECT quantile_cont(f, 1.0 / 3) AS a, quantile_cont(f, 2.0 / 3) AS b FROM y),
        g AS (SELECT count(r) FILTER (WHERE f <= a) AS n0, avg(r) FILTER (WHERE f <= a) AS m0, var_samp(r) FILTER (WHERE f <= a) AS v0, count(r) FILTER (WHERE f > b) AS n1, avg(r) FILTER (WHERE f > b) AS m1, var_samp(r) FILTER (WHERE f > b) AS v1 FROM y, e)
        SELECT round(m1 - m0, 9) AS spread, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)), 9) AS t, n0 + n1 AS n FROM g""",
    "event_study_t": " UNION ALL ".join(f"SELECT '{c}' AS \"window\", count({c}) AS n, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS sd, round(avg({c}) / (stddev_samp({c}) / sqrt(count({c}))), 9) AS t, abs(avg({c}) / (stddev_samp({c}) / sqrt(count({c})))) > {_CRITICAL.format(n=f'(count({c}) - 1)')} AS significant FROM {market_sql()}" for c in ("abnormal_ret_1d", "abnormal_ret_3d", "abnormal_ret_5d")),
    "portfolio_backtest": f"""WITH a AS {canonical_sql(FM)}, x AS (SELECT quarter, {_N("mean_lm_net_score")} AS f, {_N("abnormal_ret_1d")} AS r FROM a WHERE regexp_full_match(quarter, '[0-9]{{4}}Q[1-4]')), y AS (SELECT *, median(f) OVER (PARTITION BY quarter) AS m FROM x WHERE f IS NOT NULL AND r IS NOT NULL),
        g AS (SELECT quarter, count(*) AS n, avg(r) FILTER (WHERE f >= m) AS l, coalesce(avg(r) FILTER (WHERE f < m), 0) AS s FROM y GROUP BY quarter HAVING count(*) >= 4)
        SELECT quarter, n, round(l, 9) AS "long", round(s, 9) AS short, round(l - s, 9) AS spread, round(exp(sum(ln(1 + l)) OVER (ORDER BY quarter)) - 1, 9) AS cum_long, round(exp(sum(ln(1 + s)) OVER (ORDER BY quarter)) - 1, 9) AS cum_short FROM g
        UNION ALL SELECT quarter, count(*), NULL, NULL, NULL, NULL, NULL FROM a WHERE NOT coalesce(regexp_full_match(quarter, '[0-9]{{4}}Q[1-4]'), false) GROUP BY quarter""",
    "cumulative_abnormal_return": f"""WITH x AS (SELECT ticker, abnormal_ret_1d AS r, row_number() OVER (PARTITION BY ticker ORDER BY earnings_date NULLS FIRST, quarter NULLS FIRST, ret_1d NULLS FIRST) AS k FROM {market_sql()} WHERE abnormal_ret_1d IS NOT NULL)
        SELECT ticker, CASE WHEN count(*) >= 3 THEN round(sum(r), 9) END AS car FROM x WHERE k <= 3 GROUP BY ticker""",
    "ols_closed_form": """WITH g AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem)
        SELECT 'const' AS term, round(a, 4) AS coef, round(r2, 6) AS r2, n FROM g UNION ALL SELECT 'l_quantity', round(b, 4), round(r2, 6), n FROM g""",
}

_CALL = f"SELECT ticker, quarter, string_agg(text, ' ' ORDER BY chunk_index NULLS FIRST, chunk_id) AS text FROM {keyed_sql()} WHERE text IS NOT NULL GROUP BY ALL"
SQL["feature_panel"] = f"""{_DET},
    pan AS (SELECT * FROM {_PANEL}), fin AS (SELECT ticker, quarter, {", ".join(f"avg({_N(c)}) AS mean_{c}" for c in panel.FINBERT)}, bool_or(coalesce(section = 'qa', false)) AS answers, count(*) AS chunks FROM {keyed_sql()} GROUP BY ALL),
    rk AS (SELECT ticker, quarter, count(*) AS rc, sum({_W3}) AS ri, count(DISTINCT category) AS rn FROM f WHERE NOT negated GROUP BY ALL),
    w0 AS (SELECT ticker, quarter, text, {X.WORDS} AS w, {X.SENT} AS se, lower(text) AS low, {X.count(T.NUMBER)} AS nn, {X.count(T.DOLLAR)} AS dd, {X.count(T.PERCENT)} + {X.count(T.BASIS_POINTS)} AS pp FROM ({_CALL})),
    w1 AS (SELECT *, len(w) AS n, len(se) AS ns, greatest(len(se), 1) AS so, len(list_filter(w, lambda x: {X.SYL} >= 3)) AS lw, coalesce(list_sum(list_transform(w, lambda x: {X.SYL})), 0) AS sy, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS hh FROM w0),
    tx AS (SELECT ticker, quarter, CASE WHEN ns > 0 AND n > 0 THEN 0.4::DOUBLE * (n / ns + 100 * lw / n) ELSE 0 END AS call_fog_index, CASE WHEN ns > 0 AND n > 0 THEN 0.39::DOUBLE * (n / ns) + 11.8::DOUBLE * sy / n - 15.59::DOUBLE ELSE 0 END AS call_flesch_kincaid,
        CASE WHEN ns > 0 AND n > 0 THEN n / ns ELSE 0 END AS call_avg_sentence_length, CASE WHEN ns > 0 AND n > 0 THEN hh / n ELSE 0 END AS call_avg_word_length, CASE WHEN ns > 0 AND n > 0 THEN len(list_distinct(w)) / n ELSE 0 END AS call_vocab_richness,
        CASE WHEN ns > 0 THEN len(list_filter(se, lambda x: len(list_filter({L(T.FLS_KEYWORDS)}, lambda k: contains(lower(x), k))) > 0)) / ns ELSE 0 END AS call_fls_ratio, CASE WHEN ns > 0 THEN len(list_filter({L(T.FLS_KEYWORDS)}, lambda k: contains(low, k)))::INTEGER ELSE 0 END AS call_fls_count,
        nn / so AS call_numbers_per_sentence, dd::INTEGER AS call_dollar_mentions, pp::INTEGER AS call_percent_mentions, (nn + 2 * dd + 2 * pp) / so AS call_specificity_score FROM w1),
    qd AS ({P.SQL["qa_dynamics"]}),
    j AS (SELECT pan.*, fin.* EXCLUDE (ticker, quarter, answers, chunks), coalesce(rc, 0) AS total_risk_count, coalesce(ri, 0) / chunks AS avg_risk_intensity, coalesce(rn, 0)::INTEGER AS num_risk_categories, tx.* EXCLUDE (ticker, quarter), qd.* EXCLUDE (ticker, quarter, qa_pronoun_shift, qa_specificity_drop),
        CASE WHEN answers THEN qa_pronoun_shift ELSE 0 END AS qa_pronoun_shift, CASE WHEN answers THEN qa_specificity_drop ELSE 0 END AS qa_specificity_drop
        FROM pan JOIN fin USING (ticker, quarter) LEFT JOIN rk USING (ticker, quarter) LEFT JOIN tx USING (ticker, quarter) LEFT JOIN qd USING (ticker, quarter)),
    z AS (SELECT *, mean_lm_net_score - lag(mean_lm_net_score) OVER o AS mean_lm_net_score_momentum, mean_vader_compound - lag(mean_vader_compound) OVER o AS mean_vader_compound_momentum, total_risk_count - lag(total_risk_count) OVER o AS risk_delta,
        prepared_sentiment - qa_sentiment AS sentiment_divergence, 0.65::DOUBLE * coalesce(qa_sentiment, 0) + 0.35::DOUBLE * coalesce(prepared_sentiment, 0) AS qa_weighted_sentiment, 1.5::DOUBLE * mean_lm_negative_score AS negative_emphasis,
        mean_lm_negative_score / (mean_lm_positive_score + 1e-8) AS neg_pos_ratio, mean_lm_net_score - 0.5::DOUBLE * mean_lm_uncertainty_score AS uncertainty_adj_sentiment, mgmt_sentiment - analyst_sentiment AS mgmt_analyst_divergence,
        mean_lm_net_score * total_risk_count AS risk_sentiment_interaction FROM j WINDOW o AS (PARTITION BY ticker ORDER BY quarter))
    SELECT ticker, quarter, total_risk_count, num_risk_categories, call_fls_count, call_dollar_mentions, call_percent_mentions, qa_deflection_count, risk_delta, earnings_date,
        round(COLUMNS(c -> c NOT IN ('ticker', 'quarter', 'total_risk_count', 'num_risk_categories', 'call_fls_count', 'call_dollar_mentions', 'call_percent_mentions', 'qa_deflection_count', 'risk_delta', 'earnings_date', 's')), 9)
    FROM z LEFT JOIN (SELECT ticker, quarter, earnings_date, ret_1d, ret_3d, ret_5d, abnormal_ret_1d, abnormal_ret_3d, abnormal_ret_5d, abnormal_volume FROM {market_sql()}) USING (ticker, quarter)""".replace("COLUMNS(c ->", "COLUMNS(lambda c:")
