"""Queries of retrieval, ingestion and models, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import keys, text as T
from earshot.operators import evaluate, ingest, ml, panel, relational, retrieval as R
from earshot.plans.panel import _FIRST, _N, CH, FM, _feature_rows, canonical_sql, keyed_sql
from earshot.plans.text import TOK, WC
from earshot.sources.tables import table


def r9(c, a=None):
    return F.round(c, 9).alias(a or c)


def _asked(spark, d):
    """The stated query set: titles of the documents whose id is divisible by 100."""
    return table(spark, d, "documents").filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query"), F.col("title").alias("text"))


def _sparse(spark, d, k=10):
    return R.bm25(*R.index_texts(table(spark, d, "documents"), "doc_id", "text"), _asked(spark, d), k)


def _dense(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return R.dense(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), "vec_id", "embedding", k)


def bm25_topk(spark, d):
    return _sparse(spark, d).select("query", "id", r9("score"), "rank")


def dense_topk(spark, d):
    return _dense(spark, d).select("query", "id", F.round("score", 6).alias("score"), "rank")


def hybrid_rrf(spark, d):
    return R.fuse(_dense(spark, d, 30), _sparse(spark, d, 30)).select("query", "id", r9("score"), "rank")


def hybrid_filtered(spark, d):
    return R.filter_hits(R.fuse(_dense(spark, d, 30), _sparse(spark, d, 30)), table(spark, d, "documents"), "doc_id", {"lang": ["en"]}).select("query", "id", r9("score"), "rank")


def query_expansion(spark, d):
    return table(spark, d, "documents").filter("title is not null").select("doc_id", F.array_join(R.expand(F.col("title")), " | ").alias("queries"))


def context_budget(spark, d):
    x = relational.keep_one(panel.keyed(table(spark, d, CH)).filter("text is not null"), ["chunk_id"], [F.col("ingested_at")])
    return R.within_budget(x, ["ticker", "quarter"], ["chunk_index", "chunk_id"], T.word_count(F.col("text")), 3000).select("ticker", "quarter", "chunk_id", "used")


def retrieval_recall_mrr(spark, d):
    """Hits of the same ticker are right; how many there are is counted once a ticker, and only the hits are looked up."""
    docs = table(spark, d, "documents").filter("text is not null and ticker is not null").select(F.col("doc_id").alias("id"), "ticker")
    asked = docs.filter("id % 100 = 0").select(F.col("id").alias("query"), "ticker").join(docs.groupBy("ticker").agg(F.count("*").alias("n")), "ticker")
    hits = _sparse(spark, d).filter("rank <= 10").join(docs.withColumnRenamed("ticker", "t"), "id").join(asked.select("query", "ticker"), "query").filter("t = ticker")
    good = hits.groupBy("query").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    return asked.join(good, "query", "left").select("query", r9(F.coalesce("found", F.lit(0)) / F.col("n"), "recall"), r9(F.coalesce(1 / F.col("first"), F.lit(0.0)), "rr"))


def _expected(spark, d):
    """What each stated query should find: documents with the longer words of its title, of its ticker, source and language."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    words = F.array_distinct(F.filter(T.tokens(F.col("title")), lambda w: F.length(w) >= 5))
    return table(spark, d, "documents").filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query"), "title", words.alias("keywords"), one("ticker").alias("tickers"), one("source").alias("sections"), one("lang").alias("roles"))


def _seen(spark, d, k):
    """The hits of the stated queries with what is known of their documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "ticker", F.col("source").alias("section"), F.col("lang").alias("role"))
    return _sparse(spark, d, k).join(docs, "id")


def retrieval_keyword_eval(spark, d):
    e = R.evaluate_keywords(_seen(spark, d, 10), _expected(spark, d))
    return e.select("query", *[r9(c) for c in e.columns[1:]])


def retrieval_metric_summary(spark, d):
    return R.metric_summary(R.evaluate_keywords(_seen(spark, d, 10), _expected(spark, d))).select("metric", r9("mean"), F.round("sd", 7).alias("sd"), "n")


def _answers(spark, d):
    """Answers by quotation: the first 200 characters of the five best hits, each with its number."""
    hits = _seen(spark, d, 5).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "section", "role"))).alias("h"))
    quoted = F.array_join(F.transform("h", lambda s: F.concat(F.substring(s["text"], 1, 200), F.lit(" ["), s["rank"].cast("string"), F.lit("]"))), " ")
    sources = F.transform("h", lambda s: F.struct(s["section"].alias("speaker"), s["role"].alias("section")))
    x = _expected(spark, d).join(hits, "query", "left")
    return x.select("query", F.when(F.col("h").isNotNull(), quoted).alias("answer"), "keywords", sources.alias("sources"), F.size(R.expand(F.col("title"))).alias("queries_used"))


def citation_extract(spark, d):
    """The sources that each answer cites by number."""
    return _answers(spark, d).filter("answer is not null").select("query", F.array_join(T.citations(F.col("answer")), ",").alias("cited"))


def answer_measures(spark, d):
    m = R.answer_measures(_answers(spark, d))
    return m.select(*[r9(c) if c == "keyword_coverage" else c for c in m.columns])


def answer_quality(spark, d):
    s = R.answer_summary(R.answer_measures(_answers(spark, d)))
    return s.select(*[c if c.startswith("n_") else r9(c) for c in s.columns])


def speaker_turn_islands(spark, d):
    x = relational.keep_one(panel.keyed(table(spark, d, CH)).filter("text is not null"), ["chunk_id"], [F.col("ingested_at")])
    i = R.islands(x, ["ticker", "quarter"], ["chunk_index", "chunk_id"], ["speaker", "section"])
    return i.groupBy("ticker", "quarter", "island").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.min("speaker").alias("speaker"))


def speaker_turn_chunks(spark, d):
    x = relational.keep_one(panel.keyed(table(spark, d, CH)), ["chunk_id"], [F.col("ingested_at")])
    return R.turn_chunks(x, ["ticker", "quarter"], ["chunk_index", "chunk_id"], ["speaker", "section"], "text")


def transcript_turns(spark, d):
    return ingest.turns(panel.first_loads(table(spark, d, CH)), ["chunk_id"]).select("chunk_id", "turn", "speaker", "title", F.length("words").alias("chars"), F.md5("words").alias("digest"))


def transcript_parse(spark, d):
    return ingest.turns(panel.first_loads(table(spark, d, CH)), ["chunk_id"]).filter("speaker is not null").select("chunk_id", "turn", "speaker", "title", "role", F.length("words").alias("chars"))


def parse_transcript(spark, d):
    """Whole calls, put together from their chunks, parsed again into chunks with speaker, role and section."""
    x = panel.keyed(panel.first_loads(table(spark, d, CH))).filter("text is not null")
    item = F.struct("chunk_index", "chunk_id", "text")
    calls = x.groupBy("ticker", "quarter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["text"]), "\n").alias("transcript_text"))
    return ingest.parse_transcripts(calls).select("chunk_id", "ticker", "quarter", "speaker", "title", "role", "section", "chunk_index", F.length("text").alias("chars"))


def chunker(spark, d):
    return ingest.chunk_texts(panel.first_loads(table(spark, d, CH)), "chunk_id", "text")


def _features(x):
    """All features of the matrix that enough rows have."""
    return panel.select_features(x, evaluate.DIRECTION_FEATURES, 0.7)


def direction_models(spark, d):
    x = table(spark, d, FM)
    return ml.direction_models(x, _features(x), "abnormal_ret_1d", folds=5, trees=200, rounds=200)


def walk_forward(spark, d):
    """Under canonical quarters; rows whose quarter can't be read are only counted, under a null split."""
    x, read = keys.canonical(table(spark, d, FM)), keys.quarter_index(F.col("quarter")).isNotNull()
    unread = x.filter(~read).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("int").alias("split"), "n", F.lit(None).cast("double").alias("r2"))
    return ml.walk_forward(x.filter(read), _features(x), "abnormal_ret_1d", "quarter").unionByName(unread)


def return_models(spark, d):
    x = table(spark, d, FM)
    return ml.return_models(x, _features(x), "abnormal_ret_1d", trees=100, rounds=100)


def finance_run_all(spark, d):
    """Event study, sorts, regression and their measures in one table; the return models have a query of their own."""
    return evaluate.run_all(_feature_rows(spark, d), models=False)


def backtest_summary(spark, d):
    x = keys.canonical(table(spark, d, FM)).filter(keys.quarter_index(F.col("quarter")).isNotNull())
    b = [evaluate.backtest_summary(x, f, "abnormal_ret_1d").withColumn("feature", F.lit(f)) for f in evaluate.SORTED_BY]
    return b[0].unionByName(b[1]).select("feature", "periods", r9("spread_mean"), r9("spread_sd"), r9("positive"), r9("cum_long"), r9("cum_short"))


def role_predictions(spark, d):
    """The classifier's label of every chunk, trained on those whose role is known; each chunk once."""
    x = panel.keyed(panel.first_loads(table(spark, d, CH))).withColumn("group", F.when(F.col("role").isin("CEO", "CFO", "COO", "CTO", "VP"), "Management").when(F.col("role").isin("IR", "Analyst", "Operator"), F.col("role")))
    models = ml.train_role_classifier(x, "text", "group", "chunk_id", terms=5000, iterations=100)
    return ml.predict_roles(models, x.select("chunk_id", "group", "text"), "text").select("chunk_id", "group", "predicted", F.round("confidence", 4).alias("confidence"))


def role_classifier(spark, d):
    x = panel.keyed(table(spark, d, CH)).withColumn("group", F.when(F.col("role").isin("CEO", "CFO", "COO", "CTO", "VP"), "Management").when(F.col("role").isin("IR", "Analyst", "Operator"), F.col("role")))
    return ml.role_classifier(x, "text", "group", "chunk_id", terms=5000)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, dense_topk, hybrid_rrf, hybrid_filtered, query_expansion, context_budget, retrieval_recall_mrr, retrieval_keyword_eval, retrieval_metric_summary, citation_extract, answer_measures, answer_quality, speaker_turn_islands, speaker_turn_chunks, transcript_turns, transcript_parse, parse_transcript, chunker, direction_models, return_models, walk_forward, finance_run_all, backtest_summary, role_classifier, role_predictions,
    )
}

_B = f"""p AS (SELECT doc_id AS id, {TOK} AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT id, unnest(t) AS term FROM p), po AS (SELECT id, term, count(*) AS tf FROM u GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM p),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY term), rw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, a FROM df, n), mn AS (SELECT avg(raw) AS m FROM rw), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf, a FROM rw, mn),
    qs AS (SELECT doc_id AS query, unnest({TOK.replace("text", "title")}) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL), q AS (SELECT query, term, count(*) AS q FROM qs GROUP BY ALL),
    sc AS (SELECT query, po.id, sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / a)))::DOUBLE AS score FROM q JOIN po USING (term) JOIN idf USING (term) JOIN p ON p.id = po.id GROUP BY ALL),
    sp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM sc WHERE score > 0)"""
_D = """ds AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
    de AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM ds)"""
_H = f"""WITH {_B}, {_D}, j AS (SELECT coalesce(d.query, s.query) AS query, coalesce(d.id, s.id) AS id, d.rank AS rd, s.rank AS rs, coalesce(0.6 / (60 + d.rank), 0)::DOUBLE + coalesce(0.4 / (60 + s.rank), 0)::DOUBLE AS score
    FROM (SELECT * FROM de WHERE rank <= 30) d FULL JOIN (SELECT * FROM sp WHERE rank <= 30) s ON d.query = s.query AND d.id = s.id),
    h AS (SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, rd NULLS LAST, rs NULLS FIRST, id)::INTEGER AS rank FROM j QUALIFY rank <= 10)"""
_EXP = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN title || ' | {' | '.join(m)}'" for p, m in R.EXPANSIONS) + " ELSE title END"


def _turns_sql() -> str:
    """Turns by header lines; a pattern that looks ahead to a capital takes it instead and gives it back to the speech."""
    q = lambda p: p.replace("'", "''").replace("(?=\\p{Lu})", "(\\p{Lu})")
    case = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(line, '{q(p)}') THEN {f(q(p), t)}" for p, t in ingest.HEADERS) + " END"
    name, title = case(lambda p, t: f"trim(regexp_extract(line, '{p}', 1))"), case(lambda p, t: f"trim(regexp_extract(line, '{p}', {t}))" if t else "''")
    rest = case(lambda p, t: f"regexp_replace(line, '{p}', '{chr(92)}3')" if p.endswith("(\\p{Lu})") else f"regexp_replace(line, '{p}', '')")
    heads = ", ".join(f"'{h}'" for h in ingest.HEADINGS)
    return f"""WITH t AS (SELECT chunk_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM {_FIRST} WHERE text IS NOT NULL), l AS (SELECT chunk_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM t), h AS (SELECT *, {name} AS s0, {title} AS ti, {rest} AS re FROM l),
        g AS (SELECT *, CASE WHEN lower(s0) NOT IN ({heads}) THEN s0 END AS sp FROM h), c AS (SELECT *, count(sp) OVER (PARTITION BY chunk_id) < 2 AS few, count(sp) OVER (PARTITION BY chunk_id ORDER BY n) AS k FROM g),
        u AS (SELECT chunk_id, CASE WHEN few THEN 1 ELSE k END AS turn, CASE WHEN few THEN 'Unknown' ELSE sp END AS speaker, CASE WHEN few OR sp IS NULL THEN NULL ELSE ti END AS title, CASE WHEN few OR sp IS NULL THEN line ELSE re END AS said, n FROM c),
        v AS (SELECT chunk_id, turn, max(speaker) AS speaker, nullif(max(title), '') AS title, regexp_replace(string_agg(said, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS words FROM u GROUP BY chunk_id, turn)
        SELECT chunk_id, turn::BIGINT AS turn, speaker, title, length(words)::INTEGER AS chars, md5(words) AS digest FROM v WHERE words <> ''"""


_EX = f"""ex AS (SELECT doc_id AS query, title, list_distinct(list_filter({TOK.replace("text", "title")}, lambda w: length(w) >= 5)) AS kws, ticker, source, lang FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
    hi AS (SELECT sp.query, rank, text, d.ticker, d.source, d.lang FROM sp JOIN documents d ON d.doc_id = sp.id)"""
_KE = f"""WITH {_B}, {_EX}, kx AS (SELECT query, unnest(kws) AS kw FROM ex), ka AS (SELECT kx.query, kw, min(rank) AS fa FROM kx JOIN hi ON hi.query = kx.query AND rank <= 10 AND contains(lower(text), kw) GROUP BY ALL),
    kf AS (SELECT query, count(*) FILTER (WHERE fa <= 3) AS f3, count(*) FILTER (WHERE fa <= 5) AS f5, count(*) AS f10, min(fa) AS best FROM ka GROUP BY query),
    ac AS (SELECT ex.query, avg((ex.ticker = hi.ticker)::INT) AS ta, avg((ex.source = hi.source)::INT) AS sa, avg((ex.lang = hi.lang)::INT) AS la FROM ex JOIN hi ON hi.query = ex.query AND rank <= 5 GROUP BY ex.query),
    ev AS (SELECT ex.query, CASE WHEN len(kws) = 0 THEN 1 ELSE round(coalesce(f3, 0) / len(kws), 9) END AS recall_3, CASE WHEN len(kws) = 0 THEN 1 ELSE round(coalesce(f5, 0) / len(kws), 9) END AS recall_5, CASE WHEN len(kws) = 0 THEN 1 ELSE round(coalesce(f10, 0) / len(kws), 9) END AS recall_10,
        CASE WHEN len(kws) = 0 THEN 1 ELSE round(coalesce(1 / best, 0), 9) END AS rr, CASE WHEN len(kws) = 0 THEN 1 ELSE round(coalesce(f10, 0) / len(kws), 9) END AS keyword_hit_rate, CASE WHEN ticker IS NULL THEN 1 ELSE round(ta, 9) END AS ticker_accuracy,
        CASE WHEN source IS NOT NULL THEN round(sa, 9) END AS section_accuracy, CASE WHEN lang IS NOT NULL THEN round(la, 9) END AS role_accuracy FROM ex LEFT JOIN kf USING (query) LEFT JOIN ac USING (query))"""
_QU = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN {1 + len(m)}" for p, m in R.EXPANSIONS) + " ELSE 1 END"
_HG = " OR ".join("contains(lower(answer), '" + h.replace("'", "''") + "')" for h in R.HEDGES)
_AN = f"""WITH {_B}, {_EX}, aa AS (SELECT query, string_agg(text[1:200] || ' [' || rank::VARCHAR || ']', ' ' ORDER BY rank) AS answer, count(*) AS ns, count(DISTINCT coalesce(source, '')) AS us, count(DISTINCT coalesce(lang, '')) AS ul FROM hi WHERE rank <= 5 GROUP BY query),
    am AS (SELECT query, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> ''))::INTEGER AS length_words, len(regexp_extract_all(answer, '\\[\\d+\\]'))::INTEGER AS citations, (len(regexp_extract_all(answer, '\\[\\d+\\]')) > 0)::INTEGER AS has_citations, ({_HG})::INTEGER AS hedged,
        CASE WHEN answer IS NOT NULL THEN CASE WHEN len(kws) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(kws, lambda k: contains(lower(answer), k))) / len(kws) END END AS keyword_coverage, ns::INTEGER AS n_sources, us::INTEGER AS unique_speakers, ul::INTEGER AS unique_sections,
        CASE WHEN answer IS NOT NULL THEN ({_QU} > 1)::INTEGER END AS expanded FROM ex LEFT JOIN aa USING (query))"""
_ONE = f"(SELECT * FROM {keyed_sql()} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
SQL = {
    "transcript_turns": _turns_sql(),
    "backtest_summary": " UNION ALL ".join(f"""SELECT * FROM (WITH x AS (SELECT quarter, {_N(f)} AS f, {_N("abnormal_ret_1d")} AS r FROM {canonical_sql(FM)} WHERE regexp_full_match(quarter, '[0-9]{{4}}Q[1-4]')), y AS (SELECT *, median(f) OVER (PARTITION BY quarter) AS m FROM x WHERE f IS NOT NULL AND r IS NOT NULL),
        g AS (SELECT quarter, avg(r) FILTER (WHERE f >= m) AS l, coalesce(avg(r) FILTER (WHERE f < m), 0) AS s FROM y GROUP BY quarter HAVING count(*) >= 4)
        SELECT '{f}' AS feature, count(*) AS periods, round(avg(l - s), 9) AS spread_mean, round(stddev_samp(l - s), 9) AS spread_sd, round(avg((l - s > 0)::INT), 9) AS positive, round(exp(sum(ln(1 + l))) - 1, 9) AS cum_long, round(exp(sum(ln(1 + s))) - 1, 9) AS cum_short FROM g)""" for f in evaluate.SORTED_BY),
    "bm25_topk": f"WITH {_B} SELECT query, id, round(score, 9) AS score, rank FROM sp WHERE rank <= 10",
    "dense_topk": f"WITH {_D} SELECT query, id, round(score, 6) AS score, rank FROM de WHERE rank <= 10",
    "hybrid_rrf": f"{_H} SELECT * FROM h",
    "hybrid_filtered": f"{_H} SELECT h.* FROM h LEFT JOIN documents d ON d.doc_id = h.id WHERE lang IS NULL OR lang = 'en'",
    "query_expansion": f"SELECT doc_id, {_EXP} AS queries FROM documents WHERE title IS NOT NULL",
    "context_budget": f"SELECT ticker, quarter, chunk_id, sum({WC}) OVER (PARTITION BY ticker, quarter ORDER BY chunk_index, chunk_id)::BIGINT AS used FROM {_ONE} QUALIFY used <= 3000",
    "retrieval_recall_mrr": f"""WITH {_B}, dt AS (SELECT doc_id AS id, ticker FROM documents WHERE text IS NOT NULL AND ticker IS NOT NULL), tr AS (SELECT a.id AS query, b.id FROM dt a JOIN dt b USING (ticker) WHERE a.id % 100 = 0),
        g AS (SELECT query, count(*) AS f, min(rank) AS r FROM sp JOIN tr USING (query, id) WHERE rank <= 10 GROUP BY query), nt AS (SELECT query, count(*) AS n FROM tr GROUP BY query)
        SELECT query, round(coalesce(f, 0) / n, 9) AS recall, round(coalesce(1 / r, 0), 9) AS rr FROM nt LEFT JOIN g USING (query)""",
    "retrieval_keyword_eval": f"{_KE} SELECT * FROM ev",
    "retrieval_metric_summary": f"{_KE}" + " UNION ALL ".join(f" SELECT '{c}' AS metric, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 7) AS sd, count({c}) AS n FROM ev" for c in ("recall_3", "recall_5", "recall_10", "rr", "keyword_hit_rate", "ticker_accuracy", "section_accuracy", "role_accuracy")),
    "citation_extract": f"{_AN} SELECT query, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: TRY_CAST(x AS INTEGER)))), ',') AS cited FROM aa",
    "answer_measures": f"{_AN} SELECT * REPLACE (round(keyword_coverage, 9) AS keyword_coverage) FROM am",
    "answer_quality": f"""{_AN} SELECT count(*) AS n_questions, count(keyword_coverage) AS n_successful, round(avg(length_words), 9) AS avg_answer_length, round(avg(citations), 9) AS avg_citations, round(avg(has_citations), 9) AS citation_rate,
        round(avg(keyword_coverage), 9) AS avg_keyword_coverage, round(avg(hedged), 9) AS hedge_rate, round(avg(expanded), 9) AS query_expansion_rate, round(avg(n_sources), 9) AS avg_sources, round(avg(unique_speakers), 9) AS avg_unique_speakers FROM am""",
    "speaker_turn_islands": f"""WITH a AS (SELECT *, row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w OR section IS DISTINCT FROM lag(section) OVER w AS c FROM {_ONE} WINDOW w AS (PARTITION BY ticker, quarter ORDER BY chunk_index, chunk_id)),
        b AS (SELECT *, sum(c::INT) OVER (PARTITION BY ticker, quarter ORDER BY chunk_index, chunk_id)::BIGINT AS island FROM a) SELECT ticker, quarter, island, count(*) AS chunks, sum(length(text))::BIGINT AS chars, min(speaker) AS speaker FROM b GROUP BY ALL""",
}
