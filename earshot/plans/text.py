"""Queries over texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.functions import keys, lexicons, text as T
from earshot.operators import sentiment
from earshot.sources.tables import table

L = lambda words: "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
TOK = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
SENT = "list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 10)"
WORDS = "regexp_extract_all(lower(text), '[a-zA-Z'']+')"
WC = "len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+'))"
SYL = "greatest(1, len(regexp_extract_all(regexp_replace(x, 'e+$', ''), '[aeiou]+')))"
CHUNKS, DOCS = "chunks_with_sentiment", "documents"


def count(pattern: str, of: str = "text") -> str:
    p = pattern.replace("'", "''")
    return f"len(regexp_extract_all({of}, '{p}'))"


def _scored(df):
    s = T.lexicon_scores(F.col("text"), lexicons.POSITIVE, lexicons.NEGATIVE, lexicons.UNCERTAIN)
    return df.filter("text is not null").withColumn("s", s)


_SCORED_SQL = f"""(SELECT *, greatest(len(u), 1) AS n, len(list_intersect(u, {L(lexicons.POSITIVE)})) AS p, len(list_intersect(u, {L(lexicons.NEGATIVE)})) AS m,
    len(list_intersect(u, {L(lexicons.UNCERTAIN)})) AS unc FROM (SELECT *, list_distinct({TOK}) AS u FROM {{t}} WHERE text IS NOT NULL))"""


def lexicon_sentiment_by_source(spark, d):
    r = lambda c, a: F.round(F.avg(c), 6).alias(a)
    return _scored(table(spark, d, DOCS)).groupBy("source", "lang").agg(F.count("*").alias("docs"), r("s.pos", "pos"), r("s.neg", "neg"), r("s.net", "net"), r("s.unc", "uncertainty"))


def lexicon_sentiment_chunks(spark, d):
    r = lambda c: F.round(f"s.{c}", 6).alias(c)
    return _scored(table(spark, d, CHUNKS)).select("chunk_id", r("pos"), r("neg"), r("net"), r("unc"))


def readability(spark, d):
    x = table(spark, d, CHUNKS).filter("text is not null").select("chunk_id", T.readability(F.col("text")).alias("r"))
    return x.select("chunk_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("fog", "flesch_kincaid", "sentence_length", "word_length", "richness")])


def fls_features(spark, d):
    x = table(spark, d, CHUNKS).filter("text is not null").select("chunk_id", T.forward_looking(F.col("text")).alias("r"))
    return x.select("chunk_id", F.round("r.fls_ratio", 6).alias("fls_ratio"), F.col("r.fls_count").alias("fls_count"))


def specificity_features(spark, d):
    x = table(spark, d, CHUNKS).filter("text is not null").select("chunk_id", T.specificity(F.col("text")).alias("r"))
    return x.select("chunk_id", F.round("r.numbers_per_sentence", 6).alias("numbers_per_sentence"), "r.dollar_mentions", "r.percent_mentions", F.round("r.specificity_score", 6).alias("specificity_score"))


def word_sentence_counts(spark, d):
    t = F.col("text")
    return table(spark, d, DOCS).filter("text is not null").select(
        "doc_id", T.word_count(t).alias("n_words"), F.size(T.sentences(t)).alias("n_sentences"), F.size(T.tokens(t)).alias("n_tokens"), F.size(T.words(t)).alias("n_latin"), F.size(T.plain_tokens(t)).alias("n_plain")
    )


def filler_passive_pronouns(spark, d):
    low = F.lower("text")
    c = lambda p: F.regexp_count(low, F.lit(p))
    return table(spark, d, CHUNKS).filter("text is not null").select(
        "chunk_id", T.count_any(low, T.FILLERS).alias("fillers"), c(T.PASSIVE).alias("passives"), c(T.FIRST_PERSON).alias("first_person"), c(T.THIRD_PERSON).alias("third_person"), T.contains_any(low, T.DEFLECTIONS).cast("int").alias("deflects")
    )


def normalized_scores(spark, d):
    n = lambda c, m: F.round(T.normalize_score(F.col(c), m), 6).alias(c)
    return table(spark, d, CHUNKS).select("chunk_id", n("lm_net_score", "lm"), n("vader_compound", "vader"), n("finbert_score", "finbert"), F.round(T.normalize_score(F.col("vader_pos"), "other"), 6).alias("vader_pos"))


def role_of_title(spark, d):
    return table(spark, d, CHUNKS).select("title", T.role_of_title(F.col("title")).alias("role_found")).groupBy("title", "role_found").agg(F.count("*").alias("n"))


def section_boundary(spark, d):
    """Where the questions of each call begin: the first cue in the last four fifths of its chunks put together."""
    x = table(spark, d, CHUNKS).filter("text is not null")
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("ingested_at"))).filter("_n = 1")
    key = [keys.normalize_ticker(F.col("ticker")).alias("ticker"), keys.normalize_quarter(F.col("quarter")).alias("quarter")]
    calls = x.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), lambda s: s["text"]), "\n").alias("t"))
    b = T.qa_boundary(F.col("t"))
    return calls.select("ticker", "quarter", b.alias("boundary"), (b <= F.length("t")).alias("has_questions"), T.section_cue(F.col("t")).alias("cue_section"))


def boilerplate_strip(spark, d):
    return table(spark, d, CHUNKS).filter("text is not null").select("chunk_id", F.length(T.strip_boilerplate(F.col("text"))).alias("kept_chars"))


def highlight_words(spark, d):
    lex = [("neg", lexicons.NEGATIVE), ("pos", lexicons.POSITIVE), ("unc", lexicons.UNCERTAIN)]
    return table(spark, d, DOCS).filter("text is not null").select("doc_id", T.highlight(F.col("text"), lex).alias("marked"))


def highlight_risk(spark, d):
    return table(spark, d, CHUNKS).filter("text is not null").select("chunk_id", T.highlight_phrases(F.col("text"), sorted({k for ks in lexicons.RISKS.values() for k in ks})).alias("excerpt"))


def valence_scores(spark, d):
    values = {w: 1.5 for w in lexicons.POSITIVE} | {w: -1.5 for w in lexicons.NEGATIVE}
    x = sentiment.analyze(table(spark, d, DOCS).filter("text is not null"), "text", {"v": lambda c: sentiment.valence(c, values)})
    return x.select("doc_id", *[F.round(f"v.{c}", 6).alias(c) for c in ("compound", "pos", "neg", "neu")])


def quarter_normalize(spark, d):
    q = F.col("quarter")
    x = table(spark, d, CHUNKS).groupBy("quarter").agg(F.count("*").alias("n")).withColumn("q", keys.normalize_quarter(q))
    i = keys.quarter_index(F.col("q"))
    return x.select("quarter", F.col("q").alias("canonical"), i.alias("q_index"), keys.quarter_text(i + 1).alias("next_q"), keys.quarter_text(i - 1).alias("prev_q"), "n")


def ticker_normalize(spark, d):
    return table(spark, d, CHUNKS).groupBy("ticker").agg(F.count("*").alias("n")).select("ticker", keys.normalize_ticker(F.col("ticker")).alias("canonical"), "n")


def date_parse(spark, d):
    p = keys.parse_date(F.col("date"))
    return table(spark, d, "manifest").select("file_path", "date", p.cast("string").alias("parsed"), keys.next_weekday(p).cast("string").alias("trading_day"), keys.previous_weekday(p).cast("string").alias("previous_day"))


def missing_quarters(spark, d):
    x = table(spark, d, "feature_matrix").select(keys.normalize_ticker(F.col("ticker")).alias("ticker"), keys.normalize_quarter(F.col("quarter")).alias("quarter"))
    return keys.missing_quarters(x, "ticker", "quarter")


def display_formats(spark, d):
    """Returns as per cent, and the names of as many risk categories as the event's month says, spelled out and joined."""
    x = table(spark, d, "market_reactions")
    names = F.slice(F.array(*map(F.lit, sorted(lexicons.RISKS))), F.lit(1), F.least(F.month("earnings_date"), F.lit(10)))
    shown = F.array_join(F.transform(names, lambda c: F.initcap(F.regexp_replace(c, "_", " "))), ", ")
    return x.select("ticker", "quarter", F.when(F.col("ret_1d").isNotNull(), F.concat(F.format_string("%.4f", F.col("ret_1d") * 100), F.lit("%"))).alias("pct"), shown.alias("labels"))


def ticker_detect(spark, d):
    """Company and quarter of each document by its whole text."""
    docs = table(spark, d, DOCS).filter("text is not null").select("doc_id", "text")
    return keys.detect_call(docs, "doc_id", "text", table(spark, d, "companies")).select("doc_id", F.coalesce("ticker", F.lit("UNKNOWN")).alias("found"), F.coalesce("quarter", F.lit("")).alias("quarter_found"))


_Q = """CASE WHEN regexp_matches(s, '^(?:FY)?\\d{4}Q\\d') THEN regexp_extract(s, '^(?:FY)?(\\d{4})Q(\\d)', 1) || 'Q' || regexp_extract(s, '^(?:FY)?(\\d{4})Q(\\d)', 2)
    WHEN regexp_matches(s, '^Q\\d\\d{4}') THEN regexp_extract(s, '^Q(\\d)(\\d{4})', 2) || 'Q' || regexp_extract(s, '^Q(\\d)(\\d{4})', 1) ELSE s END"""
_S = "regexp_replace(upper(trim(quarter)), '[ -]', '', 'g')"
_QTEXT = "(({i}) // 4)::VARCHAR || 'Q' || ((({i}) % 4) + 1)::VARCHAR"
_TICK = "CASE upper(trim(ticker)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in keys.ALIASES.items()) + " ELSE upper(trim(ticker)) END"
_ROLE = "CASE WHEN coalesce(title, '') = '' THEN 'Unknown' " + " ".join("WHEN " + " OR ".join(f"contains(lower(title), '{k}')" for k in ks) + f" THEN '{r}'" for r, ks in T.ROLE_WORDS) + " ELSE 'Other' END"
_LEX = [("neg", lexicons.NEGATIVE), ("pos", lexicons.POSITIVE), ("unc", lexicons.UNCERTAIN)]
_CORE = "regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')"
_MARK = "CASE " + " ".join(f"WHEN list_contains({L(x)}, {_CORE}) THEN '<{n}>' || w || '</{n}>'" for n, x in _LEX) + " ELSE w END"
_PHRASES = sorted({k for ks in lexicons.RISKS.values() for k in ks})
_AT = ", ".join(f"CASE WHEN strpos(lower(t)[lo:], '{c.replace(chr(39), chr(39) * 2)}') > 0 THEN strpos(lower(t)[lo:], '{c.replace(chr(39), chr(39) * 2)}') + lo - 1 END" for c in T.QA_CUES)
_DATE = r"regexp_replace(regexp_replace(trim(regexp_replace(date, '(?i),?\s*\d{1,2}:\d{2}\s*[ap]\.?m\.?\s*ET\s*$', '')), ',$', ''), '^([A-Za-z]{3})[a-z]*\.?\s+', '\1 ')"

_QF = "CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN regexp_extract(h, '{p}', {y}) || 'Q' || " + (f"regexp_extract(h, '{p}', {q})" if isinstance(q, int) else f"'{q[0]}'") for p, y, q in keys.QUARTERS) + " END"

QUERIES = {
    f.__name__: f
    for f in (
        lexicon_sentiment_by_source, lexicon_sentiment_chunks, readability, fls_features, specificity_features, word_sentence_counts, filler_passive_pronouns, normalized_scores, role_of_title, section_boundary,
        boilerplate_strip, highlight_words, highlight_risk, valence_scores, quarter_normalize, ticker_normalize, date_parse, missing_quarters, display_formats, ticker_detect,
    )
}

SQL = {
    "lexicon_sentiment_by_source": f"SELECT source, lang, count(*) AS docs, round(avg(p / n), 6) AS pos, round(avg(m / n), 6) AS neg, round(avg((p - m) / n), 6) AS net, round(avg(unc / n), 6) AS uncertainty FROM {_SCORED_SQL.format(t=DOCS)} GROUP BY ALL",
    "lexicon_sentiment_chunks": f"SELECT chunk_id, round(p / n, 6) AS pos, round(m / n, 6) AS neg, round((p - m) / n, 6) AS net, round(unc / n, 6) AS unc FROM {_SCORED_SQL.format(t=CHUNKS)}",
    "readability": f"""WITH a AS (SELECT chunk_id, {WORDS} AS w, len({SENT}) AS ns FROM {CHUNKS} WHERE text IS NOT NULL),
        b AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: {SYL} >= 3)) AS c, coalesce(list_sum(list_transform(w, lambda x: {SYL})), 0) AS y, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS h FROM a)
        SELECT chunk_id, CASE WHEN ns > 0 AND n > 0 THEN round(0.4::DOUBLE * (n / ns + 100 * c / n), 6) ELSE 0.0::DOUBLE END AS fog, CASE WHEN ns > 0 AND n > 0 THEN round(0.39::DOUBLE * (n / ns) + 11.8::DOUBLE * y / n - 15.59::DOUBLE, 6) ELSE 0.0::DOUBLE END AS flesch_kincaid,
        CASE WHEN ns > 0 AND n > 0 THEN round(n / ns, 6) ELSE 0.0::DOUBLE END AS sentence_length, CASE WHEN ns > 0 AND n > 0 THEN round(h / n, 6) ELSE 0.0::DOUBLE END AS word_length, CASE WHEN ns > 0 AND n > 0 THEN round(len(list_distinct(w)) / n, 6) ELSE 0.0::DOUBLE END AS richness FROM b""",
    "fls_features": f"""WITH a AS (SELECT chunk_id, lower(text) AS l, {SENT} AS s FROM {CHUNKS} WHERE text IS NOT NULL)
        SELECT chunk_id, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: len(list_filter({L(T.FLS_KEYWORDS)}, lambda k: contains(lower(x), k))) > 0)) / len(s), 6) ELSE 0.0::DOUBLE END AS fls_ratio,
        (CASE WHEN len(s) > 0 THEN len(list_filter({L(T.FLS_KEYWORDS)}, lambda k: contains(l, k))) ELSE 0 END)::INTEGER AS fls_count FROM a""",
    "specificity_features": f"""WITH a AS (SELECT chunk_id, {count(T.NUMBER)} AS n, {count(T.DOLLAR)} AS d, {count(T.PERCENT)} AS p, {count(T.BASIS_POINTS)} AS b, greatest(len({SENT}), 1) AS s FROM {CHUNKS} WHERE text IS NOT NULL)
        SELECT chunk_id, round(n / s, 6) AS numbers_per_sentence, d::INTEGER AS dollar_mentions, (p + b)::INTEGER AS percent_mentions, round((n + 2 * d + 2 * p + 2 * b) / s, 6) AS specificity_score FROM a""",
    "word_sentence_counts": f"""SELECT doc_id, {WC}::INTEGER AS n_words, len({SENT})::INTEGER AS n_sentences, len({TOK})::INTEGER AS n_tokens, len({WORDS})::INTEGER AS n_latin,
        len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' +'), lambda w: w <> ''))::INTEGER AS n_plain FROM {DOCS} WHERE text IS NOT NULL""",
    "filler_passive_pronouns": f"""SELECT chunk_id, ({" + ".join(count(f, "lower(text)") for f in T.FILLERS)})::INTEGER AS fillers, {count(T.PASSIVE, "lower(text)")}::INTEGER AS passives, {count(T.FIRST_PERSON, "lower(text)")}::INTEGER AS first_person,
        {count(T.THIRD_PERSON, "lower(text)")}::INTEGER AS third_person, (len(list_filter({L(T.DEFLECTIONS)}, lambda k: contains(lower(text), k))) > 0)::INTEGER AS deflects FROM {CHUNKS} WHERE text IS NOT NULL""",
    "normalized_scores": f"SELECT chunk_id, round(greatest(-1, least(1, lm_net_score * 10)), 6) AS lm_net_score, round(greatest(-1, least(1, vader_compound)), 6) AS vader_compound, round(greatest(-1, least(1, finbert_score)), 6) AS finbert_score, round(vader_pos, 6) AS vader_pos FROM {CHUNKS}",
    "role_of_title": f"SELECT title, {_ROLE} AS role_found, count(*) AS n FROM {CHUNKS} GROUP BY ALL",
    "section_boundary": f"""WITH f AS (SELECT * FROM {CHUNKS} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1), k AS (SELECT {_TICK} AS ticker, {_Q} AS quarter, chunk_index, chunk_id, text FROM (SELECT *, {_S} AS s FROM f)),
        a AS (SELECT ticker, quarter, string_agg(text, chr(10) ORDER BY chunk_index NULLS FIRST, chunk_id) AS t FROM k GROUP BY ALL), b AS (SELECT *, (length(t) // 5) + 1 AS lo FROM a), c AS (SELECT *, coalesce(least({_AT}), length(t) + 1) AS e FROM b)
        SELECT ticker, quarter, e::INTEGER AS boundary, e <= length(t) AS has_questions, CASE WHEN len(list_filter({L(T.QA_CUES)}, lambda q: contains(lower(t), q))) > 0 THEN 'qa' ELSE 'prepared_remarks' END AS cue_section FROM c""",
    "highlight_risk": f"""WITH a AS (SELECT chunk_id, text, list_min(list_filter(list_transform({L(_PHRASES)}, lambda k: strpos(lower(text), k)), lambda p: p > 0)) AS f FROM {CHUNKS} WHERE text IS NOT NULL)
        SELECT chunk_id, regexp_replace(text[greatest(1, coalesce(f, 1) - 200):greatest(1, coalesce(f, 1) - 200) + 399], '(?i)({"|".join(sorted(_PHRASES, key=lambda p: (-len(p), p)))})', '<risk>\\1</risk>', 'g') AS excerpt FROM a""",
    "highlight_words": f"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: {_MARK}), ' ') AS marked FROM {DOCS} WHERE text IS NOT NULL",
    "quarter_normalize": f"""WITH a AS (SELECT quarter, count(*) AS n, {_S} AS s FROM {CHUNKS} GROUP BY ALL), b AS (SELECT *, {_Q} AS q FROM a),
        c AS (SELECT *, CASE WHEN regexp_full_match(q, '\\d{{4}}Q[1-4]') THEN q[1:4]::INTEGER * 4 + q[6:6]::INTEGER - 1 END AS i FROM b)
        SELECT quarter, q AS canonical, i AS q_index, {_QTEXT.format(i="i + 1")} AS next_q, {_QTEXT.format(i="i - 1")} AS prev_q, n FROM c""",
    "ticker_normalize": f"SELECT ticker, {_TICK} AS canonical, count(*) AS n FROM {CHUNKS} GROUP BY ALL",
    "date_parse": f"""WITH a AS (SELECT file_path, date, coalesce(try_strptime({_DATE}, '%b %d, %Y'), try_strptime({_DATE}, '%Y-%m-%d'))::DATE AS p FROM manifest)
        SELECT file_path, date, p::VARCHAR AS parsed, (p + (CASE dayofweek(p) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END)::INTEGER)::VARCHAR AS trading_day, (p - (CASE dayofweek(p) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END)::INTEGER)::VARCHAR AS previous_day FROM a""",
    "missing_quarters": f"""WITH a AS (SELECT {_TICK} AS ticker, {_S} AS s FROM feature_matrix), b AS (SELECT DISTINCT ticker, {_Q} AS q FROM a),
        c AS (SELECT ticker, q[1:4]::INTEGER * 4 + q[6:6]::INTEGER - 1 AS i FROM b WHERE regexp_full_match(q, '\\d{{4}}Q[1-4]') AND ticker IS NOT NULL),
        e AS (SELECT ticker, i, lead(i) OVER (PARTITION BY ticker ORDER BY i) AS j FROM (SELECT DISTINCT * FROM c)), m AS (SELECT ticker, unnest(range(i + 1, j)) AS k FROM e WHERE j > i + 1)
        SELECT ticker, {_QTEXT.format(i="k")} AS missing FROM m""",
    "display_formats": f"""SELECT ticker, quarter, format('{{:.4f}}%', ret_1d * 100) AS pct, array_to_string(list_transform({L(sorted(lexicons.RISKS))}[1:least(month(earnings_date), 10)], lambda c: array_to_string(list_transform(string_split(c, '_'), lambda w: upper(w[1]) || w[2:]), ' ')), ', ') AS labels FROM market_reactions""",
    "ticker_detect": f"""WITH a AS (SELECT doc_id, upper(text) AS h FROM {DOCS} WHERE text IS NOT NULL), n AS (SELECT ticker, upper(name) AS nm FROM companies),
        m AS (SELECT doc_id, ticker, row_number() OVER (PARTITION BY doc_id ORDER BY length(nm) DESC, ticker) AS k FROM a JOIN n ON contains(h, nm)), q AS (SELECT *, {_QF} AS quarter_found, nullif(regexp_extract(h, '{keys.EXCHANGE}', 1), '') AS ex FROM a)
        SELECT doc_id, coalesce(ex, ticker, 'UNKNOWN') AS found, coalesce(quarter_found, '') AS quarter_found FROM q LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (doc_id)""",
}
