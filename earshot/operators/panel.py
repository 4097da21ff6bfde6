"""Call and company-quarter aggregates: the feature panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import keys, text as T
from earshot.operators import risk
from earshot.operators.relational import keep_one
from earshot.storage import stage

SCORES = ["lm_positive_score", "lm_negative_score", "lm_net_score", "lm_uncertainty_score", "vader_compound", "vader_pos", "vader_neg", "vader_neu"]
FINBERT = ["finbert_positive", "finbert_negative", "finbert_neutral"]
MANAGEMENT = ["CEO", "CFO", "COO", "CTO"]
SPEAKS_FOR_COMPANY = "(?i)CEO|CFO|COO|CTO|VP|Director|President"


def number(c: str) -> Column:
    """A double without NaN."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def clean_section(c: str = "section") -> Column:
    s = F.regexp_replace(F.lower(F.col(c)), "[^a-z]+", "")
    return F.when(s.isin("qa", "questionsandanswers"), "qa").when(s.isin("preparedremarks", "prepared"), "prepared_remarks")


def keyed(df: DataFrame) -> DataFrame:
    """Rows under canonical ticker, quarter, section and role."""
    return df.withColumn("ticker", keys.normalize_ticker(F.col("ticker"))).withColumn("quarter", keys.normalize_quarter(F.col("quarter"))).withColumn("section", clean_section()).withColumn(
        "role", F.when(F.length("role") <= 3, F.upper("role")).otherwise(F.initcap("role"))
    )


def first_loads(chunks: DataFrame, key: str = "chunk_id", at: str = "ingested_at") -> DataFrame:
    """One row per chunk: repeated loads have the same content, and the first load stays."""
    return keep_one(chunks, [key], [F.col(at)])


def mean_if(condition: Column, value: str) -> Column:
    return F.avg(F.when(condition, number(value)))


def divergence(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of prepared remarks and of answers, 0 where a part is empty, and their difference."""
    part = lambda s: F.coalesce(mean_if(F.col("section") == s, value), F.lit(0.0))
    return df.groupBy(*by).agg(part("prepared_remarks").alias("prepared"), part("qa").alias("qa")).withColumn("divergence", F.col("prepared") - F.col("qa"))


def sentiment_panel(df: DataFrame, by: list[str] = ["ticker", "quarter"], net: str = "lm_net_score") -> DataFrame:  # noqa: B006
    """Means of the scores, and of the net score by role and section; missing where there is none."""
    return df.groupBy(*by).agg(
        *[F.avg(number(c)).alias(f"mean_{c}") for c in SCORES],
        mean_if(F.col("role").isin(*MANAGEMENT), net).alias("mgmt_sentiment"),
        mean_if(F.col("role") == "Analyst", net).alias("analyst_sentiment"),
        mean_if(F.col("section") == "prepared_remarks", net).alias("prepared_sentiment"),
        mean_if(F.col("section") == "qa", net).alias("qa_sentiment"),
    )


def call_text(df: DataFrame, by: list[str], order: str = "chunk_index", text: str = "text", where: Column | None = None) -> Column:
    """Aggregate: the texts in order, joined by blanks. A call is a few hundred chunks, so the group is bounded by the call."""
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    item = item if where is None else F.when(where, item)
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), " ")


def qa_dynamics(df: DataFrame, by: list[str]) -> DataFrame:
    """Question-and-answer behaviour of a call: shares and lengths of answers, deflection, fillers, passives, pronoun shift and specificity drop.

    Counts are taken per chunk and summed, so no text is gathered; a phrase across
    two chunks isn't counted. Calls without answers get zeros.
    """
    low = F.lower("text")
    mgmt, qa, prep = F.col("role").rlike(SPEAKS_FOR_COMPANY), F.col("section") == "qa", F.col("section") == "prepared_remarks"
    count = lambda p, of=low: F.regexp_count(of, F.lit(p))
    x = df.filter("text is not null").select(
        *by, qa.alias("qa"), prep.alias("prep"), (F.coalesce(mgmt, F.lit(False))).alias("mgmt"), (F.coalesce(F.col("role") == "Analyst", F.lit(False))).alias("asks"), T.word_count(F.col("text")).alias("w"),
        T.contains_any(low, T.DEFLECTIONS).cast("int").alias("d"), T.count_any(low, T.FILLERS).alias("f"), count(T.PASSIVE).alias("p"), T.sentence_count(F.col("text")).alias("s"),
        count(T.FIRST_PERSON).alias("i"), count(T.THIRD_PERSON).alias("t"), F.regexp_count("text", F.lit(T.NUMBER)).alias("n"),
    )
    total = lambda c, *on: F.coalesce(F.sum(F.when(F.reduce(F.array(*on), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False))), F.col(c))), F.lit(0))
    rows = lambda *on: F.coalesce(F.sum(F.when(F.reduce(F.array(*on), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False))), 1)), F.lit(0))
    q, m, a, r = F.col("qa"), F.col("mgmt"), F.col("asks"), F.col("prep")
    g = x.groupBy(*by).agg(
        total("w", q, m).alias("mw"), total("w", q, a).alias("aw"), rows(q, m).alias("mn"), rows(q, a).alias("an"), total("d", q, m).alias("md"), total("f", q, m).alias("mf"), total("p", q, m).alias("mp"), total("s", q, m).alias("ms"),
        total("i", q, m).alias("qi"), total("t", q, m).alias("qt"), total("i", r, m).alias("pi"), total("t", r, m).alias("pt"), rows(r, m).alias("pm"), total("n", q).alias("qn"), total("s", q).alias("qs"), total("n", r).alias("pn"), total("s", r).alias("ps"),
    )
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    g = g.withColumn("qa_avg_answer_length", F.col("mw") / one("mn")).withColumn("qa_avg_question_length", F.col("aw") / one("an"))
    return g.select(
        *by,
        (F.col("mw") / F.greatest(F.col("mw") + F.col("aw"), F.lit(1))).alias("qa_mgmt_word_ratio"),
        "qa_avg_answer_length",
        "qa_avg_question_length",
        (F.col("qa_avg_answer_length") / F.greatest(F.col("qa_avg_question_length"), F.lit(1.0))).alias("qa_answer_question_ratio"),
        F.col("md").alias("qa_deflection_count"),
        (F.col("md") / one("mn")).alias("qa_deflection_rate"),
        (F.col("mf") / one("mw")).alias("qa_filler_rate"),
        (F.col("mp") / one("ms")).alias("qa_passive_rate"),
        F.when(F.col("pm") > 0, F.col("pi") / one("pt") - F.col("qi") / one("qt")).otherwise(0.0).alias("qa_pronoun_shift"),
        F.when(F.col("ps") > 0, F.col("pn") / one("ps") - F.col("qn") / one("qs")).otherwise(0.0).alias("qa_specificity_drop"),
    )


def momentum(df: DataFrame, value: str, key: str = "ticker", order: str = "quarter") -> Column:
    """Change against the key's previous row."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))


def derived_features(df: DataFrame) -> DataFrame:
    """The formulas over a panel row; a missing part of the weighted sentiment counts 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (
        df.withColumn("sentiment_divergence", F.col("prepared_sentiment") - F.col("qa_sentiment"))
        .withColumn("qa_weighted_sentiment", 0.65 * zero("qa_sentiment") + 0.35 * zero("prepared_sentiment"))
        .withColumn("negative_emphasis", 1.5 * F.col("mean_lm_negative_score"))
        .withColumn("neg_pos_ratio", F.col("mean_lm_negative_score") / (F.col("mean_lm_positive_score") + 1e-8))
        .withColumn("uncertainty_adj_sentiment", F.col("mean_lm_net_score") - 0.5 * F.col("mean_lm_uncertainty_score"))
        .withColumn("mgmt_analyst_divergence", F.col("mgmt_sentiment") - F.col("analyst_sentiment"))
    )


def call_features(chunks: DataFrame, by: list[str]) -> DataFrame:
    """``call_*``: readability, forward-looking share and specificity of each call's whole text, as ``functions.text`` has them for one text.

    Chunks are joined by blanks in order of index and id; null texts are left out.
    Everything read more than once is held, and syllables are counted by patterns
    over all words at once (``<word><word>``), not word by word.
    """
    hold = risk._hold
    g = chunks.filter("text is not null").withColumn("_o", F.struct("chunk_index", "chunk_id")).groupBy(*by).agg(call_text(chunks, by, "_o").alias("_t"))
    x = hold(g, _low=F.lower("_t"), _s=F.transform(T.sentences(F.col("_t")), F.lower), _w=T.words(F.col("_t")))
    x = hold(x, _v=F.concat(F.lit("<"), F.regexp_replace(F.concat(F.array_join("_w", "><"), F.lit(">")), "e+>", ">")), _n=F.size("_w"), _ns=F.size("_s"))
    count = lambda p, of="_t": F.regexp_count(of, F.lit(p))
    x = hold(
        x, _syl=count("[aeiou]+", "_v") + count("<[^aeiou>]*>", "_v"), _long=count("<[^aeiou>]*[aeiou]+[^aeiou>]+[aeiou]+[^aeiou>]+[aeiou]", "_v"), _chars=F.length(F.array_join("_w", "")), _kinds=F.size(F.array_distinct("_w")),
        _num=count(T.NUMBER), _usd=count(T.DOLLAR), _pct=count(T.PERCENT), _bps=count(T.BASIS_POINTS), _fls=F.size(F.filter("_s", lambda s: T.contains_any(s, T.FLS_KEYWORDS))),
    )
    n, ns = F.col("_n"), F.col("_ns")
    zero = lambda c: F.when((ns > 0) & (n > 0), c).otherwise(F.lit(0.0))
    some = F.greatest(ns, F.lit(1))
    return x.select(
        *by,
        zero(0.4 * (n / ns + 100 * F.col("_long") / n)).alias("call_fog_index"),
        zero(0.39 * (n / ns) + 11.8 * F.col("_syl") / n - 15.59).alias("call_flesch_kincaid"),
        zero(n / ns).alias("call_avg_sentence_length"),
        zero(F.col("_chars") / n).alias("call_avg_word_length"),
        zero(F.col("_kinds") / n).alias("call_vocab_richness"),
        F.when(ns > 0, F.col("_fls") / ns).otherwise(F.lit(0.0)).alias("call_fls_ratio"),
        F.when(ns > 0, F.size(F.filter(F.array(*map(F.lit, T.FLS_KEYWORDS)), lambda k: F.contains(F.col("_low"), k)))).otherwise(F.lit(0)).alias("call_fls_count"),
        (F.col("_num") / some).alias("call_numbers_per_sentence"),
        F.col("_usd").alias("call_dollar_mentions"),
        (F.col("_pct") + F.col("_bps")).alias("call_percent_mentions"),
        ((F.col("_num") + 2 * F.col("_usd") + 2 * F.col("_pct") + 2 * F.col("_bps")) / some).alias("call_specificity_score"),
    )


def call_risk(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Detections that aren't negated, mean intensity over all chunks (0 for one without detection), and distinct categories of each call."""
    per = risk.rollup(risk.detect(chunks.filter("text is not null")), ["chunk_id", *by])
    found = per.groupBy(*by).agg(F.sum("risk_count").alias("_n"), F.sum("risk_intensity").alias("_i"), F.size(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("_c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return chunks.groupBy(*by).agg(F.count("*").alias("_chunks")).join(found, by, "left").select(*by, zero("_n").alias("total_risk_count"), (zero("_i") / F.col("_chunks")).alias("avg_risk_intensity"), zero("_c").alias("num_risk_categories"))


def feature_panel(chunks: DataFrame, market: DataFrame) -> DataFrame:
    """One row per ticker and quarter: sentiment, risk, text and question-and-answer features, momentum, derived features and market reaction.

    ``market`` has one row per key. Each ``chunk_id`` counts once, as it was
    ingested first. Each part is aggregated on its key before the joins, so all
    share one hash partitioning.
    """
    by = ["ticker", "quarter"]
    x = stage(keyed(first_loads(chunks)).select(*by, "chunk_id", "chunk_index", "role", "section", "text", *SCORES, *FINBERT))
    finbert = x.groupBy(*by).agg(*[F.avg(number(c)).alias(f"mean_{c}") for c in FINBERT], F.max(F.coalesce(F.col("section") == "qa", F.lit(False))).alias("_answers"))
    p = sentiment_panel(x)
    for part in (finbert, call_risk(x, by), call_features(x, by), qa_dynamics(x, by)):
        p = p.join(part, by, "left")
    for c in ("qa_pronoun_shift", "qa_specificity_drop"):  # without answers there is nothing to compare
        p = p.withColumn(c, F.when(F.col("_answers"), F.col(c)).otherwise(0.0))
    for c in ("mean_lm_net_score", "mean_vader_compound"):
        p = p.withColumn(f"{c}_momentum", momentum(p, c))
    p = p.withColumn("risk_delta", momentum(p, "total_risk_count")).drop("_answers")
    p = derived_features(p).withColumn("risk_sentiment_interaction", F.col("mean_lm_net_score") * F.col("total_risk_count"))
    return p.join(market, by, "left")


def select_features(df: DataFrame, prefixes: tuple[str, ...], least: float) -> list[str]:
    """Names of numeric columns with one of the prefixes whose share of present values reaches ``least``."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name.startswith(prefixes)]
    if not names:
        return []
    row = df.agg(F.count("*").alias("_n"), *[F.count(number(c)).alias(c) for c in names]).first()
    return [c for c in names if row["_n"] and row[c] >= least * row["_n"]]


def percentile_rank(df: DataFrame, value: str) -> DataFrame:
    """Adds ``percentile``: the share (in per cent) of rows strictly below each row's value, nulls left out.

    Counts per distinct value are ranged into ordered partitions; each sums its
    own, and the totals of the partitions before it are added, so no task sees all values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranged = stage(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()))
    over = lambda *by: Window.partitionBy(*by).orderBy(value if by else "_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_p").agg(F.sum("_n").alias("_t"))  # one row per partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_t").over(over()), F.lit(0))).withColumn("_all", F.sum("_t").over(Window.partitionBy()))
    below = ranged.join(F.broadcast(parts), "_p").withColumn("_below", F.col("_before") + F.coalesce(F.sum("_n").over(over("_p")), F.lit(0)))
    return df.join(below.select(value, (F.col("_below") * 100.0 / F.col("_all")).alias("percentile")), value)
