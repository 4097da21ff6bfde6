"""Sparse, dense and fused search over all rows, and what surrounds it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import contains_any, let, tokens
from earshot.storage import bounded_broadcast

#: Sub-queries added by the first rule that fits. Fixed values, in order of precedence.
EXPANSIONS = (
    (r"\bhow did (they|the company|it) do\b", ["revenue growth earnings", "guidance outlook"]),
    (r"\bperformance\b", ["revenue earnings growth margins"]),
    (r"\boutlook|guidance|forecast\b", ["expect anticipate next quarter year guidance"]),
    (r"\brisk|concern|worry\b", ["challenge headwind risk pressure decline"]),
    (r"\bstrategy|plan|initiative\b", ["invest growth strategy plan initiative opportunity"]),
    (r"\bcompetition|competitive\b", ["market share competitive advantage differentiation"]),
)


def index_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(postings, lengths)``: ``(id, term, tf)`` and ``(id, dl)`` of all documents with a text."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return rows.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")), rows.select("id", F.size("t").alias("dl"))


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """``(query, id, score, rank)``: the k best documents of each query ``(query, text)`` with a score above 0, ties by id.

    A term more common than not weighs ``floor`` times the mean idf; repeated query
    terms count again. Only postings of query terms meet the queries, and each
    query keeps k rows.
    """
    n = lengths.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.ln(F.col("N") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # one row of totals
    mean = raw.agg(F.avg("raw").alias("mean"))
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("q"))
    idf = raw.join(asked.select("term").distinct(), "term", "left_semi").join(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")))
    hit = postings.join(idf.select("term", "idf", "avgdl"), "term").join(lengths, "id").join(asked, "term")
    part = F.col("q") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return top(hit.groupBy("query", "id").agg(F.sum(part).alias("score")).filter("score > 0"), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, rounded to 9 places, then id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = 2_000) -> DataFrame:
    """``(query, id, score, rank)``: the k rows of greatest inner product with each query vector, exactly.

    Queries ``(query, vector)`` go to the tasks in blocks of ``block``; each batch of
    rows is one matrix product and keeps k rows per query, so what is shuffled is
    k rows per query and batch, not the product.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).dropna()

    def scan(part: list[tuple[int, list[float]]]) -> DataFrame:
        ids, matrix = np.array([p[0] for p in part], dtype=np.int64), np.array([p[1] for p in part], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.stack([np.asarray(x, dtype=np.float64) for x in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, matrix.shape[1]))
                key = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
                score = np.round(matrix @ own.T, 9)
                at = np.stack([np.lexsort((key, -s))[:k] for s in score]) if len(key) else np.zeros((len(ids), 0), int)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, at.shape[1])), pa.array(key[at].ravel()), pa.array(np.take_along_axis(score, at, 1).ravel())], names=["query", "id", "score"])

        return rows.mapInArrow(run, "query bigint, id bigint, score double")

    out, part = None, []
    for r in queries.select("query", "vector").dropna().toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            out, part = (scan(part) if out is None else out.unionByName(scan(part))), []
    if part:
        out = scan(part) if out is None else out.unionByName(scan(part))
    return top(out if out is not None else rows.sparkSession.createDataFrame([], "query bigint, id bigint, score double"), k)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 10, wd: float = 0.6, ws: float = 0.4, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (ranks from 1), dense hits first among ties."""
    d = dense_hits.select("query", "id", F.col("rank").alias("rd"))
    s = sparse_hits.select("query", "id", F.col("rank").alias("rs"))
    j = d.join(s, ["query", "id"], "full_outer")
    score = F.coalesce(wd / (c + F.col("rd")), F.lit(0.0)) + F.coalesce(ws / (c + F.col("rs")), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("rd"), "rs", "id"))
    return j.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "id", "score", "rank")


def filter_hits(hits: DataFrame, meta: DataFrame, id_col: str, allowed: dict[str, list]) -> DataFrame:
    """Hits whose metadata is among the allowed values; a missing value passes. Applied after ranking, so fewer may remain."""
    m = meta.select(F.col(id_col).alias("id"), *allowed)
    out = hits.join(m, "id", "left")
    for c, values in allowed.items():
        out = out.filter(F.col(c).isNull() | F.col(c).isin(values))
    return out.drop(*allowed)


def expand(query: Column) -> Column:
    """The query and the sub-queries of the first rule that fits it."""
    low, out = F.lower(query), None
    for pattern, more in EXPANSIONS:
        add = F.array(query, *map(F.lit, more))
        out = F.when(low.rlike(pattern), add) if out is None else out.when(low.rlike(pattern), add)
    return out.otherwise(F.array(query))


def within_budget(df: DataFrame, by: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose costs add up to at most the budget."""
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", cost).withColumn("used", F.sum("_c").over(over)).filter(F.col("used") <= budget).drop("_c")


def evaluate(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(query, recall, rr)``: share of a query's true ids among its first k hits, and 1 / rank of the first true one."""
    good = hits.filter(F.col("rank") <= k).join(truth, ["query", "id"]).groupBy("query").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    n = truth.groupBy("query").agg(F.count("*").alias("n"))
    return n.join(good, "query", "left").select("query", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def evaluate_keywords(hits: DataFrame, asked: DataFrame, ks: tuple[int, ...] = (3, 5, 10), top_k: int = 5) -> DataFrame:
    """One row per query: keyword recall at each k, reciprocal rank of the first hit with a keyword, accuracies of the first ``top_k`` hits and the keyword hit rate.

    ``hits`` is ``(query, rank, text, ticker, section, role)``, ``asked`` ``(query,
    keywords, tickers, sections, roles)`` with arrays of what is expected. Keywords
    are looked for as substrings in any case. Without expected keywords recall, rank
    and hit rate are 1, without expected tickers their accuracy is 1; the accuracies
    of sections and roles are then null, as are all accuracies of a query without hits.
    """
    word = asked.select("query", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("kw"))
    first = hits.filter(F.col("rank") <= max(ks)).select("query", "rank", F.lower("text").alias("t")).join(word, "query").filter(F.contains("t", F.col("kw"))).groupBy("query", "kw").agg(F.min("rank").alias("at"))
    found = first.groupBy("query").agg(*[F.sum((F.col("at") <= k).cast("int")).alias(f"f{k}") for k in ks], F.min("at").alias("best"))
    near = hits.filter(F.col("rank") <= top_k).join(asked.select("query", "tickers", "sections", "roles"), "query")
    share = lambda c, of: F.avg(F.array_contains(of, F.col(c)).cast("int"))
    right = near.groupBy("query").agg(*[share(c, f"{c}s").alias(f"{c}_accuracy") for c in ("ticker", "section", "role")])
    x = asked.join(found, "query", "left").join(right, "query", "left")
    none = F.size(F.coalesce("keywords", F.array().cast("array<string>"))) == 0
    n = F.size(F.array_distinct(F.transform("keywords", F.lower)))
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    rate = lambda k: F.when(none, 1.0).otherwise(F.coalesce(F.col(f"f{k}"), F.lit(0)) / n)
    return x.select(
        "query", *[rate(k).alias(f"recall_{k}") for k in ks], F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("rr"), rate(max(ks)).alias("keyword_hit_rate"),
        F.when(~some("tickers"), 1.0).otherwise(F.col("ticker_accuracy")).alias("ticker_accuracy"), F.when(some("sections"), F.col("section_accuracy")).alias("section_accuracy"), F.when(some("roles"), F.col("role_accuracy")).alias("role_accuracy"),
    )


def metric_summary(rows: DataFrame, key: str = "query") -> DataFrame:
    """``(metric, mean, sd, n)`` of every other column: means and population deviations over the queries that have a value."""
    names = [c for c in rows.columns if c != key]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))


#: What an answer says that found nothing. They must equal those of the measures reproduced here.
HEDGES = ["context doesn't", "not enough information", "no relevant", "cannot determine", "not mentioned"]


def answer_measures(answers: DataFrame) -> DataFrame:
    """Measures of each answer ``(query, answer, keywords, sources, queries_used)``, ``sources`` an array of ``(speaker, section)``; a null answer is one that failed and has nulls."""
    low = F.lower("answer")
    n = F.size(F.coalesce("keywords", F.array().cast("array<string>")))
    covered = F.size(F.filter("keywords", lambda k: F.contains(low, F.lower(k))))
    ok = F.col("answer").isNotNull()
    cites = F.regexp_count("answer", F.lit(r"\[\d+\]"))
    part = lambda c: F.size(F.array_distinct(F.transform("sources", lambda s: F.coalesce(s[c], F.lit("")))))
    return answers.select(
        "query", F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != "")).alias("length_words"), cites.alias("citations"), (cites > 0).cast("int").alias("has_citations"), contains_any(low, HEDGES).cast("int").alias("hedged"),
        F.when(ok, F.when(n == 0, 1.0).otherwise(covered / n)).alias("keyword_coverage"), F.when(ok, F.size("sources")).alias("n_sources"), F.when(ok, part("speaker")).alias("unique_speakers"), F.when(ok, part("section")).alias("unique_sections"),
        F.when(ok, (F.col("queries_used") > 1).cast("int")).alias("expanded"),
    )


def answer_summary(measures: DataFrame) -> DataFrame:
    """One row: questions, answers that succeeded, and the means of eight measures over these."""
    mean = lambda c, a: F.avg(c).alias(a)
    return measures.agg(
        F.count("*").alias("n_questions"), F.count("keyword_coverage").alias("n_successful"), mean("length_words", "avg_answer_length"), mean("citations", "avg_citations"), mean("has_citations", "citation_rate"), mean("keyword_coverage", "avg_keyword_coverage"),
        mean("hedged", "hedge_rate"), mean("expanded", "query_expansion_rate"), mean("n_sources", "avg_sources"), mean("unique_speakers", "avg_unique_speakers"),
    )


def islands(df: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adds ``island``: the number of each run of rows, in order, with equal ``same`` columns."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_n", (changed | (F.row_number().over(w) == 1)).cast("int")).withColumn("island", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def turn_chunks(df: DataFrame, by: list[str], order: list[str], same: list[str], text: str, limit: int = 2_000) -> DataFrame:
    """Texts of each island packed greedily into pieces of at most ``limit`` characters: ``(by, island, piece_no, text)``. A longer single text is a piece of its own."""
    rows = islands(df.filter(F.col(text).isNotNull()), by, order, same)
    held = rows.groupBy(*by, "island").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t_")))), lambda s: s["t_"]).alias("ts"))
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    join = lambda a, t: F.when(a["cur"] == "", t).otherwise(F.concat(a["cur"], F.lit(" "), t))
    step = lambda a, t: F.when((a["cur"] != "") & (F.length(a["cur"]) + 1 + F.length(t) > limit), F.struct(t.alias("cur"), F.array_append(a["out"], a["cur"]).alias("out"))).otherwise(F.struct(join(a, t).alias("cur"), a["out"].alias("out")))
    packed = F.aggregate("ts", zero, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.array_append(a["out"], a["cur"])))
    return held.select(*by, "island", F.posexplode(packed).alias("piece_no", text))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` scaled to length 1; a vector of zeros stays, null ones are left out."""
    length = F.sqrt(F.aggregate(F.col(vector_col), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    scaled = let(length, lambda n: F.transform(F.col(vector_col), lambda v: F.when(n > 0, v.cast("double") / n).otherwise(0.0)))
    return vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), scaled.alias("vector"))


def save_index(postings: DataFrame, lengths: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Postings by term, lengths, and unit vectors if given, as tables below the path."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def load_vectors(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def rerank(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Hits in the order of another score, the earlier rank breaking ties; ``scorer`` is any column, for instance of an Arrow UDF around a model."""
    again = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_s"), "_r"))
    return hits.withColumnRenamed("rank", "_r").withColumn("_s", scorer).withColumn("rank", again).filter(F.col("rank") <= k).drop("_s", "_r")


def first_of_queries(parts: list[DataFrame], k: int) -> DataFrame:
    """Hits of several sub-queries of one query: each id once, as the earliest sub-query found it."""
    both = None
    for i, p in enumerate(parts):
        one = p.withColumn("_q", F.lit(i))
        both = one if both is None else both.unionByName(one)
    once = F.row_number().over(Window.partitionBy("query", "id").orderBy("_q", "rank"))
    kept = both.withColumn("_n", once).filter("_n = 1")
    again = F.row_number().over(Window.partitionBy("query").orderBy("_q", "rank", "id"))
    return kept.withColumn("rank", again).filter(F.col("rank") <= k).drop("_n", "_q")


def numbered_context(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Texts of a group as numbered blocks with rules between them."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(blocks, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["t"])), "\n---\n").alias("context"))


def lookup(hits: DataFrame, docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Hits with columns of their documents; the few hits are sent to the documents if counted small."""
    return docs.select(F.col(id_col).alias("id"), *columns).join(bounded_broadcast(hits), "id")


def answer(question: str, hits: DataFrame, complete, history: list[tuple[str, str]] = (), budget: int = 3_000) -> dict:
    """The answer to one question from its ranked hits ``(rank, text, ...)``.

    The hits within the word budget are numbered into a prompt, ``complete(prompt,
    history)`` (any language model; the last four turns are passed) gives the text,
    and the sources it cites by number are returned with it. Without hits a fixed
    text is returned; an error of the model becomes the text. At most ``budget``
    rows reach the driver, since every hit has at least a word.
    """
    from earshot.functions.text import word_count

    kept = within_budget(hits.withColumn("_g", F.lit(1)), ["_g"], ["rank"], F.greatest(word_count(F.col("text")), F.lit(1)), budget).drop("_g", "used").orderBy("rank").collect()
    sources = [r.asDict() for r in kept]
    if not sources:
        return {"answer": "No relevant passages were found.", "sources": [], "cited_sources": []}
    context = "\n---\n".join(f"[{i}] {s['text']}" for i, s in enumerate(sources, 1))
    try:
        text = complete(f"{context}\n\nQuestion: {question}", list(history)[-4:])
    except Exception as e:
        text = f"Error: {e}"
    import re

    cited = sorted({int(n) for n in re.findall(r"\[(\d+)\]", text)})
    return {"answer": text, "sources": sources, "cited_sources": [sources[n - 1] for n in cited if 1 <= n <= len(sources)]}
