"""Risk phrases with negation, severity and context; centroids of embeddings; summaries of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import lexicons
from earshot.functions.text import tokens

WEIGHT = {"high": 3, "medium": 2, "low": 1}


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator, so that the optimizer computes each once a row instead of inlining it wherever it is used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def detect(
    df: DataFrame,
    text: str = "text",
    risks: dict[str, list[str]] = lexicons.RISKS,
    negators: list[str] = lexicons.NEGATORS,
    intensifiers: list[str] = lexicons.INTENSIFIERS,
    diminishers: list[str] = lexicons.DIMINISHERS,
    negation_window: int = 3,
    severity_window: int = 5,
    around: int = 50,
) -> DataFrame:
    """``df`` once per phrase found, with ``category, keyword, at, negated, severity, snippet``; rows without one are gone.

    A phrase may carry s, es, ed or ing and must not touch a letter or digit.
    Phrases are first tried as substrings, so the patterns run only where they can
    match; all offsets come from the pieces between matches, without Python.
    ``at`` counts characters from 0. Windows are taken around the token before the
    phrase. Phrases inside others are found on their own.
    """
    terms = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k.lower()).alias("keyword")) for c, ks in risks.items() for k in ks])
    x = _hold(df, _low=F.lower(text), _w=tokens(F.col(text)))
    x = x.select("*", F.inline(F.filter(terms, lambda t: F.contains(F.col("_low"), t["keyword"]))))
    # The phrase comes first, so that the matcher can skip ahead to it; what must not precede it is looked at afterwards.
    quoted = F.concat(F.lit("\\Q"), F.col("keyword"), F.lit("\\E"))
    pattern = F.concat(quoted, F.lit("(?<![a-z0-9]"), quoted, F.lit(")(?:s|es|ed|ing)?(?![a-z0-9])"))
    x = _hold(x, _m=F.regexp_extract_all("_low", pattern, F.lit(0)), _p=F.split("_low", pattern, -1)).filter(F.size("_m") > 0)
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + F.length(v))
    offset = lambda i: length(F.slice("_p", F.lit(1), i + 1)) + length(F.slice("_m", F.lit(1), i))
    x = x.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size("_m") - 1), offset)).alias("at")).drop("_m", "_p")
    x = _hold(x, _k=F.greatest(F.lit(0), F.regexp_count(F.expr("substring(_low, 1, at)"), F.lit(r"\S+")) - 1))
    first = lambda before: F.greatest(F.lit(0), F.col("_k") - before)
    window = lambda before, after: F.slice("_w", first(before) + 1, F.col("_k") + after - first(before))
    x = _hold(x, _near=window(severity_window, severity_window), negated=F.arrays_overlap(window(negation_window, 0), _array(negators))).drop("_w", "_k")
    x = x.withColumn("severity", F.when(F.arrays_overlap("_near", _array(intensifiers)), "high").when(F.arrays_overlap("_near", _array(diminishers)), "low").otherwise("medium"))
    begin = F.greatest(F.lit(0), F.col("at") - around)
    x = x.withColumn("snippet", F.regexp_replace(F.substring(F.col(text), begin + 1, F.col("at") + F.length("keyword") + around - begin), r"^\s+|\s+$", ""))
    return x.drop("_low", "_near")


def rollup(found: DataFrame, key: list[str]) -> DataFrame:
    """Per key, over detections that aren't negated: sorted categories, count, and intensity (high 3, medium 2, low 1)."""
    kept = found.filter("not negated")
    weight = F.create_map(*[F.lit(v) for kv in WEIGHT.items() for v in kv])[F.col("severity")]
    return kept.groupBy(*key).agg(F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("risk_count"), F.sum(weight).alias("risk_intensity"))


def heatmap(found: DataFrame, row: str, risks: dict[str, list[str]] = lexicons.RISKS) -> DataFrame:
    """Detections per category by ``row``; the columns are the categories of the taxonomy, absent ones 0."""
    return found.filter("not negated").groupBy(row).pivot("category", sorted(risks)).count().fillna(0)


def trends(found: DataFrame, by: list[str], chunks: DataFrame) -> DataFrame:
    """Per key and category: detections and those of high severity, with the key's total and its mean intensity over all of ``chunks``; keys without a detection have no row."""
    weight = F.create_map(*[F.lit(v) for kv in WEIGHT.items() for v in kv])[F.col("severity")]
    n = found.filter("not negated").groupBy(*by, "category").agg(F.count("*").alias("n"), F.sum(F.when(F.col("severity") == "high", 1).otherwise(0)).alias("high"), F.sum(weight).alias("_w"))
    whole = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("_w").alias("_i")).join(chunks.groupBy(*by).agg(F.count("*").alias("_c")), by)
    return n.drop("_w").join(whole.select(*by, "total", (F.col("_i") / F.col("_c")).alias("mean_intensity")), by)


def summary(found: DataFrame, by: list[str], k: int = 5, order: list[str] = ["chunk_id", "at"]) -> DataFrame:  # noqa: B006
    """The k most frequent categories per key with rank, count and the first snippet, and the key's total and detections by severity over all categories."""
    of = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s)
    kept = found.filter("not negated").groupBy(*by, "category").agg(F.count("*").alias("n"), F.min_by("snippet", F.struct(*order, "keyword")).alias("example"), *[of(s) for s in WEIGHT])
    key = Window.partitionBy(*by)  # a row per category
    kept = kept.withColumns({"total": F.sum("n").over(key), **{s: F.sum(s).over(key) for s in WEIGHT}})
    rank = F.row_number().over(key.orderBy(F.desc("n"), "category"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, centroid)``: the mean vector per label. Sums are taken per coordinate before the shuffle."""
    flat = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return flat.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def semantic(df: DataFrame, vector: str, risky: DataFrame, safe: DataFrame, min_sim: float, min_diff: float, id_col: str, anchors: DataFrame | None = None) -> DataFrame:
    """``(id, category, sim, differential)`` of vectors nearer to a category's centroid than to its safe one by more than both thresholds.

    ``risky`` is ``(category, centroid)``, ``safe`` ``(category, safe_centroid)``: one row per category of a fixed taxonomy, so they are sent to every task.
    With ``anchors`` ``(category, anchor, vector)``, the few examples that stand for each category, ``anchor`` is the one
    nearest to the vector (the least anchor among equals, null for a category without any).
    """
    both = risky.join(safe, "category")
    if anchors is not None:
        held = anchors.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("anchor", F.col("vector").alias("v")))).alias("_anchors"))
        both = both.join(held, "category", "left")
    x = df.select(id_col, vector).join(F.broadcast(both))
    x = x.withColumn("sim", cosine(F.col(vector), F.col("centroid"))).withColumn("differential", F.col("sim") - cosine(F.col(vector), F.col("safe_centroid")))
    x = x.filter((F.col("sim") > min_sim) & (F.col("differential") > min_diff))
    if anchors is None:
        return x.select(id_col, "category", "sim", "differential")
    near = F.array_max(F.transform("_anchors", lambda a, i: F.struct(F.round(cosine(F.col(vector), a["v"]), 9).alias("s"), (-i).alias("i"), a["anchor"].alias("anchor"))))
    return x.select(id_col, "category", "sim", "differential", near["anchor"].alias("anchor"))


def merge_semantic(counts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keyword counts by (key, category) with semantic finds: a new category adds 1 detection of weight 2, a known one is only confirmed."""
    j = counts.join(found.select(key, "category", F.lit(True).alias("sem")), [key, "category"], "full_outer")
    new = F.col("n").isNull()
    return j.select(key, "category", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("intensity", F.lit(2)).alias("intensity"), new.alias("is_new"), (~new & F.coalesce("sem", F.lit(False))).alias("is_confirmation"))


def overlap(counts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per category: keys found by phrase, by meaning, by both and by one alone, and the share of meaning alone."""
    j = counts.select(key, "category", F.lit(1).alias("k")).join(found.select(key, "category", F.lit(1).alias("s")), [key, "category"], "full_outer")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    only_s, only_k = F.when(F.col("k").isNull(), 1), F.when(F.col("s").isNull(), 1)
    g = j.groupBy("category").agg(n("k").alias("kw"), n("s").alias("sem"), n(F.col("k") * F.col("s")).alias("both"), n(only_s).alias("sem_only"), n(only_k).alias("kw_only"))
    return g.withColumn("noise", F.when(F.col("sem") > 0, F.col("sem_only") / F.col("sem")).otherwise(0.0))
