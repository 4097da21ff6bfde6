"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.llm import boilerplate, canonical, leakage, mixture, names, neardup, pii, split, splits, turns
from earshot.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_oversized(table(spark, sf_dir, "chunks_with_sentiment"))
    return pieces.filter("piece_no = 2").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "chunks_with_sentiment"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_spellings(table(spark, sf_dir, "chunks_with_sentiment"), table(spark, sf_dir, "companies"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct spelling with what it means; a ticker that means no company has nulls."""
    return names.spelling_groups(table(spark, sf_dir, "chunks_with_sentiment"), table(spark, sf_dir, "companies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "chunks_with_sentiment")).select("chunk_id", "turn_no", "speaker").distinct()


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "chunks_with_sentiment")).dropDuplicates(["chunk_id", "turn_no"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _ = boilerplate.company_boilerplate(table(spark, sf_dir, "chunks_with_sentiment"), table(spark, sf_dir, "companies"))
    return blocks.select(F.col("source").alias("ticker"), "line")


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.company_boilerplate(table(spark, sf_dir, "chunks_with_sentiment"), table(spark, sf_dir, "companies"))[0]


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks_with_sentiment")
    _, gone = boilerplate.company_boilerplate(chunks, table(spark, sf_dir, "companies"))
    return boilerplate.without_lines(chunks.select("chunk_id", "ticker", "text"), gone, "chunk_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.company_splits(table(spark, sf_dir, "feature_matrix"), table(spark, sf_dir, "companies"), table(spark, sf_dir, "split_targets"))
    return rows.select("ticker", "quarter", "company", "earnings_date", "abnormal_ret_1d", "split")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, companies, share against its target, and mean outcome of each split."""
    rows = p5_splits(spark, sf_dir)
    y = F.nanvl("abnormal_ret_1d", F.lit(None).cast("double"))
    got = rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("company").alias("companies"), F.avg(y).alias("mean_ret"), F.stddev(y).alias("sd_ret"))
    want = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    return want.join(got, "split", "left").withColumn("reached_share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split by two keys at once: those of one call, and those with one text under other ids, stay together."""
    docs = table(spark, sf_dir, "documents")
    call = F.when(F.col("ticker").isNotNull() & F.col("quarter").isNotNull(), F.concat_ws(" ", F.upper(F.trim("ticker")), F.upper(F.regexp_replace("quarter", "[ -]", ""))))
    keyed = docs.select("doc_id", call.alias("call"), F.when(F.length(F.trim("text")) > 0, F.sha2("text", 256)).alias("copy"))
    return splits.grouped_splits(keyed, ["call", "copy"], table(spark, sf_dir, "split_targets")).select("doc_id", "call", "copy", "component", "split")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.duplicate_pairs(*neardup.near_duplicates(table(spark, sf_dir, "chunks_with_sentiment")))
    return pairs.withColumnsRenamed({"id_a": "chunk_id_a", "id_b": "chunk_id_b"})


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(*neardup.near_duplicates(table(spark, sf_dir, "chunks_with_sentiment"))).withColumnRenamed("id", "chunk_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.match_canonical(table(spark, sf_dir, "chunks_with_sentiment"), table(spark, sf_dir, "canonical_titles"))
    return found.select(F.col("value").alias("title"), F.col("ref_id").alias("title_id"))


def p7_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct title with its entry, and how often its rows carry each role against the entry's role."""
    chunks, reference = table(spark, sf_dir, "chunks_with_sentiment"), table(spark, sf_dir, "canonical_titles")
    found = canonical.match_canonical(chunks, reference).filter("ref_id > 0")
    entry = reference.select(F.col("title_id").alias("ref_id"), F.col("role").alias("right_role"))
    seen = chunks.groupBy("title", "role").agg(F.count("*").alias("n_rows"))
    return seen.join(found, seen.title == found.value).join(entry, "ref_id").select("title", "role", "right_role", F.col("ref_id").alias("title_id"), "n_rows")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=0)
    return regions.filter("run_words >= 12").select("doc_id", "item_id").distinct()


def p8_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixture.mix_margins(mixture.mixture_cells(docs, targets), *mixture.mix_sources(docs, targets))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_details(table(spark, sf_dir, "documents")).select("doc_id", "kind", "value").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            SELECT DISTINCT chunk_id FROM chunks_with_sentiment
            WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 400""",
    }
