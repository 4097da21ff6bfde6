"""Lines that come back call after call within one source: weighted line graphs, their components, and texts without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.names import resolve_companies, with_company
from earshot.llm.split import word_count
from earshot.operators.graph import connected_components
from earshot.storage import bounded_broadcast, stage


def normal_lines(text: Column) -> Column:
    """Array of the normal forms of a text's lines: lower case, blanks collapsed and trimmed, digit runs as ``#``."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[ \t]+", " "), "[0-9]+", "#")
    return F.transform(F.split(flat, "\r?\n"), lambda x: F.trim(x))


def _occurrences(rows: DataFrame, min_words: int) -> DataFrame:
    """One row per long enough line: ``(source, chunk, counted, pos, h1, h2)``; the two hashes name the line."""
    lines = rows.select("source", "chunk", "counted", F.posexplode(normal_lines(F.col("text"))).alias("pos", "line"))
    return lines.filter(F.size(F.split("line", " ")) >= min_words).select("source", "chunk", "counted", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _rows(df: DataFrame, id_col: str, source_col: str, text_col: str, min_text_words: int) -> DataFrame:
    rows = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("chunk"), F.col(text_col).alias("text")).dropna()
    return rows.withColumn("counted", word_count(F.col("text")) >= min_text_words)


def boilerplate(df: DataFrame, id_col: str, source_col: str, text_col: str = "text", min_support: int = 5, min_words: int = 6, min_text_words: int = 60) -> tuple[DataFrame, DataFrame]:
    """``(blocks, occurrences)`` of the lines repeated in at least ``min_support`` different texts of one source.

    ``blocks`` is ``(source, line, support, block)``; ``occurrences`` is ``(source,
    chunk, pos)`` of every kept line in every text, pos counting lines from 0.

    Lines are nodes and consecutive lines edges, weighted by the number of
    different texts (by id, so loads of a text count once). Lines are normalised once
    and only their hashes are kept and counted; edges between neighbours are
    counted among the few lines of enough support, and each such line is read back
    from one text that has it. Components over edges of enough support are the
    blocks; a line without one is a block of its own.

    Only texts of at least ``min_text_words`` words are counted; null texts, ids
    and sources take no part; the count is over (source, line), so a source that
    holds most rows is spread by its lines.
    """
    rows = _rows(df, id_col, source_col, text_col, min_text_words)
    every = stage(_occurrences(rows, min_words))
    keyed = every.filter("counted").select("source", "h1", "h2", F.xxhash64("chunk").alias("c")).distinct()
    nodes = keyed.groupBy("source", "h1", "h2").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    nodes = stage(nodes.withColumn("node", F.xxhash64("source", "h1", "h2")))
    found = every.join(bounded_broadcast(nodes), ["source", "h1", "h2"])
    found = stage(found.select("source", "chunk", "counted", "pos", "node", "support").distinct())

    after = Window.partitionBy("source", "chunk").orderBy("pos")
    step = found.filter("counted").withColumn("to", F.lead("node").over(after)).withColumn("next", F.lead("pos").over(after))
    edges = step.filter("next = pos + 1").select("node", "to", "chunk").distinct().groupBy("node", "to").agg(F.count("*").alias("weight"))
    parts = connected_components(edges.filter(F.col("weight") >= min_support), "node", "to")
    seen = found.groupBy("source", "node").agg(F.min(F.struct("chunk", "pos")).alias("at"), F.first("support").alias("support"))
    seen = stage(seen.select("source", "node", "support", F.col("at.chunk").alias("chunk"), F.col("at.pos").alias("pos")))
    shown = rows.select("source", "chunk", "text").join(bounded_broadcast(seen), ["source", "chunk"])
    line = F.get(normal_lines(F.col("text")), F.col("pos"))  # of several texts under one id, the one with that line
    shown = shown.select("source", "node", "support", line.alias("line")).filter(F.xxhash64("source", F.xxhash64("line"), F.hash("line")) == F.col("node"))
    lines = shown.groupBy("source", "node").agg(F.min("line").alias("line"), F.first("support").alias("support"))
    blocks = lines.join(parts, "node", "left").select("source", "line", "support", F.coalesce("component", "node").alias("block"))
    return blocks, found.select("source", "chunk", "pos").distinct()


def without_lines(df: DataFrame, occurrences: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``df`` without the lines at ``occurrences``, their line ends included; rows without one stay as they are."""
    gone = occurrences.groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_set("pos").alias("_gone"))
    joined = df.join(bounded_broadcast(stage(gone)), df[id_col] == F.col("_chunk"), "left")
    kept = F.filter(F.split(F.col(text_col), "(?<=\n)"), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))).drop("_chunk", "_gone")


def company_boilerplate(df: DataFrame, companies: DataFrame, id_col: str = "chunk_id", ticker_col: str = "ticker", text_col: str = "text", **limits: int) -> tuple[DataFrame, DataFrame]:
    """``boilerplate`` within each company over all spellings of its ticker."""
    mapping = stage(resolve_companies(df, companies, ticker_col))
    known = with_company(df.select(F.col(id_col).alias("chunk_id"), F.col(ticker_col).alias("ticker"), F.col(text_col).alias("text")), mapping)
    return boilerplate(known, "chunk_id", "company", "text", **limits)
