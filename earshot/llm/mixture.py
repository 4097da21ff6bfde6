"""Mixing sources to target shares: raking of token weights, then calibrated sampling with capped repeats."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.storage import stage

#: Where the vocabulary files of public tokenizers lie on every machine, unless a path is given; the file goes with the job like any input.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Share of all tokens a language or topic needs to be a cell of its own; the rest share one, so there are at most 100 of each.
CELL_SHARE = 0.01
#: Topics by words of a title, for documents that come without a topic; the first that fits counts.
TOPICS = {"results": "result|quarter|earnings|recap|summary", "outlook": "outlook|guidance|forecast|view|preview", "calls": "call|conference|transcript|webcast|q&a", "notes": "note|comment|update|brief"}


def token_counts(df: DataFrame, text_col: str = "text", out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of its texts by a byte-level BPE vocabulary file (null counts 0).

    ``tokenizer`` is the path of a ``.tiktoken`` file of ranks; texts are encoded
    whole, with the text of special tokens taken as ordinary text.
    """
    path = tokenizer or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            n = [len(code.encode_ordinary(t)) if t else 0 for t in text]
            keep = [i for i, f in enumerate(batch.schema) if f.name != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(n, pa.int64())], names=[*(batch.schema.field(i).name for i in keep), out])

    rest = [f for f in df.schema if f.name not in (text_col, out)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.select(*[f.name for f in rest], text_col).mapInArrow(run, f"{fields}, {out} bigint")


def topic_of(title: Column) -> Column:
    t = F.lower(title)
    out = F.lit("other")
    for name, words in reversed(list(TOPICS.items())):
        out = F.when(t.rlike(words), name).otherwise(out)
    return out


def rake(tokens: np.ndarray, shares: np.ndarray, caps: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Expected repeats of each (source, language, topic) cell.

    Iterative proportional fitting: the weights of all cells are scaled in turn to
    the target share of each source and to the corpus's own share of each
    language and topic, and held under their source's cap; sources come last in
    each round, so that their shares are met exactly wherever their tokens
    suffice. The total is the largest at which every source can fill its share
    within its cap; a source without tokens is left out and the rest scaled up.
    Where caps bind, the margins of language and topic are met as nearly as they
    allow (``mix_margins`` reports them); a warning tells if the rounds end before the
    weights settle.
    """
    have = tokens.sum((1, 2))
    live = (have > 0) & (shares > 0)
    if not live.any():
        return np.zeros_like(tokens)
    goal = np.where(live, shares, 0.0) / shares[live].sum()
    total = (have[live] * caps[live] / goal[live]).min()
    margin = tokens[live].sum(0) / tokens[live].sum()
    lang, topic = margin.sum(1), margin.sum(0)
    w = np.where((tokens > 0) & live[:, None, None], 1.0, 0.0)
    top = caps[:, None, None] * np.ones_like(w)
    for _ in range(rounds):
        before = w.copy()
        for axes, want in (((0, 2), lang), ((0, 1), topic)):
            now = (w * tokens).sum(axes)
            f = np.divide(want * total, now, out=np.ones_like(now), where=now > 0)
            w = np.minimum(w * (f[None, :, None] if axes == (0, 2) else f[None, None, :]), top)
        for _ in range(50):  # what a cap takes from a cell goes to the source's other cells
            now = (w * tokens).sum((1, 2))
            free = np.where(w < top - 1e-12, w * tokens, 0.0).sum((1, 2))
            lack = goal * total - now
            f = np.where(lack <= 0, np.divide(goal * total, now, out=np.zeros_like(now), where=now > 0), 1.0)
            up = np.where((lack > 0) & (free > 0), 1.0 + np.divide(lack, free, out=np.zeros_like(now), where=free > 0), 1.0)
            w = np.minimum(np.where(w < top - 1e-12, w * up[:, None, None], w) * np.where(lack <= 0, f, 1.0)[:, None, None], top)
            if np.abs(goal * total - (w * tokens).sum((1, 2))).max() <= 1e-9 * total:
                break
        if np.abs(w - before).max() < tol:
            break
    else:
        warnings.warn(f"weights still move by {np.abs(w - before).max():.2g} after {rounds} rounds; caps keep some margins from being met", stacklevel=2)
    return w


def mixture_cells(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", title_col: str = "title", topic_col: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """``(id, source, lang, topic, n_tokens)`` of the documents that can take part in a mixture: those with an id, tokens and a source among the targets."""
    names = [r[0] for r in targets.select("source").dropna().distinct().collect()]  # the list of sources
    topic = topic_of(F.coalesce(F.col(title_col), F.lit(""))) if topic_col is None else F.col(topic_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("other")).alias("lang"), F.coalesce(topic, F.lit("other")).alias("topic"), F.col(text_col).alias("_text"))
    rows = rows.dropna(subset=["id", "source", "_text"]).filter(F.col("source").isin(names))
    counted = stage(token_counts(rows, "_text", tokenizer=tokenizer).filter("n_tokens > 0"))
    for c in ("lang", "topic"):
        share = counted.groupBy(c).agg(F.sum("n_tokens").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
        big = sorted(r[c] for r in share.filter(F.col("share") >= CELL_SHARE).collect() if r[c] != "other")  # at most 1 / CELL_SHARE
        counted = counted.withColumn(c, F.when(F.col(c).isin(big), F.col(c)).otherwise("other"))
    return counted


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", title_col: str = "title", topic_col: str | None = None, tokenizer: str | None = None, seed: int = 11, per_bucket: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """``(records, shares)``: which documents the mixture holds, how often, and what shares that reaches.

    ``records`` is ``(id_col, source, lang, topic, n_tokens, weight, repeats)`` with
    repeats of at least 1; ``shares`` has one row per target: its share, cap,
    tokens available, tokens used, share reached, mean repeats.

    Tokens are summed per cell of source, language and topic (``topic_col``, or by the
    title's words), a table bounded by the targets and ``CELL_SHARE``, which is raked
    on the driver.
    A document is then taken floor(weight) times, and once more where the running
    sum of the remainders of its bucket, sorted by cell and size, passes a whole
    number: systematic sampling, so each bucket meets its expectation to
    within one document. Buckets hold about ``per_bucket`` documents, so a source
    with most rows is spread over many tasks.

    Documents without a target's source, id or text take no part, nor do sources
    that only the targets name (their share is 0 and the rest is scaled up, which
    ``shares`` shows). Empty texts have no tokens and are left out. Of a repeated
    id each row counts. A missing language or title is a cell of its own.
    """
    goal = targets.select(F.col("source").alias("t"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).dropna()
    goals = goal.groupBy("t").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).orderBy("t").collect()
    names = [r["t"] for r in goals]
    counted = mixture_cells(docs, targets, id_col, text_col, source_col, lang_col, title_col, topic_col, tokenizer)
    cells = counted.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()

    langs, topics = ([*sorted({c[x] for c in cells} - {"other"}), "other"] for x in ("lang", "topic"))
    tokens = np.zeros((len(names), len(langs), len(topics)))
    size = dict.fromkeys(names, 0)
    for c in cells:
        tokens[names.index(c["source"]), langs.index(c["lang"]), topics.index(c["topic"])] += c["tokens"]
        size[c["source"]] += c["docs"]
    w = rake(tokens, np.array([r["share"] for r in goals]), np.array([float(r["cap"]) for r in goals]))
    spark = docs.sparkSession
    plan = [(names[i], langs[j], topics[k], float(w[i, j, k]), int(-(-size[names[i]] // per_bucket)), int(goals[i]["cap"])) for i, j, k in zip(*np.nonzero(w))]
    plan_df = spark.createDataFrame(plan or [("", "", "", 0.0, 1, 0)], "source string, lang string, topic string, weight double, buckets int, cap int")

    near = counted.join(F.broadcast(plan_df), ["source", "lang", "topic"]).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    near = near.withColumn("rest", F.col("weight") - F.floor("weight")).withColumn("bucket", F.pmod(F.shiftright("h", 17), F.col("buckets")))
    # Sorted by cell and size, the sample meets the tokens of each cell as well as its documents.
    order = Window.partitionBy("source", "bucket").orderBy("lang", "topic", "n_tokens", "h", "id")
    start = F.abs(F.hash(F.lit(seed), "source", "bucket")) % 1000 / 1000.0
    run = F.sum("rest").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = near.withColumn("run", run).withColumn("hi", F.floor(F.col("run") + start)).withColumn("lo", F.floor(F.col("run") - F.col("rest") + start))
    more = F.when(F.col("hi") > F.col("lo"), 1).otherwise(0)
    taken = passed.withColumn("repeats", F.least(F.floor("weight").cast("int") + more, F.col("cap"))).filter("repeats > 0")
    records = stage(taken.select(F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), "repeats"))

    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    used = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    shares = goal.select(F.col("t").alias("source"), F.col("share").alias("target_share"), F.col("cap").alias("max_repeats")).join(have, "source", "left").join(used, "source", "left")
    shares = shares.fillna(0, ["available_tokens", "documents", "used_tokens", "most_repeats"])
    return records, shares.withColumn("reached_share", F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy()))


def mix_margins(docs: DataFrame, records: DataFrame, shares: DataFrame) -> DataFrame:
    """``(axis, value, wanted, reached)``: shares of the languages and topics of a mixture, against those of the corpus within the sources that take part.

    ``docs`` are the counted documents ``(source, lang, topic, n_tokens)``; ``records`` and
    ``shares`` those of ``mix_sources``.
    """
    live = shares.filter("documents > 0 and target_share > 0").select("source")
    out = None
    for axis in ("lang", "topic"):
        share = lambda df, n: df.groupBy(F.col(axis).alias("value")).agg(F.sum(n).alias("n")).withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy()))  # noqa: B023, E731
        want = share(docs.join(F.broadcast(live), "source"), F.col("n_tokens")).select("value", F.col("s").alias("wanted"))
        have = share(records, F.col("n_tokens") * F.col("repeats")).select("value", F.col("s").alias("reached"))
        one = want.join(have, "value", "left").select(F.lit(axis).alias("axis"), "value", "wanted", F.coalesce("reached", F.lit(0.0)).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out
