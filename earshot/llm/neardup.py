"""Near-duplicate texts: an inverted join over the coordinates of a signature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.wordhash import BASE, alnum_table, mix, shingle_hashes, slices, word_hashes
from earshot.operators.graph import connected_components
from earshot.storage import bounded_broadcast, stage

#: Coordinates of a signature, minima in a coordinate, and coordinates in which a pair must agree.
COORDINATES, ROWS, MATCHES = 48, 4, 2
#: Postings of one coordinate value that one task may pair; a more common value is cut into blocks, and the pairs of its blocks are spread.
BLOCK = 2_000


def _signatures(shingles: np.ndarray, first: np.ndarray, seed: int = 7) -> np.ndarray:
    """COORDINATES 64-bit values a text: each combines ROWS minima of its own, so coordinates are independent. At similarity s a coordinate agrees with probability s ** ROWS."""
    rng = np.random.default_rng(seed)
    n_min = COORDINATES * ROWS
    a = rng.integers(0, 2**31, n_min, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, n_min, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    minima = np.empty((n_min, len(first) - 1), dtype=np.uint64)
    for k in range(n_min):
        y = x * a[k] + b[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        minima[k] = np.minimum.reduceat(y, first[:-1])
    out = np.empty((len(first) - 1, COORDINATES), dtype=np.uint64)
    for k, group in enumerate(np.arange(n_min).reshape(COORDINATES, ROWS)):
        value = np.full(len(first) - 1, np.uint64(k + 1))
        for g in group:
            value = mix(value * np.uint64(BASE) + minima[g])
        out[:, k] = value
    return out


def _sign(df: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """``(id, copy, signature)`` of each text of enough words, 32 bits a coordinate; ``copy`` is a 128-bit digest of its word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = alnum_table()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                words, first = word_hashes(texts[lo:hi], table)
                keep = np.flatnonzero(np.diff(first) >= max(min_words, shingle))
                if not len(keep):
                    continue
                count = np.diff(first)[keep]
                begin = np.concatenate([[0], np.cumsum(count)])
                words = words[np.repeat(first[:-1][keep], count) + np.arange(begin[-1]) - np.repeat(begin[:-1], count)]
                rank = (np.arange(begin[-1]) - np.repeat(begin[:-1], count)).astype(np.uint64)
                copies = [np.add.reduceat(mix(words * np.uint64(BASE) + rank * np.uint64(m)), begin[:-1]) for m in (3, 5)]
                signature = _signatures(*shingle_hashes(words, begin, shingle))
                digest = np.stack(copies, 1).astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep + lo)),
                        pa.array([digest[16 * i : 16 * i + 16] for i in range(len(keep))], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array((signature >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()), COORDINATES).cast(pa.list_(pa.int32())),
                    ],
                    names=["id", "copy", "signature"],
                )

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, copy binary, signature array<int>")


def _similarity(pairs: DataFrame, shingle: int) -> DataFrame:
    """Adds the exact Jaccard similarity of the shingle sets of ``text_a`` and ``text_b``, in place of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = alnum_table()
        for batch in batches:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for lo, hi in slices([x + y for x, y in zip(ta, tb)], 500_000):
                sets = []
                for t in (ta[lo:hi], tb[lo:hi]):
                    s, f = shingle_hashes(*word_hashes(t, table), shingle)
                    sets.append([np.unique(s[f[i] : f[i + 1]]) for i in range(hi - lo)])
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double")


def _collisions(classes: DataFrame, block: int) -> DataFrame:
    """``(a, b)``, a < b, of the classes whose signatures agree in at least MATCHES coordinates.

    Every class is posted under its coordinate-value pairs; values nobody shares are
    dropped after counting (with map-side combining, so a value that many share is
    no burden). The MATCHES - 1 most common values of a class are its skipped lists: a
    pair that agrees in MATCHES coordinates agrees in one that isn't skipped by both.
    So lists are merged but for skipped against skipped, collisions are counted per
    pair, and those values are added that both skip. A value with more than
    ``block`` postings is dealt into blocks whose pairs are separate groups, so
    neither a task nor a key ever holds it whole.
    """
    posted = classes.select("class", F.posexplode("signature").alias("k", "v")).select("class", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("element"))
    common = posted.groupBy("element").agg(F.count("*").alias("df")).filter("df > 1")
    shared = posted.join(common, "element")
    held = shared.groupBy("class").agg(F.collect_list(F.struct("df", "element")).alias("e"))  # at most COORDINATES
    skip = F.slice(F.reverse(F.array_sort("e")), 1, MATCHES - 1)["element"]
    lists = stage(held.withColumn("skip", skip).select("class", "skip", F.inline("e")).withColumn("skipped", F.array_contains("skip", F.col("element"))))
    blocks = F.ceil(F.col("df") / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks.cast("long")).cast("int")
    spread = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("class", "skip", "skipped", "element", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    x, y = (spread.select(F.col("class").alias(n), F.col("skip").alias(f"s{n}"), F.col("skipped").alias(f"k{n}"), F.col("own").alias(f"o{n}"), "element", "lo", "hi") for n in "ab")
    met = x.join(y, ["element", "lo", "hi"]).filter("a < b and not (ka and kb) and (lo = hi or oa <> ob)")
    count = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first(F.size(F.array_intersect("sa", "sb"))).alias("both"))
    return count.filter(F.col("n") + F.col("both") >= MATCHES).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", threshold: float = 0.7, shingle: int = 3, min_words: int = 60, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: classes of texts of one word sequence, and all pairs of classes at least ``threshold`` alike.

    ``members`` is ``(id, class)``, one row per distinct id; ``pairs`` is ``(a, b,
    similarity)`` of class numbers, a < b. Copies meet in a class before anything
    is paired, so a group of k copies costs k rows, not k**2.

    Classes that agree in MATCHES coordinates (``_collisions``) are verified exactly
    on the shingle sets of their texts. At similarity 0.7 a pair is missed with
    probability 0.00003, above it less.

    Null texts and texts of fewer than ``min_words`` words (or fewer than
    ``shingle``) are in no class; null ids are dropped; of several texts under one
    id each counts; empty input gives empty results.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    rows = rows.filter(F.length("text") >= 2 * max(min_words, shingle) - 1)
    signed = stage(_sign(rows, min_words, shingle))
    classes = stage(signed.groupBy("copy").agg(F.min("id").alias("head"), F.first("signature").alias("signature")).withColumn("class", F.monotonically_increasing_id()))
    members = signed.select("id", "copy").distinct().join(classes.select("copy", "class"), "copy").select("id", "class")

    matched = stage(_collisions(classes.select("class", "signature"), block))

    wanted = matched.select(F.col("a").alias("class")).union(matched.select("b")).distinct().join(classes.select("class", "head"), "class")
    texts = rows.join(bounded_broadcast(stage(wanted.select("class", F.col("head").alias("id")))), "id").groupBy("class").agg(F.min("text").alias("text"))
    texts = stage(texts)
    pairs = matched.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
    return members, stage(_similarity(pairs.select("a", "b", "ta", "tb"), shingle).filter(F.col("similarity") >= threshold))


def duplicate_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs ``(id_a, id_b)``, id_a < id_b, of ids in one class or in two similar ones."""
    links = pairs.select("a", "b").union(members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class", "class"))
    x = members.select(F.col("class").alias("a"), F.col("id").alias("x"))
    y = members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    both = links.join(x, "a").join(y, "b").filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def duplicate_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, group, links)`` of every id that has a copy or a similar text; ``links`` counts the other ids it is paired with."""
    size = stage(members.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    near = pairs.select("a", "b").union(pairs.select("b", "a")).join(size.select(F.col("class").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("class")).agg(F.sum("m").alias("m"))
    part = connected_components(pairs).withColumnRenamed("node", "class")
    whole = size.join(part, "class", "left").join(near, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = whole.groupBy("component").agg(F.min("least").alias("group"))
    whole = whole.join(named, "component").select("class", "group", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("links")).filter("links > 0")
    return members.join(whole, "class").select("id", "group", "links")
