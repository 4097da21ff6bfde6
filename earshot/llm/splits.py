"""Splits that keep related records together: components, largest-differencing bins, whole bins to splits."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.names import resolve_companies, with_company
from earshot.operators.graph import connected_components
from earshot.storage import bounded_broadcast, stage

#: Equal bins, and components (or bins of the level below) that one task balances at once.
BINS, GROUP = 40, 4_000


def difference(weights: list[float], k: int) -> list[int]:
    """The bin (0 to k - 1) of each weight by largest differencing.

    A partial solution holds k sums in descending order; the two whose spread is
    largest are combined again and again, the heaviest sum of one onto the
    lightest of the other, until one solution remains. O(n k log(n k)).
    """
    heap = []
    for i, w in enumerate(weights):
        heap.append((-w, i, [(w, [i])] + [(0.0, [])] * (k - 1)))
    heapq.heapify(heap)
    tie = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        sums = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda s: (-s[0], s[1][:1]))
        heapq.heappush(heap, (sums[-1][0] - sums[0][0], tie, sums))
        tie += 1
    out = [0] * len(weights)
    for j, (_, members) in enumerate(heap[0][2] if heap else []):
        for i in members:
            out[i] = j
    return out


def _bin_level(parts: DataFrame, bins: int, groups: int) -> DataFrame:
    """``(part, bin)``: the parts dealt into ``groups`` groups by hash, each balanced into ``bins`` bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, g in _by_group(batches):
            g = g.sort_values(["weight", "part"], ascending=[False, True])
            at = difference([float(w) for w in g["weight"]], bins)
            yield pd.DataFrame({"part": g["part"].to_numpy(), "bin": [f"{key}-{b}" for b in at]})

    def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        whole = list(batches)
        if whole:
            yield from pd.concat(whole).groupby("group")

    keyed = parts.select("part", "weight", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("group"))
    return keyed.repartition(groups, "group").mapInPandas(run, "part string, bin string")


def balanced_bins(parts: DataFrame, bins: int = BINS, group: int = GROUP) -> DataFrame:
    """``(part, bin)`` with about equal weight per bin, from ``(part, weight)`` of unique parts.

    Up to ``group`` parts are balanced by one task. More are dealt by hash into
    groups of about that size, each group is balanced into bins, and the bins are
    the parts of the next level, so the work per task stays bounded whatever the
    number of parts, and one heavy part never weighs on the rest.
    """
    current, mapping = parts.select("part", "weight"), None
    while True:
        n = current.count()
        groups = max(1, math.ceil(n / group))
        level = stage(_bin_level(current, bins, groups))
        mapping = level if mapping is None else stage(mapping.withColumnRenamed("bin", "_b").join(level.select(F.col("part").alias("_b"), "bin"), "_b").select("part", "bin"))
        if groups == 1:
            return mapping
        current = stage(current.join(level, "part").groupBy("bin").agg(F.sum("weight").alias("weight")).select(F.col("bin").alias("part"), "weight"))


def deal_bins(stats: list[tuple[str, float, float, float]], shares: list[tuple[str, float]]) -> dict[str, str]:
    """Whole bins to splits: ``stats`` is (bin, rows, outcomes, sum of outcomes), ``shares`` (split, share).

    The heaviest bins go first, each to the split that is then nearest its share
    of rows; among splits equally short, to the one whose mean outcome comes
    nearest the overall mean. Beyond the method, swaps of bins of like weight then
    bring the means together as long as that helps; shares move by half a per cent
    at most.
    """
    total = sum(s[1] for s in stats) or 1.0
    whole = sum(s for _, s in shares) or 1.0
    mean = sum(s[3] for s in stats) / (sum(s[2] for s in stats) or 1.0)
    goal = {name: share / whole * total for name, share in shares}
    have = {name: [0.0, 0.0, 0.0] for name in goal}
    out: dict[str, str] = {}
    for b, rows, n, s in sorted(stats, key=lambda x: (-x[1], x[0])):
        names = [g for g in goal if goal[g] > 0] or list(goal)
        fit = lambda g: (round(max(0.0, have[g][0] + rows - goal[g]) / total, 3), -round((goal[g] - have[g][0]) / goal[g] if goal[g] else 0.0, 2), abs((have[g][2] + s) / max(1.0, have[g][1] + n) - mean), g)  # noqa: B023, E731
        best = min(names, key=fit)
        out[b] = best
        for i, v in enumerate((rows, n, s)):
            have[best][i] += v
    by_bin = {x[0]: x for x in stats}

    def gap() -> float:
        return sum(abs(h[2] / h[1] - mean) for h in have.values() if h[1])

    for _ in range(200):
        best, swap = gap(), None
        keys = sorted(out)
        for i, x in enumerate(keys):
            for y in keys[i + 1 :]:
                a, b = by_bin[x], by_bin[y]
                if out[x] != out[y] and abs(a[1] - b[1]) <= 0.005 * total:
                    for sign in (1, -1):
                        for g, p, q in ((out[x], a, b), (out[y], b, a)):
                            for k in (1, 2, 3):
                                have[g][k - 1] += sign * (q[k] - p[k])
                        if sign == 1 and (now := gap()) < best - 1e-12:
                            best, swap = now, (x, y)
        if not swap:
            break
        x, y = swap
        a, b = by_bin[x], by_bin[y]
        for g, p, q in ((out[x], a, b), (out[y], b, a)):
            for k in (1, 2, 3):
                have[g][k - 1] += q[k] - p[k]
        out[x], out[y] = out[y], out[x]
    return out


def grouped_splits(df: DataFrame, keys: list[str], targets: DataFrame, outcome_col: str | None = None, split_col: str = "split_name", share_col: str = "target_share", bins: int = BINS) -> DataFrame:
    """``df`` with ``component`` and ``split``: rows that share a value in any of ``keys``, directly or through others, get one split.

    Rows are linked through their key values (prefixed by the key's name), whose
    connected components are weighed by their rows; components are combined by
    largest differencing into equal bins, and whole bins are given to the splits
    in proportion, with like means of ``outcome_col`` (nulls and NaN don't count).

    A row whose keys are all null or empty is a component of its own content. Every
    row is kept, repeated ones with the same split. Names in ``df`` that clash
    with the two new columns are replaced. Shares are scaled to add up to 1; the
    bins (at most ``bins`` rows) and the targets are small and go to the driver.
    """
    df = df.drop("component", "split")
    value = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    tagged = df.withColumn("_keys", F.array_compact(F.array(*[value(c) for c in keys])))
    tagged = tagged.withColumn("_first", F.coalesce(F.try_element_at("_keys", F.lit(1)), F.concat(F.lit("row="), F.xxhash64(*df.columns).cast("string"))))
    if len(keys) > 1:
        pairs = tagged.select("_first", F.explode("_keys").alias("_k")).distinct().filter("_first <> _k")
        comp = connected_components(pairs, "_first", "_k")
        tagged = tagged.join(bounded_broadcast(comp.withColumnRenamed("node", "_first")), "_first", "left").withColumn("component", F.coalesce("component", "_first"))
    else:
        tagged = tagged.withColumn("component", F.col("_first"))
    outcome = F.lit(None).cast("double") if outcome_col is None else F.nanvl(F.col(outcome_col).cast("double"), F.lit(None).cast("double"))
    parts = stage(tagged.groupBy("component").agg(F.count("*").cast("double").alias("weight"), F.count(outcome).cast("double").alias("n"), F.coalesce(F.sum(outcome), F.lit(0.0)).alias("s")))
    where = balanced_bins(parts.withColumnRenamed("component", "part"), bins)
    stats = where.join(parts, where.part == parts.component).groupBy("bin").agg(F.sum("weight").alias("w"), F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    shares = [(r[0], float(r[1])) for r in targets.select(split_col, share_col).dropna().orderBy(F.desc(share_col), split_col).collect()]
    dealt = deal_bins([(r["bin"], r["w"], r["n"], r["s"]) for r in stats], shares)
    spark = df.sparkSession
    table = spark.createDataFrame(list(dealt.items()) or [("", "")], "bin string, split string")
    final = stage(where.join(F.broadcast(table), "bin").select(F.col("part").alias("component"), "split"))
    return tagged.join(bounded_broadcast(final), "component").drop("_keys", "_first")


def company_splits(df: DataFrame, companies: DataFrame, targets: DataFrame, ticker_col: str = "ticker", outcome_col: str = "abnormal_ret_1d") -> DataFrame:
    """``grouped_splits`` by company over all spellings of its ticker; the company is added as ``company``."""
    mapping = stage(resolve_companies(df, companies, ticker_col))
    return grouped_splits(with_company(df.drop("company"), mapping, ticker_col), ["company"], targets, outcome_col)
