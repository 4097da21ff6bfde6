"""Sentence and text sentiment: lexicon shares, rule-based valence, and any model behind a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import lexicons, text as T

#: Boost of a degree word before a valued word, factor of a negator, pull of "but", normalising constant. Fixed values of the published rule set.
BOOST, NEGATE, BEFORE_BUT, AFTER_BUT, ALPHA = 0.293, -0.74, 0.5, 1.5, 15.0


def valence(text: Column, values: dict[str, float], boosters: list[str] = lexicons.INTENSIFIERS, dampers: list[str] = lexicons.DIMINISHERS, negators: list[str] = lexicons.NEGATORS) -> Column:
    """Struct of compound, pos, neg and neu by rules over a valence lexicon.

    A valued word is raised or lowered by a degree word among the three before it
    and turned by a negator there; words before "but" count half, after it one and
    a half. compound is s / sqrt(s^2 + 15). All in the JVM; the lexicon is a parameter.
    """
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    up, down, no = (F.array(*map(F.lit, x)) for x in (boosters, dampers, negators))

    def scores(w: Column) -> Column:
        but = F.array_position(w, "but")

        def score(x: Column, i: Column) -> Column:
            near = F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            v = F.coalesce(F.try_element_at(table, x), F.lit(0.0))
            lift = F.when(F.arrays_overlap(near, up), BOOST).otherwise(0.0) - F.when(F.arrays_overlap(near, down), BOOST).otherwise(0.0)
            v = (v + F.signum(v) * lift) * F.when(F.arrays_overlap(near, no), NEGATE).otherwise(1.0)
            return F.when(~F.contains(known, F.concat(F.lit(" "), x, F.lit(" "))), 0.0).otherwise(v * F.when(but == 0, 1.0).when(i + 1 < but, BEFORE_BUT).when(i + 1 > but, AFTER_BUT).otherwise(1.0))

        return F.transform(w, score)

    def shares(s: Column) -> Column:
        add = lambda keep: F.aggregate(s, F.lit(0.0), lambda t, v: t + keep(v))
        sums = F.struct(add(lambda v: v).alias("t"), add(lambda v: F.when(v > 0, v + 1).otherwise(0.0)).alias("p"), add(lambda v: F.when(v < 0, 1 - v).otherwise(0.0)).alias("m"), add(lambda v: F.when(v == 0, 1.0).otherwise(0.0)).alias("z"))

        def out(x: Column) -> Column:
            whole = x["p"] + x["m"] + x["z"]
            share = lambda c: F.when(whole > 0, c / whole).otherwise(0.0)
            return F.struct((x["t"] / F.sqrt(x["t"] * x["t"] + ALPHA)).alias("compound"), share(x["p"]).alias("pos"), share(x["m"]).alias("neg"), share(x["z"]).alias("neu"))

        return T.let(sums, out)

    known = F.lit(" " + " ".join(values) + " ")
    return T.let(T.let(T.plain_tokens(text), scores), shares)


def model_scores(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], limit: int = 2_000, batch: int = 16):
    """An Arrow function of a text column to ``struct<label, score>`` by any model.

    ``load`` runs once per task and returns a function of a list of texts to
    (label, probability) pairs. Texts are cut to ``limit`` characters; a batch that
    fails is labelled ``error`` with 0.
    """

    @F.pandas_udf("label string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for s in texts:
            out: list[tuple[str, float]] = []
            cut = [(t or "")[:limit] for t in s]
            for i in range(0, len(cut), batch):
                part = cut[i : i + batch]
                try:
                    out += model(part)
                except Exception:
                    out += [("error", 0.0)] * len(part)
            yield pd.DataFrame(out, columns=["label", "score"])

    return run


def sentence_scores(df: DataFrame, key: list[str], text: str, scorer) -> DataFrame:
    """Array of (sentence, label, score) per row, in order, by a scorer over single sentences."""
    s = df.select(*key, F.posexplode(T.sentences(F.col(text))).alias("n", "s")).withColumn("r", scorer(F.substring("s", 1, 512)))
    item = F.struct("n", F.col("s").alias("sentence"), F.col("r.label").alias("label"), F.col("r.score").alias("score"))
    return s.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("sentences"))


def analyze(df: DataFrame, text: str, methods: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with the result of each method as a column of its name; all are expressions of the same row, so nothing is joined."""
    return df.withColumns({name: f(F.col(text)) for name, f in methods.items()})
