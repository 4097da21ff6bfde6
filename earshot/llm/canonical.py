"""Free-typed values to a reference list: a prefix-filter set-similarity join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.names import abbreviates, alike, deletes, fold
from earshot.storage import stage

STOP = {"of", "for", "and", "the", "to", "in", "at"}


def _words(text: str) -> list[str]:
    text = re.sub(r"\b([a-z])\.\s?([a-z])\.(?:\s?([a-z])\.)?", lambda m: "".join(x or "" for x in m.groups()) + " ", fold(text).replace("'s ", " "))
    return re.findall(r"[^\W_]+", text)


def short_for(short: str, word: str) -> bool:
    """Whether a typed word is a short form of another: its beginning, its first letter and some of its consonants to the last, or half of its letters in order and its last."""
    if len(short) >= len(word) or not abbreviates(short, word):
        return False
    if word.startswith(short) or (short[-1] == word[-1] and 2 * len(short) + 1 >= len(word)):
        return True
    return len(short) > 1 and not set(short[1:]) & set("aeiou")


def initials(words: list[str]) -> Iterator[tuple[str, list[str]]]:
    """Every run of two or more words with its initials."""
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            yield "".join(w[0] for w in words[i:j]), words[i:j]


def word_keys(word: str, longest: int | None = None) -> set[str]:
    """Keys of a word under which equal, misspelt and shortened ones meet; a word longer than ``longest`` and its edits has none.

    Without ``longest`` the word is one of the list: it is also posted under all its beginnings.
    """
    if longest is not None and len(word) > longest + 2:
        return set()
    ends = {f"e{word[0]}{c}" for c in (word[-1] if longest is not None else set(word[1:]))} if len(word) > 1 else set()
    begins = {f"p{word}"} if longest is not None else {f"p{word[:i]}" for i in range(1, len(word) + 1)}
    return {f"d{d}" for d in deletes(word)} | begins | ends


def likeness(units: list[list[list[str]]], entry: list[str]) -> tuple[float, float]:
    """(Jaccard similarity, doubt) of a typed value and an entry.

    ``units`` has for each typed word the word sets it may stand for (itself, a word of
    the list, or the words whose initials it is). Of all ways to read them the one of
    greatest similarity counts, found word by word over the sets of entry words
    covered so far.
    """
    bit = {w: 1 << i for i, w in enumerate(entry)}
    covered = {0: 0}  # entry words covered, as bits: the fewest words the value then has
    for options in units:
        useful = [(sum(bit.get(w, 0) for w in set(o)), len(o)) for o in options if any(w in bit for w in o)]
        now: dict[int, int] = {}
        for mask, size in covered.items():
            for got, n in ((0, 1), *useful):
                if mask | got != mask or not got:
                    now[mask | got] = min(now.get(mask | got, size + n), size + n)
        covered = now
    best = max((m.bit_count() / (size + len(entry) - m.bit_count()) for m, size in covered.items()), default=0.0)
    return best, float(sum(len(o) > 1 for o in units))


def _readings(text: str) -> list[str]:
    """The value whole, and without what looks like a firm beside it: after ' at ', in brackets, before ' - ' or after the last comma."""
    out = [text, re.sub(r"\([^()]*\)", " ", text), re.split(r"\bat\b", text, flags=re.I)[0]]
    for mark in (" - ", " – ", " — ", ",", " @ ", "|", ";"):
        if mark in text:
            out += [text.split(mark, 1)[1], text.rsplit(mark, 1)[0]]
    return out


def match_canonical(values: DataFrame, reference: DataFrame, value_col: str = "title", ref_id: str = "title_id", ref_col: str = "title", threshold: float = 0.8) -> DataFrame:
    """``(value, ref_id, similarity)``: each distinct value with its best entry of the reference list, or 0 and null.

    Nothing about the list is known beforehand. Its words are indexed by their
    deletion neighbourhoods, beginnings and ends, and the initials of neighbouring
    words; a typed word may stand for those it is equal to, an edit away from
    (``names.EDIT_LENGTHS``), a short form of (``short_for``), or the initials of. A value is
    read whole and without what looks like a firm beside it.

    Words of entries are ordered by how rare they are; an entry of n words that is
    to reach Jaccard similarity t must share one of its first n - ceil(t * n) + 1
    words with the value, so only those prefixes are joined. The length and
    positional filters drop what can't reach t, the rest is verified exactly and the
    best is kept; among equals the one with the fewest doubtful words, then the
    fewest words, then the least id counts.

    Null and empty values have no row; blanks and symbols are reported with 0. An
    empty list reports every value with 0. Both sides and the words may have any
    size: all of it is joins.
    """
    raw = values.select(F.col(value_col).alias("value")).filter("value is not null and value <> ''").distinct()
    entries = reference.select(F.col(ref_id).alias("ref"), F.col(ref_col).alias("entry")).dropna().dropDuplicates(["ref"])
    ref_type = entries.schema["ref"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, list(s)) for v in b["value"] for s in {tuple(dict.fromkeys(w for w in _words(r) if w not in STOP)) for r in _readings(v)} if s]
            yield pd.DataFrame(rows, columns=["value", "tokens"])

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ref": b["ref"], "words": [list(dict.fromkeys(w for w in _words(e) if w not in STOP)) for e in b["entry"]]})

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, k) for w in b["word"] for k in sorted(word_keys(w))], columns=["word", "key"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for w in b["words"] for x in initials(list(w))], columns=["token", "covers"])

    @F.pandas_udf("boolean")
    def stands_for(token: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([alike(t, w) or short_for(t, w) for t, w in zip(token, word)], dtype="bool")

    left = stage(raw.mapInPandas(read, "value string, tokens array<string>").withColumn("set", F.monotonically_increasing_id()))
    right = stage(entries.mapInPandas(listed, f"ref {ref_type}, words array<string>").filter(F.size("words") > 0).withColumn("n", F.size("words")))
    word = right.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    longest = right.agg(F.max(F.array_max(F.transform("words", F.length)))).first()[0] or 0
    token = left.select(F.explode("tokens").alias("token")).distinct()

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, k) for t in b["token"] for k in sorted(word_keys(t, longest))], columns=["token", "key"])

    near = token.mapInPandas(probes, "token string, key string").join(word.select("word").mapInPandas(posted, "word string, key string"), "key").select("token", "word").distinct()
    near = near.filter((F.col("token") == F.col("word")) | stands_for("token", "word")).select("token", F.array("word").alias("covers"), (F.col("token") == F.col("word")).alias("same"))
    spelled = token.join(right.select("words").mapInPandas(runs, "token string, covers array<string>").distinct(), "token").select("token", "covers", F.lit(False).alias("same"))
    exact = near.filter("same").select("token")
    means = near.filter("same").unionByName(near.filter("not same").unionByName(spelled).join(exact, "token", "left_anti"))  # a word of the list stands for itself alone
    meaning = stage(means.groupBy("token").agg(F.array_sort(F.collect_set("covers")).alias("options")))

    held = left.select("set", "value", F.posexplode("tokens").alias("at", "token")).join(meaning, "token", "left")
    held = held.withColumn("options", F.coalesce("options", F.array(F.array("token"))))
    sets = stage(held.groupBy("set", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "options"))), lambda x: x["options"]).alias("units")))
    size = lambda f: F.aggregate(F.transform("units", lambda o: f(F.transform(o, F.size))), F.lit(0), lambda a, b: a + b)
    sets = sets.withColumn("least", size(F.array_min)).withColumn("most", size(F.array_max))
    place = F.row_number().over(Window.partitionBy("ref").orderBy("df", "word"))
    prefix = right.select("ref", "n", F.explode("words").alias("word")).join(word, "word").withColumn("pos", place).filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1)
    a = sets.select("set", "least", "most", F.explode(F.array_distinct(F.flatten(F.flatten("units")))).alias("word"))
    reach = F.least("most", F.col("n") - F.col("pos") + 1)  # words that can still be shared from here on
    fits = (F.col("n") >= F.col("least") * F.lit(threshold)) & (F.col("most") >= F.col("n") * F.lit(threshold)) & (reach >= F.ceil((F.col("least") + F.col("n")) * F.lit(threshold / (1 + threshold))))
    met = a.join(prefix, "word").filter(fits).select("set", "ref").distinct()
    met = met.join(sets.select("set", "value", "units"), "set").join(right, "ref")

    @F.pandas_udf("similarity double, doubt double")
    def compare(units: pd.Series, words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([likeness([[list(o) for o in u] for u in us], list(w)) for us, w in zip(units, words)], columns=["similarity", "doubt"])

    scored = met.withColumn("c", compare("units", "words")).filter(F.col("c.similarity") >= threshold)
    best = scored.groupBy("value").agg(F.min(F.struct((-F.col("c.similarity")).alias("s"), F.col("c.doubt").alias("doubt"), "n", "ref")).alias("b"))
    found = raw.join(best, "value", "left")
    zero = F.lit(0).cast(entries.schema["ref"].dataType)
    return found.select("value", F.coalesce(F.col("b.ref"), zero).alias("ref_id"), (-F.col("b.s")).alias("similarity"))
