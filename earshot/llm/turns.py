"""Raw transcript text into clean speaker turns: layouts mined by token trees of fixed depth, then extraction and merging."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.storage import stage
from earshot.llm.names import HONORIFICS, fold, person

#: Tokens of the path that names a layout; a label may go on beyond them, with every further token of one class.
DEPTH = 14
#: Lines a layout needs, the share of its lines whose slot must hold a speaker seen elsewhere, and texts after which a bare line that names nobody is a heading.
MIN_LINES, MIN_SHARE, HEADING = 3, 0.25, 3
#: Least share of all label lines that a layout, heading or label word needs to be learned: so at most ``1 / LEAST`` of each kind are sent to the tasks, whatever the corpus.
LEAST = 1e-5
#: Layouts that mark a label by nothing but itself.
BARE = {"N :", "N $", "[ N ] $", "N T $"}
#: Layouts of whole lines that are labels by their marks: a name in brackets, or a name with a role behind a dash or in brackets.
_ENDED = r"^(\[ N \]|N (--|—|-|–|\() N( (w|&) N)*( \))?) \$$"

_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*\.?(?:['’-][^\W\d_]+)*"
_TOKEN = re.compile(rf"[ \t]*(?:(?P<T>{_TIME})|(?P<n>\d+(?:[.,]\d+)*)|(?P<N>{_CAP}(?:[ \t]+{_CAP})*)|(?P<w>[^\W\d_]+(?:['’-][^\W\d_]+)*)|(?P<p>-->|--|>>|[^\w\s]|_))")
_JOINING = {"of", "for", "and", "the", "de", "van", "von", "da", "del", "di", "la", "to", "in"}
_NOISE = re.compile(rf"\[[^\[\]\n]{{0,40}}\]|\([^()\n]{{0,40}}\)|\{{[^{{}}\n]{{0,40}}\}}|<[^<>\n]{{0,40}}>|\*[^*\n]{{1,40}}\*|{_TIME}(?:[ \t]*-->[ \t]*{_TIME})?")
_ANNOTATION = re.compile(
    rf"\[[ \t]*(?:{_TIME}|(?:inaudible|laughter|laughs?|applause|music|pause|crosstalk|silence|noise|technical (?:difficulty|difficulties|issue)|indiscernible|unintelligible|foreign language|background noise|audio gap|break|cough(?:ing|s)?|sighs?|chuckles?)[^\]\n]{{0,30}})\]"
    rf"|\([ \t]*(?:{_TIME}|(?:inaudible|laughter|laughs?|applause|music|pause|crosstalk|silence|noise|technical (?:difficulty|difficulties|issue)|indiscernible|unintelligible|foreign language|background noise|audio gap|break|cough(?:ing|s)?|sighs?|chuckles?)[^)\n]{{0,30}})\)"
    rf"|<[ \t]*(?:{_TIME}|(?:inaudible|laughter|laughs?|applause|music|pause|crosstalk|silence|noise|technical (?:difficulty|difficulties|issue)|indiscernible|unintelligible)[^>\n]{{0,30}})>"
    rf"|\{{[^{{}}\n]{{1,40}}\}}|\*[^*\n]{{1,40}}\*|(?<!\S){_TIME}(?:[ \t]*-->[ \t]*{_TIME})?(?!\S)",
    re.I,
)
_FILLER = re.compile(r"(?<!\w)(?:uh+|um+|er+|erm|hmm+|mm+|ah+|eh|you know|i mean|sort of|kind of)(?!\w)(?:,|[ \t]*—)?", re.I)
_REPEAT = re.compile(r"(?<!\w)([^\W\d_]+[.,]?)(?:[ \t]+\1(?!\w))+", re.I)
_LOWER = re.compile(r"(?<![^\W\d_])[a-zß-öø-ÿ]{2,}(?![^\W\d_])")
_ASKS = re.compile(r"\b(?:next question|question (?:is|comes|from)|take (?:a|our first|the next) question|your line is open|line of|next up is)\b", re.I)


def head(line: str) -> tuple[str, list[tuple[int, int]], int] | None:
    """(layout, spans of its capitalised runs, where speech begins) of a line that may open with a label, else None.

    The layout is the path of token classes from the line's start to what ends a
    label: a colon, a dash after a leading time and name, a closing angle bracket,
    or the end of a short line. T is a time, N a capitalised run, n a number, w a
    joining word; other signs stand for themselves.
    """
    path, spans, pos, other = [], [], 0, False
    dash = close = None
    name = lambda end: " ".join([*path[:DEPTH], *(["…"] if len(path) > DEPTH else []), end])
    while True:
        m = _TOKEN.match(line, pos)
        if not m:
            break
        kind = m.lastgroup
        text = m[kind]
        if kind == "N":
            spans.append(m.span("N"))
            path.append("N")
        elif kind == "p":
            if text == ":" and spans and not other:
                return name(":"), spans, m.end()
            if text in ("-", "–", "--") and dash is None and not other and path and path[-1] == "N" and "T" in path[:-1] and len(spans) == 1:
                dash = (name(text), list(spans), m.end())
            if text == ">" and path in (["<", "N"],):
                close = (name(text), list(spans), m.end())
            path.append(text)
        elif kind == "w":
            if text not in _JOINING or not spans:
                other = True
            path.append("w")
        else:
            path.append(kind)
        pos = m.end()
        if other:  # an ordinary word: whatever follows is speech
            break
    if dash or close:
        return dash or close
    if spans and not other and not line[pos:].strip():
        return name("$"), spans, len(line)
    return None


def clean_name(label: str) -> str:
    """A label's name in lower case without marks, numbers or titles around it; any form of the operator is ``operator``."""
    words = [w for w in re.sub(r"\s+", " ", label.lower()).strip(" .,;:-–—*[](){}<>\"'").split(" ") if w]
    while words and words[0].strip(".") in HONORIFICS:
        words = words[1:]
    return "operator" if "operator" in words and len(words) <= 3 else " ".join(words)


def name_key(name: str) -> str:
    """The words of a name without diacritics, in alphabetical order: one key for ``First Last`` and ``Last, First``."""
    return " ".join(sorted(w for w in (re.sub(r"\W", "", x) for x in re.split(r"[\s.,]+", fold(name))) if w))


def _lines(text: str) -> list[str]:
    return re.split(r"\r?\n", text)


def _speaker_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw in batch.column(0).to_pylist():
            kind, words, initials = person(raw)
            if kind in ("full", "initial"):
                out.append(" ".join(sorted([*words, *initials])))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["key"])


def mine_labels(df: DataFrame, text_col: str = "text", speaker_col: str | None = "speaker") -> tuple[DataFrame, DataFrame]:
    """``(slots, headings)``: what the lines of a corpus say about labels, without any list of names.

    Each task walks its lines down the token tree and sends one row per (layout,
    slot, value) it met, with the number of texts. A value is a speaker seen
    elsewhere if it is the operator, a name of the speaker column, or a value of
    several words that opens labels of different layouts, not all bare: people are
    labelled in many ways, headings in one, and roles and firms don't come first. ``slots`` is ``(layout, slot, lines,
    share, kinds)``: the lines of each layout, the share whose slot-th capitalised run
    holds such a speaker, and how many different values it holds.

    ``headings`` is ``(value)``: values of bare layouts that at least ``HEADING`` texts
    carry and nothing shows to be a person, and those all of whose words the same
    texts write in lower case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys = [*seen, *(("", 0, w) for w in lower)]
            n = [*seen.values(), *lower.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([name_key(k[2]) if k[0] else k[2] for k in keys], pa.string()), pa.array(n, pa.int64())],
                names=["layout", "slot", "value", "key", "n"],
            )

        seen: Counter = Counter()
        lower: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                here = set()
                for line in _lines(text):
                    found = head(line)
                    if found:
                        here.update((found[0], i, clean_name(line[b:e])) for i, (b, e) in enumerate(found[1]))
                if here:
                    seen.update(here)
                    lower.update(set(_LOWER.findall(text)))
            if len(seen) + len(lower) > 500_000:
                yield rows()
                seen.clear(), lower.clear()
        yield rows()

    texts = df.select(F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    mined = stage(texts.mapInArrow(run, "layout string, slot int, value string, key string, n bigint").groupBy("layout", "slot", "value", "key").agg(F.sum("n").alias("n")))
    labels, lower = mined.filter("layout <> ''"), mined.filter("layout = ''").groupBy("value").agg(F.sum("n").alias("lower")).withColumnRenamed("value", "word")
    people = F.lit(None).cast("string") if speaker_col not in df.columns else F.col(speaker_col).cast("string")
    known = df.select(people.alias("s")).dropna().distinct().mapInArrow(_speaker_key, "key string").distinct().withColumn("listed", F.lit(True))

    several = F.size(F.split("key", " ")) > 1
    bare = F.col("layout").isin(*BARE)
    value = labels.groupBy("value", "key").agg(F.count_distinct(F.when((F.col("slot") == 0) & (~F.col("layout").endswith("$") | F.col("layout").rlike(_ENDED)), F.col("layout"))).alias("layouts"), F.max(~bare).alias("marked"), F.sum("n").alias("texts")).join(known, "key", "left")
    value = stage(value.withColumn("speaker", F.coalesce("listed", F.lit(False)) | (F.col("value") == "operator") | (several & (F.col("layouts") > 1) & F.col("marked"))))
    total = labels.agg(F.sum("n").alias("all"))  # one row
    scored = labels.join(value.select("value", "key", "speaker"), ["value", "key"]).groupBy("layout", "slot").agg(
        F.sum("n").alias("lines"), (F.sum(F.when(F.col("speaker"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.count("*").alias("kinds")
    )
    slots = scored.join(F.broadcast(total)).filter((F.col("lines") >= MIN_LINES) & (F.col("share") >= MIN_SHARE) & (F.col("lines") >= LEAST * F.col("all"))).drop("all")

    plain = value.filter(~F.col("speaker"))
    often = plain.filter(~F.col("marked") & (F.col("texts") >= HEADING)).select("value", "texts")
    word = plain.select("value", "texts", F.explode(F.split("value", " ")).alias("word")).join(lower, "word", "left")
    common = word.groupBy("value", "texts").agg(F.min(F.coalesce("lower", F.lit(0))).alias("least")).filter("least >= 2").select("value", "texts")
    headings = often.union(common).distinct().join(F.broadcast(total)).filter(F.col("texts") >= LEAST * F.col("all")).select("value")
    return slots, headings


def clean_section(section: Column) -> Column:
    """``qa`` or ``prepared_remarks`` for the spellings of either, else null."""
    s = F.regexp_replace(F.lower(F.trim(section)), "[^a-z]+", "")
    return F.when(s.rlike("^(qa|qanda|questions?(and)?answers?.*|question.*)$"), "qa").when(s.rlike("^prepared"), "prepared_remarks")


def spoken(text: str) -> str:
    """Speech without annotations, times, fillers and stuttered words."""
    text = _FILLER.sub(" ", _ANNOTATION.sub(" ", text))
    text = _REPEAT.sub(r"\1", re.sub(r"\s+", " ", text))
    return re.sub(r" ([,.;?!])", r"\1", text).strip(" ,—")


def speaker_turns(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", section_col: str = "section", speaker_col: str | None = "speaker") -> DataFrame:
    """``(id_col, turn_no, speaker, section, words)``: the turns of every text that carries speaker labels.

    A layout counts as a label if in enough of its lines one slot holds a speaker who
    is seen elsewhere (``mine_labels``); that slot is then read in all its lines, and
    whoever is named there speaks, unless the value is one of the headings of the
    corpus or a single word that nothing shows to be a name. Text before the first
    label is no turn; turns without spoken words are dropped; then neighbouring
    turns of one speaker are merged and the rest number from 1. ``section`` is the
    row's own if it can be read, else ``prepared_remarks``; from the first call for
    questions on it is ``qa``.

    Null and empty texts and texts without labels have no row; null ids are kept;
    several rows of one id each give their turns. Without a speaker column
    (or ``speaker_col`` None) speakers are known by the layouts alone.
    """
    slots: dict[str, tuple[int, int, float]] = {}
    mined, titles = mine_labels(df, text_col, speaker_col)
    for r in mined.collect():  # at most 1 / LEAST rows, as of the headings
        if (r["kinds"], r["share"]) > slots.get(r["layout"], (0, 0, 0.0))[1:]:  # people are many, their roles and firms few
            slots[r["layout"]] = (r["slot"], r["kinds"], r["share"])
    headings = {r["value"] for r in titles.collect()}

    def label(line: str) -> tuple[str, int] | None:
        """(speaker, where speech begins) of a line that opens with a label."""
        found = head(line)
        if not found or found[0] not in slots:
            return None
        layout, spans, begin = found
        b, e = spans[slots[layout][0]]
        name = clean_name(line[b:e])
        words = name.split(" ")
        if name != "operator" and (name in headings or not 2 <= len(words) <= 6):
            return None
        return name, begin

    def turns(text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, list[str]]] = []
        for line in _lines(text):
            found = label(line)
            if found:
                out.append((found[0], [line[found[1] :]]))
            elif out:
                out[-1][1].append(line)
        merged: list[tuple[str, str]] = []
        for name, lines in out:
            words = spoken("\n".join(lines))
            if not re.search(r"[^\W_]", words):
                continue
            if merged and merged[-1][0] == name:
                merged[-1] = (name, f"{merged[-1][1]} {words}")
            else:
                merged.append((name, words))
        return merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, number, who, part, what = [], [], [], [], []
            for i, (section, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                section = section or "prepared_remarks"
                for k, (name, words) in enumerate(turns(text), 1):
                    if name == "operator" and _ASKS.search(words):
                        section = "qa"
                    index.append(i), number.append(k), who.append(name), part.append(section), what.append(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(number, pa.int32()), pa.array(who, pa.string()), pa.array(part, pa.string()), pa.array(what, pa.string())],
                names=["id", "turn_no", "speaker", "section", "words"],
            )

    texts = df.select(F.col(id_col).alias("id"), clean_section(F.col(section_col)).alias("section"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, turn_no int, speaker string, section string, words string").withColumnRenamed("id", id_col)
