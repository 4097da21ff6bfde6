"""Personal details in free text: deobfuscation that keeps offsets, detection, and typed placeholders."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.names import NICKNAMES, fold
from earshot.storage import stage

#: Given names to begin with, folded; the long forms of NICKNAMES count too. Names in common use. They aren't what
#: a name must hold: the corpus is searched for the contexts in which they stand, and other names are found by these (``learn``).
GIVEN = set(
    "aaron adam adele agnes ahmed aisha alan alberto alejandro alfred alice alicia amanda amara amelia amir amy anand andre angela anita ann anna anne antonio aoife arjun arthur astrid audrey barbara "
    "beatrice bjorn brian bruce bruno camille carla carlos carmen carol caroline cecilia charlotte chen chiara claire clara claudia colin craig dennis diana diego dmitri donna dorothy edith elena eli elin "
    "ella emily emma eric erik esther eva evelyn farah fatima felix fiona florence francois gary george giulia gloria grace graham greta guillaume gunther hannah hans hassan heather helen helena hiro "
    "hugo ian ibrahim ines ingrid irene isabel ivan jane jason jean joan jorge jose juan judith julia julie jurgen karen karl keith kenji kevin klaus kwame laura lea leila lena linda lisa louis louise luca "
    "lucas lucia luis luke maria marie mario mark martin mary mei michel miguel mohamed monica nadia naomi natalie nina noemie nora oliver olga omar oscar pablo patrice paul paula pedro peter philippe pierre priya "
    "rachel rafael rahul ralph ravi renee rita roger rosa ruth sara sean sergei simone sofia sonia soren stefan susan sven tariq tatiana teresa thomas tomas ursula vera victor walter wei wolfgang ximena yasmin yuki yusuf zoe".split()
) | {n for long in NICKNAMES.values() for n in long.split()} | set(NICKNAMES)
#: Second words that make a capitalised pair a place or company instead of a person; more of them are learned from the corpus.
NOT_SURNAME = set("link flow direct works edge bridge one core path platform program street road lane avenue harbor heights valley creek junction mill mills hill estates trust mutual cooperative holdings group inc corporation co plc ag ltd llc gmbh networks energy logistics financial properties semiconductor partners capital advisors securities research markets brokerage equities fund bank tramways monday tuesday wednesday thursday friday saturday sunday".split())
#: Words that are never part of a name, however written.
FUNCTION_WORDS = set("a an the this that these those our his her its their my your at in on of for from by to with and or as if last next first before after was were is are be been has have had not no we he she they it you i".split())
#: Words that end a place name after its first word. Everyday English.
PLACE = "Harbou?r|Heights|Valley|Creek|Junction|Springs|Falls|Park|Hills?|Beach|City|Bay|Point|Ridge|Lake|Grove|Town|Village|Island|Crossing|Bridge"
#: Letters drawn alike. Cyrillic and Greek look-alikes of Latin letters.
ALIKE = dict(zip("асеіјорѕхуһԁԛԝАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aceijopsxyhdqwABCEHIJKMOPSTXYABEZHIKMNOPTYXo"))
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DIGIT = "|".join(DIGITS)
_SPELLED = re.compile(rf"\b(?:{_DIGIT})\b(?:[\s.,-]{{1,2}}(?:{_DIGIT})\b){{4,}}", re.I)
_TWO_DIGITS = re.compile(rf"(?:{_DIGIT})[\s.,-]{{1,2}}(?:{_DIGIT})")
_DIGIT_WORD = re.compile(rf"\b(?:{_DIGIT})\b[\s,.-]{{0,2}}", re.I)
_DOT = re.compile(r"(?<=\w)[ \t]*[\[({<][ \t]*(?:dot|punkt|point|punto)[ \t]*[\])}>][ \t]*(?=\w)|(?<=\w)[ \t]+dot[ \t]+(?=\w)", re.I)
_AT = re.compile(r"(?<=[\w+])[ \t]*[\[({<][ \t]*at[ \t]*[\])}>][ \t]*(?=\w)|(?<=[\w+])[ \t]+at[ \t]+(?=[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?![\w.+%-]*[ \t]*(?:@|\bat\b|[\[({<][ \t]*at\b)))", re.I)
_MAYBE_DOT = re.compile(r"[\[({<][ \t]*(?:dot|punkt|point|punto)|[ \t]dot[ \t]")
_AT_DOMAIN = re.compile(r" at [\w-]+\.[a-z]")
_ODD = re.compile(r"[­​-‏⁠﻿Ͱ-ϿЀ-ӿԀ-ԯ＀-～\U0001d400-\U0001d7ff]")


def _plain(text: str) -> bool:
    """Whether a text has nothing but Latin-1 letters and marks."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\xad" not in text


def _rewrite(text: str, begin: list[int], end: list[int], pattern: re.Pattern, repl) -> tuple[str, list[int], list[int]]:
    """One transducer: replaces matches and lets every new character stand for the whole source span of its match."""
    out, b, e, last = [], [], [], 0
    for m in pattern.finditer(text):
        new = repl(m) if callable(repl) else repl
        out += [text[last : m.start()], new]
        b += begin[last : m.start()] + [begin[m.start()]] * len(new)
        e += end[last : m.start()] + [end[m.end() - 1]] * len(new)
        last = m.end()
    if not last:
        return text, begin, end
    return "".join([*out, text[last:]]), b + begin[last:], e + end[last:]


def deobfuscate(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text with look-alike and invisible characters, spelled digits and at/dot disguises undone, and for each of its characters the first and one-past-last source character (None: nothing was changed)."""
    low = text.lower()
    odd = None if _plain(text) else _ODD.search(text)
    spelled = _SPELLED.search(text) if sum(map(low.count, DIGITS)) > 4 and _TWO_DIGITS.search(low) else None
    dots = _MAYBE_DOT.search(low) and _DOT.search(text)
    ats = ("(at" in low or "[at" in low or "{at" in low or "<at" in low or "( at" in low or "[ at" in low) or (" at " in low and _AT_DOMAIN.search(low))
    if not (odd or spelled or dots or ats):
        return text, None, None
    begin, end = list(range(len(text))), list(range(1, len(text) + 1))
    if odd:
        text, begin, end = _rewrite(text, begin, end, _ODD, lambda m: ALIKE.get(m[0], "" if unicodedata.category(m[0]) == "Cf" else unicodedata.normalize("NFKC", m[0])))
    if spelled:
        text, begin, end = _rewrite(text, begin, end, _SPELLED, lambda m: m[0])
        for m in reversed(list(_SPELLED.finditer(text))):
            part, b, e = _rewrite(m[0], begin[m.start() : m.end()], end[m.start() : m.end()], _DIGIT_WORD, lambda d: DIGITS[re.match(r"\w+", d[0])[0].lower()])
            text = text[: m.start()] + part + text[m.end() :]
            begin[m.start() : m.end()], end[m.start() : m.end()] = b, e
    text, begin, end = _rewrite(text, begin, end, _DOT, ".")
    text, begin, end = _rewrite(text, begin, end, _AT, "@")
    return text, begin, end


_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+-.")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+")
_EXT = r"(?:[ ,]{0,2}(?:ext(?:ension)?\.?|x)[ ]?\d{1,6}\b)?"
_PHONE = re.compile(
    r"(?<![\w+.-])(?:"
    r"(?:\+|00)1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:\+|00)33[ .-]?(?:\(0\))?\d(?:[ .-]?\d{2}){4}"
    r"|(?:\+|00)44[ .-]?(?:\(0\)[ ]?)?(?:\d{2}[ .-]?\d{4}[ .-]?\d{4}|\d{3}[ .-]?\d{3}[ .-]?\d{4}|\d{4}[ .-]?\d{6})"
    r"|(?:\+|00)34[ .-]?\d{3}(?:[ .-]?\d{3}){2}"
    r"|\+\d{2,3}[ .-]?(?:\(0\)[ ]?)?\d{2,4}[ .-]\d{3,8}(?:[ .-]\d{2,4})?"
    r"|\+[2-9]\d{7,13}"
    r"|(?:1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4}[ -/]\d{3,4}[ -]\d{3,4}"
    r"|\+\d{1,3}[ .-]\d{1,4}(?:[ .-]\d{2,4}){2,4}"
    r")(?![\w-]*\d)" + _EXT
)
_ID = re.compile(
    r"(?<![\w+.$€-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{7,8}[A-Z]?|\d{8}-?[A-Z]|\d{9})(?![\w-]*\d)(?!\w)"
)
_SURE = re.compile(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]")
_ID_CUE = re.compile(r"\b(?:id|ids|ssn|nino|tin|nif|dni|nie|passport|passeport|pasaporte|reisepass|security|insurance|tax|identit\w+|identidad|ausweis\w*|steuer\w*|num[ée]ro|n[úu]mero|number|no|licen[cs]e|register\w*)\b[^\n]{0,40}$", re.I)
#: A capital letter of the Latin, Greek or Cyrillic script.
_CAPITAL = "[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽȘȚΑ-ΩА-ЯЁ]"
_UP = rf"{_CAPITAL}[^\W\d_]*(?:['’-][^\W\d_]+)*"
#: What every address with a house number in front has; without it those layouts aren't tried.
_HOUSE = re.compile(rf"[0-9][A-Za-z]?(?: (?:bis|ter))?,? (?:{_CAPITAL}|rue |avenue |boulevard |place |chemin |allée )")
_CITY = rf"{_UP}(?:[ ](?:{PLACE})\b)?"
_TAIL = rf"(?:,[ ](?:Apt|Apartment|Suite|Unit|Flat)\.?[ ]\w+)?(?:,[ ]{_CITY})?(?:,[ ][A-Z]{{2}}[ ]\d{{5}}(?:-\d{{4}})?)?"
_ROAD = rf"{_UP}(?:[ ]{_UP}){{0,3}}[ ](?:Street|Road|Lane|Avenue|Boulevard|Blvd|Drive|Court|Way|Place|Square|Terrace|Crescent|Close|St|Rd|Ln|Ave|Dr|Ct|Sq|Pl)\b"
#: Address layouts by a piece of text each must contain (None: a house number in front).
_ADDRESSES = (
    ("Box", re.compile(rf"(?<![\w-])(?:P\.[ ]?O\.|PO)[ ]?Box[ ]\d+(?:,[ ]{_CITY})?(?:,[ ][A-Z]{{2}}[ ]\d{{5}})?")),
    (None, re.compile(rf"(?<![\w,.-])(?:(?:Flat|Apt|Unit|Suite)\.?[ ]\w+,[ ])?\d{{1,5}}[A-Za-z]?[ ]{_ROAD}(?:\.(?=,))?{_TAIL}")),
    (None, re.compile(rf"(?<![\w-])\d{{1,4}}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|allée)[ ](?:(?:de la|de|du|des)[ ])?{_UP}(?:[ ]{_UP}){{0,2}}(?:,[ ]\d{{5}}[ ]{_CITY})?")),
    ("str", re.compile(rf"(?<![\w-]){_UP}(?:(?<=straße)|(?<=strasse)|(?<=str)\.)[ ]\d{{1,4}}[a-z]?(?:,[ ]\d{{5}}[ ]{_CITY})?")),
    ("Calle", re.compile(rf"(?<![\w-])Calle[ ]{_UP}(?:[ ]{_UP}){{0,2}},?[ ]\d{{1,4}}(?:,[ ](?:\d{{5}}[ ])?{_CITY})?")),
    ("Via", re.compile(rf"(?<![\w-])(?:Via|Viale)[ ](?:(?:della|delle|dei|del|di|de)[ ])?{_UP}(?:[ ]{_UP}){{0,2}},?[ ]\d{{1,4}}(?:,[ ](?:\d{{5}}[ ])?{_CITY})?")),
    ("Piazza", re.compile(rf"(?<![\w-])Piazza[ ](?:(?:della|delle|dei|del|di|de)[ ])?{_UP}(?:[ ]{_UP}){{0,2}},?[ ]\d{{1,4}}(?:,[ ](?:\d{{5}}[ ])?{_CITY})?")),
    ("Avenida", re.compile(rf"(?<![\w-])Avenida[ ]{_UP}(?:[ ]{_UP}){{0,2}},?[ ]\d{{1,4}}(?:,[ ](?:\d{{5}}[ ])?{_CITY})?")),
)
#: One word of a name, whose letters may have been broken by a wrong decoding.
_W = r"(?:[^\W\d_]|Ã[\u0080-¿€™œžŸŠš‹›“”‘’•–—]|�)+(?:['’-](?:[^\W\d_]|Ã[\u0080-¿€™œ]|�)+)*"
_NAME = rf"(?:(?:[A-Za-z]\.[ \t]?){{1,3}}[ \t]?{_W}|{_W}(?:[ \t]+[A-Za-z]\.){{0,2}}[ \t]+{_W}|{_W},[ \t]+(?:{_W}(?:[ \t]+[A-Za-z]\.){{0,2}}|(?:[A-Za-z]\.[ \t]?){{1,2}}))"
_TITLE = r"(?:(?:dr|mr|mrs|ms|miss|prof|professor|sir|herr|frau|mme|m|sr|sra|dra)\.?[ \t]+)?"
_HONORIFIC = {"dr.", "dr", "mr.", "mr", "mrs.", "mrs", "ms.", "ms", "miss", "prof.", "prof", "professor", "sir", "herr", "frau", "mme", "sr.", "sra.", "dra."}
#: What commonly stands before a person's name, in everyday English, French, German and Spanish; the corpus adds its own.
NAME_CUES = [
    "contact", "contact person", "attn", "attention", "name:", "signed", "signed by", "written by", "sent by", "prepared by", "approved by", "reviewed by", "checked by", "witnessed by", "thanks to", "according to", "speak to", "speak with", "spoke to",
    "spoke with", "write to", "please call", "please ask", "contactez", "au nom de", "à l'attention de", "ansprechpartner ist", "ansprechpartner:", "im namen von", "zu händen von", "escribir a", "a nombre de", "dirigirse a", "issued to", "ausgestellt für", "délivré à", "expedido a",
]
_PAIR = re.compile(rf"(?P<first>{_CAPITAL}(?<![^\W_].)[^\W\d_]*(?:['’-][^\W\d_]+)*)(?=(?P<rest>(?:[ \t][A-Z]\.){{0,2}}[ \t]+{_UP})(?![^\W_]))")
_AT_CUE = re.compile(rf"[ \t]*[:,]?[ \t]+{_TITLE}(?P<name>{_NAME})", re.I)
_UP_TO = re.compile(rf"(?<![^\W_])(?P<name>{_NAME})$", re.I)


def _masked(text: str) -> str:
    """The text in lower case, of the same length, with ``#`` for every digit."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have no lower case of one character
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for d in "0123456789":
        low = low.replace(d, "#")
    return low


_ONE_DIGIT = re.compile("[0-9]")
_STRETCH = re.compile(r"\d[\d().\-/ \t]{3,}\d")
#: Candidates a context needs, the share of them that must begin with a known given name, and the share (of all candidates) it needs:
#: at most ``1 / LEAST`` contexts of each kind are ever sent to the tasks, whatever the corpus.
MIN_SEEN, PURITY, LEAST = 5, 0.5, 1e-5


class Contexts:
    """What a corpus says about names and identity numbers: contexts before and behind them, and second words of anything but people."""

    def __init__(self, rows: list[tuple[str, str]] = ()):
        kind = lambda k: {v for t, v in rows if t == k}
        self.before, self.behind, self.id_before, self.id_behind, self.classes = map(kind, ("L", "R", "l", "r", "Y"))
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        """Finds every learned context and common cue in a masked text."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for side, known in (("R", self.behind), ("L", self.before | set(NAME_CUES))):
                for c in known:
                    self._automaton.add_word(c, (self._automaton.get(c, ("", 0))[0] + side, len(c)))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton


def _short(piece: str) -> str:
    """As ``_masked`` for a few words."""
    return _ONE_DIGIT.sub("#", piece.lower())


def _left(text: str, at: int) -> tuple[str, str]:
    """The last two and the last one of the blank-separated pieces before ``at`` on its line, masked."""
    line = text[text.rfind("\n", 0, at) + 1 : at].rsplit(None, 2)[-2:]
    one = _short(line[-1]) if line else ""
    return f"{_short(line[0])} {one}" if len(line) > 1 else "", one


def _right(text: str, at: int) -> str:
    """The next two pieces behind ``at`` on its line, masked; empty if there is only one."""
    end = text.find("\n", at)
    words = text[at : end if end >= 0 else len(text)].split(None, 2)[:2]
    return _short(" ".join(words)) if len(words) == 2 else ""


def _listed(word: str) -> bool:
    w = word.lower()
    return w in GIVEN or (not w.isascii() and fold(w) in GIVEN)


def _last_words(text: str, line: int, stop: int, n: int) -> list[int]:
    """Where the last n blank-separated words of a line begin, nearest first, marks before a word left out."""
    out, at = [], stop
    while at > line and len(out) < n:
        begin = at
        while begin > line and text[begin - 1] not in " \t":
            begin -= 1
        first = begin
        while first < at and not text[first].isalpha():
            first += 1
        out.append(first)
        at = begin
        while at > line and text[at - 1] in " \t":
            at -= 1
    return out


def evidence(text: str) -> Iterator[tuple[str, str, bool, int]]:
    """(kind of context, context, whether the candidate is known by itself, a hash of the candidate) of the capitalised pairs and numbers of a text."""
    norm = text  # disguises are rare enough to learn without them
    for m in _PAIR.finditer(norm):
        first, rest = m["first"], m["rest"]
        if first.isupper() and rest.isupper():
            continue
        strong, h = _listed(first), hash_of(first + rest)
        two, one = _left(norm, m.start())
        strong = strong or one in _HONORIFIC
        for kind, c in (("L", two), ("L", one), ("R", _right(norm, m.end("rest")))):
            if len(c) > 2:
                yield kind, c, strong, h
        yield "Y", rest.split()[-1].lower(), strong, hash_of(first)
    for m in _numbers(norm, _ID):
        sure = bool(_SURE.fullmatch(m[0]))
        two, one = _left(norm, m.start())
        for kind, c in (("l", two), ("l", one), ("r", _right(norm, m.end()))):
            if len(c) > 1:
                yield kind, c, sure, hash_of(m[0])


def hash_of(text: str) -> int:
    """One of 63 bits, by the text's checksum: a set of these tells roughly how many different texts were seen."""
    return 1 << (zlib.crc32(text.encode("utf-8", "surrogatepass")) % 63)


def _numbers(norm: str, pattern: re.Pattern) -> Iterator[re.Match]:
    """Matches of a pattern around the stretches of five or more characters that begin and end in a digit."""
    last = 0
    for s in _STRETCH.finditer(norm):
        at, stop = max(last, s.start() - 6), min(len(norm), s.end() + 48)
        while m := pattern.search(norm, at, stop):
            if m.start() >= s.end():
                break
            yield m
            at = last = m.end()


def learn(df: DataFrame, text_col: str = "text") -> Contexts:
    """The contexts of names and identity numbers in a corpus, counted over all of it.

    Candidates are pairs of capitalised words and numbers shaped like an identity
    number. What stands before and behind them (two words, or the one before) is a
    context; it is learned if at least ``PURITY`` of its candidates are known by
    themselves (a common given name or a title; a number of unmistakable shape) and
    enough different ones were seen. Second words that follow many different first
    words, hardly ever given names, are classes of things: products, places, firms.
    Each task sends one row per context, with a 63-bit sketch of its candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(3))], names=["kind", "context", "n", "known", "bits"]
            )

        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, context, strong, bit in evidence(text):
                    at = seen.get((kind, context))
                    if at is None:
                        seen[kind, context] = [1, int(strong), bit]
                    else:
                        at[0] += 1
                        at[1] += strong
                        at[2] |= bit
            if len(seen) > 500_000:
                yield rows()
                seen.clear()
        yield rows()

    texts = df.select(F.col(text_col).alias("text")).filter("text is not null")
    counted = texts.mapInArrow(run, "kind string, context string, n bigint, known bigint, bits bigint").groupBy("kind", "context").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.expr("bit_or(bits)").alias("bits"))
    counted = stage(counted.filter(F.col("n") >= MIN_SEEN))
    total = counted.groupBy("kind").agg(F.sum("n").alias("all"))  # five rows
    different, share = F.bit_count("bits"), F.col("known") / F.col("n")
    fits = F.when(F.col("kind") == "Y", (different >= 12) & (share < 0.2)).when(F.col("kind").isin("l", "r"), (different >= MIN_SEEN - 1) & (share >= 0.2)).otherwise((different >= MIN_SEEN - 1) & (share >= PURITY))
    inside = F.when(F.col("kind").isin("L", "l"), ~F.col("context").rlike(r"[.!?]$") | F.col("context").isin(*sorted(_HONORIFIC))).when(F.col("kind") == "Y", True).otherwise(~F.col("context").rlike(r"^[.!?]"))  # of one sentence
    kept = counted.join(F.broadcast(total), "kind").filter(inside & fits & (F.col("n") >= LEAST * F.col("all")))
    return Contexts([(r["kind"], r["context"]) for r in kept.select("kind", "context").collect()])


def _is_name(name: str, cued: bool, classes: set[str] = frozenset()) -> bool:
    words = [fold(w) for w in re.split(r"[\s,]+", name) if len(w.strip(".")) > 1]
    if not words or any(w in NOT_SURNAME or w in FUNCTION_WORDS for w in words) or words[-1] in classes:
        return False
    known = any(w in GIVEN or w.split("-")[0] in GIVEN for w in words)
    initials = bool(re.search(r"(?<![^\W\d_])[A-Z]\.", name))
    shaped = all(w[:1].isupper() for w in re.split(r"[\s,]+", name) if w)
    return known or (cued and shaped and initials) or (cued and shaped and len(words) > 1)


def _names(norm: str, contexts: Contexts) -> Iterator[tuple[int, int, int, str]]:
    """Names before or behind a learned context or a common cue, and capitalised pairs that begin with a listed given name."""
    masked = _masked(norm)
    automaton = contexts.automaton()
    for end, (sides, length) in automaton.iter(masked) if len(automaton) else ():
        begin, end = end + 1 - length, end + 1
        for side in sides:
            if side == "L" and (begin == 0 or not (masked[begin - 1].isalnum() and masked[begin].isalnum())):
                m = _AT_CUE.match(norm, end)
                if m and _is_name(m["name"], True, contexts.classes):
                    yield (4, *m.span("name"), "name")
            elif side == "R" and (end == len(masked) or not masked[end].isalnum() or not masked[end - 1].isalnum()):
                stop = begin
                while stop and norm[stop - 1] in " \t":
                    stop -= 1
                if stop == begin and masked[begin].isalnum():
                    continue
                words = _last_words(norm, norm.rfind("\n", 0, stop) + 1, stop, 4)
                for n in (4, 3, 2):  # the longest stretch that is a name
                    if len(words) >= n and (m := _UP_TO.match(norm, words[n - 1], stop)) and _is_name(m["name"], True, contexts.classes):
                        yield (4, *m.span("name"), "name")
                        break
    for m in _PAIR.finditer(norm):
        first, rest = m["first"], m["rest"]
        if _listed(first):
            if _is_name(first + rest, False, contexts.classes):
                yield (5, m.start(), m.end("rest"), "name")
        elif _left(norm, m.start())[1] in _HONORIFIC and _is_name(first + rest, True, contexts.classes):
            yield (5, m.start(), m.end("rest"), "name")


_PLAIN = Contexts()


def details(text: str, contexts: Contexts = _PLAIN) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the personal details of a text, in order and without overlap, as offsets of the text itself."""
    norm, begin, end = deobfuscate(text)
    found: list[tuple[int, int, int, str]] = []
    at = norm.find("@")
    while at >= 0:
        start = at
        while start and norm[start - 1] in _LOCAL:
            start -= 1
        while start < at and norm[start] == ".":
            start += 1
        if ".." in norm[start:at]:
            start = norm.rfind("..", start, at) + 2
        domain = _DOMAIN.match(norm, at + 1)
        if domain and start < at and norm[at - 1] != ".":
            found.append((0, start, domain.end(), "email"))
        at = norm.find("@", at + 1)
    house = _HOUSE.search(norm) is not None
    for must, layout in _ADDRESSES:
        if house if must is None else must in norm:
            found += [(1, *m.span(), "address") for m in layout.finditer(norm)]
    found += [(2, *m.span(), "phone") for m in _numbers(norm, _PHONE)]
    for m in _numbers(norm, _ID):
        sure = _SURE.fullmatch(m[0]) or _ID_CUE.search(norm, norm.rfind("\n", 0, m.start()) + 1, m.start())
        if not sure:
            two, one = _left(norm, m.start())
            sure = two in contexts.id_before or one in contexts.id_before or _right(norm, m.end()) in contexts.id_behind
        if sure:
            found.append((3, *m.span(), "id_number"))
    found += _names(norm, contexts)
    taken: list[tuple[int, int, str]] = []
    for _, b, e, kind in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if all(e <= x or b >= y for x, y, _ in taken):
            taken.append((b, e, kind))
    taken.sort()
    return taken if begin is None else [(begin[b], end[e - 1], k) for b, e, k in taken]


def find_details(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: Contexts | None = None) -> DataFrame:
    """``(id, begin, end, kind, value)`` of each detail; offsets count code points, ``value`` is exactly that stretch of the text.

    Rows with a null text have no detail; a null id is kept; of several rows under
    one id each is searched. The corpus is read twice: its contexts are learned first
    (``learn``, unless ``contexts`` are given), and only they are shuffled.
    """
    contexts = learn(df, text_col) if contexts is None else contexts
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, b, e, k, t[b:e]) for i, t in enumerate(batch.column(1).to_pylist()) for b, e, k in details(t, contexts)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(cols[0], dtype=np.int64))), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.string(), pa.string())))],
                names=["id", "begin", "end", "kind", "value"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, begin int, end int, kind string, value string").withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: Contexts | None = None) -> DataFrame:
    """``(id, text, n_details)``: every text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]`` in place of each detail; null stays null."""
    contexts = learn(df, text_col) if contexts is None else contexts
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                found = details(t, contexts) if t else []
                for b, e, k in reversed(found):
                    t = f"{t[:b]}[{k.upper()}]{t[e:]}"
                texts.append(t)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["id", "text", "n_details"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, n_details int").withColumnsRenamed({"id": id_col, "text": text_col})
