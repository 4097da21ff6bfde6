"""Text measures as Column to Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that must equal those of the measures reproduced here, in their usual order.
FLS_KEYWORDS = [
    "will", "expect", "expects", "expected", "expecting", "anticipate", "anticipates", "anticipated", "anticipating", "guidance", "outlook", "forecast", "project", "projected", "projecting", "plan", "plans", "planned", "planning",
    "believe", "believes", "intend", "intends", "estimate", "estimates", "estimated", "target", "targets", "goal", "goals", "aim", "aims", "predict", "predicts", "foresee", "foresees", "going forward", "next quarter", "next year",
    "fiscal year", "forward-looking", "future", "upcoming", "pipeline",
]
FILLERS = ["um", "uh", "you know", "sort of", "kind of", "basically", "actually", "honestly", "frankly", "obviously", "clearly", "essentially", "effectively", "literally"]
DEFLECTIONS = [
    "as i mentioned", "as we mentioned", "as i said", "as we said", "as i noted", "as we noted", "as discussed", "i think i addressed", "we already covered", "let me come back to", "let me get back to",
    "i'll let", "i would refer you to", "we'll see", "we will see", "time will tell", "it's hard to say", "it's difficult to predict", "i don't want to speculate", "we don't speculate",
    "i'm not going to get into", "we're not going to comment", "i can't really", "we can't really", "that's a great question", "that's a good question", "it depends", "it really depends",
    "we'll have more to say", "more to come on that", "stay tuned", "too early to tell",
]
PASSIVE = r"\b(?:is|are|was|were|been|be|being)\s+(?:\w+ly\s+)?(?:\w+ed|driven|given|taken|made|done|seen|known|shown|found)\b"
FIRST_PERSON = r"\b(?:i|we|our|us|my)\b"
THIRD_PERSON = r"\b(?:it|they|them|the company|the team|the business|management)\b"
NUMBER = r"\b\d[\d,]*\.?\d*\b"
DOLLAR = r"(?i)\$[\d,]+\.?\d*\s*(?:million|billion|thousand|m|b|k)?"
PERCENT = r"(?i)\d+\.?\d*\s*%|percent"
BASIS_POINTS = r"(?i)\d+\s*(?:basis points|bps)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case whitespace tokens, punctuation attached."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def plain_tokens(text: Column) -> Column:
    """Lower-case tokens with everything but letters, digits and underscores taken for blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+", " "), " +"), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-case runs of Latin letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z']+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of runs of letters, marks, digits and underscores of any script."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+"))


def all_sentences(text: Column) -> Column:
    """Every piece of the text between ends of sentences (``.``, ``!`` or ``?`` before white space), however short."""
    return F.split(text, r"(?<=[.!?])\s+")


def sentences(text: Column, min_length: int = 10) -> Column:
    """Sentences of the stripped text longer than ``min_length`` characters."""
    return F.filter(all_sentences(strip(text)), lambda s: F.length(s) > min_length)


def stripped_sentences(text: Column, min_length: int = 10) -> Column:
    """Sentences stripped one by one; those longer than ``min_length`` characters then."""
    return F.filter(F.transform(all_sentences(text), strip), lambda s: F.length(s) > min_length)


def sentence_count(text: Column) -> Column:
    return F.greatest(F.size(sentences(text)), F.lit(1))


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word without its final e's, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(word, "e+$", ""), F.lit("[aeiou]+")))


def count_any(text: Column, phrases: list[str]) -> Column:
    """Occurrences of all phrases as substrings, each counted on its own; most phrases are ruled out by a plain search."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.when(F.contains(text, F.lit(p)), F.regexp_count(text, F.lit("\\Q" + p + "\\E"))).otherwise(0)
    return total


def contains_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda k: F.contains(text, k))


def lexicon_hits(found: Column, lexicon: list[str]) -> Column:
    """How many of the distinct tokens are in the lexicon: a look-up in one hash set per token, however long the list."""
    return F.size(F.filter(found, lambda w: w.isin(list(lexicon))))


def lexicon_scores(text: Column, positive: list[str], negative: list[str], uncertain: list[str]) -> Column:
    """Struct of positive, negative, net and uncertainty shares of a text's distinct whitespace tokens."""

    def shares(seen: Column) -> Column:
        counts = F.struct(F.greatest(F.size(seen), F.lit(1)).alias("n"), *[lexicon_hits(seen, x).alias(c) for c, x in (("p", positive), ("m", negative), ("u", uncertain))])
        return let(counts, lambda c: F.struct((c["p"] / c["n"]).alias("pos"), (c["m"] / c["n"]).alias("neg"), ((c["p"] - c["m"]) / c["n"]).alias("net"), (c["u"] / c["n"]).alias("unc")))

    return let(F.array_distinct(tokens(text)), shares)


def readability(text: Column) -> Column:
    """Struct of fog, flesch_kincaid, sentence_length, word_length and richness; zeros where there is no sentence or word.

    Words are extracted once; syllables are counted by patterns over all of them at
    once (``<word><word>`` without final e's), not word by word.
    """

    def measures(x: Column) -> Column:
        w, ns, v = x["w"], x["ns"], x["v"]
        n, count = F.size(w), lambda p: F.regexp_count(v, F.lit(p))
        sums = F.struct(
            n.alias("n"), ns.alias("ns"), (count("[aeiou]+") + count("<[^aeiou>]*>")).alias("syl"), count("<[^aeiou>]*[aeiou]+[^aeiou>]+[aeiou]+[^aeiou>]+[aeiou]").alias("long"),
            F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("kinds"),
        )
        return let(sums, out)

    def out(m: Column) -> Column:
        n, per = m["n"], m["n"] / m["ns"]
        zero = lambda c: F.when((m["ns"] > 0) & (n > 0), c).otherwise(F.lit(0.0))
        return F.struct(
            zero(0.4 * (per + 100 * m["long"] / n)).alias("fog"),
            zero(0.39 * per + 11.8 * m["syl"] / n - 15.59).alias("flesch_kincaid"),
            zero(per).alias("sentence_length"),
            zero(m["chars"] / n).alias("word_length"),
            zero(m["kinds"] / n).alias("richness"),
        )

    marked = lambda w: F.regexp_replace(F.concat(F.lit("<"), F.array_join(w, "><"), F.lit(">")), "e+>", ">")
    ns = F.size(sentences(text))
    return let(words(text), lambda w: let(F.struct(w.alias("w"), ns.alias("ns"), marked(w).alias("v")), measures))


def forward_looking(text: Column, keywords: list[str] = FLS_KEYWORDS) -> Column:
    """Struct of the share of sentences with a keyword (as substring) and the number of keywords in the text."""
    s = sentences(text)
    n = F.size(s)
    hit = F.size(F.filter(s, lambda x: contains_any(F.lower(x), keywords)))
    kinds = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), k)))
    return F.struct(F.when(n > 0, hit / n).otherwise(F.lit(0.0)).alias("fls_ratio"), F.when(n > 0, kinds).otherwise(F.lit(0)).alias("fls_count"))


def specificity(text: Column) -> Column:
    n, d, p, b = (F.regexp_count(text, F.lit(x)) for x in (NUMBER, DOLLAR, PERCENT, BASIS_POINTS))
    s = sentence_count(text)
    return F.struct((n / s).alias("numbers_per_sentence"), d.alias("dollar_mentions"), (p + b).alias("percent_mentions"), ((n + 2 * d + 2 * p + 2 * b) / s).alias("specificity_score"))


def normalize_score(score: Column, method: str) -> Column:
    """A score on [-1, 1]: lexicon scores are stretched tenfold, unknown methods pass."""
    if method not in ("vader", "finbert", "lm"):
        return score
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score * (10 if method == "lm" else 1)))


def citations(text: Column) -> Column:
    """Sorted distinct numbers of ``[n]``."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))))


#: Role by words of a title, first that fits. Fixed values, in order of precedence: they must equal those of the measures reproduced here.
ROLE_WORDS = (
    ("CEO", ["chief executive", "ceo", "president and ceo"]),
    ("CFO", ["chief financial", "cfo", "finance officer"]),
    ("COO", ["chief operating", "coo"]),
    ("CTO", ["chief technology", "cto"]),
    ("VP", ["vice president", "vp", "svp", "evp"]),
    ("IR", ["investor relations", "ir "]),
    (
        "Analyst",
        [
            "analyst", "research", "securities", "capital", "bank", "morgan", "goldman", "barclays", "citi", "jpmorgan", "ubs", "wells fargo", "deutsche", "credit suisse", "bernstein", "piper", "canaccord", "raymond james", "cowen",
            "needham", "oppenheimer", "baird", "evercore", "keybanc", "mizuho", "bmo", "rbc", "loop capital", "moffett", "moffettnathanson", "jefferies", "wolfe", "stifel", "truist", "wedbush", "macquarie", "scotiabank", "william blair",
            "susquehanna", "rosenblatt",
        ],
    ),
    ("Operator", ["operator", "conference call"]),
)


def role_of_title(title: Column) -> Column:
    """Role by substring of the title; empty or null is Unknown, no match Other."""
    t = F.lower(title)
    out = F.when(F.coalesce(title, F.lit("")) == "", F.lit("Unknown"))
    for role, keys in ROLE_WORDS:
        out = out.when(contains_any(t, keys), F.lit(role))
    return out.otherwise(F.lit("Other"))


#: Phrases that open the question part. Fixed values, in natural order.
QA_CUES = [
    "questions and answers:", "question-and-answer", "q&a session", "question and answer session", "we'll now take questions", "we will now take questions", "open the call to questions", "open it up for questions",
    "open the line for questions", "operator, please open", "first question", "our first question", "go to q&a", "move to q&a", "move over to q&a", "let's go to q&a", "let's move to q&a",
]


def qa_boundary(text: Column, cues: list[str] = QA_CUES) -> Column:
    """1-based position of the first cue in the last four fifths of the text, else one past its end."""
    low, least = F.lower(text), F.floor(F.length(text) / 5).cast("int") + 1
    at = [F.call_function("locate", F.lit(c), low, least) for c in cues]
    return F.coalesce(F.least(*[F.when(a > 0, a) for a in at]), F.length(text) + 1)


def section_cue(text: Column, cues: list[str] = QA_CUES) -> Column:
    """``qa`` for a text with any of the cues, else ``prepared_remarks``."""
    return F.when(contains_any(F.lower(text), cues), F.lit("qa")).otherwise(F.lit("prepared_remarks"))


def turn_section(turn: Column, text: Column, boundary: Column, least: int = 100) -> Column:
    """``qa`` for a turn whose first ``least`` characters occur at or after the boundary of its text, else ``prepared_remarks``; a shorter turn counts as at the beginning."""
    at = F.when(F.length(turn) >= least, F.call_function("locate", F.substring(turn, 1, least), text)).otherwise(F.lit(1))
    return F.when(at >= boundary, F.lit("qa")).otherwise(F.lit("prepared_remarks"))


#: What notices look like that aren't part of a call. Fixed values, in order: they must equal those of the measures reproduced here.
BOILERPLATE = [
    r"(?is)safe\s+harbor.{0,500}?(?=\n\n|\n(?-i:[A-Z][a-z]))",
    r"(?is)forward[- ]looking\s+statements?.{0,500}?(?=\n\n|\n(?-i:[A-Z][a-z]))",
    r"(?i)this\s+(?:call|transcript)\s+(?:is\s+)?(?:being\s+)?recorded.*?\n",
    r"(?i)copyright\s+©?.*?\n",
    r"(?i)all\s+rights\s+reserved.*?\n",
    r"(?i)(?:the\s+)?motley\s+fool.*?\n",
    r"(?i)fool\.com.*?\n",
]


def strip_boilerplate(text: Column, patterns: list[str] = BOILERPLATE) -> Column:
    """Without safe-harbour passages and recording, copyright, rights and publisher's notices; blank lines collapsed."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def highlight(text: Column, lexicons: list[tuple[str, list[str]]], limit: int | None = None) -> Column:
    """The text's words with ``<label>word</label>`` around those of a lexicon; the first lexicon that has the word counts."""
    body = text if limit is None else F.substring(text, 1, limit)

    def mark(w: Column) -> Column:
        return let(F.regexp_replace(F.lower(w), r"^[^a-z0-9]+|[^a-z0-9]+$", ""), lambda core: marked(w, core))

    def marked(w: Column, core: Column) -> Column:
        out = None
        for label, lex in lexicons:
            hit, new = core.isin(list(lex)), F.concat(F.lit(f"<{label}>"), w, F.lit(f"</{label}>"))
            out = F.when(hit, new) if out is None else out.when(hit, new)
        return out.otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(body, r"\s+"), lambda w: w != ""), mark), " ")


def highlight_phrases(text: Column, phrases: list[str], limit: int = 400, label: str = "risk") -> Column:
    """An excerpt of ``limit`` characters around the earliest phrase, with ``<label>`` around every phrase; longer phrases win over those inside them."""
    first = let(F.lower(text), lambda low: F.array_min(F.filter(F.transform(F.array(*map(F.lit, phrases)), lambda k: F.call_function("locate", k, low)), lambda p: p > 0)))
    begin = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - limit // 2)
    either = "|".join("\\Q" + p + "\\E" for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return F.regexp_replace(F.substring(text, begin, F.lit(limit)), f"(?i)({either})", f"<{label}>$1</{label}>")
