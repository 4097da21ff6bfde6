"""Variant spellings of people and companies: a symmetric-delete index on tokens, then optimal token assignment."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.graph import connected_components
from earshot.storage import bounded_broadcast, shuffled, stage

#: Short forms of given names. Everyday English usage.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alexandra", "al": "albert alan alexander", "andy": "andrew andrea", "ana": "anastasia", "bart": "bartholomew",
    "becky": "rebecca", "becca": "rebecca", "ben": "benjamin", "benji": "benjamin", "bernie": "bernard", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine katherine", "charlie": "charles", "chris": "christopher christine christina",
    "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri",
    "don": "donald", "dora": "theodora", "doug": "douglas", "drew": "andrew", "ed": "edward edwin", "eddie": "edward", "ellie": "eleanor", "eliza": "elizabeth", "fran": "francesca frances",
    "frank": "francis franklin", "fred": "frederick", "gabe": "gabriel", "gene": "eugene", "gerry": "gerald", "greg": "gregory", "gus": "augustus", "hal": "harold", "hank": "henry",
    "harry": "harold henry", "jack": "john jackson", "jackie": "jacqueline", "jake": "jacob", "jamie": "james", "jan": "janet", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer",
    "jerry": "gerald jerome", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "josh": "joshua", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "ken": "kenneth", "kit": "christopher", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "lucy": "lucia lucille",
    "maggie": "margaret", "marc": "marcus", "marge": "margaret", "matt": "matthew mateo", "meg": "margaret", "mick": "michael", "mike": "michael", "mitch": "mitchell", "nat": "nathaniel",
    "nate": "nathaniel nathan", "nathan": "nathaniel", "nick": "nicholas", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pete": "peter",
    "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "sandra alexander",
    "sasha": "alexander", "si": "simon", "stan": "stanley", "steph": "stephanie", "steve": "stephen steven", "sue": "susan", "susie": "susan", "suzy": "susan", "ted": "edward theodore", "teddy": "edward theodore",
    "terry": "theresa terence", "tess": "theresa", "tessa": "theresa", "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "tori": "victoria",
    "trish": "patricia", "tricia": "patricia", "val": "valerie", "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria", "vince": "vincent", "walt": "walter", "will": "william", "zac": "zachary",
    "zach": "zachary", "zack": "zachary", "zander": "alexander",
}
HONORIFICS = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "sir", "dame", "mx"}
SUFFIXES = {"cfa", "cpa", "phd", "md", "mba", "jr", "sr", "ii", "iii", "iv", "esq"}
OPERATOR = {"operator", "conference", "call", "the", "coordinator"}
UNKNOWN = re.compile(r"(speaker|participant|unknown|unidentified|unnamed|anonymous|attendee|n/?a|none|null|tbd|analyst|executive|management|moderator|company|representative|caller|person|male|female|voice|nan)(\W|\d|$)", re.I)


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(str.maketrans({"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "’": "'"})))
    return "".join(c for c in text if not unicodedata.combining(c))


def roots(token: str) -> tuple[str, ...]:
    return (token, *NICKNAMES.get(token, "").split())


#: Letters a word needs to be taken for another one edit away, two edits away, and so on.
EDIT_LENGTHS = (4, 20)


def allowed(length: int, lengths: tuple[int, ...] = EDIT_LENGTHS) -> int:
    """Edits that a word of so many letters may have."""
    return sum(length >= n for n in lengths)


def deletes(token: str, lengths: tuple[int, ...] = EDIT_LENGTHS) -> set[str]:
    """The token and what is left without as many of its letters as it may have edits. Two tokens within their allowed edits (or swaps of neighbours) share an element."""
    out = level = {token}
    for _ in range(allowed(len(token), lengths)):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def edits(a: str, b: str, most: int = len(EDIT_LENGTHS)) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that make one word the other, ``most + 1`` if it takes more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            new.append(c)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def alike(a: str, b: str) -> bool:
    """Whether two words are equal or, if both have 3 letters, within the edits that the longer may have."""
    return a == b or (min(len(a), len(b)) >= 3 and edits(a, b) <= allowed(max(len(a), len(b))))


def assign(cost: list[list[float]]) -> float:
    """Least total over all assignments of the rows to different columns (at least as many as rows), by shortest augmenting paths; O(rows^2 * columns)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            if delta == math.inf:
                return math.inf
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sum(cost[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def abbreviates(short: str, long: str) -> bool:
    """Same first letter, shorter, and its letters occur in order."""
    if not (1 <= len(short) < len(long)) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def person(raw: str | None) -> tuple[str, list[str], list[str]]:
    """(kind, words, initials) of a typed name: kind is full, initial, single, operator or unknown. Words are in the order first to last."""
    text = re.sub(r"\s+", " ", fold(raw or "")).strip(" .,;:-–—*[](){}<>\"'")
    if not re.search(r"[^\W\d_]", text):
        return "unknown", [], []
    words = [w for w in re.split(r"[\s.]+", re.sub(r"[,;:()\[\]]", " ", text)) if w]
    if "operator" in words and set(words) <= OPERATOR:
        return "operator", [], []
    if UNKNOWN.match(text) or re.search(r"\d", text):
        return "unknown", [], []
    parts = [p.strip() for p in text.split(",")]
    parts = [p for p in parts if p and not set(re.split(r"[\s.]+", p.strip("."))) <= SUFFIXES]
    if len(parts) > 1:
        parts = [" ".join(parts[1:]), parts[0]]
    words = [re.sub(r"[^\w]", "", w) for w in re.split(r"[\s.]+", " ".join(parts))]
    words = [w for i, w in enumerate(words) if w and w not in HONORIFICS and not (i and w in SUFFIXES)]
    full, initials = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    return ("full" if len(full) > 1 else "unknown" if not full else "initial" if initials else "single"), full, initials


def person_keys(kind: str, words: list[str], initials: list[str]) -> tuple[set[str], set[str]]:
    """Keys under which a name is posted, and keys under which a weak form (initials or one word) looks for full names."""
    own, weak = set(), set()
    if kind == "full":
        for i, x in enumerate(words):
            for j, y in enumerate(words):
                if i != j:
                    own |= {f"f {r} {d}" for r in roots(x) for s in roots(y) for d in deletes(s)}
                    weak |= {f"i {r[0]} {d}" for r in roots(x) for d in deletes(y)}
            weak |= {f"s {d}" for d in deletes(x)}
    elif kind == "initial":
        weak = {f"i {initials[0]} {d}" for w in words for d in deletes(w)}
    elif kind == "single":
        weak = {f"s {d}" for d in deletes(words[0])}
    return own, weak


def _token_cost(x: str, y: str) -> int:
    if set(roots(x)) & set(roots(y)):
        return 0
    return 1 if any(alike(r, s) for r in roots(x) for s in roots(y)) else 2


def name_cost(a: list[str], b: list[str]) -> int:
    """Least number of differing words (one within its allowed edits costs 1, another 2) over all assignments of the shorter name's words to the other's; 9 for a single word that isn't the other name."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2:
        return 0 if a == b else 9
    return int(assign([[_token_cost(x, y) for y in b] for x in a]))


def weak_cost(kind: str, words: list[str], initials: list[str], full: list[str]) -> int:
    """As ``name_cost`` for a weak form against a full name: its initial may stand for any other word of it."""
    best = 9
    for j, y in enumerate(full):
        c = 0 if words[0] == y else 1 if alike(words[0], y) else 2
        if c < 2 and (kind == "single" or any(r[0] == initials[0] for i, x in enumerate(full) if i != j for r in roots(x))):
            best = min(best, 2 * c + (0 if j == len(full) - 1 else 1))
    return best


def _company_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text).replace("'", ""))


def _as_ticker(raw: str) -> str:
    """The symbol in a typed ticker without exchange, currency mark or country, else an empty string."""
    m = re.fullmatch(r"\s*(?:\$|[A-Za-z]{2,8}\s*:\s*)?([A-Za-z0-9]{1,6})(?:\s*[-.:/ ]\s*[A-Za-z]{1,2})?\s*", raw)
    return m[1].lower() if m else ""


def company_cost(raw: str, ticker: str, name: str, rare: list[str]) -> float:
    """Cost of reading ``raw`` as the company; infinite if it can't be. One of the ``rare`` words, by which the name is known, must be there whole or one edit away."""
    best, symbol, own = float("inf"), _as_ticker(raw), ticker.strip().lower()
    if symbol:
        e = edits(symbol, own)
        # A swap of neighbours is the likelier slip: it wins over another company that is one letter away.
        best = float(e) if e == 0 else (0.9 if sorted(symbol) == sorted(own) else 1.0) if e == 1 and len(own) >= 4 else best
    typed, words = _company_tokens(raw), _company_tokens(name)
    if not typed or len(typed) > len(words):
        return best

    def one(x: str, y: str) -> float:
        return 0.0 if x == y else 0.25 if abbreviates(x, y) else 1.0 if alike(x, y) else math.inf

    cost = [[one(x, y) for y in words] for x in typed]
    for i, x in enumerate(typed):
        for j, y in enumerate(words):
            if y in rare and alike(x, y):  # the rest is assigned around the word by which the company is known
                rest = [[c for k, c in enumerate(row) if k != j] for r, row in enumerate(cost) if r != i]
                best = min(best, cost[i][j] + assign(rest) + 0.05 * (len(words) - len(typed)))
    return best


def resolve_companies(values: DataFrame, companies: DataFrame, value_col: str = "ticker", ticker_col: str = "ticker", name_col: str = "name") -> DataFrame:
    """``(raw, company)`` for the distinct non-null values of ``value_col`` that mean a company; the rest have no row.

    A value is read as a ticker (any case, exchange or country around it, one
    edit) or as a name (words left out, abbreviated or one edit away). Companies
    are posted under the deletion neighbourhoods of their ticker and of the
    rarest words of their name; a value meets only companies with which it shares
    one, and is given the one of least cost (below 3) if that is unique. Nulls, blanks and
    values that fit several companies equally well have no row.
    """
    raws = values.select(F.col(value_col).cast("string").alias("raw")).dropna().distinct()
    firm = companies.select(F.col(ticker_col).alias("ticker"), F.coalesce(F.col(name_col), F.lit("")).alias("name")).dropna().dropDuplicates(["ticker"])

    @F.pandas_udf("array<string>")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted(set(_company_tokens(x))))

    @F.pandas_udf("array<string>")
    def near(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted(deletes(x)))

    @F.pandas_udf("array<string>")
    def probes(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted({f"n{d}" for t in _company_tokens(x) for d in deletes(t)} | ({f"t{d}" for d in deletes(_as_ticker(x))} if _as_ticker(x) else set())))

    @F.pandas_udf("double")
    def cost(raw: pd.Series, ticker: pd.Series, name: pd.Series, rare: pd.Series) -> pd.Series:
        return pd.Series([company_cost(r, t, n, list(w)) for r, t, n, w in zip(raw, ticker, name, rare)], dtype="float64")

    word = firm.select("ticker", F.explode_outer(tokens("name")).alias("word"))
    word = word.withColumn("df", F.count("*").over(Window.partitionBy("word")))
    least = F.min("df").over(Window.partitionBy("ticker"))
    rare = word.withColumn("least", least).groupBy("ticker").agg(F.collect_set(F.when(F.col("df") == F.col("least"), F.col("word"))).alias("rare"))
    index = firm.join(shuffled(rare), "ticker")
    own = F.transform(near(F.lower(F.trim("ticker"))), lambda d: F.concat(F.lit("t"), d))
    known = index.select("ticker", "name", "rare", F.explode_outer("rare").alias("w")).select("ticker", "name", "rare", F.explode(F.transform(near(F.coalesce("w", F.lit(""))), lambda d: F.concat(F.lit("n"), d))).alias("key"))
    index = index.select("ticker", "name", "rare", F.explode(own).alias("key")).unionByName(known)
    meet = raws.select("raw", F.explode(probes("raw")).alias("key")).join(shuffled(index), "key").select("raw", "ticker", "name", "rare").distinct()
    scored = meet.withColumn("cost", cost("raw", "ticker", "name", "rare")).filter(F.col("cost") < 3)
    best = scored.groupBy("raw", "cost").agg(F.count("*").alias("n"), F.min("ticker").alias("company")).groupBy("raw").agg(F.min(F.struct("cost", "n", "company")).alias("b"))
    return best.filter("b.n = 1").select("raw", F.col("b.company").alias("company"))


def with_company(df: DataFrame, mapping: DataFrame, value_col: str = "ticker", out: str = "company") -> DataFrame:
    """``df`` with the company of its typed ticker; a value that means none stands for itself in upper case without blanks, null stays null."""
    m = bounded_broadcast(mapping.select(F.col("raw").alias("_raw"), F.col("company").alias("_company")))
    joined = df.join(m, df[value_col] == m["_raw"], "left")
    return joined.withColumn(out, F.coalesce("_company", F.nullif(F.upper(F.trim(F.col(value_col))), F.lit("")))).drop("_raw", "_company")


def link_people(names: DataFrame, scope_col: str = "company", name_col: str = "speaker") -> DataFrame:
    """``(scope, spelling, entity)`` of the distinct names in each scope; placeholders have no row.

    Full names meet under keys of one exact word and one word of another's
    deletion neighbourhood, and are linked if in the best assignment of their words
    at most one differs, by the edits its length allows (``EDIT_LENGTHS``), short
    forms of given names counting as equal, in any order, titles and middle
    initials aside, however many words there are. A form of initials or of one word
    joins the linked group it fits best, if only one fits so well; forms that fit
    no group but each other in surname and first initial are linked. All
    spellings of the operator in a scope are one entity. Nulls and names in a
    null scope are left out; nothing is linked across scopes.
    """
    spark = names.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    typed = names.select(F.col(scope_col).alias("scope"), F.col(name_col).alias("spelling")).dropna().distinct()
    typed = typed.repartition(tasks, "scope", "spelling")  # few bytes, but much work for each

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [person(x) for x in b["spelling"]]
            keys = [person_keys(*p) for p in parsed]
            yield b.assign(kind=[p[0] for p in parsed], words=[p[1] for p in parsed], initials=[p[2] for p in parsed], own=[sorted(k[0]) for k in keys], weak=[sorted(k[1]) for k in keys])

    kinds = {f.name: f.dataType.simpleString() for f in typed.schema}
    node = F.concat_ws("\u0001", F.col("scope").cast("string"), F.array_join("words", " "))
    parsed = stage(typed.mapInPandas(parse, f"scope {kinds['scope']}, spelling string, kind string, words array<string>, initials array<string>, own array<string>, weak array<string>").filter("kind <> 'unknown'").withColumn("node", node))

    @F.pandas_udf("int")
    def full_cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([name_cost(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")

    @F.pandas_udf("int")
    def form_cost(kind: pd.Series, words: pd.Series, initials: pd.Series, full: pd.Series) -> pd.Series:
        return pd.Series([weak_cost(k, list(w), list(i), list(f)) for k, w, i, f in zip(kind, words, initials, full)], dtype="int32")

    key = lambda c: F.xxhash64("scope", c)
    full = parsed.filter("kind = 'full'")
    once = full.select("scope", "node", "words", "own", "weak").dropDuplicates(["node"])  # spellings of the same words in the same order are one node
    posted = once.select("scope", "node", "words", F.explode("own").alias("k")).select("node", "words", key("k").alias("key"))
    x, y = posted.toDF("a", "wa", "key"), posted.toDF("b", "wb", "key")
    met = x.join(shuffled(y), "key").filter("a < b").select("a", "b", "wa", "wb").distinct()
    links = stage(met.filter(full_cost("wa", "wb") <= 1).select("a", "b"))
    groups = full.select("scope", "spelling", "node", "words", "weak").join(shuffled(connected_components(links)), "node", "left").withColumn("entity", F.coalesce("component", "node"))
    groups = stage(groups.select("scope", "spelling", "words", "weak", "entity"))

    forms = parsed.filter("kind in ('initial', 'single')").select("scope", "spelling", "kind", "words", "initials", "weak")
    looked = forms.select("scope", "spelling", "kind", "words", "initials", F.explode("weak").alias("k")).withColumn("key", key("k")).drop("k")
    there = groups.dropDuplicates(["entity", "words"]).select("scope", "entity", F.col("words").alias("full"), F.explode("weak").alias("k")).select("entity", "full", key("k").alias("key"))
    fits = looked.join(shuffled(there), "key").select("scope", "spelling", "kind", "words", "initials", "entity", "full").distinct()
    fits = fits.withColumn("cost", form_cost("kind", "words", "initials", "full")).filter("cost < 9").groupBy("scope", "spelling", "entity").agg(F.min("cost").alias("cost"))
    best = fits.groupBy("scope", "spelling", "cost").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).groupBy("scope", "spelling").agg(F.min(F.struct("cost", "n", "entity")).alias("b"))
    best = stage(best.select("scope", "spelling", F.when(F.col("b.n") == 1, F.col("b.entity")).alias("entity")))
    alone = forms.filter("kind = 'initial'").join(shuffled(best), ["scope", "spelling"], "left_anti")
    alone = alone.select("scope", "spelling", F.concat_ws("\u0001", F.col("scope").cast("string"), F.lit("\u0002"), F.element_at("initials", 1), F.element_at("words", -1)).alias("entity"))
    operator = parsed.filter("kind = 'operator'").select("scope", "spelling", F.concat_ws("\u0001", F.col("scope").cast("string"), F.lit("\u0002operator")).alias("entity"))
    return groups.select("scope", "spelling", "entity").unionByName(best.dropna()).unionByName(alone).unionByName(operator)


def spelling_pairs(entities: DataFrame) -> DataFrame:
    """``(scope, spelling_a, spelling_b)`` of all spellings of one entity, spelling_a < spelling_b by code point."""
    a = entities.select("scope", "entity", F.col("spelling").alias("spelling_a"))
    b = entities.select("scope", "entity", F.col("spelling").alias("spelling_b"))
    return a.join(shuffled(b), ["scope", "entity"]).filter("spelling_a < spelling_b").select("scope", "spelling_a", "spelling_b").distinct()


def spelling_groups(df: DataFrame, companies: DataFrame, ticker_col: str = "ticker", speaker_col: str = "speaker") -> DataFrame:
    """``(field, ticker, entity, spelling)``: one row per distinct raw value with the company or speaker it means.

    Tickers that mean no company, or several equally well, have a null ``ticker`` and
    ``entity``; speakers' placeholders have no row.
    """
    seen = stage(df.select(F.col(ticker_col).alias("ticker"), F.col(speaker_col).alias("speaker")).distinct())
    mapping = stage(resolve_companies(seen, companies))
    raws = seen.select(F.col("ticker").cast("string").alias("spelling")).filter("trim(spelling) <> ''").distinct()
    firms = raws.join(shuffled(mapping), raws.spelling == mapping.raw, "left").select(F.lit("ticker").alias("field"), F.col("company").alias("ticker"), F.col("company").alias("entity"), "spelling")
    people = link_people(seen.join(shuffled(mapping), seen.ticker == mapping.raw))
    return firms.unionByName(people.select(F.lit("speaker").alias("field"), F.col("scope").alias("ticker"), "entity", "spelling"))


def variant_spellings(df: DataFrame, companies: DataFrame, ticker_col: str = "ticker", speaker_col: str = "speaker") -> DataFrame:
    """``(field, ticker, spelling_a, spelling_b)``: spellings of one company, and of one speaker within a company."""
    groups = stage(spelling_groups(df, companies, ticker_col, speaker_col).filter("entity is not null"))
    both = spelling_pairs(groups.withColumn("scope", F.struct("field", "ticker")))
    return both.select("scope.field", "scope.ticker", "spelling_a", "spelling_b")
