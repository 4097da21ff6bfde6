"""Tickers, quarters and dates as typed, into canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tickers that changed. Fixed values.
ALIASES = {"GOOG": "GOOGL", "FB": "META", "AMZN.COM": "AMZN", "ANTM": "ELV"}


def normalize_ticker(t: Column, aliases: dict[str, str] = ALIASES) -> Column:
    up = F.upper(F.trim(t))
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, up), up)


def normalize_quarter(q: Column) -> Column:
    """``YYYYQn`` from ``YYYYQn``, ``YYYY-Qn``, ``FYYYYYQn`` and ``Qn YYYY``, else the text in upper case without blanks and hyphens."""
    s = F.regexp_replace(F.upper(F.trim(q)), "[ -]", "")
    a, b = r"^(?:FY)?(\d{4})Q(\d)", r"^Q(\d)(\d{4})"
    return F.when(s.rlike(a), F.concat(F.regexp_extract(s, a, 1), F.lit("Q"), F.regexp_extract(s, a, 2))).when(s.rlike(b), F.concat(F.regexp_extract(s, b, 2), F.lit("Q"), F.regexp_extract(s, b, 1))).otherwise(s)


def quarter_index(q: Column) -> Column:
    """4 * year + quarter - 1 of a canonical quarter, null for other text."""
    return F.when(q.rlike(r"^\d{4}Q[1-4]$"), F.substring(q, 1, 4).cast("int") * 4 + F.substring(q, 6, 1).cast("int") - 1)


def readable_ticker(t: Column) -> Column:
    """Whether a normalized ticker has a ticker's shape; false for null."""
    return F.coalesce(t.rlike(r"^[A-Z][A-Z0-9]{0,5}(?:\.[A-Z]{1,2})?$"), F.lit(False))


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with ``ticker`` and ``quarter`` normalized, where it has them."""
    of = {"ticker": normalize_ticker, "quarter": normalize_quarter}
    return df.withColumns({c: f(F.col(c)) for c, f in of.items() if c in df.columns})


def quarter_text(i: Column) -> Column:
    return F.concat(F.floor(i / 4).cast("int").cast("string"), F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"))


def missing_quarters(df: DataFrame, key: str, quarter: str) -> DataFrame:
    """``(key, missing)``: canonical quarters between a key's first and last that it doesn't have."""
    seen = df.select(key, quarter_index(F.col(quarter)).alias("i")).dropna().distinct()
    nxt = F.lead("i").over(Window.partitionBy(key).orderBy("i"))
    return seen.withColumn("to", nxt).filter(F.col("to") > F.col("i") + 1).select(key, F.explode(F.sequence(F.col("i") + 1, F.col("to") - 1)).alias("m")).select(key, quarter_text(F.col("m")).alias("missing"))


def parse_date(text: Column) -> Column:
    """Date of ``Jan 3, 2020``, ``Jan. 3, 2020``, ``January 3, 2020`` or ISO text, a time of day behind it dropped; null if it is none."""
    t = F.regexp_replace(text, r"(?i),?\s*\d{1,2}:\d{2}\s*[ap]\.?m\.?\s*ET\s*$", "")
    t = F.regexp_replace(F.regexp_replace(F.trim(t), r",$", ""), r"^([A-Za-z]{3})[a-z]*\.?\s+", "$1 ")
    return F.coalesce(F.try_to_timestamp(t, F.lit("MMM d, yyyy")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))).cast("date")


def parse_last_date(texts: Column) -> Column:
    """``parse_date`` of the last element of an array of texts; null for an empty one."""
    return parse_date(F.try_element_at(texts, F.lit(-1)))


def next_weekday(d: Column) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def previous_weekday(d: Column) -> Column:
    return F.date_sub(d, F.when(F.weekday(d) == 5, 1).when(F.weekday(d) == 6, 2).otherwise(0))


#: A ticker behind its exchange, in upper-case text. Fixed value.
EXCHANGE = r"(?:NASDAQ|NYSE|TICKER)[:\s]+([A-Z]{1,5})"
#: How a quarter is written in upper-case text, first that fits: (pattern, group of the year, group of the quarter or the quarter itself). Fixed values.
QUARTERS = [(r"Q(\d)\s*[-/]?\s*(20\d{2})", 2, 1), (r"(20\d{2})\s*[-/]?\s*Q(\d)", 1, 2)] + [
    (word + r"\s+QUARTER\s+(?:OF\s+)?(?:FISCAL\s+(?:YEAR\s+)?)?(20\d{2})", 1, (n,)) for word, n in (("FIRST", "1"), ("SECOND", "2"), ("THIRD", "3"), ("FOURTH", "4"), ("1ST", "1"), ("2ND", "2"), ("3RD", "3"), ("4TH", "4"))
]


def quarter_in(text: Column, patterns: list = QUARTERS) -> Column:
    """The quarter that an upper-case text names first by the order of the patterns, else null."""
    out = None
    for p, y, q in patterns:
        got = F.concat(F.regexp_extract(text, p, y), F.lit("Q"), F.regexp_extract(text, p, q) if isinstance(q, int) else F.lit(q[0]))
        out = F.when(text.rlike(p), got) if out is None else out.when(text.rlike(p), got)
    return out


def detect_call(docs: DataFrame, id_col: str, text_col: str, companies: DataFrame, file_col: str | None = None) -> DataFrame:
    """``(id_col, ticker, quarter)`` of each text: what an exchange stands before, else the company whose name is the longest in the text, else what the file's name says.

    Names and texts meet by the name's first word, then the whole name is looked for;
    among names equally long the least ticker counts. A file name counts for its
    ticker (letters before the first ``-``, ``_`` or blank, if the text has none), for a
    company name in it without blanks (which wins over the text), and for its
    quarter if the text names none. Unknown is null. One row per row of ``docs``.
    """
    word = r"[\p{L}\p{N}]+"
    rows = docs.select(F.col(id_col).alias("id"), F.upper(text_col).alias("t"), F.upper(F.coalesce(F.col(file_col), F.lit("")) if file_col else F.lit("")).alias("f")).withColumn("k", F.xxhash64("id", "t", "f"))
    names = companies.select(F.col("ticker").alias("ticker"), F.upper("name").alias("name")).dropna().filter("name <> ''").withColumn("w", F.regexp_extract("name", word, 0))
    names = names.withColumn("flat", F.regexp_replace("name", r"[ '_-]", ""))
    seen = rows.select("k", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(word), F.lit(0)))).alias("w")).join(names, "w")
    may = seen.groupBy("k").agg(F.collect_set(F.struct((-F.length("name")).alias("l"), "ticker", "name")).alias("c"))  # names that share a first word with one text
    named = F.try_element_at(F.array_sort(F.filter("c", lambda c: F.contains(F.col("t"), c["name"]))), F.lit(1))["ticker"]
    x = rows.join(may, "k", "left").withColumn("ticker", F.coalesce(F.nullif(F.regexp_extract("t", EXCHANGE, 1), F.lit("")), named)).withColumn("quarter", quarter_in(F.col("t")))
    if file_col:
        parts = F.filter(F.split("f", r"[^\p{L}\p{N}']+"), lambda w: w != "")
        runs = F.flatten(F.transform("p", lambda _, i: F.transform(F.sequence(F.lit(1), F.size("p") - i), lambda n: F.regexp_replace(F.array_join(F.slice("p", i + 1, n), ""), "'", ""))))  # neighbouring parts of one file name
        flat = rows.select("k", parts.alias("p")).filter(F.size("p") > 0).select("k", F.explode(F.array_distinct(runs)).alias("flat"))
        inside = flat.join(names.select("ticker", "flat"), "flat").groupBy("k").agg(F.min_by("ticker", F.struct(-F.length("flat"), "ticker")).alias("by_file"))
        x = x.join(inside, "k", "left")
        own = F.nullif(F.regexp_extract("f", r"^([A-Z]{1,5})[-_ ]", 1), F.lit(""))
        filed = [(r"(20\d{2})\s*[-_]?\s*Q(\d)", 1, 2), (r"Q(\d)\s*[-_]?\s*(20\d{2})", 2, 1)]
        x = x.withColumn("ticker", F.coalesce("by_file", "ticker", own)).withColumn("quarter", F.coalesce("quarter", quarter_in(F.col("f"), filed)))
    return x.select(F.col("id").alias(id_col), "ticker", "quarter")
