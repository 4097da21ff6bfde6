"""Scans of raw transcripts, manifests and results, with their key rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.keys import normalize_quarter, normalize_ticker, parse_date
from earshot.operators.relational import keep_one

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "quarter", "date", "transcript_text", "source")])
CHUNK = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "ticker", "quarter", "speaker", "title", "role", "section", "text")] + [T.StructField("chunk_index", T.IntegerType())])
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("file_path", "ticker", "quarter", "date", "source")])
PRICE = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType())])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", **options) -> DataFrame:
    """A table, or an empty one of the schema where the path doesn't exist."""
    return spark.read.schema(schema).options(**options).format(form).load(path) if exists(spark, path) else spark.createDataFrame([], schema)


def dataset(df: DataFrame, tickers: DataFrame | None = None, quarters: list[str] | None = None, least: int = 100) -> DataFrame:
    """Transcript rows under canonical names and keys, of the wanted tickers and quarters, with texts of at least ``least`` characters."""
    x = df.toDF(*[c.strip().lower() for c in df.columns])
    x = x.withColumn("ticker", normalize_ticker(F.col("ticker"))).withColumn("quarter", normalize_quarter(F.col("quarter"))).filter(F.length("transcript_text") >= least)
    x = x if quarters is None else x.filter(F.col("quarter").isin(quarters))
    return x if tickers is None else x.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def file_keys(name: Column) -> tuple[Column, Column]:
    """(quarter, ticker) of ``YYYY_Qn_tick[_processed].txt``, both null for other names."""
    p = r"(?i)^(\d{4})_Q(\d)_([A-Za-z.]+?)(?:_processed)?\.txt$"
    ok = name.rlike(p)
    return F.when(ok, F.concat(F.regexp_extract(name, p, 1), F.lit("Q"), F.regexp_extract(name, p, 2))), F.when(ok, F.upper(F.regexp_extract(name, p, 3)))


def file_quarter(name: Column) -> Column:
    """Quarter of a name that begins with ``YYYY_Qn_``, whatever follows; null for other names."""
    p = r"^(\d{4})_Q(\d)_"
    return F.when(name.rlike(p), F.concat(F.regexp_extract(name, p, 1), F.lit("Q"), F.regexp_extract(name, p, 2)))


def folder_ticker(folder: Column, mapping: dict[str, str]) -> Column:
    """Ticker of a folder: its entry in the mapping as written, else in any case, else its name in upper case. The mapping is a parameter; the first of several entries that differ in case counts."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    low: dict[str, str] = {}
    for k, v in mapping.items():
        low.setdefault(k.lower(), v)
    return F.coalesce(F.try_element_at(pairs(mapping), folder), F.try_element_at(pairs(low), F.lower(folder)), F.upper(folder))


def prices(spark: SparkSession, path: str, fetch=None, events: DataFrame | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Daily prices ``(ticker, date, close, volume)`` of a table partitioned by ticker; tickers it lacks are fetched first, if a way to is given.

    ``fetch(ticker)`` returns rows ``(date, close, volume)``; it runs on the
    executors, is tried up to ``tries`` times with doubling waits, and a ticker
    that still fails is left for the next run. What was fetched is appended to the
    table, so it is fetched once. Times with a zone are cut to their date.
    """
    import time

    have = read_optional(spark, path, PRICE)
    if fetch is None or events is None:
        return have
    lacking = events.select("ticker").dropna().distinct().join(have.select("ticker").distinct(), "ticker", "left_anti")

    def run(batches):
        import pandas as pd

        for b in batches:
            for ticker in b["ticker"]:
                for k in range(tries):
                    try:
                        rows = [(ticker, pd.Timestamp(d).date(), float(c), int(v)) for d, c, v in fetch(ticker)]
                        yield pd.DataFrame(rows, columns=["ticker", "date", "close", "volume"])
                        break
                    except Exception:
                        if k + 1 < tries:
                            time.sleep(wait * 2**k)

    lacking.mapInPandas(run, PRICE).write.mode("append").parquet(path)
    return read_optional(spark, path, PRICE)


RISK_DETAIL = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("category", "keyword", "severity", "context")] + [T.StructField("negated", T.BooleanType())]))


def chunks_with_risk(spark: SparkSession, path: str) -> DataFrame:
    """Chunks whose ``risk_categories`` and ``risk_details`` are JSON texts, parsed; a missing table is an empty one."""
    text = T.StructType([*CHUNK.fields, *[T.StructField(c, T.StringType()) for c in ("risk_categories", "risk_details")], T.StructField("risk_count", T.LongType()), T.StructField("risk_intensity", T.LongType())])
    x = read_optional(spark, path, text)
    return x.withColumn("risk_categories", F.from_json("risk_categories", T.ArrayType(T.StringType()))).withColumn("risk_details", F.from_json("risk_details", RISK_DETAIL))


def companies(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, name, sector, industry)`` from a JSON list of companies; missing fields are null, a missing file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "name", "sector", "industry")])
    return read_optional(spark, path, schema, "json", multiLine=True)


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, quarter, earnings_date)`` from CSV or JSON with free-form dates; rows without a readable date are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "quarter", "date")])
    x = read_optional(spark, path, schema, "csv", header=True) if path.endswith(".csv") else read_optional(spark, path, schema, "json", multiLine=True)
    return x.select(normalize_ticker(F.col("ticker")).alias("ticker"), normalize_quarter(F.col("quarter")).alias("quarter"), parse_date(F.col("date")).alias("earnings_date")).dropna(subset=["earnings_date"])


def text_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per text file below the roots whose name has keys; of one key in several roots the first root's file stays."""
    out = None
    for i, root in enumerate(roots):
        x = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root).withColumn("file_path", F.col("_metadata.file_path"))
        quarter, ticker = file_keys(F.element_at(F.split("file_path", "/"), -1))
        x = x.select(ticker.alias("ticker"), quarter.alias("quarter"), F.col("value").alias("transcript_text"), "file_path", F.lit(i).alias("_root")).filter("ticker is not null")
        out = x if out is None else out.unionByName(x)
    return keep_one(out, ["ticker", "quarter"], [F.col("_root"), F.col("file_path")]).drop("_root")


def clean_tabbed(text: Column) -> Column:
    """Tab-separated blocks (number, speaker, speech) as a name line and a speech line; the text itself where less than 30 % would be left."""
    fields = lambda x: F.split(x, "\t")
    line = lambda x: F.when(
        (F.size(fields(x)) >= 3) & F.trim(F.get(fields(x), 0)).rlike(r"^\d+$"), F.concat(F.trim(F.get(fields(x), 1)), F.lit("\n"), F.trim(F.array_join(F.slice(fields(x), F.lit(3), F.size(fields(x))), " ")), F.lit("\n"))
    ).when(F.size(fields(x)) == 2, F.concat_ws("\n", F.trim(F.get(fields(x), 0)), F.trim(F.get(fields(x), 1)))).otherwise(x)
    lines = F.split(text, "\n")
    body = F.when(F.contains(F.get(lines, 0), F.lit("Earnings Call Transcript")), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    clean = F.array_join(F.transform(body, line), "\n")
    return F.when(F.length(clean) < 0.3 * F.length(text), text).otherwise(clean)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_optional(spark, path, MANIFEST, "json", multiLine=True)


def processed_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (ticker, quarter) of a table; only these two columns are read."""
    return read_optional(spark, path, CHUNK).select("ticker", "quarter").distinct()
