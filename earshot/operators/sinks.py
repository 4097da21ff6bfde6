"""Writing tables, files and models."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.operators.relational import keep_one, upsert
from earshot.sources.transcripts import exists


def _fs(spark: SparkSession, path: str):
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return P, P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table, after putting back the old one where a swap was cut off between its two renames."""
    P, fs = _fs(spark, path)
    p = P(path.rstrip("/"))
    if not fs.exists(p):
        for old in fs.globStatus(P(f"{path.rstrip('/')}.old-*")) or []:
            fs.rename(old.getPath(), p)
            break
    return bool(fs.exists(p))


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside the path, then move into place, so that a query may read what it replaces.

    The old table is moved aside and deleted only once the new one is in place; if
    that fails it is moved back, and if the process ends between the two moves, the
    next ``recover`` (or write) finds it.
    """
    spark = df.sparkSession
    root = path.rstrip("/")
    P, fs = _fs(spark, root)
    new, old = P(f"{root}.new-{uuid.uuid4().hex}"), P(f"{root}.old-{uuid.uuid4().hex}")
    there = recover(spark, root)
    df.write.parquet(new.toString())
    if there and not fs.rename(P(root), old):
        raise OSError(f"{root} can't be moved")
    if not fs.rename(new, P(root)):
        if there:
            fs.rename(old, P(root))
        raise OSError(f"{new} can't be moved")
    if there:
        fs.delete(old, True)


def upsert_table(new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None) -> None:
    """Rows of ``new`` replace those of the table with the same key; of several new rows of a key the first in ``order`` counts, in the first write too."""
    spark = new.sparkSession
    order = order or [F.xxhash64(*new.columns)]
    swap_in(upsert(spark.read.parquet(path), new, keys, order) if recover(spark, path) else keep_one(new, keys, order), path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Add records to a folder of JSON files, as a manifest grows."""
    df.write.mode("append").json(path)


def write_texts(df: DataFrame, path: str, text: str = "transcript_text") -> DataFrame:
    """One text file per row, ``<quarter>/<ticker>.txt``, written by the tasks to any file system Hadoop knows; returns ``(ticker, quarter, file_path)``.

    Of several rows of a key the longest text is kept, since a file has one content.
    """
    rows = keep_one(df.select("ticker", "quarter", F.col(text).alias("t")).dropna(), ["ticker", "quarter"], [F.desc(F.length("t")), F.col("t")])
    spread = rows.repartition("quarter", "ticker").withColumn("name", F.concat_ws("/", F.regexp_replace("quarter", r"[^\w.-]", "_"), F.concat(F.regexp_replace("ticker", r"[^\w.-]", "_"), F.lit(".txt"))))
    root = path.rstrip("/")

    def run(batches):
        import pandas as pd
        from pyarrow import fs as afs

        for b in batches:
            for name, t in zip(b["name"], b["t"]):
                target, base = afs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (afs.LocalFileSystem(), root)
                target.create_dir(f"{base}/{name.rsplit('/', 1)[0]}", recursive=True)
                with target.open_output_stream(f"{base}/{name}") as out:
                    out.write(t.encode())
            yield pd.DataFrame({"ticker": b["ticker"], "quarter": b["quarter"], "file_path": [f"{root}/{n}" for n in b["name"]]})

    from earshot.storage import stage

    return stage(spread.mapInPandas(run, "ticker string, quarter string, file_path string"))


def save_model(model, path: str) -> None:
    """A fitted pipeline or model with all its stages, in place of what is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """What ``save_model`` wrote, or None where nothing is."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    return PipelineModel.load(path) if exists(SparkSession.active(), path) else None


def coverage_text(grid: DataFrame) -> DataFrame:
    """A coverage grid with one row per ticker, a mark per quarter, and the share covered."""
    quarters = [r[0] for r in grid.select("quarter").distinct().orderBy("quarter").collect()]
    wide = grid.groupBy("ticker").pivot("quarter", quarters).agg(F.when(F.max("present") == 1, "x").otherwise("-"))
    share = grid.groupBy("ticker").agg(F.round(100 * F.avg("present"), 1).alias("percent"))
    return wide.join(share, "ticker")
