"""Cutting lineage on shared storage, and broadcasts behind a measured size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast once it has been measured.
BROADCAST_BYTES = 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where it is unset a local run gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="earshot-"))
    return sc.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


#: Staged folders of this process that haven't been freed.
_STAGED: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, is columnar and
    compressed. The planner takes the size of its compressed files for that of its
    rows, so joins of results that grow with the input need ``shuffled``. Its files
    stay until ``free`` is called or Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many folders have been staged; a mark for ``free``."""
    return len(_STAGED)


def free(since: int = 0) -> None:
    """Remove the folders staged after the mark; results that still read them must be written before."""
    while len(_STAGED) > since:
        _remove(*_STAGED.pop())


atexit.register(free)


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take, by their number and the lengths of their values: one pass over what should be a staged or small table."""
    fixed, texts = 8, []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            texts.append(F.octet_length(F.col(f"`{f.name}`")))
        elif kind in ("array", "map", "struct"):
            texts.append(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))))
        fixed += 8
    row = F.lit(fixed)
    for t in texts:
        row = row + F.coalesce(t, F.lit(0))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for an equi-join that is never a broadcast, whatever the planner takes its size for.

    The planner counts compressed files and the rows before an ``explode``; a side
    that it takes for 10 MB can be twenty times that in the driver, which builds the
    broadcast. For sides that grow with the input.
    """
    return df.hint("merge")


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``max_bytes``, else ``df`` as it is (a shuffle join)."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
