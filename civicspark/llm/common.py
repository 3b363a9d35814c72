"""Helpers shared by the operators: scratch tables, names, size checks."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where the session
    names none, a folder under the warehouse, which a cluster shares too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    the lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


_here = threading.local()


def _written() -> list[str]:
    """Paths of the scratch tables this thread has written."""
    if not hasattr(_here, "paths"):
        _here.paths = []
    return _here.paths


def scratch_mark() -> int:
    """A point in this thread's scratch tables, for :func:`taken`."""
    return len(_written())


def taken(since: int) -> list[str]:
    """Paths of the scratch tables this thread has written after the mark;
    they are the caller's from now on."""
    paths = _written()
    out, paths[since:] = paths[since:], []
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables. Frames that still read them fail."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that ``df`` does not use (names compare without
    case in Spark)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def small(df: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """``broadcast(df)`` if its counted rows of about ``row_bytes`` stay below
    ``max_bytes``; else ``df`` as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
