"""Table lookup and sinks (survey S6-S10).

Paths are Hadoop paths (any shared file system); the listing, staging and
swap go through the Hadoop FileSystem API of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.errors import TableNotFound
from civicspark.functions.text import error_timestamp


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (a schema, a mark), written by the driver; it
    replaces an older one whole."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_note(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Table folders under ``root`` (hidden and staging folders excluded)."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith((".", "_")))


def resolve_table_name(spark: SparkSession, root: str, name: str) -> str:
    """The stored name matching ``name`` ignoring case (first in sorted
    order); raises with the available names when none matches."""
    available = list_tables(spark, root)
    hits = [t for t in available if t.lower() == name.lower()]
    if not hits:
        raise TableNotFound(f"table {name!r} not found; available: {available}")
    return hits[0]


def read_table_ignore_case(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Resolve ignoring case, then read every column."""
    return spark.read.parquet(f"{root.rstrip('/')}/{resolve_table_name(spark, root, name)}")


def append_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("ano",)) -> None:
    """Append to a topic table, partitioned by period so later reads
    prune partitions."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose files gained columns over time (C6 at rest)."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def overwrite_atomic(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a table. The new version is written completely to a
    staging folder (hidden from :func:`list_tables`) first, then swapped in
    by two renames, so readers never see a half-written table and ``df`` may
    read the table it replaces. Between the renames there is no table; after
    a crash there the old one lies in ``_replaced-<name>-...``."""
    spark = df.sparkSession
    root, name = path.rstrip("/").rsplit("/", 1)
    stage = f"{root}/_staging-{name}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(stage)
    fs, target = _fs(spark, path)
    _, staged = _fs(spark, stage)
    if fs.exists(target):
        _, old = _fs(spark, f"{root}/_replaced-{name}-{uuid.uuid4().hex}")
        if not fs.rename(target, old):
            raise IOError(f"could not move {path} aside")
        if not fs.rename(staged, target):
            fs.rename(old, target)
            raise IOError(f"could not swap {stage} into {path}")
        fs.delete(old, True)
    elif not fs.rename(staged, target):
        raise IOError(f"could not move {stage} to {path}")


def create_table_as(df: DataFrame, name: str, path: str) -> DataFrame:
    """Create a catalog table (stored at ``path``) from a query result;
    fails if the table exists."""
    df.write.mode("errorifexists").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def error_lines(errors: DataFrame, ts: str = "ts", url: str = "url",
                error_type: str = "error_type", message: str = "message") -> DataFrame:
    """``yyyy-MM-dd HH:mm:ss|url|type|message`` text rows. A NULL
    is an empty field; line breaks become the two characters ``\\n``."""
    fields = [F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r|\n", r"\\\\n")
              for c in (error_timestamp(F.col(ts)), F.col(url), F.col(error_type), F.col(message))]
    return errors.select(F.concat_ws("|", *fields).alias("value"))


def append_errors(errors: DataFrame, path: str, **cols) -> None:
    """Append timestamped failure lines to the error log folder."""
    error_lines(errors, **cols).write.mode("append").text(path)
