"""Tables whose columns gain members and change types at rest (survey C6).

Parquet files of one folder must agree on the types of their columns, so a
table is a list of versions, ``version=<v>`` folders: new columns only add to
a version, a column whose type changes opens the next one, and reading casts
all versions to the last. The schemas of all versions are a note beside them,
so neither a writer nor a reader opens file footers to learn them, and no
stored file is ever rewritten for a change of schema.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.sources.tables import list_tables, path_exists, read_note, write_note

SCHEMA_FILE = "versions.json"


def stored_versions(spark: SparkSession, target: str, before: int | None = None) -> list[T.StructType]:
    """Schemas of the table's versions after the last batch (``before`` this one)."""
    path = f"{target.rstrip('/')}/schema"
    if not path_exists(spark, path):
        return []
    done = [int(n.split("=")[1]) for n in list_tables(spark, path)]
    done = [n for n in done if before is None or n < before]
    if not done:
        return []
    text = read_note(spark, f"{path}/batch_id={max(done)}/{SCHEMA_FILE}")
    return [T.StructType.fromJson(json.loads(v)) for v in json.loads(text)]


def store_versions(spark: SparkSession, target: str, batch: int, versions: list[T.StructType]) -> None:
    write_note(spark, f"{target.rstrip('/')}/schema/batch_id={batch}/{SCHEMA_FILE}", json.dumps([v.json() for v in versions]))


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    numbers = (T.IntegerType, T.LongType, T.DoubleType)
    return T.DoubleType() if isinstance(a, numbers) and isinstance(b, numbers) else T.StringType()


def conform(rows: DataFrame, versions: list[T.StructType]) -> tuple[DataFrame, list[T.StructType]]:
    """``rows`` with the table's spelling and types, and the versions after
    it: the last one with new columns, or one more if a type changed."""
    if not versions:
        return rows, [rows.schema]
    last = versions[-1]
    place = {f.name.lower(): k for k, f in enumerate(last.fields)}
    fields, out, changed = list(last.fields), [], False
    for f in rows.schema.fields:
        k = place.get(f.name.lower())
        if k is None:
            fields.append(T.StructField(f.name, f.dataType))
            out.append(F.col(f"`{f.name}`"))
            continue
        wide = _wider(fields[k].dataType, f.dataType)
        changed |= wide != fields[k].dataType
        fields[k] = T.StructField(fields[k].name, wide)
        out.append(F.col(f"`{f.name}`").cast(wide).alias(fields[k].name))
    now = T.StructType(fields)
    return rows.select(out), [*versions, now] if changed else [*versions[:-1], now]


def read_versions(spark: SparkSession, table: str, versions: list[T.StructType], last: T.StructType | None = None) -> DataFrame | None:
    """All versions' rows in the names and types of ``last`` (default: the
    last version's); None if there is no folder of rows yet."""
    out, last = None, last or (versions[-1] if versions else None)
    for k, schema in enumerate(versions):
        path = f"{table.rstrip('/')}/version={k}"
        if not path_exists(spark, path):
            continue
        part = spark.read.schema(schema).parquet(path)
        have = {c.lower() for c in schema.fieldNames()}
        part = part.select([(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in last.fields])
        out = part if out is None else out.unionByName(part)
    return out


def append_versioned(df: DataFrame, table: str, batch: int, partition_by: tuple[str, ...] = ()) -> None:
    """Append a batch under its number; the same number again replaces
    what it wrote. Names that differ in case land in one column."""
    spark, table = df.sparkSession, table.rstrip("/")
    rows, versions = conform(df, stored_versions(spark, table, before=batch))
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{table}/version={len(versions) - 1}/batch_id={batch}")
    store_versions(spark, table, batch, versions)


def read_versioned(spark: SparkSession, table: str) -> DataFrame:
    """The table that :func:`append_versioned` wrote, in its last types."""
    return read_versions(spark, table, stored_versions(spark, table))
