"""Profiles and run metrics (survey A1, A3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """A1: one row per column - position, name, type, rows, non-NULL count,
    distinct count. Exactly, each column is counted by value on its own, so a
    scan reads every column once and a value crosses the network once a task
    (distinct counts in one aggregate would multiply whole rows by the
    columns). ``exact=False`` uses HyperLogLog sketches in a single pass, which
    keep the shuffle at a few KB per column however large the table."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]

    def head(i, f):
        return [F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")]

    if exact and fields:
        per = []
        for i, f in enumerate(fields):
            values = df.groupBy(F.col(f"`{f.name}`").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
            counts = values.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n_rows"), F.count("__v").alias("n_distinct"),
                                F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))), F.lit(0)).alias("non_null"))
            per.append(counts.select("n_rows", *head(i, f), "non_null", "n_distinct"))
        return reduce(lambda a, b: a.unionByName(b), per)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"__nn{i}"), F.approx_count_distinct(c).alias(f"__nd{i}")]
    entries = F.array(*[F.struct(*head(i, f), F.col(f"__nn{i}").alias("non_null"), F.col(f"__nd{i}").alias("n_distinct")) for i, f in enumerate(fields)])
    return df.agg(*aggs).select(F.col("__rows").alias("n_rows"), F.inline(entries))


def run_metrics(classified: DataFrame, by: list[str], klass: str = "response_class") -> DataFrame:
    """A3: responses per class and group, with the class's share of its group (class ``ok``: the success share)."""
    per = classified.groupBy(*by, klass).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def _value_text(name: str, dtype: T.DataType):
    """A value as text, equal for equal values; long ones as their SHA-256."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(c == 0, F.lit("0")).otherwise(c.cast("string"))  # -0.0 equals 0.0
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(c)
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def exact_profile(df: DataFrame) -> DataFrame:
    """A1 exactly, without an Expand of whole rows: each row becomes (column,
    value) pairs, which are counted map side, so a value that fills a column
    crosses the network once a task; a second count per column follows."""
    fields = df.schema.fields
    pairs = df.select(F.posexplode(F.array(*[_value_text(f.name, f.dataType) for f in fields])).alias("position", "__v"))
    values = pairs.groupBy("position", "__v").agg(F.count(F.lit(1)).alias("__c"))
    per = values.groupBy("position").agg(F.sum("__c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))), F.lit(0)).alias("non_null"),
                                         F.count("__v").alias("n_distinct"))
    names = F.array(*[F.lit(f.name) for f in fields])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    return per.select("n_rows", "position", F.get(names, F.col("position")).alias("column_name"), F.get(types, F.col("position")).alias("data_type"),
                      "non_null", "n_distinct")


def batch_profile(df: DataFrame, log_buckets: int = 14) -> DataFrame:
    """A profile of one batch that can be kept and merged: per column rows,
    non-NULL count and a HyperLogLog sketch of its values, from one pass."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        text = _value_text(f.name, f.dataType)
        aggs += [F.count(text).alias(f"__nn{i}"), F.hll_sketch_agg(text, log_buckets).alias(f"__s{i}")]
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                                 F.col(f"__nn{i}").alias("non_null"), F.col(f"__s{i}").alias("sketch")) for i, f in enumerate(fields)])
    return df.agg(*aggs).select(F.col("__rows").alias("n_rows"), F.inline(entries))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """The profile of all batches together, from kept :func:`batch_profile`
    rows alone. A column counts the rows of the batches that have it; its
    type is the common one, else ``mixed``."""
    merged = profiles.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.min("position").alias("position"), F.sum("non_null").alias("non_null"),
        F.min("data_type").alias("__t1"), F.max("data_type").alias("__t2"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    return merged.select("n_rows", "position", "column_name", F.when(F.col("__t1") == F.col("__t2"), F.col("__t1")).otherwise("mixed").alias("data_type"),
                         "non_null", "n_distinct")
