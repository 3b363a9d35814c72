"""Retry queue rewrite (survey I3, D6).

The queue is the set of failed requests. After a retry run, the new queue
is the old queue minus the requests that now succeeded - requests that were
skipped stay queued (the reference silently lost them) - and it replaces
the old queue atomically (staged write, then swap), which also lets the
job read the queue it rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.urls import repair_retry_url
from civicspark.operators.nested import OK, classify_responses
from civicspark.sources.tables import overwrite_atomic


def succeeded_urls(retry_results: DataFrame, url: str = "url") -> DataFrame:
    """Repaired URLs whose retry response is ``ok``."""
    ok = classify_responses(retry_results).filter(F.col("response_class") == OK)
    return ok.select(repair_retry_url(F.col(url)).alias("__key")).distinct()


def next_queue(queue: DataFrame, retry_results: DataFrame, url: str = "url") -> DataFrame:
    """Old queue minus succeeded requests (matched on the repaired URL)."""
    keyed = queue.withColumn("__key", repair_retry_url(F.col(url)))
    return keyed.join(succeeded_urls(retry_results, url), "__key", "left_anti").drop("__key")


def rewrite_retry_queue(spark: SparkSession, queue_path: str, retry_results: DataFrame,
                        url: str = "url") -> DataFrame:
    """Compute the next queue from the stored one and swap it in."""
    queue = spark.read.parquet(queue_path)
    overwrite_atomic(next_queue(queue, retry_results, url), queue_path)
    return spark.read.parquet(queue_path)
