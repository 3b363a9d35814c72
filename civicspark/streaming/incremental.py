"""Incremental load with Structured Streaming (survey I1, I3, D6, D7).

The landing folder receives response files from any fetcher. A stream
over it (``trigger(availableNow=True)``) processes only files it has not
seen (the checkpoint records them): the stream classifies the responses,
stamps them with their plan cell and leaves out those seen before
(:func:`unseen`); each micro-batch is parsed, flattened and written.

A response is known by its URL and the SHA-256 of its body. What was seen is
keyed state of the checkpoint, dealt over its partitions and looked up only
for the keys of a batch; no batch reads what earlier ones wrote. Which cells are
already loaded is a question for planning (``pending_cells``), never for the
load: a cell whose responses lie in several files or micro-batches is loaded
whole, so the rows do not depend on the layout of the files.

Layout of the target, each part in folders ``batch_id=<n>`` that a re-run of
the micro-batch overwrites (a batch never looks at its own folders):

* ``rows/version=<v>``: the table. New columns only add to a version; a
  column that changes its type (BIGINT with DOUBLE: DOUBLE, else STRING)
  opens the next version, and reading casts all versions to the last.
* ``schema``: the schemas of all versions after the batch, so that neither a
  batch nor a reader opens file footers to learn them.
* ``errors``: one row per response without rows: HTTP errors, blank and
  malformed bodies, URLs outside the plan, lists of different lengths.

One checkpoint belongs to one target: batch numbers come from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators.nested import OK, ZIP_LENGTH_ERROR, clean_body, classify_responses, payload_table, unpack_columnar
from civicspark.operators.schema import cells_by_url
from civicspark.plans.extraction import MONTH_CELL
from civicspark.sources.versioned import conform, read_versions, store_versions, stored_versions

LANDING_SCHEMA = "url STRING, status INT, body STRING, fetched_at TIMESTAMP_NTZ"
ERROR_SCHEMA = "fetched_at TIMESTAMP_NTZ, url STRING, error_type STRING, message STRING, batch_id LONG"


def unseen(responses: DataFrame, cells: DataFrame, keys=MONTH_CELL, known_by: tuple[str, ...] = ("url", "body_sha")) -> DataFrame:
    """``responses`` (a stream or a table) with ``response_class``,
    ``body_sha``, the stamps ``keys`` of their plan cell (``cells``: one row
    per URL) and ``__good`` (well formed and planned). A good response comes
    once for each ``known_by``, over the whole life of a stream's checkpoint; another
    one, to be logged, once for each status and time."""
    tagged = classify_responses(responses).withColumn("body_sha", F.sha2(F.coalesce("body", F.lit("")), 256))
    tagged = tagged.join(cells.select("url", *keys, F.lit(True).alias("__planned")), "url", "left")
    good = (F.col("response_class") == OK) & F.coalesce("__planned", F.lit(False))
    logged = F.when(~F.col("__good"), F.concat_ws("|", F.col("status").cast("string"), F.col("fetched_at").cast("string")))
    return (tagged.withColumn("__good", good).withColumn("__logged", logged)
            .dropDuplicates([*known_by, "__logged"]).drop("__logged", "__planned"))


def error_rows(responses: DataFrame, uneven: DataFrame) -> DataFrame:
    """The responses that give no rows, with the reason."""
    malformed = F.col("response_class") != OK
    bad = responses.filter("NOT __good").select(
        "fetched_at", "url", F.when(malformed, F.col("response_class")).otherwise("unplanned").alias("error_type"),
        F.concat_ws(" ", F.lit("status"), F.col("status").cast("string")).alias("message"))
    return bad.unionByName(uneven.select("fetched_at", "url", F.lit("uneven").alias("error_type"), F.lit(ZIP_LENGTH_ERROR).alias("message")))


def process_batch(batch: DataFrame, plan: DataFrame, target: str, epoch: int,
                  keys=MONTH_CELL, partition_by: tuple[str, ...] = ("ano",)) -> None:
    """One micro-batch, tagged by :func:`unseen` (a table of plain responses
    is tagged here): J5, J1/J2, J7 -> C6, S7, S10. ``plan``: (url, *keys), one
    row per URL."""
    spark, root = batch.sparkSession, target.rstrip("/")
    responses = (batch if "__good" in batch.columns else unseen(batch, plan, keys)).persist()
    try:
        new = unpack_columnar(responses.filter("__good").withColumn("body", clean_body("body")), "body", "__uneven")
        rows = payload_table(new.filter("NOT __uneven"), "body", ["url", *keys], pos="__pos").drop("__pos")
        versions = stored_versions(spark, root, before=epoch)
        rows, versions = conform(rows, versions)
        (rows.write.mode("overwrite").partitionBy(*partition_by)
         .parquet(f"{root}/rows/version={len(versions) - 1}/batch_id={epoch}"))
        error_rows(responses, new.filter("__uneven")).write.mode("overwrite").parquet(f"{root}/errors/batch_id={epoch}")
        store_versions(spark, root, epoch, versions)
    finally:
        responses.unpersist()


def read_errors(spark: SparkSession, target: str) -> DataFrame:
    """The responses that gave no rows, with the reason."""
    return spark.read.schema(ERROR_SCHEMA).parquet(f"{target.rstrip('/')}/errors").drop("batch_id")


def incremental_load(spark: SparkSession, landing: str, plan: DataFrame, target: str,
                     checkpoint: str, max_files_per_trigger: int | None = None,
                     keys=MONTH_CELL) -> None:
    """Load every landing file not loaded before, then stop."""
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(landing)
    cells = cells_by_url(plan, "url", tuple(keys)).persist()  # catalog-sized, reused by every batch
    try:
        query = (unseen(stream, cells, keys).writeStream
                 .foreachBatch(lambda df, epoch: process_batch(df, cells, target, epoch, keys))
                 .option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True)
                 .start())
        query.awaitTermination()
    finally:
        cells.unpersist()


def read_loaded(spark: SparkSession, target: str) -> DataFrame:
    """The loaded table, all versions in the types of the last."""
    versions = stored_versions(spark, target)
    if not versions:
        return spark.createDataFrame([], "url STRING")
    return read_versions(spark, f"{target.rstrip('/')}/rows", versions)
