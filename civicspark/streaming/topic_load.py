"""Load per topic: one table and one schema for each topic (survey S5, C6, C11, I1, K1).

Each topic of a vendor is a table of its own, so a field that is a number in
one topic and text in another stays apart. A micro-batch

1. takes the responses not seen before (``unseen``: the stream's own
   checkpointed state, no stored ledger is read),
2. stamps them with their plan cell and writes them once, dealt by table,
3. infers all tables' schemas in one grouped pass (one row a table reaches
   the driver),
4. for each table parses its responses with its own schema, lets a later fetch
   run replace the cell's earlier rows, and swaps in the touched partitions.

**Superseding.** A cell is a request URL. Responses of one fetch run add up;
a later run replaces what earlier runs brought, whichever arrives first, and
an older run that arrives late changes nothing. Only partitions with a cell of
the batch are read and written again (copy on write). A response without rows
leaves a marker row, so that it replaces, and is remembered, like any other;
readers do not see markers.

Layout of ``target``, for each table ``tables/<name>``: rows in
``version=<v>/<partitions>``, schemas of all versions in ``schema/batch_id=<n>``;
beside them ``errors/batch_id=<n>`` and the staging folder ``_stage``. New
columns stay in a version, a column whose type changes opens the next one; a
partition that is written again moves to the last version.

A micro-batch that is run again after a failure does the swaps that are left
(its staged partitions are complete from the moment ``_SUCCESS`` is there), so
rows stay the same. One checkpoint belongs to one target.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.functions.urls import topic_table_name
from civicspark.operators.nested import clean_body, infer_payloads, payload_table, unpack_columnar
from civicspark.operators.schema import cells_by_url
from civicspark.plans.extraction import MONTH_CELL
from civicspark.sources.tables import _fs, list_tables, path_exists
from civicspark.sources.versioned import conform, read_versions, store_versions, stored_versions
from civicspark.streaming.incremental import ERROR_SCHEMA, error_rows, unseen

LANDING_SCHEMA = "url STRING, status INT, body STRING, fetched_at TIMESTAMP_NTZ, run_id LONG"
RESPONSE = ("url", "run_id", "body_sha")
MARKER = "none"  # the position of a response without rows


def row_id(pos: Column) -> Column:
    """C11: a key of the source alone: URL, body and place in the body."""
    return F.concat_ws(":", F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), "body_sha"), 256), pos)


def table_path(target: str, name: str) -> str:
    return f"{target.rstrip('/')}/tables/topic={quote(name, safe='')}"


def load_batch(batch: DataFrame, cells: DataFrame, target: str, epoch: int, keys=MONTH_CELL,
               partition_by: tuple[str, ...] = ("ano",), index_arrays: bool = False, parallel: int = 4) -> None:
    """One micro-batch of responses tagged by ``unseen`` (a table of plain
    responses is tagged here). ``cells``: (url, *keys), one row per URL,
    ``topic`` among the keys."""
    spark, root = batch.sparkSession, target.rstrip("/")
    stage = f"{root}/_stage/batch_id={epoch}"
    if not path_exists(spark, f"{stage}/dealt/_SUCCESS"):
        responses = (batch if "__good" in batch.columns else unseen(batch, cells, keys, RESPONSE)).persist()
        try:
            good = unpack_columnar(responses.filter("__good").withColumn("body", clean_body("body")), "body", "__uneven")
            error_rows(responses, good.filter("__uneven")).write.mode("overwrite").parquet(f"{root}/errors/batch_id={epoch}")
            dealt = good.filter("NOT __uneven").withColumn("run_id", F.coalesce("run_id", F.lit(-1)))  # no run: before all others
            dealt.select(*RESPONSE, *keys, "body", topic_table_name("topic").alias("__table")).write.mode("overwrite").partitionBy("__table").parquet(f"{stage}/dealt")
        finally:
            responses.unpersist()
    drop_stages(spark, root, epoch)
    fields = {"body_sha": T.StringType()} | {f.name: f.dataType for f in batch.schema.fields} | {f.name: f.dataType for f in cells.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c]) for c in (*RESPONSE, *keys)] + [T.StructField("body", T.StringType()), T.StructField("__table", T.StringType())])
    dealt = spark.read.schema(schema).parquet(f"{stage}/dealt")
    inferred = infer_payloads(dealt, "body", "__table")
    touched: dict[str, list[tuple]] = {}
    for r in dealt.select("__table", *partition_by).distinct().collect():  # partitions of the batch, not rows
        touched.setdefault(r[0], []).append(tuple(r)[1:])

    def one(name: str) -> None:
        table, staged = table_path(root, name), f"{stage}/rows/topic={quote(name, safe='')}"
        if not path_exists(spark, f"{staged}/_SUCCESS"):
            part = dealt.filter(F.col("__table") == name).drop("__table")
            merge_rows(part, inferred[name], table, staged, epoch, keys, partition_by, touched[name], index_arrays)
        swap_partitions(spark, staged, table, len(stored_versions(spark, table, before=epoch + 1)) - 1, len(partition_by))

    with ThreadPoolExecutor(parallel) as pool:  # tables do not depend on one another
        list(pool.map(inheritable_thread_target(spark)(one), sorted(inferred)))


def merge_rows(part: DataFrame, inferred: tuple[str | None, bool], table: str, staged: str, epoch: int,
               keys, partition_by: tuple[str, ...], touched: list[tuple], index_arrays: bool) -> None:
    """Write to ``staged`` the whole new content of the partitions that the
    responses ``part`` of one table touch, and the table's new schema."""
    spark, keep = part.sparkSession, [*RESPONSE, *keys]
    rows = payload_table(part, "body", keep, index_arrays, pos="__pos", inferred=inferred)
    clash = next((c for c in rows.columns if c.lower() == "row_id"), None)
    rows = rows.withColumnRenamed(clash, "payload_row_id") if clash else rows
    rows = rows.withColumn("row_id", row_id(F.col("__pos").cast("string"))).drop("__pos")
    empty = part.select(*keep).join(rows.select(*RESPONSE).distinct(), list(RESPONSE), "left_anti")
    rows = rows.unionByName(empty.withColumn("row_id", row_id(F.lit(MARKER))), allowMissingColumns=True)
    rows, versions = conform(rows, stored_versions(spark, table, before=epoch))
    # each response has a row or a marker, so the bodies need not be parsed for this
    newest = part.groupBy("url").agg(F.max("run_id").alias("__new"))
    old = read_versions(spark, table, versions, versions[-1])
    if old is not None:
        old = old.filter(_any_of(touched, partition_by))
        had = old.join(newest, "url", "left_semi").groupBy("url").agg(F.max("run_id").alias("__old"))
        last = newest.join(had, "url", "left").select("url", F.greatest("__new", "__old").alias("__last"))
        # a response that is already there (a restarted load) does not come twice
        fresh = rows.join(old.join(newest, "url", "left_semi").select("row_id", "run_id"), ["row_id", "run_id"], "left_anti").select(*rows.columns)
        held = old.join(last, "url", "left").filter(F.col("__last").isNull() | (F.col("run_id") == F.col("__last"))).drop("__last")
        rows = fresh.join(last, "url").filter(F.col("run_id") == F.col("__last")).drop("__last").unionByName(held, allowMissingColumns=True)
    else:
        rows = rows.join(newest, "url").filter(F.col("run_id") == F.col("__new")).drop("__new")
    store_versions(spark, table, epoch, versions)
    rows.select(*[F.col(f"`{c}`") for c in versions[-1].fieldNames()]).write.mode("overwrite").partitionBy(*partition_by).parquet(staged)


def _any_of(values: list[tuple], columns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for v in values:
        one = F.lit(True)
        for c, x in zip(columns, v):
            one = one & F.col(c).eqNullSafe(F.lit(x))
        out = out | one
    return out


def drop_stages(spark: SparkSession, root: str, epoch: int) -> None:
    """Remove what earlier micro-batches staged; they are done."""
    for name in list_tables(spark, f"{root}/_stage"):
        if int(name.split("=")[1]) < epoch:
            fs, path = _fs(spark, f"{root}/_stage/{name}")
            fs.delete(path, True)


def swap_partitions(spark: SparkSession, staged: str, table: str, version: int, depth: int) -> None:
    """Move every staged partition over the table's, which disappears from
    all versions. Partitions that were moved before are no longer staged, so
    this may be run again after a failure at any point."""
    fs, top = _fs(spark, staged)
    Path = spark._jvm.org.apache.hadoop.fs.Path

    def leaves(path, left):
        if not left:
            return [path]
        inside = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
        return [x for p in inside for x in leaves(p, left - 1)]

    for leaf in leaves(top, depth):
        name = leaf.toString()[len(fs.makeQualified(top).toString()):].lstrip("/")
        for v in range(version + 1):
            fs.delete(Path(f"{table}/version={v}/{name}"), True)
        place = Path(f"{table}/version={version}/{name}")
        fs.mkdirs(place.getParent())
        if not fs.rename(leaf, place):
            raise IOError(f"could not move {leaf} to {place}")


def topic_tables(spark: SparkSession, target: str) -> list[str]:
    """Names of the loaded tables."""
    path = f"{target.rstrip('/')}/tables"
    return sorted(unquote(n.split("=", 1)[1]) for n in list_tables(spark, path)) if path_exists(spark, path) else []


def read_topic(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One topic's table with the types of its last version."""
    table = table_path(target, name)
    versions = stored_versions(spark, table)
    return read_versions(spark, table, versions, versions[-1]).filter(~F.col("row_id").endswith(f":{MARKER}"))


def read_topic_errors(spark: SparkSession, target: str) -> DataFrame:
    """The responses that gave no rows, with the reason."""
    return spark.read.schema(ERROR_SCHEMA).parquet(f"{target.rstrip('/')}/errors").drop("batch_id")


def load_by_topic(spark: SparkSession, landing: str, plan: DataFrame, target: str, checkpoint: str,
                  max_files_per_trigger: int | None = None, keys=MONTH_CELL, partition_by: tuple[str, ...] = ("ano",),
                  index_arrays: bool = False) -> None:
    """Load every landing file not loaded before into the topics' tables, then stop."""
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    cells = cells_by_url(plan, "url", tuple(keys)).persist()  # catalog-sized, reused by every batch
    try:
        query = (unseen(reader.parquet(landing), cells, keys, RESPONSE).writeStream
                 .foreachBatch(lambda df, epoch: load_batch(df, cells, target, epoch, keys, partition_by, index_arrays))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        cells.unpersist()
