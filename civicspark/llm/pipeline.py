"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and
returns a frame; all but the last return the columns of ``docs``.

A stage's result reads scratch tables until it is stored. When the next stage
of the thread is given ``docs`` that were stored after the earlier stage
returned, that stage's tables are deleted, so the disk holds those of one stage
at a time; given other ``docs``, nothing is deleted.

Defined results: every stage takes nulls in any column, empty tables, repeated
rows and columns that clash with an operator's own; a document whose lines all
go elsewhere goes; rows without words are no near duplicates of one another.
"""

from __future__ import annotations

import threading
import time
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import decontaminate, line_dedup, ngram_join, packing, quality
from civicspark.llm.common import drop, materialize, q, scratch_mark, taken


_before = threading.local()


def stored_after(spark: SparkSession, docs: DataFrame, moment: float) -> bool:
    """True if the files that ``docs`` reads are no older than ``moment``."""
    files = docs.inputFiles()
    if not files:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() >= 1000 * moment


def stage(work):
    """A stage function that takes over the scratch tables it writes, and
    deletes those of the stage whose stored result it is given."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths, moment = getattr(_before, "stage", ([], 0.0))
        if paths and stored_after(spark, docs, moment):
            drop(spark, paths)
            paths = []
        mark = scratch_mark()
        out = work(spark, docs, sf_dir)
        _before.stage = (taken(mark) if not paths else [*paths, *taken(mark)], time.time())
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    judged = quality.quality(docs, prefix=prefix)
    return judged.filter(q(f"{prefix}kept")).select(*[q(c) for c in docs.columns])


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay elsewhere; n_chars follows the
    text. A document that loses all its lines goes."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_lost")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    out = out.filter((F.col("n_lost") == 0) | (F.col("n_lost") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_lost") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[q(own.get(c, c)).alias(c) for c in docs.columns])


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles."""
    return ngram_join.one_each(docs).select(*[q(c) for c in docs.columns])


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*[q(c) for c in docs.columns])


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str, stages=None) -> DataFrame:
    """All stages over ``documents``, each stage's output written and read again."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, work in stages or STAGES:
        out, mark = work(spark, docs, sf_dir), scratch_mark()
        docs = materialize(out, f"pipeline-{name}")
        drop(spark, [*written, *_before.stage[0]])  # the stage's tables, and its input
        written, _before.stage = taken(mark), ([], 0.0)
    return docs
