"""The retry run as one job (survey I3, F3, X6-X9, K3, K4, S10, C10).

Input: the queue of failed requests, the responses a fetcher brought for them,
and the catalog. :func:`retry_outcomes` gives every distinct request one row
with its fate; rows, new errors and the next queue are three selections of it,
so they always add up:

=============  =================================================  ========  =====
outcome        meaning                                            logged    stays
=============  =================================================  ========  =====
``loaded``     well-formed response of a known municipality       no        no
``empty``      blank response                                     no        yes
``error``      HTTP error                                         yes       yes
``invalid``    the response is not JSON                           yes       yes
``missing``    no response yet                                    no        yes
``skipped``    the URL has no parameters, or no part after api    no        yes
``unmatched``  no municipality (with that unit) has the base URL  no        yes
=============  =================================================  ========  =====

The cell of a request is read back from its URL, the inverse of the planned
URLs: topic from the path, period and unit from the parameters.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.urls import path_after_marker, query_params, repair_retry_url, retry_eligible_te, retry_eligible_tp, topic_table_name, url_part
from civicspark.operators.nested import OK, classify_responses, clean_body, payload_table, unpack_columnar
from civicspark.operators.retry import retry_lookup

MONTHLY, YEARLY = "monthly", "yearly"
LOADED, MISSING, SKIPPED, UNMATCHED = "loaded", "missing", "skipped", "unmatched"


class RetryRun(NamedTuple):
    rows: DataFrame
    errors: DataFrame
    queue: DataFrame


def parameter(url: Column, name: str) -> Column:
    """The last value of a query parameter, its name read in any case; NULL
    where the URL has none."""
    pairs = F.filter(query_params(url_part(url, "QUERY")), lambda p: F.lower(p["key"]) == name.lower())
    return F.get(pairs, F.size(pairs) - 1)["value"]


def request_cell(url: Column, vendor: str = MONTHLY) -> dict[str, Column]:
    """The inverse of the planned URLs (X4, X5): table name, unit, year and
    month of a repaired request URL; text that is no number gives NULL."""
    if vendor == MONTHLY:
        return {"table_name": topic_table_name(url_part(url, "PATH")), "unidadegestora": F.lit(None).cast("string"),
                "ano": parameter(url, "ano").try_cast("int"), "mes": parameter(url, "mes").try_cast("int")}
    return {"table_name": path_after_marker(url_part(url, "PATH")), "unidadegestora": parameter(url, "unidadeGestoraId"),
            "ano": parameter(url, "exercicio").try_cast("int"), "mes": F.lit(None).cast("int")}


def retry_outcomes(queue: DataFrame, responses: DataFrame, catalog: DataFrame, vendor: str = MONTHLY, url: str = "url") -> DataFrame:
    """One row per distinct repaired URL of ``queue`` (``request``): its cell,
    municipality, response and ``outcome``. ``responses``: (url, status, body,
    fetched_at); of several for one URL the last one counts (a good one before
    a bad one of the same time). ``catalog``: (id, url, municipio, prefeitura,
    unidadegestora)."""
    eligible = retry_eligible_tp if vendor == MONTHLY else retry_eligible_te
    asked = queue.select(repair_retry_url(F.col(url)).alias("request")).distinct()
    asked = asked.select("request", F.coalesce(eligible(F.col("request")), F.lit(False)).alias("eligible"),
                         *[c.alias(n) for n, c in request_cell(F.col("request"), vendor).items()])
    matched = retry_lookup(asked.filter("eligible").select("request", "unidadegestora"), catalog, failed_id="request", failed_url="request",
                           catalog_cols=["municipio", "prefeitura"], failed_unit=F.col("unidadegestora") if vendor == YEARLY else None,
                           catalog_unit="unidadegestora" if vendor == YEARLY else None).drop("unidadegestora", "catalog_base")
    answers = classify_responses(responses).withColumn("request", repair_retry_url(F.col("url")))
    last = F.max_by(F.struct("status", "body", "fetched_at", "response_class"), F.struct(
        F.coalesce(F.col("fetched_at").cast("string"), F.lit("")), F.col("response_class") == OK, F.sha2(F.coalesce("body", F.lit("")), 256)))
    answers = answers.groupBy("request").agg(last.alias("r")).select("request", "r.*")
    all_ = asked.join(matched, "request", "left").join(answers, "request", "left")
    outcome = (F.when(~F.col("eligible"), SKIPPED).when(F.col("catalog_id").isNull(), UNMATCHED).when(F.col("response_class").isNull(), MISSING)
               .when(F.col("response_class") == OK, LOADED).otherwise(F.col("response_class")))
    return all_.withColumn("outcome", outcome).drop("eligible", "response_class")


def retry_run(queue: DataFrame, responses: DataFrame, catalog: DataFrame, vendor: str = MONTHLY, url: str = "url",
              outcomes: DataFrame | None = None, index_arrays: bool = False) -> RetryRun:
    """The flat rows of answered requests with their stamps, the log rows of
    those that failed again, and the next queue. Give ``outcomes`` a stored
    copy of :func:`retry_outcomes` to have it computed once."""
    out = outcomes if outcomes is not None else retry_outcomes(queue, responses, catalog, vendor, url)
    keep = ["request", "table_name", "municipio", "prefeitura", *(["unidadegestora", "ano"] if vendor == YEARLY else ["ano", "mes"])]
    loaded = unpack_columnar(out.filter(F.col("outcome") == LOADED).withColumn("body", clean_body("body")), "body", "__uneven")
    rows = payload_table(loaded.filter("NOT __uneven"), "body", keep, index_arrays, pos="__pos").drop("__pos")
    failed = out.filter(F.col("outcome").isin("error", "invalid")).select(
        F.col("fetched_at").alias("ts"), F.col("request").alias("url"), F.col("outcome").alias("error_type"),
        F.concat_ws(" ", F.lit("status"), F.col("status").cast("string")).alias("message"))
    gone = out.filter(F.col("outcome") == LOADED).select(F.col("request").alias("__request"))
    left = queue.withColumn("__request", repair_retry_url(F.col(url))).join(gone, "__request", "left_anti").drop("__request")
    return RetryRun(rows, failed, left)
