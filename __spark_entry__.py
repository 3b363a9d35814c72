"""

built from the driver tables (``standins.py``); ``oracle_sql()`` gives, per
key, an independent DuckDB answer over the same parquet tables (the
stand-in CASE expressions are repeated in SQL). Column names match on both
sides. ``surrogate_id`` answers with counts (a hash has no DuckDB twin).
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import consolidation_queries as CQ
import standins as S
from civicspark.functions import text as TX
from civicspark.functions import urls as U
from civicspark.operators import indicators as IND
from civicspark.operators import nested as N
from civicspark.operators import profile as P
from civicspark.operators import retry as R
from civicspark.operators import schema as C
from civicspark.operators import unify as UN
from civicspark.plans import extraction as X
from civicspark.plans import periods as PR
from civicspark.session import scratch_path
from civicspark.sources import catalogs as CAT
from civicspark.sources import tables as TB
from civicspark.streaming import incremental as INC
from civicspark.streaming import retry_queue as RQ

FLAGSHIP_SF = "/root/testdata/sf0.001"


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _order_plan(spark, d) -> DataFrame:
    start, end = S.month_bounds(S.table(spark, d, "orders"), "o_orderdate")
    return X.monthly_plan(S.nation_catalog(spark, d), S.order_topics(spark, d), start, end)


def _event_plan(spark, d) -> DataFrame:
    start, end = S.month_bounds(S.table(spark, d, "events"), "ts")
    return X.monthly_plan(S.nation_catalog(spark, d), S.event_topics(spark, d), start, end)


def q_extraction_plan(spark, d):
    return _order_plan(spark, d)


def q_pending_cells(spark, d):
    return X.pending_cells(_order_plan(spark, d), S.order_ledger(spark, d))


def q_loaded_cells(spark, d):
    return X.loaded_cells(_order_plan(spark, d), S.order_ledger(spark, d))


def q_portal_coverage(spark, d):
    return IND.portal_coverage(_order_plan(spark, d), S.order_ledger(spark, d),
                               list(X.MONTH_CELL), ["municipio", "topic"], S.catalog_with_uncovered(spark, d))


def _yearly_plan(spark, d) -> DataFrame:
    return X.yearly_plan(S.nation_catalog(spark, d), S.yearly_topics(spark, d), 1995, 1999)


def q_yearly_plan(spark, d):
    return _yearly_plan(spark, d)


def q_yearly_pending(spark, d):
    return X.pending_cells(_yearly_plan(spark, d), S.yearly_ledger(spark, d), X.YEAR_CELL)


def q_validate_years(spark, d):
    return PR.validate_years(S.year_requests(spark, d), "ano_inicio", "ano_fim", 2008)


def q_payload_errors(spark, d):
    return N.payload_errors(S.columnar_orders(spark, d).withColumn("status", F.lit(200)), keep=["o_orderkey"])


def q_month_range(spark, d):
    return PR.months_spanned(S.table(spark, d, "orders"), "o_orderdate")


def q_year_range(spark, d):
    return PR.years_spanned(S.table(spark, d, "orders"), "o_orderdate")


def q_high_water_mark(spark, d):
    return X.high_water_mark(S.order_ledger(spark, d), ["empresa", "topic"])


def q_resume_plan(spark, d):
    return X.resume_plan(S.order_ledger(spark, d), S.nation_catalog(spark, d), end=(2002, 2),
                         topics=S.topics_with_unloaded(spark, d), first=(2001, 11))


def q_build_month_url(spark, d):
    cells = S.order_ledger(spark, d).select("topic", "municipio", "ano", "mes", "base_url").distinct()
    return cells.select("topic", "municipio", "ano", "mes",
                        U.month_url(U.normalize_url("base_url"), "topic", "ano", "mes").alias("url"))


def q_build_template_url(spark, d):
    c = S.part_template_cells(spark, d)
    return c.select("p_partkey", U.template_url("base_url", "topic", "template", "unit", "ano").alias("url"))


def q_validate_periods(spark, d):
    return PR.validate_periods(S.period_requests(spark, d), "periodo_inicio", "periodo_fim")


def q_vendor_filter(spark, d):
    return X.vendor_filter(S.customer_catalog(spark, d), "BUILDING")


def q_scan_catalog_csv(spark, d):
    path = scratch_path(spark, "catalog_csv")
    (S.customer_catalog(spark, d).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return CAT.read_catalog_csv(spark, path)


def q_scan_topics_null_fill(spark, d):
    path = scratch_path(spark, "topics_csv")
    (S.part_topics(spark, d).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return CAT.read_topics_csv(spark, path)


def q_scan_line_list(spark, d):
    path = scratch_path(spark, "line_list")
    S.pages_line_list(spark, d).write.text(path)
    return CAT.read_line_list(spark, path)


def q_scan_error_log(spark, d):
    path = scratch_path(spark, "error_log")
    S.pages_error_log_lines(spark, d).write.text(path)
    return CAT.read_error_log(spark, path)


def q_scan_json_payload(spark, d):
    landing = S.event_landing(spark, d).select("response_id", "url", "status", "body")
    return N.scan_json_payload(landing, keep=["response_id", "url"])


def q_scan_table_ignore_case(spark, d):
    root = scratch_path(spark, "db")
    S.table(spark, d, "orders").write.parquet(f"{root}/Orders")
    S.table(spark, d, "region").write.parquet(f"{root}/region")
    return TB.read_table_ignore_case(spark, root, "ORDERS")


def q_sink_append(spark, d):
    path = scratch_path(spark, "append")
    o = S.table(spark, d, "orders").withColumn("ano", F.year("o_orderdate"))
    TB.append_rows(o.filter("o_orderkey % 2 = 0"), path)
    TB.append_rows(o.filter("o_orderkey % 2 = 1"), path)
    return spark.read.parquet(path)


def q_sink_overwrite(spark, d):
    path = scratch_path(spark, "overwrite")
    TB.overwrite_atomic(S.table(spark, d, "orders"), path)
    current = spark.read.parquet(path)
    TB.overwrite_atomic(current.withColumn("o_orderstatus", F.lower("o_orderstatus")), path)
    return spark.read.parquet(path)


def q_sink_ctas(spark, d):
    path = scratch_path(spark, "ctas")
    name = "ctas_" + path.rsplit("-", 1)[-1]
    src = S.process_numbers(spark, d)
    out = TX.compose_process_number(src, "processo", "anoprocesso").drop("processo", "anoprocesso")
    return TB.create_table_as(out, name, path)


def q_sink_errors(spark, d):
    path = scratch_path(spark, "errors")
    p = S.table(spark, d, "pages")
    failed = p.select(F.current_timestamp().alias("ts"), "url", F.lit("HTTPError").alias("error_type"),
                      F.concat(F.lit("500 Server Error for url: "), F.col("url")).alias("message"))
    TB.append_errors(failed.filter("length(url) % 2 = 0"), path)
    TB.append_errors(failed.filter("length(url) % 2 = 1"), path)
    logged = CAT.read_error_log(spark, path)
    stamp_ok = F.col("logged_at").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")  # X15 format
    return logged.withColumn("logged_at_format_ok", stamp_ok).drop("logged_at")


def q_rename_columns(spark, d):
    return C.rename_columns(S.table(spark, d, "nation"), {"n_name": "municipio", "n_regionkey": "regiao"})


def q_rename_swap(spark, d):
    return C.rename_columns(S.table(spark, d, "nation"), {"n_name": "n_regionkey", "n_regionkey": "n_name"})


RETYPE = {"o_orderkey": "TEXT", "o_custkey": "REAL", "o_orderpriority": "INTEGER", "o_orderdate": "TEXT"}


def q_retype_columns(spark, d):
    return C.retype_columns(S.table(spark, d, "orders"), RETYPE)


def q_drop_columns(spark, d):
    return C.drop_columns(S.table(spark, d, "part"), ["p_brand", "p_type"])


def q_normalize_column_names(spark, d):
    c = S.table(spark, d, "customer")
    messy = c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey").toDF(
        " C_CUSTKEY", "C_Name ", "c_name", "c_acctbal", "C_ACCTBAL")
    return C.normalize_column_names(messy)


def q_schema_evolution_append(spark, d):
    path = scratch_path(spark, "evolve")
    existing = S.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    batch = S.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("Name"),
        F.col("s_acctbal").alias("ACCTBAL"), F.col("s_nationkey").alias("nationkey"))
    existing.write.parquet(path)
    C.fold_case_like(batch, existing.columns).write.mode("append").parquet(path)
    return TB.read_evolving(spark, path)


def q_stamp_metadata(spark, d):
    landing = S.event_landing(spark, d).select("response_id", "url", "status", "body")
    ok = N.fetched_bodies(landing)
    ddl = N.infer_rows_schema(ok)
    stamped = C.stamp_responses(ok, _event_plan(spark, d))
    keep = ["response_id", "url", "municipio", "prefeitura", "ano", "mes"]
    return N.flatten_struct(N.json_rows(stamped, keep=keep, element_ddl=ddl))


def q_surrogate_id(spark, d):
    o = S.table(spark, d, "orders").select(
        F.format_string("https://portal.example/api/pedidos?cliente=%d", F.col("o_custkey")).alias("url"),
        F.col("o_orderkey").alias("pos"))
    ids = C.surrogate_id(o)
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_distinct_ids"))


def q_classify_responses(spark, d):
    landing = S.event_landing(spark, d)
    return N.classify_responses(landing).select("response_id", "status", "response_class")


def q_run_metrics(spark, d):
    return P.run_metrics(N.classify_responses(S.event_landing(spark, d)), ["topic"])


def q_retry_eligible(spark, d):
    f = S.pages_failed_api(spark, d).withColumn("fixed", U.repair_retry_url("url"))
    return f.select("page_id", U.retry_eligible_tp("fixed").alias("eligible_tp"),
                    U.retry_eligible_te("fixed").alias("eligible_te"))


def q_normalize_url(spark, d):
    return S.pages_raw_urls(spark, d).select("page_id", "raw_url", U.normalize_url("raw_url").alias("url"))


def q_strip_api_chars(spark, d):
    return S.pages_api_urls(spark, d).select("page_id", U.strip_api_chars(U.normalize_url("raw_url")).alias("base_url"))


def q_topic_table_name(spark, d):
    return S.pages_topics(spark, d).select("page_id", "topic", U.topic_table_name("topic").alias("table_name"))


def q_repair_retry_url(spark, d):
    return S.pages_raw_urls(spark, d).select("page_id", U.repair_retry_url("raw_url").alias("url"))


def q_url_parts(spark, d):
    p = S.pages_with_port(spark, d)
    return p.select("page_id", *[U.url_part("url", part).alias(name) for part, name in
                                 (("PROTOCOL", "scheme"), ("AUTHORITY", "authority"), ("HOST", "host"),
                                  ("PATH", "path"), ("QUERY", "query"))])


def q_url_query_params(spark, d):
    p = S.pages_with_params(spark, d)
    kv = p.select("page_id", F.explode(U.query_params(U.url_part("url", "QUERY"))).alias("kv"))
    return kv.select("page_id", F.col("kv.key").alias("param"), F.col("kv.value").alias("value"))


def q_path_after_marker(spark, d):
    f = S.pages_failed_api(spark, d)
    return f.select("page_id", U.path_after_marker(U.url_part(U.repair_retry_url("url"), "PATH")).alias("endpoint"))


def q_compose_process_number(spark, d):
    out = TX.compose_process_number(S.process_numbers(spark, d), "processo", "anoprocesso")
    return out.select("l_orderkey", "l_linenumber", "processo_formatado")


def q_coerce_numeric(spark, d):
    v = UN.coerce_column(S.event_values(spark, d), "valor")
    return v.select("event_id", "valor")


def q_coercion_rejects(spark, d):
    return UN.coercion_rejects(S.event_values(spark, d), "valor", ["event_type"])


def q_json_stringify(spark, d):
    return TX.stringify_nested(S.int_embeddings(spark, d)).withColumnRenamed("embedding", "embedding_json")


def q_json_rows(spark, d):
    return N.json_rows(S.flat_landing(spark, d), keep=["response_id"])


def q_flatten_struct(spark, d):
    return N.flatten_struct(S.nested_lines(spark, d))


def q_flatten_indexed(spark, d):
    return N.flatten_struct(S.indexed_lines(spark, d), index_arrays=True)


def q_zip_columns_to_rows(spark, d):
    rows = N.json_rows(S.columnar_orders(spark, d), keep=["o_orderkey"]).drop("pos")
    payload = rows.select("o_orderkey", F.struct("linha", "valor").alias("payload"))
    zipped, _errors = N.zip_columns_to_rows(payload, "payload", ["o_orderkey"])
    return zipped


def q_json_scalar_valor(spark, d):
    return N.scalar_valor(S.scalar_landing(spark, d), keep=["response_id"])


def q_retry_lookup(spark, d):
    failed = S.table(spark, d, "pages").select("page_id", "url")
    return R.retry_lookup(failed, S.pages_catalog(spark, d), failed_id="page_id")


def q_retry_unmatched(spark, d):
    failed = S.table(spark, d, "pages").select("page_id", "url")
    matched = R.retry_lookup(failed, S.pages_catalog(spark, d), failed_id="page_id")
    return R.retry_unmatched(failed, matched, "page_id")


def q_merge_outer_common(spark, d):
    left, right = S.merge_sides(spark, d)
    return UN.merge_outer_common(left, right)


def q_concat_disjoint(spark, d):
    return UN.concat_disjoint(S.table(spark, d, "region"), S.table(spark, d, "labels"))


def q_distinct_rows(spark, d):
    return UN.distinct_rows(S.table(spark, d, "documents").select("lang", "source", "text"))


def q_dedup_by_key(spark, d):
    return UN.dedup(S.table(spark, d, "documents"), keys=["text"], order_by=["doc_id"])


def q_dedup_missing_key_fallback(spark, d):
    return UN.dedup(S.table(spark, d, "documents").select("source", "lang"), keys=["checksum"])


def q_unify_tables(spark, d):
    t1, t2 = S.unify_sides(spark, d)
    path = scratch_path(spark, "unified")
    TB.overwrite_atomic(UN.unify_tables(t1, t2), path)
    return spark.read.parquet(path)


def q_table_profile(spark, d):
    return P.table_profile(S.table(spark, d, "lineitem"))


def q_multi_employment(spark, d):
    li = S.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("person"), F.col("l_suppkey").alias("employer"),
        F.year("l_shipdate").alias("ano"), F.month("l_shipdate").alias("mes"))
    return IND.multi_employment(li, "person", "employer")


def q_price_outliers(spark, d):
    li = S.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").alias("ano"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"))
    return IND.price_outliers(li, "l_partkey", ["ano"], "unit_price")


def q_incremental_load(spark, d):
    base = scratch_path(spark, "incremental")
    landing, target, cp = f"{base}/landing", f"{base}/table", f"{base}/_checkpoint"
    resp = S.event_landing(spark, d)
    cols = ["url", "status", "body", "fetched_at"]
    resp.repartition(5).select(*cols).write.parquet(landing)
    plan = _event_plan(spark, d)
    INC.incremental_load(spark, landing, plan, target, cp, max_files_per_trigger=2)
    INC.incremental_load(spark, landing, plan, target, cp)          # replay: no new files
    resp.filter(F.col("event_id") % 2 == 0).select(*cols).write.mode("append").parquet(landing)
    INC.incremental_load(spark, landing, plan, target, cp)          # late copies of loaded responses
    return INC.read_loaded(spark, target)


def q_retry_queue_rewrite(spark, d):
    path = scratch_path(spark, "retry_queue")
    queue = S.table(spark, d, "pages").select(
        "url", F.lit("HTTPError").alias("error_type"), F.lit("503 Server Error").alias("message"))
    queue.write.parquet(path)
    return RQ.rewrite_retry_queue(spark, path, S.pages_retry_results(spark, d))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # 2.1 scans, sources, sinks
    "scan_catalog_csv": q_scan_catalog_csv,
    "scan_topics_null_fill": q_scan_topics_null_fill,
    "scan_line_list": q_scan_line_list,
    "scan_error_log": q_scan_error_log,
    "scan_json_payload": q_scan_json_payload,
    "scan_table_ignore_case": q_scan_table_ignore_case,
    "sink_append": q_sink_append,
    "sink_overwrite": q_sink_overwrite,
    "sink_ctas": q_sink_ctas,
    "sink_errors": q_sink_errors,
    # 2.2 schema and projection
    "rename_columns": q_rename_columns,
    "rename_swap": q_rename_swap,
    "retype_columns": q_retype_columns,
    "drop_columns": q_drop_columns,
    "normalize_column_names": q_normalize_column_names,
    "schema_evolution_append": q_schema_evolution_append,
    "stamp_metadata": q_stamp_metadata,
    "surrogate_id": q_surrogate_id,
    # 2.3 filters
    "vendor_filter": q_vendor_filter,
    "classify_responses": q_classify_responses,
    "retry_eligible": q_retry_eligible,
    "validate_periods": q_validate_periods,
    "validate_years": q_validate_years,
    # 2.4 scalar functions
    "normalize_url": q_normalize_url,
    "strip_api_chars": q_strip_api_chars,
    "topic_table_name": q_topic_table_name,
    "build_month_url": q_build_month_url,
    "build_template_url": q_build_template_url,
    "repair_retry_url": q_repair_retry_url,
    "url_parts": q_url_parts,
    "url_query_params": q_url_query_params,
    "path_after_marker": q_path_after_marker,
    "compose_process_number": q_compose_process_number,
    "coerce_numeric": q_coerce_numeric,
    "json_stringify": q_json_stringify,
    # 2.5 nested
    "json_rows": q_json_rows,
    "flatten_struct": q_flatten_struct,
    "flatten_indexed": q_flatten_indexed,
    "zip_columns_to_rows": q_zip_columns_to_rows,
    "json_scalar_valor": q_json_scalar_valor,
    "payload_errors": q_payload_errors,
    # 2.6 generators
    "month_range": q_month_range,
    "year_range": q_year_range,
    "extraction_plan": q_extraction_plan,
    "yearly_plan": q_yearly_plan,
    # 2.7 joins
    "pending_cells": q_pending_cells,
    "loaded_cells": q_loaded_cells,
    "yearly_pending": q_yearly_pending,
    "retry_lookup": q_retry_lookup,
    "retry_unmatched": q_retry_unmatched,
    "merge_outer_common": q_merge_outer_common,
    # 2.8 set operations
    "concat_disjoint": q_concat_disjoint,
    "distinct_rows": q_distinct_rows,
    "dedup_by_key": q_dedup_by_key,
    "dedup_missing_key_fallback": q_dedup_missing_key_fallback,
    "unify_tables": q_unify_tables,
    # 2.9 aggregations
    "table_profile": q_table_profile,
    "coercion_rejects": q_coercion_rejects,
    "run_metrics": q_run_metrics,
    "high_water_mark": q_high_water_mark,
    # 2.11 incremental
    "incremental_load": q_incremental_load,
    "resume_plan": q_resume_plan,
    "retry_queue_rewrite": q_retry_queue_rewrite,
    # 2.13 indicators
    "multi_employment": q_multi_employment,
    "price_outliers": q_price_outliers,
    "portal_coverage": q_portal_coverage,
}


# --------------------------------------------------------------------------
# DuckDB side (independent SQL; stand-in CASE expressions repeated)
# --------------------------------------------------------------------------

BOM_SQL = "chr(65279)"


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _norm(e: str) -> str:
    s = _strip(e)
    return f"rtrim(CASE WHEN starts_with({s}, 'http') THEN {s} ELSE 'https://' || ltrim({s}, '/') END, '/')"


_NATION_HOST = "replace(lower(n_name), '_', '-') || '.portal.example'"
_NATION_URL = (f"CASE n_nationkey % 3 WHEN 0 THEN 'https://' || {_NATION_HOST} || '/api/' "
               f"WHEN 1 THEN 'http://' || {_NATION_HOST} || '/api' ELSE ' ' || {_NATION_HOST} || '/api/' END")

CATALOG_CTE = f"""nation_catalog AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, 'Prefeitura de ' || n_name AS prefeitura, lower(n_name) AS municipio,
         {_NATION_URL} AS url, r_name AS empresa, n_nationkey + 1 AS unidadegestora
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

LEDGER_CTE = f"""ledger AS (
  SELECT o_orderkey, o_orderpriority AS topic, lower(n_name) AS municipio, 'Prefeitura de ' || n_name AS prefeitura,
         r_name AS empresa, CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes,
         {_NATION_URL} AS base_url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

ORDER_PLAN_CTES = f"""{CATALOG_CTE},
{LEDGER_CTE},
topics AS (SELECT DISTINCT empresa, topic FROM ledger),
months AS (
  SELECT CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes
  FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
                                      INTERVAL 1 MONTH)) AS d FROM orders)),
plan AS (
  SELECT t.topic, c.municipio, c.prefeitura, c.empresa, m.ano, m.mes,
         printf('%s/%s?ano=%d&mes=%02d', {_norm('c.url')}, t.topic, m.ano, m.mes) AS url
  FROM nation_catalog c JOIN topics t ON c.empresa = t.empresa, months m)"""

_EV_OBJ = ("'{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || "
           "'\",\"value\":' || CAST(value AS VARCHAR) || ',\"ano\":0,\"props\":' || props || '}'")
_EV_PART = "'{\"event_id\":' || event_id || ',\"part\":2}'"

EVENT_LANDING_CTE = f"""ev_base AS (
  SELECT e.*, n.*,
         CASE event_id % 3 WHEN 0 THEN '[' || {_EV_OBJ} || ']' WHEN 1 THEN {_EV_OBJ}
              ELSE {BOM_SQL} || '[' || {_EV_OBJ} || ',' || {_EV_PART} || ']' END AS full_body
  FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey),
ev_landing AS (
  SELECT event_id AS response_id,
         printf('%s/%s?ano=%d&mes=%02d', {_norm(_NATION_URL)}, event_type, year(ts), month(ts)) AS url,
         CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status,
         CASE WHEN event_id % 13 = 0 THEN '   ' WHEN event_id % 17 = 0 THEN substr(full_body, 1, length(full_body) - 2)
              ELSE full_body END AS body,
         event_type AS topic
  FROM ev_base),
ev_classified AS (
  SELECT *, CASE WHEN status >= 400 THEN 'error' WHEN b = '' THEN 'empty' WHEN NOT json_valid(b) THEN 'invalid'
                 ELSE 'ok' END AS response_class
  FROM (SELECT *, {_strip(f"regexp_replace(body, '^' || {BOM_SQL}, '')")} AS b FROM ev_landing)),
ev_ok AS (SELECT response_id, url, CASE WHEN starts_with(b, '{{') THEN '[' || b || ']' ELSE b END AS arr
          FROM ev_classified WHERE response_class = 'ok'),
ev_items AS (
  SELECT response_id, url, CAST(i AS INTEGER) AS pos,
         CAST(json_extract(arr, '$[' || i || '].event_id') AS BIGINT) AS event_id,
         CAST(json_extract(arr, '$[' || i || '].user_id') AS BIGINT) AS user_id,
         json_extract_string(arr, '$[' || i || '].event_type') AS event_type,
         CAST(json_extract(arr, '$[' || i || '].value') AS DOUBLE) AS value,
         CAST(json_extract(arr, '$[' || i || '].ano') AS BIGINT) AS ano,
         CAST(json_extract(arr, '$[' || i || '].props.k') AS BIGINT) AS props_k,
         CAST(json_extract(arr, '$[' || i || '].part') AS BIGINT) AS part
  FROM (SELECT *, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM ev_ok)),
ev_topics AS (
  SELECT DISTINCT r_name AS empresa, event_type AS topic
  FROM events JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ev_months AS (
  SELECT CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes
  FROM (SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS d
        FROM events)),
ev_plan AS (
  SELECT t.topic, c.municipio, c.prefeitura, c.empresa, m.ano, m.mes,
         printf('%s/%s?ano=%d&mes=%02d', {_norm('c.url')}, t.topic, m.ano, m.mes) AS url
  FROM nation_catalog c JOIN ev_topics t ON c.empresa = t.empresa, ev_months m)"""

_URL_SCHEME = "regexp_extract(url, '^([a-z]+)://', 1)"
_URL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_URL_REST = "regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"

RAW_URLS_CTE = f"""raw AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN {_URL_HOST} || {_URL_REST}
                       WHEN 2 THEN {_URL_SCHEME} || '://' || {_URL_HOST} || '/' || {_URL_REST}
                       WHEN 3 THEN '/' || {_URL_HOST} || {_URL_REST} || '/' ELSE url END AS raw_url
  FROM pages)"""

FAILED_API_CTE = f"""failed AS (
  SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN {_URL_SCHEME} || '://' || {_URL_HOST} || '/api' || {_URL_REST}
                       ELSE url END AS url FROM pages),
fixed AS (SELECT page_id, regexp_replace({_norm('url')}, '([^:])/{{2,}}', '\\1/', 'g') AS u FROM failed),
fixed_path AS (SELECT page_id, u, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM fixed),
endpoints AS (
  SELECT page_id, u, CASE WHEN list_position(string_split(path, '/'), 'api') > 0
                          THEN string_split(path, '/')[list_position(string_split(path, '/'), 'api') + 1] END AS endpoint
  FROM fixed_path)"""

CATALOG_PAGES_CTE = f"""cat AS (
  SELECT {_URL_SCHEME} || '://' || {_URL_HOST} AS ck, min(page_id) AS id FROM pages WHERE page_id % 2 = 0 GROUP BY 1
  UNION ALL
  SELECT {_URL_SCHEME} || '://' || {_URL_HOST} || '/' || string_split({_URL_REST}, '/')[2] AS ck, min(page_id) + 100000 AS id
  FROM pages WHERE page_id % 10 = 0 GROUP BY 1),
page_keys AS (
  SELECT page_id, url, lower({_URL_SCHEME} || '://' || {_URL_HOST}) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pk
  FROM pages),
cands AS (
  SELECT p.page_id, p.url, c.id, lower(c.ck) AS ck
  FROM page_keys p JOIN cat c ON p.pk = lower(c.ck) OR starts_with(p.pk, lower(c.ck) || '/')),
best AS (
  SELECT page_id, url, id AS catalog_id, ck AS catalog_base FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(ck) DESC, id) AS rn FROM cands) WHERE rn = 1)"""

_NUM_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def _coerce(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '{_NUM_RE}') THEN TRY_CAST(trim({e}) AS DOUBLE) END"


_TEMPLATE = ("CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '?unidadeGestoraId={unidadeGestoraId}&exercicio={exercicio}' "
             "WHEN 2 THEN 'exercicio={exercicio}&periodo={periodo}' ELSE ' ' END")

_PERIOD_START = ("lpad(CAST(month(o_orderdate) + CASE WHEN o_orderkey % 7 = 0 THEN 6 ELSE 0 END AS VARCHAR), 2, '0') "
                 "|| '/' || CAST(year(o_orderdate) AS VARCHAR)")
_PERIOD_END = "lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '/' || CAST(year(o_orderdate) + 1 AS VARCHAR)"

_SQL: dict[str, str] = {}

_SQL["extraction_plan"] = f"WITH {ORDER_PLAN_CTES} SELECT * FROM plan"
_SQL["pending_cells"] = f"""WITH {ORDER_PLAN_CTES}
SELECT * FROM plan p WHERE NOT EXISTS (
  SELECT 1 FROM ledger l WHERE l.topic = p.topic AND l.municipio = p.municipio AND l.prefeitura = p.prefeitura
                           AND l.ano = p.ano AND l.mes = p.mes)"""
_SQL["loaded_cells"] = f"""WITH {ORDER_PLAN_CTES}
SELECT * FROM plan p WHERE EXISTS (
  SELECT 1 FROM ledger l WHERE l.topic = p.topic AND l.municipio = p.municipio AND l.prefeitura = p.prefeitura
                           AND l.ano = p.ano AND l.mes = p.mes)"""
_SQL["portal_coverage"] = f"""WITH {ORDER_PLAN_CTES},
hits AS (SELECT DISTINCT topic, municipio, prefeitura, ano, mes FROM ledger)
SELECT p.municipio, p.topic, count(*) AS planned_cells, count(h.topic) AS filled_cells,
       round(count(h.topic) / count(*), 4) AS coverage
FROM plan p LEFT JOIN hits h USING (topic, municipio, prefeitura, ano, mes) GROUP BY p.municipio, p.topic
UNION ALL SELECT lower(r_name), NULL, 0, 0, 0.0 FROM region"""
_YEAR_PLAN_CTE = f"""{CATALOG_CTE},
ytopics AS (SELECT r_name AS empresa, lower(p_name) AS assunto, {_TEMPLATE} AS parametros
            FROM part JOIN region ON p_partkey % 5 = r_regionkey),
ycells AS (SELECT t.assunto AS topic, c.municipio, c.prefeitura, CAST(c.unidadegestora AS VARCHAR) AS unidadegestora, c.empresa,
                  CAST(y.ano AS INTEGER) AS ano, c.url AS base, parametros
           FROM nation_catalog c JOIN ytopics t ON c.empresa = t.empresa, (SELECT unnest(generate_series(1995, 1999)) AS ano) y),
yfilled AS (SELECT *, {_strip("replace(replace(replace(coalesce(parametros, ''), '{unidadeGestoraId}', unidadegestora), '{exercicio}', CAST(ano AS VARCHAR)), '{periodo}', '')")} AS t
            FROM ycells),
yplan AS (SELECT topic, municipio, prefeitura, unidadegestora, empresa, ano, rtrim({_norm('base')}, '/api') || '/api/' || topic ||
                 CASE WHEN t = '' THEN '' ELSE replace(CASE WHEN starts_with(t, '?') THEN t ELSE '?' || t END, ' ', '') END AS url
          FROM yfilled)"""
_SQL["yearly_plan"] = f"WITH {_YEAR_PLAN_CTE} SELECT * FROM yplan"
_SQL["yearly_pending"] = f"""WITH {_YEAR_PLAN_CTE},
done AS (SELECT DISTINCT lower(p_name) AS topic, lower(n_name) AS municipio, CAST(n_nationkey + 1 AS VARCHAR) AS unidadegestora,
                unnest(generate_series(1996, 1996 + p_size % 3)) AS ano
         FROM part JOIN nation ON p_partkey % 25 = n_nationkey)
SELECT * FROM yplan p WHERE NOT EXISTS (
  SELECT 1 FROM done l WHERE l.topic = p.topic AND l.municipio = p.municipio AND l.unidadegestora = p.unidadegestora AND l.ano = p.ano)"""
_Y1 = "CAST(year(o_orderdate) + 6 - CASE WHEN o_orderkey % 7 = 0 THEN 10 ELSE 0 END AS VARCHAR)"
_Y2 = "' ' || CAST(year(o_orderdate) + 8 AS VARCHAR)"
_SQL["validate_years"] = f"""WITH r AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'abcd' WHEN o_orderkey % 5 = 0 THEN {_Y2} ELSE {_Y1} END AS ano_inicio,
         CASE WHEN o_orderkey % 5 = 0 THEN {_Y1} ELSE {_Y2} END AS ano_fim FROM orders),
p AS (SELECT *, TRY_CAST(trim(ano_inicio) AS INTEGER) AS y1, TRY_CAST(trim(ano_fim) AS INTEGER) AS y2 FROM r)
SELECT o_orderkey, ano_inicio, ano_fim, reason, reason IS NULL AS valid FROM (
  SELECT *, CASE WHEN y1 IS NULL OR y2 IS NULL THEN 'format' WHEN y1 > y2 THEN 'order'
                 WHEN least(y1, y2) < 2000 OR greatest(y1, y2) > 2008 THEN 'year' END AS reason FROM p)"""
_SQL["payload_errors"] = "SELECT o_orderkey, 'lists of one response differ in length' AS error FROM orders WHERE o_orderkey % 19 = 0"
_SQL["month_range"] = """SELECT CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes
FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
                                    INTERVAL 1 MONTH)) AS d FROM orders)"""
_SQL["year_range"] = """SELECT CAST(unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS INTEGER) AS ano
FROM orders"""
_SQL["high_water_mark"] = f"""WITH {LEDGER_CTE}
SELECT empresa, topic, CAST(floor(max(ano * 12 + mes - 1) / 12) AS INTEGER) AS ano,
       CAST(max(ano * 12 + mes - 1) % 12 + 1 AS INTEGER) AS mes
FROM ledger GROUP BY empresa, topic"""
_SQL["resume_plan"] = f"""WITH {CATALOG_CTE}, {LEDGER_CTE},
marks AS (SELECT empresa, topic, max(make_date(ano, mes, 1)) AS start_month FROM ledger GROUP BY empresa, topic
          UNION ALL SELECT r_name, 'NEVER', DATE '2001-11-01' FROM region),
cells AS (
  SELECT m.topic, c.municipio, c.prefeitura, c.empresa, CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes,
         c.url AS base
  FROM (SELECT empresa, topic, unnest(generate_series(start_month, DATE '2002-02-01', INTERVAL 1 MONTH)) AS d FROM marks) m
  JOIN nation_catalog c ON c.empresa = m.empresa)
SELECT topic, municipio, prefeitura, empresa, ano, mes,
       printf('%s/%s?ano=%d&mes=%02d', {_norm('base')}, topic, ano, mes) AS url
FROM cells p WHERE NOT EXISTS (
  SELECT 1 FROM ledger l WHERE l.topic = p.topic AND l.municipio = p.municipio AND l.prefeitura = p.prefeitura
                           AND l.ano = p.ano AND l.mes = p.mes)"""
_SQL["build_month_url"] = f"""WITH {LEDGER_CTE}
SELECT DISTINCT topic, municipio, ano, mes, printf('%s/%s?ano=%d&mes=%02d', {_norm('base_url')}, topic, ano, mes) AS url
FROM ledger"""
_SQL["build_template_url"] = f"""WITH cells AS (
  SELECT p_partkey, lower(p_type) AS topic, {_TEMPLATE} AS template, {_NATION_URL} AS base_url,
         n_nationkey + 1 AS unit, 1995 + p_partkey % 7 AS ano
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
filled AS (
  SELECT *, {_strip("replace(replace(replace(coalesce(template, ''), '{unidadeGestoraId}', CAST(unit AS VARCHAR)), '{exercicio}', CAST(ano AS VARCHAR)), '{periodo}', '')")} AS t
  FROM cells)
SELECT p_partkey, rtrim({_norm('base_url')}, '/api') || '/api/' || topic ||
       CASE WHEN t = '' THEN '' ELSE replace(CASE WHEN starts_with(t, '?') THEN t ELSE '?' || t END, ' ', '') END AS url
FROM filled"""
_SQL["validate_periods"] = f"""WITH r AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 23 = 0 THEN 'ab/2024' WHEN o_orderkey % 5 = 0 THEN {_PERIOD_END} ELSE {_PERIOD_START} END
           AS periodo_inicio,
         CASE WHEN o_orderkey % 5 = 0 THEN {_PERIOD_START} ELSE {_PERIOD_END} END AS periodo_fim
  FROM orders),
p AS (
  SELECT *, TRY_CAST(string_split(periodo_inicio, '/')[1] AS INTEGER) AS m1, TRY_CAST(string_split(periodo_inicio, '/')[2] AS INTEGER) AS y1,
            TRY_CAST(string_split(periodo_fim, '/')[1] AS INTEGER) AS m2, TRY_CAST(string_split(periodo_fim, '/')[2] AS INTEGER) AS y2
  FROM r),
v AS (
  SELECT o_orderkey, periodo_inicio, periodo_fim,
         CASE WHEN m1 IS NULL OR y1 IS NULL OR m2 IS NULL OR y2 IS NULL THEN 'format'
              WHEN y1 > y2 OR (y1 = y2 AND m1 > m2) THEN 'order'
              WHEN m1 < 1 OR m1 > 12 OR m2 < 1 OR m2 > 12 THEN 'month' END AS reason
  FROM p)
SELECT *, reason IS NULL AS valid FROM v"""
_SQL["vendor_filter"] = """SELECT c_custkey AS id, c_name AS prefeitura, lower(c_name) AS municipio,
       'https://portal' || c_nationkey || '.example.gov/api/' AS url, c_mktsegment AS empresa,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS unidadegestora
FROM customer WHERE c_mktsegment = 'BUILDING'"""
_SQL["scan_catalog_csv"] = """SELECT c_custkey AS id, c_name AS prefeitura, lower(c_name) AS municipio,
       'https://portal' || c_nationkey || '.example.gov/api/' AS url, c_mktsegment AS empresa,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS unidadegestora
FROM customer"""
_SQL["scan_topics_null_fill"] = f"""SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS assunto, coalesce({_TEMPLATE}, '') AS parametros
FROM part"""
_SQL["scan_line_list"] = "SELECT url AS value FROM pages WHERE page_id % 6 <> 0"
_SQL["scan_error_log"] = f"""WITH lines AS (
  SELECT CASE page_id % 4 WHEN 0 THEN '2025-06-17 10:57:48|' || url || '|HTTPError|400 Client Error: Bad Request for url: ' || url
              WHEN 1 THEN '2025-06-17 11:00:28|' || url || '|Erro: ValueError - Formato inesperado'
              WHEN 2 THEN 'linha sem separador ' || page_id
              ELSE '2025-06-17 11:02:02|' || url || '|ConnectionError|a|b' END AS line FROM pages),
parts AS (SELECT string_split({_strip('line')}, '|') AS p FROM lines)
SELECT p[1] AS logged_at, p[2] AS url,
       CASE WHEN len(p) >= 4 THEN p[3] WHEN len(p) = 3 AND regexp_matches(p[3], '^Erro: \\S+ - ')
            THEN regexp_extract(p[3], '^Erro: (\\S+) - ', 1) END AS error_type,
       CASE WHEN len(p) >= 4 THEN array_to_string(p[4:], '|')
            WHEN len(p) = 3 AND regexp_matches(p[3], '^Erro: \\S+ - ') THEN regexp_extract(p[3], '^Erro: \\S+ - (.*)$', 1)
            WHEN len(p) = 3 THEN p[3] END AS message
FROM parts WHERE len(p) >= 2"""
_SQL["scan_json_payload"] = f"""WITH {CATALOG_CTE}, {EVENT_LANDING_CTE}
SELECT response_id, url, pos, event_id, user_id, event_type, value, ano, props_k, part FROM ev_items"""
_SQL["scan_table_ignore_case"] = "SELECT * FROM orders"
_SQL["sink_append"] = "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS ano FROM orders"
_SQL["sink_overwrite"] = "SELECT * REPLACE (lower(o_orderstatus) AS o_orderstatus) FROM orders"
_SQL["sink_ctas"] = """SELECT *, CASE WHEN processo IS NOT NULL AND anoprocesso IS NOT NULL
       THEN replace(CAST(processo AS VARCHAR), '.0', '') || '/' || replace(CAST(anoprocesso AS VARCHAR), '.0', '') END
       AS processo_formatado
FROM (SELECT *, CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE CAST(l_orderkey AS DOUBLE) END AS processo,
             CAST(year(l_shipdate) AS DOUBLE) AS anoprocesso FROM lineitem)"""
_SQL["sink_ctas"] = f"SELECT * EXCLUDE (processo, anoprocesso) FROM ({_SQL['sink_ctas']})"
_SQL["sink_errors"] = """SELECT url, 'HTTPError' AS error_type, '500 Server Error for url: ' || url AS message,
       TRUE AS logged_at_format_ok
FROM pages"""
_SQL["rename_columns"] = "SELECT n_nationkey, n_name AS municipio, n_regionkey AS regiao FROM nation"
_SQL["rename_swap"] = "SELECT n_nationkey, n_regionkey AS n_name, n_name AS n_regionkey FROM nation"
_SQL["retype_columns"] = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
       o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       TRY_CAST(o_orderpriority AS BIGINT) AS o_orderpriority
FROM orders"""
_SQL["drop_columns"] = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
_SQL["normalize_column_names"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"
_SQL["schema_evolution_append"] = """SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment,
       CAST(NULL AS INTEGER) AS nationkey FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier"""
_SQL["stamp_metadata"] = f"""WITH {CATALOG_CTE}, {EVENT_LANDING_CTE}
SELECT i.response_id, i.url, i.pos, i.event_id, i.user_id, i.event_type, i.value, i.props_k, i.part,
       p.municipio, p.prefeitura, p.ano, p.mes
FROM ev_items i JOIN (SELECT DISTINCT url, municipio, prefeitura, ano, mes FROM ev_plan) p ON i.url = p.url"""
_SQL["surrogate_id"] = "SELECT count(*) AS n_rows, count(*) AS n_distinct_ids FROM orders"
_SQL["classify_responses"] = f"""WITH {CATALOG_CTE}, {EVENT_LANDING_CTE}
SELECT response_id, status, response_class FROM ev_classified"""
_SQL["run_metrics"] = f"""WITH {CATALOG_CTE}, {EVENT_LANDING_CTE}
SELECT topic, response_class, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY topic) AS share FROM ev_classified GROUP BY topic, response_class"""
_SQL["retry_eligible"] = f"""WITH {FAILED_API_CTE}
SELECT page_id, contains(u, '?') AS eligible_tp, contains(u, '?') AND endpoint IS NOT NULL AS eligible_te FROM endpoints"""
_SQL["path_after_marker"] = f"WITH {FAILED_API_CTE} SELECT page_id, endpoint FROM endpoints"
_SQL["normalize_url"] = f"WITH {RAW_URLS_CTE} SELECT page_id, raw_url, {_norm('raw_url')} AS url FROM raw"
_SQL["strip_api_chars"] = f"""WITH raw AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/api/' ELSE url END AS raw_url FROM pages)
SELECT page_id, rtrim({_norm('raw_url')}, '/api') AS base_url FROM raw"""
_SQL["topic_table_name"] = """WITH t AS (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Group/' || string_split(url, '/')[-1]
                       WHEN 1 THEN 'Group/GetGet' || string_split(url, '/')[-1]
                       ELSE 'Group/Get' || string_split(url, '/')[-1] END AS topic FROM pages)
SELECT page_id, topic, lower(replace(string_split(topic, '/')[-1], 'Get', '')) AS table_name FROM t"""
_SQL["repair_retry_url"] = f"""WITH {RAW_URLS_CTE}
SELECT page_id, regexp_replace({_norm('raw_url')}, '([^:])/{{2,}}', '\\1/', 'g') AS url FROM raw"""
_SQL["url_parts"] = f"""WITH p AS (
  SELECT page_id, CASE WHEN page_id % 6 = 0 THEN {_URL_SCHEME} || '://' || {_URL_HOST} || ':8080' || {_URL_REST} ELSE url END AS url
  FROM pages)
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority,
       regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', '') AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
       CASE WHEN regexp_matches(url, '^[^#?]*\\?') THEN regexp_extract(url, '^[^#?]*\\?([^#]*)', 1) END AS query
FROM p"""
_SQL["url_query_params"] = """WITH p AS (
  SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=9&flag'
                       ELSE url END AS url FROM pages),
q AS (SELECT page_id, regexp_extract(url, '^[^#?]*\\?([^#]*)', 1) AS query FROM p WHERE regexp_matches(url, '^[^#?]*\\?')),
parts AS (SELECT page_id, unnest(string_split(query, '&')) AS part, unnest(range(len(string_split(query, '&')))) AS i FROM q),
kv AS (SELECT page_id, i, split_part(part, '=', 1) AS param, substr(part, strpos(part, '=') + 1) AS value
       FROM parts WHERE contains(part, '='))
SELECT page_id, param, value FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, param ORDER BY i DESC) AS rn FROM kv) WHERE rn = 1"""
_SQL["compose_process_number"] = """SELECT l_orderkey, l_linenumber,
       CASE WHEN processo IS NOT NULL AND anoprocesso IS NOT NULL
            THEN replace(CAST(processo AS VARCHAR), '.0', '') || '/' || replace(CAST(anoprocesso AS VARCHAR), '.0', '') END
         AS processo_formatado
FROM (SELECT *, CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE CAST(l_orderkey AS DOUBLE) END AS processo,
             CAST(year(l_shipdate) AS DOUBLE) AS anoprocesso FROM lineitem)"""
_EV_VALOR = ("CASE event_id % 10 WHEN 1 THEN '1.234,56' WHEN 2 THEN '1d' WHEN 3 THEN ' 12 ' WHEN 4 THEN '' "
             "ELSE CAST(value AS VARCHAR) END")
_SQL["coerce_numeric"] = f"SELECT event_id, {_coerce('v')} AS valor FROM (SELECT event_id, {_EV_VALOR} AS v FROM events)"
_SQL["coercion_rejects"] = f"""SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE ({_coerce('v')}) IS NULL) AS n_invalid
FROM (SELECT event_id, event_type, {_EV_VALOR} AS v FROM events) GROUP BY event_type"""
_SQL["json_stringify"] = """SELECT vec_id, label,
       CASE WHEN len(embedding) > 0 THEN CAST(to_json(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER))) AS VARCHAR) END
         AS embedding_json
FROM embeddings"""
_SQL["json_rows"] = f"""WITH b AS (
  SELECT event_id AS response_id,
         '{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || CAST(value AS VARCHAR) || '}}' AS obj,
         {_EV_PART} AS part_obj FROM events),
l AS (SELECT response_id, CASE WHEN response_id % 2 = 0 THEN '[' || obj || ']' ELSE '[' || obj || ',' || part_obj || ']' END AS arr FROM b)
SELECT response_id, CAST(i AS INTEGER) AS pos,
       CAST(json_extract(arr, '$[' || i || '].event_id') AS BIGINT) AS event_id,
       json_extract_string(arr, '$[' || i || '].event_type') AS event_type,
       CAST(json_extract(arr, '$[' || i || '].part') AS BIGINT) AS part,
       CAST(json_extract(arr, '$[' || i || '].user_id') AS BIGINT) AS user_id,
       CAST(json_extract(arr, '$[' || i || '].value') AS DOUBLE) AS value
FROM (SELECT *, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM l)"""
_SQL["flatten_struct"] = """SELECT l_linenumber, l_orderkey AS rec_orderkey, l_partkey AS rec_item_partkey, l_suppkey AS rec_item_suppkey,
       l_quantity AS rec_amounts_quantity, l_extendedprice AS rec_amounts_price_extended,
       l_discount AS rec_amounts_price_discount
FROM lineitem"""
_SQL["flatten_indexed"] = """SELECT l_orderkey, l_linenumber, l_quantity AS items_0_qty, l_discount AS items_0_disc,
       CASE WHEN l_linenumber % 3 >= 1 THEN l_quantity * 2 END AS items_1_qty,
       CASE WHEN l_linenumber % 3 >= 1 THEN l_tax END AS items_1_disc,
       CASE WHEN l_linenumber % 3 = 2 THEN l_quantity * 3 END AS items_2_qty,
       CASE WHEN l_linenumber % 3 = 2 THEN l_discount + l_tax END AS items_2_disc
FROM lineitem"""
_SQL["zip_columns_to_rows"] = """SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS pos, i AS linha, o_totalprice * i AS valor
FROM (SELECT o_orderkey, o_totalprice, unnest(generate_series(1, 1 + o_orderkey % 4)) AS i FROM orders WHERE o_orderkey % 19 <> 0)"""
_SQL["json_scalar_valor"] = """SELECT response_id, json_extract_string(body, '$') AS valor FROM (
  SELECT event_id AS response_id,
         CASE event_id % 3 WHEN 0 THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
              WHEN 1 THEN '"' || event_type || '"' ELSE CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END END AS body
  FROM events)"""
_SQL["retry_lookup"] = f"WITH {CATALOG_PAGES_CTE} SELECT * FROM best"
_SQL["retry_unmatched"] = f"WITH {CATALOG_PAGES_CTE} SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM best)"
_SQL["merge_outer_common"] = """WITH l AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS nationkey FROM customer),
r AS (
  SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey + 10 END AS nationkey FROM supplier)
SELECT coalesce(l.nationkey, r.nationkey) AS nationkey, c_custkey, c_name, s_suppkey, s_name
FROM l FULL OUTER JOIN r ON l.nationkey IS NOT DISTINCT FROM r.nationkey"""
_SQL["concat_disjoint"] = """SELECT r_regionkey, r_name, NULL::BIGINT AS doc_id, NULL::INTEGER AS quality, NULL::INTEGER AS toxic FROM region
UNION ALL SELECT NULL, NULL, doc_id, quality, toxic FROM labels"""
_SQL["distinct_rows"] = "SELECT DISTINCT lang, source, text FROM documents"
_SQL["dedup_by_key"] = """SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""
_SQL["dedup_missing_key_fallback"] = "SELECT DISTINCT source, lang FROM documents"
_SQL["unify_tables"] = f"""WITH t1 AS (
  SELECT c_custkey AS custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS nationkey,
         {_coerce("CASE c_custkey % 10 WHEN 1 THEN '1.234,56' WHEN 2 THEN '1d' ELSE CAST(c_acctbal AS VARCHAR) END")} AS valor,
         c_mktsegment AS segment FROM customer),
t2 AS (
  SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS nationkey,
         s_acctbal AS valor, s_name AS name FROM supplier)
SELECT DISTINCT coalesce(t1.nationkey, t2.nationkey) AS nationkey, coalesce(t1.valor, t2.valor) AS valor,
       custkey, segment, suppkey, name
FROM t1 FULL OUTER JOIN t2 ON t1.nationkey IS NOT DISTINCT FROM t2.nationkey AND t1.valor IS NOT DISTINCT FROM t2.valor"""
_LINEITEM_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                  ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                  ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
_SQL["table_profile"] = "\nUNION ALL\n".join(
    f"SELECT (SELECT count(*) FROM lineitem) AS n_rows, {i} AS position, '{c}' AS column_name, '{t}' AS data_type, "
    f"count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM lineitem"
    for i, (c, t) in enumerate(_LINEITEM_COLS))
_SQL["multi_employment"] = """SELECT l_partkey AS person, CAST(year(l_shipdate) AS INTEGER) AS ano, CAST(month(l_shipdate) AS INTEGER) AS mes,
       count(DISTINCT l_suppkey) AS n_employers
FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2"""
_SQL["price_outliers"] = """WITH u AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(l_shipdate) AS INTEGER) AS ano, l_extendedprice / nullif(l_quantity, 0) AS unit_price
  FROM lineitem),
m AS (SELECT l_partkey, ano, median(unit_price) AS med FROM u GROUP BY ALL)
SELECT u.*, m.med AS median_price FROM u JOIN m USING (l_partkey, ano) WHERE unit_price > 2 * m.med"""
_SQL["incremental_load"] = f"""WITH {CATALOG_CTE}, {EVENT_LANDING_CTE}
SELECT i.url, i.event_id, i.user_id, i.event_type, i.value, i.props_k, i.part,
       p.topic, p.municipio, p.prefeitura, p.ano, p.mes
FROM ev_items i JOIN (SELECT DISTINCT url, topic, municipio, prefeitura, ano, mes FROM ev_plan) p ON i.url = p.url"""
_SQL["retry_queue_rewrite"] = """SELECT url, 'HTTPError' AS error_type, '503 Server Error' AS message FROM pages WHERE page_id % 3 <> 0"""

_QUERIES.update(CQ.queries())
_SQL.update(CQ.oracle_sql(SimpleNamespace(**globals())))


# --------------------------------------------------------------------------
# contract
# --------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: cells of the extraction plan still to fetch (plan over
    municipalities x topics x months, anti-joined with the loaded ledger)."""
    return q_pending_cells(spark, FLAGSHIP_SF)


def _llm() -> tuple[dict, dict]:
    """Queries and SQL of subpackage llm and of the corpus pipeline; none
    where their files are absent. Any other import error is raised."""
    found, sql = {}, {}
    try:
        from civicspark.llm import queries as llm
        found, sql = llm.queries(), llm.oracle_sql()
    except ModuleNotFoundError as e:
        if e.name != "civicspark.llm":
            raise
        return found, sql
    try:
        import corpus_pipeline
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline":
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_llm()[0]}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per key over the pre-registered driver tables."""
    return {**{k: v for k, v in _SQL.items() if k in _QUERIES}, **_llm()[1]}
