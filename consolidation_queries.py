"""

Bound to the driver tables like those of ``__spark_entry__.py``, which
registers them and hands in the SQL fragments both share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

import standins as S
from civicspark.functions.urls import repair_retry_url
from civicspark.operators import indicators as IND
from civicspark.operators import nested as N
from civicspark.operators import people as PE
from civicspark.operators import profile as P
from civicspark.operators import retry as R
from civicspark.operators import schema as C
from civicspark.operators import templates as TP
from civicspark.operators import unify as UN
from civicspark.plans import extraction as X
from civicspark.session import scratch_path
from civicspark.sources import versioned as V
from civicspark.streaming import retry_job as RJ
from civicspark.streaming import topic_load as TL

SQL: dict = {}


def _event_plan(spark, d):
    start, end = S.month_bounds(S.table(spark, d, "events"), "ts")
    return X.monthly_plan(S.nation_catalog(spark, d), S.event_topics(spark, d), start, end)


def q_load_by_topic(spark, d):
    base = scratch_path(spark, "by-topic")
    landing, target, cp = f"{base}/landing", f"{base}/tables", f"{base}/_checkpoint"
    plan = _event_plan(spark, d)
    responses = S.topic_landing(spark, d)
    early = (F.col("run_id") == 2) | (F.col("event_id") % 2 == 0)
    columns = ["url", "status", "body", "fetched_at", "run_id"]
    responses.filter(early).select(*columns).repartition(3).write.parquet(landing)
    TL.load_by_topic(spark, landing, plan, target, cp, max_files_per_trigger=2)
    TL.load_by_topic(spark, landing, plan, target, cp)  # replay: no new files
    # rows of the older run that come late, and copies of loaded responses
    responses.filter(~early | (F.col("event_id") % 5 == 0)).select(*columns).coalesce(2).write.mode("append").parquet(landing)
    TL.load_by_topic(spark, landing, plan, target, cp)
    parts = []
    for name in TL.topic_tables(spark, target):
        t = TL.read_topic(spark, target, name)
        value = "valor" if "valor" in t.columns else "valor_a"
        parts.append(t.select(F.lit(name).alias("table_name"), "row_id", "run_id", "municipio", "ano", "mes",
                              F.lit(t.schema[value].dataType.simpleString()).alias("valor_type"), F.col(value).cast("string").alias("valor"),
                              *[(F.col(c).cast("string") if c in t.columns else F.lit(None).cast("string")).alias(c) for c in ("id", "extra")]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _load_by_topic_sql(e):
    return f"""WITH {e.CATALOG_CTE}, {e.EVENT_LANDING_CTE},
r AS (
  SELECT l.url, l.status, v.event_id, v.user_id, v.event_type,
         CASE WHEN v.event_id % 4 = 3 AND v.user_id % 3 = 0 AND v.user_id % 25 < 8 THEN 2 ELSE 1 END AS run_id,
         CASE WHEN v.event_id % 13 = 0 THEN '   ' WHEN v.event_id % 4 = 3 AND v.user_id % 3 = 0 AND v.user_id % 25 < 8 AND v.user_id % 25 = 6 THEN '[]'
              ELSE CASE event_type WHEN 'click' THEN '{{"valor":' || v.event_id || '}}' WHEN 'error' THEN '{{"valor":"e' || v.event_id || '"}}'
                   WHEN 'purchase' THEN '{{"id":' || v.user_id || ',"valor":{{"a":' || v.event_id || '}}}}'
                   WHEN 'signup' THEN '{{"valor":' || v.event_id % 1000 || CASE WHEN v.event_id % 2 = 0 THEN '' ELSE '.5' END || '}}'
                   ELSE '[{{"valor":' || v.event_id || '}},{{"extra":"x' || v.user_id || '"}}]' END END AS body
  FROM ev_landing l JOIN events v ON l.response_id = v.event_id),
ok AS (SELECT *, max(run_id) OVER (PARTITION BY url) AS last FROM r WHERE status < 400 AND trim(body) <> ''),
kept AS (SELECT DISTINCT ON (url, body) * FROM ok WHERE run_id = last AND body <> '[]'),
items AS (SELECT *, unnest(CASE WHEN event_type = 'view' THEN [0, 1] ELSE [0] END) AS pos FROM kept)
SELECT event_type AS table_name, sha256(i.url || chr(10) || sha256(body)) || ':' || pos AS row_id, CAST(run_id AS BIGINT) AS run_id,
       p.municipio, p.ano, p.mes,
       CASE event_type WHEN 'error' THEN 'string' WHEN 'signup' THEN 'double' ELSE 'bigint' END AS valor_type,
       CASE WHEN pos = 1 THEN NULL WHEN event_type = 'error' THEN 'e' || event_id
            WHEN event_type = 'signup' THEN CAST(CAST(event_id % 1000 AS DOUBLE) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0.5 END AS VARCHAR)
            ELSE CAST(event_id AS VARCHAR) END AS valor,
       CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS id, CASE WHEN pos = 1 THEN 'x' || user_id END AS extra
FROM items i JOIN (SELECT DISTINCT url, municipio, ano, mes FROM ev_plan) p ON i.url = p.url"""


SQL["load_by_topic"] = _load_by_topic_sql


# --- retry -------------------------------------------------------------------

def q_retry_job(spark, d):
    path = scratch_path(spark, "retry-job")
    queue = S.pages_requests(spark, d).select("url")
    RJ.retry_outcomes(queue, S.pages_retry_responses(spark, d), S.pages_unit_catalog(spark, d), RJ.YEARLY).write.parquet(path)
    run = RJ.retry_run(queue, None, None, RJ.YEARLY, outcomes=spark.read.parquet(path))
    none = F.lit(None).cast("string")
    rows = run.rows.select(F.lit("row").alias("kind"), F.col("request").alias("url"), "table_name", "municipio", "prefeitura", "unidadegestora", "ano",
                           "page_id", "nota", none.alias("error_type"))
    errors = run.errors.select(F.lit("error").alias("kind"), "url", "error_type")
    return rows.unionByName(errors, allowMissingColumns=True).unionByName(run.queue.select(F.lit("queue").alias("kind"), "url"), allowMissingColumns=True)


def q_retry_lookup_unit(spark, d):
    unit = RJ.parameter(repair_retry_url(F.col("url")), "unidadegestoraid")
    return R.retry_lookup(S.pages_requests(spark, d), S.pages_unit_catalog(spark, d), "page_id", catalog_cols=["municipio"],
                          failed_unit=unit, catalog_unit="unidadegestora")


def _requests_cte(e):
    base = f"{e._URL_SCHEME} || '://' || {e._URL_HOST}"
    return f"""p AS (SELECT page_id, {base} AS base, 1 + page_id % 3 AS unit, 2015 + page_id % 9 AS ano, 'topic' || page_id % 7 AS topic FROM pages),
q AS (SELECT *, base || CASE WHEN page_id % 10 = 8 THEN '/v1/' WHEN page_id % 4 = 2 THEN '//api/' ELSE '/api/' END || tail AS url,
             base || CASE WHEN page_id % 10 = 8 THEN '/v1/' ELSE '/api/' END || tail AS request
      FROM (SELECT *, topic || CASE WHEN page_id % 10 = 9 THEN '' ELSE '?unidadeGestoraId=' || unit || '&exercicio=' || ano || '&pagina=' || page_id END AS tail FROM p)),
cat AS (SELECT base AS cbase, u, min(page_id) * 10 + u AS id, 'm-' || base AS municipio, 'P ' || base AS prefeitura
        FROM p, (SELECT unnest([1, 2]) AS u) WHERE page_id % 2 = 0 GROUP BY base, u)"""


def _retry_job_sql(e):
    return f"""WITH {_requests_cte(e)},
o AS (SELECT q.*, cat.id, municipio, prefeitura, page_id % 10 < 8 AS eligible,
             CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 3 = 1 THEN 'error' WHEN page_id % 9 = 2 THEN 'empty' WHEN page_id % 9 = 5 THEN 'invalid' ELSE 'ok' END AS r
      FROM q LEFT JOIN cat ON q.base = cbase AND q.unit = u),
j AS (SELECT DISTINCT ON (request) *, CASE WHEN NOT eligible THEN 'skipped' WHEN id IS NULL THEN 'unmatched' ELSE r END AS outcome FROM o ORDER BY request, page_id)
SELECT 'row' AS kind, request AS url, topic AS table_name, municipio, prefeitura, CAST(unit AS VARCHAR) AS unidadegestora, CAST(ano AS INTEGER) AS ano,
       page_id, 'x' || page_id % 4 AS nota, NULL AS error_type FROM j WHERE outcome = 'ok'
UNION ALL SELECT 'error', request, NULL, NULL, NULL, NULL, NULL, NULL, NULL, outcome FROM j WHERE outcome IN ('error', 'invalid')
UNION ALL SELECT 'queue', q.url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM q JOIN j USING (request) WHERE outcome <> 'ok'"""


SQL["retry_job"] = _retry_job_sql
SQL["retry_lookup_unit"] = lambda e: f"""WITH {_requests_cte(e)}
SELECT page_id, url, id AS catalog_id, lower(cbase) AS catalog_base, municipio FROM q JOIN cat ON q.base = cbase AND unit = u WHERE page_id % 10 <> 9"""


# --- plan --------------------------------------------------------------------

def _order_plan(spark, d):
    start, end = S.month_bounds(S.table(spark, d, "orders"), "o_orderdate")
    return X.monthly_plan(S.nation_catalog(spark, d), S.order_topics(spark, d), start, end)


def _pending(spark, d):
    return X.pending_cells(_order_plan(spark, d), S.order_ledger(spark, d))


def q_pending_ranges(spark, d):
    return X.pending_ranges(_pending(spark, d))


def q_pending_ranges_expanded(spark, d):
    return X.expand_ranges(X.pending_ranges(_pending(spark, d)))


YEAR_GROUP = ("topic", "municipio", "prefeitura", "unidadegestora")


def q_pending_year_ranges(spark, d):
    plan = X.yearly_plan(S.nation_catalog(spark, d), S.yearly_topics(spark, d), 1995, 1999)
    return X.pending_ranges(X.pending_cells(plan, S.yearly_ledger(spark, d), X.YEAR_CELL), YEAR_GROUP, mes=None)


def q_resume_years(spark, d):
    topics = S.yearly_topics(spark, d).distinct()
    marks = X.high_water_mark(S.yearly_ledger(spark, d), ["topic"], mes=None)
    marks = marks.join(topics.select("empresa", F.col("assunto").alias("topic")).distinct(), "topic")
    return X.resume_years(marks, S.nation_catalog(spark, d), topics, 2000)


def q_resume_by_municipality(spark, d):
    return X.resume_by_municipality(S.order_ledger(spark, d), _order_plan(spark, d))


def _islands(cells, group, number, columns):
    g = ", ".join(group)
    return f"""n AS (SELECT DISTINCT {g}, {number} AS i FROM ({cells})),
g AS (SELECT *, i - row_number() OVER (PARTITION BY {g} ORDER BY i) AS run FROM n)
SELECT {g}, {columns}, count(*) AS n_periods FROM g GROUP BY {g}, run"""


_MONTHS = "CAST(min(i) // 12 AS INTEGER) AS first_ano, CAST(min(i) % 12 + 1 AS INTEGER) AS first_mes, CAST(max(i) // 12 AS INTEGER) AS last_ano, CAST(max(i) % 12 + 1 AS INTEGER) AS last_mes"
SQL["pending_ranges"] = lambda e: e._SQL["pending_cells"].replace("\nSELECT * FROM plan p", ",\npending AS (SELECT * FROM plan p", 1) + "),\n" + _islands(
    "SELECT * FROM pending", ("topic", "municipio", "prefeitura"), "ano * 12 + mes - 1", _MONTHS)
SQL["pending_ranges_expanded"] = lambda e: e._SQL["pending_cells"].replace("SELECT * FROM plan p", "SELECT topic, municipio, prefeitura, ano, mes FROM plan p")
SQL["pending_year_ranges"] = lambda e: e._SQL["yearly_pending"].replace("\nSELECT * FROM yplan p", ",\npending AS (SELECT * FROM yplan p", 1) + "),\n" + _islands(
    "SELECT * FROM pending", YEAR_GROUP, "ano", "CAST(min(i) AS INTEGER) AS first_ano, CAST(max(i) AS INTEGER) AS last_ano")
SQL["resume_years"] = lambda e: f"""WITH {e.CATALOG_CTE},
tp AS (SELECT DISTINCT r_name AS empresa, lower(p_name) AS assunto, {e._TEMPLATE} AS parametros FROM part JOIN region ON p_partkey % 5 = r_regionkey),
led AS (SELECT lower(p_name) AS topic, max(1996 + p_size % 3) AS ano FROM part JOIN nation ON p_partkey % 25 = n_nationkey GROUP BY 1),
marks AS (SELECT DISTINCT empresa, topic, ano FROM led JOIN tp ON topic = assunto),
todo AS (SELECT m.empresa, m.topic, parametros, unnest(generate_series(m.ano + 1, 2000)) AS ano FROM marks m JOIN tp ON m.empresa = tp.empresa AND m.topic = assunto),
cells AS (SELECT topic, c.municipio, c.prefeitura, CAST(c.unidadegestora AS VARCHAR) AS unidadegestora, c.empresa, CAST(ano AS INTEGER) AS ano, c.url AS base, parametros
          FROM nation_catalog c JOIN todo t ON c.empresa = t.empresa),
filled AS (SELECT *, {e._strip("replace(replace(replace(coalesce(parametros, ''), '{unidadeGestoraId}', unidadegestora), '{exercicio}', CAST(ano AS VARCHAR)), '{periodo}', '')")} AS t FROM cells)
SELECT topic, municipio, prefeitura, unidadegestora, empresa, ano, rtrim({e._norm('base')}, '/api') || '/api/' || topic ||
       CASE WHEN t = '' THEN '' ELSE replace(CASE WHEN starts_with(t, '?') THEN t ELSE '?' || t END, ' ', '') END AS url FROM filled"""
SQL["resume_by_municipality"] = lambda e: f"""WITH {e.ORDER_PLAN_CTES},
marks AS (SELECT topic, municipio, prefeitura, max(ano * 12 + mes) AS mark FROM ledger GROUP BY ALL)
SELECT p.* FROM plan p LEFT JOIN marks m USING (topic, municipio, prefeitura) WHERE (mark IS NULL OR ano * 12 + mes >= mark) AND NOT EXISTS (
  SELECT 1 FROM ledger l WHERE l.topic = p.topic AND l.municipio = p.municipio AND l.prefeitura = p.prefeitura AND l.ano = p.ano AND l.mes = p.mes)"""


# --- payloads ----------------------------------------------------------------

def q_scan_object_lists(spark, d):
    return N.scan_json_payload(S.object_lists(spark, d), keep=["o_orderkey"], index_arrays=True)


def q_indexed_values(spark, d):
    out = N.indexed_values(S.indexed_lines(spark, d), ["l_orderkey", "l_linenumber"])
    return out.withColumn("value", F.col("value").cast("double"))


def q_indexed_wide(spark, d):
    return N.pivot_indexed(S.indexed_lines(spark, d), ["l_orderkey", "l_linenumber"], quantile=0.5)[0]


def q_indexed_rest(spark, d):
    out = N.pivot_indexed(S.indexed_lines(spark, d), ["l_orderkey", "l_linenumber"], quantile=0.5)[1]
    return out.withColumn("value", F.col("value").cast("double"))


def q_stamp_rows(spark, d):
    ok = N.fetched_bodies(S.event_landing(spark, d).select("response_id", "url", "status", "body"))
    rows = N.flatten_struct(N.json_rows(ok, keep=["response_id", "url"]))
    return C.stamp_metadata(rows, _event_plan(spark, d))


def q_schema_drift_append(spark, d):
    """Types that change at rest: a whole number, then text and a broken one."""
    path, o = scratch_path(spark, "drift"), S.table(spark, d, "orders")
    first = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cliente"), F.col("o_custkey").alias("valor"))
    second = o.filter("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("Cliente"), F.col("o_totalprice").alias("valor"))
    third = o.filter("o_orderkey % 3 = 2").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prioridade"))
    for k, batch in enumerate((first, second, second, third)):  # the second is written twice under its number
        V.append_versioned(batch, path, min(k, 1) if k < 3 else 2)
    return V.read_versioned(spark, path)


SQL["schema_drift_append"] = lambda e: """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_orderstatus END AS cliente,
       CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN o_totalprice END AS valor, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS prioridade
FROM orders"""
SQL["scan_object_lists"] = lambda e: """SELECT o_orderkey, 0 AS pos, CASE WHEN k <> 0 THEN o_orderkey END AS contratos_0_v, CASE WHEN k <> 0 AND odd THEN o_orderkey + 1 END AS contratos_1_v,
       CASE WHEN k <> 0 AND odd THEN o_orderkey + 2 END AS aditivos_0_w, CASE WHEN k = 0 THEN o_orderkey END AS itens_0_q, CASE WHEN k = 0 THEN o_orderkey + 1 END AS itens_1_q
FROM (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderkey % 2 = 1 AS odd FROM orders)"""
_ENTRIES = """SELECT l_orderkey, l_linenumber, 'items' AS path, CAST(i AS INTEGER) AS idx, field,
       CASE WHEN field = 'qty' THEN l_quantity * (i + 1) ELSE CASE i WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_discount + l_tax END END AS value
FROM (SELECT *, unnest(range(1 + l_linenumber % 3)) AS i FROM lineitem), (SELECT unnest(['qty', 'disc']) AS field)"""
SQL["indexed_values"] = lambda e: _ENTRIES
SQL["indexed_rest"] = lambda e: f"SELECT * FROM ({_ENTRIES}) WHERE idx >= 2"
SQL["indexed_wide"] = lambda e: """SELECT l_orderkey, l_linenumber, l_quantity AS items_0_qty, l_discount AS items_0_disc,
       CASE WHEN l_linenumber % 3 > 0 THEN l_quantity * 2 END AS items_1_qty, CASE WHEN l_linenumber % 3 > 0 THEN l_tax END AS items_1_disc FROM lineitem"""
SQL["stamp_rows"] = lambda e: e._SQL["stamp_metadata"]


# --- merge, profile, indicators ----------------------------------------------

def q_merge_outer_heavy(spark, d):
    left, right = S.heavy_sides(spark, d)
    return UN.merge_outer_heavy(left, right, share=0.1, rows_per_task=200)


def q_merge_null_single(spark, d):
    left, right = S.heavy_sides(spark, d)
    return UN.merge_outer_heavy(left, right, null_keys=UN.SINGLE, share=0.1, rows_per_task=200)


def q_table_profile_exact(spark, d):
    return P.exact_profile(S.table(spark, d, "lineitem"))


def q_table_profile_merged(spark, d):
    li, path = S.table(spark, d, "lineitem"), scratch_path(spark, "profiles")
    for flag in ("A", "N", "R"):  # a batch each, kept and merged
        P.batch_profile(li.filter(F.col("l_returnflag") == flag)).write.mode("append").parquet(path)
    merged = P.merge_profiles(spark.read.parquet(path))
    exact = P.exact_profile(li).select("column_name", F.col("n_distinct").alias("true_distinct"))
    close = F.abs(F.col("n_distinct") - F.col("true_distinct")) <= 0.05 * F.col("true_distinct")
    return merged.join(exact, "column_name").select("n_rows", "position", "column_name", "data_type", "non_null", close.alias("distinct_within_5_percent"))


def q_robust_outliers(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey % 50").alias("item"), F.year("l_shipdate").alias("ano"),
                                              F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"))
    return IND.robust_outliers(li, "item", ["ano"], "unit_price", k=1.5)


def q_coverage_timeline(spark, d):
    return IND.coverage_timeline(_order_plan(spark, d), S.order_ledger(spark, d))


_HEAVY = """c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 99 WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer),
s AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 99 WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey + 10 END AS k FROM supplier)"""
SQL["merge_outer_heavy"] = lambda e: f"WITH {_HEAVY} SELECT coalesce(c.k, s.k) AS nationkey, c_custkey, c_name, s_suppkey, s_name FROM c FULL JOIN s ON c.k IS NOT DISTINCT FROM s.k"
SQL["merge_null_single"] = lambda e: f"WITH {_HEAVY} SELECT coalesce(c.k, s.k) AS nationkey, c_custkey, c_name, s_suppkey, s_name FROM c FULL JOIN s ON c.k = s.k"
SQL["table_profile_exact"] = lambda e: e._SQL["table_profile"]
SQL["table_profile_merged"] = lambda e: f"SELECT n_rows, position, column_name, data_type, non_null, true AS distinct_within_5_percent FROM ({e._SQL['table_profile']})"
SQL["robust_outliers"] = lambda e: """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS item, CAST(year(l_shipdate) AS INTEGER) AS ano,
                  CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price FROM lineitem),
m AS (SELECT *, median(unit_price) OVER (PARTITION BY item, ano) AS median_price FROM p),
v AS (SELECT *, abs(unit_price - median_price) AS deviation FROM m),
w AS (SELECT *, median(deviation) OVER (PARTITION BY item, ano) AS mad_price FROM v)
SELECT item, ano, l_orderkey, l_linenumber, unit_price, median_price, deviation, mad_price FROM w WHERE mad_price > 0 AND deviation > CAST(1.5 AS DOUBLE) * mad_price"""
SQL["coverage_timeline"] = lambda e: f"""WITH {e.ORDER_PLAN_CTES},
b AS (SELECT topic, municipio, prefeitura, min(ano * 12 + mes - 1) AS a, max(ano * 12 + mes - 1) AS z FROM plan GROUP BY ALL),
m AS (SELECT DISTINCT topic, municipio, prefeitura, ano * 12 + mes - 1 AS i FROM ledger),
n AS (SELECT b.*, i, lag(i) OVER (PARTITION BY b.topic, b.municipio, b.prefeitura ORDER BY i) AS prev FROM b JOIN m USING (topic, municipio, prefeitura) WHERE i BETWEEN a AND z),
s AS (SELECT topic, municipio, prefeitura, count(*) AS n, count(*) FILTER (prev IS NULL OR i - prev > 1) AS runs, max(i - coalesce(prev, a - 1) - 1) AS gap, max(i) AS last FROM n GROUP BY ALL),
y AS (SELECT topic, municipio, prefeitura, min(ano) AS full_year FROM (
        SELECT topic, municipio, prefeitura, i // 12 AS ano FROM m GROUP BY ALL HAVING count(*) = 12) GROUP BY ALL)
SELECT b.topic, b.municipio, b.prefeitura, coalesce(n, 0) AS n_months, coalesce(runs, 0) AS n_runs, greatest(coalesce(gap, 0), z - coalesce(last, a - 1)) AS longest_gap,
       z - coalesce(last, a - 1) AS staleness, CAST(full_year AS INTEGER) AS first_full_year
FROM b LEFT JOIN s USING (topic, municipio, prefeitura) LEFT JOIN y USING (topic, municipio, prefeitura)"""


# --- messages and names --------------------------------------------------------

def q_error_templates(spark, d):
    return TP.error_templates(S.pages_messages(spark, d))


def q_resolved_people(spark, d):
    return PE.resolve_people(S.payroll_names(spark, d)).groupBy("person").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("name").alias("n_names"))


def q_multi_employment_resolved(spark, d):
    return PE.multi_employment_resolved(S.payroll_names(spark, d), "name", "employer")


def _templates_sql(e):
    message = S.LOG_MESSAGE
    return f"""WITH m AS (SELECT CASE page_id % 3 WHEN 0 THEN 'HTTPError' WHEN 1 THEN 'ValueError' END AS error_type, {message} AS message,
                 '2025-06-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || ' 10:00:00' AS logged_at FROM pages),
t AS (SELECT *, list_transform(list_filter(regexp_split_to_array(message, '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]|://|@') THEN '<*>' ELSE x END) AS tokens FROM m),
b AS (SELECT error_type, tokens, count(*) AS n, min(logged_at) AS first_at, max(logged_at) AS last_at FROM t GROUP BY ALL),
f AS (SELECT error_type, tokens, i, tokens[:i - 1] || ['<*>'] || tokens[i + 1:] AS wild FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM b) WHERE tokens[i] <> '<*>'),
w AS (SELECT error_type, wild, count(*) AS variants FROM f GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT f.error_type, f.tokens, f.wild, row_number() OVER (PARTITION BY f.error_type, f.tokens ORDER BY variants DESC, i) AS k
      FROM f JOIN w ON f.error_type IS NOT DISTINCT FROM w.error_type AND f.wild = w.wild),
g AS (SELECT b.*, array_to_string(coalesce(c.wild, b.tokens), ' ') AS template FROM b LEFT JOIN c ON k = 1 AND b.error_type IS NOT DISTINCT FROM c.error_type AND b.tokens = c.tokens)
SELECT error_type, template, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_variants, sum(n) / sum(sum(n)) OVER (PARTITION BY error_type) AS share,
       min(first_at) AS first_at, max(last_at) AS last_at FROM g GROUP BY error_type, template"""


def _people_cte(e):
    word = S.word_of("k")
    return f"""c AS (SELECT c_custkey AS id, CAST(1000 + c_custkey // 4 AS INTEGER) AS k, c_custkey % 4 AS v, c_nationkey AS employer FROM customer
  UNION ALL SELECT s_suppkey, CAST(1000 + s_suppkey AS INTEGER), 4, s_nationkey + 100 FROM supplier),
w AS (SELECT *, upper({word}) AS word FROM c),
n AS (SELECT *, 1 + (k - 1000) % 12 AS mes, CASE v WHEN 2 THEN 'W' || substr(word, 2) WHEN 3 THEN substr(word, 1, length(word) - 1) ELSE word END AS odd FROM w),
p AS (SELECT *, min(array_to_string(list_sort(['JOAO', 'SILVA', odd]), ' ')) OVER (PARTITION BY k) AS person FROM n)"""


SQL["error_templates"] = _templates_sql
SQL["resolved_people"] = lambda e: f"WITH {_people_cte(e)} SELECT person, count(*) AS n_rows, count(DISTINCT v) AS n_names FROM p GROUP BY person"
SQL["multi_employment_resolved"] = lambda e: f"""WITH {_people_cte(e)} SELECT person, 2024 AS ano, CAST(mes AS INTEGER) AS mes, count(DISTINCT employer) AS n_employers
FROM p GROUP BY person, mes HAVING count(DISTINCT employer) >= 2"""


def queries():
    return {k: globals()[f"q_{k}"] for k in SQL}


def oracle_sql(entry):
    """``entry``: holds the shared SQL fragments as attributes."""
    return {k: make(entry) for k, make in SQL.items()}
