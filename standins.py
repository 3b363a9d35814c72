"""Stand-in inputs built from the driver tables (FIXTURES.md, part C).

Each function only reshapes a driver table into the schema an operator
expects (a catalog, a landing table, an error log...) and plants the edge
cases listed in FIXTURES.md with deterministic CASE expressions; the same
expressions appear on the DuckDB side in ``__spark_entry__.py``. None of
the operators' work happens here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# --- municipalities, topics, ledger ------------------------------------------

# A municipality per nation; vendor = region name; the base URL comes in
# three spellings (https with slash, http without, no scheme and blanks).
NATION_HOST = "concat(replace(lower(n_name), '_', '-'), '.portal.example')"
NATION_URL = (f"CASE n_nationkey % 3 WHEN 0 THEN concat('https://', {NATION_HOST}, '/api/') "
              f"WHEN 1 THEN concat('http://', {NATION_HOST}, '/api') "
              f"ELSE concat(' ', {NATION_HOST}, '/api/') END")


def nation_catalog(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.concat(F.lit("Prefeitura de "), F.col("n_name")).alias("prefeitura"),
        F.lower("n_name").alias("municipio"),
        F.expr(NATION_URL).alias("url"),
        F.col("r_name").alias("empresa"),
        (F.col("n_nationkey") + 1).alias("unidadegestora"),
    )


def order_ledger(spark, d) -> DataFrame:
    """Loaded rows: every order is a row of topic ``o_orderpriority`` for
    its customer's municipality and order month."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    return j.select(
        F.col("o_orderkey"), F.col("o_orderpriority").alias("topic"),
        F.lower("n_name").alias("municipio"),
        F.concat(F.lit("Prefeitura de "), F.col("n_name")).alias("prefeitura"),
        F.col("r_name").alias("empresa"),
        F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes"),
        F.expr(NATION_URL).alias("base_url"),
    )


def order_topics(spark, d) -> DataFrame:
    """Topic list per vendor: the order priorities seen for that vendor."""
    return order_ledger(spark, d).select("empresa", "topic").distinct()


def catalog_with_uncovered(spark, d) -> DataFrame:
    """The catalog and, per region, a municipality whose vendor has no topics."""
    r = table(spark, d, "region")
    bare = r.select((F.col("r_regionkey") + 1000).cast("bigint").alias("id"), F.concat(F.lit("Prefeitura "), "r_name").alias("prefeitura"),
                    F.lower("r_name").alias("municipio"), F.lit("https://bare.example").alias("url"), F.lit("none").alias("empresa"),
                    F.lit(None).cast("int").alias("unidadegestora"))
    return nation_catalog(spark, d).unionByName(bare)


def topics_with_unloaded(spark, d) -> DataFrame:
    """The topic lists and, per vendor, a topic that was never loaded."""
    r = table(spark, d, "region")
    return order_topics(spark, d).unionByName(r.select(F.col("r_name").alias("empresa"), F.lit("NEVER").alias("topic")))


def yearly_topics(spark, d) -> DataFrame:
    """Topics with URL templates, one per part, for the vendor of a region."""
    p, r = table(spark, d, "part"), table(spark, d, "region")
    return p.join(r, (p.p_partkey % 5) == r.r_regionkey).select(
        F.col("r_name").alias("empresa"), F.lower("p_name").alias("assunto"), F.expr(TEMPLATE).alias("parametros"))


def yearly_ledger(spark, d) -> DataFrame:
    """Loaded rows of the yearly vendor: topic of the part, municipality
    ``p_partkey % 25``, 1996 to 1996 + p_size % 3."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    return p.join(n, (p.p_partkey % 25) == n.n_nationkey).select(
        F.lower("p_name").alias("topic"), F.lower("n_name").alias("municipio"),
        F.concat(F.lit("Prefeitura de "), F.col("n_name")).alias("prefeitura"),
        (F.col("n_nationkey") + 1).cast("string").alias("unidadegestora"),
        F.explode(F.expr("sequence(1996, 1996 + p_size % 3)")).alias("ano"))


def year_requests(spark, d) -> DataFrame:
    """Year pairs from order dates: ten years early on ``% 7 = 0``, text on
    ``% 23 = 0``, swapped on ``% 5 = 0``."""
    y = "cast(year(o_orderdate) + 6 - CASE WHEN o_orderkey % 7 = 0 THEN 10 ELSE 0 END AS string)"
    e = "concat(' ', cast(year(o_orderdate) + 8 AS string))"
    return table(spark, d, "orders").select(
        "o_orderkey", F.expr(f"CASE WHEN o_orderkey % 23 = 0 THEN 'abcd' WHEN o_orderkey % 5 = 0 THEN {e} ELSE {y} END").alias("ano_inicio"),
        F.expr(f"CASE WHEN o_orderkey % 5 = 0 THEN {y} ELSE {e} END").alias("ano_fim"))


def month_bounds(df: DataFrame, col: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """The requested period (a user parameter in the reference): first and
    last month present in a date column - one aggregate row."""
    r = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    return (r["a"].year, r["a"].month), (r["b"].year, r["b"].month)


# --- landing table of responses (events) -------------------------------------

def event_topics(spark, d) -> DataFrame:
    e, n, r = table(spark, d, "events"), table(spark, d, "nation"), table(spark, d, "region")
    j = e.join(n, (e.user_id % 25) == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("r_name").alias("empresa"), F.col("event_type").alias("topic")).distinct()


EVENT_OBJ = ("concat('{\"event_id\":', event_id, ',\"user_id\":', user_id, ',\"event_type\":\"', event_type, "
             "'\",\"value\":', cast(value AS string), ',\"ano\":0,\"props\":', props, '}')")
EVENT_PART = "concat('{\"event_id\":', event_id, ',\"part\":2}')"


def event_landing(spark, d) -> DataFrame:
    """One response per event. URL = the monthly request URL of the cell
    (municipality ``user_id % 25``, topic ``event_type``, event month).
    Status 500 on ``event_id % 11 = 0``; blank body on ``% 13``; truncated
    JSON on ``% 17``; otherwise a one-object list, a bare object, or a
    BOM-prefixed two-object list whose second object has other keys."""
    e, n = table(spark, d, "events"), table(spark, d, "nation")
    j = e.join(n, (e.user_id % 25) == n.n_nationkey)
    full = (f"CASE event_id % 3 WHEN 0 THEN concat('[', {EVENT_OBJ}, ']') WHEN 1 THEN {EVENT_OBJ} "
            f"ELSE concat('{BOM}[', {EVENT_OBJ}, ',', {EVENT_PART}, ']') END")
    body = (f"CASE WHEN event_id % 13 = 0 THEN '   ' "
            f"WHEN event_id % 17 = 0 THEN substr({full}, 1, length({full}) - 2) ELSE {full} END")
    url = (f"format_string('%s/%s?ano=%d&mes=%02d', regexp_replace(CASE WHEN startswith(trim({NATION_URL}), 'http') "
           f"THEN trim({NATION_URL}) ELSE concat('https://', regexp_replace(trim({NATION_URL}), '^/+', '')) END, '/+$', ''), "
           f"event_type, year(ts), month(ts))")
    return j.select(
        F.col("event_id").alias("response_id"), F.expr(url).alias("url"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END").alias("status"),
        F.expr(body).alias("body"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("topic"),
    )


def flat_landing(spark, d) -> DataFrame:
    """Bodies without nesting: a bare object on even ids, a two-object list
    (second object with other keys) on odd ids."""
    e = table(spark, d, "events")
    obj = ("concat('{\"event_id\":', event_id, ',\"user_id\":', user_id, ',\"event_type\":\"', event_type, "
           "'\",\"value\":', cast(value AS string), '}')")
    body = f"CASE WHEN event_id % 2 = 0 THEN {obj} ELSE concat('[', {obj}, ',', {EVENT_PART}, ']') END"
    return e.select(F.col("event_id").alias("response_id"), F.expr(body).alias("body"))


def scalar_landing(spark, d) -> DataFrame:
    """Bodies that are plain JSON values: number, string or boolean."""
    e = table(spark, d, "events")
    body = ("CASE event_id % 3 WHEN 0 THEN cast(cast(round(value * 100) AS bigint) AS string) "
            "WHEN 1 THEN concat('\"', event_type, '\"') "
            "ELSE CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END END")
    return e.select(F.col("event_id").alias("response_id"), F.expr(body).alias("body"))


def event_values(spark, d) -> DataFrame:
    """``valor`` as text with planted bad numbers."""
    e = table(spark, d, "events")
    txt = ("CASE event_id % 10 WHEN 1 THEN '1.234,56' WHEN 2 THEN '1d' WHEN 3 THEN ' 12 ' "
           "WHEN 4 THEN '' ELSE cast(value AS string) END")
    return e.select("event_id", "event_type", F.expr(txt).alias("valor"))


# --- URLs (pages) ------------------------------------------------------------

URL_SCHEME = "regexp_extract(url, '^([a-z]+)://', 1)"
URL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
URL_REST = "regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"


def pages_raw_urls(spark, d) -> DataFrame:
    """Request URLs as users type them: blanks, no scheme, a doubled slash,
    a leading and trailing slash."""
    raw = (f"CASE page_id % 5 WHEN 0 THEN concat('  ', url, ' ') "
           f"WHEN 1 THEN concat({URL_HOST}, {URL_REST}) "
           f"WHEN 2 THEN concat({URL_SCHEME}, '://', {URL_HOST}, '/', {URL_REST}) "
           f"WHEN 3 THEN concat('/', {URL_HOST}, {URL_REST}, '/') ELSE url END")
    return table(spark, d, "pages").select("page_id", F.expr(raw).alias("raw_url"))


def pages_api_urls(spark, d) -> DataFrame:
    """Catalog-style URLs: ``/api/`` appended on even pages."""
    raw = "CASE WHEN page_id % 2 = 0 THEN concat(url, '/api/') ELSE url END"
    return table(spark, d, "pages").select("page_id", F.expr(raw).alias("raw_url"))


def pages_topics(spark, d) -> DataFrame:
    """Topic paths ``Group/Get<last part>``; one in seven without ``Get``,
    one in seven with ``GetGet``."""
    last = "element_at(split(url, '/'), -1)"
    t = (f"CASE page_id % 7 WHEN 0 THEN concat('Group/', {last}) "
         f"WHEN 1 THEN concat('Group/GetGet', {last}) ELSE concat('Group/Get', {last}) END")
    return table(spark, d, "pages").select("page_id", F.expr(t).alias("topic"))


def pages_with_port(spark, d) -> DataFrame:
    u = f"CASE WHEN page_id % 6 = 0 THEN concat({URL_SCHEME}, '://', {URL_HOST}, ':8080', {URL_REST}) ELSE url END"
    return table(spark, d, "pages").select("page_id", F.expr(u).alias("url"))


def pages_with_params(spark, d) -> DataFrame:
    """A repeated key (last wins) and a part without ``=`` on every fourth page."""
    u = "CASE WHEN page_id % 4 = 0 THEN concat(url, CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END, 'page=9&flag') ELSE url END"
    return table(spark, d, "pages").select("page_id", F.expr(u).alias("url"))


def pages_failed_api(spark, d) -> DataFrame:
    """Failed yearly-vendor URLs: ``/api`` inserted after the host on two
    pages in three."""
    u = f"CASE WHEN page_id % 3 <> 0 THEN concat({URL_SCHEME}, '://', {URL_HOST}, '/api', {URL_REST}) ELSE url END"
    return table(spark, d, "pages").select("page_id", F.expr(u).alias("url"))


def pages_catalog(spark, d) -> DataFrame:
    """Portal catalog: scheme and host of pages with even ``page_id`` (id =
    lowest page), plus a deeper entry (host + first path part) for pages
    with ``page_id % 10 = 0``."""
    p = table(spark, d, "pages")
    base = f"concat({URL_SCHEME}, '://', {URL_HOST})"
    hosts = p.filter("page_id % 2 = 0").groupBy(F.expr(base).alias("url")).agg(F.min("page_id").alias("id"))
    deep_url = f"concat({base}, '/', element_at(split({URL_REST}, '/'), 2))"
    deep = (p.filter("page_id % 10 = 0").groupBy(F.expr(deep_url).alias("url"))
            .agg((F.min("page_id") + 100000).alias("id")))
    return hosts.unionByName(deep)


def pages_error_log_lines(spark, d) -> DataFrame:
    line = ("CASE page_id % 4 WHEN 0 THEN concat('2025-06-17 10:57:48|', url, '|HTTPError|400 Client Error: Bad Request for url: ', url) "
            "WHEN 1 THEN concat('2025-06-17 11:00:28|', url, '|Erro: ValueError - Formato inesperado') "
            "WHEN 2 THEN concat('linha sem separador ', page_id) "
            "ELSE concat('2025-06-17 11:02:02|', url, '|ConnectionError|a|b') END")
    return table(spark, d, "pages").select(F.expr(line).alias("value"))


def pages_line_list(spark, d) -> DataFrame:
    line = (f"CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('  ', url, '\t') "
            f"WHEN 2 THEN concat('{BOM}', url) ELSE url END")
    return table(spark, d, "pages").select(F.expr(line).alias("value"))


def pages_retry_results(spark, d) -> DataFrame:
    """Retry outcome per queued URL: success on ``page_id % 3 = 0``."""
    return table(spark, d, "pages").select(
        "url", F.expr("CASE WHEN page_id % 3 = 0 THEN 200 ELSE 503 END").alias("status"),
        F.expr("concat('[{\"page_id\":', page_id, '}]')").alias("body"))


# --- tables --------------------------------------------------------------------

def customer_catalog(spark, d) -> DataFrame:
    """A municipality catalog per customer (vendor = market segment; blank
    unit on every third)."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("prefeitura"),
        F.lower("c_name").alias("municipio"),
        F.expr("concat('https://portal', c_nationkey, '.example.gov/api/')").alias("url"),
        F.col("c_mktsegment").alias("empresa"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END").alias("unidadegestora"),
    )


TEMPLATE = ("CASE p_size % 4 WHEN 0 THEN NULL "
            "WHEN 1 THEN '?unidadeGestoraId={unidadeGestoraId}&exercicio={exercicio}' "
            "WHEN 2 THEN 'exercicio={exercicio}&periodo={periodo}' ELSE ' ' END")


def part_topics(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("assunto"),
        F.expr(TEMPLATE).alias("parametros"))


def part_template_cells(spark, d) -> DataFrame:
    """One templated request per part: municipality ``p_partkey % 25``,
    year ``1995 + p_partkey % 7``."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    j = p.join(n, (p.p_partkey % 25) == n.n_nationkey)
    return j.select("p_partkey", F.lower("p_type").alias("topic"), F.expr(TEMPLATE).alias("template"),
                    F.expr(NATION_URL).alias("base_url"), (F.col("n_nationkey") + 1).alias("unit"),
                    (F.lit(1995) + F.col("p_partkey") % 7).alias("ano"))


def merge_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """All customers and all suppliers; the shared ``nationkey`` is NULL when
    the own key is a multiple of 7, and 10 higher on the supplier side, so
    either side has keys of its own."""
    c = table(spark, d, "customer").select(
        "c_custkey", "c_name",
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END").alias("nationkey"))
    s = table(spark, d, "supplier").select(
        "s_suppkey", "s_name",
        F.expr("CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey + 10 END").alias("nationkey"))
    return c, s


def unify_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two vendors' tables with messy names (case, blanks, a case-duplicate)
    and ``valor`` as text on one side."""
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("CustKey"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END").alias("NationKey "),
        F.expr("CASE c_custkey % 10 WHEN 1 THEN '1.234,56' WHEN 2 THEN '1d' ELSE cast(c_acctbal AS string) END").alias("Valor"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("c_name").alias("valor"),
    )
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("suppkey"),
        F.expr("CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END").alias("nationkey"),
        F.col("s_acctbal").alias("valor"), F.col("s_name").alias("name"),
    )
    return c, s


def period_requests(spark, d) -> DataFrame:
    """``MM/AAAA`` request pairs from order dates: month + 6 on
    ``o_orderkey % 7 = 0``, start and end swapped on ``% 5 = 0``, text month
    on ``% 23 = 0``."""
    o = table(spark, d, "orders")
    start = ("concat(lpad(cast(month(o_orderdate) + CASE WHEN o_orderkey % 7 = 0 THEN 6 ELSE 0 END AS string), 2, '0'), "
             "'/', cast(year(o_orderdate) AS string))")
    end = "concat(lpad(cast(month(o_orderdate) AS string), 2, '0'), '/', cast(year(o_orderdate) + 1 AS string))"
    s = f"CASE WHEN o_orderkey % 23 = 0 THEN 'ab/2024' WHEN o_orderkey % 5 = 0 THEN {end} ELSE {start} END"
    e = f"CASE WHEN o_orderkey % 5 = 0 THEN {start} ELSE {end} END"
    return o.select("o_orderkey", F.expr(s).alias("periodo_inicio"), F.expr(e).alias("periodo_fim"))


def process_numbers(spark, d) -> DataFrame:
    """Process and year as REAL (as the reference stores them), process
    NULL on ``(l_orderkey + l_linenumber) % 9 = 0``."""
    li = table(spark, d, "lineitem")
    return li.select(
        "*",
        F.expr("CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE cast(l_orderkey AS double) END").alias("processo"),
        F.expr("cast(year(l_shipdate) AS double)").alias("anoprocesso"))


def nested_lines(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    rec = F.struct(
        F.col("l_orderkey").alias("orderkey"),
        F.struct(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).alias("item"),
        F.struct(F.col("l_quantity").alias("quantity"),
                 F.struct(F.col("l_extendedprice").alias("extended"), F.col("l_discount").alias("discount")).alias("price")
                 ).alias("amounts"))
    return li.select("l_linenumber", rec.alias("rec"))


def indexed_lines(spark, d) -> DataFrame:
    """An array of 1-3 objects per line item."""
    li = table(spark, d, "lineitem")
    items = F.expr("slice(array(named_struct('qty', l_quantity, 'disc', l_discount), "
                   "named_struct('qty', l_quantity * 2, 'disc', l_tax), "
                   "named_struct('qty', l_quantity * 3, 'disc', l_discount + l_tax)), 1, 1 + l_linenumber % 3)")
    return li.select("l_orderkey", "l_linenumber", items.alias("items"))


def columnar_orders(spark, d) -> DataFrame:
    """Columnar payload per order ``{"linha": [...], "valor": [...]}`` with
    ``1 + o_orderkey % 4`` entries; ``valor`` one short on ``% 19 = 0``."""
    o = table(spark, d, "orders")
    linha = "sequence(1, 1 + cast(o_orderkey % 4 AS int))"
    valor = f"transform({linha}, i -> o_totalprice * i)"
    valor = f"CASE WHEN o_orderkey % 19 = 0 THEN slice({valor}, 1, cast(o_orderkey % 4 AS int)) ELSE {valor} END"
    return o.select("o_orderkey", F.to_json(F.struct(F.expr(linha).alias("linha"), F.expr(valor).alias("valor"))).alias("body"))


def int_embeddings(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label",
                    F.expr("transform(embedding, x -> cast(floor(cast(x AS double) * 1000) AS int))").alias("embedding"))


# --- responses of several topics and fetch runs --------------------------------

#: Bodies whose field ``valor`` has another type in each topic: number, text,
#: object, whole and broken numbers mixed, number beside a second object.
TOPIC_BODY = ("CASE event_type WHEN 'click' THEN concat('{\"valor\":', event_id, '}') "
              "WHEN 'error' THEN concat('{\"valor\":\"e', event_id, '\"}') "
              "WHEN 'purchase' THEN concat('{\"id\":', user_id, ',\"valor\":{\"a\":', event_id, '}}') "
              "WHEN 'signup' THEN concat('{\"valor\":', event_id % 1000, CASE WHEN event_id % 2 = 0 THEN '' ELSE '.5' END, '}') "
              "ELSE concat('[{\"valor\":', event_id, '},{\"extra\":\"x', user_id, '\"}]') END")


def topic_landing(spark, d) -> DataFrame:
    """One response per event as in :func:`event_landing`, with a fetch run:
    run 2 where ``event_id % 4 = 3`` and ``user_id % 3 = 0`` in municipalities
    0 to 7 (its bodies replace their cell's), else 1; cells of municipality 6 come back without
    rows in run 2; status 500 on ``event_id % 11``, blank on ``% 13``."""
    late = "(event_id % 4 = 3 AND user_id % 3 = 0 AND user_id % 25 < 8)"
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("event_id").alias("response_id"))
    return event_landing(spark, d).select("response_id", "url", "status", "fetched_at").join(e, "response_id").select(
        "event_id", "url", "status", "fetched_at", F.expr(f"CASE WHEN {late} THEN 2L ELSE 1L END").alias("run_id"),
        F.expr(f"CASE WHEN event_id % 13 = 0 THEN '   ' WHEN {late} AND user_id % 25 = 6 THEN '[]' ELSE {TOPIC_BODY} END").alias("body"))


# --- failed requests of the yearly vendor ---------------------------------------

#: The host lies on a portal of its own for each page in four; without
#: parameters on ``% 10 = 9``, without an api part on ``% 10 = 8``, with a
#: doubled slash on ``% 4 = 2``.
REQUEST = (f"concat({URL_SCHEME}, '://', {URL_HOST}, CASE WHEN page_id % 10 = 8 THEN '/v1/' WHEN page_id % 4 = 2 THEN '//api/' ELSE '/api/' END, "
           "'topic', page_id % 7, CASE WHEN page_id % 10 = 9 THEN '' ELSE concat('?unidadeGestoraId=', 1 + page_id % 3, '&exercicio=', "
           "2015 + page_id % 9, '&pagina=', page_id) END)")


def pages_requests(spark, d) -> DataFrame:
    """The retry queue: one failed request per page."""
    return table(spark, d, "pages").select("page_id", F.expr(REQUEST).alias("url"))


def pages_unit_catalog(spark, d) -> DataFrame:
    """Portals of pages with even ``page_id``, each with units 1 and 2."""
    p = table(spark, d, "pages").filter("page_id % 2 = 0")
    hosts = p.groupBy(F.expr(f"concat({URL_SCHEME}, '://', {URL_HOST})").alias("base")).agg(F.min("page_id").alias("first"))
    return hosts.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("unidadegestora"), "base", "first").select(
        (F.col("first") * 10 + F.col("unidadegestora")).alias("id"), F.concat("base", F.lit("/")).alias("url"),
        F.concat(F.lit("m-"), "base").alias("municipio"), F.concat(F.lit("P "), "base").alias("prefeitura"), "unidadegestora")


def pages_retry_responses(spark, d) -> DataFrame:
    """What the fetcher brought: nothing on ``page_id % 11 = 0``, status 503
    on ``% 3 = 1``, a blank body on ``% 9 = 2``, broken JSON on ``% 9 = 5``."""
    body = "CASE page_id % 9 WHEN 2 THEN '  ' WHEN 5 THEN '{\"page' ELSE concat('[{\"page_id\":', page_id, ',\"nota\":\"x', page_id % 4, '\"}]') END"
    return table(spark, d, "pages").filter("page_id % 11 <> 0").select(
        F.expr(REQUEST).alias("url"), F.expr("CASE WHEN page_id % 3 = 1 THEN 503 ELSE 200 END").alias("status"), F.expr(body).alias("body"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"))


def object_lists(spark, d) -> DataFrame:
    """Bodies that are an object of lists of objects: two lists, of which the
    second is empty on even keys, or one list on every third key."""
    body = ("CASE WHEN o_orderkey % 3 = 0 THEN concat('{\"itens\":[{\"q\":', o_orderkey, '},{\"q\":', o_orderkey + 1, '}]}') "
            "ELSE concat('{\"contratos\":[{\"v\":', o_orderkey, '}', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat(',{\"v\":', o_orderkey + 1, '}') END, "
            "'],\"aditivos\":[', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('{\"w\":', o_orderkey + 2, '}') END, ']}') END")
    return table(spark, d, "orders").select("o_orderkey", F.lit(200).alias("status"), F.expr(body).alias("body"))


def heavy_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers, a third of either on key 99, a seventh on
    NULL; the suppliers' other keys 10 higher."""
    key = "CASE WHEN {k} % 3 = 0 THEN 99 WHEN {k} % 7 = 0 THEN NULL ELSE {n} END"
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.expr(key.format(k="c_custkey", n="c_nationkey")).alias("nationkey"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.expr(key.format(k="s_suppkey", n="s_nationkey + 10")).alias("nationkey"))
    return c, s


# --- messages and names -----------------------------------------------------------

#: Log messages of five kinds: an URL and a status, four field names in one
#: place, a number, two types in one place, nothing.
LOG_MESSAGE = ("CASE page_id % 5 WHEN 0 THEN concat('HTTP ', 400 + page_id % 7, ' Client Error for url: ', url) "
               "WHEN 1 THEN concat('Field ', CASE page_id % 4 WHEN 0 THEN 'valor' WHEN 1 THEN 'data' WHEN 2 THEN 'nome' ELSE 'cpf' END, ' missing  in response') "
               "WHEN 2 THEN concat('Timeout after ', page_id, ' s') "
               "WHEN 3 THEN concat('Cannot read ', CASE page_id % 2 WHEN 0 THEN 'int' ELSE 'float' END) ELSE ' ' END")


def pages_messages(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(
        F.expr("CASE page_id % 3 WHEN 0 THEN 'HTTPError' WHEN 1 THEN 'ValueError' END").alias("error_type"), F.expr(LOG_MESSAGE).alias("message"),
        F.expr("concat('2025-06-', lpad(cast(1 + page_id % 28 AS string), 2, '0'), ' 10:00:00')").alias("logged_at"))


#: A word for a number: three letters a digit, no letter in common at any place.
SYLLABLES = ("bcd", "fgh", "jkl", "mnp", "qrs", "tvw", "xyz", "aei", "oub", "ndk")


def word_of(number: str, replace: str = "replace") -> str:
    text = f"cast({number} AS string)"
    for k, s in enumerate(SYLLABLES):
        text = f"{replace}({text}, '{k}', '{s}')"
    return text


def payroll_names(spark, d) -> DataFrame:
    """Customers four to a person, the name written as it is, with accents,
    particle and blanks, with a letter changed, or with one missing; suppliers
    as a second job of the person of their number."""
    word = word_of("1000 + cast(floor(c_custkey / 4) AS int)")
    c = table(spark, d, "customer").select(
        F.expr(f"CASE c_custkey % 4 WHEN 0 THEN concat('Joao Silva ', {word}) WHEN 1 THEN concat(' joão da  SILVA, ', {word}) "
               f"WHEN 2 THEN concat('Joao Silva ', 'w', substr({word}, 2)) ELSE concat('Joao Silva ', substr({word}, 1, length({word}) - 1)) END").alias("name"),
        F.col("c_nationkey").alias("employer"), F.lit(2024).alias("ano"), F.expr("1 + cast(floor(c_custkey / 4) AS int) % 12").alias("mes"))
    s = table(spark, d, "supplier").select(
        F.expr(f"concat('SILVA Joao ', {word_of('1000 + cast(s_suppkey AS int)')})").alias("name"), (F.col("s_nationkey") + 100).alias("employer"),
        F.lit(2024).alias("ano"), F.expr("1 + cast(s_suppkey AS int) % 12").alias("mes"))
    return c.unionByName(s)
