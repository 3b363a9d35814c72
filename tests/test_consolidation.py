"""Retry job, pending ranges, heavy merges, profiles, long arrays, timelines."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import indicators as IND
from civicspark.operators import nested as N
from civicspark.operators import profile as P
from civicspark.operators import unify as UN
from civicspark.plans import extraction as X
from civicspark.streaming import retry_job as RJ

# --- retry -------------------------------------------------------------------


def cell(spark, url, vendor):
    r = spark.createDataFrame([(url,)], "u string").select(*[c.alias(n) for n, c in RJ.request_cell(F.col("u"), vendor).items()]).first()
    return tuple(r)


def test_cells_are_read_back_from_planned_urls(spark):
    cat = spark.createDataFrame([(1, " http://a.b/api/ ", "m", "p", "v", 7), (2, "x.y:8080/zapi", "n", "q", "v", None)],
                                "id long, url string, municipio string, prefeitura string, empresa string, unidadegestora int")
    topics = spark.createDataFrame([("v", "Grupo/GetContratos")], "empresa string, topic string")
    for r in X.monthly_plan(cat, topics, (2023, 12), (2024, 2)).collect():
        assert cell(spark, r.url, RJ.MONTHLY) == ("contratos", None, r.ano, r.mes)
    yearly = spark.createDataFrame([("v", "licitacoes", "?unidadeGestoraId={unidadeGestoraId}&exercicio={exercicio}")], "empresa string, assunto string, parametros string")
    for r in X.yearly_plan(cat.filter("id = 1"), yearly, 2020, 2021).collect():
        assert cell(spark, r.url, RJ.YEARLY) == ("licitacoes", "7", r.ano, None)
    assert cell(spark, "https://a.b/api/x?UNIDADEGESTORAID=3&exercicio=abc&exercicio=2020", RJ.YEARLY) == ("x", "3", 2020, None)
    assert cell(spark, "https://a.b/v1/x", RJ.YEARLY) == (None, None, None, None)


def test_retry_run_accounts_for_every_request(spark):
    base = "https://h.x/api/t"
    queue = spark.createDataFrame([(f"{base}?ano=2024&mes={m}",) for m in range(1, 8)] + [(base,), ("https://no.x/api/t?ano=2024&mes=1",), ("h.x//api//t?ano=2024&mes=1",)], "url string")
    answers = [(1, 200, '[{"v":1},{"v":2}]', "2024-01-02"), (1, 500, "x", "2024-01-01"), (2, 500, "x", None), (3, 200, " ", None), (4, 200, "{", None),
               (5, 200, "[]", None), (6, 200, '{"a":[1],"b":[1,2]}', None)]
    responses = spark.createDataFrame([(f"{base}?ano=2024&mes={m}", s, b, t) for m, s, b, t in answers], "url string, status int, body string, fetched_at string")
    responses = responses.withColumn("fetched_at", F.to_timestamp_ntz("fetched_at"))
    catalog = spark.createDataFrame([(1, "h.x/", "m", "p", None)], "id long, url string, municipio string, prefeitura string, unidadegestora int")
    out = {r.request.split("mes=")[-1] if "h.x" in r.request and "mes" in r.request else r.request: r.outcome
           for r in RJ.retry_outcomes(queue, responses, catalog).collect()}
    assert out == {"1": "loaded", "2": "error", "3": "empty", "4": "invalid", "5": "loaded", "6": "loaded", "7": "missing", base: "skipped", "https://no.x/api/t?ano=2024&mes=1": "unmatched"}
    run = RJ.retry_run(queue, responses, catalog)
    assert sorted((r.table_name, r.municipio, r.ano, r.mes, r.v) for r in run.rows.collect()) == [("t", "m", 2024, 1, 1), ("t", "m", 2024, 1, 2)]
    assert sorted(r.error_type for r in run.errors.collect()) == ["error", "invalid"]
    assert sorted(r.url[-5:] for r in run.queue.collect()) == sorted(["mes=2", "mes=3", "mes=4", "mes=7", "api/t", "mes=1"])
    none = queue.limit(0)
    empty = RJ.retry_run(none, responses, catalog)
    assert empty.rows.count() == empty.errors.count() == empty.queue.count() == 0


# --- pending ranges ------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_expand_to_the_cells(spark, seed):
    rng = random.Random(seed)
    cells = {(t, "m", "p", 2000 + i // 12, i % 12 + 1) for t in "abc" for i in range(60) if rng.random() < 0.6}
    df = spark.createDataFrame([*cells, *list(cells)[:5]], "topic string, municipio string, prefeitura string, ano int, mes int")
    ranges = X.pending_ranges(df)
    assert {tuple(r) for r in X.expand_ranges(ranges).collect()} == cells
    i = lambda t: {c[3] * 12 + c[4] for c in cells if c[0] == t}
    assert ranges.count() == sum(1 for t in "abc" for x in i(t) if x - 1 not in i(t))  # one range a run
    assert sum(r.n_periods for r in ranges.collect()) == len(cells)
    assert X.pending_ranges(df.limit(0)).count() == 0


# --- merge -----------------------------------------------------------------------

def brute_merge(left, right, pair):
    out, used = [], set()
    for a in left:
        hits = [k for k, b in enumerate(right) if a[0] == b[0] and (pair or a[0] is not None)]
        used |= set(hits)
        out += [(a[0], a[1], right[k][1]) for k in hits] or [(a[0], a[1], None)]
    return collections.Counter(out + [(b[0], None, b[1]) for k, b in enumerate(right) if k not in used])


def sides(spark, n, m):
    left = [(None if i % 5 == 1 else 7 if i % 3 == 0 else 8 if i % 4 == 0 else i, f"l{i % 50}") for i in range(n)]
    right = [(None if i % 6 == 1 else 7 if i % 2 == 0 else i + 3, f"r{i}") for i in range(m)]
    return left, right, spark.createDataFrame(left, "k int, a string"), spark.createDataFrame(right, "k int, b string")


@pytest.mark.parametrize("null_keys", ["pair", "single"])
@pytest.mark.parametrize("rows_per_task", [10, 10_000])
def test_heavy_merge_equals_brute_force(spark, null_keys, rows_per_task):
    left, right, a, b = sides(spark, 240, 60)
    got = UN.merge_outer_heavy(a, b, share=0.1, rows_per_task=rows_per_task, null_keys=null_keys)
    assert got.columns == ["k", "a", "b"]
    assert collections.Counter(map(tuple, got.collect())) == brute_merge(left, right, null_keys == "pair")
    assert UN.merge_outer_heavy(a.limit(0), b, share=0.1).count() == len(right)
    assert UN.merge_outer_heavy(a, b.limit(0), share=0.1).count() == len(left)


def test_no_task_of_a_heavy_key_stands_out(spark):
    left = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS a").withColumn("__h", F.xxhash64("k"))
    right = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS b").withColumn("__h", F.xxhash64("k"))
    found = UN.heavy_keys(left, ["k"], 0.1)
    assert found == [left.filter("k = -1").first()["__h"]]
    a, _ = UN.salted_sides(left, right, ["k"], found, 500)
    per = sorted(r["n"] for r in a.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n")).collect())
    assert len(per) == 20 * 2 and per[-1] <= 4 * per[len(per) // 2] and sum(per) == 2 * 10_000


@pytest.mark.parametrize("null_keys", ["pair", "single"])
def test_pairs_of_a_heavy_key_fill_all_partitions(spark, null_keys):
    """AQE would merge their partitions by bytes, however many pairs the rows make."""
    a, b = spark.range(600).selectExpr("'x' AS k", "id AS a"), spark.range(300).selectExpr("if(id % 5 = 0, NULL, 'x') AS k", "id AS b")
    got = UN.merge_outer_heavy(a, b, share=0.1, rows_per_task=20, null_keys=null_keys)
    per = {r.p: r["count"] for r in got.filter("a IS NOT NULL AND b IS NOT NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert sum(per.values()) == 600 * 240 and len(per) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_shared_columns_get_suffixes(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    got = UN.merge_outer_heavy(a, b, ["k"], share=0.5)
    assert got.columns == ["k", "v_bd1", "v_bd2"] and sorted(map(tuple, got.collect()), key=repr) == [(1, "x", "y"), (2, None, "z")]


# --- profile ---------------------------------------------------------------------

def test_profiles_merge_and_estimate(spark):
    df = spark.range(40_000).selectExpr("id % 9000 AS k", "CASE WHEN id % 2 = 0 THEN CAST(id AS double) END AS x", "concat('t', id % 3) AS s", "array(id % 5) AS l", "-0.0D * (id % 2) AS z")
    batches = [P.batch_profile(df.filter(f"k % 3 = {i}")) for i in range(3)]
    merged = {r.column_name: r for r in P.merge_profiles(batches[0].union(batches[1]).union(batches[2])).collect()}
    exact = {r.column_name: r for r in P.exact_profile(df).collect()}
    assert {c: (r.n_rows, r.non_null) for c, r in merged.items()} == {c: (r.n_rows, r.non_null) for c, r in exact.items()}
    assert {c: r.n_distinct for c, r in exact.items()} == {"k": 9000, "x": 20_000, "s": 3, "l": 5, "z": 1}
    assert all(abs(merged[c].n_distinct - exact[c].n_distinct) <= 0.03 * exact[c].n_distinct for c in exact)
    plan = P.exact_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_profile_of_drifting_batches(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string"), spark.createDataFrame([("2", 1.5)], "k string, n double")
    got = {r.column_name: (r.n_rows, r.non_null, r.data_type, r.n_distinct) for r in P.merge_profiles(P.batch_profile(a).union(P.batch_profile(b))).collect()}
    assert got == {"k": (3, 3, "mixed", 2), "s": (2, 1, "string", 1), "n": (1, 1, "double", 1)}


# --- long arrays -------------------------------------------------------------------

def test_one_long_list_leaves_the_width(spark):
    body = lambda n: "[" + ",".join('{"v":%d,"o":{"w":"x"}}' % k for k in range(n)) + "]"
    schema = "array<struct<v:int,o:struct<w:string>>>"
    short = spark.createDataFrame([(k, body(k % 3 + 1)) for k in range(200)], "id int, body string")
    both = short.union(spark.createDataFrame([(999, body(100_000)), (1000, None), (1001, "[]")], "id int, body string"))
    table = lambda df: df.select("id", F.from_json("body", schema).alias("items"))
    wide, rest = N.pivot_indexed(table(both), ["id"], quantile=0.95)
    assert wide.columns == N.pivot_indexed(table(short), ["id"], quantile=0.95)[0].columns == ["id", *[f"items_{i}_{f}" for i in range(3) for f in ("v", "o_w")]]
    assert rest.count() == 2 * (100_000 - 3) and rest.agg(F.min("idx"), F.max("idx")).first()[:] == (3, 99_999)
    assert wide.count() == 203 and N.indexed_values(table(short), ["id"]).count() == 2 * sum(k % 3 + 1 for k in range(200))
    assert N.indexed_values(short, ["id"]).count() == 0


def test_objects_of_lists_of_objects_are_one_row(spark):
    rows = [(1, 200, '{"contratos":[{"v":1},{"v":2}],"aditivos":[{"w":3}]}'), (2, 200, '{"itens":[{"q":1},{"q":2}]}'), (3, 200, '{"a":[1,2],"b":["x","y"]}'), (4, 200, '{"a":[1],"b":[]}')]
    landing = spark.createDataFrame(rows, "id int, status int, body string")
    out = {(r.id, r.pos): r for r in N.scan_json_payload(landing, keep=["id"], index_arrays=True).collect()}
    assert (out[1, 0].contratos_0_v, out[1, 0].contratos_1_v, out[1, 0].aditivos_0_w) == (1, 2, 3) and (out[2, 0].itens_0_q, out[2, 0].itens_1_q) == (1, 2)
    assert (out[3, 0].a, out[3, 0].b, out[3, 1].a, out[3, 1].b) == (1, "x", 2, "y") and len(out) == 4
    assert [r.id for r in N.payload_errors(landing, keep=["id"]).collect()] == [4]


# --- indicators --------------------------------------------------------------------

def test_robust_outliers_do_not_depend_on_plans(spark):
    rows = [(k % 4, 2020, float((k * 7919) % 101)) for k in range(2000)] + [(1, 2020, 1e6), (9, 2020, 5.0), (9, 2020, 5.0), (9, 2020, 8.0), (2, 2020, None)]
    items = spark.createDataFrame(rows, "item int, ano int, price double").repartition(5)
    seen = set()
    for aqe in ("true", "false"):
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            try:
                seen.add(tuple(sorted(tuple(r) for r in IND.robust_outliers(items, "item", ["ano"], "price", k=1.9).collect())))
            finally:
                spark.conf.set("spark.sql.adaptive.enabled", "true")
                spark.conf.set("spark.sql.exchange.reuse", "true")
    assert len(seen) == 1 and any(r[2] == 1e6 for r in next(iter(seen))) and not any(r[0] == 9 for r in next(iter(seen)))


def test_timeline_gaps_at_both_ends(spark):
    plan = spark.createDataFrame([("t", "m", "p", 2000 + i // 12, i % 12 + 1) for i in range(36)] + [("t", "none", "p", 2000, k + 1) for k in range(12)],
                                 "topic string, municipio string, prefeitura string, ano int, mes int")
    have = [5, 6, *range(12, 24), 30]
    loaded = spark.createDataFrame([("t", "m", "p", 2000 + i // 12, i % 12 + 1) for i in have + have] + [("t", "m", "p", 1990, 1)], plan.schema)
    got = {r.municipio: tuple(r)[3:] for r in IND.coverage_timeline(plan, loaded).collect()}
    assert got == {"m": (15, 3, 6, 5, 2001), "none": (0, 0, 12, 12, None)}
