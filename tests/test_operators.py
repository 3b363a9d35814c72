"""The reference's own argument checks, merge/dedup semantics, nested
payload shapes."""

import logging

import pytest
from pyspark.sql import functions as F

from civicspark.errors import EmptySelection, SchemaError, TableNotFound
from civicspark.operators import nested as N
from civicspark.operators import profile as P
from civicspark.operators import schema as C
from civicspark.operators import unify as UN
from civicspark.plans import extraction as X
from civicspark.plans import periods as PR
from civicspark.session import scratch_path
from civicspark.sources import tables as TB


@pytest.fixture()
def abc(spark):
    return spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")


def test_rename_checks(abc):
    with pytest.raises(SchemaError):
        C.rename_columns(abc, {"zz": "y"})
    with pytest.raises(SchemaError):
        C.rename_columns(abc, {"a": "b"})
    swapped = C.rename_columns(abc, {"a": "b", "b": "a"})
    assert swapped.columns == ["b", "a", "c"] and swapped.first()["b"] == 1


def test_drop_and_retype_checks(abc):
    with pytest.raises(SchemaError):
        C.drop_columns(abc, ["zz"])
    with pytest.raises(SchemaError):
        C.drop_columns(abc, ["a", "b", "c"])
    with pytest.raises(SchemaError):
        C.retype_columns(abc, {"zz": "TEXT"})
    assert C.drop_columns(abc, ["b"]).columns == ["a", "c"]


def test_retype_rejects_counts(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert C.retype_columns(df, {"v": "INTEGER"}).dtypes == [("v", "bigint")]
    assert [tuple(r) for r in C.retype_rejects(df, {"v": "INTEGER"}).collect()] == [("v", 1)]


def test_normalize_names_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" Valor", "VALOR", "x ")
    out = C.normalize_column_names(df)
    assert out.columns == ["valor", "x"] and tuple(out.first()) == (1, 3)


def test_evolve_ignore_case(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(2, "y", 5)], "id int, NAME string, extra int")
    out = C.evolve_union(a, b, case_sensitive=False)
    assert out.columns == ["id", "name", "extra"] and out.count() == 2


def test_merge_null_keys_and_strategies(spark):
    left = spark.createDataFrame([(1, None), (2, 7), (3, 8)], "l int, k int")
    right = spark.createDataFrame([(None, "n"), (7, "s"), (7, "t"), (9, "u")], "k int, r string")
    split = sorted(map(tuple, UN.merge_outer_common(left, right).select("k", "l", "r").collect()),
                   key=str)
    full = sorted(map(tuple, UN.merge_outer_common(left, right, strategy="full").select("k", "l", "r").collect()),
                  key=str)
    assert split == full
    assert (None, 1, "n") in split and (7, 2, "s") in split and (7, 2, "t") in split
    assert (8, 3, None) in split and (9, None, "u") in split and len(split) == 5


def test_merge_refuses_mixed_key_types(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([("1",)], "k string")
    with pytest.raises(SchemaError):
        UN.merge_outer_common(a, b)


def test_dedup_keep_first_and_fallback(spark, caplog):
    df = spark.createDataFrame([("t", 3, "c"), ("t", 1, "a"), ("u", None, "z"), ("u", 2, "b")],
                               "k string, o int, v string")
    out = {r["k"]: r["v"] for r in UN.dedup(df, ["k"], ["o"]).collect()}
    assert out == {"t": "a", "u": "b"}  # NULL order values sort last
    with caplog.at_level(logging.WARNING):
        assert UN.dedup(df, ["missing"]).count() == 4
    assert "not found" in caplog.text


def test_zip_columns_reports_unequal_lengths(spark):
    df = spark.createDataFrame([(1, ([1, 2], ["a", "b"])), (2, ([1], []))],
                               "id int, p struct<n:array<int>, s:array<string>>")
    rows, errors = N.zip_columns_to_rows(df, "p", ["id"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    assert [tuple(r) for r in errors.collect()] == [(2, N.ZIP_LENGTH_ERROR)]


def test_json_rows_union_keys_scalar_lists_and_bad_json(spark):
    df = spark.createDataFrame([(1, '[{"a":1},{"b":"x"}]'), (2, '{"a":2,"c":{"d":true}}'),
                                (3, "[1,2,3]"), (4, '[{"a":'), (5, "7")], "id int, body string")
    rows = N.json_rows(df, keep=["id"])
    got = sorted(tuple(r) for r in N.flatten_struct(rows).select("id", "pos", "a", "b", "c_d").collect())
    assert got == [(1, 0, 1, None, None), (1, 1, None, "x", None), (2, 0, 2, None, True)]
    assert [tuple(r) for r in N.scalar_valor(df, keep=["id"]).collect()] == [(5, "7")]


def test_flatten_indexed_width_cap_keeps_rest(spark):
    df = spark.createDataFrame([(1, [(1,), (2,), (3,)]), (2, [(4,)])], "id int, xs array<struct<v:int>>")
    out = N.flatten_struct(df, index_arrays=True, max_index_width=2)
    assert out.columns == ["id", "xs_0_v", "xs_1_v", "xs_rest"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 2, '[{"v":3}]'), (2, 4, None, None)]


def test_classify(spark):
    df = spark.createDataFrame([(500, "[]"), (200, "  "), (200, "{bad"), (200, "﻿[1]")], "status int, body string")
    assert [r[0] for r in N.classify_responses(df).select("response_class").collect()] == \
        ["error", "empty", "invalid", "ok"]


def test_validate_periods_reasons(spark):
    df = spark.createDataFrame([("01/2024", "03/2024"), ("05/2024", "03/2024"), ("13/2024", "14/2024"),
                                ("ab/2024", "01/2024"), ("01/2024/x", "02/2024")], "a string, b string")
    got = [(r["valid"], r["reason"]) for r in PR.validate_periods(df, "a", "b").collect()]
    assert got == [(True, None), (False, "order"), (False, "month"), (False, "format"), (True, None)]


def test_month_range_inclusive_and_empty(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2023, 11, 5), dt.date(2024, 2, 1)), (dt.date(2024, 5, 1), dt.date(2024, 1, 1))],
                               "s date, e date")
    got = [tuple(r) for r in PR.month_range(df, "s", "e").collect()]
    assert got == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]


def test_vendor_filter_stops_when_empty(spark):
    cat = spark.createDataFrame([(1, "portaltp")], "id int, empresa string")
    with pytest.raises(EmptySelection):
        X.vendor_filter(cat, "PortalTP", require=True)


def test_table_lookup_and_atomic_overwrite(spark):
    root = scratch_path(spark, "t")
    spark.range(3).write.parquet(f"{root}/BensImoveis")
    assert TB.resolve_table_name(spark, root, "bensimoveis") == "BensImoveis"
    with pytest.raises(TableNotFound, match="BensImoveis"):
        TB.resolve_table_name(spark, root, "nope")
    path = f"{root}/out"
    TB.overwrite_atomic(spark.range(5), path)
    TB.overwrite_atomic(spark.read.parquet(path).filter("id < 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_ranked_median_equals_spark_median_with_a_hot_group(spark):
    from civicspark.operators.indicators import group_median
    rows = [(0 if i % 3 == 0 else i % 17, float((i * 7919) % 101) / 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double")
    a = {r[0]: r[1] for r in group_median(df, ["g"], "v", method="aggregate").collect()}
    b = {r[0]: r[1] for r in group_median(df, ["g"], "v").collect()}
    assert a == b and len(a) == 17


def test_yearly_plan_and_resume_from_next_year(spark):
    cat = spark.createDataFrame([(9, "P", "m", "http://ws.x.gov/api/", "tectrilha", 3)],
                                "id long, prefeitura string, municipio string, url string, empresa string, unidadegestora int")
    topics = spark.createDataFrame([("tectrilha", "contratos", "?unidadeGestoraId={unidadeGestoraId}&exercicio={exercicio}"),
                                    ("tectrilha", "bensImoveis", " ")], "empresa string, assunto string, parametros string")
    plan = X.yearly_plan(cat, topics, 2023, 2024)
    urls = sorted(r["url"] for r in plan.collect())
    assert urls == ["http://ws.x.gov/api/bensImoveis", "http://ws.x.gov/api/bensImoveis",
                    "http://ws.x.gov/api/contratos?unidadeGestoraId=3&exercicio=2023",
                    "http://ws.x.gov/api/contratos?unidadeGestoraId=3&exercicio=2024"]
    ledger = spark.createDataFrame([("tectrilha", "contratos", 2023), ("tectrilha", "bensImoveis", 2024)],
                                   "empresa string, topic string, ano int")
    marks = X.high_water_mark(ledger, ["empresa", "topic"], mes=None)
    todo = sorted((r["topic"], r["ano"]) for r in X.resume_years(marks, cat, topics, 2024).collect())
    assert todo == [("contratos", 2024)]


def test_shared_url_stamps_first_cell(spark):
    plan = spark.createDataFrame([("u", "m", "p", 2024, 1), ("u", "m", "p", 2023, 1), ("v", "m", "p", 2024, 2)],
                                 "url string, municipio string, prefeitura string, ano int, mes int")
    resp = spark.createDataFrame([("u", "[1]"), ("v", "[2]")], "url string, body string")
    got = sorted((r["url"], r["ano"], r["mes"]) for r in C.stamp_responses(resp, plan).collect())
    assert got == [("u", 2023, 1), ("v", 2024, 2)]


def test_payload_names_types_and_shapes(spark):
    from civicspark.operators import nested as N
    land = spark.createDataFrame([(1, 200, '[{"Valor":1,"VOID":null,"pos":5}]'), (2, 200, '{"valor":"s","VARIANT":2,"o":{"k":1,"K":"z"}}'),
                                  (3, 200, '"sem dados"'), (4, 200, '{"valor":[1.5,2],"VARIANT":[3,4]}')], "id long, status int, body string")
    rows = {(r["id"], r["pos"]): r.asDict() for r in N.scan_json_payload(land, keep=["id"]).collect()}
    name = next(n for n in rows[1, 0] if n.lower() == "valor")
    assert {k: r[name] for k, r in rows.items()} == {(1, 0): "1", (2, 0): "s", (3, 0): "sem dados", (4, 0): "1.5", (4, 1): "2"}
    assert rows[1, 0]["payload_pos"] == 5 and rows[2, 0]["VARIANT"] == 2 and rows[4, 1]["VARIANT"] == 4
    assert rows[2, 0]["o_K"] == "z"


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_median_does_not_depend_on_settings(spark, reuse, adaptive):
    import math
    import statistics
    from civicspark.operators import indicators as IND
    rows = [(None if k % 3 == 0 else k % 3, math.sin(k) * 10 ** (k % 5) if k % 11 else None) for k in range(3000)]
    rows += [(7, 0.0), (7, -1.0), (8, 5.0), (9, 2.0), (9, 2.0), (10, float("inf")), (10, 1.0), (10, 0.5)]
    old = {c: spark.conf.get(c) for c in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.createDataFrame(rows, "g int, v double").repartition(7)
        got = {r.g: r.m for r in IND.group_median(df, ["g"], "v", "m").collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g], statistics.median(v), rel_tol=1e-12) for g, v in want.items())


def test_pairs_of_a_key_are_dealt_over_cells(spark):
    """400 x 300 pairs of one key and a NULL key meet in cells of 50 x 50, each pair in one of them."""
    left = spark.range(800).select(F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN id ELSE 7 END").alias("k"), F.col("id").alias("l"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    right = spark.range(400).select(F.expr("CASE id % 4 WHEN 0 THEN NULL ELSE 7L END").alias("__r_k"), F.col("id").alias("r"))
    a, b = UN.deal_pairs(left, right, ["k"], ["__r_k"], cell_rows=50)
    met = a.join(b, a["k"].eqNullSafe(b["__r_k"]) & (a["__a"] == b["__ra"]) & (a["__b"] == b["__rb"]))
    assert met.count() == met.select("l", "r").distinct().count() == 400 * 300 + 200 * 100
    assert max(r["count"] for r in met.groupBy("k", "__a", "__b").count().collect()) < 4 * 50 * 50
    joined = UN.merge_outer_common(left, right.withColumnRenamed("__r_k", "k"))
    assert joined.count() == 400 * 300 + 200 * 100 + 200
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "strategy=merge" in plan


def test_cells_of_many_keys_meet_in_all_partitions(spark):
    """Cells are numbered through all keys, so pairs meet by that number alone, in as many tasks as there are shuffle partitions."""
    left = spark.range(900).select(F.expr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE -7 END").alias("k"), F.col("id").alias("l"))
    right = spark.range(450).select(F.expr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE id + 1000 END").alias("__r_k"), F.col("id").alias("r"))
    a, b = UN.deal_pairs(left, right, ["k"], ["__r_k"], cell_rows=40)
    assert a.filter("__dealt").select("k", "__a", "__b").distinct().count() == a.filter("__dealt").select("__cell").distinct().count() == 2 * 8 * 4
    met = UN.meet_in_cells(a.filter("__dealt"), b.filter("__dealt"))
    rows = met.select("l", "r", F.col("k").eqNullSafe(F.col("__r_k")).alias("same"), F.spark_partition_id().alias("p")).collect()
    assert len(rows) == len({(x.l, x.r) for x in rows}) == 2 * 300 * 150 and all(x.same for x in rows)
    assert len({x.p for x in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_columnar_body_is_unpacked_once(spark, tmp_path):
    """Filters on the unpacked body must not bring its parse along, once for each time they name it."""
    bodies = ['{"a":[1,2],"b":["x","y"]}', '{"a":[1],"b":[]}', '{"a":[{"c":1}]}', '[{"a":1}]', "5", None]
    spark.createDataFrame(list(enumerate(bodies)), "id long, body string").write.parquet(f"{tmp_path}/landing")
    out = N.unpack_columnar(spark.read.parquet(f"{tmp_path}/landing"), "body", "uneven").filter("NOT uneven")
    out = out.filter(N.body_shape() != "scalar")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert {r.id: r.body for r in out.collect()} == {0: '[{"a":1,"b":"x"},{"a":2,"b":"y"}]', 2: '{"a":[{"c":1}]}', 3: '[{"a":1}]'}


def test_profile_counts_each_column_without_widening_rows(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None), (2, None, None)], "a int, b double, c string")
    got = [tuple(r) for r in P.table_profile(df).collect()]
    assert got == [(3, 0, "a", "int", 3, 2), (3, 1, "b", "double", 2, 1), (3, 2, "c", "string", 1, 1)]
    assert [r.n_rows for r in P.table_profile(df.limit(0)).collect()] == [0, 0, 0]
    assert "Expand" not in P.table_profile(df)._jdf.queryExecution().optimizedPlan().toString()
