"""Incremental load: replay adds nothing; retry queue keeps what did not succeed."""

import pytest
from pyspark.sql import functions as F

from civicspark.session import scratch_path
from civicspark.streaming import incremental as INC
from civicspark.streaming import retry_queue as RQ


CELL = "url string, topic string, municipio string, prefeitura string, ano int, mes int"


def load(spark, rows, files, per_batch=None):
    base = scratch_path(spark, "inc-test")
    frame = spark.createDataFrame(rows, "url string, status int, body string").withColumn("fetched_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    frame.repartition(files).write.parquet(f"{base}/landing")
    plan = spark.createDataFrame([("u", "t", "m", "p", 2024, 1)], CELL)
    INC.incremental_load(spark, f"{base}/landing", plan, f"{base}/table", f"{base}/_cp", per_batch)
    return base, plan, frame


@pytest.mark.parametrize("per_batch", [1, 2, None])
def test_rows_do_not_depend_on_the_files(spark, per_batch):
    rows = [("u", 200, '[{"a":%d}]' % k) for k in range(12)]
    base, plan, frame = load(spark, rows, 5, per_batch)
    assert sorted(r.a for r in INC.read_loaded(spark, f"{base}/table").collect()) == list(range(12))
    INC.incremental_load(spark, f"{base}/landing", plan, f"{base}/table", f"{base}/_cp")
    frame.write.mode("append").parquet(f"{base}/landing")  # late copies of loaded responses
    INC.incremental_load(spark, f"{base}/landing", plan, f"{base}/table", f"{base}/_cp")
    assert INC.read_loaded(spark, f"{base}/table").count() == 12


def test_a_batch_may_run_twice_and_types_may_drift(spark):
    target = scratch_path(spark, "inc-drift")
    plan = spark.createDataFrame([("u", "t", "m", "p", 2024, 1)], CELL)

    def batch(*bodies):
        return spark.createDataFrame([("u", 200, b, None) for b in bodies], INC.LANDING_SCHEMA)

    first = batch('{"a":1,"pos":7,"url":"x"}', '{"a":1,"pos":7,"url":"x"}')
    for _ in range(2):
        INC.process_batch(first, plan, target, 0)
        assert [(r.a, r.pos, r.payload_url) for r in INC.read_loaded(spark, target).collect()] == [(1, 7, "x")]
    INC.process_batch(batch('{"A":"two","b":true}', '"plain"', '{"a":[3,4],"b":[false,true]}', '{"a":[1],"b":[]}', "{"), plan, target, 1)
    rows = INC.read_loaded(spark, target).collect()
    assert sorted((r.a or "", r.b or False, r.valor or "") for r in rows) == [
        ("", False, "plain"), ("1", False, ""), ("3", False, ""), ("4", True, ""), ("two", True, "")]
    assert sorted(r.error_type for r in INC.read_errors(spark, target).collect()) == ["invalid", "uneven"]


def test_errors_of_the_load_are_kept(spark):
    base, *_ = load(spark, [("u", 500, "x"), ("u", 200, "  "), ("u", 200, "{"), ("other", 200, '{"a":1}'), ("u", None, '{"a":1}')], 1)
    assert sorted(r.error_type for r in INC.read_errors(spark, f"{base}/table").collect()) == ["empty", "error", "invalid", "unplanned"]
    assert INC.read_loaded(spark, f"{base}/table").count() == 1


def test_retry_queue_keeps_failed_and_skipped(spark):
    path = scratch_path(spark, "queue-test")
    spark.createDataFrame([("https://a/x?p=1",), ("https://a/y?p=2",), ("https://b//z?p=3",)], "url string") \
        .write.parquet(path)
    results = spark.createDataFrame([("https://a/x?p=1", 200, "[1]"), ("https://b/z?p=3", 200, "[]"),
                                     ("https://a/y?p=2", 503, "")], "url string, status int, body string")
    out = sorted(r[0] for r in RQ.rewrite_retry_queue(spark, path, results).collect())
    assert out == ["https://a/y?p=2"]
