"""Load per topic: own schemas, superseding runs, replay, file layout, state."""

import random

import pytest
from pyspark.sql import functions as F

from civicspark.session import scratch_path
from civicspark.sources.tables import list_tables, path_exists
from civicspark.streaming import incremental as INC
from civicspark.streaming import topic_load as TL

CELL = "url string, topic string, municipio string, prefeitura string, ano int, mes int"
PLAN = [("a1", "Group/GetAlfa", "m", "p", 2024, 1), ("a2", "Group/GetAlfa", "m", "p", 2024, 2), ("a3", "Group/GetAlfa", "n", "p", 2025, 1),
        ("b1", "Group/GetBeta", "m", "p", 2024, 1)]


def responses(spark, rows):
    """rows: (url, status, body, run)."""
    return spark.createDataFrame([(u, s, b, None, r) for u, s, b, r in rows], TL.LANDING_SCHEMA)


def loaded(spark, target, table, *columns):
    t = TL.read_topic(spark, target, table)
    return sorted((tuple(r) for r in t.select(*columns).collect()), key=repr)


class Load:
    def __init__(self, spark, files=1, per_batch=None):
        base = scratch_path(spark, "topic-test")
        self.spark, self.files, self.per_batch = spark, files, per_batch
        self.landing, self.target, self.cp = f"{base}/landing", f"{base}/t", f"{base}/cp"
        self.plan = spark.createDataFrame(PLAN, CELL)

    def land(self, rows):
        responses(self.spark, rows).repartition(self.files).write.mode("append").parquet(self.landing)
        self.run()

    def run(self):
        TL.load_by_topic(self.spark, self.landing, self.plan, self.target, self.cp, self.per_batch)


def test_same_field_of_two_topics_keeps_both_types(spark):
    load = Load(spark)
    load.land([("a1", 200, '[{"v":1},{"v":2}]', 1), ("b1", 200, '{"v":"x","row_id":9}', 1), ("b1", 404, "", 1), ("zz", 200, "[]", 1), ("a1", 200, '{"k":[1],"l":[1,2]}', 1)])
    assert TL.topic_tables(spark, load.target) == ["alfa", "beta"]
    assert dict(TL.read_topic(spark, load.target, "alfa").dtypes)["v"] == "bigint" and loaded(spark, load.target, "alfa", "v") == [(1,), (2,)]
    assert loaded(spark, load.target, "beta", "v", "payload_row_id") == [("x", 9)]
    assert sorted(r.error_type for r in TL.read_topic_errors(spark, load.target).collect()) == ["error", "uneven", "unplanned"]


def test_a_later_run_replaces_the_cell_only(spark):
    load = Load(spark)
    load.land([("a1", 200, '[{"v":1}]', 1), ("a2", 200, '[{"v":5}]', 1), ("a3", 200, '[{"v":7}]', 1)])
    ids = dict(loaded(spark, load.target, "alfa", "url", "row_id"))
    before = set(list_tables(spark, f"{TL.table_path(load.target, 'alfa')}/version=0"))
    load.land([("a1", 200, '[{"v":1},{"v":2}]', 2)])
    assert loaded(spark, load.target, "alfa", "url", "v") == [("a1", 1), ("a1", 2), ("a2", 5), ("a3", 7)]
    assert {r[1] for r in loaded(spark, load.target, "alfa", "url", "row_id") if r[0] != "a1"} == {ids["a2"], ids["a3"]}
    assert before == set(list_tables(spark, f"{TL.table_path(load.target, 'alfa')}/version=0")) == {"ano=2024", "ano=2025"}
    load.land([("a1", 200, '[{"v":9}]', 1), ("a2", 200, '[{"v":6}]', 1)])  # an older run comes late; one run adds up
    assert loaded(spark, load.target, "alfa", "url", "v") == [("a1", 1), ("a1", 2), ("a2", 5), ("a2", 6), ("a3", 7)]
    load.land([("a2", 200, "[]", 3)])  # nothing any more
    load.land([("a2", 200, '[{"v":8}]', 2)])  # and that is remembered
    assert loaded(spark, load.target, "alfa", "url", "v") == [("a1", 1), ("a1", 2), ("a3", 7)]


def test_only_touched_partitions_are_written(spark):
    load = Load(spark)
    load.land([("a1", 200, '[{"v":1}]', 1), ("a3", 200, '[{"v":7}]', 1)])
    files = lambda ano: TL.read_topic(spark, load.target, "alfa").filter(f"ano = {ano}").select(F.input_file_name()).distinct().collect()
    old = files(2024), files(2025)
    load.land([("a2", 200, '[{"v":2}]', 1)])
    assert files(2025) == old[1] and files(2024) != old[0]


def random_rows(seed):
    rng, rows = random.Random(seed), []
    for k in range(60):
        u = rng.choice(["a1", "a2", "a3", "b1"])
        rows.append((u, 200, rng.choice(['[{"v":%d}]', '{"v":%d,"w":"t"}', '[{"v":%d},{"v":0}]']) % k, rng.randint(1, 3)))
    return rows


def expected(rows):
    last = {}
    for u, _, _, r in rows:
        last[u] = max(last.get(u, 0), r)
    out = []
    for u, b, r in {(u, b, r) for u, _, b, r in rows}:
        if r == last[u]:
            out += [(u, int(x)) for x in __import__("re").findall(r'"v":(\d+)', b)]
    return sorted(out)


@pytest.mark.parametrize("seed,files,per_batch", [(1, 1, None), (1, 4, 1), (2, 3, 2)])
def test_rows_do_not_depend_on_files_order_or_replay(spark, seed, files, per_batch):
    rows, load = random_rows(seed), Load(spark, files, per_batch)
    load.land(rows[:40])
    load.land(rows[40:] + rows[:10])
    load.run()
    got = [r for t in TL.topic_tables(spark, load.target) for r in loaded(spark, load.target, t, "url", "v")]
    assert sorted(got) == expected(rows)
    ids = [r for t in TL.topic_tables(spark, load.target) for r in loaded(spark, load.target, t, "row_id")]
    assert len(set(ids)) == len(ids)


def test_types_drift_inside_one_topic(spark):
    load = Load(spark)
    load.land([("a1", 200, '[{"v":1}]', 1), ("a3", 200, '[{"v":2}]', 1)])
    load.land([("a2", 200, '[{"V":"x","w":1}]', 1)])
    assert loaded(spark, load.target, "alfa", "url", "v", "w") == [("a1", "1", None), ("a2", "x", 1), ("a3", "2", None)]
    load.land([("a3", 200, '[{"v":2.5}]', 2)])
    assert loaded(spark, load.target, "alfa", "url", "v") == [("a1", "1"), ("a2", "x"), ("a3", "2.5")]


@pytest.mark.parametrize("broken", ["rows", "swap"])
def test_a_batch_may_run_again(spark, broken, monkeypatch):
    """The batch dies after its rows are staged, or half way through the swap."""
    target = scratch_path(spark, "topic-again")
    plan = spark.createDataFrame(PLAN, CELL)
    TL.load_batch(responses(spark, [("a1", 200, '[{"v":1}]', 1), ("a3", 200, '[{"v":7}]', 1)]), plan, target, 0)
    second = responses(spark, [("a1", 200, '[{"v":2}]', 2), ("a3", 200, '[{"v":8}]', 2), ("b1", 200, '[{"v":3}]', 1)])
    real, calls = TL.swap_partitions, []

    def dies(spark_, staged, table, version, depth):
        calls.append(table)
        if broken == "swap":
            fs, p = TL._fs(spark_, f"{staged}/ano=2024")
            _, to = TL._fs(spark_, f"{table}/version={version}/ano=2024")
            fs.delete(to, True)
            fs.mkdirs(to.getParent())
            fs.rename(p, to)
        raise RuntimeError("lost")

    monkeypatch.setattr(TL, "swap_partitions", dies)
    with pytest.raises(RuntimeError):
        TL.load_batch(second, plan, target, 1)
    monkeypatch.setattr(TL, "swap_partitions", real)
    for _ in range(2):
        TL.load_batch(second, plan, target, 1)
        assert loaded(spark, target, "alfa", "url", "v") == [("a1", 2), ("a3", 8)] and loaded(spark, target, "beta", "v") == [(3,)]


def test_no_ledger_is_stored_or_read(spark):
    base = scratch_path(spark, "inc-state")
    frame = spark.createDataFrame([("a1", 200, '[{"v":1}]', None), ("a1", 200, '[{"v":2}]', None)], INC.LANDING_SCHEMA)
    plan = spark.createDataFrame(PLAN, CELL)
    for _ in range(3):
        frame.write.mode("append").parquet(f"{base}/landing")
        INC.incremental_load(spark, f"{base}/landing", plan, f"{base}/t", f"{base}/cp")
    assert INC.read_loaded(spark, f"{base}/t").count() == 2
    assert not path_exists(spark, f"{base}/t/ledger") and path_exists(spark, f"{base}/cp/state")


def test_a_response_planned_later_is_loaded_then(spark):
    load = Load(spark)
    load.plan = spark.createDataFrame(PLAN[:1], CELL)
    rows = [("a1", 200, '[{"v":1}]', 1), ("b1", 200, '[{"v":2}]', 1)]
    load.land(rows)
    load.plan = spark.createDataFrame(PLAN, CELL)
    load.land(rows)
    assert loaded(spark, load.target, "alfa", "v") == [(1,)] and loaded(spark, load.target, "beta", "v") == [(2,)]
