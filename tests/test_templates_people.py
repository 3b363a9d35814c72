"""Error templates, connected components and person resolution by brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import components as CO
from civicspark.operators import people as PE
from civicspark.operators import templates as TP


def templates(spark, rows, **options):
    df = spark.createDataFrame(rows, "error_type string, message string, logged_at string")
    return {(r.error_type, r.template): (r.n, r.n_variants, round(r.share, 4), r.first_at, r.last_at) for r in TP.error_templates(df, **options).collect()}


def test_templates_merge_in_one_position(spark):
    rows = [("E", f"Field {w} missing", t) for w, t in (("a", "3"), ("b", "1"), ("c", "2"), ("c", "9"))]
    rows += [("E", "Field a found", "5"), ("E", "code 17 at https://x/y", "4"), ("E", " code  99 at https://z ", "6"), (None, None, None), (None, " ", "7"), ("F", "Field a missing", "8")]
    got = templates(spark, rows)
    assert got == {("E", "Field <*> missing"): (4, 3, 0.5714, "1", "9"), ("E", "Field a found"): (1, 1, 0.1429, "5", "5"), ("E", "code <*> at <*>"): (2, 1, 0.2857, "4", "6"),
                   (None, ""): (2, 1, 1.0, "7", "7"), ("F", "Field a missing"): (1, 1, 1.0, "8", "8")}
    assert templates(spark, rows, min_variants=4)["E", "Field a missing"][:2] == (1, 1)
    assert templates(spark, []) == {}


def test_long_messages_are_counted_but_not_merged(spark):
    long = " ".join(["w"] * 300)
    got = templates(spark, [("E", f"{long} {x}", "1") for x in "abcd"])
    assert len(got) == 4


@pytest.mark.parametrize("seed,n,m", [(1, 60, 40), (2, 200, 190), (3, 50, 200)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + k, 1001 + k) for k in range(40)]  # a chain too
    group = {x: x for l in links for x in l if l[0] != l[1]}
    for _ in range(len(group)):
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = CO.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == group
    assert CO.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_people_against_all_pairs(spark):
    rng = random.Random(5)
    tokens = ["JOANA", "MARTIN", "MARTINS", "MARTIM", "SOUZA", "SOUSA", "ANA", "ANE", "PEREIRA", "PEREIRO", "LIMA", "A1B2C3", "A1B2C4", "SILVA", "SILVAA", "SLVA"]
    names = {" ".join(sorted(rng.choice(tokens) for _ in range(rng.randint(1, 3)))) for _ in range(220)}
    names = sorted(names)

    def linked(a, b):
        a, b = collections.Counter(a.split()), collections.Counter(b.split())
        x, y = list((a - b).elements()), list((b - a).elements())
        if len(x) != 1 or len(y) != 1 or edit(x[0], y[0]) > 1:
            return False
        long = max(x[0], y[0], key=len)
        return (len(long) >= PE.FUZZY_LETTERS if len(x[0]) != len(y[0]) else len(x[0]) >= PE.FUZZY_LETTERS) and not any(c.isdigit() for c in long)

    group = {n: n for n in names}
    for _ in names:
        for a in names:
            for b in names:
                if linked(a, b):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.name: r.person for r in PE.resolve_people(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == group and len(set(group.values())) < len(names)


def test_two_jobs_of_one_person(spark):
    rows = [("João da Silva Pereira", "A"), ("joao SILVA, Pereira", "B"), ("Joao Silva Pereyra", "C"), ("Joao Souza", "A"), (None, "A"), (None, "B"), (" - ", "C"), ("Ana Lima", "A"), ("Ane Lima", "B")]
    df = spark.createDataFrame([(n, e, 2024, 1) for n, e in rows], "name string, employer string, ano int, mes int")
    assert [tuple(r) for r in PE.multi_employment_resolved(df, "name", "employer").collect()] == [("JOAO PEREIRA SILVA", 2024, 1, 3)]
    assert PE.resolve_people(df).filter("person is null").count() == 3


def test_a_block_gives_no_more_links_than_members(spark):
    names = [f"JOAO SILV{c}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    links = PE.name_links(spark.createDataFrame([(n, n.split()) for n in names], "name string, tokens array<string>"))
    assert links.count() == len(names) - 1


def test_names_are_not_broadcast(spark, tmp_path):
    """A name is many rows in the joins, and a component table is compressed: no join may rest on a file's size."""
    spark.createDataFrame([(f"JOAO SILVA{chr(65 + k % 26)}", "A", 2024, 1) for k in range(40)], "name string, employer string, ano int, mes int").write.parquet(f"{tmp_path}/names")
    rows = spark.read.parquet(f"{tmp_path}/names")
    names = rows.select("name").distinct().select("name", F.split("name", " ").alias("tokens"))
    for df in (PE.name_links(names), PE.resolve_people(rows), PE.multi_employment_resolved(rows, "name", "employer")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
