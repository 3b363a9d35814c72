"""Periodic runs against brute force: kernel, operator, and the whole query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from civicspark.llm import periodic, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, Runs string, kept string"


def brute(x, least=24):
    out = []
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 3 * q) and not any(x[i:i + n - r] == x[i + r:i + n] for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("direct", [1, 2, 5, 12, 48])
def test_kernel(direct):
    rng, seen = random.Random(direct), 0
    for _ in range(40):
        docs = []
        for _ in range(rng.randint(1, 4)):
            x, size = [], rng.randint(0, 600)
            while len(x) < size:
                v = rng.choice([1, 2, 3, 50])
                p = [rng.randint(0, v) for _ in range(rng.randint(1, 70))]
                x += (p * 8)[:int(len(p) * rng.uniform(1, 6))]
            docs.append(x)
        for x, got in zip(docs, periodic.runs_of([np.array(x, np.int64) for x in docs], 24, direct)):
            assert got == brute(x)
            seen += len(got)
    assert seen > 50


def test_long_texts():
    rng = random.Random(3)
    period = [rng.randint(0, 9) for _ in range(9000)]
    x = [rng.randint(0, 9) for _ in range(500)] + [10] + period * 3 + period[:77] + [11] + [1, 2] * 40_000
    got, = periodic.runs_of([np.array(x, np.int64)])
    assert (501, 27077, 9000) in got and (len(x) - 80_000, 80_000, 2) in got


ROWS = [
    (1, "a b c " * 20 + "\nend", "k", "x"), (1, "a b c " * 20 + "\nend", "k", "x"), (None, "z " * 30, None, None),
    (3, None, "k", "x"), (4, "", "k", "x"), (5, "\t \n\r", "k", "x"), (6, "w x  " * 25, "k", "x"),
    (7, " ".join(f"w{i % 211}" for i in range(9000)), "k", "x"), (8, "A a " * 12 + "A\x0ba\x0cA", "k", "x"),
    (9, "same line here and there\n" * 9, "k", "x"), (10, "x " * 23, "k", "x"),
]


def test_operator(spark):
    got = sorted(((r.doc_id, r.kept, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in
                  periodic.periodic_runs(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()), key=repr)
    ref = []
    for i, t, _, k in ROWS:
        w = words(t)
        runs = brute(w) if len(w) < 1000 else [(0, 9000, 211)]
        ref.append((i, k, len(w), runs, kept(w, runs)))
    assert got == sorted(ref, key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def reference(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(kept(w, runs)))


def test_query(spark):
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(words(r.text)) <= 1500]
    ref = {reference(r.doc_id, r.text) for r in short}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert ref <= got and sum(r[1] for r in ref) > 5


def test_query_edges(spark, tmp_path):
    rows = [(i, t) for i, t, _, _ in ROWS if i != 7] + [(i, " ".join(f"v{(i * k) % 97}" for k in range(i % 40))) for i in range(100, 400)]
    spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((reference(*r) for r in rows if r[0] is not None), key=repr)


def test_null_key_is_not_planted(spark):
    docs = spark.createDataFrame([(None, "a b  c"), (None, None)], "doc_id long, text string")
    assert [r.text for r in periodic.plant_periods(docs).collect()] == ["a b  c", None]
