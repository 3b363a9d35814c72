"""Near-duplicate embeddings against brute force, with measured recall."""

import collections

import numpy as np
import pytest

from civicspark.llm import embed_dedup as E
from civicspark.llm import queries

SCHEMA = "vec_id long, embedding array<double>, Kept string, vec string"


def brute(rows, limit=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for size in {len(rows[k][1]) for k in good}:
        ks = [k for k in good if len(rows[k][1]) == size]
        m = E.unit(np.array([rows[k][1] for k in ks], float))
        for a, b in zip(*np.nonzero(m @ m.T >= limit)):
            if a != b:
                links[ks[a]].add(ks[b])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        for g in group:
            out[g] = (rows[g][0], len(links[g]), least, rows[g][0] == least)
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "old", "e") for r in rows], SCHEMA).repartition(3)
    out = E.near_duplicates(df)
    assert out.columns == ["vec_id", "embedding", "vec", "n_links", "component_id", "kept"]
    return collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())


def near(rng, v, cos):
    """A vector at an exact cosine to ``v``."""
    v = v / np.linalg.norm(v)
    o = rng.normal(size=len(v))
    o -= (o @ v) * v
    return cos * v + np.sqrt(1 - cos * cos) * o / np.linalg.norm(o)


def test_groups_of_all_sizes(spark):
    rng, rows = np.random.default_rng(5), []
    for size, noise in ((300, 0.03), (300, 0.06), (40, 0.05), (17, 0.04), (5, 0.03), (2, 0.02), (1, 0)) * 2:
        c = rng.normal(size=32)
        c /= np.linalg.norm(c)
        rows += [(c + rng.normal(size=32) * noise).tolist() for _ in range(size)]
    rows += [rows[3]] * 100 + [rows[-1]] * 3  # exact copies
    rows += rng.normal(size=(400, 32)).tolist()
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    got, ref = found(spark, rows), collections.Counter(brute(rows))
    linked = lambda c: sum(r[1] * n for r, n in c.items())
    by_id, by_ref = {r[0]: r for r in got}, {r[0]: r for r in ref}
    assert all(by_id[i][1] <= by_ref[i][1] for i in by_ref)  # no link that is none
    assert linked(got) >= 0.97 * linked(ref)
    assert sum(by_id[i][2] == by_ref[i][2] for i in by_ref) >= 0.99 * len(rows)


def test_tight_groups_are_counted_exactly(spark):
    rng, rows = np.random.default_rng(6), []
    for size in (500, 60, 20, 7, 2):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        rows += [(c + rng.normal(size=64) * 0.01).tolist() for _ in range(size)]
    rows += rng.normal(size=(300, 64)).tolist()
    rows = [(3 * i + 1, v) for i, v in enumerate(rows)]
    assert found(spark, rows) == collections.Counter(brute(rows))


@pytest.mark.parametrize("cos,least", [(0.952, 0.9), (0.97, 0.95), (0.99, 0.99)])
def test_recall_of_pairs_by_cosine(spark, cos, least):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(700, 48))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, [near(rng, v, cos) for v in a]]))]
    got = found(spark, rows)
    pairs = sum(n for r, n in got.items() if r[1])
    assert pairs >= least * 1400
    assert sum(n for r, n in got.items() if not r[3]) >= least * 700


def test_shifted_vectors(spark):
    """Vectors with a strong common part: bits tell less, tables have more of them."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(400, 48)) + 1.0
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, [near(rng, v, 0.985) for v in a]]))]
    got, ref = found(spark, rows), collections.Counter(brute(rows))
    assert sum(r[1] * n for r, n in got.items()) >= 0.95 * sum(r[1] * n for r, n in ref.items())


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]),
            (12, [1e300, 1e300]), (13, [1e-300, 1e-300]), (None, None)]
    assert found(spark, rows) == collections.Counter(brute(rows))
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(spark, [(1, None), (2, [0.0])]) == collections.Counter([(1, 0, 1, True), (2, 0, 2, True)])
    assert found(spark, [(4, [1.0, 0.0]), (2, [1.0, 0.1])]) == collections.Counter([(4, 1, 2, False), (2, 1, 2, True)])


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op11_embedding_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == collections.Counter(brute(rows))
