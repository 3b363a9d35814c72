"""Operator 11, near-duplicate embeddings by iterative quantisation.

Equal vectors are one node with a weight. Rotations for binary codes are
learnt by iterative quantisation on a sample of about ``SAMPLE`` nodes (a hash
of the vector decides; the one bounded fit), then every node is coded. All
planes pass through the origin, so a bit parts two vectors with a chance of
their angle / pi whatever the table holds. Code bits fill hash tables of
log2(nodes) / e bits, e being what a bit tells (collision entropy on the
sample, 1 if balanced); two nodes meet in a table when their bits there differ
in one place at most. The number of tables follows from the chance that a pair
at the threshold meets (``RECALL``), so both grow with the input by formula,
and buckets stay small for spread data.

* Pairs of single nodes that meet are kept when their 64-bit codes are no
  further apart than a pair at the threshold gets (four standard deviations),
  then ranked with the original vectors.
* Buckets of ``HOT`` nodes or more name their least node (by hash) a leader.
  Nodes linked to a leader of theirs join its cell (they are one component),
  in bins of their angle to it. By the triangle inequality, bins whose angles
  add up to the threshold's at most are linked without a look at any pair:
  these are counted from the histogram of bins. Other bins of a cell, and the
  nodes outside that some member meets, are compared in blocks of about
  ``BLOCK`` vectors, which return counts, not pairs. So no row stands for a
  pair inside a group, and a group is dealt over all tasks.

Links are exact (cosine in double precision); ``n_links`` counts the links
found. For a huge group whose angles are spread up to the threshold itself the
block comparisons grow with its square; tight groups are counted by bins.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and stay; vectors of different lengths do not
link; rows that repeat are linked as copies; null ids take part, a component's
id is its least id that is not null (null if none), ``kept`` says whether the
row's id equals it (null equals null); other columns come back unchanged, of
names that clash with the new ones the new ones stay; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm import graph
from civicspark.llm.common import materialize, q

LIMIT, RECALL, SAMPLE, ROUNDS = 0.95, 0.97, 8192, 30
HOT, BLOCK, BINS, CODE = 16, 256, 32, 64


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as doubles, short rows padded by 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (no row is zero)."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fold(x: np.ndarray, wide: int) -> np.ndarray:
    """Rows in ``wide`` components: short ones padded, others added up."""
    out = np.zeros((len(x), wide))
    for a in range(0, x.shape[1], wide):
        part = x[:, a:a + wide]
        out[:, :part.shape[1]] += part
    return out


class Plan:
    """Numbers that follow from the nodes, the threshold and what a bit tells."""

    def __init__(self, nodes: int, limit: float, tells: float = 1.0):
        flip = math.acos(limit) / math.pi
        self.bits = min(60, max(8, math.ceil(math.log2(max(nodes, 2)) / max(tells, 0.2))))
        meet = (1 - flip) ** self.bits + self.bits * flip * (1 - flip) ** (self.bits - 1)
        self.tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))
        self.pool = max(CODE, self.tables * self.bits)
        self.apart = math.ceil(CODE * flip + 4 * math.sqrt(CODE * flip * (1 - flip)))
        self.angle = math.acos(limit)


def learn(sample: np.ndarray, pool: int, seed: int = 11) -> np.ndarray:
    """Projections (wide x pool) whose signs are the bits: principal axes,
    then for each group of bits a random rotation that is turned, round by
    round, to bring the projections close to their signs."""
    axes = np.linalg.eigh(sample.T @ sample)[1]
    z, rng, out = sample @ axes, np.random.default_rng(seed), []
    for _ in range(-(-pool // sample.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.concatenate(out, axis=1)[:, :pool]


def telling(sample: np.ndarray, axes: np.ndarray) -> float:
    """The mean collision entropy of the bits on the sample."""
    p = (sample @ axes >= 0).mean(axis=0)
    return float(-np.log2(p * p + (1 - p) * (1 - p)).mean())


def with_codes(nodes: DataFrame, plan: Plan, axes: np.ndarray) -> DataFrame:
    """``nodes`` with a 64-bit code and the table keys."""
    weights = np.uint64(1) << np.arange(60, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = (fold(unit(matrix(b.column("vec"))), len(axes)) @ axes >= 0).astype(np.uint64)
            code = (bits[:, :CODE] << np.arange(CODE, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
            keys = np.stack([bits[:, t * plan.bits:(t + 1) * plan.bits] @ weights[:plan.bits] for t in range(plan.tables)], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * plan.tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), lists], names=[*b.schema.names, "code", "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{schema}, code long, keys array<long>")


def with_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The other columns of ``pairs`` with the cosine of two vector columns."""
    rest = [c for c in pairs.columns if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if r.num_rows:
                x, y = matrix(r.column(a)), matrix(r.column(b))
                cos = (unit(x) * unit(y)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*[r.column(c) for c in rest], pa.array(cos)], names=[*rest, "cos"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*rest).schema)
    return pairs.mapInArrow(run, f"{schema}, cos double")


def block_counts(pairs: DataFrame, limit: float) -> DataFrame:
    """(node, n, cell) of block pairs (left, right: arrays of node, w, vec;
    own: the two are one block; cell): weights linked to each node that has
    any; ``cell`` only for nodes of the left side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            sides = []
            for name in ("left", "right"):
                lists = r.column(name)
                flat = lists.flatten()
                sides.append((lists.offsets.to_numpy() - lists.offsets[0].as_py(), flat.field("node").to_numpy(), flat.field("w").to_numpy(), matrix(flat.field("vec"))))
            node, n, cell = [], [], []
            for k, (own, c) in enumerate(zip(r.column("own").to_pylist(), r.column("cell").to_pylist())):
                (a, an, aw, av), (b, bn, bw, bv) = [(i[o[k]:o[k + 1]], i, w[o[k]:o[k + 1]], v[o[k]:o[k + 1]]) for o, i, w, v in sides]
                wide = max(av.shape[1], bv.shape[1])
                linked = unit(np.pad(av, ((0, 0), (0, wide - av.shape[1])))) @ unit(np.pad(bv, ((0, 0), (0, wide - bv.shape[1])))).T >= limit
                if own:
                    np.fill_diagonal(linked, False)
                left, right = linked @ bw, linked.T @ aw
                for ids, counts, mark in ((a, left, c),) if own else ((a, left, c), (b, right, None)):
                    some = np.flatnonzero(counts)
                    node += ids[some].tolist()
                    n += counts[some].tolist()
                    cell += [mark] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(cell, pa.int64())], names=["node", "n", "cell"])

    return pairs.select("left", "right", "own", "cell").mapInArrow(run, "node long, n long, cell long")


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def blocks(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in blocks of about ``BLOCK`` with equal ``by``: (by, sub,
    block), dealt by a hash of the node."""
    per = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(per, list(by)).withColumn("sub", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / BLOCK)))
    return dealt.groupBy(*by, "sub").agg(F.collect_list(F.struct("node", "w", "vec")).alias("block"))


def probes(key: Column, bits: int) -> Column:
    """``key`` itself and with each of its 0 bits set: of two keys that differ
    in one bit, the one with the 0 reaches the other."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    free = F.filter(flips, lambda f: key.bitwiseAND(f) == 0)
    return F.concat(F.array(key), F.transform(free, lambda f: key.bitwiseOR(f)))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT) -> DataFrame:
    """``vectors`` with n_links, component_id and kept."""
    made = ("n_links", "component_id", "kept")
    rows = vectors.select(*[q(c) for c in vectors.columns if c.lower() not in made])
    good = rows.filter(usable(q(vector)))
    nodes = materialize(good.groupBy(q(vector).alias("vec")).agg(F.min(q(key)).alias("low"), F.count(F.lit(1)).alias("w")).select(
        F.monotonically_increasing_id().alias("node"), "vec", "low", "w"), "vectors")
    n = nodes.count()
    if n:
        found = _found(nodes, n, limit)
        out = rows.alias("x").join(found.alias("v"), F.col(f"x.`{vector}`") == F.col("v.vec"), "left")
        held = F.col("v.node").isNotNull()
        links, component = F.coalesce(F.col("v.n_links"), F.lit(0)), F.when(held, F.col("v.component")).otherwise(F.col(f"x.`{key}`"))
    else:
        out, links, component = rows.alias("x"), F.lit(0), F.col(f"x.`{key}`")
    return out.select("x.*", links.cast("long").alias("n_links"), component.alias("component_id"),
                      F.col(f"x.`{key}`").eqNullSafe(component).alias("kept"))


def _found(nodes: DataFrame, n: int, limit: float) -> DataFrame:
    """(node, vec, n_links, component) of all nodes."""
    share = int(min(1.0, SAMPLE / n) * (1 << 20))
    sample = nodes.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < max(share, 1)).select("vec").toArrow().column("vec").combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
    if not len(sample):
        sample = nodes.select("vec").limit(1).toArrow().column("vec").combine_chunks()
    wide = int(np.bincount(np.diff(sample.offsets.to_numpy())).argmax())
    sample = fold(unit(matrix(sample)), wide)
    plan = Plan(n, limit, telling(sample, learn(sample, CODE)))
    coded = materialize(with_codes(nodes, plan, learn(sample, plan.pool)), "codes")

    # Tables of different vector lengths are different tables.
    tabled = coded.select("node", "code", F.size("vec").alias("size"), F.posexplode("keys").alias("t", "key")).withColumn("t", F.col("size") * plan.tables + F.col("t")).drop("size")
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    hot = tabled.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m"), F.min(order).alias("first")).filter(F.col("m") >= HOT).select("t", "key", F.col("first.node").alias("cell"))
    hot = materialize(hot, "leaders")
    centres = hot.select("cell").distinct().join(coded.select(F.col("node").alias("cell"), F.col("vec").alias("centre")), "cell")
    near = tabled.join(hot, ["t", "key"]).select("node", "cell").distinct()
    near = with_cosine(near.join(coded.select("node", "vec"), "node").join(centres, "cell").select("node", "cell", "vec", "centre"), "vec", "centre")
    near = near.filter((F.col("cos") >= limit) | (F.col("node") == F.col("cell")))
    chosen = F.min(F.struct(F.when(F.col("node") == F.col("cell"), 0).otherwise(1).alias("o"), F.xxhash64("cell").alias("h"), "cell", "cos"))
    width = plan.angle / BINS
    member = near.groupBy("node").agg(chosen.alias("c")).select(
        "node", "c.cell", F.least(F.lit(BINS - 1), F.floor(F.acos(F.least(F.lit(1.0), F.col("c.cos"))) / width)).cast("int").alias("bin"))
    member = materialize(member, "cells")
    held = materialize(coded.select("node", "vec", "w").join(member, "node"), "members")

    # Inside cells: certain bins by their sums, the others in blocks.
    per = held.groupBy("cell", "bin").agg(F.sum("w").alias("sum"))
    other = per.select("cell", F.col("bin").alias("bin2"), F.col("sum").alias("sum2"))
    sure = per.join(other, "cell").filter(F.col("bin") + F.col("bin2") + 2 <= BINS).groupBy("cell", "bin").agg(F.sum("sum2").alias("sure"))
    own = F.when(2 * F.col("bin") + 2 <= BINS, F.col("w")).otherwise(0)
    inside = held.select("node", "cell", "bin", "w").join(sure, ["cell", "bin"]).select("node", (F.col("sure") - own).alias("n"))
    parts = materialize(blocks(held, "cell", "bin"), "blocks")
    a = parts.select("cell", F.struct("bin", "sub").alias("pa"), F.col("bin").alias("ba"), F.col("block").alias("left"))
    b = parts.select("cell", F.struct("bin", "sub").alias("pb"), F.col("bin").alias("bb"), F.col("block").alias("right"))
    unsure = a.join(b, "cell").filter((F.col("pa") <= F.col("pb")) & (F.col("ba") + F.col("bb") + 2 > BINS))
    within = block_counts(unsure.select("left", "right", (F.col("pa") == F.col("pb")).alias("own"), F.lit(None).cast("long").alias("cell")), limit)

    # Who meets whom.
    ask = tabled.select("t", "node", "code", F.explode(probes(F.col("key"), plan.bits)).alias("key"))
    place = member.select("node", "cell")
    single = tabled.join(place, "node", "left_anti")
    single_ask = ask.join(place, "node", "left_anti")
    x, y = single_ask.alias("x"), single.alias("y")
    close = (F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= plan.apart) & (F.col("x.node") != F.col("y.node"))
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & close).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    va, vb = coded.select(F.col("node").alias("a"), F.col("vec").alias("va"), F.col("w").alias("wa")), coded.select(F.col("node").alias("b"), F.col("vec").alias("vb"), F.col("w").alias("wb"))
    links = materialize(with_cosine(pairs.join(va, "a").join(vb, "b"), "va", "vb").filter(F.col("cos") >= limit), "links")
    single_counts = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("wb").alias("n")), F.struct(F.col("b").alias("node"), F.col("wa").alias("n")))).alias("l")).select("l.*")

    # Nodes of other cells, or of none, against cells.
    cell_in = tabled.join(place, "node").select("t", "key", F.col("cell").alias("to")).distinct()
    cell_ask = ask.join(place, "node").select("t", "key", F.col("cell").alias("to")).distinct()
    met = ask.select("t", "key", "node").join(cell_in, ["t", "key"]).select("node", "to").union(tabled.select("t", "key", "node").join(cell_ask, ["t", "key"]).select("node", "to")).distinct()
    met = met.join(place, "node", "left").filter(F.col("cell").isNull() | (F.col("cell") > F.col("to"))).select("node", F.col("to").alias("cell"))
    reach = held.groupBy("cell").agg(F.max("bin").alias("last"))
    met = with_cosine(met.join(centres, "cell").join(reach, "cell").join(coded.select("node", "vec", F.col("vec").alias("copy"), "w"), "node"), "copy", "centre")
    met = met.withColumn("far", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))).filter(F.col("far") <= plan.angle + (F.col("last") + 1) * width + 1e-9)
    met = materialize(met.select("cell", F.floor(F.col("far") / width).cast("int").alias("bin"), "node", "w", "vec"), "met")
    guests = blocks(met, "cell", "bin").select("cell", F.col("bin").alias("far"), F.col("block").alias("left"))
    hosts = parts.select("cell", "bin", F.col("block").alias("right"))
    across = guests.join(hosts, "cell").filter((F.col("far") <= F.col("bin") + BINS + 1) & (F.col("bin") <= F.col("far") + BINS + 1))
    across = materialize(block_counts(across.select("left", "right", F.lit(False).alias("own"), "cell"), limit), "across")

    counts = inside.union(within.select("node", "n")).union(single_counts).union(across.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    edges = across.filter(F.col("cell").isNotNull()).select("node", "cell").distinct().join(place.withColumnRenamed("cell", "home"), "node", "left")
    edges = links.select("a", "b").union(edges.select(F.coalesce("home", "node"), "cell"))
    labels = graph.components(edges)
    whole = nodes.join(place, "node", "left").withColumn("head", F.coalesce("cell", "node")).join(labels.withColumnRenamed("node", "head"), "head", "left").select(
        "node", "vec", "low", "w", F.coalesce("label", "head").alias("label"))
    whole = materialize(whole, "labels")
    least = whole.groupBy("label").agg(F.min("low").alias("component"))
    return whole.join(least, "label").join(counts, "node", "left").select("node", "vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component")
