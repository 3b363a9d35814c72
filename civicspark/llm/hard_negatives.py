"""Operator 12, hard-negative mining by Kronecker-packed products.

Components become integers floor(``SCALE`` x). The candidates of a block are
biased to be non-negative and the i-th components of all of them are packed
into the fields of one wide integer, so an anchor's i-th component multiplies
them all at once; the sum of an anchor's products holds every score in its own
field, exactly, as fields are as wide as the largest possible sum.

Anchors (a stated query set) meet all rows in blocks: rows are dealt into
blocks by a hash of their own number, whatever their id, label or value, and
each pair of an anchor block and a row block is one group of bounded size.
A first pass keeps each block's best rows of the anchor's label, a second one
each block's best rows of other labels in the score range of each positive;
a ranking over these few rows follows. Work is anchors times rows, as the exact
result demands; the shuffle carries a vector once for every ``ANCHORS``
anchors or ``ROWS`` rows.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; of vectors of different lengths the missing components
count as 0; null ids are no anchors, come last in ties and may be returned;
rows that repeat are rows of their own (an anchor's copy may be its positive,
ties between equal ids go by row number); products of components
of any size are exact, a score beyond a long counts as the nearest long; an empty table, or one
without anchors, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import materialize, q

SCALE, ROWS, ANCHORS = 256, 4096, 8192
MOST = (1 << 63) - 1


def integers(column: pa.ChunkedArray) -> np.ndarray:
    """floor(SCALE x) of a list column, short rows padded by 0; Python's
    integers where 64 bits could overflow."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(rows.offsets.to_numpy())
    wide = int(size.max(initial=0))
    if not np.all(np.abs(flat) < 1 << 40):
        flat = np.array([int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(SCALE * x) for x in flat.tolist()], object)
    else:
        flat = np.floor(SCALE * flat).astype(np.int64)
    out = np.zeros((len(rows), wide), flat.dtype)
    out[np.arange(wide) < size[:, None]] = flat
    return out


class Packed:
    """Candidates (rows of ``values``) packed for anchors ``many``."""

    def __init__(self, values: np.ndarray, many: np.ndarray):
        self.count, wide = values.shape[0], max(values.shape[1], many.shape[1])
        values, self.anchors = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (values, many))
        self.up_c, self.up_a = (-min(0, int(x.min(initial=0))) for x in (values, self.anchors))
        top = wide * (int(values.max(initial=0)) + self.up_c) * (int(self.anchors.max(initial=0)) + self.up_a)
        self.bytes = 4 if top < 1 << 32 else 8 if top < 1 << 62 else (top.bit_length() + 7) // 8
        small = self.bytes <= 8
        values = values.astype(np.int64 if small else object)
        self.base = self.up_a * values.sum(axis=1) + wide * self.up_a * self.up_c
        biased = values.T + self.up_c
        if small:
            self.wide = [int.from_bytes(c.astype(f"<u{self.bytes}").tobytes(), "little") for c in biased]
        else:
            self.wide = [int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in c), "little") for c in biased]

    def scores(self, at: int) -> np.ndarray:
        """Exact inner products of anchor ``at`` with all candidates."""
        own, total = self.anchors[at].tolist(), 0
        for x, packed in zip(own, self.wide):
            total += (x + self.up_a) * packed
        raw = total.to_bytes(self.count * self.bytes, "little")
        if self.bytes <= 8:
            fields = np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64)
        else:
            fields = np.array([int.from_bytes(raw[k:k + self.bytes], "little") for k in range(0, len(raw), self.bytes)], object)
        return fields - self.base - self.up_c * sum(own)


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, equal ones in order of place."""
    if len(scores) > most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:most]


def clip(score) -> int:
    return max(-MOST - 1, min(MOST, int(score)))


def in_id_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table.select(["vec_id", "row"]), sort_keys=[("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor (``key`` divisible by ``every``) and each
    of its ``positives`` best other rows of its label, the ``negatives`` best
    rows of other labels of ``low`` to ``high`` % of the positive's score."""
    vec = q(vector)
    rows = vectors.filter(q(label).isNotNull() & usable(vec)).select(
        F.monotonically_increasing_id().alias("row"), q(key).cast("long").alias("vec_id"), q(label).alias("label"), vec.alias("vec"))
    rows = materialize(rows, "negatives")
    chosen = rows.filter(F.col("vec_id") % every == 0)
    n, m = rows.count(), chosen.count()
    stripes, groups = max(1, -(-n // ROWS)), max(1, -(-m // ANCHORS))
    r, c = (F.pmod(F.xxhash64("row"), F.lit(k)).cast("int") for k in (stripes, groups))
    pool = rows.withColumn("r", r).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def against(anchors: DataFrame, kernel, schema: str) -> DataFrame:
        a = anchors.withColumn("c", c).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        return a.groupBy("r", "c").cogroup(pool.groupBy("r", "c")).applyInArrow(kernel, schema)

    def alike(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and block.num_rows:
            block = in_id_order(block)
            ids, row, kind = (block.column(x).to_pylist() for x in ("vec_id", "row", "label"))
            values, many = integers(block.column("vec")), integers(anchors.column("vec"))
            places: dict = {}
            for k, x in enumerate(kind):
                places.setdefault(x, []).append(k)
            queue: dict = {}
            for k, x in enumerate(anchors.column("label").to_pylist()):
                queue.setdefault(x, []).append(k)
            own = anchors.column("row").to_pylist()
            for x, ks in queue.items():
                at = np.array(places.get(x, []), np.int64)
                packed = Packed(values[at], many[ks]) if len(at) else None
                for j, k in enumerate(ks if packed else []):
                    s = packed.scores(j)
                    for b in best(s, positives + 1):
                        if row[at[b]] != own[k]:
                            out.append((own[k], clip(s[b]), ids[at[b]], row[at[b]]))
        return table_of(out, ("arow", "positive_score", "positive_id", "prow"))

    def unlike(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and block.num_rows:
            block = in_id_order(block)
            ids, row = (block.column(x).to_pylist() for x in ("vec_id", "row"))
            codes: dict = {}
            kind = np.array([codes.setdefault(x, len(codes)) for x in block.column("label").to_pylist()])
            packed = Packed(integers(block.column("vec")), integers(anchors.column("vec")))
            own, aid, alabel, wanted = (anchors.column(x).to_pylist() for x in ("row", "vec_id", "label", "positives"))
            for k, ps in enumerate(wanted):
                spans = [(p, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in ps]
                spans = [x for x in spans if x[1] <= x[2]]
                if not spans:
                    continue
                s = packed.scores(k)
                at = np.flatnonzero((s >= min(x[1] for x in spans)) & (s <= max(x[2] for x in spans)) & (kind != codes.get(alabel[k], -1)))
                at = at[np.argsort(-s[at], kind="stable")]
                for p, lo, hi in spans:
                    for b in at[(s[at] >= lo) & (s[at] <= hi)][:negatives]:
                        out.append((own[k], aid[k], p["prow"], p["positive_id"], p["positive_score"], ids[b], clip(s[b]), row[b]))
        return table_of(out, ("arow", "anchor_id", "prow", "positive_id", "positive_score", "negative_id", "negative_score", "nrow"))

    top = Window.partitionBy("arow").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "prow")
    first = against(chosen, alike, "arow long, positive_score long, positive_id long, prow long")
    first = first.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= positives)
    first = first.groupBy("arow").agg(F.collect_list(F.struct("positive_score", "positive_id", "prow")).alias("positives"))
    with_positives = materialize(chosen.join(first, chosen["row"] == first["arow"]).drop("arow"), "anchors")
    found = against(with_positives, unlike, "arow long, anchor_id long, prow long, positive_id long, positive_score long, negative_id long, negative_score long, nrow long")
    order = Window.partitionBy("arow", "prow").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "nrow")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def table_of(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, columns)})
