"""Operator 9, n-gram Jaccard join by grouped prefixes.

A document's set is that of its distinct word shingles, hashed to 64 bits.
Documents with equal sets become one node. Shingles are ordered from rare to
frequent by a count sketch over all documents (a fixed number of counters, so
its size does not follow the data; it only sets the order, never a result).
Two sets can reach the threshold only if their prefixes in that order share
shingles enough. Nodes with equal prefix and size form one group, and group
pairs come from shared prefix shingles.

Links are verified on whole sets in two steps. First every bucket (a shared
shingle, or a group) gives chains and stars, as many pairs as members, and
the verified links are joined by union-find. Then the buckets that still hold
several components give all pairs between different components which pass
the size, prefix and bin filters; that step is exact. Pairs inside a component are
not enumerated, so a group of any number of near copies costs in proportion
to its size.

Defined results: documents without words, or null text, have an empty set and
their own id as component; null document ids get no say in a component's id
(a component of null ids only has null); repeated rows are rows of one node;
equal ids with different texts are different nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from civicspark.llm.common import materialize, q, small
from civicspark.llm.graph import components
from civicspark.llm.textnum import Hasher, chunks, digest, row_sets, shingles, text_bytes

SPACE = (0x20, *range(0x09, 0x0E))
SKETCH_BITS, SLICE, BINS = 22, 4096, 128


def _sets(batches: Iterator[pa.RecordBatch], column: int, size: int, hasher: Hasher | None = None):
    """For each batch its row ranges with their distinct shingle hashes."""
    hasher = hasher or Hasher(SPACE)
    for b in batches:
        raw, off = text_bytes(b.column(column))
        for lo, hi in chunks(off):
            words, rows = hasher.words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            yield b, lo, hi, *shingles(words, rows, size)


def sketch(texts: DataFrame, size: int, bits: int = SKETCH_BITS, sets=_sets) -> bytes:
    """For each of 2^bits hash slots the logarithm of its shingle count.
    ``sets``: as :func:`_sets`, for shingles of another kind."""
    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for _, _, _, h, _ in sets(batches, 0, size):
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = total.reshape(-1, SLICE)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([_narrow(parts[k]) for k in full], pa.binary())], names=["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(c, f"<u{len(c) // SLICE}").astype(np.int64)
        logs = [(8 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(logs, pa.binary())], names=["slice", "logs"])

    out = bytearray(1 << bits)
    summed = texts.mapInArrow(count, "slice long, counts binary").repartition(F.col("slice")).mapInArrow(add, "slice long, logs binary")
    for r in summed.collect():  # 2^bits bytes, whatever the data
        out[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = r["logs"]
    return bytes(out)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype("<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u8").tobytes()


def shingle_sets(docs: DataFrame, size: int, threshold: int, order: bytes, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, mark, n, node, prefix, bins): the text's digest, set size, 16-byte digest of the set,
    the prefix as a sorted array, and the set's members counted by bin. ``threshold``: per cent."""
    table = docs.sparkSession.sparkContext.broadcast(order)
    schema = T.StructType([docs.schema[0], T.StructField("mark", T.StringType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
                           T.StructField("bins", T.ArrayType(T.ShortType()))])

    def read(batches):
        weight = np.frombuffer(table.value, np.uint8)
        for b, lo, hi, h, rows in _sets(batches, 1, size):
            n, node, prefix, bins = [], [], [], []
            for s in row_sets(h, rows):
                key = (weight[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                k = len(s) - -(-threshold * len(s) // 100) + 1 if len(s) else 0
                n.append(len(s))
                node.append(digest(s))
                bins.append(np.minimum(np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS), 32767).astype(np.int16))
                prefix.append(np.sort(np.partition(key, k - 1)[:k]).view(np.int64) if k else np.zeros(0, np.int64))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * BINS), pa.array(np.concatenate(bins)))],
                                             names=["doc_id", "mark", "n", "node", "prefix", "bins"])

    return docs.select("doc_id", "text", _mark(F.col("text"))).mapInArrow(read, schema)


def least_shared(n1: Column, n2: Column, threshold: int) -> Column:
    """The fewest common members of sets that reach the threshold."""
    return F.ceil(F.lit(threshold) * (n1 + n2) / F.lit(100 + threshold)).cast("long")


def prefix_rest(n: Column, threshold: int) -> Column:
    """Members of a set after its prefix. Two sets share at most the shared
    members of their prefixes plus the rest of one of them: that whose prefix
    ends first, hence for certain no more than the larger set's rest."""
    return F.ceil(F.lit(threshold) * n / F.lit(100)).cast("long") - 1


def within_reach(x: Column, y: Column, n: Column, m: Column, threshold: int) -> Column:
    """False only for sets that cannot reach the threshold: what their bins
    differ by is in one of them alone, and of that there may be no more than
    their sizes leave beside the fewest common members."""
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda total, d: total + d)
    return apart <= n + m - 2 * least_shared(n, m, threshold)


class Verifier:
    """Checks pairs of nodes on whole sets, made again from the texts of the
    documents that stand for them."""

    def __init__(self, docs: DataFrame, stand: DataFrame, size: int, threshold: int, repeated: bool):
        self.docs, self.stand, self.size, self.threshold, self.repeated = docs, stand, size, threshold, repeated

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, members): sorted 64-bit hashes as bytes."""
        size = self.size

        def read(batches):
            hasher = Hasher(SPACE)
            for b in batches:
                for b, lo, hi, h, rows in _sets([b], 1, size, hasher):
                    sets = list(row_sets(h, rows))
                    want = b.column(0).slice(lo, hi - lo).to_pylist()
                    keep = [(w, s.tobytes()) for w, s in zip(want, sets) if digest(s) == w]
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.binary()), pa.array([k[1] for k in keep], pa.binary())], names=["node", "members"])

        want = small(materialize(self.stand.join(small(nodes, 40), "node", "left_semi"), "wanted"), 128)
        # the one text that stands for the node; rows equal in id and text are one
        rows = self.docs.join(want, self.docs["doc_id"].eqNullSafe(want["stand"]) & (_mark(self.docs["text"]) == want["stand_mark"])).select("node", "text")
        rows = rows.dropDuplicates(["node"]) if self.repeated else rows
        return materialize(rows.mapInArrow(read, "node binary, members binary"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` that reach the threshold."""
        threshold = self.threshold

        def check(batches):
            for b in batches:
                good = []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([x, y]))
                    shared = int((both[1:] == both[:-1]).sum())
                    good.append(100 * shared >= threshold * (len(both) - shared))
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        x, y = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary"), "verified")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, threshold: int = 90) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes): (doc_id, mark, n, node) of every row, written, and
    (node, label) of the nodes that have links."""
    docs = docs.select(q(doc_id).alias("doc_id"), q(text).alias("text"))
    order = sketch(docs.select("text"), size)
    sets = materialize(shingle_sets(docs, size, threshold, order), "shingle-sets")
    full = sets.filter("n > 0")
    nodes = full.groupBy("node", "n").agg(F.min(F.struct(F.coalesce(F.col("doc_id").isNull(), F.lit(False)).alias("none"), F.col("doc_id").alias("stand"), F.col("mark").alias("stand_mark"), "prefix", "bins")).alias("s"))
    nodes = nodes.select("node", "n", "s.stand", "s.stand_mark", "s.prefix", "s.bins")
    nodes = materialize(nodes.withColumn("grp", F.min("node").over(Window.partitionBy("n", "prefix"))), "nodes")
    repeated = not full.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty()
    verify = Verifier(docs, nodes.select("node", "stand", "stand_mark"), size, threshold, repeated)

    rep = nodes.filter(F.col("node") == F.col("grp")).select("n", "grp", F.posexplode("prefix").alias("place", "token"))
    by_token = Window.partitionBy("token")
    tokens = materialize(rep.withColumn("df", F.count(F.lit(1)).over(by_token)).filter("df > 1").select("token", "place", "n", "grp"), "tokens")
    # the member with the most shared shingles is tried against all others of its bucket
    weight = small(tokens.groupBy("grp").agg(F.count(F.lit(1)).alias("weight")), 32)
    by_weight = by_token.orderBy(F.desc("weight"), "n", "grp")
    stars = tokens.join(weight, "grp").select("token", "n", "grp", F.first("grp").over(by_weight).alias("star"), F.first("n").over(by_weight).alias("star_n"),
                                              F.lag("grp").over(by_weight).alias("before"), F.lag("n").over(by_weight).alias("before_n"))
    near = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)
    tries = stars.filter("before is not null").select("grp", "n", F.explode(F.array_distinct(F.array(
        F.struct(F.col("star").alias("g"), F.col("star_n").alias("m")), F.struct(F.col("before").alias("g"), F.col("before_n").alias("m"))))).alias("o"))
    tries = tries.filter(near(F.col("n"), F.col("o.m"))).groupBy(F.col("o.g").alias("a"), F.col("grp").alias("b"), "n", F.col("o.m").alias("m")).agg(F.count(F.lit(1)).alias("shared"))
    first = tries.filter(F.col("shared") + prefix_rest(F.greatest("n", "m"), threshold) >= least_shared(F.col("n"), F.col("m"), threshold)).select("a", "b")
    by_group = Window.partitionBy("grp").orderBy("node")
    inside = nodes.select("grp", "node", F.lag("node").over(by_group).alias("before")).filter("before is not null")
    inside = inside.select(F.explode(F.array_distinct(F.array("grp", "before"))).alias("a"), F.col("node").alias("b"))
    links = verify.links(first.unionByName(inside).distinct())
    labels = components(links)

    seen = materialize(nodes.join(small(labels, 40), "node", "left").select("node", "n", "grp", "bins", F.coalesce("label", "node").alias("label")), "labelled")
    rest = _between_groups(tokens, seen, nodes.filter(F.col("node") == F.col("grp")).select("grp", "prefix"), threshold, near).unionByName(_inside_groups(seen, threshold)).distinct()
    more = verify.links(rest)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return sets.select("doc_id", "mark", "n", "node"), labels


def _between_groups(tokens: DataFrame, seen: DataFrame, prefixes: DataFrame, threshold: int, near) -> DataFrame:
    """Pairs of nodes of different components whose groups' prefixes share
    enough. Buckets whose groups all lie in one component are left out.

    Of two sets that must share ``k`` members, the first ``n - k + 1`` of one
    and the first ``m - k + 1`` of the other meet; for the smaller of the two
    that is a shorter prefix than for a set of which only its size is known.
    Pairs that meet there are then held against whole prefixes."""
    parts = seen.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    rows = materialize(tokens.join(parts, "grp").select("token", "place", "n", "grp", "low", "high"), "token-labels")
    mixed = rows.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("token")
    open_rows = rows.join(mixed, "token", "left_semi")
    x, y = open_rows.filter(F.col("place") <= F.col("n") - least_shared(F.col("n"), F.col("n"), threshold)).alias("x"), open_rows.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    k = least_shared(n, m, threshold)
    differ = (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high")) | (F.col("x.low") != F.col("y.low"))
    later = (n < m) | ((n == m) & (F.col("x.grp") < F.col("y.grp")))
    meet = (F.col("x.place") <= n - k) & (F.col("y.place") <= m - k)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & later & differ & near(n, m) & meet)
    pairs = materialize(pairs.select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b"), n.alias("n"), m.alias("m")).distinct(), "group-pairs")
    for side in ("a", "b"):
        pairs = pairs.join(prefixes.select(F.col("grp").alias(side), F.col("prefix").alias(f"{side}_prefix")), side)
    shared = F.size(F.array_intersect("a_prefix", "b_prefix"))
    good = pairs.filter(shared + prefix_rest(F.greatest("n", "m"), threshold) >= least_shared(F.col("n"), F.col("m"), threshold)).select("a", "b")
    a, b = seen.select(F.col("grp").alias("a"), F.col("node").alias("na"), F.col("label").alias("la"), F.col("n").alias("n"), F.col("bins").alias("a_bins")), seen.select(F.col("grp").alias("b"), F.col("node").alias("nb"), F.col("label").alias("lb"), F.col("n").alias("m"), F.col("bins").alias("b_bins"))
    return good.join(a, "a").join(b, "b").filter((F.col("la") != F.col("lb")) & within_reach(F.col("a_bins"), F.col("b_bins"), F.col("n"), F.col("m"), threshold)).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def _inside_groups(seen: DataFrame, threshold: int) -> DataFrame:
    """Pairs of nodes of one group and different components."""
    mixed = seen.groupBy("grp").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("grp")
    open_rows = seen.join(mixed, "grp", "left_semi")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    return x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
                  & within_reach(F.col("x.bins"), F.col("y.bins"), F.col("x.n"), F.col("y.n"), threshold)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, threshold: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows, labels = jaccard_components(docs, doc_id, text, size, threshold)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("d"))
    named = least.join(small(labels, 40), "node", "left").select("node", "d", F.coalesce("label", "node").alias("label"))
    ids = named.join(named.groupBy("label").agg(F.min("d").alias("component_id")), "label").select(F.col("node").alias("of"), "component_id")
    joined = rows.join(ids, rows["node"] == ids["of"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (null
    last). Rows without words all stay; of repeated rows one stays."""
    rows, labels = jaccard_components(docs, doc_id, text, size, threshold)
    keys = rows.filter("n > 0").groupBy("doc_id", "mark", "node").agg(F.count(F.lit(1)).alias("copies"))
    keys = materialize(keys.join(small(labels, 40), "node", "left").select(F.coalesce("label", "node").alias("label"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("key"), "copies"), "keys")
    chosen = keys.groupBy("label").agg(F.min("key").alias("chosen"))
    lost = keys.join(chosen, "label").filter(F.col("key") != F.col("chosen")).select(F.col("key.doc_id").alias("__lost_id"), F.col("key.mark").alias("__lost_mark"))
    kept = docs.join(small(materialize(lost, "lost"), 80), q(doc_id).eqNullSafe(F.col("__lost_id")) & (_mark(q(text)) == F.col("__lost_mark")), "left_anti")
    again = materialize(keys.filter("copies > 1").select(F.col("key.doc_id").alias("__again_id"), F.col("key.mark").alias("__again_mark")), "repeated")
    if again.isEmpty():
        return kept
    # rows equal in id and text, but for those without words: one of each stays, chosen map side
    columns = kept.columns
    told = kept.join(small(again, 80), q(doc_id).eqNullSafe(F.col("__again_id")) & (_mark(q(text)) == F.col("__again_mark")), "left")
    told = materialize(told, "told")
    single = told.filter("__again_mark is null").select(*[q(c) for c in columns])
    first = told.filter("__again_mark is not null").groupBy("__again_id", "__again_mark").agg(F.first(F.struct(*[q(c) for c in columns])).alias("__row"))
    return single.unionByName(first.select(*[F.col("__row")[c].alias(c) for c in columns]))


def _mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))
