"""Operator 2, fuzzy line dedup by MinHash.

A line's set is that of its ``SHINGLE``-character shingles after white space
is turned into single spaces (shorter lines: the line itself). Signatures
come from one hash of each shingle: its high bits choose one of
``BANDS * ROWS`` bins, the bin keeps its least value, and empty bins borrow
from the next filled one. Lines that agree in a whole band are candidates; at
a similarity of 0.8 a pair meets in some band with a chance of 0.995.

Equal lines are one node, told by a 16-byte digest, so a line that a third of
all documents hold is counted per task before the shuffle. Candidates are
linked in two steps, as many pairs as bucket members first (star and chain).
Lines of buckets that still hold several components, which get ``BANDS`` more
bands each, are then compared in blocks: a task holds the lines of a bucket, or
a cell of ``CELL`` by ``CELL`` of a larger one, as parities of their shingles in
``BITS`` bins, and pairs become rows only if the parities that differ leave the
threshold in reach. What differs there is in one of the sets alone, so no pair
that reaches it is left out, and rows are as many as bucket members, not pairs.
Each pair is verified by exact Jaccard on the lines' shingles. Union-find joins
the links, and of each component the line at the first place (document id, line
number) stays.

Defined results: lines without other characters than white space are never
dropped, nor are they compared; null text has no lines; rows with equal
document ids keep their lines by line number, rows with null ids come last;
repeated rows: the line stays in one of them, the first row by text digest
and, where whole rows are equal, in all of them, since they have one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from civicspark.llm.common import fresh, materialize, q, small
from civicspark.llm.graph import components
from civicspark.llm.textnum import mix, row_sets

SHINGLE, BANDS, ROWS, THRESHOLD, SEEN, CHUNK = 7, 10, 4, 80, 200_000, 1 << 17
BITS, CELL, AT_ONCE = 2048, 1024, 1 << 14


def _hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines on end, and the lines' offsets."""
    code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    code += np.uint64(1)
    code = np.concatenate([code, np.zeros(size, np.uint64)])
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(length)
    begin = end - length
    rows = np.concatenate([[0], np.cumsum(np.maximum(length - size + 1, 1))])
    base = np.uint64(0x9E3779B97F4A7C15)
    every = np.zeros(len(code) - size, np.uint64)
    for k in range(size):
        every *= base
        every += code[k:k + len(every)]
    starts = np.ones(len(every), bool)
    for k in range(1, size):  # no whole shingle starts so near to the end of its line
        starts[end[length > k] - k] = False
    h = every[starts]
    short = np.flatnonzero(length < size)
    part = np.zeros(len(short), np.uint64)
    for k in range(size):
        part = part * base + np.where(k < length[short], code[begin[short] + k], np.uint64(0))
    h[rows[short]] = part
    return mix(h), rows


def signatures(h: np.ndarray, rows: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` least values for each line."""
    n = len(rows) - 1
    line = np.repeat(np.arange(n), np.diff(rows))
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, line * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64), h)
    out = out.reshape(n, bins)
    empty = out == np.iinfo(np.uint64).max
    step = 0
    while empty.any() and step < bins:  # borrow from the next bin, one step more each time
        step += 1
        out = np.where(empty, np.roll(out, -1, axis=1) + np.uint64(0x632BE59BD9B4E019) * (~np.roll(empty, -1, axis=1)), out)
        empty &= np.roll(empty, -1, axis=1)
    return out


def band_keys(h: np.ndarray, at: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    """One row of the keys of bands ``first``, ``first + 1``, ... for each line."""
    sig = signatures(h, at, bands * rows).reshape(len(at) - 1, bands, rows)
    key = np.broadcast_to(np.arange(first, first + bands, dtype=np.uint64), (len(at) - 1, bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
    return key


def split_lines(text: str) -> Iterator[tuple[int, str]]:
    """Number and normal form of each line that has a character."""
    for k, line in enumerate(text.split("\n")):
        # of white space, only the space is printable
        said = line.strip() if line.isprintable() and "  " not in line else " ".join(line.split())
        if said:
            yield k, said


def _digest(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def line_table(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, mark, line, node, head, bands) of every line, from (doc_id,
    mark, text); head: half of the digest, which will do for candidates. A task gives the bands of a line it has seen before only now and
    then, so a line that many documents hold has few band rows."""
    schema = T.StructType([*docs.schema[:2], T.StructField("line", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("head", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def made(b, owner, number, said):
            nodes, new = [_digest(s) for s in said], []
            if len(seen) > SEEN:
                seen.clear()
            for k, n in enumerate(nodes):
                if n not in seen:
                    seen.add(n)
                    new.append(k)
            fresh_rows = np.zeros(len(nodes), bool)
            fresh_rows[new] = True
            h, at = _hashes([said[k] for k in new], shingle)
            key = band_keys(h, at, bands, rows)
            ends = np.concatenate([[0], np.cumsum(fresh_rows * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.reshape(-1).view(np.int64)))
            take = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(number, pa.int64()), pa.array(nodes, pa.binary()),
                                               pa.array(np.frombuffer(b"".join(nodes), np.int64)[::2].copy()), lists], names=["doc_id", "mark", "line", "node", "head", "bands"])

        for b in batches:
            owner, number, said, held = [], [], [], 0
            for row, text in enumerate(b.column(2).to_pylist()):
                for k, s in split_lines(text or ""):
                    owner.append(row)
                    number.append(k)
                    said.append(s)
                    held += len(s)
                    if held > CHUNK:
                        yield made(b, owner, number, said)
                        owner, number, said, held = [], [], [], 0
            if said:
                yield made(b, owner, number, said)

    return docs.mapInArrow(read, schema)


def line_texts(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, head, said) of the lines ``named`` (node, first), read again at their first places."""
    want = named.groupBy(F.col("first.doc_id").alias("of"), F.col("first.mark").alias("of_mark")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "node")).alias("lines"))
    want = materialize(want, "wanted")
    size = want.agg(F.sum(F.size("lines") * 48 + 64)).first()[0] or 0  # a row holds all wanted lines of a document
    want = F.broadcast(want) if size <= 32 << 20 else want
    rows = docs.join(want, docs["doc_id"].eqNullSafe(want["of"]) & (docs["mark"] == want["of_mark"])).select("text", F.col("lines.line").alias("line"), F.col("lines.node").alias("node"))

    def read(batches):
        for b in batches:
            out = {}
            for text, line, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                said = dict(split_lines(text))
                out.update((n, said[k]) for k, n in zip(line, node))
            heads = pa.array(np.frombuffer(b"".join(out), np.int64)[::2].copy())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), heads, pa.array(list(out.values()), pa.string())], names=["node", "head", "said"])

    return materialize(rows.mapInArrow(read, "node binary, head long, said string").dropDuplicates(["node"]), "lines")


def _line_sets(batches: Iterator[pa.RecordBatch], column: int, shingle: int):
    """As ``_sets`` of operator 9, for the shingles of whole lines."""
    for b in batches:
        held = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:  # about 4 MB of lines together
            hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + (4 << 20), "right")))
            yield b, lo, hi, *_hashes(b.column(column).slice(lo, hi - lo).to_pylist(), shingle)
            lo = hi


def line_shapes(said: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(head, mine, n, odd, keys, bands) of each line of ``said`` (head, mine,
    said): the set's size, the parities of its members in ``BITS`` bins, the
    keys of its bands and then of as many by another hash, and the latter as an
    array."""
    def read(batches):
        for b, lo, hi, h, at in _line_sets(batches, 2, shingle):
            sets = list(row_sets(h, at))
            odd = [np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes() for s in sets]
            key = band_keys(mix(h ^ np.uint64(0x632BE59BD9B4E019)), at, bands, rows, bands)
            keys = [k.tobytes() for k in np.concatenate([band_keys(h, at, bands, rows), key], axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
            own = [c.slice(lo, hi - lo) for c in b.columns[:2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(odd, pa.binary()), pa.array(keys, pa.binary()), lists], names=["head", "mine", "n", "odd", "keys", "bands"])

    return materialize(said.select("head", "mine", "said").mapInArrow(read, "head long, mine long, n long, odd binary, keys binary, bands array<long>"), "line-shapes")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells, from rows in the order of their cells (the first three columns)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            cell = np.column_stack([c.to_numpy() for c in b.columns[:3]])
            before = [[c[-1].as_py() for c in held[-1].columns[:3]]] if held else cell[:1]
            new = np.flatnonzero((cell != np.concatenate([before, cell[:-1]])).any(axis=1))
            if len(new):
                if held or new[-1]:
                    yield pa.Table.from_batches([*held, b.slice(0, new[-1])])
                held, b = [], b.slice(new[-1])
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """(g, h): heads, in order, of the pairs of a bucket's lines of different
    labels that may reach the threshold, each from the first bucket that both
    are in. ``members``: (band, c, head, mine, n, odd, keys), ``c`` the lines of
    the bucket, ``mine`` the label's 64-bit hash, ``keys`` the line's buckets."""
    stripes = F.ceil(F.col("c") / CELL)
    dealt = members.withColumn("own", F.pmod(F.xxhash64("head"), stripes)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), stripes - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "head", "mine", "n", "odd", "keys")
    dealt = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def compare(batches):
        for t in _cells(batches):
            band, low, high, own, head, mine, n = (t.column(k).to_numpy() for k in range(7))
            odd, keys = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint64).reshape(t.num_rows, -1) for k in (7, 8))
            new = (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if low[lo] == high[lo]:
                    x, y = np.triu_indices(hi - lo, 1)
                else:  # pairs of two stripes; those of one have a cell of their own
                    mask = own[lo:hi] == low[lo]
                    x, y = (k.reshape(-1) for k in np.meshgrid(np.flatnonzero(mask), np.flatnonzero(~mask)))
                x, y = x + lo, y + lo
                near = (mine[x] != mine[y]) & (100 * np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]))
                x, y = x[near], y[near]
                apart = n[x] + n[y] + 2 * (-threshold * (n[x] + n[y]) // (100 + threshold))  # the sizes less twice the fewest common members
                for k in range(0, len(x), AT_ONCE):
                    i, j = x[k:k + AT_ONCE], y[k:k + AT_ONCE]
                    good = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= apart[k:k + AT_ONCE]
                    i, j = i[good], j[good]
                    here = keys[i, (keys[i] == keys[j]).argmax(axis=1)].view(np.int64) == band[lo]
                    if here.any():
                        g, h = head[i[here]], head[j[here]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g, h)), pa.array(np.maximum(g, h))], names=["g", "h"])

    return dealt.mapInArrow(compare, "g long, h long")


def verified(pairs: DataFrame, said: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The nodes (a, b) of the pairs (g, h) of heads whose lines reach the
    threshold. ``said``: (node, head, said) of their lines."""
    def check(batches):
        for b in batches:
            good: list[bool] = []
            held = np.cumsum(pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))).to_numpy(zero_copy_only=False))
            while (lo := len(good)) < b.num_rows:  # about 4 MB of lines together
                hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + (4 << 20), "right")))
                said = pa.concat_arrays([b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo)]).dictionary_encode()
                h, at = _hashes(said.dictionary.to_pylist(), shingle)
                sets = list(row_sets(h, at))
                which = said.indices.to_pylist()
                for x, y in zip(which[:hi - lo], which[hi - lo:]):
                    x, y = sets[x], sets[y]
                    shared = 0
                    if 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                        both = np.concatenate([x, y])
                        both.sort()
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    good.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    x, y = (said.select(F.col("head").alias(head), F.col("node").alias(node), F.col("said").alias(text)) for head, node, text in (("g", "a", "x"), ("h", "b", "y")))
    return materialize(pairs.join(x, "g").join(y, "h").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary"), "verified")


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) of the components after the links ``more`` (a, b) are
    added: the old components are the nodes of the union-find, not the lines."""
    of = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left")
    of = materialize(of.select("node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("new")), "line-ends")
    x, y = of.select(F.col("node").alias("a"), F.col("label").alias("x")), of.select(F.col("node").alias("b"), F.col("label").alias("y"))
    joined = components(more.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("now"))
    alone = of.filter("new").select("node", "label")  # linked now for the first time
    return materialize(labels.unionByName(alone).join(small(joined, 40), "label", "left").select("node", F.coalesce("now", "label").alias("label")), "components")


def lost_lines(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, mark, lost): the numbers of the lines that go, for documents
    that lose some. ``docs``: (doc_id, mark, text)."""
    lines = materialize(line_table(docs, shingle, bands, rows), "line-table")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line")
    places = materialize(lines.groupBy("node").agg(F.min("head").alias("head"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-places")

    order = Window.partitionBy("band").orderBy("head")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keys = lines.select("head", F.explode("bands").alias("band"))
    buckets = keys.select("band", "head", F.min("head").over(whole).alias("star"), F.lag("head").over(order).alias("before"), F.max("head").over(whole).alias("last"))
    buckets = materialize(buckets.filter("star <> last and (before is null or before <> head)"), "line-buckets")
    named = materialize(places.select("head", "node", "first").join(small(buckets.select("head").distinct(), 24), "head", "left_semi"), "line-names")
    first = materialize(buckets.filter("before is not null").select(F.explode(F.array_distinct(F.array("star", "before"))).alias("g"), F.col("head").alias("h")).distinct(), "line-pairs")
    said = line_texts(named, docs)  # every line of a bucket is in a pair
    links = verified(first, said, shingle, threshold)
    labels = components(links)

    with_label = named.join(small(labels, 40), "node", "left").select("head", "node", F.xxhash64(F.coalesce("label", "node")).alias("mine"))
    marked = materialize(buckets.select("band", "head").join(with_label, "head"), "line-buckets")
    mixed = lambda rows: rows.groupBy("band").agg(F.min("mine").alias("l"), F.max("mine").alias("h"), F.count(F.lit(1)).alias("c")).filter("l <> h").select("band", "c")
    # of up to three lines, the first step has tried all pairs
    marked = materialize(marked.join(mixed(marked).filter("c > 3"), "band"), "line-open")
    opened = materialize(marked.select("node", "mine").distinct(), "line-open")
    if not opened.isEmpty():
        said = materialize(said.join(small(opened, 40), "node"), "lines")
        shapes = line_shapes(said, shingle, bands, rows)
        again = materialize(shapes.select("head", "mine", F.explode("bands").alias("band")), "line-again")
        members = marked.select("band", "c", "head").unionByName(again.join(mixed(again), "band").select("band", "c", "head"))
        rest = block_pairs(members.join(shapes.select("head", "mine", "n", "odd", "keys"), "head"), threshold)
        rest = rest.join(first.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")), ["g", "h"], "left_anti")
        more = verified(rest, said, shingle, threshold)
        if not more.isEmpty():
            labels = relabelled(labels, more)

    linked = places.join(small(labels, 40), "node")
    kept = linked.groupBy("label").agg(F.min("first").alias("kept"))
    busy = linked.join(kept, "label").select("node", "kept").unionByName(
        places.filter("n > 1").join(small(labels, 40), "node", "left_anti").select("node", F.col("first").alias("kept")))
    lost = lines.select("doc_id", "mark", "line", "node").join(small(materialize(busy, "line-kept"), 96), "node").filter(place != F.col("kept"))
    return lost.groupBy("doc_id", "mark").agg(F.collect_list("line").alias("lost"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with the lines that go taken out of the text, and n_lines and
    n_lost (lines with a character, before, and those taken out; clashing
    columns are replaced)."""
    mark = F.xxhash64(q(text))
    lost = materialize(lost_lines(docs.select(q(doc_id).alias("doc_id"), mark.alias("mark"), q(text).alias("text")), **limits), "lost-lines")
    total = lost.agg(F.sum(F.size("lost") * 8 + 64)).first()[0] or 0
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_lost")]
    of, at, gone = fresh(docs, "of", "at", "gone")
    lost = lost.select(F.col("doc_id").alias(of), F.col("mark").alias(at), F.col("lost").alias(gone))
    joined = docs.select(*[q(c) for c in kept]).join(F.broadcast(lost) if total <= 32 << 20 else lost, q(doc_id).eqNullSafe(q(of)) & (mark == q(at)), "left").drop(of, at)
    where = kept.index(text)
    schema = T.StructType([*joined.schema[:len(kept)], T.StructField("n_lines", T.LongType()), T.StructField("n_lost", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, count, less = [], [], []
            for t, g in zip(b.column(where).to_pylist(), b.column(len(kept)).to_pylist()):
                count.append(sum(1 for x in t.split("\n") if x and not x.isspace()) if t else 0)
                less.append(len(g) if g else 0)
                if g:
                    g = set(g)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
                texts.append(t)
            columns = [pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(b.columns[:len(kept)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(less, pa.int64())], names=[*kept, "n_lines", "n_lost"])

    return joined.mapInArrow(cut, schema)
