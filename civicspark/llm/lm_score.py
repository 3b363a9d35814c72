"""Operator 1, LM scoring by stupid backoff.

Scores are relational: documents are dealt into blocks, each block gives its
distinct n-grams of orders 1 to ``order`` with their counts, dealt by hash to
buckets; a bucket adds up the counts of all blocks (the n-gram count table)
and sends each block the totals of its own n-grams; joined back to the
block's n-grams in place, they are summed per document. A frequent n-gram is
one row per block, however many rows or documents hold it, so no key is hot.

The score of a word is that of the longest n-gram ending there which the
corpus holds ``least`` times or more: its count over its context's count,
times ``alpha`` for each order given up; a lone word's count is taken over
all words. Counts cover all documents, the scored one too; so ``least`` is 2:
what only one place says gives no score to itself.

Rows equal in id and text meet in one block; there they are one row with its
number of copies, which its n-grams count and its score is given to.

Blocks hold about ``BLOCK_BYTES`` of text, buckets the n-grams of as much;
their numbers grow with the input.

Defined results: words are runs without ASCII white space, A-Z lower-cased;
null or empty text has no words, a score of 0 and a null mean; repeated rows
and repeated ids are scored each; null ids stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import materialize, q
from civicspark.llm.textnum import Hasher, chunks, mix, text_bytes

SPACE = (0x20, *range(0x09, 0x0E))
ORDER, LEAST, ALPHA, BLOCK_BYTES, COPIES = 2, 2, 0.4, 16 << 20, 1 << 16


def _grams(column, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hashes of the n-grams ending at each word (0 where
    the document has too few words before), and the documents' offsets."""
    raw, off = text_bytes(column)
    hasher, parts, ends = Hasher(SPACE), [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in chunks(off):  # the hasher's own arrays are many times the text
        w, r = hasher.words(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        parts.append(w)
        ends.append(r[1:] + ends[-1][-1])
    words, rows = np.concatenate(parts), np.concatenate(ends)
    place = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
    out = []
    for k in range(1, order + 1):
        h = np.full(len(words), k, np.uint64)
        for back in range(k - 1, -1, -1):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.roll(words, back))
        out.append(np.where(place >= k - 1, h | np.uint64(1), np.uint64(0)))
    return out, rows


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    return np.unique(every, return_inverse=True)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted n-grams come in bucket order."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _narrow(counts: np.ndarray) -> bytes:
    return counts.astype("<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u8").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST,
              alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score, mean_log_score) of every row;
    n_backoff: words scored below the longest order they could have."""
    spark = docs.sparkSession
    docs = docs.select(q(doc_id).alias("doc_id"), q(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(parts, "block")
    dealt = dealt.groupBy("block", "doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))  # in place: rows are dealt by block

    def count(t: pa.Table) -> pa.Table:
        grams, rows = _grams(t.column("text").combine_chunks(), order)
        distinct, at = _distinct(grams)
        n = np.bincount(at, np.tile(np.repeat(t.column("copies").to_numpy(), np.diff(rows)), order), len(distinct)).astype(np.int64)
        b = _bucket(distinct, blocks).astype(np.int64)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
        pieces = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        return pa.table({"bucket": pa.array([int(b[x]) for x, _ in pieces], pa.int64()), "block": pa.array([t.column("block")[0].as_py()] * len(pieces), pa.int64()),
                         "grams": pa.array([distinct[x:y].tobytes() for x, y in pieces], pa.binary()), "counts": pa.array([_narrow(n[x:y]) for x, y in pieces], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        counts = [_wide(c, len(g)) for c, g in zip(t.column("counts").to_pylist(), grams)]
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)[at]
        edge = np.cumsum([0, *map(len, grams)])
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "size": pa.array(np.diff(edge), pa.int64()),
                         "totals": pa.array([_narrow(total[x:y]) for x, y in zip(edge[:-1], edge[1:])], pa.binary())})

    def score(t: pa.Table, totals: pa.Table) -> pa.Table:
        grams, rows = _grams(t.column("text").combine_chunks(), order)
        _, at = _distinct(grams)
        totals = totals.sort_by("bucket")
        parts = [_wide(c, n) for c, n in zip(totals.column("totals").to_pylist(), totals.column("size").to_pylist())]
        c = (np.concatenate(parts) if parts else np.zeros(0, np.int64))[at].reshape(order, -1)
        n = c.shape[1]
        place = np.arange(n) - np.repeat(rows[:-1], np.diff(rows))
        level, most = np.ones(n, np.int64), np.minimum(place + 1, order)
        value = np.log(np.maximum(c[0], 1))
        for k in range(2, order + 1):
            use = (place >= k - 1) & (c[k - 1] >= least)
            level[use] = k
            value[use] = np.log(c[k - 1][use]) - np.log(c[k - 2][np.flatnonzero(use) - 1])
        value += np.log(alpha) * (most - level)
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[rows])
        each = np.array([value[a:b].sum() for a, b in zip(rows[:-1], rows[1:])], np.float64)
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(np.diff(rows), pa.int64()), "n_alone": pa.array(summed(level == 1), pa.int64()),
                         "n_backoff": pa.array(summed(level < most), pa.int64()), "part": pa.array(each, pa.float64()), "copies": t.column("copies")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = dealt.groupBy("block").applyInArrow(count, "bucket long, block long, grams binary, counts binary")
    totals = table.groupBy("bucket").applyInArrow(add, "block long, bucket long, size long, totals binary")
    scored = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, n_alone long, n_backoff long, part double, copies long")
    scored = materialize(scored, "lm-scores")
    words = scored.agg(F.sum(F.col("n_words") * F.col("copies"))).first()[0] or 1
    for size in (COPIES, 1):  # each row again, in two steps that keep arrays short
        scored = scored.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(size).cast("long"))))
        scored = scored.withColumn("copies", F.least(F.col("copies") - F.col("at"), F.lit(size)))
    total = F.col("part") - F.col("n_alone") * F.log(F.lit(float(words)))
    return scored.select("doc_id", "n_words", "n_backoff", total.alias("log_score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_score"))
