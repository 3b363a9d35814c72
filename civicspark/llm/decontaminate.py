"""Operator 6, benchmark decontamination by a broadcast set of test n-grams.

Native: DataFrame functions only. Texts are lower-cased (A-Z) and cut into
runs of ASCII letters, digits and other characters beyond ASCII. Every
benchmark item gives its windows of ``size`` words (an item of fewer words is
one window); their hashes are the set. A document's windows are hashed inside
its row, for each window length that the set has, and look up the set's slot
table, a constant of the plan; the few that pass leave the row with their
words, and a broadcast join with the set keeps those of equal words. A set
beyond ``BROADCAST_BYTES`` has no slot table: then all windows leave their
rows and meet the set in a shuffle join.

Every document row gives one marker row, so one pass yields both hits and
documents. Rows are grouped by document id and the text's digest: repeated
rows have equal results and come back as often as they were. What is summed
for one document are its hit positions, at most its words.

Defined results: null and empty texts have no words; null document ids are
kept apart by text; null or empty items match nothing; items with equal ids
count once, their texts all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import ascii_lower, bind, materialize, q

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE, BROADCAST_BYTES, SPREAD, COPIES = 10, 64 << 20, 32, 4096


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def windows(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, in order (none if fewer).
    Windows of n words are hashed from two of half as many."""
    def shift(hs: Column, by: int) -> Column:
        return F.slice(hs, by + 1, F.greatest(F.size(hs), F.lit(1)))

    def of(n: int, ones: Column) -> Column:
        if n == 1:
            return ones
        if n % 2:
            return F.zip_with(of(n - 1, ones), shift(ones, n - 1), lambda a, b: F.xxhash64(a, b))
        return bind(of(n // 2, ones), lambda half: F.zip_with(half, shift(half, n // 2), lambda a, b: F.xxhash64(a, b)))

    hashes = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda ones: of(size, ones))
    return F.slice(hashes, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))


def test_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(hash, w_words, w_size, w_items): the distinct windows of all items."""
    w = items.select(q(item_id).cast("string").alias("item"), words_of(q(text)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    rows = w.select("item", "words", length.alias("n"), starts.alias("i")).select("item", F.slice("words", F.col("i"), F.col("n")).alias("w_words"))
    grams = rows.groupBy("w_words").agg(F.collect_set("item").alias("w_items")).withColumn("w_size", F.size("w_words"))
    hash_of = F.coalesce(*[F.when(F.col("w_size") == n, F.get(windows(F.col("w_words"), n), F.lit(0))) for n in range(1, size + 1)])
    return grams.select(hash_of.alias("hash"), "w_words", "w_size", "w_items")


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = SIZE, markers: bool = True) -> DataFrame:
    """(doc_id, digest, n_words, at, w_size, w_items): verified hits, ``at``
    from 0; with ``markers`` also a row with ``at`` null for every document."""
    grams = materialize(test_windows(items, item_id, item_text, size), "test-windows")
    seen = grams.groupBy("w_size").agg(F.count(F.lit(1)).alias("n")).collect()
    slots = 1 << max(12, (SPREAD * sum(r["n"] for r in seen)).bit_length())
    bounded = slots + sum(r["n"] * (64 + 24 * r["w_size"]) for r in seen) <= BROADCAST_BYTES
    table = slot_table(grams, slots) if bounded else None
    d = docs.select(q(doc_id).alias("doc_id"), F.md5(F.coalesce(q(text), F.lit(""))).alias("digest"), words_of(q(text)).alias("words"))
    marker = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("said")))
    made = [bind(windows(F.col("words"), n), candidates(F.col("words"), n, table, slots)) for n in sorted(r["w_size"] for r in seen)]
    probes = d.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(F.slice(marker, 1, int(markers)), *made)).alias("p"))
    same = (F.col("p.h") == F.col("hash")) & (F.col("p.said") == F.col("w_words"))
    found = probes.join(F.broadcast(grams) if bounded else grams, same, "left" if markers else "inner")
    return found.filter(F.col("p.h").isNull() | F.col("hash").isNotNull()).select("doc_id", "digest", "n_words", F.col("p.at").alias("at"), "w_size", "w_items")


def slot_table(grams: DataFrame, slots: int) -> bytes:
    """One byte for each hash slot: 1 where the set has a window."""
    out = bytearray(slots)
    for r in grams.select(slot(F.col("hash"), slots).alias("s")).distinct().collect():
        out[r["s"]] = 1
    return bytes(out)


def slot(h: Column, slots: int) -> Column:
    return F.pmod(h, F.lit(slots)).cast("int")


def candidates(words: Column, n: int, table: bytes | None, slots: int):
    """From window hashes to (at, h, said) of the windows whose slot is set,
    or of all where the set is too large for a slot table."""
    def of(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: i)
        if table is not None:
            full = lambda h: F.substr(F.lit(table), slot(h, slots) + 1, F.lit(1)) == F.lit(b"\x01")
            at = F.filter(F.transform(hashes, lambda h, i: F.when(full(h), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.get(hashes, i).alias("h"), F.slice(words, i + 1, F.lit(n)).alias("said")))
    return of


def report(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (ids, sorted as
    strings) and spans (start, end) of hit words."""
    h = hits(docs, items, **names)
    spots = h.groupBy("doc_id", "digest", "n_words").agg(
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", F.col("w_size").alias("n"))))).alias("spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items"))
    # rows that repeat, again: by parts, so that no array holds all copies
    one = spots.select("doc_id", "digest", "n_words", "items", spans(F.col("spots")).alias("spans"), "copies")
    parts = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("part"))
    rows = parts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - COPIES * F.col("part")))).alias("copy"))
    return rows.select("doc_id", "digest", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"), "items", "spans")


def spans(spots: Column) -> Column:
    """Sorted (at, n) joined to disjoint (start, end)."""
    kind = "array<struct<start:int,end:int>>"

    def one(start: Column, end: Column) -> Column:
        return F.array(F.struct(start, end)).cast(kind)

    def add(done: Column, s: Column) -> Column:
        last, end = F.try_element_at(done, F.lit(-1)), s["at"] + s["n"]
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(last["end"] >= s["at"], F.concat(head, one(last["start"], F.greatest(last["end"], end)))).otherwise(
            F.concat(done, one(s["at"], end)))

    return F.aggregate(spots, F.array().cast(kind), add)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the rows whose text holds a test window."""
    found = hits(docs, items, doc_id, text, markers=False, **names).select("doc_id", "digest").distinct()
    bad = found.select(F.col("doc_id").alias("__bad_id"), F.col("digest").alias("__bad_digest"))
    same = q(doc_id).eqNullSafe(F.col("__bad_id")) & (F.md5(F.coalesce(q(text), F.lit(""))) == F.col("__bad_digest"))
    return docs.join(bad, same, "left_anti")
