"""Operator 13, periodic run detection by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, of length
``max(least, 3 q)`` at least, that no neighbouring word extends keeping q.

The documents of a batch are laid one after another as word numbers, a number
of its own between two of them, so no run crosses. Then

* periods up to ``DIRECT`` are found by lag scans: in a run, the words at some
  three neighbouring places of a grid equal those q further on, so only grid
  places are compared;
* longer periods fall into scales (Q, 1.5 Q]. At a scale, the minimum of the
  hashes of ``K = 1.5 Q`` words is taken in windows of
  ``w = 2 (Q + 1) - K + 1`` places. The windows at the start of a run and one
  period later see equal words, so their minimizers are equal, q apart; and as
  K is no shorter than q, no equal one lies between. So next equal minimizers
  that lie a period of the scale apart seed every run.

Each seed is extended word by word in both directions, exactly; stretches with
a shorter period (a divisor, by length) are left to that period. Only documents
of three periods of a scale take part in it.

Nothing is shuffled. Memory follows a batch of ``CHUNK_WORDS`` words or the
longest document, some 60 bytes a word (a row of 100 MB of text: about 1 GB).

Defined results: null text has no words; empty texts have no runs and an empty
collapsed text; repeated rows and null ids are worked on each; columns of the
input that clash with the new ones are replaced; an empty table gives no rows.
Equal hashes of different words in a row could only hide a run (64 bits).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.common import bind, fresh, q
from civicspark.llm.textnum import M64, mix

LEAST, DIRECT = 24, 48
CHUNK_WORDS, SLICE = 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = b" \t\n\x0b\x0c\r"
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Numbers:
    """Numbers of words (bytes between ASCII white space)."""

    def __init__(self):
        self.of = defaultdict(count().__next__)

    def words(self, text: str) -> np.ndarray:
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            end = min(at + SLICE, len(raw))
            while end < len(raw) and raw[end] not in SPACES:
                end += 1
            part = raw[at:end].split()
            out.append(np.fromiter(map(self.of.__getitem__, part), np.int64, len(part)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base & M64, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """``op`` over each window of ``w`` values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (w - have)], x[w - have:]) if have < w else x


def minimizers(words: np.ndarray, k: int, w: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all ``k``-word grams that are the least of some
    window of ``w`` places."""
    n = len(words) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * up[:len(words)], out=total[1:])
    h = mix((total[k:] - total[:n]) * down[:n])
    low = sliding(np.minimum, h, w)
    fill = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.maximum, np.concatenate([fill, low, fill]), w) == h)
    return chosen, h[chosen]


def stretch(x: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The places around ``at`` on end whose words equal those ``lag`` on."""
    lo, hi, last, step = at, at, len(x) - lag, 64
    while lo > 0:
        a = max(0, lo - step)
        odd = np.flatnonzero(x[a:lo] != x[a + lag:lo + lag])
        if len(odd):
            lo = a + int(odd[-1]) + 1
            break
        lo, step = a, min(2 * step, 1 << 16)
    step = 64
    while hi < last:
        b = min(last, hi + step)
        odd = np.flatnonzero(x[hi:b] != x[hi + lag:b + lag])
        if len(odd):
            hi += int(odd[0])
            break
        hi, step = b, min(2 * step, 1 << 16)
    return lo, hi


def divisors(n: int) -> list[int]:
    """``n`` divided by each of its prime factors."""
    out, left, p = [], n, 2
    while p * p <= left:
        if left % p == 0:
            out.append(n // p)
            while left % p == 0:
                left //= p
        p += 1
    return out + [n // left] * (left > 1)


def find_runs(x: np.ndarray, parts: list[tuple[int, int]], least: int = LEAST, direct: int = DIRECT) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) in ``x``, in which documents of falling
    length lie one after another; ``parts`` holds (words of the document, end
    of its place in ``x``)."""
    found = []

    def seeds(lag: int, at: np.ndarray):
        k, need = 0, max(least - lag, 2 * lag)
        while k < len(at):
            lo, hi = stretch(x, lag, int(at[k]))
            if hi - lo >= need and not any(np.array_equal(x[lo:lo + lag], x[lo + r:lo + r + lag]) for r in divisors(lag)):
                found.append((lo, hi - lo + lag, lag))
            k = int(np.searchsorted(at, max(hi, int(at[k]) + 1)))

    longest = parts[0][0] if parts else 0
    for lag in range(1, min(direct, longest // 3) + 1):
        s = max(1, max(least - lag, 2 * lag) // 3)
        same = x[:-lag:s] == x[lag::s]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hits):
            seeds(lag, hits * s)
    scale = direct
    if longest >= 3 * (scale + 1):
        up, down = powers(len(x))
    while longest >= 3 * (scale + 1):
        k = max(scale + 1, scale * 3 // 2)
        end = max(e for n, e in parts if n >= 3 * (scale + 1))
        at, h = minimizers(x[:end], k, 2 * (scale + 1) - k + 1, up, down)
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        lag = at[1:] - at[:-1]
        good = (h[1:] == h[:-1]) & (lag > scale) & (lag <= k)
        at, lag = at[:-1][good], lag[good]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        edges = np.flatnonzero(np.diff(lag)) + 1
        for a, b in zip([0, *edges], [*edges, len(lag)]):
            if b > a:
                seeds(int(lag[a]), at[a:b])
        scale = k
    return found


def runs_of(texts: list[np.ndarray], least: int = LEAST, direct: int = DIRECT) -> list[list[tuple[int, int, int]]]:
    """The runs of each document (word numbers), by start and period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if len(texts[i]) >= least]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    laid, begin, parts, at = [], [], [], 0
    for k, i in enumerate(order):
        laid += [texts[i], np.array([-1 - k], np.int64)]
        begin.append(at)
        at += len(texts[i]) + 1
        parts.append((len(texts[i]), at))
    begin = np.array(begin)
    for start, length, period in find_runs(np.concatenate(laid), parts, least, direct):
        k = int(np.searchsorted(begin, start, "right")) - 1
        out[order[k]].append((start - int(begin[k]), length, period))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def collapse(words: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return words[np.cumsum(edge[:-1]) == 0]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, direct: int = DIRECT) -> DataFrame:
    """The other columns of ``docs`` with n_words, runs (array of start,
    length, period, by start and period) and collapsed, the text of the kept
    words between single spaces."""
    made = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c != text and c.lower() not in made]
    inner, = fresh(docs, "text")
    schema = T.StructType([*docs.select(*[q(c) for c in kept]).schema, T.StructField("n_words", T.LongType()),
                           T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])

    def work(texts: list[str]) -> tuple[list, list, list]:
        numbers = Numbers()
        docs = [numbers.words(t) for t in texts]
        names = list(numbers.of)
        runs = runs_of(docs, least, direct)
        joined = [b" ".join(map(names.__getitem__, collapse(d, r).tolist())).decode("utf-8", "surrogatepass") for d, r in zip(docs, runs)]
        return [len(d) for d in docs], runs, joined

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, a = b.column(len(kept)), 0
            while a < len(texts):
                part, held, z = [], 0, a
                while z < len(texts) and (z == a or held < 6 * CHUNK_WORDS):
                    part.append(texts[z].as_py() or "")
                    held += len(part[-1])
                    z += 1
                n, runs, joined = work(part)
                flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *map(len, runs)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in b.columns[:len(kept)]], pa.array(n, pa.int64()), lists, pa.array(joined, pa.string())],
                                                 names=[*kept, "n_words", "runs", "collapsed"])
                a = z

    return docs.select(*[q(c) for c in kept], q(text).alias(inner)).mapInArrow(find, schema)


def plant_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which the tail of one text in ten repeats: with h the CRC-32
    of the decimal key and g = h / 10, the words from a = g % n on come round
    again after 1 + (n - a) / (3 + g % 8) words where h % 10 is 0."""
    h = F.crc32(q(key).cast("string").cast("binary"))

    def planted(words, place):
        n, a, p = F.size(words), place["a"], place["p"]
        return F.array_join(F.concat(F.slice(words, 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))), " ")

    def place(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        return F.struct(a.cast("int").alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))

    words = F.filter(F.split(q(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = (h % 10 == 0) & F.coalesce(q(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return docs.withColumn(text, F.when(hit, bind(words, lambda w: bind(place(w), lambda x: planted(w, x)))).otherwise(q(text)))


def run_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the contract: counts, the run of the greatest exact
    length / period, and digests."""
    first = F.aggregate("runs", F.lit(None).cast(RUN.elementType), lambda acc, r: F.when(
        acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    b = found.withColumn("best", first)
    return b.select(key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
