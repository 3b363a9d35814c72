"""Operator 10, packing by order-preserving dynamic programming.

Each task reads its documents in order as one stream of token ids (a text's
ids, then ``end_id``) and cuts it into windows of at most ``window`` ids.
Cuts may lie at document ends (no penalty), at sentence or line ends
(``SENTENCE``) and at any other id (``HARD``). The cuts minimise padding plus
penalties, which is windows * ``window`` + penalties less the ids. Of two ways
of one cost the one that is further on is never worse, so the program keeps
far(c), the furthest cut of cost c at most: the furthest of the last document
end, the last sentence end and the last id within a window of far at the cost
before. A block of ``BLOCK`` ids is solved at a time and its open window goes
to the next block, so memory follows the block and the longest document.

Nothing is shuffled: the stream of a task is its scan split, and only a
split's last window is left part-filled.

Texts are tokenized by distinct words between ASCII white space, which no
token of the vocabulary's pre-tokenizer crosses. A table of words, bounded in
bytes (``KNOWN_BYTES``), is kept between the batches of a task; words beyond ``LONG``
characters (texts without spaces) are never kept. Memory follows the batch and
the longest document (a row of 100 MB: about 1.5 GB).

The program's transitions are over costs, not positions: for each cost the
furthest cut, where a monotone queue would keep, for each position, the
cheapest cut. Both give a cut of least cost (the tests compare with the plain
program over positions); by costs, a block takes numpy steps instead of a
Python step per id.

Defined results: null text is empty and still gives its end id; repeated rows
are packed each; null document ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat
from math import gcd
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.common import q

WINDOW, SENTENCE, HARD, BLOCK = 4096, 16, 256, 1 << 20
KNOWN_BYTES, ENTRY_BYTES, LONG, SLICE_CHARS = 96 << 20, 120, 64, 1 << 20
STOPS = (".", "!", "?", "…", "。")
MARKS = ".,;:!?"
PART, TOGETHER = "~", 512  # stands between words that are encoded in one call
DOC_END = np.zeros(1, np.int64)  # the number of the end of a document


class Grown:
    """A numpy array that grows at its end; room doubles, so what is there is
    copied a bounded number of times."""

    def __init__(self, values: np.ndarray):
        self.room, self.n = values, len(values)

    def add(self, values: np.ndarray):
        end = self.n + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:end] = values
        self.n = end


class Words:
    """Ids of words, kept in one flat array. New words are encoded many in
    one call, with ``PART`` between them, whose id tells them apart again
    (white space and a sign of its own part words for the library too); words
    that hold ``PART`` one by one. A word of letters with a mark behind is the
    ids of its letters and the mark's."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole, self.end_id = Tokenizer.from_file(path), end_id
        signs = self.pipeline([PART, *MARKS])

        def joins(tokenizer, probes: list[str]) -> bool:
            alone = self.pipeline(probes)
            return len(signs[0]) == 1 and self.pipeline([f" {PART} ".join(probes)], tokenizer)[0] == [i for k, ids in enumerate(alone) for i in (signs[0] * (k > 0) + ids)]

        self.part = signs[0][0] if joins(self.whole, ["a", "Word", "zażółć", "3.5x", "a,b", "é", "#"]) else None
        # words of small letters need neither the normaliser nor the pre-tokenizer's pattern
        self.plain, self.letters = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if not joins(self.plain, ["a", "word", "abcdefghijklmnop"]):
            self.plain = self.whole
        if not joins(self.letters, ["a", "zażółć", "straße", "éà", "日本", "слово"]):
            self.letters = self.whole
        marked = self.pipeline([f"word{m}" for m in MARKS])
        self.marks = {m: ids[0] for m, ids, both in zip(MARKS, signs[1:], marked) if len(ids) == 1 and both == self.pipeline(["word"])[0] + ids}
        self.reset()

    def reset(self):
        # 0: the end of a document; 1: the end of a line
        self.index, self.held = {"": 2, "\n": 1}, 0
        self.ids, self.start, self.size = Grown(np.array([self.end_id], np.uint32)), Grown(np.array([0, 0, 0])), Grown(np.array([1, 0, 0]))
        self.stop = Grown(np.array([2, 1, 0], np.uint8))

    def pipeline(self, words: list[str], tokenizer=None) -> list[list[int]]:
        """Ids of each text by the library."""
        return [e.ids for e in (tokenizer or self.whole).encode_batch_fast(words, add_special_tokens=False)]

    def made(self, words: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, on end, of ``words``."""
        if self.part is None:
            made = self.pipeline(words)
            return np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), np.uint32)
        sizes, flat = [], []
        for a in range(0, len(words), TOGETHER):
            some = words[a:a + TOGETHER]
            text = f" {PART} ".join(some)
            ids = np.array(self.pipeline([text], tokenizer if tokenizer and is_normalized("NFC", text) else None)[0], np.uint32)
            at = np.flatnonzero(ids == self.part)
            sizes.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
            flat.append(ids[ids != self.part])
        return np.concatenate(sizes), np.concatenate(flat)

    def add(self, words: list[str], size: np.ndarray, flat: np.ndarray):
        self.index.update(zip(words, range(self.size.n, self.size.n + len(words))))
        self.start.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(flat)
        self.stop.add(np.fromiter((w.endswith(STOPS) for w in words), np.uint8, len(words)))

    def learn(self, words: list[str]):
        marked, plain, odd, get = [], set(), [], self.index.get
        for w in words:
            if w[-1] in self.marks and w[:-1].isalpha():
                marked.append(w)
                if get(w[:-1]) is None:
                    plain.add(w[:-1])
            elif PART in w:
                odd.append(w)
            else:
                plain.add(w)
        groups: dict = {}
        for w in plain:
            small = w.isalpha() and w == w.lower()
            groups.setdefault(None if not small else self.plain if w.isascii() else self.letters, []).append(w)
        for tokenizer, some in groups.items():
            self.add(some, *self.made(some, tokenizer))
        if odd:
            made = self.pipeline(odd)
            self.add(odd, np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), np.uint32))
        if marked:
            base = np.fromiter((self.index[w[:-1]] for w in marked), np.int64, len(marked))
            size = self.size.room[base]
            ends = np.cumsum(size + 1)
            flat = np.empty(int(ends[-1]), np.uint32)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[ends - 1] = np.fromiter((self.marks[w[-1]] for w in marked), np.uint32, len(marked))
            flat[inside] = self.ids.room[np.repeat(self.start.room[base] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            self.add(marked, size + 1, flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts on end, the ends of texts, and the ends of
        sentences and lines (positions after an id)."""
        if self.held > KNOWN_BYTES:
            self.reset()
        parts = [w for t in texts for w in _words(t)]
        keys = [np.fromiter(map(self.index.get, p, repeat(-1)), np.int64, len(p)) for p in parts]
        unknown = [np.flatnonzero(k < 0).tolist() for k in keys]
        new = {p[i] for p, at in zip(parts, unknown) for i in at}
        short = [w for w in new if len(w) <= LONG]
        before = self.ids.n
        if short:
            had = self.size.n
            self.learn(short)
            self.held += ENTRY_BYTES * (self.size.n - had) + sum(map(len, short)) + 4 * (self.ids.n - before)
        kept, once = (self.size.n, self.ids.n), [w for w in new if len(w) > LONG] if len(short) < len(new) else []
        if once:
            made = self.pipeline(once)
            self.add(once, np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), np.uint32))
        for k, p, at in zip(keys, parts, unknown):
            if at:
                k[at] = [self.index[p[i]] for i in at]
        keys = np.concatenate([k for own, last in zip(keys, _last(texts)) for k in ((own, DOC_END) if last else (own,))])
        size = self.size.room[keys]
        ends = np.cumsum(size)
        ids = self.ids.room[np.repeat(self.start.room[keys] - (ends - size), size) + np.arange(int(ends[-1]))]
        stop = self.stop.room[keys]
        if once:  # long words are forgotten, with the room they took
            for w in once:
                del self.index[w]
            self.start.n = self.size.n = self.stop.n = kept[0]
            self.ids.n = kept[1]
            if len(self.ids.room) > 4 * kept[1] + (1 << 20):
                self.ids.room = self.ids.room[:kept[1]].copy()
        return ids, ends[stop == 2], ends[stop == 1]


def _words(text: str) -> Iterator[list[str]]:
    """Words and line ends of a text, in slices cut at spaces. A-Z are
    lower-cased at once where that changes no composed or special string."""
    at = 0
    low = text.encode().lower().decode()
    if "<|" not in text and is_normalized("NFC", text) and is_normalized("NFC", low):
        text = low
    while True:
        cut = text.find(" ", at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else -1
        part = text[at:cut] if cut >= 0 else text[at:]
        for c in "\t\v\f\r":
            if c in part:
                part = part.replace(c, " ")
        yield part.replace("\n", " \n ").split(" ")
        if cut < 0:
            return
        at = cut + 1


def _last(texts: list[str]) -> Iterator[bool]:
    """True for the last slice of each text."""
    for t in texts:
        n = sum(1 for _ in _words(t)) if len(t) > SLICE_CHARS else 1
        yield from (i == n - 1 for i in range(n))


def best_cuts(points: np.ndarray, penalty: np.ndarray, window: int, closed: bool, hard: int = HARD) -> list[int]:
    """Positions of the chosen cuts. ``points``: the end and other cuts with a
    ``penalty`` of their own, growing; any other position costs ``hard``.
    ``closed``: the last point is a cut; else the last window stays open, after
    the cut of least padding and penalties."""
    total, prices = int(points[-1]), np.unique(penalty).tolist()
    unit = gcd(window, hard, *prices)
    step, ways = window // unit, []  # cost in units and, for each position, the last cut up to it
    for price in prices:
        last, some = np.zeros(total + 1, np.int64), points[penalty <= price]
        last[some] = some
        ways.append((step + price // unit, np.maximum.accumulate(last)))
    ways.append((step + hard // unit, np.arange(total + 1)))
    far, c = np.zeros(2 * step + -(-total // window) * (step + hard // unit), np.int64), step
    while far[c - 1] < total:  # no cut costs less than a step, so a step is found at once
        best = np.full(step, far[c - 1])
        for cost, last in ways:
            none = max(0, cost - c)
            if none < step:
                best[none:] = np.maximum(best[none:], last[np.minimum(far[c - cost + none:c - cost + step] + window, total)])
        far[c:c + step] = np.maximum.accumulate(best)
        c += step
    j = int(np.searchsorted(far[:c], total))
    if not closed:
        low = int(np.searchsorted(far[:c], total - window, "right"))
        j = low + int(np.argmin(unit * np.arange(low, j + 1) - far[low:j + 1]))
    out = []
    while far[j]:
        j = int(np.searchsorted(far[:j + 1], far[j]))
        out.append(int(far[j]))
        j = next(j - cost for cost, last in ways if cost <= j and last[min(far[j - cost] + window, total)] == far[j])
    return out[::-1]


def cut_points(total: int, docs: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts that cost less than ``HARD`` and their penalties: document ends
    and sentence ends."""
    points = np.unique(np.concatenate([docs, stops, [total]]))
    points = points[(points > 0) & (points <= total)]
    return points, np.where(np.isin(points, docs), 0, SENTENCE)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (little-endian
    unsigned 32-bit), pieces (doc_id, start, length, doc_tokens, offset)."""
    kind = docs.select(q(doc_id)).schema[0].dataType
    long = T.LongType()
    piece = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, long) for c in ("start", "length", "doc_tokens", "offset")]])
    schema = T.StructType([T.StructField("sequence_id", long), T.StructField("n_tokens", long), T.StructField("ids", T.BinaryType()), T.StructField("pieces", T.ArrayType(piece))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, serial = Words(vocabulary, end_id), TaskContext.get().partitionId() << 32
        ids, stops = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, size, name = np.zeros(0, np.int64), np.zeros(0, np.int64), []  # of each document: its start in ids (below 0 if begun before), length, id

        def cut(closed: bool):
            nonlocal ids, stops, first, size, name, serial
            points, penalty = cut_points(len(ids), first + size, stops)
            cuts, rows, a = best_cuts(points, penalty, window, closed), [], 0
            for b in cuts:
                lo, hi = np.searchsorted(first + size, a, "right"), np.searchsorted(first, b, "left")
                rows.append({"sequence_id": serial, "n_tokens": b - a, "ids": ids[a:b].astype("<u4").tobytes(), "pieces": [
                    {"doc_id": name[k], "start": max(0, a - f), "length": min(b, f + n) - max(a, f), "doc_tokens": n, "offset": max(0, f - a)}
                    for k, f, n in zip(range(lo, hi), first[lo:hi].tolist(), size[lo:hi].tolist())]})
                serial, a = serial + 1, b
            lo = np.searchsorted(first + size, a, "right")
            ids, stops, first, size, name = ids[a:], stops[stops > a] - a, first[lo:] - a, size[lo:], name[lo:]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k:k + 256], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for b in batches:
            texts, names = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            at = 0
            while at < len(texts):  # batches balanced by characters
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= SLICE_CHARS):
                    held, to = held + len(texts[to]), to + 1
                new, ends, marks = words.encode(texts[at:to])
                base, begun = len(ids), np.concatenate([[0], ends[:-1]])
                ids, stops = np.concatenate([ids, new]), np.concatenate([stops, marks + base])
                first, size = np.concatenate([first, begun + base]), np.concatenate([size, ends - begun])
                name += names[at:to]
                at = to
                if len(ids) >= BLOCK:
                    yield from cut(False)
        if len(ids):
            yield from cut(True)

    return docs.select(q(doc_id), q(text)).mapInArrow(run, schema)


def pieces(packed: DataFrame) -> DataFrame:
    """One row per piece, with the CRC-32 of its ids."""
    p = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    part = F.substr("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return p.select("p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
