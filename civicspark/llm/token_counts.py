"""Operator 5, token counts by Arrow functions that return lengths only.

Texts are cut at safe boundaries: at a space that follows another character
and does not end the text. The vocabulary has no piece with a word mark
inside (checked when the model is loaded, else texts stay whole), so no merge
crosses such a space, and the mark that the library puts before each text
stands for the space that was cut. The pieces of about ``BATCH_BYTES`` of
text (bytes) are encoded in one call, each distinct piece once; a table of
lengths, bounded in bytes (``KNOWN_BYTES``), is kept between calls, without
pieces beyond ``LONG`` characters. Texts beyond ``SLICE_CHARS`` are worked off
slice by slice, so memory follows the batch and not the longest text; a text
without a safe boundary (no spaces) is one piece, and memory follows it.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
are counted each; special strings inside texts are ordinary text, as is the
library's default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.common import fresh, q

BATCH_BYTES, SLICE_CHARS, KNOWN_BYTES, ENTRY_BYTES, LONG = 1 << 20, 1 << 20, 48 << 20, 120, 64
SAFE = re.compile(r"(?<=[^ ]) (?=.)", re.DOTALL)


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """``text`` in slices of ``size`` characters or more, cut at safe boundaries."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def pieces(text: str) -> list[str]:
    """``text`` cut at all its safe boundaries."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return SAFE.split(text)
    return text.split(" ")


class Lengths:
    """Token counts of texts by one sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        marks = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        whole = self.model.encode("a  b ", out_type=str) == ["▁a", "▁", "▁b", "▁"]
        self.cut = pieces if whole and not any("▁" in p.lstrip("▁") for p in marks) else lambda t: [t]
        self.known: dict[str, int] = {}
        self.held = 0

    def of(self, texts: list[str]) -> list[int]:
        parts = [self.cut(t) for t in texts]
        new = list(set().union(*parts) - self.known.keys())
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        get = self.known.__getitem__
        out = [sum(map(get, p)) for p in parts]
        for p in new:
            if len(p) > LONG:
                del self.known[p]
            else:
                self.held += ENTRY_BYTES + len(p)
        if self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
        return out


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """The other columns of ``docs`` with n_bytes, n_tokens and over_limit
    (clashing ones are replaced)."""
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c.lower() not in made]
    inner, = fresh(docs, "text")
    schema = T.StructType([*docs.select(*[q(c) for c in kept]).schema, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model)
        for b in batches:
            texts = [t or "" for t in b.column(len(kept)).to_pylist()]
            totals, queue, owner, held = [0] * len(texts), [], [], 0

            def flush():
                for row, n in zip(owner, lengths.of(queue)):
                    totals[row] += n

            for row, t in enumerate(texts):
                for part in slices(t):
                    queue.append(part)
                    owner.append(row)
                    held += len(part) if part.isascii() else len(part.encode())
                    if held >= BATCH_BYTES:
                        flush()
                        queue, owner, held = [], [], 0
            flush()
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(size, pa.int64()), pa.array(totals, pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    rows = docs.select(*[q(c) for c in kept], q(text).alias(inner))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
