"""Bounded-space online best-fit packing of tokenised documents into sequences.

A task keeps at most OPEN bins. They are found through a bitset keyed by free space: the lowest set bit at or
above a piece's length is the bin that it fills best. If none has room and all OPEN are in use, the fullest bin
(the lowest set bit) closes. Sequences don't cross tasks, so no row is shuffled and memory is OPEN bins a task.

Only documents longer than a sequence are cut: their first piece holds the remainder, the others fill sequences. A
very long text is encoded whole and gives as many pieces as it needs. Null and empty texts have the end id alone.
Repeated rows are packed each. Of bins with equal free space the last one put back is taken. An empty table gives no
pieces. Ids are the tokenizers library's, which makes an added token that stands in a text one id. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bound_batches, fields, id_and_text, to_arrow
from .encoding import encoder

#: Open bins of a task.
OPEN = 1024


class BestFit:
    """Places pieces online; only free spaces are kept, as what went into a bin needs no later change."""

    def __init__(self, size: int, open_bins: int = OPEN):
        self.size, self.limit = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of a piece of 1..size tokens."""
        if length == self.size:
            self.made += 1
            return self.made - 1, 0
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id = self.size, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return out


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; the first may be shorter than `size`, later ones are not."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))] if n > size else [(0, n)]


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, open_bins: int = OPEN) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset, and the piece's ids (little-endian unsigned 32-bit)."""
    bound_batches(docs.sparkSession)
    schema = fields(
        docs,
        ("piece", "int"),
        ("start", "bigint"),
        ("length", "bigint"),
        ("sequence_id", "bigint"),
        ("offset", "bigint"),
        ("ids", "binary"),
    )
    arrow = to_arrow(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer).encode, BestFit(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(*batch.to_pydict().values(), strict=True):
                ids = encode(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    at, offset = bins.place(length)
                    out.append((name, piece, start, length, base + at, offset, ids[4 * start : 4 * (start + length)]))
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return id_and_text(docs).mapInArrow(run, schema)
