"""Near duplicates by b-bit MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct word n-grams; its signature is the least element under each of ``SYMBOLS``
hash functions, ``BITS`` bits of each. The distance of two signatures is the number of symbols that differ:
for sets of Jaccard index t it is binomial with mean SYMBOLS * (1 - t). ``Layout`` takes the least distance r that a
pair at the wanted similarity exceeds with a chance of ``LOSS`` at most (over the choice of hash functions), and the join
finds every pair within it:

* signatures are split into m equal chunks. Of two within r, at least m - r div 2 chunks differ in at most one
  symbol each (pigeonhole);
* a chunk is indexed with every allowed error, that is once without each of its symbols in turn, so such a pair
  shares a key of each of these chunks, whatever symbol differs;
* a signature leaves out its ``slack`` keys of the largest buckets; as all follow one order of keys, what either of
  a pair leaves out is a prefix of the keys that they share, and keys of ``NEED`` chunks are still shared.

Pairs that share so many are held to the distance r, and what is left to the exact index of the full sets. How
buckets are led, large ones taken in blocks and components found is shared with ``jaccard_join``.

Defined cases are those of ``jaccard_join``: null and empty texts are linked with nothing; texts of fewer than n words are
one element; rows without an id are components of their own; rows that repeat an id are documents of
their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import NEED, U64, Join, _mix, near_duplicates
from .shared import lean

SYMBOLS, BITS, LOSS = 128, 16, 1e-8
_SEEDS = np.random.default_rng(29).integers(0, 1 << 63, (2, SYMBOLS, 1), dtype=np.uint64)
FACTORS, OFFSETS = _SEEDS[0] * U64(2) + U64(1), _SEEDS[1]


class Layout:
    """Distance, chunk size, chunks and slack for a similarity of percent / 100."""

    def __init__(self, percent: int):
        apart = 1 - percent / 100
        chance = [math.comb(SYMBOLS, k) * apart**k * (1 - apart) ** (SYMBOLS - k) for k in range(SYMBOLS + 1)]
        self.radius = next(r for r in range(SYMBOLS + 1) if sum(chance[r + 1 :]) <= LOSS)
        sizes = [c for c in (16, 8, 4, 2) if SYMBOLS // c - self.radius // 2 >= NEED]
        if not sizes:
            raise ValueError(f"signatures of {SYMBOLS} symbols are too short for a similarity of {percent} %")
        self.size = sizes[0]
        self.chunks = SYMBOLS // self.size
        self.slack = self.chunks - self.radius // 2 - NEED


class Signature:
    """Signatures as bytes, and what the join asks of a sketch: which pairs may reach the similarity."""

    @staticmethod
    def of(elements: np.ndarray) -> bytes:
        if not len(elements):
            return b""
        least = np.full(SYMBOLS, np.iinfo(np.uint64).max, U64)
        with np.errstate(over="ignore"):
            for at in range(0, len(elements), 512):
                values = (elements[None, at : at + 512] ^ OFFSETS) * FACTORS
                np.minimum(least, (values ^ (values >> U64(32))).min(1), out=least)
            return (_mix(least) >> U64(64 - BITS)).astype(np.uint16).tobytes()

    @staticmethod
    def rows(signatures: list | pa.Array) -> np.ndarray:
        data = b"".join(s if isinstance(s, bytes) else s.as_buffer() for s in signatures)
        return np.frombuffer(data, np.uint16).reshape(-1, SYMBOLS)

    @classmethod
    def possible(cls, a: pa.Array, b: pa.Array, sizes: np.ndarray, percent: int) -> np.ndarray:
        return (cls.rows(a) != cls.rows(b)).sum(1) <= Layout(percent).radius

    @classmethod
    def stacked(cls, signatures: list) -> tuple[np.ndarray]:
        return (cls.rows(signatures),)

    @staticmethod
    def near(stack: tuple[np.ndarray], a: int, others: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        fits = 100 * np.minimum(n[a], n[others]) >= percent * np.maximum(n[a], n[others])
        out = np.zeros(len(others), bool)
        out[fits] = (stack[0][others[fits]] != stack[0][a]).sum(1) <= Layout(percent).radius
        return out


def chunk_keys(signatures: np.ndarray, layout: Layout) -> np.ndarray:
    """Keys of each row: of each chunk without each of its symbols in turn. The last byte is the chunk."""
    c, m = layout.size, layout.chunks
    chunks = signatures.reshape(-1, m, c).astype(U64)
    with np.errstate(over="ignore"):
        parts = _mix(chunks * FACTORS[:c, 0] + OFFSETS[:c, 0])
        keys = parts.sum(2, dtype=U64)[:, :, None] - parts
        keys = _mix(keys + (np.arange(m, dtype=U64)[:, None] << U64(32)) + np.arange(c, dtype=U64))
    return ((keys & ~U64(255)) | np.arange(m, dtype=U64)[:, None]).reshape(len(signatures), -1).view(np.int64)


class HammingJoin(Join):
    """The join by signatures: its own sketches and keys, all else as ``Join``."""

    sketch = Signature

    def allot(self) -> None:
        self.layout = Layout(self.percent)

    def enough(self) -> Column:
        """Keys of ``NEED`` chunks."""
        return F.expr(f"bit_count(bit_or(shiftleft(1L, CAST(pmod(key, 256) AS INT)))) >= {NEED}")

    def band(self) -> Column:
        return F.lit(0)

    def slack(self) -> Column:
        return F.lit(self.layout.slack)

    def keyed(self) -> DataFrame:
        """key, cls of every class, from its signature."""
        layout = self.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    keys = chunk_keys(Signature.rows(part.column(1)), layout)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "cls"])

        rows = self.known.join(self.copies(), F.col("id") == F.col("__skipped"), "left_anti")
        return rows.select("cls", "sketch").mapInArrow(lean(run), "key long, cls long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """For each row id, text_hash, n_shingles, cls, comp (least class that links reach), component_id (least id so) and
    kept: whether the row's id is its component's."""
    out = near_duplicates(docs, doc_id, text, words, percent, HammingJoin)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
