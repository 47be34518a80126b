"""Ranked lexical search by dual-sorted wavelet trees.

Documents are cut into shards of at most ``SHARD_DOCS`` documents and ``SHARD_POSTINGS`` postings as they are read.
In a shard documents are numbered by their ids, and the postings of all terms form one sequence: term by term,
and by falling impact within a term. A wavelet matrix holds that sequence: a bit plane for each binary digit of the
document number, high digits first, each plane sorting the next one's sequence stably by its bit. So a range of the
sequence (a term's list) maps to its documents in any half of a document range by counting bits, and stays
sorted by impact: the first posting of a mapped range is the largest impact that the term has in that subtree.

A query starts with the ranges of its terms at the root. A node's bound is the weighted sum of the first
impacts of its ranges; at a leaf (one document) it is the score. Nodes are opened best first, ``OPENED`` at a time,
until none reaches the k-th best score found; a task carries its best k from shard to shard. Results are exact.

An impact is all of the score that depends on the document: (1000000000 * tf) div (1000 * tf + 12 * m), where
m = 75 + (25 * n * N) div L follows the length n of a document, the number N of documents with terms and all their
terms L, which are counted before the index is built. A term weighs floor(1000 * ln((2 N + 2) / (2 df + 1))).

Queries go to the tasks in blocks of at most ``BLOCK_BYTES`` of terms, each of them a pass over the index.

Defined cases: null texts and texts without terms are in no result; equal scores go by document id (rows that repeat an id
are documents of their own, in any order); scores of 0 are left out; items without terms and null item ids have no
results; rows that repeat an item id are one item with the terms of all; empty tables give no rows; documents without an
id (kept as the least 64-bit number) come out with a null id, first among equals; other columns are left out.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, saved

SHARD_DOCS, SHARD_POSTINGS = 2048, 400_000
NO_ID = -(1 << 63)
OPENED, BLOCK_BYTES = 512, 8 << 20
#: Bytes of a UTF-8 text as terms have them: A-Z lower-cased, what belongs to no term a space.
FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def collection(docs: DataFrame, text: str) -> tuple[int, int]:
    """(N, L), summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(terms_of(v.as_py())) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(c > 0 for c in counts)]), pa.array([sum(counts)])], names=["docs", "terms"])

    row = docs.select(text).mapInArrow(lean(run), "docs long, terms long").agg(F.sum("docs").alias("N"), F.sum("terms").alias("L")).first()
    return row.N or 0, row.L or 0


def impacts(tf: np.ndarray, n: np.ndarray, N: int, L: int) -> np.ndarray:
    """Python's integers where 64 bits would not hold 25 n N."""
    if len(n) and int(n.max()) * N * 25 >= 1 << 62:
        m = np.array([75 + 25 * int(x) * N // L for x in n], np.int64)
    else:
        m = 75 + 25 * n * N // max(L, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Shard:
    """One shard: document ids by number, terms, where their lists start, impacts, bit planes."""

    FIELDS = "docs binary, terms binary, starts binary, impacts binary, planes binary"
    NAMES = ["docs", "terms", "starts", "impacts", "planes"]

    def __init__(self, docs: np.ndarray, terms: list[bytes], starts: np.ndarray, impact: np.ndarray, bits: list[np.ndarray]):
        self.docs, self.terms, self.starts = docs, terms, starts
        n, self.levels = len(impact), len(bits)
        self.ones, self.zeros, self.top = np.zeros((self.levels, n + 1), np.int32), np.zeros(self.levels, np.int64), np.zeros((self.levels + 1, n + 1), np.int32)
        self.top[0, :n] = impact
        for k, bit in enumerate(bits):
            np.cumsum(bit, out=self.ones[k, 1:])
            zeros = n - int(self.ones[k, n])
            self.zeros[k] = zeros
            self.top[k + 1, :zeros], self.top[k + 1, zeros:n] = self.top[k, :n][bit == 0], self.top[k, :n][bit != 0]
        self.flat_ones, self.flat_top, self.width = self.ones.reshape(-1), self.top.reshape(-1), n + 1

    @staticmethod
    def pack(docs: np.ndarray, number: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: list[bytes]) -> tuple[bytes, ...]:
        """The fields of a shard from its postings (document number, term number, impact)."""
        order = np.lexsort((number, -impact, term))
        number, impact = number[order], impact[order]
        starts = np.searchsorted(term[order], np.arange(len(terms) + 1)).astype(np.int32)
        planes, sequence = [], number
        for shift in range(max(1, int(len(docs) - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(np.uint8)
            planes.append(np.packbits(bit))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        return docs.tobytes(), b" ".join(terms), starts.tobytes(), impact.astype(np.int32).tobytes(), np.concatenate(planes).tobytes()

    @classmethod
    def unpack(cls, docs: bytes, terms: bytes, starts: bytes, impact: bytes, planes: bytes) -> Shard:
        impact_, docs_ = np.frombuffer(impact, np.int32), np.frombuffer(docs, np.int64)
        n, width = len(impact_), -(-len(impact_) // 8)
        packed = np.frombuffer(planes, np.uint8).reshape(-1, width)
        return cls(docs_, terms.split(b" "), np.frombuffer(starts, np.int32), impact_, [np.unpackbits(p, count=n) for p in packed])

    def best(self, left: np.ndarray, right: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of the k best with a score of ``least`` at least, for the terms whose lists are [left, right)."""
        lo, hi, level, number = left[None].astype(np.int64), right[None].astype(np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self._bound(lo, hi, level, weights)
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            open_ = bound >= least
            if not open_.all():
                lo, hi, level, number, bound = lo[open_], hi[open_], level[open_], number[open_], bound[open_]
                if not len(bound):
                    break
            now = np.arange(len(bound)) if len(bound) <= OPENED else np.argpartition(-bound, OPENED)[:OPENED]
            rest = np.ones(len(bound), bool)
            rest[now] = False
            at = (level[now] * self.width)[:, None]
            ones_lo, ones_hi = self.flat_ones[at + lo[now]].astype(np.int64), self.flat_ones[at + hi[now]].astype(np.int64)
            zeros = self.zeros[level[now]][:, None]
            new_lo = np.concatenate([lo[now] - ones_lo, zeros + ones_lo])
            new_hi = np.concatenate([hi[now] - ones_hi, zeros + ones_hi])
            new_level = np.tile(level[now] + 1, 2)
            new_number = np.concatenate([2 * number[now], 2 * number[now] + 1])
            new_bound = self._bound(new_lo, new_hi, new_level, weights)
            leaf = (new_level == self.levels) & (new_bound >= least)
            if leaf.any():
                scores, docs = np.concatenate([scores, new_bound[leaf]]), np.concatenate([docs, self.docs[new_number[leaf]]])
                if len(scores) > k:
                    best = np.lexsort((docs, -scores))[:k]
                    scores, docs = scores[best], docs[best]
                if len(scores) == k:
                    least = max(least, int(scores.min()))
            inner = (new_level < self.levels) & (new_bound >= least)
            lo, hi = np.concatenate([lo[rest], new_lo[inner]]), np.concatenate([hi[rest], new_hi[inner]])
            level, number = np.concatenate([level[rest], new_level[inner]]), np.concatenate([number[rest], new_number[inner]])
            bound = np.concatenate([bound[rest], new_bound[inner]])
        return scores, docs

    def _bound(self, lo: np.ndarray, hi: np.ndarray, level: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (np.where(lo < hi, self.flat_top[(level * self.width)[:, None] + lo], 0) * weights).sum(1, dtype=np.int64)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: tuple[int, int] | None = None) -> DataFrame:
    """One row a shard (``Shard.FIELDS``) over all documents with terms; ``size`` is (N, L), counted where it is not given."""
    N, L = size or collection(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, number, term, tf, known = [], [], [], [], [], {}

        def close() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            terms = sorted(known)
            rank = np.empty(len(terms), np.int64)
            rank[[known[t] for t in terms]] = np.arange(len(terms))
            counts = np.array([len(t) for t in term])
            of = np.repeat(np.arange(len(ids)), counts)
            tf_ = np.concatenate(tf)
            impact = impacts(tf_, np.repeat(np.array(lengths, np.int64), counts), N, L)
            fields = Shard.pack(np.array(ids, np.int64)[order], place[of], rank[np.concatenate(term)], impact, terms)
            for held in (ids, lengths, number, term, tf):
                held.clear()
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in fields], names=Shard.NAMES)

        postings = 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(terms_of(value.as_py()))
                if not found:
                    continue
                if ids and (len(ids) == SHARD_DOCS or postings + len(found) > SHARD_POSTINGS):
                    yield close()
                    postings = 0
                ids.append(doc)
                lengths.append(found.total())
                term.append(np.fromiter((known.setdefault(t, len(known)) for t in found), np.int64, len(found)))
                tf.append(np.fromiter(found.values(), np.int64, len(found)))
                postings += len(found)
        if ids:
            yield close()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.col(text))
    return saved(rows.mapInArrow(lean(run), Shard.FIELDS), "wavelet-index")


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term (binary), times"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, n) for i, value in zip(batch.column(0).to_pylist(), batch.column(1)) for t, n in Counter(terms_of(value.as_py())).items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "times"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text)).where("item_id IS NOT NULL")
    return rows.mapInArrow(lean(run), "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def document_counts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df for the terms of ``wanted`` that the index has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                sizes = np.diff(np.frombuffer(starts.as_buffer(), np.int32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.as_py().split(b" "), pa.binary()), pa.array(sizes)], names=["term", "df"])

    counts = index.select("terms", "starts").mapInArrow(lean(run), "term binary, df long")
    return counts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def search_block(index: DataFrame, block: list, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of each task for the items of ``block`` (item_id, term, factor)."""
    items: dict[int, dict[bytes, int]] = {}
    for row in block:
        items.setdefault(row.item_id, {})[bytes(row.term)] = row.factor
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item in sent.value}
        for batch in batches:
            for row in zip(*batch.columns):
                shard = Shard.unpack(*(x.as_buffer().to_pybytes() if name == "terms" else x.as_buffer() for name, x in zip(Shard.NAMES, row)))
                at = {t: i for i, t in enumerate(shard.terms)}
                for item, factors in sent.value.items():
                    here = [(at[t], w) for t, w in factors.items() if t in at]
                    if not here:
                        continue
                    place, weights = np.array([p for p, _ in here]), np.array([w for _, w in here], np.int64)
                    scores, docs = best[item]
                    least = int(scores[-1]) if len(scores) == k else 1
                    found = shard.best(shard.starts[place], shard.starts[place + 1], weights, k, least)
                    scores, docs = np.concatenate([scores, found[0]]), np.concatenate([docs, found[1]])
                    order = np.lexsort((docs, -scores))[:k]
                    best[item] = scores[order], docs[order]
        for item, (scores, docs) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(docs), pa.int64()), pa.array(docs), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(lean(run), "item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, size: tuple[int, int], item_id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item; ``size`` is the (N, L) of the index."""
    terms = saved(query_terms(items, item_id, text), "search-terms")
    counts = document_counts(index, terms)
    weight = F.floor(1000 * F.log((2 * F.lit(size[0]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    factors = terms.join(counts, "term").select("item_id", "term", (F.col("times") * weight).alias("factor")).where("factor > 0")
    factors = saved(factors, "search-factors")
    total = factors.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    found = [saved(search_block(index, factors.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect(), k), "search-best") for b in range(blocks)]
    best = functools.reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index and search in one: the k best documents (doc_id, text) of each item (item_id, text)."""
    size = collection(docs, "text")
    return search(build_index(docs, size=size), items, size, k=k)
