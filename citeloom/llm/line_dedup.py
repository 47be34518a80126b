"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents.

A first pass hashes every line of at least ``min_chars`` code points (stripped of ASCII
white space, A-Z lower-cased) to 128 bits and counts, per hash, the documents that hold
it. Hashes of ``min_docs`` or more documents are dealt to shards; each shard is turned into a
minimal perfect hash with three flat arrays behind it: fingerprints, counts and keepers
(largest document id). Documents then probe those arrays; lines are never joined.

* Where all arrays together are small (measured, ``BROADCAST_BYTES``), each task gets them.
* Otherwise hashes of lines, not texts, travel to the shard's task. A shard with many
  probes gets as many salted copies as its summed counts ask for, and probes stream by.

Defined cases: a null text counts one empty line and stays null; a null document id is
smaller than every other; rows that repeat a document id count as so many documents and,
if theirs is the largest id, all keep the line; an empty table gives an empty result; input
columns called ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, SPACE, lean, put, saved, with_columns

NO_ID = -(1 << 63)
KEYS_PER_SHARD = 100_000
PROBES_PER_TASK = 2_000_000


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """For every line its 128-bit hash, or None where it is too short to count."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(SPACE)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None)
    return out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 128-bit keys, another one for each level."""
    a, b = keys[:, 0].view(np.uint64), keys[:, 1].view(np.uint64)
    with np.errstate(over="ignore"):
        x = a ^ (b + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * level + 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: in each level the keys that are alone
    in their cell stay, the others go on to the next level; a key's index is its cell's rank."""

    GAMMA, LEVELS = 1.6, 32

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, self.size = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - 1 + self.size
            self.ranks.append(ranks)
            self.size += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < cls.LEVELS:
            cells = max(64, int(cls.GAMMA * len(keys)))
            at = (_mixed(keys, len(levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; any index or -1 for a key that was not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        for i in left if len(self.rest) else ():
            found = np.flatnonzero((self.rest == keys[i]).all(axis=1))
            if len(found):
                out[i] = self.size + found[0]
        return out


class LineArrays:
    """One shard: the perfect hash and its fingerprint, count and keeper arrays."""

    def __init__(self, hash_: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hash, self.fingerprints, self.counts, self.keepers = hash_, fingerprints, counts, keepers

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineArrays:
        hash_ = PerfectHash.build(keys)
        at = hash_.index(keys)
        arrays = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
        for array, values in zip(arrays, (keys[:, 1], np.minimum(counts, 0xFFFFFFFF), keepers)):
            array[at] = values
        return cls(hash_, *arrays)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and keeper of each key; count 0 where the fingerprint says that it is another's."""
        at = self.hash.index(keys)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == keys[known, 1]
        counts, keepers = np.zeros(len(keys), np.int64), np.full(len(keys), NO_ID, np.int64)
        counts[known], keepers[known] = self.counts[at[known]], self.keepers[at[known]]
        return counts, keepers

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(
            out, rest=self.hash.rest, f=self.fingerprints, c=self.counts, k=self.keepers,
            sizes=np.array([len(x) for x in self.hash.levels], np.int64),
            **{f"l{i}": np.packbits(x) for i, x in enumerate(self.hash.levels)},
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineArrays:
        z = np.load(io.BytesIO(data))
        levels = [np.unpackbits(z[f"l{i}"], count=int(n)).astype(bool) for i, n in enumerate(z["sizes"])]
        return cls(PerfectHash(levels, z["rest"]), z["f"], z["c"], z["k"])


def count_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2, n (documents that hold the line), keeper; each Arrow batch adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                id_ = NO_ID if id_ is None else id_
                for h in set(line_hashes(value.as_py(), min_chars)) - {None}:
                    known = seen.get(h)
                    if known is None:
                        seen[h] = [1, id_]
                    else:
                        known[0] += 1
                        known[1] = max(known[1], id_)
            keys = _halves(list(seen))
            n = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[:, 0], keys[:, 1], n[:, 0], n[:, 1])], names=["h1", "h2", "n", "keeper"])

    parts = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(count), "h1 long, h2 long, n long, keeper long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def build_index(lines: DataFrame, min_docs: int) -> DataFrame:
    """shard, n_shards, salts, index: one row of arrays for each shard of the hashes of lines that ``min_docs`` documents hold."""
    lines = saved(lines.where(F.col("n") >= min_docs), "line-counts")
    n_shards = max(64, -(-lines.count() // KEYS_PER_SHARD))

    def build(pdf):
        import pandas as pd

        keys = np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(np.int64))
        arrays = LineArrays.build(keys, pdf["n"].to_numpy(np.int64), pdf["keeper"].to_numpy(np.int64))
        salts = -(-int(pdf["n"].sum()) // PROBES_PER_TASK)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_shards": [n_shards], "salts": [salts], "index": [arrays.dump()]})

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    return saved(dealt.groupBy("shard").applyInPandas(build, "shard int, n_shards int, salts int, index binary"), "line-index")


def _cut(batch: pa.RecordBatch, text: str, names: list[str], hashes: list[list[bytes | None]], dropped: list[set]) -> pa.RecordBatch:
    texts, n_lines, n_dropped = [], [], []
    for value, keys, gone in zip(batch.column(batch.schema.names.index(text)), hashes, dropped):
        n_lines.append(len(keys))
        n_dropped.append(sum(h in gone for h in keys) if gone else 0)
        value = value.as_py()
        texts.append("\n".join(x for x, h in zip(value.split("\n"), keys) if h not in gone) if gone and value is not None else value)
    return put(batch, [text, *names], [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())])


def _probe_with_copies(docs: DataFrame, index: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([(r.shard, r.n_shards, bytes(r["index"])) for r in index.collect()])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {shard: LineArrays.load(data) for shard, _, data in held.value}
        n_shards = held.value[0][1] if held.value else 1
        for batch in batches:
            hashes = [line_hashes(x.as_py(), min_chars) for x in batch.column(batch.schema.names.index(text))]
            ids = [NO_ID if x is None else x for x in batch.column(batch.schema.names.index(doc_id)).to_pylist()]
            flat = [(h, i) for i, keys in enumerate(hashes) for h in set(keys) - {None}]
            dropped: list[set] = [set() for _ in hashes]
            if flat and shards:
                keys = _halves([h for h, _ in flat])
                shard_of = np.mod(keys[:, 0], n_shards)
                order = np.argsort(shard_of, kind="stable")
                cuts = np.flatnonzero(np.diff(shard_of[order])) + 1
                for at in np.split(order, cuts):
                    arrays = shards.get(int(shard_of[at[0]]))
                    if arrays is not None:
                        counts, keepers = arrays.probe(keys[at])
                        for j in np.flatnonzero(counts >= min_docs):
                            h, i = flat[at[j]]
                            if ids[i] != keepers[j]:
                                dropped[i].add(h)
            yield _cut(batch, text, ["n_lines", "n_dropped"], hashes, dropped)

    return docs.mapInArrow(lean(probe), with_columns(docs, f"{text} string, n_lines long, n_dropped long"))


def _probe_in_shards(docs: DataFrame, index: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    n_shards = index.select(F.coalesce(F.max("n_shards"), F.lit(1))).first()[0]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, rows = [], [], []
            for id_, row, value in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2)):
                own = list(set(line_hashes(value.as_py(), min_chars)) - {None})
                keys += own
                ids += [NO_ID if id_ is None else id_] * len(own)
                rows += [row] * len(own)
            pair = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["id", "row", "h1", "h2"])

    # a row is known by its id and its text's hash: rows that share an id, or have none, keep lists of their own
    probes = docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(lean(hashes), "id long, row long, h1 long, h2 long").withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    probes = probes.join(index.select("shard", "salts"), "shard").select("shard", F.pmod(F.xxhash64("id", "row"), "salts").cast("int").alias("salt"), "id", "row", "h1", "h2", F.lit(None).cast("binary").alias("index"))
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.lit(None).cast("long").alias(c) for c in ("id", "row", "h1", "h2")), "index")
    both = copies.unionByName(probes)
    both = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("index").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, shard = None, None
        for batch in batches:
            shards, index_at = batch.column(0).to_numpy(), batch.schema.names.index("index")
            fresh = batch.column(index_at).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(fresh).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and fresh[a]:
                    arrays, shard = LineArrays.load(batch.column(index_at)[a].as_py()), shards[a]
                    a += 1
                if b <= a:
                    continue
                part = batch.slice(a, b - a)
                assert arrays is not None and (part.column(0).to_numpy() == shard).all()
                keys = np.column_stack([part.column("h1").to_numpy(), part.column("h2").to_numpy()])
                counts, keepers = arrays.probe(keys)
                yield part.select(["id", "row", "h1", "h2"]).filter(pa.array((counts >= min_docs) & (part.column("id").to_numpy() != keepers)))

    gone = both.mapInArrow(lean(probe), "id long, row long, h1 long, h2 long").distinct()
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("h1", "h2")).alias("__gone"))  # a text's lines at most
    same = (F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col("__id")) & (F.xxhash64(text) == F.col("__row"))
    joined = docs.join(gone, same, "left").drop("__id", "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("__gone")
            dropped = [{np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in x or ()} for x in batch.column(at).to_pylist()]
            batch = batch.drop_columns(["__gone"])
            hashes = [line_hashes(x.as_py(), min_chars) for x in batch.column(batch.schema.names.index(text))]
            yield _cut(batch, text, ["n_lines", "n_dropped"], hashes, dropped)

    return joined.mapInArrow(lean(cut), with_columns(docs, f"{text} string, n_lines long, n_dropped long"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the lines dropped that at least ``min_docs`` documents hold, except in the
    one with the largest id, and with n_lines (before) and n_dropped."""
    index = build_index(count_lines(docs, doc_id, text, min_chars), min_docs)
    size = index.select(F.coalesce(F.sum(F.length("index")), F.lit(0))).first()[0]
    probe = _probe_with_copies if size <= broadcast_bytes else _probe_in_shards
    return probe(docs, index, doc_id, text, min_docs, min_chars)
