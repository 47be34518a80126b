"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen if the least hash among its s-mers is the first or the last
one. That depends on the k-mer alone, so equal passages give equal anchors wherever they
stand. A document's fingerprint keeps every anchor of its text in order of position, so it grows
with the text: five bytes each (the hash and the gap to the anchor before, which is never above
K - S), in base64. Two anchors that follow each other at the same gap in both documents match at
one shift; an anchor is common if it does so with the one before or after it (where a document has
one anchor only, if its hash is in the other). Likeness is the Jaccard index of the anchors: common
ones over all of both, repeated ones as often as they stand; ``aligned`` gives the shift at which
most anchors match.

Defined cases: a text without a closed syncmer (all shorter than k, some of up to 38 characters) is one anchor by
its own hash; null and empty texts have the
empty fingerprint, which is like itself (1) and unlike any other (0); equal texts have equal
fingerprints; documents that repeat an id follow each other in order of their text; an empty
table gives no rows; only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, put, with_columns

K, S = 24, 8
ANCHOR = np.dtype([("hash", "<u4"), ("gap", "u1")])
#: Characters of one batch of results.
BATCH_CHARS = 8 << 20
#: Ranges of ids: small ones for even tasks, larger ones where there would be too many edges for the driver.
SMALL_PART, LARGE_PART, SMALL_PARTS = 16 << 20, 1 << 30, 50_000
NO_ID, NAMES = -(1 << 63), ["part", "id", "key", "text", "halo"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def smer_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash for each S code points in a row, by doubling: of 2, 4 and 8."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + np.uint64(1)
        for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            x = x[:-step] * np.uint64(factor) + (x[step:] ^ (x[step:] >> np.uint64(31)))
        return _mix(x)


def own_anchor(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A whole text as one anchor."""
    own = int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=4).digest(), "little")
    return np.array([own], np.uint32), np.zeros(1, np.int64)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash (32 bits) and position of the text's closed syncmers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(codes) < K:
        return own_anchor(codes)
    with np.errstate(over="ignore"):
        smers = smer_hashes(codes)
        n = K - S + 1  # s-mers of a k-mer
        least = smers
        for step in (1, 2, 4, 8):  # least of 16
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[:-1], least[1:])  # of 17
        ends = len(smers) - n + 1
        at = np.flatnonzero((smers[:ends] == least) | (smers[n - 1 :] == least))
        hashes = _mix(smers[at] + smers[at + S] * np.uint64(0x9E3779B97F4A7C15) + smers[at + 2 * S] * np.uint64(0xC2B2AE3D27D4EB4F))
    return (hashes >> np.uint64(32)).astype(np.uint32), at


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All anchors in order of position: hashes and positions. Every text but the empty one has some: up to 38 characters
    may hold no closed syncmer, and then are one anchor as a whole."""
    text = text or ""
    found = anchors(text)
    if len(found[0]) or not text:
        return found
    return own_anchor(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    out = np.empty(len(print_[0]), ANCHOR)
    out["hash"], out["gap"] = print_[0], np.diff(print_[1], prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(base64.b64decode(text), ANCHOR)
    return got["hash"].astype(np.uint32), np.cumsum(got["gap"], dtype=np.int64)


def _links(a: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One number for each two anchors that follow each other: their hashes and the gap."""
    hashes = a[0].astype(np.uint64)
    return ((hashes[:-1] << np.uint64(32)) | hashes[1:]) ^ (np.diff(a[1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    known = np.sort(y)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _matched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """How many anchors of each match the other's at a common shift."""
    if len(a[0]) == 1 or len(b[0]) == 1:
        return int(_in(a[0], b[0]).sum()), int(_in(b[0], a[0]).sum())
    x, y = _links(a), _links(b)
    counts = []
    for links, others in ((x, y), (y, x)):
        both = np.zeros(len(links) + 2, bool)
        both[1:-1] = _in(links, others)
        counts.append(int((both[1:] | both[:-1]).sum()))
    return counts[0], counts[1]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    n, m = len(a[0]), len(b[0])
    if not n or not m:
        return float(n == m)
    common = sum(_matched(a, b)) / 2
    return common / (n + m - common)


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(shift, anchors that match at it): the shift from a to b that most pairs of equal anchors agree on."""
    if not len(a[0]) or not len(b[0]):
        return 0, 0
    order = np.argsort(b[0], kind="stable")
    hashes, at, least = b[0][order], b[1][order], int(a[1][-1])
    votes = np.zeros(least + int(b[1][-1]) + 1, np.int64)
    for p, i, j in zip(a[1].tolist(), np.searchsorted(hashes, a[0], "left").tolist(), np.searchsorted(hashes, a[0], "right").tolist()):
        votes[at[i:j] - p + least] += 1
    most = int(votes.max())
    return (min((np.flatnonzero(votes == most) - least).tolist(), key=lambda v: (abs(v), v)), most) if most else (0, 0)


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_chars and fingerprint; input columns of such names are replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(batch.schema.names.index(text))]
            yield put(batch, ["n_chars", "fingerprint"], [pa.array([len(x) for x in texts], pa.int64()), pa.array([written(fingerprint(x)) for x in texts], pa.string())])

    return docs.mapInArrow(lean(run), with_columns(docs, "n_chars long, fingerprint string"))


def _edges(keys: DataFrame, parts: int) -> np.ndarray:
    """Keys that cut the table into about equal parts, by the distributed quantile sketch."""
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    got = keys.agg(F.percentile_approx("key", shares, 10 * parts).alias("q")).first().q if parts > 1 else []
    return np.unique(np.array(got or [], np.int64))


def _heads(keys: DataFrame, edges: np.ndarray) -> dict[int, int]:
    """The greatest key of each range that has rows: one number for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            part = np.searchsorted(edges, key)
            order = np.lexsort((key, part))
            last = order[np.flatnonzero(np.diff(part[order], append=-1))]
            yield pa.RecordBatch.from_arrays([pa.array(part[last].astype(np.int32)), pa.array(key[last])], names=["part", "key"])

    return {r.part: r.key for r in keys.mapInArrow(run, "part int, key long").groupBy("part").agg(F.max("key").alias("key")).collect()}


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """For every document, in descending order of id, its fingerprint, that of its edited text
    (the last half replaced by the start of the next document; after the last comes the first) and
    its likeness to both: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are cut into ranges by approximate quantiles; the greatest row of each range is also
    sent to the range above it, so that every document meets its next one in its own task.
    Null ids come last."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.coalesce("id", F.lit(NO_ID).cast("long")).alias("key"), "text")
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(24, min(SMALL_PARTS, -(-size // SMALL_PART)), -(-size // LARGE_PART))
    edges = _edges(rows.select("key"), parts)
    heads = _heads(rows.select("key"), edges)
    order = sorted(heads, reverse=True)
    goes_to = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # the first range's head also ends the last one

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1)
            part = np.searchsorted(edges, key.to_numpy()).astype(np.int32)
            halo = [i for i, k in enumerate(key.to_pylist()) if k in goes_to]
            own = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *own, pa.array(np.zeros(len(part), bool))], names=NAMES)
            if halo:
                to = pa.array([goes_to[key[i].as_py()] for i in halo], pa.int32())
                yield pa.RecordBatch.from_arrays([to, *(c.take(pa.array(halo)) for c in own), pa.array([True] * len(halo))], names=NAMES)

    dealt = rows.mapInArrow(deal, "part int, id long, key long, text string, halo boolean")
    # one range a task: hashed range numbers would meet in one task and leave others empty
    dealt = dealt.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions("part", "halo", F.desc("key"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held, held_part, closed = None, None, None
        cols: tuple[list, ...] = ([], [], [], [], [], [], [])
        chars = 0
        for batch in batches:
            for part, id_, text, halo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                if halo and closed == part:
                    continue  # rows that repeat the head's id: the first of them is the next document
                text = text.as_py()
                print_ = fingerprint(text)
                if held is not None and held_part == part:
                    own_id, own, own_print = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    other = fingerprint(edited)
                    row = (own_id, len(own), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(own_print), written(other), likeness(own_print, other), likeness(own_print, print_))
                    for col, v in zip(cols, row):
                        col.append(v)
                    chars += len(row[3]) + len(row[4])
                    if chars > BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                        cols, chars = ([], [], [], [], [], [], []), 0
                closed = part if halo else None
                held, held_part = (None if halo else (id_, text, print_)), part
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            cols, chars = ([], [], [], [], [], [], []), 0

    return dealt.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
