"""Exact set-similarity join of documents by word n-grams: universe partition and pigeonhole.

A document is the set of its distinct word n-grams (as 64-bit hashes). Sets that are equal
form a class, and only classes are joined.

"Verify exactly" is by these 64-bit hashes: two different n-grams of two compared documents pass for one with a
chance of 2^-64 each.

Candidates. Sizes are cut into bands. Two sets of Jaccard index t or more, the smaller one (of
band k, at most U) and the larger one, differ in at most H = U (1 - t) / t elements. The universe is
cut by hash into m segments, and each band has the cheaper of two allocations (``allocate``):

* subsets: m = H + NEED + slack segments. At most H of them can differ, so NEED + slack at least are
  equal. Every set leaves out its ``slack`` keys of the largest buckets (empty segments, common
  passages). By that one order of keys, what either set of a pair leaves out is a prefix of the keys that
  they share, so they still share NEED;
* deletions: m = H / 2 + 1 segments, indexed with their one-deletion neighbourhoods. One of them at
  least differs in one element or none, so a pair shares the key of a segment or of a segment less one element.

A set is indexed in its own band and probes the bands of the sizes that it can match. Keys are sums
of element hashes, so a deletion is a subtraction.

Verification. Keys travel without the sets. In a sorted stream of keys every key has a
leader, its least member; buckets over ``BUCKET`` members are led by the member with the most keys that it
shares with others. Round one verifies members against leaders (linear in the number of keys) and
takes components of the links found. Round two verifies the pairs of different components
that remain: in small buckets pair by pair, and in large ones by leader, in
blocks whose pairs are counted inside the task and leave it as a spanning forest. No pair of a bucket
is skipped, and none is emitted for a large one. Before sets are sent anywhere, ``Sketch`` rules out
pairs by a bound that never exceeds their true difference.

Defined cases: null and empty texts have no elements and are linked with nothing; a text of fewer words
than n is one element; rows without an id take no part and are components of their own (null); rows that
repeat an id are documents of their own; an empty table gives no rows; other input columns pass through,
those named ``n_shingles`` or ``component_id`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, saved

BUCKET, BLOCK = 32, 384
#: Elements of the sets of one block, and words whose hashes a task keeps.
BLOCK_ELEMENTS, KNOWN_WORDS = 1_000_000, 100_000
BAND_RATIO, SLACK, NEED = 1.35, 4, 3
#: Links of one document that meet in one place, at most.
HUB = 4096
#: Rows of one or two numbers that are few enough to be sent to all tasks (some 64 bytes each in a hashed relation).
BROADCAST_IDS = 500_000
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text (A-Z lower-cased, ASCII white space)."""

    FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 32, dtype=np.uint64) * U64(2) + U64(1)

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, U64)
        known = self.known
        new = [w for w in {*words} if w not in known]
        if len(known) + len(new) > KNOWN_WORDS:
            self.known, new = {}, [*{*words}]
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(self.known.__getitem__, words), U64, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, n, U64)
            for i in range(n):
                total += _mix(h[i : len(h) - n + 1 + i] * self.FACTORS[i])
            return np.unique(_mix(total))


class Sketch:
    """Counts and sums (mod 256) of a set's hashes in about n / 4 cells: two bytes a cell. Cells halve by adding
    neighbours, so sketches of two sizes compare."""

    @staticmethod
    def of(elements: np.ndarray) -> bytes:
        bits = max(0, int(np.ceil(np.log2(max(len(elements), 1) / 4)))) if len(elements) > 4 else 0
        with np.errstate(over="ignore"):
            values = _mix(elements + U64(0xE7037ED1A0B428DB))
        cell = (values >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(elements), np.int64)
        counts = np.minimum(np.bincount(cell, minlength=1 << bits), 255).astype(np.uint8)
        sums = np.bincount(cell, weights=(values & U64(255)).astype(np.float64), minlength=1 << bits).astype(np.int64) % 256
        return counts.tobytes() + sums.astype(np.uint8).tobytes()

    @staticmethod
    def cells(data, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums, folded to ``size`` cells."""
        both = np.frombuffer(data, np.uint8).astype(np.int16).reshape(2, -1)
        if size is not None and size < both.shape[1]:
            both = both.reshape(2, size, -1).sum(2)
        return both[0], both[1] % 256

    @staticmethod
    def bound(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """At most the size of the symmetric difference: a cell differs by its counts, or by two if only its sum does."""
        more = np.abs(a[0] - b[0])
        return (more + 2 * ((more == 0) & (a[1] != b[1]))).sum(-1, dtype=np.int64)

    @classmethod
    def possible(cls, a: pa.Array, b: pa.Array, sizes: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs of sketches (of sets of so many elements together) may reach the similarity."""
        least = np.zeros(len(sizes), np.int64)
        for k, (x, y) in enumerate(zip(a, b)):
            x, y = x.as_buffer(), y.as_buffer()
            cells = min(len(x), len(y)) // 2
            least[k] = cls.bound(cls.cells(x, cells), cls.cells(y, cells))
        return (100 + percent) * least <= (100 - percent) * sizes

    @classmethod
    def stacked(cls, sketches: list) -> tuple[np.ndarray, np.ndarray]:
        size = min(len(s) for s in sketches) // 2
        cells = [cls.cells(s, size) for s in sketches]
        return np.stack([c for c, _ in cells]), np.stack([c for _, c in cells])

    @classmethod
    def near(cls, stack: tuple[np.ndarray, np.ndarray], a: int, others: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others in a stack may reach the similarity with its row ``a``."""
        bound = cls.bound((stack[0][a], stack[1][a]), (stack[0][others], stack[1][others]))
        return (100 + percent) * bound <= (100 - percent) * (n[a] + n[others])


def class_of(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


class Bands:
    """Size bands and their allocations for a similarity of percent / 100."""

    def __init__(self, percent: int, counts: dict[int, int] | None = None, largest: int = 1 << 31):
        self.percent, self.edges = percent, [1]
        while self.edges[-1] <= largest:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_RATIO)))
        self.plans = [self.allocate(k, (counts or {}).get(k, 1)) for k in range(len(self.edges) - 1)]

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def partners(self, size: int) -> range:
        """The bands of the sizes from the least that can match up to the size itself."""
        least = -(-size * self.percent // 100)
        return range(self.band(least), self.band(size) + 1)

    def slack(self, k: int, h: int) -> int:
        """Segments more than needed: about as many as are empty in the band's least sets."""
        m, slack = h + NEED + SLACK, SLACK
        for _ in range(8):
            slack = min(SLACK + h // 4, SLACK + int(np.ceil(1.3 * m * np.exp(-self.edges[k] / m))))
            m = h + NEED + slack
        return slack

    def allocate(self, k: int, sets: int) -> tuple[int, bool, int]:
        """(segments, deletions?, slack) for a band with about so many sets: the way with fewer keys and chance candidates."""
        size = self.edges[k + 1] - 1
        h = size * (100 - self.percent) // self.percent
        if not h:
            return 0, False, 0  # only equal sets, which are one class
        slack = self.slack(k, h)
        subsets, deletions = h + NEED + slack, h // 2 + 1
        empty = lambda m: m * np.exp(-size / m)  # noqa: E731  segments that chance leaves empty
        costs = (
            subsets + 50 * sets * (max(0.0, empty(subsets) - slack) / subsets) ** 2 + (sets if size < 2.5 * subsets else 0),
            deletions + size + 50 * sets * deletions * np.exp(-2 * size / deletions) * (1 + 2 * size / deletions),
        )
        return (subsets, False, slack) if costs[0] <= costs[1] else (deletions, True, 0)

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """Keys of a set in all its bands; the last bit is 1 where a pair has to share NEED of them, seven bits
        before it are the band."""
        out = []
        with np.errstate(over="ignore"):
            values = _mix(elements ^ U64(0xA0761D6478BD642F))
            spread = _mix(elements)
            for k in self.partners(len(elements)):
                m, deletions, _ = self.plans[k]
                if not m:
                    continue
                segment = (spread >> U64(32)) * U64(m) >> U64(32)
                order = np.argsort(segment, kind="stable")
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(values[order], dtype=U64)])
                at = np.searchsorted(segment[order], np.arange(m + 1, dtype=U64))
                total = sums[at[1:]] - sums[at[:-1]]
                place = _mix(np.arange(m, dtype=U64) + U64(k << 40))
                if deletions:
                    s = segment.astype(np.int64)
                    out.append(_mix(np.concatenate([total + place, total[s] - values + place[s]])) & ~U64(255) | U64(2 * k))
                else:
                    out.append(_mix(total + place) & ~U64(255) | U64(2 * k + 1))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, sketch: type = Sketch) -> DataFrame:
    """id, text_hash, n, cls (0 without elements), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            n, cls, sketches = [], [], []
            for value in batch.column(2):
                elements = shingle(value.as_py())
                n.append(len(elements))
                cls.append(class_of(elements) if len(elements) else 0)
                sketches.append(sketch.of(elements))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketches, pa.binary())], names=["id", "text_hash", "n", "cls", "sketch"])

    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(lean(run), "id long, text_hash long, n long, cls long, sketch binary")


def keys_of(texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    """key, cls for each key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, keys, classes, held = Shingler(words), [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(classes, np.int64), [len(k) for k in keys]))], names=["key", "cls"])

        for batch in batches:
            for value in batch.column(0):
                elements = shingle(value.as_py())
                if len(elements):
                    keys.append(bands.keys(elements))
                    classes.append(class_of(elements))
                    held += len(keys[-1])
                    if held > 300_000:
                        yield rows()
                        keys, classes, held = [], [], 0
        if keys:
            yield rows()

    return texts.mapInArrow(lean(run), "key long, cls long")


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, cls) to key, pos, cls, leader for the keys of several classes; the leader is the least class.
    A stream: a bucket is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, leader, next pos, class, written
        for batch in batches:
            key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            again = np.zeros(len(key), bool)  # rows that repeat a class
            again[1:] = (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])
            if last and len(key):
                again[0] = key[0] == last[0] and cls[0] == last[3]
            key, cls = key[~again], cls[~again]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.append(first, len(key)))
            run_of = np.repeat(np.arange(len(first)), length)
            leader, pos0, several = cls[first].copy(), np.zeros(len(first), np.int64), length > 1
            extra = None
            if last and last[0] == key[0]:
                leader[0], pos0[0], several[0] = last[1], last[2], True
                if not last[4]:
                    extra = (last[0], 0, last[1], last[1])
            last = (key[-1], leader[-1], pos0[-1] + length[-1], cls[-1], bool(several[-1]))
            keep = several[run_of]
            pos = np.arange(len(key)) - first[run_of] + pos0[run_of]
            cols = [c[keep] for c in (key, pos, cls, leader[run_of])]
            if extra:
                cols = [np.append(c, np.array([e], np.int64)) for c, e in zip(cols, extra)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "pos", "cls", "leader"])

    dealt = keyed.repartition("key").sortWithinPartitions("key", "cls")
    return dealt.mapInArrow(lean(run), "key long, pos long, cls long, leader long")


class Join:
    """One run of the join: its documents, parameters and written tables."""

    sketch = Sketch

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, percent: int):
        self.docs, self.doc_id, self.text, self.words, self.percent = docs.where(F.col(doc_id).isNotNull()), doc_id, text, words, percent
        self.all = saved(signatures(docs, doc_id, text, words, self.sketch), "jaccard-sets")
        self.known = self.all.where("n > 0 AND id IS NOT NULL")
        self.classes = self.known.groupBy("cls")
        self.allot()

    def allot(self) -> None:
        # how many sets a band has, on a scale of sixteen steps for each factor e: enough to weigh allocations
        counted = self.known.groupBy(F.floor(F.log(F.col("n").cast("double")) * 16).alias("scale")).agg(F.count("*").alias("n")).collect()
        sizes, counts = Bands(self.percent), {}
        for r in counted:
            band = sizes.band(max(1, round(np.exp((r.scale + 0.5) / 16))))
            counts[band] = counts.get(band, 0) + r.n
        self.bands = Bands(self.percent, counts)

    def enough(self) -> Column:
        """Aggregate: are the keys that a pair shares as many as it needs?"""
        need = F.when(F.pmod("key", F.lit(2)) == 1, NEED).otherwise(1)
        return F.count("*") >= F.min(need)

    def band(self) -> Column:
        """The keys of a class among which it leaves out ``slack`` of the largest."""
        return F.pmod(F.shiftright("key", 1), F.lit(128)).cast("int")

    def slack(self) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for k, (_, _, slack) in enumerate(self.bands.plans) for x in (k, slack))), F.col("band"))

    def copies(self) -> DataFrame:
        """Ids of documents all of whose rows are copies of others (__skipped)."""
        copied = self.classes.agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
        rows = self.known.select("id", "cls").join(copied, "cls", "left").groupBy("id").agg(F.min(F.coalesce(F.col("id") != F.col("first"), F.lit(False))).alias("copy"))
        skipped = saved(rows.where("copy").select(F.col("id").alias("__skipped")), "jaccard-copies")
        return few(skipped)

    def keyed(self) -> DataFrame:
        """key, cls of every class: documents all of whose rows are copies of others are left out."""
        skipped = self.copies()
        texts = self.docs.join(skipped, F.col(self.doc_id).cast("long") == F.col("__skipped"), "left_anti").select(self.text)
        return keys_of(texts, self.words, self.bands)

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """cls, elements for the classes in ``wanted`` (cls): their texts are read and cut again."""
        holders = saved(self.classes.agg(F.min("id").alias("id")).join(wanted.distinct(), "cls", "left_semi"), "jaccard-wanted")
        ids = holders.select(F.col("id").alias("__wanted")).distinct()
        if holders.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(words)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    sets = [shingle(v.as_py()) for v in batch.column(1).slice(at, 500)]
                    yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "elements"])

        rows = self.docs.select(F.col(self.doc_id).cast("long").alias("__id"), self.text).join(ids, F.col("__id") == F.col("__wanted"), "left_semi")
        sets = rows.mapInArrow(lean(run), "cls long, elements binary")
        return saved(sets.join(holders.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "jaccard-elements")

    def sketches_of(self, wanted: DataFrame) -> DataFrame:
        return self.known.select("cls", "n", "sketch").join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and sketches do not rule out."""
        percent, sketch = self.percent, self.sketch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(sketch.possible(batch.column(3), batch.column(5), sizes, percent)))

        sketches = self.sketches_of(_ends(pairs))
        side = lambda c: sketches.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
        both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return saved(both.mapInArrow(lean(run), "a long, b long"), "jaccard-likely")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the similarity."""
        percent = self.percent
        pairs = self.likely(pairs)
        sets = self.sets_of(_ends(pairs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    same = len(x) + len(y) - len(np.union1d(x, y))
                    good.append(100 * same >= percent * (len(x) + len(y) - same))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")

    def links_in_blocks(self, members: DataFrame) -> DataFrame:
        """Links between different components inside the groups (leader, cls, comp), as a spanning forest for each
        pair of blocks. Sketches go to the blocks first; only members that they leave a partner send their sets."""
        percent, sketch = self.percent, self.sketch
        sketches = self.sketches_of(members)
        members = members.join(sketches, "cls")
        sizes = members.groupBy("leader").agg(F.count("*").alias("g"), F.sum("n").alias("elements"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        blocks = F.ceil(F.greatest(F.col("g") / BLOCK, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
        dealt = members.select("leader", "cls", "comp").join(sizes.select("leader", blocks.alias("blocks")), "leader")
        own = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
        dealt = dealt.withColumn("own", own).select("leader", "cls", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp", "own")

        def apart(rows: list[tuple], i: int, j: int) -> np.ndarray:
            """Pairs that are to be compared: of two components and, in a pair of blocks, one of each."""
            comp, side = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            out = comp[:, None] != comp[None]
            return out & (side[:, None] != side[None]) if i != j else out

        def close(rows: list[tuple], i: int, j: int) -> list[tuple]:
            """The rows whose sketch leaves them a partner."""
            stack = sketch.stacked([r[3] for r in rows])
            n, open_ = np.array([r[4] for r in rows]), apart(rows, i, j)
            kept = np.zeros(len(rows), bool)
            for a in range(len(rows)):
                other = np.flatnonzero(open_[a])
                if len(other):
                    kept[a] = sketch.near(stack, a, other, n, percent).any()
            return [(r[0], r[1], r[2]) for r, k in zip(rows, kept) if k]

        def linked(rows: list[tuple], i: int, j: int) -> list[tuple[int, int]]:
            sets_ = [np.frombuffer(r[3], U64) for r in rows]
            n = np.array([len(s) for s in sets_])
            tokens, inverse, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(rows)), n)
            shared = times[inverse] > 1
            column = (np.cumsum(times > 1) - 1)[inverse[shared]]
            row, width = row[shared], int((times > 1).sum())
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            same = np.zeros((len(rows), len(rows)), np.float32)
            for a in range(0, width, 2048):
                lo, hi = np.searchsorted(column, [a, a + 2048])
                x = np.zeros((len(rows), min(2048, width - a)), np.float32)
                x[row[lo:hi], column[lo:hi] - a] = 1
                same += x @ x.T
            same = same.astype(np.int64)
            good = (100 * same >= percent * (n[:, None] + n[None] - same)) & apart(rows, i, j)
            parent = {r[1]: r[1] for r in rows}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            out = []
            for a, b in zip(*np.nonzero(np.triu(good, 1))):
                ra, rb = root(rows[a][1]), root(rows[b][1])
                if ra != rb:
                    parent[ra] = rb
                    out.append((rows[a][0], rows[b][0]))
            return out

        def by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list]]:
            """(leader, i, j) and its rows (cls, comp, own and what else comes), from a sorted stream."""
            group, held = None, []
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in range(6)]
                more = [batch.column(c) for c in range(6, width)]
                for k, (leader, i, j, *row) in enumerate(zip(*cols)):
                    if (leader, i, j) != group:
                        if len(held) > 1:
                            yield group, held
                        group, held = (leader, i, j), []
                    held.append((*row, *(m[k].as_py() for m in more)))
            if len(held) > 1:
                yield group, held

        def run_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["leader", "i", "j", "cls", "comp", "own"]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            for (leader, i, j), rows in by_group(batches, 8):
                cols = list(zip(*((leader, i, j, *r) for r in close(rows, i, j)))) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

        def run_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, i, j), rows in by_group(batches, 7):
                found = linked(rows, i, j)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        key = ["leader", "i", "j"]
        sorted_ = lambda df: df.repartition(*key).sortWithinPartitions(*key, "cls")
        sketched = dealt.join(sketches, "cls").select(*key, "cls", "comp", "own", "sketch", "n")
        left = saved(sorted_(sketched).mapInArrow(lean(run_close), "leader long, i int, j int, cls long, comp long, own int"), "jaccard-close")
        full = left.join(self.sets_of(left.select("cls")), "cls").select(*key, "cls", "comp", "own", "elements")
        return sorted_(full).mapInArrow(lean(run_linked), "a long, b long")

    def labels(self) -> DataFrame:
        """cls, comp for all classes that are linked with another."""
        shared = saved(buckets(self.keyed()), "jaccard-buckets")
        # keys of buckets over BUCKET; few, as each has that many members
        counted = shared.select("key", "cls", F.count("*").over(Window.partitionBy("cls")).alias("k"))
        large_keys = counted.groupBy("key").agg(F.count("*").alias("g"), F.max_by("cls", F.struct("k", "cls")).alias("centre")).where(F.col("g") > BUCKET)
        large_keys = few(saved(large_keys.select("key", "g", "centre"), "jaccard-large-keys"))
        members = saved(shared.join(large_keys, "key", "left").withColumn("large", F.col("g").isNotNull()), "jaccard-members")
        nth = F.row_number().over(Window.partitionBy("cls", "band").orderBy(F.desc("g"), "key"))
        large = members.where("large").select("key", "cls", F.col("centre").alias("leader"), "g", self.band().alias("band")).withColumn("nth", nth)
        large = saved(large.where(F.col("nth") > self.slack()).select("leader", "cls").distinct(), "jaccard-led")
        small = members.where("NOT large").select("key", "cls", "leader", "pos")
        stars = small.where("pos > 0").groupBy(F.col("leader").alias("a"), F.col("cls").alias("b")).agg(self.enough().alias("enough"))
        stars = stars.where("enough").select("a", "b").unionByName(large.where("leader <> cls").select(F.col("leader").alias("a"), F.col("cls").alias("b")))
        stars = saved(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-stars")
        first = saved(self.links(stars), "jaccard-links")
        comps = components(first)
        labelled = lambda df: df.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        small = labelled(small.select("key", "cls"))
        open_ = small.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        small = saved(small.join(open_, "key", "left_semi"), "jaccard-open")
        left, right = (small.select("key", *(F.col(c).alias(f"{c}{k}") for c in ("cls", "comp"))) for k in (1, 2))
        pairs = left.join(right, "key").where("cls1 < cls2 AND comp1 <> comp2")
        pairs = pairs.groupBy(F.col("cls1").alias("a"), F.col("cls2").alias("b")).agg(self.enough().alias("enough"))
        pairs = saved(pairs.where("enough").select("a", "b").join(stars, ["a", "b"], "left_anti"), "jaccard-pairs")
        second = saved(self.links(pairs).unionByName(self.links_in_blocks(labelled(large))), "jaccard-links")
        return components(first.unionByName(second))


def few(table: DataFrame) -> DataFrame:
    """A written table, sent to all tasks by joins where it is measured to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def components(links: DataFrame) -> DataFrame:
    """cls, comp (its component's least cls) for every end of a link. Each round takes the least label
    among neighbours and then the label's label, so a path halves; rounds end when no label changes. An end with more
    than ``HUB`` links gives its label to so many parts of them at a time."""
    edges = links.where("a <> b").select("a", "b")
    edges = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-ends")
    hubs = few(saved(edges.groupBy("b").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts")).where("salts > 1"), "component-hubs"))
    edges = edges.join(hubs, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "salts"), F.lit(0)).cast("int").alias("salt"))
    edges = saved(edges, "component-edges")
    labels = saved(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "component-labels")
    while True:
        at_b = labels.select(F.col("cls").alias("b"), "comp").join(hubs, "b", "left")
        at_b = at_b.select("b", "comp", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        around = edges.join(at_b, ["b", "salt"]).groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        hop = labels.join(around, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        new = saved(hop.join(jump, "comp", "left").select("cls", "old", F.least("comp", "far").alias("comp")), "component-labels")
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("cls", "comp")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, way: type[Join] = Join) -> DataFrame:
    """For each row id, text_hash, n_shingles, cls, comp (least class that links reach), component_id (least id so)."""
    join = way(docs, doc_id, text, words, percent)
    labelled = join.all.drop("sketch").join(join.labels(), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    labelled = saved(labelled, "jaccard-labelled")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    least = labelled.where(linked).groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    least = few(saved(least, "jaccard-least"))
    out = labelled.join(least, "comp", "left")
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"), "cls", "comp", F.when(linked, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of its least id (of rows that repeat the id, the one whose
    text has the least hash; of rows that repeat both, one). Rows without elements or id stay."""
    found = near_duplicates(docs, doc_id, text, words, percent).where("n_shingles > 0 AND id IS NOT NULL")
    groups = found.groupBy("comp").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.count("*").alias("size")).where("size > 1")
    rows = saved(found.select("comp", "id", "text_hash").join(groups, "comp"), "jaccard-groups")
    stays = (F.col("id") == F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = rows.where(~stays).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = (F.col(doc_id).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    out = docs.join(gone, same, "left_anti")
    again = rows.where(stays).groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.limit(1).count():
        repeated = docs.join(again, same).dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
        out = out.join(again, same, "left_anti").unionByName(repeated)
    return out
