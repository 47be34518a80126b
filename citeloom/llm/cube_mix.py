"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is its weighted share of all sizes, at most ``max_repeat`` times its own
size; what exceeds that is shared out again by weight. Every document is taken floor(ratio)
times, ratio = target / source size, and once more with probability ratio - floor(ratio). Who
gets the extra copy is drawn with the cube method, balanced on sizes and document counts:
three documents with fractional probabilities move along the null space of the two
constraints until one of them is 0 or 1; its place goes to the next document. That flight runs
in every (source, salt) stream with three documents of memory and leaves at most two
undecided; those fly again in ever fewer streams until a source has one. Its last two land at the
nearest whole number, and the last few hundred make up for that in both constraints.

Draws come from hashes of the document, so reruns agree. Defined cases: null texts have size
0; a null id or source is a value of its own (its source comes last); repeated rows are
documents of their own (which of the rows that repeat in all columns gets a copy more makes no
difference); a source without any words has target 0; an empty table gives no
rows; input columns named ``size``, ``source_size``, ``target``, ``copies`` or ``taken`` are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, lean, put, saved, text_of, with_columns, word_count

ROWS_PER_STREAM, STREAMS = 10_000, 64
#: What a joined row of a key and its copies takes in memory, at most.
SAMPLED_BYTES = 128
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: list[float], max_repeat: float) -> list[float]:
    """Water-filling: shares by weight, those above ``max_repeat`` sizes stop there and the
    excess goes to the others by weight, until none is above."""
    total = float(sum(n for _, n in sizes))
    out = [0.0] * len(sizes)
    open_ = [i for i, (_, n) in enumerate(sizes) if n > 0]
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > max_repeat * sizes[i][1]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = max_repeat * float(sizes[i][1])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


class Flight:
    """The cube method's flight for one stream; a unit is [probability, size, draw, payload]."""

    def __init__(self) -> None:
        self.open: list[list] = []

    def add(self, unit: list) -> Iterator[list]:
        """Takes a unit in; gives out those that are decided."""
        if unit[0] <= EPS or unit[0] >= 1 - EPS:
            unit[0] = float(round(unit[0]))
            yield unit
            return
        self.open.append(unit)
        if len(self.open) == 3:
            yield from self._move()

    def _move(self) -> Iterator[list]:
        a, b, c = self.open
        u = (b[1] - c[1], c[1] - a[1], a[1] - b[1])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - x[0]) / v if v > 0 else x[0] / -v for x, v in zip(self.open, u) if v)
        down = min(x[0] / v if v > 0 else (1 - x[0]) / -v for x, v in zip(self.open, u) if v)
        step = up if c[2] * (up + down) < down else -down
        for x, v in zip(self.open, u):
            x[0] += step * v
        done = [x for x in self.open if x[0] <= EPS or x[0] >= 1 - EPS]
        self.open = [x for x in self.open if EPS < x[0] < 1 - EPS]
        for x in done:
            x[0] = float(round(x[0]))
        yield from done

    def land(self) -> list[list]:
        """The last two to the nearest whole sum of sizes, ties to fewer."""
        if not self.open:
            return []
        goal = sum(x[0] * x[1] for x in self.open)
        ways = [[(k >> i) & 1 for i in range(len(self.open))] for k in range(1 << len(self.open))]
        best = min(ways, key=lambda w: (abs(sum(v * x[1] for v, x in zip(w, self.open)) - goal), sum(w)))
        for x, v in zip(self.open, best):
            x[0] = float(v)
        return self.open


def repair(units: list[list], size: float, count: float) -> None:
    """Turns units over until their number and the sum of their sizes are as near to what is missing
    of both as they can be: first single units, while the number is out by one or more, then pairs
    of one in and one out, which leave the number as it is."""
    sizes = np.array([x[1] for x in units], np.float64)
    taken = np.array([x[0] == 1 for x in units], bool)
    while round(count):
        up = count > 0
        able = np.flatnonzero(taken != up)
        if not len(able):
            break
        at = able[np.abs((size if up else -size) - sizes[able]).argmin()]
        taken[at] = up
        size, count = size - (sizes[at] if up else -sizes[at]), count - (1 if up else -1)
    for _ in range(len(units)):
        out, in_ = np.flatnonzero(~taken), np.flatnonzero(taken)
        if not len(out) or not len(in_):
            break
        gain = sizes[out][:, None] - sizes[in_][None]
        a, b = divmod(int(np.abs(size - gain).argmin()), len(in_))
        if abs(size - gain[a, b]) >= abs(size):
            break
        taken[out[a]], taken[in_[b]] = True, False
        size -= gain[a, b]
    for x, value in zip(units, taken):
        x[0] = float(value)


def _units(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[int, tuple, list]]:
    column = lambda c: batch.column(batch.schema.names.index(c)).to_pylist()
    for i, (p, size, draw, *key) in enumerate(zip(column("__p"), column("__size"), column("__draw"), *map(column, by))):
        yield i, tuple(key), [p, size, draw, i]


def _fly(df: DataFrame, by: list[str]) -> DataFrame:
    """__p moved towards 0 or 1 in each stream of equal ``by`` (rows come sorted by it); two rows of a stream may stay between."""

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, now = Flight(), None
        for batch in batches:
            p = batch.column(batch.schema.names.index("__p")).to_numpy().copy()
            ready = np.ones(len(p), bool)
            late: list[tuple[pa.RecordBatch, float]] = []

            def settle(units, p=p, ready=ready, late=late):
                for value, _, _, at in units:
                    if isinstance(at, int):
                        p[at], ready[at] = value, True
                    else:
                        late.append((at[0], value))

            for i, key, unit in _units(batch, by):
                if key != now:
                    settle(flight.open)
                    flight, now = Flight(), key
                ready[i] = False
                settle(flight.add(unit))
            for unit in flight.open:  # their rows wait alone, so that the batch can leave
                if isinstance(unit[3], int):
                    unit[3] = (batch.slice(unit[3], 1),)
            yield put(batch, ["__p"], [pa.array(p)]).filter(pa.array(ready))
            for row, value in late:
                yield put(row, ["__p"], [pa.array([value])])
        for value, _, _, at in flight.open:
            yield put(at[0], ["__p"], [pa.array([value])])

    return df.mapInArrow(lean(fly), with_columns(df, "__p double"))


def _land(df: DataFrame, by: list[str], kept: int = 512) -> DataFrame:
    """The last flight, over the few rows that streams left: all __p to 0 or 1. The last ``kept``
    rows of a source stay at hand to make up for what landing adds or takes away."""

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, now, held, missing = Flight(), None, deque(), [0.0, 0.0]

        def row(unit: list) -> pa.RecordBatch:
            return put(unit[3], ["__p"], [pa.array([unit[0]])])

        def finish() -> Iterator[pa.RecordBatch]:
            units = [*held, *flight.land()]
            repair(units, missing[0] - sum(x[0] * x[1] for x in units), missing[1] - sum(x[0] for x in units))
            yield from map(row, units)

        for batch in batches:
            for i, key, unit in _units(batch, by):
                if key != now:
                    yield from finish()
                    flight, now, held, missing = Flight(), key, deque(), [0.0, 0.0]
                missing[0] += unit[0] * unit[1]
                missing[1] += unit[0]
                unit[3] = batch.slice(i, 1)
                held.extend(flight.add(unit))
                while len(held) > kept:
                    missing[0] -= held[0][0] * held[0][1]
                    missing[1] -= held[0][0]
                    yield row(held.popleft())
        yield from finish()

    return df.mapInArrow(lean(land), with_columns(df, "__p double"))


def source_targets(sizes: DataFrame, max_repeat: float, weight_cycle: tuple[float, ...]) -> DataFrame:
    """source, source_size, target, salts: one row for each source. Shares go round by rank of the
    source, so these rows (some tens of bytes for each source) pass the driver; documents do not."""
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    weights = [weight_cycle[i % len(weight_cycle)] for i in range(len(rows))]
    out = targets([(r.source, r.n) for r in rows], weights, max_repeat)
    data = [(r.source, int(r.n), float(t), max(STREAMS, -(-r.rows // ROWS_PER_STREAM))) for r, t in zip(rows, out)]
    return spark.createDataFrame(data, "source string, source_size long, target double, salts int")


def _sampled(units: DataFrame, max_repeat: float, weight_cycle: tuple[float, ...]) -> DataFrame:
    """``units`` (with __source, __size, __h) and source_size, target, copies."""
    goals = saved(source_targets(units.select(F.col("__source").alias("source"), F.col("__size").alias("size")), max_repeat, weight_cycle), "mix-targets")
    g = goals.select(F.col("source").alias("__s"), "source_size", "target", F.col("salts").alias("__salts"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(g, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s").withColumns({
        "__whole": F.floor(ratio + EPS).cast("int"), "__p": F.greatest(ratio - F.floor(ratio + EPS), F.lit(0.0)),
        "__draw": F.pmod(F.xxhash64("__h", F.lit(2)), F.lit(1 << 52)).cast("double") / float(1 << 52),
    })
    order = [F.desc("__size"), "__h"]  # the largest units are decided first, so what is left to land is small
    undecided = (F.col("__p") > 0) & (F.col("__p") < 1)
    salts, done, level = goals.agg(F.max("salts")).first()[0] or 1, None, 0
    while True:
        level += 1
        own = rows.withColumn("__salt", F.pmod(F.xxhash64("__h", F.lit(level)), "__salts").cast("int"))
        flown = own.repartition("__source", "__salt").sortWithinPartitions("__source", "__salt", *order)
        flown = saved(_fly(flown, ["__source", "__salt"]).drop("__salt"), "mix-flight")
        decided = flown.where(~undecided)
        done = decided if done is None else done.unionByName(decided)
        rows = flown.where(undecided)
        if 2 * salts <= ROWS_PER_STREAM:
            break
        # every stream leaves two units at most: where these are many, they fly again in fewer streams
        salts = -(-2 * salts // ROWS_PER_STREAM)
        rows = rows.withColumn("__salts", F.ceil(2 * F.col("__salts") / ROWS_PER_STREAM).cast("int"))
    last = rows.repartition("__source").sortWithinPartitions("__source", *order)
    done = done.unionByName(_land(last, ["__source"]))
    return done.withColumn("copies", F.col("__whole") + F.col("__p").cast("int")).drop("__whole", "__p", "__draw", "__salts")


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeat: float = 3.0,
    weight_cycle: tuple[float, ...] = (1.0, 2.0, 3.0), size: Column | None = None, columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (``columns`` of it; all by default) with size (words), source_size,
    target (both of the source), copies (whole number, at most ``max_repeat``) and taken = copies x size.

    Texts do not fly: units of a key (128 bits of hash over the row's columns), source and size do, and the
    copies are joined back by key. Only where the text is not asked for, the rows asked for fly themselves."""
    own = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in (columns or docs.columns) if c not in own]
    size = word_count(text_of(text)) if size is None else size
    hashed = [F.col(c) for c in dict.fromkeys([doc_id, source, text, *keep]) if not docs.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    unit = [F.col(source).alias("__source"), size.alias("__size"), F.xxhash64(*hashed).alias("__h")]
    out = [*keep, F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken")]
    if text not in keep:
        rows = saved(docs.select(*keep, *unit), "mix-rows")
        return _sampled(rows, max_repeat, weight_cycle).select(*out)
    keys = ["__h", "__g"]
    rows = docs.select(*keep, *unit, F.xxhash64(F.lit(2), *hashed).alias("__g"))
    units = rows.groupBy(*keys).agg(F.first("__source").alias("__source"), F.first("__size").alias("__size"), F.count("*").alias("__rows"))
    units = saved(units.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int")))), "mix-units")
    sampled = saved(_sampled(units, max_repeat, weight_cycle).drop("__source", "__size", "__nth"), "mix-sampled")
    n, repeated = units.agg(F.count("*"), F.coalesce(F.max("__rows"), F.lit(1))).first()
    once = sampled.where("__rows = 1")
    joined = rows.join(F.broadcast(once) if n * SAMPLED_BYTES <= BROADCAST_BYTES else once, keys).select(*out)
    if repeated > 1:
        # rows that repeat in all columns: one of each meets all the copies of its key
        several = sampled.where("__rows > 1")
        first = rows.join(several.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
        joined = joined.unionByName(first.join(several, keys).select(*out))
    return joined
