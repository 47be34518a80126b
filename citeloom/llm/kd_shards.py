"""K-d tree sharding with DataFrame functions only.

Equal texts form a group, which is never split. Groups carry metadata coordinates; a node of
the tree is split along its widest coordinate at the weighted median of bytes, until every
leaf is one shard. A median is found by radix refinement: histograms of up to 4,096 cells per node
are added up by the executors, and the cell that holds the median is refined. Coordinates end in bits of the group's hash, so ties on a coordinate (a
source with a third of all rows) can be split anywhere.

Defined cases: a null text is an empty one: size 1, one group with the empty texts; null metadata count as
the smallest value; repeated rows are rows of their own in the same shard; a group larger than a
shard's share stays whole, and its shard is that much larger; an empty table gives no
rows; input columns named ``size``, ``text_crc32``, ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, text_of

VALUE_BITS, HASH_BITS, DIGIT_BITS = 31, 31, 12
#: Cells of all nodes' histograms that the driver reads at once, at most (beyond 4,096 nodes 16 for each).
MOST_CELLS = 1 << 16
#: A median is fine enough when the cell that holds it has this share of the node's bytes.
TOLERANCE = 1 / 4096
ROWS_PER_BUCKET = 250_000


def _number(df: DataFrame, name: str) -> Column:
    """A metadata column as a number that keeps its order: strings by their first six bytes."""
    if dict(df.dtypes)[name] == "string":
        code = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    else:
        code = F.col(name).cast("double")
    return F.coalesce(code, F.lit(-1.0))


def _spread(groups: DataFrame, dims: list[str]) -> DataFrame:
    """Coordinates c0, c1, ...: the value scaled to VALUE_BITS, then bits of the group's hash."""
    ends = groups.agg(*(f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    top, cols = (1 << VALUE_BITS) - 1, []
    for i, d in enumerate(dims):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        scaled = F.floor((F.col(d) - lo) / (hi - lo) * top) if hi > lo else F.lit(0)
        bits = F.pmod(F.xxhash64(F.col("group_id"), F.lit(i)), F.lit(1 << HASH_BITS))
        cols.append(F.shiftleft(scaled.cast("long"), HASH_BITS).bitwiseOR(bits).alias(f"c{i}"))
    return groups.select("group_id", "bytes", "rows", *cols)


def _with(points: DataFrame, rows: list[tuple[int, ...]], names: str) -> DataFrame:
    """``points`` with what the driver knows of each node: a row of numbers for each, at most as many as shards."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return points.join(F.broadcast(points.sparkSession.sql(f"SELECT * FROM VALUES {values} AS known({names})")), "node")


def _coordinate(dims: int) -> Column:
    """The coordinate with the number in column ``dim``."""
    return reduce(lambda c, i: c.when(F.col("dim") == i, F.col(f"c{i}")), range(1, dims), F.when(F.col("dim") == 0, F.col("c0")))


def _medians(points: DataFrame, dims: int, at: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node {id: (coordinate, share)} the largest key of its lower part."""
    prefix, below = dict.fromkeys(at, 0), dict.fromkeys(at, 0)
    total: dict[int, int] = {}
    cut: dict[int, int] = {}
    left = VALUE_BITS + HASH_BITS
    while left > 0 and len(cut) < len(at):
        open_ = [n for n in at if n not in cut]
        step = min(left, DIGIT_BITS, max(4, (MOST_CELLS // len(open_)).bit_length() - 1))
        left -= step
        asked = _with(points, [(n, at[n][0], prefix[n]) for n in open_], "node, dim, prefix")
        key = asked.select("node", "prefix", "bytes", _coordinate(dims).alias("key")).where(F.shiftright("key", left + step) == F.col("prefix"))
        cells: dict[int, list] = {n: [] for n in open_}
        for r in key.groupBy("node", F.shiftright("key", left).alias("cell")).agg(F.sum("bytes").alias("bytes")).collect():
            cells[r.node].append((r.cell, r.bytes))
        for n in open_:
            own = sorted(cells[n])
            total.setdefault(n, sum(b for _, b in own))
            goal, done = total[n] * at[n][1], below[n]
            for cell, size in own:
                if done + size >= goal or cell == own[-1][0]:
                    if size <= TOLERANCE * total[n] or not left:
                        upper = done + size - goal <= goal - done
                        cut[n] = ((cell + upper) << left) - 1
                    prefix[n], below[n] = cell, done
                    break
                done += size
    return cut


def kd_tree(groups: DataFrame, dims: list[str], n_shards: int) -> DataFrame:
    """group_id, bytes, rows, shard. The node of each group is a column that every level writes anew,
    so plans stay as small for a thousand shards as for two; there are log2 of the shards levels."""
    points = saved(_spread(groups, dims).withColumn("node", F.lit(0).cast("long")), "kd-points")
    leaves = {0: (0, n_shards)}  # node: its shards
    while any(hi - lo > 1 for lo, hi in leaves.values()):
        extents = points.groupBy("node").agg(*(F.max(f"c{i}") - F.min(f"c{i}") for i in range(len(dims)))).collect()
        widest = {r[0]: max(range(len(dims)), key=lambda i: (r[i + 1] or 0, -i)) for r in extents}
        at = {n: (widest[n], ((hi - lo) // 2) / (hi - lo)) for n, (lo, hi) in leaves.items() if hi - lo > 1 and n in widest}
        cut = _medians(points, len(dims), at) if at else {}
        parts, rows = {}, []
        for n, (lo, hi) in leaves.items():
            if n in cut:
                mid = lo + (hi - lo) // 2
                low, high = len(parts), len(parts) + 1
                parts[low], parts[high] = (lo, mid), (mid, hi)
                rows.append((n, at[n][0], cut[n], low))
            else:  # a leaf, or a node without rows: nothing is above this cut
                rows.append((n, 0, 1 << 62, len(parts)))
                parts[len(parts)] = (lo, lo + 1)
        split = _with(points, rows, "node, dim, cut, low")
        node = F.col("low") + (_coordinate(len(dims)) > F.col("cut")).cast("long")
        points = saved(split.select("group_id", "bytes", "rows", *(f"c{i}" for i in range(len(dims))), node.alias("node")), "kd-points")
        leaves = parts
    shards = _with(points, [(n, lo) for n, (lo, _) in leaves.items()], "node, shard")
    return shards.select("group_id", "bytes", "rows", F.col("shard").cast("int").alias("shard"))


def shard_documents(
    docs: DataFrame, n_shards: int = 8, target_bytes: int | None = None, text: str = "text", order: str = "doc_id",
    dims: tuple[str, ...] = ("doc_id", "n_chars", "source", "lang"), columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (``columns`` of it; all by default) with size (UTF-8 bytes of the
    text plus 1), text_crc32, shard and slot (gapless from 0 within a shard). With ``target_bytes``
    the number of shards follows from the bytes."""
    own = ("size", "text_crc32", "shard", "slot")
    keep = [c for c in (columns or docs.columns) if c not in own]
    dims = tuple(d for d in dims if d in docs.columns) or (order,)
    full = docs.withColumns({
        "__size": (F.octet_length(text_of(text)) + 1).cast("long"), "__crc": F.crc32(F.encode(text_of(text), "UTF-8")),
        "__group": F.xxhash64(text_of(text)), **{f"__d{i}": _number(docs, d) for i, d in enumerate(dims)},
    })
    groups = full.groupBy(F.col("__group").alias("group_id")).agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"), *(F.min(f"__d{i}").alias(f"d{i}") for i in range(len(dims))))
    groups = saved(groups, "kd-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if target_bytes:
        n_shards = max(1, -(-total[0] // target_bytes))
    tree = kd_tree(groups, [f"d{i}" for i in range(len(dims))], n_shards)
    buckets = max(64, -(-total[1] // (n_shards * ROWS_PER_BUCKET)))
    rows = full.select(*keep, F.col(order).alias("__order"), "__size", "__crc", "__group").join(tree.select(F.col("group_id").alias("__group"), F.col("shard").alias("__shard")), "__group")
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__order", "__crc"), F.lit(buckets)).cast("int")).drop("__group")
    rows = saved(rows, "kd-rows")
    counts = rows.groupBy("__shard", "__bucket").agg(F.count("*").alias("__n"))
    starts = counts.selectExpr("__shard", "__bucket", "sum(__n) OVER (PARTITION BY __shard ORDER BY __bucket) - __n AS __start")
    slot = F.expr("row_number() OVER (PARTITION BY __shard, __bucket ORDER BY __order, __crc) - 1 + __start")
    return rows.join(starts, ["__shard", "__bucket"]).select(*keep, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"), slot.cast("long").alias("slot"))
