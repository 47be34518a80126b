"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Inputs of a score are the text's hashed words, statistics of its form, and the numeric metadata
columns that ``train`` is given (the logarithm of each, and whether it is null). The machine has a bias, linear weights and ``RANK`` factors for each input; pairwise interactions
are scored in linear time, as half of (sum of v x)^2 - sum of (v x)^2. It is fitted by the
driver on at most ``fit_rows`` labelled rows, the same ones in each run (smallest hash of the
id), and then scores all documents in Arrow batches.

Defined cases: null and empty texts are scored like any text (all inputs 0); null labels are not
fitted; repeated rows are scored alike; without a label of both kinds every score is the share of
label 1 (0.5 without labels); an empty table gives no rows; input columns named ``score`` or
``predicted`` are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, put, saved, with_columns

HASHED, RANK, FIT_ROWS = 256, 6, 12_000
UPPER, LOWER, DIGIT = (bytes(range(*x)) for x in ((65, 91), (97, 123), (48, 58)))
STOPS, SYMBOLS, SPACES = b".,;:'\"?-()", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\x0b\x0c\r"
STATS = 18


def features(text: str | None, words_seen: dict[str, int], metadata: tuple = ()) -> np.ndarray:
    """Structure statistics, hashed words by the root of their share, metadata by logarithm."""
    x = np.zeros(STATS + HASHED + 2 * len(metadata), np.float32)
    for i, value in enumerate(metadata):
        missing = value is None or value != value
        x[STATS + HASHED + 2 * i] = missing
        x[STATS + HASHED + 2 * i + 1] = 0 if missing else math.copysign(math.log1p(min(abs(value), 1e300)), value) / 12
    words = (text or "").split()
    n = len(words)
    if not n:
        return x
    data = text.encode("utf-8", "replace")
    size = len(data)
    upper, lower, digit, stops, symbols, spaces = ((size - len(data.translate(None, c))) / size for c in (UPPER, LOWER, DIGIT, STOPS, SYMBOLS, SPACES))
    counts = Counter(words)
    lines = [v for v in text.split("\n") if v.strip()]
    top = [c for _, c in counts.most_common(3)]
    letters = max(upper + lower, 1e-3)
    x[:STATS] = (
        1.0, math.log1p(n) / 8, math.log1p(size / n) / 2, upper, min(upper / letters, 1), lower, digit, stops, symbols, spaces,
        math.log1p(len(counts)) / math.log1p(n), top[0] / n, sum(top) / n, sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))) / 6, min(data.count(b"|") / n, 1), min(1, symbols * 10),
    )
    for word, count in counts.items():
        at = words_seen.get(word)
        if at is None:
            if len(words_seen) > 200_000:
                words_seen.clear()
            at = words_seen[word] = STATS + zlib.crc32(word.lower().encode("utf-8", "replace")) % HASHED
        x[at] += count
    x[STATS : STATS + HASHED] = np.sqrt(x[STATS : STATS + HASHED] / n)
    return x


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray, metadata: tuple[str, ...] = ()):
        self.bias, self.linear, self.factors, self.metadata = bias, linear, factors, metadata

    def margin(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((s * s).sum(1) - (x * x) @ (self.factors * self.factors).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x.astype(np.float64)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 0.03, penalty: float = 2e-4, rank: int = RANK) -> Machine:
    """Logistic loss, Adam over all rows at once; the same rows give the same machine."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.001), 0.999)
        return Machine(math.log(share / (1 - share)), np.zeros(x.shape[1]), np.zeros((x.shape[1], rank)))
    x = x.astype(np.float64)
    m = Machine(0.0, np.zeros(x.shape[1]), np.random.default_rng(7).normal(0, 0.05, (x.shape[1], rank)))
    p = [np.zeros(1), m.linear, m.factors]
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    squares = x * x
    for t in range(1, steps + 1):
        m.bias = p[0][0]
        sums = x @ p[2]
        g = (1 / (1 + np.exp(-np.clip(m.margin(x), -30, 30))) - y) / len(y)
        grads = [np.array([g.sum()]), x.T @ g + penalty * p[1], x.T @ (g[:, None] * sums) - (squares.T @ g)[:, None] * p[2] + penalty * p[2]]
        for v, d, a, b in zip(p, grads, first, second):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            v -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    m.bias = float(p[0][0])
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _numbers(metadata: tuple[str, ...]) -> list[Column]:
    return [F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(metadata)]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, metadata: tuple[str, ...] = ()) -> Machine:
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__y"))
    ids = saved(known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows), "fm-ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            x = [features(v.as_py(), seen, meta).tobytes() for v, *meta in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[3:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(x, pa.binary())], names=["id", "y", "x"])

    # the ids are at most fit_rows numbers, so they can go to every task
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), *_numbers(metadata)).join(F.broadcast(ids), "__id").select("__id", "__text", "__y", *(f"__m{i}" for i in range(len(metadata)))).mapInArrow(lean(read), "id long, y int, x binary")
    got = sorted(rows.dropDuplicates(["id"]).limit(fit_rows).collect(), key=lambda r: r.id)
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), STATS + HASHED + 2 * len(metadata))
    machine = fit(x, np.array([r.y for r in got], np.float64))
    machine.metadata = tuple(metadata)
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from the threshold on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            known = [batch.column(batch.schema.names.index(f"__m{i}")).to_pylist() for i in range(len(machine.metadata))]
            meta = list(zip(*known)) if known else [()] * len(column)
            s = np.zeros(len(column))
            for at in range(0, len(column), 1000):
                s[at : at + 1000] = machine.score(np.stack([features(v.as_py(), seen, m) for v, m in zip(column.slice(at, 1000), meta[at : at + 1000])]))
            batch = batch.drop_columns([f"__m{i}" for i in range(len(machine.metadata))])
            yield put(batch, ["score", "predicted"], [pa.array(s), pa.array((s >= threshold).astype(np.int32))])

    return docs.select("*", *_numbers(machine.metadata)).mapInArrow(lean(run), with_columns(docs, "score double, predicted int"))
