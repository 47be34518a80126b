"""Packing documents into training sequences: shortest-pack-first over the length histogram.

A document's ids (and an end id) are cut into whole sequences and one rest. Only the histogram
of rest lengths, at most ``seq_len`` numbers, reaches the driver, where lengths are placed
longest first into the pattern with the most room, updating how many sequences follow each
pattern. Patterns go back to the pieces by rank: a piece's rank among those of its length, found
from counts by write task, falls in exactly one run of pattern places.

Defined cases: a null or empty text has the end id only; repeated rows are packed as rows of
their own; an empty table gives no rows; only ``doc_id`` and the text are read, so other columns,
clashing or not, play no part.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, batches_of, lean, saved

CACHED_WORDS, CACHED_CHARS, PORTION_BYTES, LAID_WORDS = 300_000, 48, 6 << 20, 1 << 17
#: A character that a tokenizer gives an id of its own; words are joined by it to be encoded together.
MARK = "°"
#: Words whose parts can be told without the tokenizer: ASCII and Latin-1 but for spaces; and the
#: tokenizer's own rule for parts, for these characters.
PLAIN = re.compile("[!-~¡-ÿ]{1,48}")
# the byte alphabet of such vocabularies: printable Latin-1 bytes are themselves, the others follow 255
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
ALPHABET = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
#: What these rules hold for: the tokenizer file's own normaliser and splitting, as it states them.
#: A file that states others is used on whole texts.
NORMALIZER = [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")


def rules_of(tokenizer) -> dict:
    """The normaliser and splitting of a tokenizer as its file states them, without its vocabulary, which is large once parsed."""
    stated = {"normalizer": tokenizer.normalizer, "pre_tokenizer": tokenizer.pre_tokenizer}
    return {name: json.loads(step.__getstate__()) for name, step in stated.items() if step is not None}


def splits_by_word(rules: dict) -> bool:
    """Whether a tokenizer's file states the normaliser and splitting that ``PARTS`` stands for."""
    try:
        steps = [(x["type"], x.get("pattern")) for x in rules["normalizer"]["normalizers"]]
        first, second = rules["pre_tokenizer"]["pretokenizers"]
        return steps == NORMALIZER and first["pattern"] == SPLIT and first["behavior"] == "Removed" and first["invert"] and second["type"] == "ByteLevel" and not second["add_prefix_space"]
    except (KeyError, TypeError, ValueError):
        return False


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space: words between spaces are
    encoded alone and remembered, which gives the same ids as the text at once. What is
    remembered goes with the task; a worker process would keep it beside all later ones. Words and
    their parts are remembered together: a part is a word with the same ids, so most words are kept once."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.cached_words = Tokenizer.from_file(path), {}, cached_words
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.model = self.tokenizer.model  # each look-up of it would make a new object
        self.by_word = splits_by_word(rules_of(self.tokenizer))

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> dict[str, bytes]:
        together = [w for w in words if MARK not in w] if len(self.mark) == 1 else []
        out: dict[str, bytes] = {}
        for at in range(0, len(together), 2000):
            part = together[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            if len(ends) == len(part):
                for word, end in zip(part, ends):
                    out[word] = raw[4 * start : 4 * end]
                    start = end + 1
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._alone(rest)) if rest else ())
        return out

    def _part(self, part: str) -> bytes:
        """Ids of one part of a word, by the tokenizer's model; its alphabet stands for bytes."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Words of Latin letters are taken apart as the tokenizer does, for their parts recur more often."""
        out, rest = {}, []
        if len(self.known) > self.cached_words:
            self.known = {}
        known = self.known
        for word in words:
            if word.isascii() and word.isalpha() and len(word) <= CACHED_CHARS:  # one part: most words, told without patterns
                part = word if word.islower() else word.lower()
                if (ids := known.get(part)) is None:
                    ids = known[part] = self._part(part)
                out[word] = ids
                continue
            if not PLAIN.fullmatch(word) or "<|" in word:
                rest.append(word)
                continue
            ids = b""
            for part in PARTS.findall(word.lower()):
                if (own := known.get(part)) is None:
                    own = known[part] = self._part(part)
                ids += own
            out[word] = known[word] = ids
        if rest:
            found = self._together(rest)
            out.update(found)
            known.update((w, ids) for w, ids in found.items() if len(w) <= CACHED_CHARS)
        return out

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Words are split and numbered by Arrow; Python sees each distinct one once. Ids are
        laid out for a few texts at a time."""
        if not self.by_word:
            yield from (np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False))
            return
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # some times faster than to_pylist
        own = [*map(self.known.get, words)]
        new = [w for w, ids in zip(words, own) if ids is None]
        if new:
            found = self._encode(new)
            own = [found[w] if ids is None else ids for w, ids in zip(words, own)]
            del found
        del words, new
        sizes = np.fromiter(map(len, own), np.int32, len(own)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        ids = np.frombuffer(b"".join(own), "<u4")
        del own
        numbers, offsets = numbered.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy() - split.offsets[0].as_py()
        for a, b in steps(offsets[1:], LAID_WORDS):
            word = numbers[offsets[a] : offsets[b]]
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes[word], dtype=np.int32)])
            flat = ids[np.repeat(starts[word] - ends[:-1], sizes[word]) + np.arange(ends[-1], dtype=np.int32)]
            cuts = ends[offsets[a : b + 1] - offsets[a]]
            yield from (flat[i:j] for i, j in zip(cuts, cuts[1:]))


def steps(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, of at least one, that grow the sums ``ends`` by ``size`` at most."""
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, stop
        start = stop


def portions(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text each."""
    return steps(np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), size)


def cut_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int, doc_id: str, text: str, portion_bytes: int = PORTION_BYTES, cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, start, length, doc_tokens, task, nth (among the task's pieces of that length), ids (little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(tokenizer_path, cached_words), np.array([end_id], "<u4").tobytes()
        task, counts = TaskContext.get().partitionId(), [0] * (seq_len + 1)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in portions(texts, portion_bytes):
                cols: tuple[list, ...] = ([], [], [], [], [], [], [])
                for id_, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(texts.slice(a, b - a))):
                    ids = ids.tobytes() + end
                    total = len(ids) // 4
                    for start in range(0, total, seq_len):
                        length = min(seq_len, total - start)
                        row = (id_, start, length, total, task, counts[length], ids[4 * start : 4 * (start + length)])
                        counts[length] += 1
                        for col, v in zip(cols, row):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["doc_id", "start", "length", "doc_tokens", "task", "nth", "ids"],
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(cut), "doc_id long, start long, length long, doc_tokens long, task int, nth long, ids binary")


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(how many sequences, ((length, times), ...)) for each pattern. Lengths come longest
    first; each goes to the open pattern with the least in it."""
    open_: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []  # used, order, parts, count
    out, order, least = [], 0, min(histogram, default=1)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while open_ and seq_len - open_[0][0] < least:
                used, _, parts, count = heapq.heappop(open_)
                out.append((count, parts))
            order += 1
            if open_ and seq_len - open_[0][0] >= length:
                used, _, parts, count = heapq.heappop(open_)
                n = min(left, count)
                if n < count:
                    heapq.heappush(open_, (used, order, parts, count - n))
                    order += 1
                more = parts[:-1] + ((length, parts[-1][1] + 1),) if parts[-1][0] == length else (*parts, (length, 1))
                heapq.heappush(open_, (used + length, order, more, n))
            else:
                fit = max(1, min(seq_len // length, left))
                n = left // fit
                heapq.heappush(open_, (fit * length, order, ((length, fit),), n))
                n *= fit
            left -= n
    return out + [(count, parts) for _, _, parts, count in open_]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, sequences, times, first sequence, offset): runs of ranks of a
    length that fill one place of one pattern."""
    out, rank, sequence = [], {}, 0
    for count, parts in patterns:
        offset = 0
        for length, times in parts:
            first = rank.get(length, 0)
            out.append((length, first, count, times, sequence, offset))
            rank[length] = first + count * times
            offset += length * times
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, portion_bytes: int = PORTION_BYTES, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces with their ids (binary, little-endian unsigned 32-bit): doc_id, start, length,
    doc_tokens, ids, sequence_id, offset. ``portion_bytes`` of text are encoded at once and some ``cached_words``
    remembered between portions: less of both takes less memory and more time, for the same pieces."""
    spark = docs.sparkSession
    with batches_of(spark, portion_bytes):
        pieces = saved(cut_pieces(docs, tokenizer_path, seq_len, end_id, doc_id, text, portion_bytes, cached_words), "pieces")
    counts = saved(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = F.expr("sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    before = saved(counts.select("length", "task", before), "piece-ranks")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs: dict[int, list] = {}
    for length, first, count, times, sequence, offset in places(shortest_pack_first(histogram, seq_len)):
        runs.setdefault(length, []).append((first, count, times, sequence, offset))
    # at most a few runs for each of seq_len lengths: patterns split and open once a length
    table = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in runs.items()}
    held = spark.sparkContext.broadcast(table)
    if before.count() * 128 <= broadcast_bytes:
        before = F.broadcast(before)

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            value = int(length[own[0]])
            first, _, times, start, at = held.value[value]
            run = np.searchsorted(first, rank[own], side="right") - 1
            nth = rank[own] - first[run]
            sequence[own], offset[own] = start[run] + nth // times[run], at[run] + nth % times[run] * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # ids stay with Spark; only lengths and ranks go to Python
    put = F.pandas_udf(place, "sequence_id long, offset long")
    ranked = pieces.join(before, ["length", "task"]).withColumn("__at", put("length", F.col("before") + F.col("nth")))
    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "__at.sequence_id", "__at.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the pieces of each sequence joined (at most ``seq_len`` ids)."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
