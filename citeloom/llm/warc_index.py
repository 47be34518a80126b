"""WARC archives of web pages with a two-level capture index.

Pages become WARC 1.1 records, each a gzip member of its own. Of equal payloads from
``min_revisit_bytes`` on only the one with the largest id is written in full (response); the
others become revisit records that name it. Archives are rows of a table in the shared folder
(name, bytes of a whole .warc.gz), because executors share nothing but what Spark can read;
``export_archives`` puts them out as files.

The index has two levels. Its lines (reversed-host URL key, page, archive, offset, length) are sorted
over the cluster and packed into compressed blocks; the sparse block directory keeps each block's first
key, range by range. A lookup finds its range, then its block by binary search in the range's
directory, then its line by binary search in the block, and then reads that byte range of the archive.

Defined cases: a null payload is an empty one; a null URL has an empty key and sorts first; ids and URLs may
repeat, every row is a capture of its own (those with the greatest id of a payload are all
responses); an empty table gives empty archives; only id, URL and payload are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, lean, saved

ARCHIVE_BYTES, LINES_PER_BLOCK = 4 << 20, 1000
#: Lines of one range of the index (more where there would be over MOST_PARTS ranges), and lookups of a task.
LINES_PER_PART, LEAST_PARTS, MOST_PARTS, LOOKUPS_PER_TASK = 50_000, 24, 100_000, 200_000
#: What a repeated digest and its keeper take in memory, at most; salts of a digest where these are many.
KEEPER_BYTES, SALTS = 256, 16
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The URL with its host reversed and without scheme, port 80/443, leading www and fragment:
    ``http://www.a.org/b?c`` becomes ``org,a)/b?c``."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(?::(\d+))?([^#]*)", url or "")
    if not m:
        return (url or "").split("#")[0]
    host = m[1].lower().removeprefix("www.")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    rest = m[3] if m[3].startswith("/") else "/" + m[3]
    return ",".join(reversed(host.split("."))) + port + ")" + rest


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record; a revisit has the digest and length of the full payload and no body."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""), f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers, payload (None for a revisit), the digest and the length of the full payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").rstrip(">")) else None
    response = headers["WARC-Type"] == "response"
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if response and len(payload) != length:
        raise ValueError(f"record of {headers['WARC-Record-ID']}: {len(payload)} bytes instead of {length}")
    return {
        "page_id": number(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"],
        "payload": payload if response else None, "payload_bytes": length,
        "payload_digest": hashlib.sha1(payload).hexdigest() if response else base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "refers_to": None if response else number(headers["WARC-Refers-To"]),
    }


def _with_keepers(pages: DataFrame, repeats: DataFrame) -> DataFrame:
    """``pages`` with keeper (null where the digest is not in ``repeats``). Payloads stay where they are
    if the repeated digests are few; if not, pages are dealt by digest and a salt, so one payload fills no task."""
    if repeats.count() * KEEPER_BYTES <= BROADCAST_BYTES:
        return pages.join(F.broadcast(repeats), "digest", "left")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    copies = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 1000) -> DataFrame:
    """One table of two kinds of rows: archives (archive, data) and captures (archive, url_key, page_id, at, length)."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    long_ = F.length("payload") >= min_revisit_bytes
    repeats = pages.where(long_).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    pages = _with_keepers(pages, saved(repeats, "warc-keepers"))
    pages = pages.withColumn("keeper", F.when(long_ & (F.coalesce("page_id", F.lit(-(1 << 63))) < F.col("keeper")), F.col("keeper")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, buffer, at = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            lines: tuple[list, ...] = ([], [], [], [], [], [])

            def put(*row, lines=lines):
                for col, v in zip(lines, row):
                    col.append(v)

            cols = [batch.column(batch.schema.names.index(c)) for c in ("page_id", "url", "digest", "keeper", "payload")]
            for page, link, digest, keeper, data in zip(*(c.to_pylist() for c in cols[:4]), cols[4]):
                member = record("response" if keeper is None else "revisit", page, link, digest, data.as_py(), keeper)
                put(f"{task:06d}-{nth:06d}", None, url_key(link), page, at, len(member))
                buffer.append(member)
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    put(f"{task:06d}-{nth:06d}", b"".join(buffer), None, None, None, None)
                    nth, buffer, at = nth + 1, [], 0
            yield _rows(lines)
        if buffer:
            yield _rows(([f"{task:06d}-{nth:06d}"], [b"".join(buffer)], [None], [None], [None], [None]))

    return saved(pages.select("page_id", "url", "digest", "keeper", "payload").mapInArrow(lean(write), "archive string, data binary, url_key string, page_id long, at long, length long"), "warc")


def _rows(cols) -> pa.RecordBatch:
    types = (pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["archive", "data", "url_key", "page_id", "at", "length"])


def _line(key: str, page: int | None, archive: str, at: int, length: int) -> str:
    return f"{sort_key(key, page)}\t{archive}\t{at}\t{length}"


def sort_key(key: str | None, page: int | None) -> str:
    """What lines are sorted and searched by; ids are zero-padded so that they sort as numbers."""
    clean = (key or "").replace("\t", "%09").replace("\n", "%0A")
    return f"{clean}\t{'' if page is None else f'{page + (1 << 63):020d}'}"


def build_index(captures: DataFrame, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """block (number), first (least search key), data (compressed lines, sorted)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            keys = [sort_key(k, p) for k, p in zip(cols[0], cols[1])]
            text = [_line(*row) for row in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(text, pa.string())], names=["key", "line"])

    sorted_ = captures.select("url_key", "page_id", "archive", "at", "length").mapInArrow(lean(lines), "key string, line string")
    lines_in = captures.count()
    n = max(LEAST_PARTS, min(MOST_PARTS, -(-lines_in // LINES_PER_PART)))
    sorted_ = sorted_.repartitionByRange(n, "key", "line").sortWithinPartitions("key", "line")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, first, held = TaskContext.get().partitionId(), 0, None, []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + nth], pa.int64()), pa.array([first], pa.string()), pa.array([zlib.compress("\n".join(held).encode(), 6)], pa.binary())], names=["block", "first", "data"])

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held:
                    first = key
                held.append(line)
                if len(held) >= lines_per_block:
                    yield block()
                    nth, held = nth + 1, []
        if held:
            yield block()

    return saved(sorted_.mapInArrow(lean(pack), "block long, first string, data binary"), "warc-index")


def find_lines(lines: list[str], key: str) -> list[str]:
    """The lines of a block with that search key, by binary search."""
    at = bisect.bisect_left(lines, key + "\t")
    out = []
    while at < len(lines) and lines[at].startswith(key + "\t"):
        out.append(lines[at])
        at += 1
    return out


def locate(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """archive, at, length of each capture that ``lookups`` (url_key, page_id) ask for."""
    spark = lookups.sparkSession
    directory = index.select(F.shiftright("block", 32).alias("part"), F.col("first").alias("key"), "block")
    top = sorted((r.key, r.part) for r in directory.groupBy("part").agg(F.min("key").alias("key")).collect())
    held = spark.sparkContext.broadcast(([f for f, _ in top], [p for _, p in top]))  # one key a range, MOST_PARTS at most

    def among(firsts: list[str], key: str) -> tuple[int, int]:
        """Lines of a key may begin in the stretch before the first one that starts with it."""
        return max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, numbers = held.value
        for batch in batches:
            keys, found = [], []
            for key in (sort_key(k, p) for k, p in zip(*(c.to_pylist() for c in batch.columns))):
                a, b = among(firsts, key)
                keys += [key] * (b - a)
                found += numbers[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(keys, pa.string())], names=["part", "key"])

    keys = saved(lookups.select("url_key", "page_id").mapInArrow(lean(part_of), "part long, key string").distinct(), "warc-lookups")
    # a range and its lookups meet in a task of their own, a range with many lookups in several
    tasks, deals = [], 0
    for r in keys.groupBy("part").count().collect():
        n = -(-r["count"] // LOOKUPS_PER_TASK)
        tasks.append((r.part, deals, n))
        deals += n
    if not tasks:
        return spark.createDataFrame([], "archive string, at long, length long")
    dealt = spark.createDataFrame(tasks, "part long, first_task int, tasks int")
    entries = directory.join(F.broadcast(dealt), "part").select(F.explode(F.sequence("first_task", F.col("first_task") + F.col("tasks") - 1)).alias("task"), "key", "block")
    asked = keys.join(F.broadcast(dealt), "part").select((F.col("first_task") + F.pmod(F.xxhash64("key"), "tasks").cast("int")).alias("task"), "key", F.lit(None).cast("long").alias("block"))
    stream = entries.unionByName(asked).repartitionById(deals, F.col("task")).sortWithinPartitions("task", F.col("block").isNull(), "key")

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, firsts, numbers = None, [], []
        for batch in batches:
            found, blocks = [], []
            for own, key, block in zip(*(c.to_pylist() for c in batch.columns)):
                if own != task:
                    task, firsts, numbers = own, [], []
                if block is not None:
                    firsts.append(key)
                    numbers.append(block)
                    continue
                a, b = among(firsts, key)
                found += [key] * (b - a)
                blocks += numbers[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(found, pa.string())], names=["block", "key"])

    out = stream.mapInArrow(lean(block_of), "block long, key string")
    asked = out.groupBy("block").agg(F.collect_list("key").alias("keys"))  # at most a block's lines, once each

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [])
            for data, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                block = zlib.decompress(data.as_py()).decode().split("\n")
                for line in (x for key in wanted for x in find_lines(block, key)):
                    archive, at, length = line.rsplit("\t", 3)[1:]
                    for col, v in zip(cols, (archive, int(at), int(length))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["archive", "at", "length"])

    return index.join(asked, "block").select("data", "keys").mapInArrow(lean(lines), "archive string, at long, length long")


RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_ranges(archives: DataFrame, ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the ranges (archive, at, length): RECORD, payload null unless asked for."""
    asked = ranges.groupBy("archive").agg(F.collect_list(F.struct("at", "length")).alias("r"))  # bounded by an archive's size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1)):
                view = memoryview(data.as_buffer())
                rows = [parse_record(view[w["at"] : w["at"] + w["length"]]) for w in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] if payloads or n != "payload" else None for r in rows], t) for n, t in zip(names, types)], names=names)

    return archives.join(asked, "archive").select("data", "r").mapInArrow(lean(read), RECORD)


def export_archives(table: DataFrame, folder: str) -> int:
    """Writes each archive as ``folder``/name.warc.gz, from the executors, where they all mount that folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with open(f"{folder}/{name}.warc.gz.part", "wb") as out:
                    out.write(data.as_buffer())
                os.replace(f"{folder}/{name}.warc.gz.part", f"{folder}/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return table.where("data IS NOT NULL").select("archive", "data").mapInArrow(lean(write), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 1000, payloads: bool = False) -> DataFrame:
    """Writes the pages, indexes them, and reads every capture back through the index."""
    table = write_archives(pages, page_id, url, payload, min_revisit_bytes)
    captures = table.where("data IS NULL")
    index = build_index(captures)
    ranges = locate(captures, index)
    return read_ranges(table.where("data IS NOT NULL").select("archive", "data"), ranges, payloads)
