"""BibTeX and RIS bibliographies of any size: records are cut where they begin or end, whatever the split of a file.

Spark's text reader takes ``lineSep``, so a split ends at a record and a large file is read by as many tasks as it
has splits. A BibTeX entry begins at ``@`` at the start of a line, an RIS record ends at ``ER  -``. Within a split
records are numbered as they come; the numbers of a file's splits are added up from their counts.

BibTeX entries are scanned by depth of braces (any depth), with quoted values, ``#`` joins, month names and the
macros of ``@string``, which hold from their definition on, in their file. An entry that does not end before the next
``@`` at the start of a line, or whose fields cannot be told apart, is broken: it is reported with its place, takes no
number and costs no other entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..tables import kept, measured

# ---- fixed names of the format
MONTHS = {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June", "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December"}
# ---- end of fixed names

NEXT, BEGIN, BRACE, NAME = re.compile(r"\n@"), re.compile(r"@[ \t\r\n]*(\w+)[ \t\r\n]*([{(])"), re.compile(r"[{}]"), re.compile(r"[^\s=,{}\"#()]+")
LINE_BEGIN = re.compile(r"^[ \t]*@", re.MULTILINE)
Part = tuple[bool, str]  # (is it a name?, text)


class Broken(ValueError):
    """An entry that cannot be read, with why."""


def closing(text: str, at: int, limit: int | None = None) -> int:
    """Place of the brace that closes the one at ``at``."""
    depth = 0
    for m in BRACE.finditer(text, at, len(text) if limit is None else limit):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    raise Broken("a brace is never closed")


def quoted(text: str, at: int) -> int:
    """Place of the quote that ends the value whose quote is at ``at``; quotes inside braces do not count."""
    k = at + 1
    while k < len(text):
        if text[k] == "{":
            k = closing(text, k)
        elif text[k] == '"':
            return k
        k += 1
    raise Broken("a quote is never closed")


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def value_at(text: str, at: int) -> tuple[list[Part], int]:
    """Parts of the value that begins at ``at``, and the place after it."""
    parts: list[Part] = []
    while True:
        at = _skip(text, at)
        if text[at : at + 1] == "{":
            end = closing(text, at)
            parts.append((False, text[at + 1 : end]))
            at = end + 1
        elif text[at : at + 1] == '"':
            end = quoted(text, at)
            parts.append((False, text[at + 1 : end]))
            at = end + 1
        elif m := NAME.match(text, at):
            parts.append((not m.group().isdigit(), m.group()))
            at = m.end()
        else:
            raise Broken("a field has no value")
        at = _skip(text, at)
        if text[at : at + 1] != "#":
            return parts, at
        at += 1


def fields_of(body: str) -> dict[str, list[Part]]:
    """Fields of ``name = value, ...``; the last of a name counts."""
    out, at = {}, 0
    while True:
        while at < len(body) and (body[at].isspace() or body[at] == ","):
            at += 1
        if at == len(body):
            return out
        m = NAME.match(body, at)
        at = _skip(body, m.end()) if m else at
        if not m or body[at : at + 1] != "=":
            raise Broken(f"'=' is missing at character {at} of the entry's fields")
        out[m.group().lower()], at = value_at(body, at + 1)
        if at < len(body) and body[at] != ",":
            raise Broken(f"',' is missing at character {at} of the entry's fields")


def scan(text: str) -> Iterator[tuple[int, str, str, dict[str, list[Part]], str | None]]:
    """(place, kind, raw, fields, error) of each entry and macro; comments and preambles are passed over."""
    at = 0
    while m := BEGIN.search(text, at):
        kind, start = m.group(1).lower(), m.end() - 1
        begin = NEXT.search(text, m.end())
        limit = begin.start() if begin else len(text)
        try:
            if m.group(2) == "{":
                end = closing(text, start, limit)
            elif (end := text.rfind(")", start, limit)) < 0:
                raise Broken("a bracket is never closed")
            body, at = text[start + 1 : end], end + 1
            if kind not in ("comment", "preamble"):
                key = re.match(r"[^,=]*(,|$)", body) if kind != "string" else None
                yield m.start(), kind, text[m.start() : at], fields_of(body[key.end() :] if key else body), None
        except Broken as e:
            begin = LINE_BEGIN.search(text, m.end())
            at = begin.start() if begin else len(text)
            if kind not in ("comment", "preamble"):
                yield m.start(), kind, text[m.start() : at].strip()[:1000], {}, str(e)


ITEM = "owner string, block long, seq long, nth long, place long, kind string, raw_text string, error string, named boolean, names array<string>, parts array<array<struct<name:boolean,text:string>>>"
ITEM_NAMES = [part.split(" ", 1)[0] for part in re.split(r", (?=[a-z_]+ )", ITEM)]
_PART = pa.struct([("name", pa.bool_()), ("text", pa.string())])
ITEM_TYPES = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 3, pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(_PART))]


#: Entries that are given out, and texts that are read, at a time.
ITEMS, TEXTS = 512, 64


def _given_out(rows: Iterable[tuple], size: int = ITEMS) -> Iterator[pa.RecordBatch]:
    """``ITEM`` batches of at most ``size`` rows, each made before the next row is asked for."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*part), ITEM_TYPES)], names=ITEM_NAMES)


def _items(pieces: DataFrame, cut: bool = False) -> DataFrame:
    """Entries and macros of pieces (owner, block, piece), where a block's pieces follow one another in a partition; those
    that are ``cut`` have lost the @ that began them, but for the first of an owner. ``nth`` counts a block's entries from 0, ``seq`` all that it has; ``place`` is the character in the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            where, nth, seq = None, 0, 0
            for part in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
                for owner, block, piece in zip(*(part.column(k).to_pylist() for k in range(3))):
                    begun = cut and not (block == 0 and (owner, block) != where)
                    if (owner, block) != where:
                        where, nth, seq = (owner, block), 0, 0
                    for place, kind, raw, fields, error in scan("@" * begun + (piece or "")):
                        entry = kind != "string" and not error
                        parts = [[{"name": n, "text": x} for n, x in v] for v in fields.values()]
                        named = any(n for v in fields.values() for n, _ in v)
                        yield owner, block, seq, nth if entry else None, place, kind, raw, error, named, [*fields], parts
                        nth, seq = nth + entry, seq + 1

        yield from _given_out(found())

    return kept(pieces.select("owner", "block", "piece").mapInArrow(run, ITEM), "bibtex-items")


def _macros(items: DataFrame) -> DataFrame:
    """owner, macros (array of (block, seq, name, text)) of owners that define any, each resolved by those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            resolved = []
            for macros in batch.column(1).to_pylist():
                known, out = dict(MONTHS), []
                for m in macros:
                    for name, parts in zip(m["names"], m["parts"]):
                        known[name] = "".join(known.get(p["text"].lower(), p["text"]) if p["name"] else p["text"] for p in parts)
                        out.append({"block": m["block"], "seq": m["seq"], "name": name, "text": known[name]})
                resolved.append(out)
            kind = pa.list_(pa.struct([("block", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(resolved, kind)], names=["owner", "macros"])

    defined = items.where("kind = 'string' AND error IS NULL").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "names", "parts"))).alias("macros"))
    return defined.mapInArrow(run, "owner string, macros array<struct<block:bigint,seq:bigint,name:string,text:string>>")


def _entries(items: DataFrame) -> DataFrame:
    """owner, ref_idx, kind, raw_text, fields (map of name and value). Only entries that name something meet the macros."""
    sizes = items.where("nth IS NOT NULL").groupBy("owner", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = measured(kept(sizes.select("owner", "block", F.coalesce(before, F.lit(0)).alias("start")), "bibtex-starts"))
    rows = items.where("nth IS NOT NULL").join(starts, ["owner", "block"])
    macros = measured(kept(_macros(items), "bibtex-macros"), 10_000)
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def meant(p):
        name = F.lower(p["text"])
        known = F.filter("macros", lambda m: (m["name"] == name) & ((m["block"] < F.col("block")) | ((m["block"] == F.col("block")) & (m["seq"] < F.col("seq")))))
        return F.when(p["name"], F.coalesce(F.try_element_at(known, F.lit(-1))["text"], F.try_element_at(months, name), p["text"])).otherwise(p["text"])

    plain = F.transform("parts", lambda v: F.array_join(F.transform(v, lambda p: p["text"]), ""))
    told = F.transform("parts", lambda v: F.array_join(F.transform(v, meant), ""))
    values = lambda df, v: df.select("owner", (F.col("start") + F.col("nth") + 1).cast("int").alias("ref_idx"), "kind", "raw_text", F.map_from_arrays("names", F.transform(v, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))).alias("fields"))
    return values(rows.where("NOT named"), plain).unionByName(values(rows.where("named").join(macros, "owner", "left"), told))


def _broken(items: DataFrame) -> DataFrame:
    return items.where("error IS NOT NULL").select("owner", "block", "place", "kind", "raw_text", "error")


def bibtex_in_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, broken) of whole BibTeX texts (doc_id, text), one text an owner; ``owner`` is the doc_id as a string."""
    items = _items(docs.select(F.col("doc_id").cast("string").alias("owner"), F.lit(0).cast("long").alias("block"), F.col("text").alias("piece")))
    return _entries(items), _broken(items)


def _pieces(spark: SparkSession, path: str | list[str], separator: str, glob: str | None) -> DataFrame:
    """owner (the file's path), block (where its split starts), piece: what lies between separators, in order in a partition."""
    reader = spark.read.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("owner"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def bibtex_in_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, broken) of BibTeX files, read by splits; ``owner`` is the file's path, ``block`` where the split of a broken entry starts."""
    items = _items(_pieces(spark, path, "\n@", glob), cut=True)
    return _entries(items), _broken(items)


def ris_in_texts(docs: DataFrame) -> DataFrame:
    """owner, ref_idx, raw_text of whole RIS texts (doc_id, text): lines up to ER."""
    records = F.filter(F.split(t.text(F.col("text")), r"(?m)^ER  -.*$"), lambda r: r.rlike(r"(?m)^TY  - "))
    rows = docs.select(F.col("doc_id").cast("string").alias("owner"), F.posexplode(records).alias("pos", "raw_text"))
    return rows.select("owner", (F.col("pos") + 1).cast("int").alias("ref_idx"), F.trim("raw_text").alias("raw_text"))


def ris_in_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """owner (the file's path), ref_idx, raw_text of RIS files, read by splits."""
    pieces = _pieces(spark, path, "\nER  -", glob).withColumn("at", F.monotonically_increasing_id())
    rows = kept(pieces.where(F.col("piece").rlike(r"(?m)^TY  - ")), "ris-records")
    sizes = rows.groupBy("owner", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = measured(kept(sizes.select("owner", "block", F.coalesce(before, F.lit(0)).alias("start")), "ris-starts"))
    nth = F.row_number().over(Window.partitionBy("owner", "block").orderBy("at"))
    rows = rows.withColumn("nth", nth).join(starts, ["owner", "block"])
    # what is left of the line of the ER before goes
    own = F.when(F.col("piece").rlike(r"^\s*TY  - "), F.col("piece")).otherwise(F.regexp_replace("piece", r"^[^\n]*\n", ""))
    return rows.select("owner", (F.col("start") + F.col("nth")).cast("int").alias("ref_idx"), F.trim(own).alias("raw_text"))
