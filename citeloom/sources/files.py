"""Readers of documents and bibliographies: text, BibTeX, RIS, DOCX, PDF, TEI and parser records, to REFS columns."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import entries, intext
from ..schema import INTEXT
from . import bibliography

# ---- fixed names of the formats
BIBTEX_TYPES = {"article": "journal-article", "book": "book", "conference": "proceedings-article", "incollection": "book-chapter", "inproceedings": "proceedings-article", "mastersthesis": "thesis", "misc": "unknown", "phdthesis": "thesis", "techreport": "report"}
RIS_TYPES = {"BOOK": "book", "CHAP": "book-chapter", "CONF": "proceedings-article", "CPAPER": "proceedings-article", "JOUR": "journal-article", "RPRT": "report", "THES": "thesis"}
RIS_FIELDS = {"title": ["TI", "T1"], "year": ["PY", "Y1"], "journal": ["JO", "JF", "T2"], "volume": ["VL"], "issue": ["IS"], "first": ["SP"], "last": ["EP"], "doi": ["DO"], "publisher": ["PB"], "url": ["UR"]}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RECORD = "author array<struct<family:string,given:string>>, title array<string>, date array<string>, issued array<string>, `container-title` array<string>, journal array<string>, booktitle array<string>, volume array<string>, issue array<string>, number array<string>, pages array<string>, publisher array<string>, doi array<string>, url array<string>, type string, original array<string>"
RECORD_TYPES = {"article": "journal-article", "article-journal": "journal-article", "book": "book", "chapter": "book-chapter", "paper-conference": "proceedings-article", "report": "report", "thesis": "thesis", "webpage": "webpage"}
# ---- end of fixed names

#: Outside parsers, the better first; and the variable that names one for all calls.
PARSERS, PARSER_VARIABLE = ("anystyle", "grobid"), "CITELOOM_PARSER"
READERS = {".pdf": "pdf", ".docx": "docx", ".bib": "bibtex", ".ris": "ris"}
REF_COLUMNS = ["doc_id", "ref_idx", "raw_text", "authors", "title", "year", "container_title", "volume", "issue", "pages", "publisher", "doi", "url", "arxiv_id", "pmid", "isbn", "type"]


def _refs(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    def one(c: str) -> Column:
        if c in ("doc_id", "ref_idx"):
            return F.col(c)
        if c == "authors":
            return F.coalesce(fields[c], F.array().cast(f"array<{t.AUTHOR}>"))
        return fields[c].cast("int") if c == "year" else t.text(fields.get(c, F.lit("")))

    return rows.select(*(one(c).alias(c) for c in REF_COLUMNS))


def _map(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key), F.lit("unknown"))


def read_texts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """doc_id (hash of the path), path, text: one row for each text or Markdown file."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def from_texts(docs: DataFrame, backends: dict[str, DataFrame] | None = None, parser: str = "auto") -> tuple[DataFrame, DataFrame]:
    """References and in-text citations of documents (doc_id, text), by the chosen parser (``parse``)."""
    parsed = parse(entries.entries(docs), backends, parser)
    bodies = docs.select("doc_id", entries.body_text(F.col("text")).alias("body"))
    return parsed, intext.intext(bodies, body="body")


def _bibtex_refs(rows: DataFrame) -> DataFrame:
    """Reference rows from entries (doc_id, ref_idx, kind, raw_text, fields)."""
    field = lambda name: t.text(F.try_element_at("fields", F.lit(name)))
    either = lambda a, b: F.coalesce(t.nullif(field(a)), field(b))
    doi = F.coalesce(t.nullif(t.doi_of(field("doi"))), F.lower(field("doi")))
    people = F.filter(F.split(field("author"), " and "), lambda a: F.trim(a) != "")
    return _refs(rows, {
        "raw_text": F.col("raw_text"), "title": F.trim(F.btrim(field("title"), F.lit("{}"))), "year": t.year_of(field("year")), "container_title": either("journal", "booktitle"), "volume": field("volume"),
        "issue": either("number", "issue"), "pages": F.replace(field("pages"), F.lit("--"), F.lit("-")), "publisher": field("publisher"), "doi": doi, "url": field("url"),
        "arxiv_id": t.arxiv_of(either("eprint", "note")), "authors": F.transform(people, lambda a: t.author_of(F.rtrim(F.trim(a), F.lit(",.;")))), "type": _map(BIBTEX_TYPES, F.col("kind")),
    })


def _by_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("owner").cast("long"))


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.xxhash64("owner"))


def from_bibtex(docs: DataFrame) -> DataFrame:
    """References of whole BibTeX texts (doc_id, text), numbered without gaps; broken entries are left out."""
    return _bibtex_refs(_by_text(bibliography.bibtex_in_texts(docs)[0]))


def read_bibtex(spark: SparkSession, path: str | list[str], glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """References of BibTeX files, read by splits, and the broken entries (owner, block, place, kind, raw_text, error)."""
    found, broken = bibliography.bibtex_in_files(spark, path, glob)
    return _bibtex_refs(_by_file(found)), broken


def _ris_refs(rows: DataFrame) -> DataFrame:
    every = lambda tag: F.regexp_extract_all("raw_text", F.lit(rf"(?m)^{tag}  - ?(.*?)\s*$"), F.lit(1))
    one = lambda name: t.text(F.coalesce(*(t.nullif(t.text(F.try_element_at(every(tag), F.lit(1)))) for tag in RIS_FIELDS[name])))
    first, last = one("first"), one("last")
    people = F.concat(every("AU"), every("A1"))
    return _refs(rows, {
        "raw_text": F.col("raw_text"), "title": one("title"), "year": t.year_of(one("year")), "container_title": one("journal"), "volume": one("volume"), "issue": one("issue"),
        "pages": F.when((first != "") & (last != ""), F.concat(first, F.lit("-"), last)).otherwise(first), "doi": F.lower(one("doi")), "publisher": one("publisher"), "url": one("url"),
        "authors": F.transform(F.filter(people, lambda a: a != ""), lambda a: t.author_of(F.rtrim(F.trim(a), F.lit(",.;")))), "type": _map(RIS_TYPES, t.text(F.try_element_at(every("TY"), F.lit(1)))),
    })


def from_ris(docs: DataFrame) -> DataFrame:
    """References of whole RIS texts (doc_id, text)."""
    return _ris_refs(_by_text(bibliography.ris_in_texts(docs)))


def read_ris(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """References of RIS files, read by splits."""
    return _ris_refs(_by_file(bibliography.ris_in_files(spark, path, glob)))


def docx_runs(data: bytes) -> list[tuple[int, str, bool]]:
    """(paragraph, text, superscript) of a .docx file's runs; none where it is not one."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for i, paragraph in enumerate(root.iter(f"{WORD}p")):
        for run in paragraph.iter(f"{WORD}r"):
            align = run.find(f"{WORD}rPr/{WORD}vertAlign")
            text = "".join((x.text or "") if x.tag == f"{WORD}t" else "\t" if x.tag == f"{WORD}tab" else "\n" if x.tag == f"{WORD}br" else "" for x in run)
            out.append((i, text, align is not None and align.get(f"{WORD}val") == "superscript"))
    return out


def _binary(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_docx(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """doc_id, path, text, superscripts: paragraphs joined by newlines, and numeric citations in superscript runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = [], []
            for data in batch.column(1):
                runs = docx_runs(data.as_py())
                lines: dict[int, list[str]] = {}
                for i, text, _ in runs:
                    lines.setdefault(i, []).append(text)
                texts.append("\n".join("".join(lines.get(i, [])) for i in range(max(lines, default=-1) + 1)))
                found = [m.group().replace(" ", "") for _, text, up in runs if up for m in re.finditer(r"\d{1,3}(?:[\-–,]\s*\d{1,3})*", text.strip())]
                marks.append([f"[{x}]" for x in dict.fromkeys(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(marks, pa.list_(pa.string()))], names=["path", "text", "superscripts"])

    rows = _binary(spark, path, glob).select("path", "content").mapInArrow(run, "path string, text string, superscripts array<string>")
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text", "superscripts")


def from_docx(docs: DataFrame, backends: dict[str, DataFrame] | None = None, parser: str = "auto") -> tuple[DataFrame, DataFrame]:
    """As ``from_texts``, with superscript citations after the others, each string once."""
    refs, cited = from_texts(docs.select("doc_id", "text"), backends, parser)
    more = docs.select("doc_id", F.posexplode("superscripts").alias("pos", "raw")).withColumn("pos", (F.col("pos") + 1_000_000).cast("int"))
    more = more.join(cited.select("doc_id", "raw"), ["doc_id", "raw"], "left_anti").withColumns(intext.parse_citation(F.col("raw")))
    return refs, cited.unionByName(more.select(*cited.columns))


def read_pdf(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """doc_id, path, text, error of PDF files, page by page; needs pdfplumber on the executors. A file that
    cannot be read has an empty text and says why in error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pdf_text(data.as_py()) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "text", "error"])

    rows = _binary(spark, path, glob).select("path", "content").mapInArrow(run, "path string, text string, error string")
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text", "error")


def pdf_text(data: bytes) -> tuple[str, str | None]:
    """(text, None), or ('', reason)."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return "\n".join(page.extract_text() or "" for page in pdf.pages), None
    except ImportError:
        return "", "pdfplumber is needed to read .pdf files"
    except Exception as e:  # whatever a broken file makes the library raise is about that file alone
        return "", f"{type(e).__name__}: {e}"


def from_parser_records(rows: DataFrame, column: str = "value") -> DataFrame:
    """Reference rows from a citation parser's JSON records (doc_id, ref_idx, column); values may be lists or single."""
    listed = F.regexp_replace(F.col(column), r'"(title|date|issued|container-title|journal|booktitle|volume|issue|number|pages|publisher|doi|url|original)"\s*:\s*("(?:[^"\\]|\\.)*")', r'"$1":[$2]')
    listed = F.regexp_replace(listed, r'"type"\s*:\s*\[\s*("(?:[^"\\]|\\.)*")[^\]]*\]', r'"type":$1')
    rows = rows.select("doc_id", "ref_idx", F.from_json(listed, RECORD).alias("r"))
    r = F.col("r")
    first = lambda *names: F.trim(F.coalesce(*(t.nullif(t.text(F.try_element_at(r[n], F.lit(1)))) for n in names), F.lit("")))
    doi = F.rtrim(F.regexp_extract(F.lower(first("doi")), r"(10\.\d{4,9}/[^\s\"'<>]+)", 1), F.lit(".,;:)"))
    people = F.filter(r["author"], lambda a: ~t.missing(a["family"]) | ~t.missing(a["given"]))
    return _refs(rows, {
        "raw_text": first("original"), "authors": F.transform(people, lambda a: t.author(F.trim(t.text(a["family"])), F.trim(t.text(a["given"])))), "title": first("title"),
        "year": F.regexp_extract(first("date", "issued"), r"\b(1[6-9]\d{2}|20\d{2})\b", 1).try_cast("int"), "container_title": first("container-title", "journal", "booktitle"), "volume": first("volume"),
        "issue": first("issue", "number"), "pages": first("pages"), "publisher": first("publisher"), "doi": doi, "url": F.when(doi == "", first("url")), "type": _map(RECORD_TYPES, F.lower(t.text(r["type"]))),
    })


def from_tei(rows: DataFrame, column: str = "value") -> DataFrame:
    """Reference rows from TEI biblStruct elements as XML (doc_id, ref_idx, column), by XPath functions; those without
    title and authors are left out."""
    x = F.regexp_replace(F.col(column), r'\sxmlns(:\w+)?="[^"]*"', "")
    rows = rows.withColumn("__x", x)
    at = lambda path: F.trim(t.text(F.xpath_string("__x", F.lit(path))))
    either = lambda a, b: F.coalesce(t.nullif(at(a)), at(b))
    # names one by one: a person's own forename, or none
    inside = lambda p, tag: F.trim(t.text(F.regexp_extract(p, rf"<{tag}\b[^>]*>([^<]*)", 1)))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    people = F.flatten(F.transform(F.regexp_extract_all("__x", F.lit(r"(?s)<author\b[^>]*>(.*?)</author>"), F.lit(1)), lambda a: F.regexp_extract_all(a, F.lit(r"(?s)<persName\b[^>]*>(.*?)</persName>"), F.lit(1))))
    authors = F.filter(F.transform(people, lambda p: t.author(plain(inside(p, "surname")), plain(inside(p, "forename")))), lambda a: a["family"] != "")
    page = at("//biblScope[@unit='page']")
    ends = F.concat(at("//biblScope[@unit='page']/@from"), F.lit("-"), at("//biblScope[@unit='page']/@to"))
    out = _refs(rows, {
        "authors": authors, "title": either("//title[@level='a']", "//title"), "year": F.regexp_extract(either("//date[@type='published']/@when", "//date[@type='published']"), r"^(\d{4})", 1).try_cast("int"),
        "container_title": either("//title[@level='j']", "//title[@level='m']"), "volume": at("//biblScope[@unit='volume']"), "issue": at("//biblScope[@unit='issue']"),
        "pages": F.when(page != "", page).when(F.length(ends) > 1, ends), "doi": F.lower(at("//idno[@type='DOI']")), "type": F.lit("unknown"), "url": at("//ptr/@target"), "raw_text": F.col(column),
    })
    return out.where((F.col("title") != "") | (F.size("authors") > 0))


def backfill(parsed: DataFrame, raw: DataFrame) -> DataFrame:
    """A parser backend's rows, those without title and authors taken from the built-in parser of the raw entries
    (doc_id, ref_idx, raw_text); where it gave far fewer or more rows for a document than entries, all of it."""
    own = entries.parse_entries(raw).select(*REF_COLUMNS)
    n = raw.groupBy("doc_id").agg(F.count("*").alias("n"))
    m = parsed.groupBy("doc_id").agg(F.count("*").alias("m"))
    trusted = n.join(m, "doc_id").where(F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).select("doc_id", F.lit(True).alias("trusted"))
    a, b = F.struct(*(F.col(f"p.{c}") for c in REF_COLUMNS[2:])), F.struct(*(F.col(f"o.{c}") for c in REF_COLUMNS[2:]))
    rows = own.alias("o").join(parsed.alias("p"), ["doc_id", "ref_idx"], "left").join(trusted, "doc_id", "left")
    useful = F.coalesce("trusted", F.lit(False)) & (~t.missing(F.col("p.title")) | (F.coalesce(F.size("p.authors"), F.lit(0)) > 0))
    return rows.select("doc_id", "ref_idx", F.when(useful, a).otherwise(b).alias("x")).select("doc_id", "ref_idx", "x.*")


def parse(raw: DataFrame, backends: dict[str, DataFrame] | None = None, choice: str = "auto") -> DataFrame:
    """Reference rows from raw entries (doc_id, ref_idx, raw_text) by the chosen parser. ``backends`` holds the answers
    of outside parsers as reference rows (``from_parser_records``, ``from_tei``); 'auto' takes the first of
    ``PARSERS`` that is there, a name takes that one; what they leave open, or all where there is none, is
    parsed here ('regex'). The environment variable in ``PARSER_VARIABLE`` comes before ``choice``."""
    choice = (os.environ.get(PARSER_VARIABLE) or choice or "auto").lower()
    backends = backends or {}
    order = [choice] if choice in PARSERS else [*PARSERS] if choice == "auto" else []
    found = next((b for b in order if b in backends), None)
    if found is None:
        return entries.parse_entries(raw).select(*REF_COLUMNS)
    return backfill(backends[found], raw)


def _globs(spark: SparkSession, path: str | list[str]) -> dict[str, str | None]:
    """Kind of reader and the glob of its files' suffixes, for the kinds that are there; files without a suffix are
    texts, for which there is no glob (None)."""
    listed = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1).alias("s"))
    kinds: dict[str, list[str]] = {}
    for r in listed.distinct().collect():
        kinds.setdefault(READERS.get(r.s.lower(), "text"), []).append(r.s)
    return {kind: None if "" in suffixes else "*{" + ",".join(sorted(suffixes)) + "}" for kind, suffixes in kinds.items()}


def _texts(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    texts = read_texts(spark, path, glob)
    return texts if glob else texts.where(~F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).isin([*READERS]))


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc_id, path, text, error of the text, .docx and .pdf files under a path."""
    globs, none = _globs(spark, path), F.lit(None).cast("string").alias("error")
    loads = {"text": lambda g: _texts(spark, path, g).withColumn("error", none), "docx": lambda g: read_docx(spark, path, g).drop("superscripts").withColumn("error", none), "pdf": lambda g: read_pdf(spark, path, g)}
    found = [loads[kind](glob).select("doc_id", "path", "text", "error") for kind, glob in globs.items() if kind in loads]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "doc_id long, path string, text string, error string")


def unreadable(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, place, error of what under a path cannot be read: PDF files and BibTeX entries."""
    globs = _globs(spark, path)
    out = spark.createDataFrame([], "path string, place long, error string")
    if "pdf" in globs:
        out = out.unionByName(read_pdf(spark, path, globs["pdf"]).where("error IS NOT NULL").select("path", F.lit(0).cast("long").alias("place"), "error"))
    if "bibtex" in globs:
        broken = read_bibtex(spark, path, globs["bibtex"])[1]
        out = out.unionByName(broken.select(F.col("owner").alias("path"), (F.col("block") + F.col("place")).alias("place"), F.concat_ws(": ", "error", F.substring("raw_text", 1, 80)).alias("error")))
    return out


def read(spark: SparkSession, path: str | list[str], backends: dict[str, DataFrame] | None = None, parser: str = "auto") -> tuple[DataFrame, DataFrame]:
    """References and in-text citations of the files under a path, each by its own suffix and opened by its own reader only;
    everything but .pdf, .docx, .bib and .ris is text. ``unreadable`` says what could not be read."""
    globs = _globs(spark, path)
    readers = {
        "text": lambda g: from_texts(_texts(spark, path, g), backends, parser), "bibtex": lambda g: (read_bibtex(spark, path, g)[0], None), "ris": lambda g: (read_ris(spark, path, g), None),
        "docx": lambda g: from_docx(read_docx(spark, path, g), backends, parser), "pdf": lambda g: from_texts(read_pdf(spark, path, g), backends, parser),
    }
    found = [readers[kind](globs[kind]) for kind in readers if kind in globs] or [from_texts(read_texts(spark, path), backends, parser)]
    cited = [c for _, c in found if c is not None]
    return reduce(DataFrame.unionByName, [r for r, _ in found]), reduce(DataFrame.unionByName, cited) if cited else spark.createDataFrame([], INTEXT)
