"""From documents to reference rows: the reference block, its entries, and their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# ---- fixed patterns of the formats
HEADING = r"(?i)^\s*(references|bibliography|works\s+cited|literature\s+cited|citations|reference\s+list)\s*:?\s*$"
NEXT_HEADING = r"(?i)^\s*(appendix|appendices|supplementary|supporting\s+information|acknowledge?ments?|figures?|tables?|index|notes?|glossary|abbreviations?)\b"
LETTER_HEADING = r"^\s*[A-Z]\.\s+[A-Z]"
QUOTED_TITLE = "[\"“]([^\"”]{4,300})[\"”]"
TITLE_AFTER_YEAR = r"\(\d{4}[a-z]?\)\.\s*([^.]{4,300})\."
TITLE_AFTER_AUTHORS = r"\.\s+([A-Z][^.]{4,300})\."
AUTHOR_BLOCK = "(?s)^(.+?)(?=\\s*\\(\\d{4}\\b|\\s*\\(n\\.?d\\.?\\)|[\"“])"
# ---- end of fixed patterns


def _lines(column: Column) -> Column:
    return F.split(t.text(column), "\n")


def _first_index(lines: Column, found, start: Column) -> Column:
    """Index from 0 of the first line from ``start`` on that ``found`` holds for; the number of lines if none."""
    hits = F.filter(F.transform(lines, lambda x, i: F.when((i >= start) & found(F.trim(x), i), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.size(lines))


def _start(lines: Column) -> Column:
    return _first_index(lines, lambda x, i: x.rlike(HEADING), F.lit(0))


def references_block(column: Column) -> Column:
    """The lines under the first reference heading up to the next section, all lines without a heading."""
    lines = _lines(column)
    start = _start(lines) + 1
    end = _first_index(lines, lambda x, i: x.rlike(NEXT_HEADING) | ((i > start) & x.rlike(LETTER_HEADING)), start)
    return F.when(start > F.size(lines), lines).otherwise(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))))


def body_text(column: Column) -> Column:
    """What stands before the heading; '' without one."""
    lines = _lines(column)
    start = _start(lines)
    return F.when(start < F.size(lines), F.array_join(F.slice(lines, 1, start), "\n")).otherwise("")


def looks_like_entry(line: Column) -> Column:
    return line.rlike(r"^[A-Z0-9(\[]") & line.rlike(r"\(\d{4}[a-z]?\)|\b(19|20)\d{2}\b") & (F.length(line) > 30)


def _flat(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def split_entries(block: Column) -> Column:
    """The entries of a block: numbered (only where the whole block starts so twice, which one
    line start cannot), else line by line, else by empty lines, else after a full stop before a name."""
    text = F.array_join(block, "\n")
    lines = F.filter(F.transform(block, lambda s: F.trim(s)), lambda x: x != "")
    likely = F.size(F.filter(lines, looks_like_entry))
    # int() of a share of the lines: whole tenths avoid a different rounding
    enough = (F.size(lines) >= 2) & (likely >= F.greatest(F.lit(2), F.floor(F.size(lines) * 6 / 10).cast("int")))

    def fold(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), line)))
        return F.when(looks_like_entry(line) | (F.size(done) == 0), F.concat(done, F.array(line))).otherwise(longer)

    by_line = F.aggregate(lines, F.array().cast("array<string>"), fold)
    by_gap = F.filter(F.transform(F.split(text, r"\n\s*\n"), _flat), lambda x: x != "")
    by_name = F.filter(F.transform(F.split(F.regexp_replace(text, "\n", " "), r"(?<=[.\]])\s+(?=[A-Z][A-Za-z\-']+,\s+[A-Z]\.)"), _flat), lambda x: x != "")
    out = F.when(enough, F.transform(by_line, _flat)).when(F.size(by_gap) > 1, by_gap).otherwise(by_name)
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.array().cast("array<string>")).otherwise(out)


def entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ref_idx (from 1), raw_text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(split_entries(references_block(F.col(text)))).alias("pos", "raw_text"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("int").alias("ref_idx"), "raw_text")


def _looks_like_title(s: Column) -> Column:
    tokens = F.filter(F.split(s, r"\s+"), lambda x: x != "")
    short = F.size(F.filter(tokens, lambda x: F.rtrim(x, F.lit(".,;")).rlike(r"^[A-Z]{1,2}\.?$")))
    low = F.lower(s)
    url = low.startswith("http://") | low.startswith("https://") | low.startswith("www.") | s.contains("://")
    return (F.length(s) >= 6) & ~s.rlike(r"^[A-Za-z\-']+(?:,\s*[A-Z]\.?)+$") & ~url & (2 * short <= F.size(tokens))


def title_of(raw: Column) -> Column:
    found = F.concat(*(F.regexp_extract_all(t.text(raw), F.lit(p), F.lit(1)) for p in (QUOTED_TITLE, TITLE_AFTER_YEAR, TITLE_AFTER_AUTHORS)))
    clean = F.transform(found, lambda x: F.rtrim(F.trim(x), F.lit(".,;")))
    return t.text(F.try_element_at(F.filter(clean, _looks_like_title), F.lit(1)))


def author_block(raw: Column, title: Column) -> Column:
    """The text before the year or quote, else before the title; not over 250 characters and without the title."""
    raw = t.text(raw)
    at = F.when(title != "", F.instr(raw, title)).otherwise(0)
    before = F.when(at > 1, F.rtrim(F.trim(F.substr(raw, F.lit(1), at - 1)), F.lit(",.;"))).otherwise("")
    first = F.rtrim(F.trim(F.regexp_extract(raw, AUTHOR_BLOCK, 1)), F.lit(",.;"))
    good = lambda s: (s != "") & (F.length(s) <= 250) & ~((title != "") & F.contains(F.lower(s), F.lower(title)))
    return t.text(F.try_element_at(F.filter(F.array(first, before), good), F.lit(1)))


def _people(s: Column) -> Column:
    """Personal names by commas; initials that stand alone belong to the name before."""
    commas = F.regexp_replace(s, r"\s+(?:and|&)\s+", ", ")
    parts = F.filter(F.transform(F.split(commas, ","), lambda s: F.trim(s)), lambda x: x != "")
    initials = lambda x: x.rlike(r"^(?:[A-Z]\.?\s*){1,4}$")

    def fold(state: Column, part: Column) -> Column:
        names, open_ = state["names"], state["open"]
        last = F.concat(F.try_element_at(names, F.lit(-1)), F.lit(", "), part)
        joined = F.concat(F.slice(names, 1, F.size(names) - 1), F.array(last))
        joins = open_ & initials(part)
        return F.struct(F.when(joins, joined).otherwise(F.concat(names, F.array(part))).alias("names"), (~joins).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("open"))
    names = F.aggregate(parts, start, fold, lambda state: state["names"])
    return F.transform(F.slice(names, 1, 50), lambda x: t.author_of(F.rtrim(x, F.lit(",.;"))))


def parse_authors(block: Column) -> Column:
    s = F.rtrim(F.trim(t.text(block)), F.lit(",.;"))
    s = F.regexp_replace(s, r"(?i)[,\s]+et\s+al\.?\s*$", "")
    s = F.regexp_replace(s, r"(?i)[,\s]+and\s+(?:others|colleagues)\s*$", "")
    s = F.rtrim(F.trim(s), F.lit(",.;"))
    sides = F.filter(F.transform(F.split(s, r"\s+(?:and|&)\s+"), lambda s: F.trim(s)), lambda x: x != "")
    whole = lambda x: t.author(F.rtrim(x, F.lit(",.;")), F.lit(""))
    some, every = F.exists(sides, t.is_institution), F.forall(sides, t.is_institution)
    mixed = F.flatten(F.transform(sides, lambda x: F.when(t.is_institution(x), F.array(whole(x))).otherwise(_people(x))))
    split = F.size(sides) > 1
    return (
        F.when(s == "", F.array().cast(f"array<{t.AUTHOR}>"))
        .when(t.is_institution(s), F.array(whole(s)))
        .when(split & every, F.transform(sides, whole))
        .when(split & some & (F.size(sides) <= 3), mixed)
        .otherwise(_people(s))
    )


def venue_of(raw: Column, title: Column) -> dict[str, Column]:
    """container_title, volume, issue, pages, publisher."""
    raw = t.text(raw)
    at = F.instr(raw, title)
    after = F.ltrim(F.when((title != "") & (at > 0), F.substr(raw, at + F.length(title))).otherwise(""), F.lit(' ".”“'))
    named = F.regexp_extract(after, r"^[\s.\"'“”]*([A-Za-z][A-Za-z.&'\-\s]+?)[,.]?\s+\d{1,4}\s*[,(:;]", 1)
    chunk = F.trim(F.regexp_extract(after, r"[.?!]\s+([A-Z][^,.]{2,120})[,.]", 1))
    container = F.when(title == "", "").when(named != "", F.rtrim(F.trim(named), F.lit("."))).otherwise(chunk)
    three = r"\b(\d{1,4})\s*\((\d{1,4})\)\s*[,:]\s*([0-9eA-Z]+\s*[-–]\s*[0-9eA-Z]+)"
    volume, issue, pages = (F.regexp_extract(raw, three, g) for g in (1, 2, 3))
    all_three = volume != ""
    place = r"\b[A-Z][A-Za-z]+(?:,\s*[A-Z]{2,})?:\s+([A-Z][^;]{2,80}?);\s*\d{4}"
    publisher = F.rtrim(F.trim(F.regexp_extract(raw, place, 1)), F.lit("."))
    place_text = F.regexp_extract(raw, place, 0)
    return {
        "container_title": F.when((place_text != "") & (container != "") & F.contains(place_text, container), "").otherwise(container),
        "volume": F.when(all_three, volume).otherwise(F.regexp_extract(raw, r"(?i)\bvol(?:ume)?\.?\s*(\d{1,4})", 1)),
        "issue": issue,
        "pages": F.replace(F.when(all_three, pages).otherwise(F.regexp_extract(raw, r"\bpp?\.?\s*([0-9eA-Z]+\s*[-–]\s*[0-9eA-Z]+)", 1)), F.lit(" "), F.lit("")),
        "publisher": publisher,
    }


def type_of(raw: Column, fields: dict[str, Column]) -> Column:
    raw = t.text(raw)
    return (
        F.when((fields["arxiv_id"] != "") & (fields["doi"] == ""), "posted-content")
        .when(raw.rlike(r"(?i)\bproc(?:eedings)?\b|\bconf(?:erence)?\b"), "proceedings-article")
        .when(raw.rlike(r"(?i)\bpress\b|\bpublisher\b|\bbook\b"), "book")
        .when((fields["container_title"] != "") | (fields["doi"] != "") | (fields["pmid"] != "") | (fields["volume"] != ""), "journal-article")
        .otherwise("unknown")
    )


def parse_entries(rows: DataFrame, raw: str = "raw_text") -> DataFrame:
    """The fields of each entry (REFS columns), from its raw text. One projection, no shuffle."""
    r = F.col(raw)
    rows = rows.withColumns({"doi": t.doi_of(r), "arxiv_id": t.arxiv_of(r), "pmid": t.pmid_of(r), "year": t.year_of(r), "url": t.url_of(r), "title": title_of(r), "isbn": F.lit("")})
    rows = rows.withColumn("authors", parse_authors(author_block(r, F.col("title"))))
    rows = rows.withColumns(venue_of(r, F.col("title")))
    return rows.withColumn("type", type_of(r, {c: F.col(c) for c in ("arxiv_id", "doi", "container_title", "pmid", "volume")}))
