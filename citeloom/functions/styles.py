"""Citations in seven styles, in-text forms, BibTeX and RIS, as Columns over a record.

A record is anything whose fields are reached by name: a struct column or a dict of columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

SUPPORTED_STYLES = ["apa", "mla", "ama", "chicago", "vancouver", "ieee", "harvard"]

# ---- fixed names of the formats
BIBTEX_TYPES = {"journal-article": "article", "book": "book", "book-chapter": "incollection", "proceedings-article": "inproceedings", "posted-content": "misc", "report": "techreport", "thesis": "phdthesis", "webpage": "misc"}
RIS_TYPES = {"journal-article": "JOUR", "book": "BOOK", "book-chapter": "CHAP", "proceedings-article": "CONF", "posted-content": "JOUR", "report": "RPRT", "thesis": "THES"}
# ---- end of fixed names


def _map(names: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key), F.lit(default))


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else t.text(p) for p in parts))


def _if(value: Column, *parts: Column | str) -> Column:
    """The parts joined if the value is there, else ''."""
    return F.when(t.missing(value.cast("string")), "").otherwise(_cat(*parts))


def _join(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), sep)


def _authors(c) -> Column:
    return F.coalesce(c["authors"], F.array().cast(f"array<{t.AUTHOR}>"))


def _family(a: Column) -> Column:
    return t.text(a["family"])


def _comma(front: Column, back: Column) -> Column:
    return F.rtrim(F.trim(_cat(front, ", ", back)), F.lit(","))


def _named(c) -> Column:
    return F.filter(_authors(c), lambda a: ~t.missing(a["family"]))


def _list(names: Column, last: str) -> Column:
    """Commas, and ``last`` before the last of several."""
    n = F.size(names)
    return F.when(n > 1, _cat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), last, F.try_element_at(names, F.lit(-1)))).otherwise(t.text(F.try_element_at(names, F.lit(1))))


def _nth(array: Column, n: int) -> Column:
    return F.try_element_at(array, F.lit(n))


def apa_authors(c) -> Column:
    one = lambda a: _comma(a["family"], t.initials(a["given"]))
    every, named = _authors(c), F.transform(_named(c), one)
    first = F.transform(F.filter(F.slice(every, 1, 19), lambda a: ~t.missing(a["family"])), one)
    return F.when(F.size(every) > 20, _cat(F.array_join(first, ", "), ", ... ", one(_nth(every, -1)))).otherwise(_list(named, ", & "))


def mla_authors(c) -> Column:
    a = _authors(c)
    first, second = _comma(_nth(a, 1)["family"], _nth(a, 1)["given"]), _nth(a, 2)
    return F.when(F.size(a) == 0, "").when(F.size(a) == 1, first).when(F.size(a) == 2, F.trim(_cat(first, ", and ", second["given"], " ", second["family"]))).otherwise(_cat(first, ", et al."))


def ama_authors(c) -> Column:
    names = F.transform(_named(c), lambda a: F.trim(_cat(a["family"], " ", t.compact_initials(a["given"]))))
    return F.when(F.size(names) > 6, _cat(F.array_join(F.slice(names, 1, 3), ", "), ", et al")).otherwise(F.array_join(names, ", "))


def chicago_authors(c) -> Column:
    a = _authors(c)
    rest = F.transform(F.slice(a, 2, 1 << 20), lambda x: F.trim(_cat(x["given"], " ", x["family"])))
    return F.when(F.size(a) == 0, "").otherwise(_list(F.concat(F.array(_comma(_nth(a, 1)["family"], _nth(a, 1)["given"])), rest), ", and "))


def ieee_authors(c) -> Column:
    names = F.transform(_named(c), lambda a: F.trim(_cat(t.initials(a["given"]), " ", a["family"])))
    n = F.size(names)
    return F.when(n > 6, _cat(_nth(names, 1), " et al.")).when(n == 2, _cat(_nth(names, 1), " and ", _nth(names, 2))).otherwise(_list(names, ", and "))


def harvard_authors(c) -> Column:
    names = F.transform(_named(c), lambda a: _comma(a["family"], t.initials(a["given"])))
    return F.when(F.size(names) > 3, _cat(_nth(names, 1), " et al.")).otherwise(_list(names, " and "))


def infer_type(c) -> Column:
    """The record's type, or one that its fields suggest."""
    known = ~t.missing(c["type"]) & (c["type"] != "unknown")
    any_ = ~t.missing(c["volume"]) | ~t.missing(c["pages"]) | ~t.missing(c["doi"]) | ~t.missing(c["issue"])
    return (
        F.when(known, c["type"])
        .when(~t.missing(c["container_title"]) & any_, "journal-article")
        .when(~t.missing(c["arxiv_id"]), "posted-content")
        .when(~t.missing(c["publisher"]) & t.missing(c["container_title"]), "book")
        .otherwise("unknown")
    )


class _Parts:
    """The pieces that the styles share."""

    def __init__(self, c):
        self.year = t.text(c["year"].cast("string"))
        self.venue = t.text(c["container_title"])
        self.publisher, self.volume, self.issue = t.text(c["publisher"]), t.text(c["volume"]), t.text(c["issue"])
        self.pages, self.doi, self.title = t.en_dash(c["pages"]), t.text(c["doi"]), t.text(c["title"])
        self.place = F.when(self.venue != "", self.venue).otherwise(self.publisher)
        self.sentence = _if(self.title, F.rtrim(t.sentence_case(self.title), F.lit(".")), ".")
        self.headline = _if(self.title, '"', t.title_case(self.title), '."')
        self.vol_issue = _cat(self.volume, _if(self.issue, "(", self.issue, ")"))
        self.kind = infer_type(c)
        self.article = self.kind.isin("journal-article", "posted-content")
        self.book = self.kind == "book"


def _by_kind(p: _Parts, article: Column, book: Column, other: Column) -> Column:
    return t.tidy(F.when(p.article, article).when(p.book, book).otherwise(other))


def apa(c) -> Column:
    p, who = _Parts(c), apa_authors(c)
    year = F.when(p.year != "", _cat("(", p.year, ").")).otherwise("(n.d.).")
    post = _join(", ", _if(p.venue, "*", p.venue, "*"), p.vol_issue, p.pages)
    tail = F.when(p.doi != "", _cat(" https://doi.org/", p.doi)).when((c["source"] == "openalex") & ~t.missing(c["source_url"]), _cat(" ", c["source_url"])).otherwise("")
    other = F.when(p.kind == "proceedings-article", _cat(who, " ", year, " ", p.sentence, " ", _if(p.venue, "*", p.venue, "*"), ".")).otherwise(_cat(who, " ", year, " ", p.sentence, " ", p.place))
    return _by_kind(p, _cat(who, " ", year, " ", p.sentence, " ", post, ".", tail), _cat(who, " ", year, " ", p.sentence, " ", p.publisher, "."), other)


def mla(c) -> Column:
    p, who = _Parts(c), mla_authors(c)
    rest = _join(", ", _if(p.volume, "vol. ", p.volume), _if(p.issue, "no. ", p.issue), p.year, _if(p.pages, "pp. ", p.pages))
    article = _cat(_join(" ", _if(who, who, "."), p.headline, _if(p.venue, "*", t.title_case(p.venue), "*"), _if(rest, rest, ".")), _if(p.doi, " doi:", p.doi, "."))
    return _by_kind(p, article, _cat(who, ". ", t.title_case(p.title), ". ", p.publisher, ", ", p.year, "."), _cat(who, ". ", p.headline, " ", p.place, " ", p.year, "."))


def _dated(p: _Parts) -> Column:
    both = (p.year != "") & (p.vol_issue != "")
    return F.when(both & (p.pages != ""), _cat(p.year, ";", p.vol_issue, ":", p.pages, ".")).when(both, _cat(p.year, ";", p.vol_issue, ".")).otherwise(_if(p.year, p.year, "."))


def ama(c) -> Column:
    p, who = _Parts(c), ama_authors(c)
    article = _cat(_join(" ", _cat(who, "."), p.sentence, _if(p.venue, "*", p.venue, "*."), _dated(p)), _if(p.doi, " doi:", p.doi))
    return _by_kind(p, article, _cat(who, ". *", p.sentence, "* ", p.publisher, "; ", p.year, "."), _cat(who, ". ", p.sentence, " ", p.place, ". ", p.year, "."))


def chicago(c) -> Column:
    p, who = _Parts(c), chicago_authors(c)
    year = F.when(p.year != "", p.year).otherwise("n.d.")
    biblio = F.trim(_cat(p.volume, _if(p.issue, ", no. ", p.issue), _if(p.pages, ": ", p.pages)))
    line = F.rtrim(_join(" ", _cat(who, "."), _cat(year, "."), p.headline, _if(p.venue, "*", t.title_case(p.venue), "*"), biblio), F.lit(","))
    article = _cat(line, ".", _if(p.doi, " https://doi.org/", p.doi, "."))
    return _by_kind(p, article, _cat(who, ". ", year, ". *", t.title_case(p.title), "*. ", p.publisher, "."), _cat(who, ". ", year, ". ", p.headline, " ", p.place, "."))


def vancouver(c) -> Column:
    p, who = _Parts(c), ama_authors(c)
    title = _if(p.title, F.rtrim(p.title, F.lit(".")), ".")
    article = _cat(_join(" ", _cat(who, "."), title, _if(p.venue, p.venue, "."), _dated(p)), _if(p.doi, " doi:", p.doi))
    return _by_kind(p, article, _cat(who, ". ", title, " ", p.publisher, "; ", p.year, "."), _cat(who, ". ", title, " ", p.place, ". ", p.year, "."))


def ieee(c, index: Column | None = None) -> Column:
    p, who = _Parts(c), ieee_authors(c)
    prefix = F.lit("") if index is None else _cat("[", index.cast("string"), "] ")
    title = _if(p.title, '"', t.sentence_case(p.title), ',"')
    tail = _join(", ", _if(p.volume, "vol. ", p.volume), _if(p.issue, "no. ", p.issue), _if(p.pages, "pp. ", p.pages), p.year)
    venue = _if(p.venue, "*", t.title_case(p.venue), "*", F.when(tail != "", ",").otherwise(""))
    article = _cat(F.rtrim(_join(" ", _cat(prefix, who, ","), title, venue, tail), F.lit(",")), ".", _if(p.doi, " doi: ", p.doi, "."))
    return _by_kind(p, article, _cat(prefix, who, ", *", t.title_case(p.title), "*. ", p.publisher, ", ", p.year, "."), _cat(prefix, who, ", ", title, " ", p.place, ", ", p.year, "."))


def harvard(c) -> Column:
    p, who = _Parts(c), harvard_authors(c)
    year = F.when(p.year != "", _cat("(", p.year, ")")).otherwise("(no date)")
    title = _if(p.title, "'", F.rtrim(t.sentence_case(p.title), F.lit(".")), "',")
    where = F.btrim(_cat(p.vol_issue, _if(p.pages, ", pp. ", p.pages)), F.lit(", "))
    venue = _if(p.venue, "*", t.title_case(p.venue), "*", F.when(where != "", ",").otherwise(""))
    article = _cat(F.rtrim(_join(" ", who, year, title, venue, where), F.lit(",")), ".", _if(p.doi, " doi: ", p.doi, "."))
    return _by_kind(p, article, _cat(who, " ", year, " *", t.title_case(p.title), "*. ", p.publisher, "."), _cat(who, " ", year, " ", title, " ", p.place, "."))


def format_reference(c, style: str, index: Column | None = None) -> Column:
    """The record in one of SUPPORTED_STYLES; ``index`` numbers AMA, Vancouver and IEEE."""
    s = style.lower()
    if s not in SUPPORTED_STYLES:
        raise ValueError(f"unsupported style {style!r}; there are {SUPPORTED_STYLES}")
    if s == "ieee":
        return ieee(c, index)
    out = {"apa": apa, "mla": mla, "ama": ama, "chicago": chicago, "vancouver": vancouver, "harvard": harvard}[s](c)
    return _cat(index.cast("string"), ". ", out) if index is not None and s in ("ama", "vancouver") else out


def format_intext(c, style: str, index: Column | None = None, page: Column | None = None) -> Column:
    s = style.lower()
    if s not in SUPPORTED_STYLES:
        raise ValueError(f"unsupported style {style!r}; there are {SUPPORTED_STYLES}")
    page = F.lit("") if page is None else t.text(page)
    if s in ("ama", "vancouver", "ieee"):
        return _cat("[", F.lit("0") if index is None else index.cast("string"), _if(page, ", p. ", page), "]")
    names = F.transform(_named(c), _family)
    n, nobody = F.size(names), F.size(_authors(c)) == 0
    year = t.text(c["year"].cast("string"))
    if s == "mla":
        who, tail, alone = " and ", _if(page, " ", page), _if(page, "(", page, ")")
    else:
        who, tail = " & ", _cat(", ", F.when(year != "", year).otherwise("n.d."), _if(page, ", p. ", page))
        alone = _if(year, "(", year, ")")
    many = _cat("(", _nth(names, 1), " et al.", tail, ")")
    return F.when(nobody, alone).when(n == 1, _cat("(", _nth(names, 1), tail, ")")).when(n == 2, _cat("(", _nth(names, 1), who, _nth(names, 2), tail, ")")).otherwise(many)


def citation_key(c) -> Column:
    lead = F.when(F.size(_authors(c)) == 0, F.lit("anon")).otherwise(_family(_nth(_authors(c), 1)))
    return _cat(F.regexp_replace(F.lower(lead), "[^a-z0-9]+", ""), F.coalesce(c["year"].cast("string"), F.lit("nd")))


def bibtex(c) -> Column:
    kind = _map(BIBTEX_TYPES, t.text(c["type"]), "misc")
    line = lambda name, value: F.when(~t.missing(value), _cat(f"  {name} = {{", value, "},"))
    who = F.array_join(F.transform(_authors(c), t.full_name), " and ")
    where = F.when(kind.isin("inproceedings", "incollection"), "booktitle").otherwise("journal")
    lines = [
        _cat("@", kind, "{", citation_key(c), ","), line("author", who), line("title", c["title"]),
        F.when(~t.missing(c["container_title"]), _cat("  ", where, " = {", c["container_title"], "},")),
        line("year", c["year"].cast("string")), line("volume", c["volume"]), line("number", c["issue"]), line("pages", c["pages"]),
        line("publisher", c["publisher"]), line("doi", c["doi"]), line("eprint", c["arxiv_id"]),
        F.when(~t.missing(c["arxiv_id"]), F.lit("  archivePrefix = {arXiv},")), line("pmid", c["pmid"]), F.lit("}"),
    ]
    return F.concat_ws("\n", *lines)


def _page_ends(pages: Column) -> tuple[Column, Column]:
    ends = F.split(F.replace(t.text(pages), F.lit("–"), F.lit("-")), "-", 2)
    return F.trim(_nth(ends, 1)), F.when(F.size(ends) > 1, F.trim(_nth(ends, 2)))


def _ris_lines(kind: Column, c, fields: list[tuple[str, Column]], tail: list[Column]) -> Column:
    line = lambda tag, value: F.when(~t.missing(value), _cat(f"{tag}  - ", value))
    who = F.transform(_authors(c), lambda a: F.rtrim(_cat("AU  - ", a["family"], ", ", a["given"]), F.lit(", ")))
    return F.concat_ws("\n", _cat("TY  - ", kind), who, *(line(tag, value) for tag, value in fields), *tail, F.lit("ER  - "))


def ris(c) -> Column:
    first, last = _page_ends(c["pages"])
    fields = [("TI", c["title"]), ("PY", c["year"].cast("string")), ("JO", c["container_title"]), ("VL", c["volume"]), ("IS", c["issue"]), ("SP", first), ("EP", last), ("DO", c["doi"]), ("PB", c["publisher"])]
    return _ris_lines(_map(RIS_TYPES, t.text(c["type"]), "GEN"), c, fields, [])


def ris_grey(p) -> Column:
    """Grey literature from the parsed entry."""
    fields = [("TI", p["title"]), ("PY", p["year"].cast("string")), ("PB", p["publisher"]), ("UR", p["url"])]
    return _ris_lines(F.lit("GEN"), p, fields, [F.lit("N1  - Grey literature; verified by URL resolution only.")])


def bibtex_grey(p) -> Column:
    line = lambda name, value: F.when(~t.missing(value), _cat(f"  {name} = {{", value, "},"))
    who = F.array_join(F.transform(_authors(p), t.full_name), " and ")
    fields = [("author", who), ("title", p["title"]), ("year", p["year"].cast("string")), ("publisher", p["publisher"]), ("url", p["url"])]
    return F.concat_ws("\n", _cat("@misc{", F.lower(citation_key(p)), ","), *(line(n, v) for n, v in fields), F.lit("  note = {Grey literature; verified by URL resolution only}"), F.lit("}"))
