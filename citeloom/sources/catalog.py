"""Catalogue records from the databases' own JSON and XML: one projection for each source, to WORKS columns.

Input is a column with one record as a JSON string (arXiv: an Atom entry as XML). Unknown or
missing fields give '' (year: null); a record that does not parse gives a row of empty fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.linkage import WORK_FIELDS

# ---- fixed names of the databases' formats
CROSSREF_TYPES = ["journal-article", "book", "book-chapter", "proceedings-article", "posted-content", "report", "dataset"]
OPENALEX_TYPES = {
    "article": "journal-article", "book": "book", "book-chapter": "book-chapter", "dataset": "dataset", "dissertation": "thesis", "editorial": "journal-article", "erratum": "journal-article", "journal-article": "journal-article",
    "letter": "journal-article", "posted-content": "posted-content", "preprint": "posted-content", "reference-entry": "book-chapter", "report": "report", "review": "journal-article",
}
PUBMED_ARTICLES = ["case reports", "clinical trial", "comment", "editorial", "journal article", "letter", "meta-analysis", "randomized controlled trial", "review", "systematic review"]
PUBMED_PREPRINTS = ["preprint", "preprint version"]
CROSSREF = "DOI string, title array<string>, `container-title` array<string>, author array<struct<family:string,given:string,ORCID:string>>, issued struct<`date-parts`:array<array<int>>>, page string, volume string, issue string, publisher string, type string"
OPENALEX = "id string, title string, display_name string, publication_year int, doi string, type string, authorships array<struct<author:struct<display_name:string,orcid:string>>>, primary_location struct<source:struct<display_name:string,host_organization_name:string,type:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>"
PUBMED = "uid string, title string, pubdate string, epubdate string, fulljournalname string, source string, volume string, issue string, pages string, authors array<struct<name:string>>, articleids array<struct<idtype:string,value:string>>, pubtype array<string>"
S2 = "paperId string, title string, year int, venue string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string,PubMed:string>"
ARXIV = "id string, title string, published string, author array<struct<name:string>>, doi string"
SCHOLARLY = "pub_url string, bib struct<title:string,author:string,pub_year:string,venue:string>"
# ---- end of fixed names

NONE = f"array<{t.AUTHOR}>"


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _names(array: Column, field: str = "name") -> Column:
    return F.coalesce(F.transform(array, lambda a: t.author_of(F.rtrim(F.trim(t.text(a[field])), F.lit(",.;")))), F.array().cast(NONE))


def _works(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    strings = {c: t.text(fields.get(c, F.lit(""))) for c in WORK_FIELDS if c not in ("authors", "year")}
    return rows.select(*(F.coalesce(fields["authors"], F.array().cast(NONE)).alias(c) if c == "authors" else fields["year"].cast("int").alias(c) if c == "year" else strings[c].alias(c) for c in WORK_FIELDS))


def crossref(rows: DataFrame, column: str = "value") -> DataFrame:
    r = F.col("r")
    rows = rows.select(F.from_json(column, CROSSREF).alias("r"))
    authors = F.transform(r["author"], lambda a: F.struct(t.text(a["family"]).alias("family"), t.text(a["given"]).alias("given"), a["ORCID"].alias("orcid")))
    return _works(rows, {
        "source": F.lit("crossref"), "source_id": r["DOI"], "source_url": F.when(~t.missing(r["DOI"]), F.concat(F.lit("https://doi.org/"), r["DOI"])), "authors": authors,
        "title": _first(r["title"]), "year": _first(_first(r["issued"]["date-parts"])), "container_title": _first(r["container-title"]), "volume": r["volume"], "issue": r["issue"], "pages": r["page"],
        "publisher": r["publisher"], "doi": F.lower(r["DOI"]), "type": F.when(r["type"].isin(CROSSREF_TYPES), r["type"]).otherwise("unknown"),
    })


def openalex(rows: DataFrame, column: str = "value") -> DataFrame:
    r = F.col("r")
    rows = rows.select(F.from_json(column, OPENALEX).alias("r"))
    b, src = r["biblio"], r["primary_location"]["source"]
    named = F.transform(r["authorships"], lambda a: F.struct(t.author_of(F.rtrim(F.trim(t.text(a["author"]["display_name"])), F.lit(",.;"))).alias("n"), a["author"]["orcid"].alias("orcid")))
    authors = F.transform(named, lambda a: F.struct(a["n"]["family"].alias("family"), a["n"]["given"].alias("given"), a["orcid"].alias("orcid")))
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in OPENALEX_TYPES.items() for x in kv)), F.lower(t.text(r["type"])))
    like_article = (src["type"] == "journal") | ~t.missing(b["volume"]) | ~t.missing(b["first_page"])
    return _works(rows, {
        "source": F.lit("openalex"), "source_id": F.replace(r["id"], F.lit("https://openalex.org/"), F.lit("")), "source_url": r["id"], "authors": authors,
        "title": F.coalesce(t.nullif(t.text(r["title"])), r["display_name"]), "year": r["publication_year"], "container_title": src["display_name"], "volume": b["volume"], "issue": b["issue"],
        "pages": F.btrim(F.concat(t.text(b["first_page"]), F.lit("-"), t.text(b["last_page"])), F.lit("-")), "publisher": src["host_organization_name"],
        "doi": F.lower(F.replace(r["doi"], F.lit("https://doi.org/"), F.lit(""))), "type": F.coalesce(known, F.when(F.coalesce(like_article, F.lit(False)), "journal-article"), F.lit("unknown")),
    })


def pubmed(rows: DataFrame, column: str = "value") -> DataFrame:
    """Records of a summary's result, each with its uid."""
    r = F.col("r")
    rows = rows.select(F.from_json(column, PUBMED).alias("r"))
    kinds = F.transform(F.coalesce(r["pubtype"], F.array().cast("array<string>")), F.lower)
    article, book = F.exists(kinds, lambda k: k.isin(PUBMED_ARTICLES)), F.exists(kinds, lambda k: k.contains("book"))
    date = F.coalesce(t.nullif(t.text(r["pubdate"])), t.text(r["epubdate"]))
    doi = _first(F.filter(r["articleids"], lambda a: a["idtype"] == "doi"))["value"]
    return _works(rows, {
        "source": F.lit("pubmed"), "source_id": r["uid"], "source_url": F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), r["uid"], F.lit("/")), "authors": _names(r["authors"]),
        "title": F.rtrim(r["title"], F.lit(".")), "year": F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int"), "container_title": F.coalesce(t.nullif(t.text(r["fulljournalname"])), r["source"]),
        "volume": r["volume"], "issue": r["issue"], "pages": r["pages"], "doi": F.lower(doi), "pmid": r["uid"],
        "type": F.when(article, "journal-article").when(book, "book").when(F.exists(kinds, lambda k: k.isin(PUBMED_PREPRINTS)), "posted-content").otherwise("journal-article"),
    })


def semantic_scholar(rows: DataFrame, column: str = "value") -> DataFrame:
    r = F.col("r")
    rows = rows.select(F.from_json(column, S2).alias("r"))
    ids = r["externalIds"]
    return _works(rows, {
        "source": F.lit("semantic_scholar"), "source_id": r["paperId"], "source_url": F.concat(F.lit("https://www.semanticscholar.org/paper/"), t.text(r["paperId"])), "authors": _names(r["authors"]), "title": r["title"],
        "year": r["year"], "container_title": r["venue"], "doi": F.lower(ids["DOI"]), "arxiv_id": F.lower(ids["ArXiv"]), "pmid": ids["PubMed"], "type": F.lit("journal-article"),
    })


def arxiv(rows: DataFrame, column: str = "value") -> DataFrame:
    """Atom entries as XML."""
    r = F.col("r")
    bare = F.regexp_replace(F.col(column), r"(</?)arxiv:", "$1")
    rows = rows.select(F.from_xml(bare, ARXIV, {"rowTag": "entry"}).alias("r"))
    number = F.when(F.contains(r["id"], F.lit("/abs/")), F.substring_index(r["id"], "/abs/", -1))
    title = F.trim(F.replace(F.replace(r["title"], F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))
    return _works(rows, {
        "source": F.lit("arxiv"), "source_id": number, "source_url": r["id"], "authors": _names(r["author"]), "title": title, "year": F.substring(r["published"], 1, 4).try_cast("int"),
        "container_title": F.lit("arXiv"), "doi": F.lower(r["doi"]), "arxiv_id": number, "type": F.lit("posted-content"),
    })


def scholarly(rows: DataFrame, column: str = "value") -> DataFrame:
    """Records of a scholar search; ``bib.author`` is a list of names (as JSON text here, since some are one string)."""
    r = F.col("r")
    rows = rows.select(F.from_json(column, SCHOLARLY).alias("r"))
    b = r["bib"]
    listed = F.coalesce(F.from_json(b["author"], "array<string>"), F.array().cast("array<string>"))
    authors = F.transform(F.filter(listed, lambda a: ~t.missing(a)), lambda a: t.author_of(F.rtrim(F.trim(a), F.lit(",.;"))))
    return _works(rows, {
        "source": F.lit("scholarly"), "source_id": r["pub_url"], "source_url": r["pub_url"], "authors": authors, "title": b["title"],
        "year": F.when(b["pub_year"].rlike(r"^\d+$"), b["pub_year"]).try_cast("int"), "container_title": b["venue"], "type": F.lit("journal-article"),
    })


NORMALIZERS = {"scholarly": scholarly, "crossref": crossref, "openalex": openalex, "pubmed": pubmed, "semantic_scholar": semantic_scholar, "arxiv": arxiv}


def read_catalog(spark, paths: dict[str, str]) -> DataFrame:
    """One catalogue of the sources' files: {source: path of JSON lines (arXiv: one Atom entry a line)}."""
    frames = [NORMALIZERS[source](spark.read.text(path)) for source, path in paths.items()]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
