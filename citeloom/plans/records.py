"""Queries of the readers: the catalogue's records are written in each source's own format and read back.

The written texts are made from ``base`` and ``works_v`` (``views``), so they grow with the documents; the SQL says what
a reader has to find in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import catalog, files
from .oracle import sql
from .views import view

#: What no written record may hold inside a value, in either engine's patterns.
DELIMITERS = r'[{}"<>&@#\\]'


def _told(authors: Column) -> Column:
    return F.array_join(F.transform(authors, lambda a: F.concat_ws("|", a["family"], a["given"])), ";")


def _plain(name: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, DELIMITERS, ""), r"\s+", " "))


def _base(spark: SparkSession, d: str) -> DataFrame:
    """base with title made plain, and people ('Family, Given and ...')."""
    people = F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["family"], a["given"])), " and ")
    return view(spark, d, "base").withColumns({"plain": _plain("title"), "people": people})


def _shown(refs: DataFrame) -> DataFrame:
    fields = ("title", "year", "container_title", "volume", "issue", "pages", "publisher", "doi", "url", "arxiv_id", "type")
    return refs.select("doc_id", "ref_idx", _told(F.col("authors")).alias("authors"), *fields)


def bibtex_records(spark: SparkSession, d: str) -> DataFrame:
    """Three entries a document: a macro and a join, braces twenty deep beside a comment, and quotes around a brace."""
    deep = "{" * 20
    text = F.concat(
        F.lit("@comment{not {this}}\n@string{venue = {"), "journal", F.lit("}}\n@article{a"), "doc_id", F.lit(",\n  title = {{"), "plain", F.lit("}},\n  author = {"), "people", F.lit('},\n  journal = venue # " B",\n  month = jan,\n  year = '), "year",
        F.lit(",\n  volume = "), "volume", F.lit(", number = {"), "issue", F.lit("}, pages = {"), "first_page", F.lit("--"), "last_page", F.lit("}, doi = {https://doi.org/"), "doi", F.lit("}\n}\n@PhdThesis{b, title = " + deep), "plain", F.lit("}" * 20 + ", year = {"), "year",
        F.lit('}, publisher = "North {"} Press", url={http://x.org/'), "doc_id", F.lit("}} @misc(c, title = {Last}, eprint = {2101.00001}, note = unknown)\n@article{broken, title = {never closed\n"),
    )
    return _shown(files.from_bibtex(_base(spark, d).select("doc_id", text.alias("text"))))


def ris_records(spark: SparkSession, d: str) -> DataFrame:
    """Two records a document."""
    lines = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a["family"], F.lit(", "), a["given"])), "\n")
    text = F.concat(
        F.lit("TY  - JOUR\n"), lines, F.lit("\nTI  - "), "plain", F.lit("\nPY  - "), "year", F.lit("/02/03\nJO  - "), "journal", F.lit("\nVL  - "), "volume", F.lit("\nIS  - "), "issue", F.lit("\nSP  - "), "first_page", F.lit("\nEP  - "), "last_page",
        F.lit("\nDO  - "), "doi", F.lit("\nER  - \n\nTY  - BOOK\nT1  - Second of "), "doc_id", F.lit("\nY1  - "), "year", F.lit("\nPB  - North Press\nUR  - http://x.org/"), "doc_id", F.lit("\nER  - \n"),
    )
    return _shown(files.from_ris(_base(spark, d).select("doc_id", text.alias("text"))))


def tei_records(spark: SparkSession, d: str) -> DataFrame:
    """One biblStruct a document; every other person has no forename."""
    person = lambda a, i: F.concat(F.lit("<author><persName>"), F.when(i % 2 == 0, F.concat(F.lit('<forename type="first">'), a["given"], F.lit("</forename>"))).otherwise(""), F.lit("<surname>"), a["family"], F.lit("</surname></persName></author>"))
    xml = F.concat(
        F.lit('<biblStruct xmlns="http://www.tei-c.org/ns/1.0"><analytic><title level="a">'), "plain", F.lit("</title>"), F.array_join(F.transform("authors", person), ""), F.lit('<idno type="DOI">'), "doi", F.lit('</idno><ptr target="http://x.org/'), "doc_id",
        F.lit('"/></analytic><monogr><title level="j">'), "journal", F.lit('</title><imprint><biblScope unit="volume">'), "volume", F.lit('</biblScope><biblScope unit="issue">'), "issue", F.lit('</biblScope><biblScope unit="page" from="'), "first_page", F.lit('" to="'), "last_page",
        F.lit('"/><date type="published" when="'), "year", F.lit('-03-01"/></imprint></monogr></biblStruct>'),
    )
    return _shown(files.from_tei(_base(spark, d).select("doc_id", F.lit(1).alias("ref_idx"), xml.alias("value"))))


def parser_records(spark: SparkSession, d: str) -> DataFrame:
    """One JSON record of a citation parser a document, with lists and single values."""
    record = F.to_json(F.struct(
        F.array("plain").alias("title"), F.transform("authors", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"))).alias("author"), F.concat(F.col("year").cast("string"), F.lit("-05")).alias("date"), F.array("journal").alias("container-title"),
        F.col("volume"), F.array("issue").alias("issue"), F.array(F.concat_ws("-", "first_page", "last_page")).alias("pages"), F.array(F.concat(F.lit("doi:"), F.upper("doi"), F.lit("."))).alias("doi"), F.lit("article-journal").alias("type"),
    ))
    return _shown(files.from_parser_records(_base(spark, d).select("doc_id", F.lit(1).alias("ref_idx"), record.alias("value"))))


def catalog_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record of the catalogue as its source answers, normalised."""
    w = view(spark, d, "works_v").withColumns({"plain": _plain("title"), "n": F.regexp_extract("source_id", r"(\d+)$", 1)})
    of = lambda source: w.where(F.col("source") == source)
    named = F.transform("authors", lambda a: F.struct(F.concat_ws(", ", a["family"], a["given"]).alias("name")))
    shown = F.transform("authors", lambda a: F.struct(F.struct(F.concat_ws(", ", a["family"], a["given"]).alias("display_name")).alias("author")))
    number = F.col("year").cast("string")
    crossref = F.to_json(F.struct(
        F.upper("doi").alias("DOI"), F.array("plain").alias("title"), F.array("container_title").alias("container-title"), F.transform("authors", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"))).alias("author"),
        F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.col("pages").alias("page"), "volume", "issue", "publisher", "type",
    ))
    openalex = F.to_json(F.struct(
        F.concat(F.lit("https://openalex.org/W"), "n").alias("id"), F.col("plain").alias("display_name"), F.col("year").alias("publication_year"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.lit("article").alias("type"), shown.alias("authorships"),
        F.struct(F.struct(F.col("container_title").alias("display_name"), F.lit("journal").alias("type")).alias("source")).alias("primary_location"), F.struct("volume", "issue", F.col("n").alias("first_page"), F.lit("").alias("last_page")).alias("biblio"),
    ))
    pubmed = F.to_json(F.struct(
        F.col("pmid").alias("uid"), F.concat("plain", F.lit(".")).alias("title"), F.concat(number, F.lit(" Mar 3")).alias("pubdate"), F.col("container_title").alias("fulljournalname"), "volume", "issue", "pages", named.alias("authors"),
        F.array(F.struct(F.lit("pii").alias("idtype"), F.lit("x").alias("value")), F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value"))).alias("articleids"), F.array(F.lit("Journal Article")).alias("pubtype"),
    ))
    semantic = F.to_json(F.struct(F.concat(F.lit("p"), "n").alias("paperId"), F.col("plain").alias("title"), "year", F.col("container_title").alias("venue"), named.alias("authors"), F.struct(F.concat(F.lit("10.5/D"), "n").alias("DOI")).alias("externalIds")))
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), a["family"], F.lit(", "), a["given"], F.lit("</name></author>"))), "")
    atom = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), "arxiv_id", F.lit("</id><title>"), "plain", F.lit("</title>"), F.coalesce(F.concat(F.lit("<published>"), number, F.lit("-02-03T00:00:00Z</published>")), F.lit("")), people, F.lit("<arxiv:doi>"), "doi", F.lit("</arxiv:doi></entry>"))
    scholar = F.to_json(F.struct(F.concat(F.lit("http://s.org/"), "n").alias("pub_url"), F.struct(F.col("plain").alias("title"), F.transform("authors", lambda a: F.concat_ws(", ", a["family"], a["given"])).alias("author"), number.alias("pub_year"), F.col("container_title").alias("venue")).alias("bib")))
    made = {"crossref": crossref, "openalex": openalex, "pubmed": pubmed, "semantic_scholar": semantic, "arxiv": atom}
    frames = [catalog.NORMALIZERS[source](of(source).select(value.alias("value"))) for source, value in made.items()]
    frames.append(catalog.scholarly(of("crossref").select(scholar.alias("value"))))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    fields = ("source", "source_id", "source_url", "title", "year", "container_title", "volume", "issue", "pages", "publisher", "doi", "arxiv_id", "pmid", "type")
    return out.select(*fields, _told(F.col("authors")).alias("authors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (bibtex_records, ris_records, tei_records, parser_records, catalog_records)}


def oracle_sql() -> dict[str, str]:
    plain = "trim(regexp_replace(regexp_replace(title, '" + DELIMITERS.replace("'", "''") + "', '', 'g'), '\\s+', ' ', 'g'))"
    # a person's name after reading: marks at its end go
    people = "array_to_string(list_transform(string_split(authors, ';'), lambda a: {0}), ';')"
    cut = people.format("split_part(a, '|', 1) || '|' || rtrim(split_part(a, '|', 2), ',.;')")
    odd = "array_to_string(list_transform(string_split(authors, ';'), lambda a, i: split_part(a, '|', 1) || '|' || CASE WHEN i % 2 = 1 THEN split_part(a, '|', 2) ELSE '' END), ';')"
    ids = "doc_id, CAST({0} AS INT) AS ref_idx"
    row = "SELECT {ids}, {authors} AS authors, {title} AS title, {year} AS year, {journal} AS container_title, {volume} AS volume, {issue} AS issue, {pages} AS pages, {publisher} AS publisher, {doi} AS doi, {url} AS url, {arxiv} AS arxiv_id, '{type}' AS type FROM base"
    none = dict.fromkeys(("authors", "journal", "volume", "issue", "pages", "publisher", "doi", "url", "arxiv"), "''") | {"year": "CAST(NULL AS INT)"}
    whole = none | {"title": plain, "year": "year", "journal": "journal", "volume": "volume", "issue": "issue", "pages": "first_page || '-' || last_page", "doi": "doi", "type": "journal-article"}
    first = whole | {"ids": ids.format(1), "authors": cut}
    link = "'http://x.org/' || doc_id"
    bibtex = " UNION ALL ".join(row.format(**x) for x in (
        first | {"journal": "journal || ' B'"}, none | {"ids": ids.format(2), "title": plain, "year": "year", "publisher": "'North {\"} Press'".replace("{", "{{").replace("}", "}}").format(), "url": link, "type": "thesis"},
        none | {"ids": ids.format(3), "title": "'Last'", "arxiv": "'2101.00001'", "type": "unknown"},
    ))
    ris = " UNION ALL ".join(row.format(**x) for x in (first, none | {"ids": ids.format(2), "title": "'Second of ' || doc_id", "year": "year", "publisher": "'North Press'", "url": link, "type": "book"}))
    work = "SELECT '{source}' AS source, {id} AS source_id, {link} AS source_url, {title} AS title, {year} AS year, {venue} AS container_title, {volume} AS volume, {issue} AS issue, {pages} AS pages, {publisher} AS publisher, {doi} AS doi, {arxiv} AS arxiv_id, {pmid} AS pmid, {type} AS type, {authors} AS authors FROM works_v WHERE source = '{of}'"
    n = "regexp_extract(source_id, '(\\d+)$', 1)"
    bare = dict.fromkeys(("volume", "issue", "pages", "publisher", "doi", "arxiv", "pmid"), "''") | {"title": plain, "year": "year", "venue": "container_title", "type": "'journal-article'", "authors": f"CASE WHEN authors = '' THEN '' ELSE {cut} END"}
    catalogue = " UNION ALL ".join(work.format(**(bare | {"of": x["source"]} | x)) for x in (
        {"source": "crossref", "id": "upper(doi)", "link": "'https://doi.org/' || upper(doi)", "volume": "volume", "issue": "issue", "pages": "pages", "publisher": "publisher", "doi": "doi", "type": "type", "authors": "authors"},
        {"source": "openalex", "id": f"'W' || {n}", "link": f"'https://openalex.org/W' || {n}", "volume": "volume", "issue": "issue", "pages": n, "doi": "doi"},
        {"source": "pubmed", "id": "pmid", "link": "'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/'", "title": f"rtrim({plain}, '.')", "volume": "volume", "issue": "issue", "pages": "pages", "doi": "doi", "pmid": "pmid"},
        {"source": "semantic_scholar", "id": f"'p' || {n}", "link": f"'https://www.semanticscholar.org/paper/p' || {n}", "doi": f"'10.5/d' || {n}"},
        {"source": "arxiv", "id": "arxiv_id", "link": "'http://arxiv.org/abs/' || arxiv_id", "venue": "'arXiv'", "doi": "doi", "arxiv": "arxiv_id", "type": "'posted-content'"},
        {"source": "scholarly", "of": "crossref", "id": f"'http://s.org/' || {n}", "link": f"'http://s.org/' || {n}"},
    ))
    return {
        "bibtex_records": sql(bibtex), "ris_records": sql(ris), "tei_records": sql(row.format(**first | {"authors": odd, "url": link, "type": "unknown"})), "parser_records": sql(row.format(**first | {"authors": "authors"})),
        "catalog_records": sql(catalogue),
    }
