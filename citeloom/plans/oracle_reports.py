"""Oracle SQL of the reports of an audit with the title search: BibTeX, RIS, and the clean bibliography."""

from __future__ import annotations

from ..functions import styles
from .oracle import FIELDS, FOUND, SEARCHED, results, sql
from .oracle_styles import FAMILY, GIVEN, NAMES, PIECES, each, expressions

CANON = f"""
canon AS (SELECT doc_id, ref_idx, source, source_id, source_url, coalesce(title, '') AS title, type, year, {', '.join(f"coalesce({c}, '') AS {c}" for c in FIELDS if c != 'year')} FROM differed),
told AS (SELECT x.doc_id, x.ref_idx, x.confidence, x.score, r.raw_text, r.title AS r_title, r.authors AS r_authors, r.year AS r_year, r.publisher AS r_publisher, r.url AS r_url, r.doi AS r_doi, c.doc_id IS NOT NULL AS known, c.* EXCLUDE (doc_id, ref_idx)
  FROM results x JOIN refs_v r USING (doc_id, ref_idx) LEFT JOIN canon c USING (doc_id, ref_idx))"""


def _map(names: dict[str, str], default: str) -> str:
    return "(CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{default}' END)"


def _lines(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), chr(10))"


def _full(authors: str) -> str:
    return f"array_to_string({each('trim(' + GIVEN + ' || ' + chr(39) + ' ' + chr(39) + ' || ' + FAMILY + ')', NAMES.format(authors))}, ' and ')"


def _key(authors: str, year: str) -> str:
    lead = f"(CASE WHEN {authors} = '' THEN 'anon' ELSE split_part(split_part({authors}, ';', 1), '|', 1) END)"
    return f"regexp_replace(lower({lead}), '[^a-z0-9]+', '', 'g') || coalesce(CAST({year} AS VARCHAR), 'nd')"


def _field(name: str, value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '  {name} = {{' || {value} || '}},' END"


def _tag(tag: str, value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{tag}  - ' || {value} END"


def _ris(kind: str, authors: str, fields: list[tuple[str, str]], tail: str) -> str:
    who = each(f"rtrim('AU  - ' || {FAMILY} || ', ' || {GIVEN}, ', ')", NAMES.format(authors))
    return f"array_to_string(list_filter(list_concat(list_concat(['TY  - ' || {kind}], {who}), [{', '.join([*(_tag(*f) for f in fields), tail])}]), lambda x: x IS NOT NULL), chr(10))"


def _removed(kind: str) -> str:
    return f"'% HALLUCINATED -- not emitting canonical {kind} for: ' || raw_text[1:120]"


def oracle_sql() -> dict[str, str]:
    ctes = results("default").replace(FOUND, SEARCHED) + "," + CANON
    year, r_year = "CAST(year AS VARCHAR)", "CAST(r_year AS VARCHAR)"
    kind = _map(styles.BIBTEX_TYPES, "misc")
    where = f"CASE WHEN container_title <> '' THEN '  ' || (CASE WHEN {kind} IN ('inproceedings', 'incollection') THEN 'booktitle' ELSE 'journal' END) || ' = {{' || container_title || '}},' END".replace("{{", "{").replace("}}", "}")
    entry = _lines(
        f"'@' || {kind} || '{{' || {_key('authors', 'year')} || ','".replace("{{", "{"), _field("author", _full("authors")), _field("title", "title"), where, _field("year", year), _field("volume", "volume"), _field("number", "issue"),
        _field("pages", "pages"), _field("publisher", "publisher"), _field("doi", "doi"), _field("eprint", "arxiv_id"), "CASE WHEN arxiv_id <> '' THEN '  archivePrefix = {arXiv},' END", _field("pmid", "pmid"), "'}'",
    )
    grey = _lines(
        f"'@misc{{' || lower({_key('r_authors', 'r_year')}) || ','".replace("{{", "{"), _field("author", _full("r_authors")), _field("title", "r_title"), _field("year", r_year), _field("publisher", "r_publisher"), _field("url", "r_url"),
        "'  note = {Grey literature; verified by URL resolution only}'", "'}'",
    )
    first = "trim(split_part(replace(pages, '–', '-'), '-', 1))"
    last = "CASE WHEN contains(replace(pages, '–', '-'), '-') THEN trim(replace(pages, '–', '-')[instr(replace(pages, '–', '-'), '-') + 1:]) END"
    ris = _ris(_map(styles.RIS_TYPES, "GEN"), "authors", [("TI", "title"), ("PY", year), ("JO", "container_title"), ("VL", "volume"), ("IS", "issue"), ("SP", first), ("EP", last), ("DO", "doi"), ("PB", "publisher")], "'ER  - '")
    ris_grey = _ris("'GEN'", "r_authors", [("TI", "r_title"), ("PY", r_year), ("PB", "r_publisher"), ("UR", "r_url")], "'N1  - Grey literature; verified by URL resolution only.', 'ER  - '")
    choose = lambda g, k, kind: f"CASE WHEN confidence = 'verified_via_url' THEN {g} WHEN known AND confidence <> 'hallucinated' THEN {k} ELSE {_removed(kind)} END"
    snippet = "coalesce(nullif(r_title, ''), nullif(raw_text[1:80], ''), '(no title)')"
    clean = f"""CASE WHEN confidence = 'hallucinated' THEN '[REMOVED — hallucinated entry could not be verified: "' || {snippet} || '"]' WHEN confidence = 'verified_via_url' OR NOT known THEN trim(raw_text) ELSE {expressions()['apa'][0]} END"""
    # the whole entry where it changes: what an edit script gives when it is rejected, and when it is applied
    changes = f"""SELECT doc_id, ref_idx, trim(raw_text) AS rejected, {expressions()['apa'][0]} AS applied FROM p WHERE known AND confidence IN ('partial', 'verified_with_style_edits')"""
    changes = f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) AS INT) AS nth FROM ({changes}) WHERE rejected <> applied"
    return {
        "tracked_changes": sql(changes, ctes + PIECES.replace("FROM works_v", "FROM told")),
        "bibtex": sql(f"SELECT doc_id, ref_idx, {choose(grey, entry, 'BibTeX')} AS entry FROM told", ctes),
        "ris": sql(f"SELECT doc_id, ref_idx, {choose(ris_grey, ris, 'RIS')} AS entry FROM told", ctes),
        "clean_bibliography": sql(f"SELECT doc_id, ref_idx, {clean} AS entry FROM p", ctes + PIECES.replace("FROM works_v", "FROM told")),
    }
