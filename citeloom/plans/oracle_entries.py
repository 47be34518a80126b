"""Oracle SQL of entry parsing: title, authors, venue and type of raw entries. Lookaheads are groups here, folds are lists."""

from __future__ import annotations

from ..operators import entries
from .oracle import institution, lit, sql

ENDS = "',.;'"
#: The author block with what follows it as part of the match.
BLOCK = "(?s)^(.+?)(?:\\s*\\(\\d{4}\\b|\\s*\\(n\\.?d\\.?\\)|[\"“])"
PLACE = r"\b[A-Z][A-Za-z]+(?:,\s*[A-Z]{2,})?:\s+([A-Z][^;]{2,80}?);\s*\d{4}"
THREE = r"\b(\d{1,4})\s*\((\d{1,4})\)\s*[,:]\s*([0-9eA-Z]+\s*[-–]\s*[0-9eA-Z]+)"
PAGES = r"\bpp?\.?\s*([0-9eA-Z]+\s*[-–]\s*[0-9eA-Z]+)"


def got(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def every(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, 1)"


def parts(x: str, pattern: str) -> str:
    """Split, trimmed, none empty."""
    return f"list_filter(list_transform(string_split_regex({x}, {lit(pattern)}), lambda v: trim(v)), lambda v: v <> '')"


def title_like(s: str) -> str:
    tokens = f"list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> '')"
    short = f"len(list_filter({tokens}, lambda w: regexp_matches(rtrim(w, '.,;'), '^[A-Z]{{1,2}}\\.?$')))"
    url = f"(starts_with(lower({s}), 'http://') OR starts_with(lower({s}), 'https://') OR starts_with(lower({s}), 'www.') OR contains({s}, '://'))"
    names = lit("^[A-Za-z\\-']+(?:,\\s*[A-Z]\\.?)+$")
    return f"(length({s}) >= 6 AND NOT regexp_matches({s}, {names}) AND NOT {url} AND 2 * {short} <= len({tokens}))"


def name_of(x: str) -> str:
    """'family|given' of one name."""
    s = f"trim({x})"
    words = f"string_split_regex({s}, '\\s+')"
    front = f"array_to_string({words}[1:greatest(len({words}) - 1, 1)], ' ')"
    return f"""(CASE WHEN contains({s}, ',') THEN trim({s}[1:instr({s}, ',') - 1]) || '|' || trim({s}[instr({s}, ',') + 1:]) WHEN len({words}) < 2 THEN {s} || '|'
      WHEN regexp_matches(replace({words}[-1], '.', ''), '^[A-Z]{{1,4}}$') THEN {front} || '|' || {words}[-1] ELSE {words}[-1] || '|' || {front} END)"""


def people(x: str) -> str:
    """Names by commas: initials that stand alone belong to the name before, unless that has taken some ('c')."""
    listed = parts(f"regexp_replace({x}, '\\s+(?:and|&)\\s+', ', ', 'g')", ",")
    initials = lit(r"^(?:[A-Z]\.?\s*){1,4}$")
    fold = f"""list_reduce(list_transform({listed}, lambda v: [v]), lambda done, v: CASE WHEN done[-1] = 'o' AND regexp_matches(v[1], {initials})
      THEN list_concat(done[1:-3], [done[-2] || ', ' || v[1], 'c']) ELSE list_concat(done[1:-2], [v[1], 'o']) END, ['c'])"""
    return f"list_transform(({fold})[1:-2][1:50], lambda v: {name_of('rtrim(v, ' + lit('.,;') + ')')})"


def _parsed() -> str:
    whole = lambda x: f"rtrim({x}, '.,;') || '|'"
    cut = f"rtrim(trim(a0), {ENDS})"
    cut = f"regexp_replace({cut}, {lit(r'(?i)[,\s]+et\s+al\.?\s*$')}, '')"
    cut = f"rtrim(trim(regexp_replace({cut}, {lit(r'(?i)[,\s]+and\s+(?:others|colleagues)\s*$')}, '')), {ENDS})"
    return f"""
x1 AS (SELECT *, coalesce(list_filter(list_transform(list_concat(list_concat({every('raw', entries.QUOTED_TITLE)}, {every('raw', entries.TITLE_AFTER_YEAR)}), {every('raw', entries.TITLE_AFTER_AUTHORS)}), lambda v: rtrim(trim(v), {ENDS})), lambda v: {title_like('v')})[1], '') AS title FROM ids),
x2 AS (SELECT *, CASE WHEN title <> '' THEN instr(raw, title) ELSE 0 END AS spot, rtrim(trim({got('raw', BLOCK)}), {ENDS}) AS first_ FROM x1),
x3 AS (SELECT *, coalesce(list_filter([first_, CASE WHEN spot > 1 THEN rtrim(trim(raw[1:spot - 1]), {ENDS}) ELSE '' END], lambda v: v <> '' AND length(v) <= 250 AND NOT (title <> '' AND contains(lower(v), lower(title))))[1], '') AS a0,
  CASE WHEN title <> '' AND spot > 0 THEN ltrim(raw[spot + length(title):], ' .”“') ELSE '' END AS after FROM x2),
x4 AS (SELECT *, {cut} AS s, rtrim(trim({got('after', chr(94) + '[' + chr(92) + 's.' + chr(92) + chr(34) + chr(39) + '“”]*([A-Za-z][A-Za-z.&' + chr(39) + chr(92) + '-' + chr(92) + 's]+?)[,.]?' + chr(92) + 's+' + chr(92) + 'd{1,4}' + chr(92) + 's*[,(:;]')}), '.') AS named, trim({got('after', r'[.?!]\s+([A-Z][^,.]{2,120})[,.]')}) AS chunk,
  {got('raw', THREE, 1)} AS v3, {got('raw', THREE, 2)} AS issue, {got('raw', THREE, 3)} AS p3, {got('raw', PLACE, 0)} AS place, rtrim(trim({got('raw', PLACE)}), '.') AS publisher FROM x3),
x5 AS (SELECT *, {parts('s', chr(92) + 's+(?:and|&)' + chr(92) + 's+')} AS sides, CASE WHEN title = '' THEN '' WHEN named <> '' THEN named ELSE chunk END AS container FROM x4),
x6 AS (SELECT *, list_transform(sides, lambda v: {institution('v')}) AS insts FROM x5),
parsed AS (SELECT *, CASE WHEN s = '' THEN [] WHEN {institution('s')} THEN [{whole('s')}] WHEN len(sides) > 1 AND len(list_filter(insts, lambda v: NOT v)) = 0 THEN list_transform(sides, lambda v: {whole('v')})
  WHEN len(sides) BETWEEN 2 AND 3 AND list_contains(insts, true) THEN flatten(list_transform(sides, lambda w, i: CASE WHEN insts[i] THEN [{whole('w')}] ELSE {people('w')} END)) ELSE {people('s')} END AS authors,
  CASE WHEN place <> '' AND container <> '' AND contains(place, container) THEN '' ELSE container END AS container_title,
  CASE WHEN v3 <> '' THEN v3 ELSE {got('raw', r'(?i)\bvol(?:ume)?\.?\s*(\d{1,4})')} END AS volume, replace(CASE WHEN v3 <> '' THEN p3 ELSE {got('raw', PAGES)} END, ' ', '') AS pages FROM x6)"""


def oracle_sql(ids: str) -> dict[str, str]:
    """``ids``: a SELECT of doc_id, raw and the identifiers, year and URL of each entry."""
    kind = f"""CASE WHEN arxiv_id <> '' AND doi = '' THEN 'posted-content' WHEN regexp_matches(raw, {lit(r'(?i)\bproc(?:eedings)?\b|\bconf(?:erence)?\b')}) THEN 'proceedings-article'
      WHEN regexp_matches(raw, {lit(r'(?i)\bpress\b|\bpublisher\b|\bbook\b')}) THEN 'book' WHEN container_title <> '' OR doi <> '' OR pmid <> '' OR volume <> '' THEN 'journal-article' ELSE 'unknown' END"""
    return {
        "parsed_entries": sql(
            f"SELECT doc_id, title, array_to_string(authors, ';') AS authors, year, container_title, volume, issue, pages, publisher, doi, arxiv_id, pmid, url, {kind} AS type FROM parsed",
            f"ids AS ({ids}),{_parsed()}",
        )
    }
