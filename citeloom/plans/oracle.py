"""Oracle SQL (DuckDB) for the registered queries, written apart from the Column functions."""

from __future__ import annotations

from ..functions import text as words
from ..operators import entries, intext
from .views import prefix


def q(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sql(body: str, ctes: str = "") -> str:
    return f"{prefix()}{',' + ctes if ctes else ''} {body}"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def drop(tokens: str, stop) -> str:
    return f"list_filter({tokens}, lambda w: w <> '' AND NOT list_contains({q(stop)}, w))"


def title(x: str) -> str:
    plain = f"regexp_replace(regexp_replace({fold(x)}, '<[^>]+>', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')"
    return f"array_to_string({drop(f'string_split_regex(trim({plain}), {lit(chr(92) + chr(115) + chr(43))})', words.STOP_WORDS)}, ' ')"


def surname(x: str) -> str:
    return f"regexp_replace({fold(x)}, '[^a-z]+', '', 'g')"


def surnames(authors: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split({authors}, ';'), lambda a: {surname('split_part(a, chr(124), 1)')}), lambda s: s <> ''))"


def lead_surnames(authors: str) -> str:
    """In order; list_distinct does not keep it."""
    return f"list_filter(list_transform(string_split({authors}, ';'), lambda a: {surname('split_part(a, chr(124), 1)')}), lambda s: s <> '')"


def journal(x: str) -> str:
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in words.JOURNAL_WORDS.items()) + "}"
    found = f"regexp_extract_all({fold(x)}, '[a-z]+\\.?|[0-9]+')"
    return f"array_to_string({drop(f'list_transform({found}, lambda k: coalesce({names}[k], rtrim(k, {lit(chr(46))})))', words.STOP_WORDS)}, ' ')"


def institution_key(x: str) -> str:
    return f"array_to_string({drop(f'string_split_regex(trim(regexp_replace({fold(x)}, {lit('[^a-z' + chr(92) + 's]+')}, {lit('')}, {lit('g')})), {lit(chr(92) + 's+')})', words.CONNECTIVES)}, '')"


def institution(x: str) -> str:
    s = f"rtrim(trim(coalesce({x}, '')), '.,;')"
    w = f"list_filter(string_split_regex({s}, '\\s+'), lambda k: k <> '')"
    personal = " OR ".join(f"regexp_matches({s}, {lit(p)})" for p in (r",\s*[A-Z]\.", r",\s+[A-Z][a-z\-']+\s+[A-Z]{1,4}\b", r"^[A-Z][a-z\-']+\s+[A-Z]{1,4}$"))
    marked = f"len(list_filter({w}, lambda k: list_contains({q(words.INSTITUTION_WORDS)}, lower(rtrim(k, '.,;'))))) > 0"
    caps = f"len(list_filter({w}, lambda k: regexp_matches(k, '^\\p{{Lu}}')))"
    conn = f"len(list_filter({w}, lambda k: list_contains({q(words.CONNECTIVES)}, lower(k))))"
    return f"({s} <> '' AND NOT ({personal}) AND ({marked} OR (len({w}) >= 3 AND {caps} >= 3 AND {caps} + {conn} >= len({w}) - 1)))"


def overlap(a: str, b: str) -> str:
    x, y = surnames(a), surnames(b)
    return f"(CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len({x}), len({y})) ELSE 0 END)"


def pages(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\-–—]', '-', 'g'))"


def abbreviates(a: str, b: str) -> str:
    tokens = lambda x: f"list_filter(regexp_extract_all({fold(x)}, '[a-z]+'), lambda k: NOT list_contains({q(words.JOURNAL_CONNECTIVES)}, k))"

    def within(s: str, m: str) -> str:
        hit = f"list_position(list_transform({m}[spot + 1:], lambda k: starts_with(k, {s}[i]) OR starts_with({s}[i], k)), true)"
        return f"list_reduce(list_transform(range(1, len({s}) + 1), lambda n: CAST(n AS INT)), lambda spot, i: CAST(CASE WHEN spot < 0 OR coalesce({hit}, 0) = 0 THEN -1 ELSE spot + {hit} END AS INT), 0) >= 0"

    return f"(len({tokens(a)}) > 0 AND len({tokens(b)}) > 0 AND ({within(tokens(a), tokens(b))} OR {within(tokens(b), tokens(a))}))"


def ratio(src: str, a: str, b: str, out: str, name: str) -> str:
    """CTEs that add the token set ratio of two normalised columns; the subsequence is a fold of rows."""
    lcs = """list_last(list_reduce(list_transform(string_split(p_, ''), lambda c: [unicode(c)]),
        lambda row, c: list_reduce(list_transform(range(1, len(q_) + 1), lambda j: [CAST(j AS INT)]),
          lambda acc, j: list_append(acc, CASE WHEN unicode(q_[j[1]]) = c[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], list_last(acc)) END), [CAST(0 AS INT)]),
        list_transform(range(len(q_) + 1), lambda i: CAST(0 AS INT))))"""
    lengths = "length(s_) AS s, CASE WHEN s_ <> '' THEN 1 ELSE 0 END AS j, length(p_) AS p, length(q_) AS q"
    return f"""
{out}_1 AS (SELECT *, list_sort(list_distinct(list_filter(string_split({a}, ' '), lambda x: x <> ''))) AS ta_, list_sort(list_distinct(list_filter(string_split({b}, ' '), lambda x: x <> ''))) AS tb_ FROM {src}),
{out}_2 AS (SELECT *, array_to_string(list_filter(ta_, lambda x: list_contains(tb_, x)), ' ') AS s_, array_to_string(list_filter(ta_, lambda x: NOT list_contains(tb_, x)), ' ') AS p_,
  array_to_string(list_filter(tb_, lambda x: NOT list_contains(ta_, x)), ' ') AS q_ FROM {out}_1),
{out}_3 AS (SELECT * EXCLUDE (ta_, tb_, s_, p_, q_), len(ta_) = 0 OR len(tb_) = 0 AS none_, s_ <> '' AND (p_ = '' OR q_ = '') AS whole_, {lengths}, CASE WHEN p_ = '' OR q_ = '' THEN 0 ELSE {lcs} END AS l FROM {out}_2),
{out} AS (SELECT * EXCLUDE (none_, whole_, s, j, p, q, l), round(CASE WHEN none_ THEN 0 WHEN whole_ THEN 100 ELSE greatest(200.0::DOUBLE * (s + j + l) / (2 * s + 2 * j + p + q),
  CASE WHEN j = 1 THEN 100::DOUBLE * (1 - (j + p)::DOUBLE / (2 * s + j + p)) END, CASE WHEN j = 1 THEN 100::DOUBLE * (1 - (j + q)::DOUBLE / (2 * s + j + q)) END) END, 6) AS {name} FROM {out}_3)"""


W = "w.source, w.source_id, w.source_url, w.authors AS w_authors, w.title AS w_title, w.year AS w_year, w.container_title AS w_container, w.volume AS w_volume, w.issue AS w_issue, w.pages AS w_pages, w.publisher AS w_publisher, w.doi AS w_doi, w.arxiv_id AS w_arxiv, w.pmid AS w_pmid, w.type AS w_type"
RANK = "list_position(['crossref', 'openalex', 'pubmed', 'semantic_scholar', 'arxiv', 'scholarly'], {})"
FOUND = f"""
found AS (
  SELECT DISTINCT r.doc_id, r.ref_idx, {W} FROM refs_v r JOIN works_v w ON r.doi <> '' AND lower(r.doi) = lower(w.doi) AND w.source IN ('crossref', 'openalex')
  UNION SELECT r.doc_id, r.ref_idx, {W} FROM refs_v r JOIN works_v w ON r.pmid <> '' AND r.pmid = w.pmid AND w.source = 'pubmed'
  UNION SELECT r.doc_id, r.ref_idx, {W} FROM refs_v r JOIN works_v w ON r.arxiv_id <> '' AND w.arxiv_id <> '' AND regexp_replace(lower(r.arxiv_id), 'v[0-9]+$', '') = regexp_replace(lower(w.arxiv_id), 'v[0-9]+$', '') AND w.source = 'arxiv')"""
SANDBOX = "(w_doi <> '' AND lower(w_doi) LIKE '10.65215/%')"
SCORED = f"""{FOUND},
pairs AS (SELECT f.*, r.title AS r_title, r.year AS r_year, r.authors AS r_authors, r.doi AS r_doi, {title('r.title')} AS nr, {title('f.w_title')} AS nw FROM found f JOIN refs_v r USING (doc_id, ref_idx)),
{ratio('pairs', 'nr', 'nw', 'rated', 'title_score')},
scored AS (SELECT *, CASE WHEN r_title = '' OR w_title = '' THEN 0.0 ELSE round(0.55::DOUBLE * title_score + 0.25::DOUBLE * (CASE WHEN r_authors = '' THEN 60.0 ELSE {overlap('r_authors', 'w_authors')} * 100 END)
    + 0.15::DOUBLE * (CASE WHEN r_year IS NULL THEN 60 WHEN r_year = w_year THEN 100 WHEN abs(r_year - w_year) <= 1 THEN 70 ELSE 50 END)
    + 0.05::DOUBLE * (CASE WHEN r_doi <> '' AND w_doi <> '' AND lower(r_doi) = lower(w_doi) THEN 30 ELSE 0 END) - (CASE WHEN {SANDBOX} THEN 15 ELSE 0 END), 6) END AS score FROM rated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_idx ORDER BY {SANDBOX}, score DESC, {RANK.format('source')}, source_id) AS place FROM scored)"""
CORROBORATED = f"""{SCORED},
firsts AS (SELECT doc_id, ref_idx, w_title AS b_title, w_year AS b_year, w_authors AS b_authors, w_doi AS b_doi, nw AS nb FROM ranked WHERE place = 1),
against AS (SELECT * FROM ranked JOIN firsts USING (doc_id, ref_idx)),
{ratio('against', 'nb', 'nw', 'likened', 'likeness')},
judged AS (SELECT *, {overlap('b_authors', 'w_authors')} >= 0.5 OR b_authors = '' OR w_authors = '' AS names_agree FROM likened),
good AS (SELECT *, place > 1 AND w_title <> '' AND likeness >= 88 AND coalesce(abs(b_year - w_year) <= 1, true) AND ((b_doi <> '' AND w_doi <> '' AND lower(b_doi) = lower(w_doi)) OR names_agree) AS good FROM judged),
corr AS (SELECT *, good AND row_number() OVER (PARTITION BY doc_id, ref_idx, good, source, source_url ORDER BY place) = 1 AS corroborates FROM good)"""


def _filled(field: str, column: str) -> str:
    empty = f"{column} IS NULL" if field == "year" else f"{column} = ''" + (f" OR {SANDBOX}" if field == "doi" else "")
    best = f"max(CASE WHEN place = 1 AND NOT ({empty}) THEN {column} END)"
    return f"coalesce({best}, min_by({column}, place) FILTER (WHERE corroborates AND NOT ({empty}))) AS {field}"


FIELDS = {"doi": "w_doi", "container_title": "w_container", "volume": "w_volume", "issue": "w_issue", "pages": "w_pages", "publisher": "w_publisher", "arxiv_id": "w_arxiv", "pmid": "w_pmid", "year": "w_year", "authors": "w_authors"}
MERGED = f"""{CORROBORATED},
merged AS (SELECT doc_id, ref_idx, max(CASE WHEN place = 1 THEN score END) AS score, max(CASE WHEN place = 1 THEN title_score END) AS title_score, max(CASE WHEN place = 1 THEN source END) AS source, max(CASE WHEN place = 1 THEN source_id END) AS source_id, max(CASE WHEN place = 1 THEN source_url END) AS source_url,
  max(CASE WHEN place = 1 THEN w_title END) AS title, max(CASE WHEN place = 1 THEN w_type END) AS type, count(DISTINCT CASE WHEN place = 1 OR (corroborates AND likeness >= 90 AND names_agree) THEN source END) AS sources_agreeing,
  {', '.join(_filled(f, c) for f, c in FIELDS.items())} FROM corr GROUP BY doc_id, ref_idx)"""

_E = lambda x: f"coalesce({x}, '')"
_BOTH = lambda f: f"({_E('r.' + f)} <> '' AND {_E('m.' + f)} <> '')"
_NUM = lambda x: f"(CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE trim({x}) END)"
_RANGE = "regexp_matches(r.pages, '^\\s*\\d+\\s*[-–]\\s*\\d+')"
_END = lambda i: f"CAST(regexp_replace(split_part(replace(r.pages, '–', '-'), '-', {i}), '[^0-9]', '', 'g') AS BIGINT)"
_NAMES = lambda x: f"array_to_string(list_transform(string_split({_E(x)}, ';')[1:5], lambda a: trim(split_part(a, '|', 2) || ' ' || split_part(a, '|', 1))), '; ')"
_COUNT = lambda x: f"(CASE WHEN {_E(x)} = '' THEN 0 ELSE len(string_split({x}, ';')) END)"
_OV = overlap(_E("r.authors"), _E("m.authors"))
_DEAD = "(r.doi <> '' AND k.doi IS NULL)"
_RULES = [
    (f"{_BOTH('title')} AND title_score < 92", "title", "r.title", "m.title", "'major'"),
    ("r.year <> m.year", "year", "CAST(r.year AS VARCHAR)", "CAST(m.year AS VARCHAR)", "CASE WHEN abs(r.year - m.year) > 1 THEN 'major' ELSE 'minor' END"),
    (_DEAD, "doi (does not resolve)", "r.doi", f"CASE WHEN {_E('m.doi')} = '' THEN '(canonical record has no DOI)' ELSE m.doi END", "'major'"),
    (f"NOT {_DEAD} AND {_BOTH('doi')} AND lower(r.doi) <> lower(m.doi)", "doi", "r.doi", "m.doi", "'major'"),
    (f"{_BOTH('container_title')} AND journal_score < 80 AND NOT {abbreviates('r.container_title', 'm.container_title')}", "journal", "r.container_title", "m.container_title", "'major'"),
    (f"{_BOTH('authors')} AND {_OV} < 0.5", "authors (surnames disagree)", _NAMES("r.authors"), _NAMES("m.authors"), "'major'"),
    (f"{_BOTH('authors')} AND {_OV} >= 0.5 AND {_COUNT('m.authors')} > {_COUNT('r.authors')} + 1 AND NOT regexp_matches(r.raw_text, '(?i)\\bet\\s+al\\.?')", "author count", f"CAST({_COUNT('r.authors')} AS VARCHAR) || ' listed'", f"CAST({_COUNT('m.authors')} AS VARCHAR) || ' on the canonical record'", "'minor'"),
    (f"{_BOTH('volume')} AND {_NUM('r.volume')} <> {_NUM('m.volume')}", "volume", "r.volume", "m.volume", "'major'"),
    (f"{_BOTH('issue')} AND {_NUM('r.issue')} <> {_NUM('m.issue')}", "issue", "r.issue", "m.issue", "'major'"),
    (f"{_BOTH('pages')} AND {pages('r.pages')} <> {pages('m.pages')}", "pages", "r.pages", "m.pages", "'major'"),
    ("r.year > 2027", "year (future)", "CAST(r.year AS VARCHAR)", "'<= 2026'", "'major'"),
    ("r.year < 1665", "year (implausibly historical)", "CAST(r.year AS VARCHAR)", "'>= 1665'", "'major'"),
    (f"CASE WHEN {_RANGE} THEN {_END(1)} > {_END(2)} ELSE false END", "pages (backwards)", "r.pages", "'start > end is impossible'", "'major'"),
    (f"CASE WHEN {_RANGE} THEN {_END(2)} - {_END(1)} > 1500 ELSE false END", "pages (implausibly long)", "r.pages", f"'range spans ' || CAST({_END(2)} - {_END(1)} AS VARCHAR) || ' pages'", "'minor'"),
    ("regexp_matches(r.pages, '\\bPMC\\d{5,}\\b')", "pages (PMC ID in pages slot)", "r.pages", "'PMC IDs do not belong in the pages field'", "'major'"),
]
_LISTED = ", ".join(f"CASE WHEN {c} THEN struct_pack(field := '{f}', parsed := {_E(p)}, canonical := {_E(m)}, severity := {s}) END" for c, f, p, m, s in _RULES)
# journals first get their ratio, then every rule is a case
DIFFERED = f"""{MERGED},
journals AS (SELECT m.*, {journal('r.container_title')} AS jr, {journal('m.container_title')} AS jm FROM merged m JOIN refs_v r USING (doc_id, ref_idx)),
{ratio('journals', 'jr', 'jm', 'compared', 'journal_score')},
differed AS (SELECT m.*, list_filter([{_LISTED}], lambda x: x IS NOT NULL) AS diffs, r.authors AS r_authors, r.pages AS r_pages, r.title AS r_title, r.year AS r_year, r.doi AS r_doi, r.arxiv_id AS r_arxiv, r.pmid AS r_pmid
  FROM compared m JOIN refs_v r USING (doc_id, ref_idx) LEFT JOIN doi_v k ON lower(k.doi) = lower(r.doi))"""
_CAPS = lambda g: f"list_transform(list_filter(string_split_regex({g}, '[\\s.\\-]+'), lambda x: x <> ''), lambda x: upper(x[1]))"
_FAMILY, _GIVEN = "split_part(a, '|', 1)", "split_part(a, '|', 2)"
EDITED = f"""{DIFFERED},
named AS (SELECT d.doc_id, d.ref_idx, unnest(string_split({_E('d.r_authors')}, ';')) AS a, generate_subscripts(string_split({_E('d.r_authors')}, ';'), 1) AS n, string_split({_E('d.authors')}, ';') AS known FROM differed d),
knowns AS (SELECT doc_id, ref_idx, n, {_FAMILY} AS family, {_GIVEN} AS given, list_last(list_filter(known, lambda k: lower(split_part(k, '|', 1)) = lower(split_part(a, '|', 1)) AND k <> '')) AS k FROM named WHERE a <> ''),
capitals AS (SELECT *, {_CAPS('given')} AS mine, {_CAPS("split_part(k, '|', 2)")} AS theirs FROM knowns WHERE k IS NOT NULL),
edits AS (
  SELECT doc_id, ref_idx, 'author ''' || split_part(k, '|', 1) || '''' AS field, family || ', ' || given AS original, split_part(k, '|', 1) || ', ' || array_to_string(theirs, '. ') || '.' AS corrected
  FROM capitals WHERE len(theirs) > len(mine) AND len(mine) > 0 AND starts_with(array_to_string(theirs, ''), array_to_string(mine, ''))
  UNION ALL SELECT doc_id, ref_idx, 'pages', r_pages, replace(r_pages, '-', '–') FROM differed
  WHERE contains(r_pages, '-') AND NOT contains(r_pages, '–') AND ({_E('pages')} = '' OR {pages('r_pages')} = {pages(_E('pages'))})),
kept AS (SELECT e.* FROM edits e JOIN differed d USING (doc_id, ref_idx) WHERE len(list_filter(d.diffs, lambda x: starts_with(e.field, split_part(x.field, ' ', 1)))) = 0)"""
_SAME = lambda f, r: f"(d.{r} <> '' AND {_E('d.' + f)} <> '' AND lower(d.{r}) = lower(d.{f}))"
_FIRST = lambda x: surname(f"split_part({x}, '|', 1)")
TIERED = f"""{EDITED},
tiered AS (SELECT d.doc_id, d.ref_idx, d.score, d.sources_agreeing, len(d.diffs) AS n_diffs, (SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id AND k.ref_idx = d.ref_idx) AS n_edits,
  (d.score >= 88 AND d.sources_agreeing >= 2) OR {_SAME('doi', 'r_doi')} OR {_SAME('arxiv_id', 'r_arxiv')} OR {_SAME('pmid', 'r_pmid')}
  OR (d.r_title <> '' AND d.title <> '' AND d.title_score >= 95 AND (d.r_authors = '' OR {_E('d.authors')} = '' OR {_FIRST('d.r_authors')} = {_FIRST(_E('d.authors'))} OR {overlap('d.r_authors', _E('d.authors'))} >= 0.34))
  OR (d.r_title <> '' AND d.title <> '' AND d.title_score >= 97 AND coalesce(abs(d.r_year - d.year) <= 1, true)) AS real FROM differed d),
based AS (SELECT r.doc_id, r.ref_idx, coalesce(t.score, 0) AS score, coalesce(t.sources_agreeing, 0) AS sources_agreeing, CASE WHEN t.doc_id IS NULL OR t.score < 70 OR NOT t.real THEN 'hallucinated' WHEN n_diffs > 0 THEN 'partial' WHEN n_edits > 0 THEN 'verified_with_style_edits' ELSE 'verified' END AS tier,
  (r.doi = '' OR k.doi IS NOT NULL) AS doi_ok, coalesce(u.resolves, false) AS url_ok, {institution("split_part(split_part(r.authors, ';', 1), '|', 1)")} AS inst
  FROM refs_v r LEFT JOIN tiered t USING (doc_id, ref_idx) LEFT JOIN doi_v k ON lower(k.doi) = lower(r.doi) LEFT JOIN url_v u ON r.url <> '' AND u.url = r.url)"""


def results(strictness: str) -> str:
    grey = {"strict": "tier", "default": "'verified_via_url'", "relaxed": "'verified'"}[strictness]
    return f"{TIERED}, results AS (SELECT doc_id, ref_idx, score, sources_agreeing, CASE WHEN tier = 'hallucinated' AND doi_ok AND (url_ok OR inst) THEN {grey} ELSE tier END AS confidence FROM based)"


_TERMS = f"""
terms AS (SELECT source, source_id, unnest(list_distinct(list_filter(string_split({title('title')}, ' '), lambda x: x <> ''))) AS term FROM works_v),
asked AS (SELECT doc_id, ref_idx, year, authors, arxiv_id, title, unnest(list_distinct(list_filter(string_split({title('title')}, ' '), lambda x: x <> ''))) AS term FROM refs_v WHERE title <> ''),
hits AS (SELECT r.doc_id, r.ref_idx, t.source, t.source_id, count(*) AS shared, any_value(r.year) AS year, any_value(r.authors) AS authors, any_value(r.arxiv_id) AS arxiv_id, any_value(r.title) AS title FROM asked r JOIN terms t USING (term) GROUP BY ALL),
fits AS (SELECT h.*, w.year AS w_year, CASE h.source WHEN 'openalex' THEN h.year IS NULL OR coalesce(h.year = w.year, false)
    WHEN 'pubmed' THEN (h.year IS NULL OR coalesce(h.year = w.year, false)) AND (len({surnames('h.authors')}) = 0 OR list_contains({surnames('w.authors')}, {lead_surnames('h.authors')}[1]))
    WHEN 'arxiv' THEN h.arxiv_id = '' AND contains({title('w.title')}, {title('h.title')}) AND len(list_filter({lead_surnames('h.authors')}[1:2], lambda x: NOT list_contains({surnames('w.authors')}, x))) = 0
    ELSE true END AS fits, CASE h.source WHEN 'crossref' THEN len(list_filter({lead_surnames('h.authors')}[1:3], lambda x: list_contains({surnames('w.authors')}, x))) ELSE 0 END AS friends FROM hits h JOIN works_v w ON w.source = h.source AND w.source_id = h.source_id),
top5 AS (SELECT doc_id, ref_idx, source, source_id, shared FROM fits WHERE fits QUALIFY row_number() OVER (PARTITION BY doc_id, ref_idx, source ORDER BY shared DESC, friends DESC, abs(coalesce(year - w_year, 99)), source_id) <= 5)"""
#: Candidates by identifier and, where those do not decide, by title: takes the place of FOUND.
SEARCHED = f"""{FOUND.replace("found AS", "by_id AS", 1)},{_TERMS},
id_pairs AS (SELECT f.doc_id, f.ref_idx, r.doi <> '' AND f.w_doi <> '' AND lower(r.doi) = lower(f.w_doi) AND r.title <> '' AS same, {title('r.title')} AS nr, {title('f.w_title')} AS nw FROM by_id f JOIN refs_v r USING (doc_id, ref_idx)),
{ratio('id_pairs', 'nr', 'nw', 'id_rated', 'id_score')},
decided AS (SELECT doc_id, ref_idx FROM id_rated GROUP BY doc_id, ref_idx HAVING bool_or(same AND id_score >= 92) AND count(*) >= 2),
found AS (SELECT * FROM by_id UNION SELECT t.doc_id, t.ref_idx, {W} FROM top5 t JOIN works_v w ON w.source = t.source AND w.source_id = t.source_id WHERE (t.doc_id, t.ref_idx) NOT IN (SELECT (doc_id, ref_idx) FROM decided))"""


_LINES = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM paper_v),
heads AS (SELECT doc_id, min(pos) AS head FROM lines WHERE regexp_matches(trim(line), {heading}) GROUP BY doc_id),
ends AS (SELECT l.doc_id, min(l.pos) AS stop FROM lines l JOIN heads h USING (doc_id) WHERE l.pos > h.head AND (regexp_matches(trim(line), {next}) OR (l.pos > h.head + 1 AND regexp_matches(trim(line), {letter}))) GROUP BY l.doc_id)
""".format(heading=lit(entries.HEADING), next=lit(entries.NEXT_HEADING), letter=lit(entries.LETTER_HEADING))
_BLOCK = "coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM lines l WHERE l.doc_id = p.doc_id AND (h.head IS NULL OR l.pos > h.head) AND (e.stop IS NULL OR l.pos < e.stop)), '')"
_BODY = "coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM lines l WHERE l.doc_id = p.doc_id AND l.pos < h.head), '')"

_DOI = r"rtrim(regexp_extract({0}, '\b(10\.\d{{4,9}}/[^\s\"''<>]+)', 1), '.,;:)')"
_KEYS = f"""
keys AS (SELECT doc_id, ref_idx, year, {institution("split_part(a, '|', 1)")} AND split_part(a, '|', 2) = '' AS inst, split_part(a, '|', 1) AS family
  FROM (SELECT doc_id, ref_idx, year, unnest(string_split(authors, ';')) AS a FROM refs_v WHERE year IS NOT NULL) WHERE split_part(a, '|', 1) <> ''),
named AS (SELECT doc_id, ref_idx, year, inst, CASE WHEN inst THEN {institution_key('family')} ELSE {surname('family')} END AS name FROM keys)"""


def oracle_sql() -> dict[str, str]:
    from . import oracle_entries

    text = "regexp_extract(raw, {0}, {1})"
    year = f"TRY_CAST(coalesce(nullif({text.format(lit(chr(92) + '((1[6-9]' + chr(92) + 'd{2}|20' + chr(92) + 'd{2})' + chr(92) + 'b'), 1)}, ''), nullif({text.format(lit(r'\b(1[6-9]\d{2}|20\d{2})\s*;'), 1)}, ''), nullif({text.format(lit(r'\b(1[6-9]\d{2}|20\d{2})\b'), 1)}, '')) AS INT)"
    doi = f"lower({_DOI.format('raw')})"
    named_arxiv = text.format(lit(r"(?i)\barXiv:?\s*([a-z\-]+/\d{7}|\d{4}\.\d{4,5}(?:v\d+)?)\b"), 1)
    ids = f"doc_id, {doi} AS doi, CASE WHEN {named_arxiv} <> '' THEN lower({named_arxiv}) ELSE {text.format(lit(r'\b(\d{4}\.\d{4,5}(?:v\d+)?)\b'), 1)} END AS arxiv_id, {text.format(lit(r'(?i)\bPMID:?\s*(\d{1,9})\b'), 1)} AS pmid, {year} AS year, CASE WHEN {doi} = '' THEN rtrim({text.format(lit(r'(https?://\S+)'), 1)}, '.,);') ELSE '' END AS url"
    host = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"
    reputable = " OR ".join(f"ends_with({host}, '{d}') OR {host} = '{d.lstrip('.')}'" for d in words.REPUTABLE_HOSTS)
    tiers = "(VALUES ('hallucinated'), ('partial'), ('verified_with_style_edits'), ('verified_via_url'), ('verified')) AS v(confidence)"
    out = {
        "normalize_title_docs": f"SELECT doc_id, md5({title('text')}) AS title_md5 FROM documents",
        "normalize_compatible_docs": f"SELECT doc_id, md5({title('text')}) AS title_md5 FROM documents",
        "normalize_names": sql(f"SELECT doc_id, ref_idx, n, {surname('family')} AS surname, {institution_key('family')} AS institution_key, {institution('family')} AS institutional, upper(trim(given)[1:1]) AS initial FROM (SELECT doc_id, ref_idx, CAST(generate_subscripts(string_split(authors, ';'), 1) AS INT) AS n, split_part(unnest(string_split(authors, ';')), '|', 1) AS family, split_part(unnest(string_split(authors, ';')), '|', 2) AS given FROM refs_v)"),
        "journal_match": sql(f"SELECT doc_id, {journal('short_journal')} AS short_key, {journal('journal')} AS full_key, {abbreviates('short_journal', 'journal')} AS abbreviates, {abbreviates('journal', 'volume')} AS with_volume FROM base"),
        "reputable_hosts": f"SELECT page_id, ({reputable}) AS reputable FROM pages",
        "extract_ids": sql(f"SELECT {ids} FROM raw_v"),
        "refs_block": sql(f"SELECT p.doc_id, {_BLOCK} AS block, {_BODY} AS body FROM paper_v p LEFT JOIN heads h USING (doc_id) LEFT JOIN ends e USING (doc_id)", _LINES),
        "surname_overlap": sql(f"SELECT r.doc_id, r.ref_idx, w.source, round({overlap('r.authors', 'w.authors')}, 6) AS overlap FROM refs_v r JOIN works_v w ON r.doi <> '' AND r.doi = w.doi"),
        "title_ratio": sql("SELECT doc_id, ref_idx, source, title_score FROM rated", SCORED),
        "id_candidates": sql("SELECT doc_id, ref_idx, source, source_id FROM found", FOUND),
        "title_search_all_terms": sql("SELECT * FROM top5", _TERMS),
        "record_scores": sql("SELECT doc_id, ref_idx, source, source_id, score, CAST(place AS INT) AS place FROM ranked", SCORED),
        "best_record": sql("SELECT doc_id, ref_idx, source, source_id, score FROM ranked WHERE place = 1", SCORED),
        "corroborators": sql("SELECT doc_id, ref_idx, source, source_id FROM corr WHERE corroborates", CORROBORATED),
        "merged_metadata": sql(f"SELECT doc_id, ref_idx, source, source_id, CAST(sources_agreeing AS INT) AS sources_agreeing, year, {', '.join(f'{_E(c)} AS {c}' for c in FIELDS if c not in ('year', 'authors'))}, {_COUNT('authors')} AS n_authors FROM merged", MERGED).replace(" AS n_authors FROM", "::INT AS n_authors FROM"),
        "discrepancies": sql("SELECT doc_id, ref_idx, d.field AS field, d.parsed AS parsed_value, d.canonical AS canonical_value, d.severity AS severity FROM (SELECT doc_id, ref_idx, unnest(diffs) AS d FROM differed)", DIFFERED),
        "style_edits": sql("SELECT doc_id, ref_idx, field, original, corrected FROM kept", EDITED),
        "audit_results": sql("SELECT doc_id, ref_idx, confidence, score, CAST(sources_agreeing AS INT) AS sources_agreeing FROM results", results("default")),
        "audit_again": sql("SELECT doc_id, ref_idx, confidence, score, CAST(sources_agreeing AS INT) AS sources_agreeing FROM results", results("default")),
        "xcheck_keys": sql("SELECT doc_id, ref_idx, year, name, inst AS institutional FROM named", _KEYS),
        "claims": sql(f"SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS pos, trim(unnest(c)) AS claim FROM (SELECT doc_id, regexp_extract_all(body, {lit(intext.CLAIM)}, 1) AS c FROM body_v)"),
        "cache_keys": "SELECT page_id, left(sha256(url), 32) AS cache_key FROM pages",
        "api_breaker": "WITH calls AS (SELECT event_id, event_type AS api, value < 20 AS failed FROM events) SELECT event_id, api, failed, coalesce(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY api ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 4 AS open FROM calls",
        "duplicates": sql(f"""SELECT doc_id, idx1, idx2, arg_min(reason, rank) AS reason FROM (
            SELECT a.doc_id, a.ref_idx AS idx1, b.ref_idx AS idx2, 1 AS rank, 'shared DOI: ' || a.doi AS reason FROM merged a JOIN merged b ON a.doc_id = b.doc_id AND a.ref_idx < b.ref_idx AND a.doi <> '' AND lower(a.doi) = lower(b.doi)
            UNION ALL SELECT a.doc_id, a.ref_idx, b.ref_idx, 2, 'shared ' || a.source || ' ID: ' || a.source_id FROM merged a JOIN merged b ON a.doc_id = b.doc_id AND a.ref_idx < b.ref_idx AND a.source = b.source AND a.source_id = b.source_id
            UNION ALL SELECT doc_id, idx1, idx2, 3, 'identical canonical record' FROM same3 WHERE ratio3 >= 95
            UNION ALL SELECT doc_id, idx1, idx2, 4, 'duplicate parsed title and year' FROM same4 WHERE ratio4 >= 95) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY doc_id, idx1, idx2"),
            f"""{MERGED},
            t3 AS (SELECT a.doc_id, a.ref_idx AS idx1, b.ref_idx AS idx2, {title('a.title')} AS x, {title('b.title')} AS y FROM merged a JOIN merged b ON a.doc_id = b.doc_id AND a.ref_idx < b.ref_idx AND a.year IS NOT DISTINCT FROM b.year AND a.title <> '' AND b.title <> '' AND {overlap(_E('a.authors'), _E('b.authors'))} >= 0.5),
            {ratio('t3', 'x', 'y', 'same3', 'ratio3')},
            t4 AS (SELECT a.doc_id, a.ref_idx AS idx1, b.ref_idx AS idx2, {title('a.title')} AS x, {title('b.title')} AS y FROM refs_v a JOIN refs_v b ON a.doc_id = b.doc_id AND a.ref_idx < b.ref_idx AND a.year IS NOT DISTINCT FROM b.year AND a.title <> '' AND b.title <> ''
              LEFT JOIN merged m ON m.doc_id = a.doc_id AND m.ref_idx = a.ref_idx LEFT JOIN merged n ON n.doc_id = b.doc_id AND n.ref_idx = b.ref_idx WHERE m.doc_id IS NULL OR n.doc_id IS NULL),
            {ratio('t4', 'x', 'y', 'same4', 'ratio4')}"""),
    }
    out |= oracle_entries.oracle_sql(f"SELECT raw, {ids} FROM raw_v")
    for strictness in ("default", "strict", "relaxed"):
        name = "audit_tier_counts" if strictness == "default" else f"audit_{strictness}"
        out[name] = sql(f"SELECT confidence, count(r.doc_id) AS n FROM {tiers} LEFT JOIN results r USING (confidence) GROUP BY confidence", results(strictness))
    audited = {k: v for k, v in out.items() if FOUND in v and k != "id_candidates"}
    return out | {k: v.replace(FOUND, SEARCHED) for k, v in audited.items()} | {f"{k}_by_id": v for k, v in audited.items()}
