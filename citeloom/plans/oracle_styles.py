"""Oracle SQL of the citation styles and of in-text citations, over the string form of authors."""

from __future__ import annotations

from ..functions import styles
from ..functions import text as words
from ..operators import intext
from .oracle import institution, institution_key, lit, q, sql, surname

NAMES = "list_filter(string_split({0}, ';'), lambda a: a <> '')"
FAMILY, GIVEN = "split_part(a, '|', 1)", "split_part(a, '|', 2)"
INITIALS = "array_to_string(list_transform(list_filter(string_split_regex(trim({0}), '[\\s.]+'), lambda p: p <> ''), lambda p: array_to_string(list_transform(list_filter(string_split(p, '-'), lambda b: b <> ''), lambda b: upper(b[1]) || '.'), '-')), ' ')"
COMPACT = "array_to_string(list_transform(list_filter(string_split_regex(trim({0}), '[\\s.\\-]+'), lambda p: p <> ''), lambda p: upper(p[1])), '')"


def comma(a: str, b: str) -> str:
    return f"rtrim(trim({a} || ', ' || {b}), ',')"


def each(expr: str, names: str = NAMES.format("authors")) -> str:
    return f"list_transform({names}, lambda a: {expr})"


def listed(n: str, last: str) -> str:
    return f"(CASE WHEN len({n}) = 0 THEN '' WHEN len({n}) = 1 THEN {n}[1] ELSE array_to_string({n}[1:-2], ', ') || {last} || {n}[-1] END)"


def title_case(x: str) -> str:
    w = f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({w}, lambda w, i: CASE WHEN i > 1 AND i < len({w}) AND list_contains({q(words.LOWER_IN_TITLES)}, lower(regexp_replace(w, '[^A-Za-z]', '', 'g'))) THEN lower(w) ELSE upper(w[1]) || w[2:] END), ' ')"


def sentence_case(x: str) -> str:
    w = f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"
    letters = "regexp_replace(p, '[^A-Za-z]', '', 'g')"
    segment = f"CASE WHEN length({letters}) >= 2 AND {letters} = upper({letters}) THEN p WHEN i = 1 AND k = 1 THEN upper(p[1]) || lower(p[2:]) ELSE lower(p) END"
    return f"array_to_string(list_transform({w}, lambda w, i: array_to_string(list_transform(regexp_extract_all(w, '[\\-–—/]|[^\\-–—/]+'), lambda p, k: {segment}), '')), ' ')"


def tidy(x: str) -> str:
    for pattern, with_ in ((r"\s+", " "), (r",\s*\.", "."), (r",\s*,", ","), (r":\s*\.", "."), (r";\s*\.", "."), (r"\s+([,.;:])", r"\1"), (r"\.\.+", "."), (r"\(\s*\)", "")):
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(with_)}, 'g')"
    return f"trim({x})"


def when(value: str, expr: str) -> str:
    return f"(CASE WHEN {value} <> '' THEN {expr} ELSE '' END)"


def joined(sep: str, *parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), '{sep}')"


FULL = each("trim(" + GIVEN + " || ' ' || " + FAMILY + ")")
WITH_INITIALS = each(comma(FAMILY, INITIALS.format(GIVEN)))
AMA = each("trim(" + FAMILY + " || ' ' || " + COMPACT.format(GIVEN) + ")")
IEEE = each("trim(" + INITIALS.format(GIVEN) + " || ' ' || " + FAMILY + ")")
FIRST = comma("split_part(split_part(authors, ';', 1), '|', 1)", "split_part(split_part(authors, ';', 1), '|', 2)")
WHO = {
    "apa": listed(WITH_INITIALS, "', & '"),
    "mla": f"(CASE WHEN authors = '' THEN '' WHEN len({FULL}) = 1 THEN {FIRST} WHEN len({FULL}) = 2 THEN trim({FIRST} || ', and ' || {FULL}[2]) ELSE {FIRST} || ', et al.' END)",
    "ama": f"array_to_string({AMA}, ', ')",
    "chicago": f"(CASE WHEN authors = '' THEN '' ELSE {listed(f'list_concat([{FIRST}], {FULL}[2:])', chr(39) + ', and ' + chr(39))} END)",
    "ieee": f"(CASE WHEN len({IEEE}) = 2 THEN {IEEE}[1] || ' and ' || {IEEE}[2] ELSE {listed(IEEE, chr(39) + ', and ' + chr(39))} END)",
    "harvard": f"(CASE WHEN len({WITH_INITIALS}) > 3 THEN {WITH_INITIALS}[1] || ' et al.' ELSE {listed(WITH_INITIALS, chr(39) + ' and ' + chr(39))} END)",
}
WHO["vancouver"] = WHO["ama"]
# the pieces of a record, then the styles over them; the views have no record with over six authors
PIECES = f""",
w AS (SELECT *, CASE WHEN type <> 'unknown' THEN type WHEN container_title <> '' AND (volume <> '' OR pages <> '' OR doi <> '' OR issue <> '') THEN 'journal-article' WHEN arxiv_id <> '' THEN 'posted-content' WHEN publisher <> '' AND container_title = '' THEN 'book' ELSE 'unknown' END AS kind,
  coalesce(CAST(year AS VARCHAR), '') AS y, replace(pages, '-', '–') AS pg, CASE WHEN container_title <> '' THEN container_title ELSE publisher END AS place, volume || {when('issue', "'(' || issue || ')'")} AS vi,
  {title_case('title')} AS tc, {sentence_case('title')} AS sc, {title_case('container_title')} AS vc FROM works_v),
p AS (SELECT *, {when('title', "rtrim(sc, '.') || '.'")} AS sentence, {when('title', "'" + chr(34) + "' || tc || '." + chr(34) + "'")} AS headline, {when('container_title', "'*' || container_title || '*'")} AS venue, {when('container_title', "'*' || vc || '*'")} AS headvenue,
  CASE WHEN y <> '' AND vi <> '' AND pg <> '' THEN y || ';' || vi || ':' || pg || '.' WHEN y <> '' AND vi <> '' THEN y || ';' || vi || '.' WHEN y <> '' THEN y || '.' ELSE '' END AS dated FROM w)"""


def expressions() -> dict[str, tuple[str, str]]:
    """For each style the formatted reference and the citation in the text, over the rows of p."""
    article = "kind IN ('journal-article', 'posted-content')"
    ay, cy, hy = "(CASE WHEN y <> '' THEN '(' || y || ').' ELSE '(n.d.).' END)", "(CASE WHEN y <> '' THEN y ELSE 'n.d.' END)", "(CASE WHEN y <> '' THEN '(' || y || ')' ELSE '(no date)' END)"
    rest = joined(", ", when("volume", "'vol. ' || volume"), when("issue", "'no. ' || issue"), "y", when("pg", "'pp. ' || pg"))
    tail = joined(", ", when("volume", "'vol. ' || volume"), when("issue", "'no. ' || issue"), when("pg", "'pp. ' || pg"), "y")
    biblio = "trim(volume || " + when("issue", "', no. ' || issue") + " || " + when("pg", "': ' || pg") + ")"
    where = "trim(vi || " + when("pg", "', pp. ' || pg") + ", ', ')"
    plain = when("title", "rtrim(title, '.') || '.'")
    quoted, single = when("title", "'\"' || sc || ',\"'"), when("title", "chr(39) || rtrim(sc, '.') || chr(39) || ','")
    who = {s: f"({x})" for s, x in WHO.items()}
    bodies = {
        "apa": (f"{who['apa']} || ' ' || {ay} || ' ' || sentence || ' ' || {joined(', ', 'venue', 'vi', 'pg')} || '.' || (CASE WHEN doi <> '' THEN ' https://doi.org/' || doi WHEN source = 'openalex' THEN ' ' || source_url ELSE '' END)",
                f"{who['apa']} || ' ' || {ay} || ' ' || sentence || ' ' || publisher || '.'",
                f"CASE WHEN kind = 'proceedings-article' THEN {who['apa']} || ' ' || {ay} || ' ' || sentence || ' ' || venue || '.' ELSE {who['apa']} || ' ' || {ay} || ' ' || sentence || ' ' || place END"),
        "mla": (joined(" ", f"(CASE WHEN {who['mla']} <> '' THEN {who['mla']} || '.' ELSE '' END)", "headline", "headvenue", f"(CASE WHEN {rest} <> '' THEN {rest} || '.' ELSE '' END)") + " || " + when("doi", "' doi:' || doi || '.'"),
                f"{who['mla']} || '. ' || tc || '. ' || publisher || ', ' || y || '.'", f"{who['mla']} || '. ' || headline || ' ' || place || ' ' || y || '.'"),
        "ama": (joined(" ", f"{who['ama']} || '.'", "sentence", when("venue", "venue || '.'"), "dated") + " || " + when("doi", "' doi:' || doi"),
                f"{who['ama']} || '. *' || sentence || '* ' || publisher || '; ' || y || '.'", f"{who['ama']} || '. ' || sentence || ' ' || place || '. ' || y || '.'"),
        "chicago": (f"rtrim({joined(' ', who['chicago'] + chr(32) + '|| ' + chr(39) + '.' + chr(39), cy + ' || ' + chr(39) + '.' + chr(39), 'headline', 'headvenue', biblio)}, ',') || '.' || " + when("doi", "' https://doi.org/' || doi || '.'"),
                    f"{who['chicago']} || '. ' || {cy} || '. *' || tc || '*. ' || publisher || '.'", f"{who['chicago']} || '. ' || {cy} || '. ' || headline || ' ' || place || '.'"),
        "vancouver": (joined(" ", f"{who['ama']} || '.'", plain, when("container_title", "container_title || '.'"), "dated") + " || " + when("doi", "' doi:' || doi"),
                      f"{who['ama']} || '. ' || {plain} || ' ' || publisher || '; ' || y || '.'", f"{who['ama']} || '. ' || {plain} || ' ' || place || '. ' || y || '.'"),
        "ieee": (f"rtrim({joined(' ', who['ieee'] + ' || ' + chr(39) + ',' + chr(39), quoted, f'(CASE WHEN headvenue <> {lit(chr(32).strip())} THEN headvenue || (CASE WHEN {tail} <> {lit(chr(32).strip())} THEN {lit(chr(44))} ELSE {lit(chr(32).strip())} END) ELSE {lit(chr(32).strip())} END)', tail)}, ',') || '.' || " + when("doi", "' doi: ' || doi || '.'"),
                 f"{who['ieee']} || ', *' || tc || '*. ' || publisher || ', ' || y || '.'", f"{who['ieee']} || ', ' || {quoted} || ' ' || place || ', ' || y || '.'"),
        "harvard": (f"rtrim({joined(' ', who['harvard'], hy, single, f'(CASE WHEN headvenue <> {lit(chr(32).strip())} THEN headvenue || (CASE WHEN {where} <> {lit(chr(32).strip())} THEN {lit(chr(44))} ELSE {lit(chr(32).strip())} END) ELSE {lit(chr(32).strip())} END)', where)}, ',') || '.' || " + when("doi", "' doi: ' || doi || '.'"),
                    f"{who['harvard']} || ' ' || {hy} || ' *' || tc || '*. ' || publisher || '.'", f"{who['harvard']} || ' ' || {hy} || ' ' || {single} || ' ' || place || '.'"),
    }
    fams = each(FAMILY)
    shown = lambda mid, end, alone: f"(CASE WHEN len({fams}) = 0 THEN {alone} WHEN len({fams}) = 1 THEN '(' || {fams}[1] || {end} || ')' WHEN len({fams}) = 2 THEN '(' || {fams}[1] || {mid} || {fams}[2] || {end} || ')' ELSE '(' || {fams}[1] || ' et al.' || {end} || ')' END)"
    dated = shown("' & '", "', ' || (CASE WHEN y <> '' THEN y ELSE 'n.d.' END)", when("y", "'(' || y || ')'"))
    cited = {"mla": shown("' and '", "''", "''")} | dict.fromkeys(("apa", "chicago", "harvard"), dated) | dict.fromkeys(("ama", "vancouver", "ieee"), "'[7]'")
    book = lit("book")
    return {s: (tidy(f"CASE WHEN {article} THEN {a} WHEN kind = {book} THEN {b} ELSE {o} END"), cited[s]) for s, (a, b, o) in bodies.items()}


def style_sql() -> dict[str, str]:
    made = expressions()
    return {f"format_{s}": sql(f"SELECT source, source_id, {made[s][0]} AS formatted, {made[s][1]} AS cited FROM p", PIECES.lstrip(",\n")) for s in styles.SUPPORTED_STYLES}


_ENTRY = "(regexp_matches({0}, '^[A-Z0-9(\\[]') AND regexp_matches({0}, '\\(\\d{{4}}[a-z]?\\)|\\b(19|20)\\d{{2}}\\b') AND length({0}) > 30)"
# the papers of the view have no entry that only a name tells apart, which needs a look behind
ENTRIES = """
blocks AS (SELECT p.doc_id, {block} AS block FROM paper_v p LEFT JOIN heads h USING (doc_id) LEFT JOIN ends e USING (doc_id)),
rows_ AS (SELECT doc_id, trim(line) AS line, pos FROM (SELECT doc_id, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS pos FROM blocks) WHERE trim(line) <> ''),
likely AS (SELECT *, {entry} AS is_ref, count(*) OVER (PARTITION BY doc_id) AS n, sum(CASE WHEN {entry} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS r FROM rows_),
by_line AS (SELECT doc_id, string_agg(line, ' ' ORDER BY pos) AS raw, min(pos) AS pos FROM (SELECT *, greatest(sum(CASE WHEN is_ref THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS island FROM likely WHERE n >= 2 AND r >= greatest(2, floor(n * 6 / 10))) GROUP BY doc_id, island),
by_gap AS (SELECT doc_id, unnest(string_split_regex(block, '\\n\\s*\\n')) AS raw, generate_subscripts(string_split_regex(block, '\\n\\s*\\n'), 1) AS pos FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM by_line)),
found_ AS (SELECT doc_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS raw_text, pos FROM (SELECT * FROM by_line UNION ALL SELECT doc_id, raw, pos FROM by_gap))"""


def intext_sql() -> dict[str, str]:
    from .oracle import _BLOCK, _KEYS, _LINES

    patterns = ", ".join(f"regexp_extract_all(rest, {lit(p)}, 1)" for p in intext.PATTERNS)
    numbers = f"regexp_extract(raw, {lit(intext.NUMBERS)}, 1)"
    chunks = f"string_split_regex({numbers}, '\\s*,\\s*')"
    ends = "string_split_regex(c, '\\s*[-–]\\s*')"
    indices = f"flatten(list_transform({chunks}, lambda c: CASE WHEN len({ends}) = 2 THEN range(CAST({ends}[1] AS INT), CAST({ends}[2] AS INT) + 1) ELSE [CAST({ends}[1] AS BIGINT)] END))"
    ctes = f"""
brackets AS (SELECT doc_id, body, list_filter(list_transform(regexp_extract_all(body, {lit(intext.BRACKETS)}, 1), lambda x: x[2:-2]), lambda x: contains(x, ';') AND len(list_filter(string_split(x, ';'), lambda s: regexp_matches(s, '\\b(?:19|20)\\d{{2}}\\b'))) >= 2) AS several FROM body_v),
blanked AS (SELECT *, flatten(list_transform(several, lambda x: list_transform(list_filter(string_split(x, ';'), lambda s: trim(s) <> ''), lambda s: '(' || trim(s) || ')'))) AS parts,
  CASE WHEN len(several) = 0 THEN body ELSE list_reduce(several, lambda s, x: replace(s, '(' || x || ')', '(;)'), body) END AS rest FROM brackets),
gathered AS (SELECT doc_id, list_concat(parts, list_transform(flatten([{patterns}]), lambda x: trim(x))) AS every FROM blanked),
unique_ AS (SELECT doc_id, raw, min(i) AS i FROM (SELECT doc_id, unnest(every) AS raw, generate_subscripts(every, 1) AS i FROM gathered) GROUP BY ALL),
placed AS (SELECT doc_id, raw, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos FROM unique_),
parted AS (SELECT *, {numbers} AS numbers, CASE WHEN {numbers} = '' THEN regexp_extract(raw, '\\b(\\d{{4}})[a-z]?\\b', 1) ELSE '' END AS y, trim(trim(regexp_extract(raw, '^(.*?)\\b\\d{{4}}[a-z]?\\b', 1)), ' (,') AS before FROM placed),
told AS (SELECT *, y <> '' AND {institution('before')} AS inst FROM parted),
cited AS (SELECT doc_id, pos, raw, CASE WHEN numbers <> '' THEN {indices} ELSE [] END AS indices, CASE WHEN inst THEN {institution_key('before')} ELSE '' END AS institutional,
  CASE WHEN y <> '' AND NOT inst THEN list_transform(list_filter(regexp_extract_all(before, '\\b([A-Z][A-Za-z\\-''À-ÖØ-öø-ÿ]{{1,40}})', 1), lambda x: NOT list_contains({q(words.NOT_SURNAMES)}, lower(x))), lambda x: {surname('x')}) ELSE [] END AS surnames, y, inst FROM told),
citations AS (SELECT doc_id, pos, raw, indices, institutional, surnames, CASE WHEN inst OR len(surnames) > 0 THEN TRY_CAST(y AS INT) END AS year FROM cited WHERE len(indices) > 0 OR inst OR len(surnames) > 0),{_KEYS},
numbered AS (SELECT c.doc_id, c.raw, r.ref_idx FROM (SELECT doc_id, raw, unnest(indices) AS ref_idx FROM citations) c JOIN refs_v r ON r.doc_id = c.doc_id AND r.ref_idx = c.ref_idx),
persons AS (SELECT c.doc_id, c.raw, k.ref_idx FROM (SELECT doc_id, raw, year, unnest(surnames) AS name FROM citations) c JOIN named k ON NOT k.inst AND k.doc_id = c.doc_id AND k.year = c.year AND k.name = c.name),
bodies AS (SELECT c.doc_id, c.raw, k.ref_idx, k.name, CASE WHEN c.institutional = k.name THEN 0 ELSE 1 END AS rank, min(k.ref_idx) OVER (PARTITION BY c.doc_id, c.raw, k.name) AS first FROM citations c JOIN named k ON k.inst AND c.institutional <> '' AND k.doc_id = c.doc_id AND k.year = c.year
  AND (c.institutional = k.name OR contains(k.name, c.institutional) OR contains(c.institutional, k.name))),
bests AS (SELECT doc_id, raw, ref_idx FROM bodies QUALIFY rank * 100000 + first = min(rank * 100000 + first) OVER (PARTITION BY doc_id, raw)),
hits AS (SELECT DISTINCT * FROM numbered UNION SELECT * FROM persons UNION SELECT * FROM bests)"""
    split = f"{_LINES.rstrip()},{ENTRIES.format(block=_BLOCK, entry=_ENTRY.format('line'))}"
    return {
        "intext_citations": sql("SELECT doc_id, pos, raw, array_to_string(surnames, ',') AS surnames, year, array_to_string(indices, ',') AS indices, institutional FROM citations", ctes),
        "xcheck_matched": sql("SELECT doc_id, raw, array_to_string(list_sort(list(ref_idx)), ',') AS ref_idxs FROM hits GROUP BY doc_id, raw", ctes),
        "xcheck_orphans": sql("SELECT doc_id, pos, raw FROM citations c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = c.doc_id AND h.raw = c.raw)", ctes),
        "xcheck_unused": sql("SELECT doc_id, ref_idx FROM refs_v r WHERE doc_id IN (SELECT doc_id FROM citations) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = r.doc_id AND h.ref_idx = r.ref_idx)", ctes),
        "xcheck_counts": sql(
            f"""SELECT b.doc_id, coalesce(n_references, 0) AS n_references, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_unused, 0) AS n_unused FROM (SELECT doc_id FROM refs_v UNION SELECT doc_id FROM lost) b
            LEFT JOIN (SELECT doc_id, count(*) AS n_references FROM refs_v GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_orphans FROM lost GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_unused FROM idle GROUP BY doc_id) USING (doc_id)""",
            f"""{ctes},
            lost AS (SELECT doc_id, raw FROM citations c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = c.doc_id AND h.raw = c.raw)),
            idle AS (SELECT doc_id, ref_idx FROM refs_v r WHERE doc_id IN (SELECT doc_id FROM citations) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = r.doc_id AND h.ref_idx = r.ref_idx))""",
        ),
        "split_entries": sql("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS ref_idx, raw_text FROM found_ WHERE raw_text <> ''", split),
    }


