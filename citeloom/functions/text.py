"""Normalisation, extraction and predicates of bibliographic text, as Column functions.

All of them are total: null or malformed input gives an empty string, null or false, never an
error, also under ANSI mode. Missing values are null or '' alike; results use ''.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists and maps that results depend on
STOP_WORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]
JOURNAL_WORDS = {
    "am.": "american", "amer.": "american", "conf": "conference", "conf.": "conference", "int": "international", "int.": "international",
    "j": "journal", "j.": "journal", "natl.": "national", "proc": "proceedings", "proc.": "proceedings", "rev.": "review",
}
INSTITUTION_WORDS = [
    "academy", "administration", "agency", "alliance", "association", "authority", "board", "bureau", "center", "centers", "centre",
    "college", "commission", "committee", "company", "consortium", "corporation", "council", "court", "department", "federation", "force",
    "foundation", "government", "group", "hospital", "initiative", "institute", "kingdom", "league", "ministry", "nations", "network",
    "office", "organisation", "organization", "panel", "project", "register", "registry", "republic", "school", "service", "society",
    "states", "task", "trust", "union", "university",
]
CONNECTIVES = ["&", "and", "for", "in", "of", "on", "the", "to"]
JOURNAL_CONNECTIVES = ["a", "an", "and", "for", "in", "of", "on", "the"]
NOT_SURNAMES = ["al", "and", "cf", "et", "in", "see", "the"]
REPUTABLE_HOSTS = [
    ".edu", ".gov", ".mil", "aha.org", "ama-assn.org", "americanheart.org", "bjs.ojp.gov", "bls.gov", "brookings.edu", "cdc.gov", "census.gov",
    "europa.eu", "fda.gov", "kff.org", "lancet.com", "ncbi.nlm.nih.gov", "nejm.org", "nih.gov", "nlm.nih.gov", "ojp.gov", "pewresearch.org",
    "prisonpolicy.org", "rand.org", "sentencingproject.org", "un.org", "who.int",
]
SANDBOX_PREFIXES = ["10.65215/"]
LOWER_IN_TITLES = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "is", "nor", "of", "on", "or", "the", "to", "vs", "with"]
# ---- end of fixed values


def words_in(column: Column, words: list[str]) -> Column:
    return column.isin(words)


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def missing(column: Column) -> Column:
    return text(column) == ""


def first_match(column: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, '' without one."""
    return F.regexp_extract(text(column), pattern, group)


def nullif(column: Column) -> Column:
    return F.when(column != "", column)


def strip_chars(column: Column, chars: str) -> Column:
    return F.rtrim(column, F.lit(chars))


#: Letters of the Latin script end here; a class asks first whether a character lies above.
LATIN = 0x24F


def _class(codes: list[int]) -> str:
    """Sorted code points as a pattern's character class, without its outer brackets. Characters up to ``LATIN`` are told
    by one comparison from the many ranges above."""

    def ranges(some: list[int]) -> str:
        out: list[list[int]] = []
        for code in some:
            if out and code == out[-1][1] + 1:
                out[-1][1] = code
            else:
                out.append([code, code])
        return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)

    return ranges([c for c in codes if c <= LATIN]) + rf"[\x{{{LATIN + 1:X}}}-\x{{10FFFF}}&&[{ranges([c for c in codes if c > LATIN])}]]"


@cache
def _marks() -> tuple[str, str, str, str, str]:
    """Characters that decompose to one other and marks, and what to; classes of those that become several characters, letters
    or digits among them (what else they become is dropped like themselves), and of combining marks; the several, as a map's text.
    Decomposed syllables of Hangul hold no character that any normal form here keeps, so they stay whole."""
    one, base, several, marks = [], [], [], []
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            marks.append(code)
        elif plain != c and len(plain) == 1:
            one.append(c)
            base.append(plain)
        elif plain != c and any(x.isascii() and (x.isalnum() or x in " <>") for x in plain):
            several.append((code, plain))
    told = "\x01".join(f"{chr(code)}\x02{plain}" for code, plain in several)
    return "".join(one), "".join(base), _class([code for code, _ in several]), _class(marks), told


def strip_accents(column: Column) -> Column:
    """Compatibility decomposition without combining marks, over all planes. Built-in functions only; the character by
    character way is taken by texts that hold a character which becomes several."""
    one, base, several, marks, told = _marks()
    out = F.translate(text(column), one, base)
    pieces = F.regexp_extract_all(out, F.lit(f"([{several}]|(?:(?![{several}])(?s:.))+)"), F.lit(1))
    mapped = F.str_to_map(F.lit(told), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(mapped, p), p)), "")
    out = F.when(out.rlike(f"[{several}]"), spelled).otherwise(out)
    return F.regexp_replace(out, f"[{marks}]+", "")


def _folded(column: Column) -> Column:
    return F.lower(strip_accents(column))


def _tokens(column: Column, drop: list[str]) -> Column:
    return F.filter(F.split(F.trim(column), r"\s+"), lambda t: (t != "") & ~t.isin(drop))


def title_tokens(column: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(_folded(column), r"<[^>]+>", " "), r"[^a-z0-9 ]+", " ")
    return _tokens(plain, STOP_WORDS)


def normalize_title(column: Column) -> Column:
    return F.array_join(title_tokens(column), " ")


def normalize_surname(column: Column) -> Column:
    return F.regexp_replace(_folded(column), "[^a-z]+", "")


def journal_words(column: Column) -> Column:
    words = F.create_map(*(F.lit(x) for kv in JOURNAL_WORDS.items() for x in kv))
    found = F.regexp_extract_all(_folded(column), F.lit(r"([a-z]+\.?|[0-9]+)"), F.lit(1))
    spelled = F.transform(found, lambda t: F.coalesce(F.try_element_at(words, t), F.rtrim(t, F.lit("."))))
    return F.filter(spelled, lambda t: (t != "") & ~t.isin(STOP_WORDS))


def normalize_journal(column: Column) -> Column:
    return F.array_join(journal_words(column), " ")


def journal_tokens(column: Column) -> Column:
    return F.filter(F.regexp_extract_all(_folded(column), F.lit("([a-z]+)"), F.lit(1)), lambda t: ~t.isin(JOURNAL_CONNECTIVES))


def institution_key(column: Column) -> Column:
    return F.array_join(_tokens(F.regexp_replace(_folded(column), r"[^a-z\s]+", ""), CONNECTIVES), "")


def initial_of(column: Column) -> Column:
    return F.upper(F.substring(F.trim(text(column)), 1, 1))


def normalize_pages(column: Column) -> Column:
    return F.regexp_replace(text(column), r"[\s\-–—]", "-")


def doi_of(column: Column) -> Column:
    return F.lower(strip_chars(first_match(column, r"\b(10\.\d{4,9}/[^\s\"'<>]+)"), ".,;:)"))


def arxiv_of(column: Column) -> Column:
    named = first_match(column, r"(?i)\barXiv:?\s*([a-z\-]+/\d{7}|\d{4}\.\d{4,5}(?:v\d+)?)\b")
    return F.when(named != "", F.lower(named)).otherwise(first_match(column, r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b"))


def pmid_of(column: Column) -> Column:
    return first_match(column, r"(?i)\bPMID:?\s*(\d{1,9})\b")


def year_of(column: Column) -> Column:
    """1600 to 2099: in brackets, else before a semicolon, else the first one."""
    ways = (r"\((1[6-9]\d{2}|20\d{2})\b", r"\b(1[6-9]\d{2}|20\d{2})\s*;", r"\b(1[6-9]\d{2}|20\d{2})\b")
    return F.coalesce(*(nullif(first_match(column, w)) for w in ways)).try_cast("int")


def url_of(column: Column) -> Column:
    return F.when(doi_of(column) == "", strip_chars(first_match(column, r"(https?://\S+)"), ".,);")).otherwise("")


def is_institution(column: Column) -> Column:
    s = F.rtrim(F.trim(text(column)), F.lit(".,;"))
    personal = s.rlike(r",\s*[A-Z]\.") | s.rlike(r",\s+[A-Z][a-z\-']+\s+[A-Z]{1,4}\b") | s.rlike(r"^[A-Z][a-z\-']+\s+[A-Z]{1,4}$")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    marked = F.exists(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;"))).isin(INSTITUTION_WORDS))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    linking = F.size(F.filter(words, lambda w: F.lower(w).isin(CONNECTIVES)))
    shaped = (F.size(words) >= 3) & (capital >= 3) & (capital + linking >= F.size(words) - 1)
    return (s != "") & ~personal & (marked | shaped)


def _prefixes_in_order(short: Column, long: Column) -> Column:
    """Each token of ``short`` begins, or is begun by, a token of ``long``, in order."""

    def step(at: Column, token: Column) -> Column:
        rest = F.slice(long, at + 1, F.greatest(F.size(long) - at, F.lit(0)))
        hit = F.array_position(F.transform(rest, lambda t: t.startswith(token) | token.startswith(t)), True).cast("int")
        return F.when((at < 0) | (hit == 0), F.lit(-1)).otherwise(at + hit)

    return F.aggregate(short, F.lit(0), step) >= 0


def abbreviates(cited: Column, full: Column) -> Column:
    a, b = journal_tokens(cited), journal_tokens(full)
    return (F.size(a) > 0) & (F.size(b) > 0) & (_prefixes_in_order(a, b) | _prefixes_in_order(b, a))


def real_doi(column: Column) -> Column:
    sandbox = F.lit(False)
    for prefix in SANDBOX_PREFIXES:
        sandbox = sandbox | F.lower(text(column)).startswith(prefix)
    return ~missing(column) & ~sandbox


def reputable(url: Column) -> Column:
    host = F.lower(text(F.try_parse_url(url, F.lit("HOST"))))
    hit = F.lit(False)
    for name in REPUTABLE_HOSTS:
        hit = hit | host.endswith(name) | (host == name.lstrip("."))
    return hit


def same_number(a: Column, b: Column) -> Column:
    a, b = F.trim(text(a)), F.trim(text(b))
    numbers = a.rlike(r"^\d+$") & b.rlike(r"^\d+$")
    plain = lambda c: F.regexp_replace(c, r"^0+(?=\d)", "")
    return (a == b) | (numbers & (plain(a) == plain(b)))


def uses_et_al(column: Column) -> Column:
    return text(column).rlike(r"(?i)\bet\s+al\.?")


# ---- names
AUTHOR = "struct<family:string,given:string,orcid:string>"


def author(family: Column, given: Column) -> Column:
    return F.struct(family.alias("family"), given.alias("given"), F.lit(None).cast("string").alias("orcid"))


def author_of(column: Column) -> Column:
    """One name: 'Family, Given'; one word; 'Family JA' (capitals at the end are initials); 'Given Family'."""
    s = F.trim(text(column))
    comma = F.instr(s, ",")
    words = F.split(s, r"\s+")
    last, n = F.try_element_at(words, F.lit(-1)), F.size(words)
    front = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ")
    bare = F.replace(last, F.lit("."), F.lit(""))
    return (
        F.when(comma > 0, author(F.trim(F.substr(s, F.lit(1), comma - 1)), F.trim(F.substr(s, comma + 1))))
        .when(n < 2, author(s, F.lit("")))
        .when(bare.rlike(r"^[A-Z]{1,4}$"), author(front, last))
        .otherwise(author(last, front))
    )


def full_name(a: Column) -> Column:
    return F.trim(F.concat_ws(" ", text(a["given"]), text(a["family"])))


def surnames(authors: Column) -> Column:
    """Distinct normalised surnames, none empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(authors, F.array().cast(f"array<{AUTHOR}>")), lambda a: normalize_surname(a["family"])), lambda s: s != ""))


def initials(given: Column, joint: str = " ") -> Column:
    """'Jane Mary' to 'J. M.', 'Jean-Paul' to 'J.-P.'."""
    parts = F.filter(F.split(F.trim(text(given)), r"[\s.]+"), lambda p: p != "")
    one = lambda p: F.array_join(F.transform(F.filter(F.split(p, "-"), lambda b: b != ""), lambda b: F.concat(F.upper(F.substring(b, 1, 1)), F.lit("."))), "-")
    return F.array_join(F.transform(parts, one), joint)


def compact_initials(given: Column) -> Column:
    parts = F.filter(F.split(F.trim(text(given)), r"[\s.\-]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), "")


# ---- casing
def title_case(column: Column) -> Column:
    words = F.filter(F.split(F.trim(text(column)), r"\s+"), lambda w: w != "")
    raise_ = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))

    def one(w: Column, i: Column) -> Column:
        minor = F.lower(F.regexp_replace(w, "[^A-Za-z]", "")).isin(LOWER_IN_TITLES)
        return F.when((i > 0) & (i < F.size(words) - 1) & minor, F.lower(w)).otherwise(raise_(w))

    return F.array_join(F.transform(words, one), " ")


def sentence_case(column: Column) -> Column:
    """Lower case but for the first segment and for acronyms, segment by segment of compounds."""
    words = F.filter(F.split(F.trim(text(column)), r"\s+"), lambda w: w != "")
    pieces = lambda w: F.regexp_extract_all(w, F.lit(r"([\-–—/]|[^\-–—/]+)"), F.lit(1))

    def segment(p: Column, first: Column) -> Column:
        letters = F.regexp_replace(p, "[^A-Za-z]", "")
        acronym = (F.length(letters) >= 2) & (letters == F.upper(letters))
        return F.when(acronym, p).when(first, F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))).otherwise(F.lower(p))

    word = lambda w, i: F.array_join(F.transform(pieces(w), lambda p, k: segment(p, (i == 0) & (k == 0))), "")
    return F.array_join(F.transform(words, word), " ")


def en_dash(pages: Column) -> Column:
    return F.replace(text(pages), F.lit("-"), F.lit("–"))


def tidy(column: Column) -> Column:
    """Separators left behind by empty fields go."""
    for pattern, with_ in ((r"\s+", " "), (r",\s*\.", "."), (r",\s*,", ","), (r":\s*\.", "."), (r";\s*\.", "."), (r"\s+([,.;:])", "$1"), (r"\.\.+", "."), (r"\(\s*\)", "")):
        column = F.regexp_replace(column, pattern, with_)
    return F.trim(column)


def html_escape(column: Column) -> Column:
    out = text(column)
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(entity))
    return out
