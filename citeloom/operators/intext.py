"""In-text citations: finding and parsing them, and the cross-check with the bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# ---- fixed patterns of the formats
LETTERS = r"A-Za-z\-'À-ÖØ-öø-ÿĀ-žŁł"
CAPITAL = r"[A-ZÀ-ÖØ-ÞĀĂ-ŻŁ]"
PERSON = rf"{CAPITAL}[{LETTERS}]{{1,40}}(?:\s+(?:and|&)\s+{CAPITAL}[{LETTERS}]{{1,40}})?(?:\s+et\s+al\.?)?"
NAME_WORD = rf"{CAPITAL}\.?[{LETTERS}.]{{0,40}}"
INSTITUTION = rf"{NAME_WORD}(?:\s+(?:(?:of|for|and|the|on|in|to|&)\s+)?{NAME_WORD}){{1,8}}"
NUMBERS = r"\[(\d{1,3}(?:\s*[,\-–]\s*\d{1,3})*)\]"
PATTERNS = [
    rf"(\({PERSON}(?:,\s*|\s+)\d{{4}}[a-z]?\))",
    rf"(\({INSTITUTION},\s*\d{{4}}[a-z]?\))",
    r"(\[\d{1,3}(?:\s*[,\-–]\s*\d{1,3})*\])",
    rf"(\b{PERSON}\s*\(\d{{4}}[a-z]?\))",
    rf"(\b{INSTITUTION}\s*\(\d{{4}}[a-z]?\))",
]
CLAIM = (
    r"(?i)([^.\n]*?(?:studies? show|research suggests?|evidence (?:indicates?|shows?|suggests?)"
    r"|it (?:has been|is) (?:shown|demonstrated|reported)|according to)[^.\n]{0,300}\.)"
)
BRACKETS = r"(\([^()]{1,500}?\))"
# ---- end of fixed patterns


def _is_multiple(inner: Column) -> Column:
    parts = F.filter(F.transform(F.split(inner, ";"), lambda s: F.trim(s)), lambda x: x != "")
    return inner.contains(";") & (F.size(parts) >= 2) & (F.size(F.filter(parts, lambda x: x.rlike(r"\b(?:19|20)\d{2}\b"))) >= 2)


def citations_in(body: Column) -> Column:
    """Distinct citations in order of finding: the parts of multiple ones, then each pattern's, outside those."""
    body = t.text(body)
    inner = F.transform(F.regexp_extract_all(body, F.lit(BRACKETS), F.lit(1)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    several = F.filter(inner, _is_multiple)
    parts = F.transform(F.filter(F.flatten(F.transform(several, lambda x: F.split(x, ";"))), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("("), F.trim(x), F.lit(")")))
    # a multiple citation is blanked, so that no pattern starts inside it
    rest = F.aggregate(several, body, lambda s, x: F.replace(s, F.concat(F.lit("("), x, F.lit(")")), F.lit("(;)")))
    found = F.flatten(F.array(*(F.regexp_extract_all(rest, F.lit(p), F.lit(1)) for p in PATTERNS)))
    return F.array_distinct(F.concat(parts, F.transform(found, lambda s: F.trim(s))))


def expand_numbers(inner: Column) -> Column:
    """'1, 3-5' to 1, 3, 4, 5; a range that runs down is empty."""

    def one(chunk: Column) -> Column:
        ends = F.split(chunk, r"\s*[-–]\s*")
        a, b = F.try_element_at(ends, F.lit(1)).try_cast("int"), F.try_element_at(ends, F.lit(2)).try_cast("int")
        none = F.array().cast("array<int>")
        return F.when(F.size(ends) > 2, none).when(b.isNotNull(), F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(none)).otherwise(F.when(a.isNull(), none).otherwise(F.array(a)))

    return F.flatten(F.transform(F.split(inner, r"\s*,\s*"), lambda c: one(F.trim(c))))


def parse_citation(raw: Column) -> dict[str, Column]:
    """surnames, year, indices, institutional; all empty where it is no citation."""
    raw = F.trim(t.text(raw))
    numbers = F.regexp_extract(raw, NUMBERS, 1)
    numeric = numbers != ""
    year = F.when(~numeric, F.regexp_extract(raw, r"\b(\d{4})[a-z]?\b", 1)).otherwise("")
    before = F.trim(F.regexp_extract(raw, r"^(.*?)\b\d{4}[a-z]?\b", 1))
    before = F.btrim(before, F.lit(" (,"))
    institution = (year != "") & t.is_institution(before)
    words = F.filter(F.regexp_extract_all(before, F.lit(r"\b([A-Z][A-Za-z\-'À-ÖØ-öø-ÿ]{1,40})\b"), F.lit(1)), lambda w: ~F.lower(w).isin(t.NOT_SURNAMES))
    none = F.array().cast("array<string>")
    names = F.when((year != "") & ~institution, F.transform(words, t.normalize_surname)).otherwise(none)
    return {
        "surnames": names, "year": F.when(institution | (F.size(names) > 0), year.try_cast("int")),
        "indices": F.when(numeric, expand_numbers(numbers)).otherwise(F.array().cast("array<int>")),
        "institutional": F.when(institution, t.institution_key(before)).otherwise(""),
    }


def intext(bodies: DataFrame, doc_id: str = "doc_id", body: str = "body") -> DataFrame:
    """doc_id, pos, raw and the parsed columns, one row for each distinct citation that parses."""
    rows = bodies.select(F.col(doc_id).alias("doc_id"), F.posexplode(citations_in(F.col(body))).alias("pos", "raw"))
    rows = rows.withColumns(parse_citation(F.col("raw")))
    return rows.where((F.size("indices") > 0) | F.col("year").isNotNull() | F.col("raw").rlike(NUMBERS))


def bibliography_keys(refs: DataFrame) -> DataFrame:
    """doc_id, ref_idx, year, name, institutional (boolean): what in-text citations are matched by."""
    rows = refs.where(F.col("year").isNotNull()).select("doc_id", "ref_idx", "year", F.explode("authors").alias("a")).where(~t.missing(F.col("a.family")))
    whole = t.missing(F.col("a.given")) & t.is_institution(F.col("a.family"))
    return rows.select("doc_id", "ref_idx", "year", F.when(whole, t.institution_key(F.col("a.family"))).otherwise(t.normalize_surname(F.col("a.family"))).alias("name"), whole.alias("institutional"))


def matches(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, raw, ref_idx: what citations resolve to. Three equi-joins; the part-of-name rule is an
    equi-join on document and year whose residual compares keys, for institutions only."""
    c, keys = citations.select("doc_id", "raw", "surnames", "year", "indices", "institutional"), bibliography_keys(refs)
    numbered = c.select("doc_id", "raw", F.explode("indices").alias("ref_idx")).join(refs.select("doc_id", "ref_idx"), ["doc_id", "ref_idx"]).select("doc_id", "raw", "ref_idx")
    people = c.where((F.col("institutional") == "") & (F.size("indices") == 0)).select("doc_id", "raw", "year", F.explode(F.array_distinct("surnames")).alias("name"))
    people = people.join(keys.where("not institutional"), ["doc_id", "year", "name"]).select("doc_id", "raw", "ref_idx")
    named = c.where("institutional <> ''").select("doc_id", "raw", "year", F.col("institutional").alias("cited"))
    pairs = named.join(keys.where("institutional"), ["doc_id", "year"])
    pairs = pairs.withColumn("rank", F.when(F.col("cited") == F.col("name"), 0).when(F.contains("name", "cited") | F.contains("cited", "name"), 1)).where("rank IS NOT NULL")
    # the exact key, else the first key of the bibliography that contains or is contained; all entries of that key
    key_first = F.min("ref_idx").over(Window.partitionBy("doc_id", "raw", "name"))
    pairs = pairs.withColumn("first", key_first)
    best = F.min(F.struct("rank", "first")).over(Window.partitionBy("doc_id", "raw"))
    institutions = pairs.withColumn("best", best).where(F.struct("rank", "first") == F.col("best")).select("doc_id", "raw", "ref_idx")
    return numbered.unionByName(people).unionByName(institutions).distinct()


def matched(citations: DataFrame, refs: DataFrame) -> DataFrame:
    return matches(citations, refs).groupBy("doc_id", "raw").agg(F.array_sort(F.collect_set("ref_idx")).alias("ref_idxs"))


def orphans(citations: DataFrame, refs: DataFrame) -> DataFrame:
    return citations.select("doc_id", "pos", "raw").join(matches(citations, refs).select("doc_id", "raw"), ["doc_id", "raw"], "left_anti")


def unused(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """Entries never cited, in documents with a citation at all."""
    cited = refs.select("doc_id", "ref_idx").join(citations.select("doc_id").distinct(), "doc_id", "left_semi")
    return cited.join(matches(citations, refs), ["doc_id", "ref_idx"], "left_anti").select("doc_id", "ref_idx")


def claims(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, claim: sentences that ask for a citation."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(t.text(F.col(text)), F.lit(CLAIM), F.lit(1))).alias("pos", "claim"))
    return rows.select("doc_id", "pos", F.trim("claim").alias("claim"))
