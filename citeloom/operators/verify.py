"""The rules on a reference and its canonical record: differences, edits, tier, notes, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..tables import dealt, kept, last_stays
from . import linkage
from .linkage import KEY

# ---- thresholds and labels of the rules (fixed values)
LEAST_SCORE, TRUSTED_SCORE, SAME_TITLE, NAMED_TITLE, LONE_TITLE, SOME_NAMES = 70, 88, 92, 95, 97, 0.34
SAME_JOURNAL, FIRST_JOURNAL_YEAR, LONGEST_RANGE = 80, 1665, 1500
STRICTNESS = ("default", "strict", "relaxed")
# ---- end of fixed values

NO_AUTHORS = f"array<{t.AUTHOR}>"


def _authors(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(NO_AUTHORS))


def _difference(when: Column, field: str, parsed: Column, canonical: Column, severity: Column | str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    row = F.struct(F.lit(field).alias("field"), t.text(parsed.cast("string")).alias("parsed_value"), t.text(canonical.cast("string")).alias("canonical_value"), severity.alias("severity"))
    return F.when(when, row)


def _both(a: Column, b: Column) -> Column:
    return ~t.missing(a) & ~t.missing(b)


def discrepancies(r, c, title_score: Column, journal_score: Column, doi_known: Column, this_year: int) -> Column:
    """array<struct<field, parsed_value, canonical_value, severity>> of a reference ``r`` and its record ``c``."""
    ra, ca = _authors(r["authors"]), _authors(c["authors"])
    both_named = (F.size(ra) > 0) & (F.size(ca) > 0)
    overlap = sim.surname_overlap(ra, ca)
    names = lambda a: F.array_join(F.transform(F.slice(a, 1, 5), t.full_name), "; ")
    dead = ~t.missing(r["doi"]) & ~F.coalesce(doi_known, F.lit(True))
    pages = t.text(r["pages"])
    ends = F.split(F.trim(pages), "[-–]", 2)
    digits = lambda i: F.regexp_replace(F.try_element_at(ends, F.lit(i)), r"\D", "").try_cast("long")
    ranged = pages.rlike(r"^\s*\d+\s*[-–]\s*\d+")
    span = F.when(ranged, digits(2) - digits(1))
    rules = [
        _difference(_both(r["title"], c["title"]) & (title_score < SAME_TITLE), "title", r["title"], c["title"], "major"),
        _difference(r["year"] != c["year"], "year", r["year"], c["year"], F.when(F.abs(r["year"] - c["year"]) > 1, "major").otherwise("minor")),
        _difference(dead, "doi (does not resolve)", r["doi"], F.when(t.missing(c["doi"]), "(canonical record has no DOI)").otherwise(c["doi"]), "major"),
        _difference(~dead & _both(r["doi"], c["doi"]) & (F.lower(r["doi"]) != F.lower(c["doi"])), "doi", r["doi"], c["doi"], "major"),
        _difference(_both(r["container_title"], c["container_title"]) & (journal_score < SAME_JOURNAL) & ~t.abbreviates(r["container_title"], c["container_title"]), "journal", r["container_title"], c["container_title"], "major"),
        _difference(both_named & (overlap < linkage.HALF_OF_NAMES), "authors (surnames disagree)", names(ra), names(ca), "major"),
        _difference(
            both_named & (overlap >= linkage.HALF_OF_NAMES) & (F.size(ca) > F.size(ra) + 1) & ~t.uses_et_al(r["raw_text"]), "author count",
            F.concat(F.size(ra).cast("string"), F.lit(" listed")), F.concat(F.size(ca).cast("string"), F.lit(" on the canonical record")), "minor",
        ),
        _difference(_both(r["volume"], c["volume"]) & ~t.same_number(r["volume"], c["volume"]), "volume", r["volume"], c["volume"], "major"),
        _difference(_both(r["issue"], c["issue"]) & ~t.same_number(r["issue"], c["issue"]), "issue", r["issue"], c["issue"], "major"),
        _difference(_both(r["pages"], c["pages"]) & (F.trim(t.normalize_pages(r["pages"])) != F.trim(t.normalize_pages(c["pages"]))), "pages", r["pages"], c["pages"], "major"),
        _difference(r["year"] > this_year + 1, "year (future)", r["year"], F.lit(f"<= {this_year}"), "major"),
        _difference(r["year"] < FIRST_JOURNAL_YEAR, "year (implausibly historical)", r["year"], F.lit(f">= {FIRST_JOURNAL_YEAR}"), "major"),
        _difference(span < 0, "pages (backwards)", pages, F.lit("start > end is impossible"), "major"),
        _difference(span > LONGEST_RANGE, "pages (implausibly long)", pages, F.concat(F.lit("range spans "), span.cast("string"), F.lit(" pages")), "minor"),
        _difference(pages.rlike(r"\bPMC\d{5,}\b"), "pages (PMC ID in pages slot)", pages, F.lit("PMC IDs do not belong in the pages field"), "major"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def style_edits(r, c, differences: Column) -> Column:
    """array<struct<field, original, corrected, description>>: missing middle initials and hyphens in page
    ranges, less those about a field that differs anyway."""
    canonical = F.filter(_authors(c["authors"]), lambda a: ~t.missing(a["family"]))
    parts = lambda g: F.filter(F.split(t.text(g), r"[\s.\-]+"), lambda x: x != "")
    capitals = lambda p: F.transform(p, lambda x: F.upper(F.substring(x, 1, 1)))

    def one(a: Column) -> Column:
        known = F.try_element_at(F.filter(canonical, lambda k: F.lower(k["family"]) == F.lower(a["family"])), F.lit(-1))
        mine, theirs = parts(a["given"]), parts(known["given"])
        short, long = F.array_join(capitals(mine), ""), F.array_join(capitals(theirs), "")
        more = known.isNotNull() & ~t.missing(a["family"]) & (F.size(theirs) > F.size(mine)) & (short != "") & long.startswith(short)
        return F.when(more, F.struct(
            F.concat(F.lit("author '"), known["family"], F.lit("'")).alias("field"),
            F.concat(a["family"], F.lit(", "), t.text(a["given"])).alias("original"),
            F.concat(known["family"], F.lit(", "), F.array_join(capitals(theirs), ". "), F.lit(".")).alias("corrected"),
            F.concat(
                F.lit("Add missing middle initial(s) for "), known["family"], F.lit(": '"), t.text(a["given"]), F.lit("' has "), F.size(mine).cast("string"),
                F.lit(" initial(s), canonical record shows "), F.size(theirs).cast("string"), F.lit(" ("), long, F.lit(")."),
            ).alias("description"),
        ))

    pages = t.text(r["pages"])
    same = t.missing(c["pages"]) | (F.trim(t.normalize_pages(pages)) == F.trim(t.normalize_pages(c["pages"])))
    dashed = F.replace(pages, F.lit("-"), F.lit("–"))
    hyphen = F.when(F.contains(pages, F.lit("-")) & ~F.contains(pages, F.lit("–")) & same, F.struct(
        F.lit("pages").alias("field"), pages.alias("original"), dashed.alias("corrected"),
        F.concat(F.lit("Use en-dash in page range: '"), pages, F.lit("' -> '"), dashed, F.lit("'.")).alias("description"),
    ))
    edits = F.filter(F.concat(F.transform(_authors(r["authors"]), one), F.array(hyphen)), lambda e: e.isNotNull())
    heads = F.transform(differences, lambda d: F.split(d["field"], " ")[0])
    return F.filter(edits, lambda e: ~F.exists(heads, lambda h: e["field"].startswith(h)))


def tier(r, c, score: Column, agreeing: Column, title_score: Column, differences: Column, edits: Column) -> Column:
    ra, ca = _authors(r["authors"]), _authors(c["authors"])
    nameless = (F.size(ra) == 0) | (F.size(ca) == 0)
    first = lambda a: t.normalize_surname(F.try_element_at(a, F.lit(1))["family"])
    same_id = lambda f: _both(r[f], c[f]) & (F.lower(r[f]) == F.lower(c[f]))
    by_id = same_id("doi") | same_id("arxiv_id") | same_id("pmid")
    titled = _both(r["title"], c["title"])
    lead = ~t.missing(F.try_element_at(ra, F.lit(1))["family"]) & (first(ra) == first(ca))
    named = titled & (title_score >= NAMED_TITLE) & (nameless | lead | (sim.surname_overlap(ra, ca) >= SOME_NAMES))
    alone = titled & (title_score >= LONE_TITLE) & sim.close_years(r["year"], c["year"])
    real = ((score >= TRUSTED_SCORE) & (agreeing >= 2)) | by_id | named | alone
    return (
        F.when(c["source"].isNull() | F.coalesce(score < LEAST_SCORE, F.lit(True)) | ~F.coalesce(real, F.lit(False)), "hallucinated")
        .when(F.size(differences) > 0, "partial")
        .when(F.size(edits) > 0, "verified_with_style_edits")
        .otherwise("verified")
    )


def grey_literature(r, found: Column, doi_known: Column, url_known: Column, strictness: str) -> Column:
    """What no database lists is accepted by its URL, or by its institution as the first author."""
    if strictness not in STRICTNESS:
        raise ValueError(f"strictness is one of {STRICTNESS}, not {strictness!r}")
    if strictness == "strict":
        return found
    institution = t.is_institution(F.try_element_at(_authors(r["authors"]), F.lit(1))["family"])
    open_ = (found == "hallucinated") & F.coalesce(doi_known, F.lit(True)) & (F.coalesce(url_known, F.lit(False)) | F.coalesce(institution, F.lit(False)))
    return F.when(open_, "verified" if strictness == "relaxed" else "verified_via_url").otherwise(found)


def notes(r, c, confidence: Column, score: Column, title_score: Column, differences: Column, doi_known: Column, url_known: Column) -> Column:
    lead_r, lead_c = (F.try_element_at(_authors(x["authors"]), F.lit(1))["family"] for x in (r, c))
    whole = F.format_string("%.0f", F.coalesce(score, F.lit(0.0)))
    by_url = F.coalesce(url_known, F.lit(False)) & ~t.missing(r["url"])
    swapped = (title_score >= LONE_TITLE) & ~t.missing(lead_r) & ~t.missing(lead_c) & (t.normalize_surname(lead_r) != t.normalize_surname(lead_c)) & (sim.surname_overlap(r["authors"], c["authors"]) < SOME_NAMES)
    n = F.size(differences)
    dead = F.when(~t.missing(r["doi"]) & ~F.coalesce(doi_known, F.lit(True)), F.concat(F.lit("The cited DOI '"), r["doi"], F.lit("' does not resolve; the DOI of a published paper would.")))
    main = (
        F.when((confidence == "verified_via_url") & by_url, F.concat(F.lit("Confirmed by its URL"), F.when(t.reputable(r["url"]), " (reputable domain)").otherwise(""), F.lit(": "), r["url"], F.lit(". Grey literature is not listed in the databases.")))
        .when(confidence == "verified_via_url", F.concat(F.lit("Institutional grey literature by '"), t.text(lead_r), F.lit("'"), F.when(t.missing(r["publisher"]), "").otherwise(F.concat(F.lit(" (publisher: '"), r["publisher"], F.lit("')"))), F.lit("; "), F.when(t.missing(r["url"]), "no URL was given").otherwise("its URL did not resolve"), F.lit(".")))
        .when(c["source"].isNull(), "No database has a candidate and no URL resolves. Treat as fabricated until confirmed by hand.")
        .when(confidence == "hallucinated", F.concat(F.lit("The closest candidate scored "), whole, F.lit("/100 and no second source corroborates it.")))
        .when(confidence == "partial", F.concat(F.lit("The paper appears to be real (score "), whole, F.lit("/100) but the citation has "), n.cast("string"), F.when(n == 1, " substantive error.").otherwise(" substantive errors.")))
        .when(confidence == "verified_with_style_edits", "All substantive parts are correct; the edits are cosmetic.")
    )
    wrong = F.when((confidence == "partial") & F.coalesce(swapped, F.lit(False)), F.concat(F.lit("The title matches, but the authors do not: cited with '"), t.text(lead_r), F.lit("' first, the record has '"), t.text(lead_c), F.lit("'.")))
    return F.filter(F.array(dead, main, wrong), lambda x: x.isNotNull())


def audit(refs: DataFrame, works: DataFrame, dois: DataFrame, urls: DataFrame, strictness: str = "default", this_year: int = 2026, use_scholarly: bool = False, skip_search: bool = False) -> DataFrame:
    """One row for each reference: doc_id, ref_idx, parsed, canonical, confidence, score, sources_agreeing,
    discrepancies, style_edits, notes, merged_from, corroborating. ``dois`` (doi) are those that resolve,
    ``urls`` has (url, resolves)."""
    with last_stays():
        linked = kept(linkage.linked(refs, works, use_scholarly, skip_search), "merged")
    known = dois.select(F.lower("doi").alias("known_doi")).distinct()
    pages = urls.groupBy(F.col("url").alias("known_url")).agg(F.max("resolves").alias("url_known"))
    # canonical records are joined last: they are the wider part, and travel once
    rows = refs.join(known, F.lower("doi") == F.col("known_doi"), "left").join(pages, F.col("url") == F.col("known_url"), "left").join(dealt(linked), KEY, "left")
    parsed = F.struct(*(F.col(c) for c in refs.columns if c not in KEY))
    rows = rows.select(
        *KEY, parsed.alias("parsed"), "canonical", "score", "title_score", F.coalesce("sources_agreeing", F.lit(0)).alias("sources_agreeing"), "merged_from", "corroborating",
        F.when(~t.missing(F.col("doi")), F.col("known_doi").isNotNull()).alias("doi_known"), F.when(~t.missing(F.col("url")), F.coalesce("url_known", F.lit(False))).alias("url_known"),
    )
    r, c = F.col("parsed"), F.col("canonical")
    rows = sim.with_ratio(rows, "journal_score", t.journal_words(r["container_title"]), t.journal_words(c["container_title"]))
    none = "array<struct<field:string,parsed_value:string,canonical_value:string,severity:string>>"
    rows = rows.withColumn("discrepancies", F.when(c.isNotNull(), discrepancies(r, c, F.col("title_score"), F.col("journal_score"), F.col("doi_known"), this_year)).otherwise(F.array().cast(none)))
    edits = "array<struct<field:string,original:string,corrected:string,description:string>>"
    rows = rows.withColumn("style_edits", F.when(c.isNotNull(), style_edits(r, c, F.col("discrepancies"))).otherwise(F.array().cast(edits)))
    found = tier(r, c, F.col("score"), F.col("sources_agreeing"), F.col("title_score"), F.col("discrepancies"), F.col("style_edits"))
    rows = rows.withColumn("confidence", grey_literature(r, found, F.col("doi_known"), F.col("url_known"), strictness))
    return rows.withColumn("notes", notes(r, c, F.col("confidence"), F.col("score"), F.col("title_score"), F.col("discrepancies"), F.col("doi_known"), F.col("url_known")))


def duplicates(results: DataFrame) -> DataFrame:
    """doc_id, idx1, idx2, reason for entries of a bibliography that are the same work. Each entry has a
    key for each reason (DOI, record id, year of the record, year as parsed), so one equi-join finds the
    pairs; the first reason that holds counts."""
    c, p = F.col("canonical"), F.col("parsed")
    year = lambda y: F.coalesce(y.cast("string"), F.lit("?"))
    keys = [F.when(~t.missing(c["doi"]), F.lower(c["doi"])), F.when(~t.missing(c["source_id"]), F.concat_ws("|", c["source"], c["source_id"])), F.when(~t.missing(c["title"]), year(c["year"])), F.when(~t.missing(p["title"]), year(p["year"]))]
    named = F.filter(F.array(*(F.struct(F.lit(i + 1).alias("rank"), k.alias("key")) for i, k in enumerate(keys))), lambda k: k["key"].isNotNull())
    kept = lambda x: F.struct(*(x[f].alias(f) for f in ("doi", "source", "source_id", "title", "authors")))
    rows = results.select("doc_id", "ref_idx", F.when(c.isNotNull(), kept(c)).alias("c"), p["title"].alias("p"), F.explode(named).alias("k")).select("doc_id", "k.rank", "k.key", "ref_idx", "c", "p")
    a, b = (rows.select("doc_id", "rank", "key", F.col("ref_idx").alias(f"idx{n}"), F.col("c").alias(f"c{n}"), F.col("p").alias(f"p{n}")) for n in (1, 2))
    pairs = a.join(b, ["doc_id", "rank", "key"]).where("idx1 < idx2")
    rank, c1, c2 = F.col("rank"), F.col("c1"), F.col("c2")
    pairs = pairs.where((rank < 3) | ((rank == 3) & (sim.surname_overlap(c1["authors"], c2["authors"]) >= linkage.HALF_OF_NAMES)) | ((rank == 4) & (c1.isNull() | c2.isNull())))
    titles = lambda n: F.when(rank == 3, F.col(f"c{n}.title")).when(rank == 4, F.col(f"p{n}"))
    pairs = sim.with_title_ratio(pairs, "likeness", titles(1), titles(2), rank >= 3, NAMED_TITLE).where((rank < 3) | (F.col("likeness") >= NAMED_TITLE))
    reason = (
        F.when(rank == 1, F.concat(F.lit("shared DOI: "), c1["doi"]))
        .when(rank == 2, F.concat(F.lit("shared "), c1["source"], F.lit(" ID: "), c1["source_id"]))
        .when(rank == 3, "identical canonical record")
        .otherwise("duplicate parsed title and year")
    )
    return pairs.groupBy("doc_id", "idx1", "idx2").agg(F.min_by(reason, rank).alias("reason"))


def tier_counts(results: DataFrame) -> DataFrame:
    """confidence, n for all five tiers, also those without a reference."""
    from ..schema import TIERS

    tiers = results.sparkSession.createDataFrame([(x,) for x in TIERS], "confidence string")
    counts = results.groupBy("confidence").agg(F.count("*").alias("n"))
    return tiers.join(counts, "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))
