"""The engine's registered queries, over tables made from the driver's documents (``views``)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import edits, styles
from ..functions import text as t
from ..operators import entries, incremental, intext, linkage, verify
from ..sources import sinks
from ..tables import kept, workspace
from . import oracle, oracle_reports, oracle_styles, records
from .views import view

KEY = linkage.KEY
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def either(f):
    """Registers ``f`` over the whole audit, and over candidates by identifiers alone as ``<name>_by_id``."""
    _QUERIES[f.__name__] = lambda spark, d: f(spark, d, False)
    _QUERIES[f"{f.__name__}_by_id"] = lambda spark, d: f(spark, d, True)
    return f


def _audit(spark: SparkSession, d: str, strictness: str = "default", skip_search: bool = False) -> DataFrame:
    return verify.audit(view(spark, d, "refs_v"), view(spark, d, "works_v"), view(spark, d, "doi_v"), view(spark, d, "url_v"), strictness, 2026, skip_search=skip_search)


def _ranked(spark: SparkSession, d: str, skip_search: bool = False) -> DataFrame:
    return linkage.ranked(view(spark, d, "refs_v"), view(spark, d, "works_v"), skip_search=skip_search)


@query
def normalize_title_docs(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(t.normalize_title(F.col("text"))).alias("title_md5"))


@query
def normalize_compatible_docs(spark, d):
    """As ``normalize_title_docs`` of texts whose digits are subscripts and whose small letters are full-width: the same keys."""
    small = "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in small)
    text = F.translate("text", small + "0123456789", wide + "".join(chr(0x2080 + k) for k in range(10)))
    return _read(spark, d, "documents").select("doc_id", F.md5(t.normalize_title(F.replace(text, F.lit("ｆｉ"), F.lit("ﬁ")))).alias("title_md5"))


@query
def normalize_names(spark, d):
    a = view(spark, d, "refs_v").select(*KEY, F.posexplode("authors").alias("p", "a"))
    return a.select(*KEY, (F.col("p") + 1).cast("int").alias("n"), t.normalize_surname(F.col("a.family")).alias("surname"), t.institution_key(F.col("a.family")).alias("institution_key"), t.is_institution(F.col("a.family")).alias("institutional"), t.initial_of(F.col("a.given")).alias("initial"))


@query
def journal_match(spark, d):
    s, j, v = F.col("short_journal"), F.col("journal"), F.col("volume")
    return view(spark, d, "base").select("doc_id", t.normalize_journal(s).alias("short_key"), t.normalize_journal(j).alias("full_key"), t.abbreviates(s, j).alias("abbreviates"), t.abbreviates(j, v).alias("with_volume"))


@query
def reputable_hosts(spark, d):
    return _read(spark, d, "pages").select("page_id", t.reputable(F.col("url")).alias("reputable"))


@query
def extract_ids(spark, d):
    r = F.col("raw")
    return view(spark, d, "raw_v").select("doc_id", t.doi_of(r).alias("doi"), t.arxiv_of(r).alias("arxiv_id"), t.pmid_of(r).alias("pmid"), t.year_of(r).alias("year"), t.url_of(r).alias("url"))


@query
def parsed_entries(spark, d):
    rows = entries.parse_entries(view(spark, d, "raw_v"), "raw")
    names = F.array_join(F.transform("authors", lambda a: F.concat_ws("|", a["family"], a["given"])), ";")
    return rows.select("doc_id", "title", names.alias("authors"), "year", "container_title", "volume", "issue", "pages", "publisher", "doi", "arxiv_id", "pmid", "url", "type")


@query
def refs_block(spark, d):
    return view(spark, d, "paper_v").select("doc_id", F.array_join(entries.references_block(F.col("text")), "\n").alias("block"), entries.body_text(F.col("text")).alias("body"))


@query
def split_entries(spark, d):
    return entries.entries(view(spark, d, "paper_v"))


@query
def surname_overlap(spark, d):
    r = view(spark, d, "refs_v").where("doi <> ''").select(*KEY, "doi", F.col("authors").alias("a"))
    w = view(spark, d, "works_v").select("source", "doi", F.col("authors").alias("b"))
    return r.join(w, "doi").select(*KEY, "source", F.round(sim.surname_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@either
def title_ratio(spark, d, skip_search):
    return _ranked(spark, d, skip_search).select(*KEY, "w.source", "title_score")


@query
def id_candidates(spark, d):
    return linkage.by_id(view(spark, d, "refs_v"), view(spark, d, "works_v")).select(*KEY, "w.source", "w.source_id").distinct()


@query
def title_search_all_terms(spark, d):
    return linkage.title_search(view(spark, d, "refs_v"), view(spark, d, "works_v")).select(*KEY, "w.source", "w.source_id", "shared")


@either
def record_scores(spark, d, skip_search):
    return _ranked(spark, d, skip_search).select(*KEY, "w.source", "w.source_id", "score", "place")


@either
def best_record(spark, d, skip_search):
    return linkage.best(_ranked(spark, d, skip_search)).select(*KEY, "w.source", "w.source_id", "score")


@either
def corroborators(spark, d, skip_search):
    rows = linkage.corroborated(view(spark, d, "refs_v"), view(spark, d, "works_v"), skip_search=skip_search)
    return rows.where("corroborates").select(*KEY, "w.source", "w.source_id")


@either
def merged_metadata(spark, d, skip_search):
    rows = linkage.linked(view(spark, d, "refs_v"), view(spark, d, "works_v"), skip_search=skip_search)
    fields = [t.text(F.col(f"canonical.{f}")).alias(f) for f in linkage.FILLED if f != "year"]
    return rows.select(*KEY, "canonical.source", "canonical.source_id", F.col("sources_agreeing").cast("int").alias("sources_agreeing"), "canonical.year", *fields, F.size("canonical.authors").alias("n_authors"))


@either
def discrepancies(spark, d, skip_search):
    return _audit(spark, d, skip_search=skip_search).select(*KEY, F.explode("discrepancies").alias("d")).select(*KEY, "d.field", "d.parsed_value", "d.canonical_value", "d.severity")


@either
def style_edits(spark, d, skip_search):
    return _audit(spark, d, skip_search=skip_search).select(*KEY, F.explode("style_edits").alias("e")).select(*KEY, "e.field", "e.original", "e.corrected")


@either
def audit_results(spark, d, skip_search):
    return _audit(spark, d, skip_search=skip_search).select(*KEY, "confidence", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("sources_agreeing").cast("int").alias("sources_agreeing"))


@query
def audit_again(spark, d):
    """The audit after one in a hundred references changed: the others keep the results of the audit before."""
    refs = view(spark, d, "refs_v")
    before = refs.withColumn("title", F.when(F.pmod(F.col("doc_id") + F.col("ref_idx"), F.lit(100)) == 7, F.concat(F.lit("Once "), "title")).otherwise(F.col("title")))
    store, rest = f"{workspace(spark)}/audits-{uuid.uuid4().hex}", [view(spark, d, x) for x in ("works_v", "doi_v", "url_v")]
    incremental.audit(before, *rest, store)
    return incremental.audit(refs, *rest, store).select(*KEY, "confidence", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("sources_agreeing").cast("int").alias("sources_agreeing"))


@either
def audit_tier_counts(spark, d, skip_search):
    return verify.tier_counts(_audit(spark, d, skip_search=skip_search))


@either
def audit_strict(spark, d, skip_search):
    return verify.tier_counts(_audit(spark, d, "strict", skip_search))


@either
def audit_relaxed(spark, d, skip_search):
    return verify.tier_counts(_audit(spark, d, "relaxed", skip_search))


@query
def audit_with_search(spark, d):
    return _audit(spark, d).select(*KEY, "confidence", "score", F.size("discrepancies").alias("n_discrepancies"), F.size("notes").alias("n_notes"))


@either
def duplicates(spark, d, skip_search):
    return verify.duplicates(_audit(spark, d, skip_search=skip_search))


@query
def intext_citations(spark, d):
    rows = intext.intext(view(spark, d, "body_v"), body="body")
    return rows.select("doc_id", "pos", "raw", F.array_join("surnames", ",").alias("surnames"), "year", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"), "institutional")


def _cited(spark, d) -> tuple[DataFrame, DataFrame]:
    return kept(intext.intext(view(spark, d, "body_v"), body="body"), "citations"), view(spark, d, "refs_v")


@query
def xcheck_keys(spark, d):
    return intext.bibliography_keys(view(spark, d, "refs_v")).select(*KEY, "year", "name", "institutional")


@query
def xcheck_matched(spark, d):
    return intext.matched(*_cited(spark, d)).select("doc_id", "raw", F.array_join(F.transform("ref_idxs", lambda x: x.cast("string")), ",").alias("ref_idxs"))


@query
def xcheck_orphans(spark, d):
    return intext.orphans(*_cited(spark, d))


@query
def xcheck_unused(spark, d):
    return intext.unused(*_cited(spark, d))


@query
def xcheck_counts(spark, d):
    cited, refs = _cited(spark, d)
    return sinks.counts(refs, intext.orphans(cited, refs), intext.unused(cited, refs), refs.limit(0)).drop("n_duplicates")


@query
def claims(spark, d):
    return intext.claims(view(spark, d, "body_v"), text="body")


@query
def suggest_top5(spark, d):
    return sinks.suggestions(intext.claims(view(spark, d, "body_v"), text="body"), view(spark, d, "works_v"))


def _style(style: str):
    def run(spark, d):
        w = view(spark, d, "works_v")
        record = {c: F.col(c) for c in w.columns}
        return w.select("source", "source_id", styles.format_reference(record, style).alias("formatted"), styles.format_intext(record, style, F.lit(7)).alias("cited"))

    return run


for _name in styles.SUPPORTED_STYLES:
    _QUERIES[f"format_{_name}"] = _style(_name)


@query
def bibtex(spark, d):
    return sinks.bibtex_entries(_audit(spark, d))


@query
def ris(spark, d):
    return sinks.ris_entries(_audit(spark, d))


@query
def clean_bibliography(spark, d):
    return sinks.clean_bibliography(_audit(spark, d), "apa")


@query
def tracked_changes(spark, d):
    """Each correction as its edit script has it: all changes rejected, and all applied."""
    rows = sinks.token_changes(_audit(spark, d), "apa").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_idx")))
    return rows.select(*KEY, edits.with_changes(F.col("edits"), "insert").alias("rejected"), edits.with_changes(F.col("edits"), "delete").alias("applied"), "nth")


@query
def markdown_entries(spark, d):
    return sinks.markdown_entries(_audit(spark, d), "apa")


@query
def html_entries(spark, d):
    return sinks.html_entries(_audit(spark, d), "apa")


@query
def json_results(spark, d):
    return sinks.json_results(_audit(spark, d))


@query
def cache_keys(spark, d):
    return _read(spark, d, "pages").select("page_id", F.left(F.sha2("url", 256), F.lit(32)).alias("cache_key"))


@query
def api_breaker(spark, d):
    from ..sources.access import circuit_breaker

    calls = _read(spark, d, "events").select("event_id", F.col("event_type").alias("api"), (F.col("value") < 20).alias("failed"))
    return circuit_breaker(calls, {}, default=4, order="event_id").select("event_id", "api", "failed", "open")


def queries() -> dict:
    return _QUERIES | records.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (oracle.oracle_sql() | oracle_styles.style_sql() | oracle_styles.intext_sql() | oracle_reports.oracle_sql() | records.oracle_sql()).items() if k in queries()}
