"""Linking references to a catalogue of records: candidates, the best one, corroboration, merging.

All joins are equi-joins on identifiers or title tokens; everything after them is keyed by (doc_id, ref_idx).

There are many candidates to a reference, and few are kept: candidates travel as a number of the record, its keys and
what scores and places need (``SLIM``). Whole records are joined back by number only to the best and to corroborators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..schema import SOURCES
from ..tables import dealt, kept, last_stays
from . import titles

KEY = ["doc_id", "ref_idx"]
WORK_FIELDS = ["source", "source_id", "source_url", "authors", "title", "year", "container_title", "volume", "issue", "pages", "publisher", "doi", "arxiv_id", "pmid", "type"]
#: What scoring, placing and corroboration read of a record beside its keys.
SLIM = ["source", "source_id", "year", "doi"]
NUMBER, KEYS = "__number", "__keys"
FILLED = ["doi", "container_title", "volume", "issue", "pages", "publisher", "arxiv_id", "pmid", "year"]
PER_SOURCE = 5

# ---- thresholds of the linkage rules (fixed values)
DECISIVE_TITLE, AGREEING_TITLE, CORROBORATING_TITLE, HALF_OF_NAMES = 92, 90, 88, 0.5
# ---- end of fixed values


def source_rank(source: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), source), F.lit(len(SOURCES) + 1)).cast("int")


def _keys(title: Column, authors: Column) -> Column:
    """What titles and names are compared by, worked out once for each record and each reference, not for each pair; words
    are joined, as arrays of short words take twice the room on the way."""
    some = F.size(F.coalesce(authors, F.array().cast(f"array<{t.AUTHOR}>"))) > 0
    return F.struct(t.normalize_title(title).alias("tokens"), F.array_join(t.surnames(authors), " ").alias("names"), (~t.missing(title)).alias("titled"), some.alias("signed"))


def _words(joined: Column) -> Column:
    """The tokens or surnames of keys, none of which is empty or holds a space."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def numbered(works: DataFrame) -> DataFrame:
    """The records with a number of their own and their keys, written once."""
    keys = _keys(F.col("title"), F.col("authors"))
    return kept(works.select(F.monotonically_increasing_id().alias(NUMBER), *WORK_FIELDS, keys.alias(KEYS)), "records")


def _work(works: DataFrame, **more: Column) -> DataFrame:
    """w (the record; of numbered ones, the number and ``SLIM``), k (its keys) and what else is asked for."""
    more = [c.alias(name) for name, c in more.items()]
    if NUMBER in works.columns:
        return works.select(F.struct(F.col(NUMBER).alias("number"), *SLIM).alias("w"), F.col(KEYS).alias("k"), *more)
    return works.select(F.struct(*WORK_FIELDS).alias("w"), _keys(F.col("title"), F.col("authors")).alias("k"), *more)


def by_doi(refs: DataFrame, works: DataFrame) -> DataFrame:
    cited = refs.where(~t.missing(F.col("doi"))).select(*KEY, F.lower("doi").alias("id"))
    known = _work(works.where(F.col("source").isin("crossref", "openalex") & ~t.missing(F.col("doi"))), id=F.lower("doi"))
    return cited.join(dealt(known), "id").select(*KEY, "w", "k")


def by_pmid(refs: DataFrame, works: DataFrame) -> DataFrame:
    cited = refs.where(~t.missing(F.col("pmid"))).select(*KEY, F.col("pmid").alias("id"))
    return cited.join(dealt(_work(works.where("source = 'pubmed'"), id=F.col("pmid"))), "id").select(*KEY, "w", "k")


def by_arxiv(refs: DataFrame, works: DataFrame) -> DataFrame:
    bare = lambda c: F.regexp_replace(F.lower(c), r"v\d+$", "")
    cited = refs.where(~t.missing(F.col("arxiv_id"))).select(*KEY, bare("arxiv_id").alias("id"))
    return cited.join(dealt(_work(works.where("source = 'arxiv'"), id=bare("arxiv_id"))), "id").select(*KEY, "w", "k")


def by_id(refs: DataFrame, works: DataFrame) -> DataFrame:
    return by_doi(refs, works).unionByName(by_arxiv(refs, works)).unionByName(by_pmid(refs, works))


def decisive(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of references that need no search: two records by identifier, one with the cited DOI and title."""
    both = dealt(found).join(refs.select(*KEY, "doi", "title", t.title_tokens(F.col("title")).alias("tokens")), KEY)
    cited = sim.same_doi(F.col("doi"), F.col("w.doi")) & ~t.missing(F.col("title"))
    both = sim.with_ratio(both, "likeness", _words(F.col("k.tokens")), F.col("tokens"), cited, DECISIVE_TITLE)
    strong = F.coalesce(cited & (F.col("likeness") >= DECISIVE_TITLE), F.lit(False))
    return both.groupBy(*KEY).agg(F.max(strong).alias("strong"), F.count("*").alias("n")).where("strong AND n >= 2").select(*KEY)


def title_search(refs: DataFrame, works: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """Up to ``per_source`` records of each source that share the most terms with a title (``titles.search``), with w, k and shared."""
    # written, so that the exchanges of the search are gone before those of the records come
    with last_stays():
        found = kept(titles.search(refs, works, per_source).select(*KEY, "source", "source_id", "shared"), "title-found")
    records = _work(works, source=F.col("source"), source_id=F.col("source_id"))
    return found.join(dealt(records), ["source", "source_id"]).select(*KEY, "w", "k", F.col("shared").cast("long").alias("shared"))


def _found(refs: DataFrame, records: DataFrame, skip_search: bool) -> DataFrame:
    """By identifier, and by title for references that those do not decide; each record (numbered) once."""
    found = kept(by_id(refs, records), "by-id")
    if not skip_search:
        found = found.unionByName(title_search(refs.join(decisive(refs, found), KEY, "left_anti"), records).drop("shared"))
    # dealt by reference once: the join with references needs no other exchange
    first = [F.min_by(c, F.col("w.number")).alias(c) for c in ("w", "k")]
    return found.repartition(*KEY).groupBy(*KEY, F.col("w.source").alias("s"), F.col("w.source_id").alias("i")).agg(*first).drop("s", "i")


def _catalogue(works: DataFrame, use_scholarly: bool) -> DataFrame:
    return numbered(works if use_scholarly else works.where("source <> 'scholarly'"))


def whole(rows: DataFrame, records: DataFrame) -> DataFrame:
    """``rows`` of a number with w, the whole record."""
    return rows.join(dealt(records.select(F.col(NUMBER).alias("number"), F.struct(*WORK_FIELDS).alias("w"))), "number").drop("number")


def candidates(refs: DataFrame, works: DataFrame, use_scholarly: bool = False, skip_search: bool = False) -> DataFrame:
    """Candidates with whole records (w) and keys (k)."""
    records = _catalogue(works, use_scholarly)
    return whole(_found(refs, records, skip_search).select(*KEY, "w.number", "k"), records)


def scored(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (of ``found``, w has ``SLIM`` at least) with title_score, score and place (1 is the best). Sandbox DOIs come
    after all others."""
    r, w = ({c: F.col(f"{x}.{c}") for c in ("year", "doi")} for x in ("r", "w"))
    rows = found.join(dealt(refs.select(*KEY, F.struct("year", "doi").alias("r"), _keys(F.col("title"), F.col("authors")).alias("rk"))), KEY)
    rows = sim.with_ratio(rows, "title_score", _words(F.col("rk.tokens")), _words(F.col("k.tokens")))
    overlap = F.when(F.col("rk.signed"), sim.overlap(_words(F.col("rk.names")), _words(F.col("k.names"))))
    score = sim.record_score(r, w, F.col("title_score"), overlap, F.col("rk.titled") & F.col("k.titled"))
    rows = rows.withColumn("score", score).drop("r", "rk")
    sandbox = ~t.missing(w["doi"]) & ~t.real_doi(w["doi"])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(sandbox, F.desc("score"), source_rank(F.col("w.source")), F.col("w.source_id")))
    return rows.withColumn("place", place.cast("int"))


def ranked(refs: DataFrame, works: DataFrame, use_scholarly: bool = False, skip_search: bool = False) -> DataFrame:
    """The candidates of references, ``scored``: w is slim."""
    return scored(refs, _found(refs, _catalogue(works, use_scholarly), skip_search))


def best(ranked: DataFrame) -> DataFrame:
    return ranked.where("place = 1").drop("place")


def _alike(rows: DataFrame, *best: str) -> DataFrame:
    """Candidates with names_agree, likeness and good: like title, near year, and same DOI or common names as the best; ``best``
    are columns of the best that are asked for beside. likeness is null where a record fails in all but the title, or where
    lengths show that its title does."""
    whole = Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = F.struct(*(F.col(f"w.{c}").alias(c) for c in ("year", "doi")))
    rows = rows.withColumns({"bw": F.first(short).over(whole), "bk": F.first("k").over(whole)} | {"best": F.first(c).over(whole) for c in best})
    b, w = F.col("bw"), F.col("w")
    overlap = sim.overlap(_words(F.col("bk.names")), _words(F.col("k.names")))
    rows = rows.withColumn("names_agree", (overlap >= HALF_OF_NAMES) | ~F.col("bk.signed") | ~F.col("k.signed"))
    agrees = (F.col("place") > 1) & F.col("k.titled") & sim.close_years(b["year"], w["year"]) & (sim.same_doi(b["doi"], w["doi"]) | F.col("names_agree"))
    rows = sim.with_ratio(rows, "likeness", _words(F.col("bk.tokens")), _words(F.col("k.tokens")), agrees, CORROBORATING_TITLE)
    return rows.withColumn("good", F.coalesce(F.col("likeness") >= CORROBORATING_TITLE, F.lit(False))).drop("bw", "bk")


def _each_url_once(rows: DataFrame) -> DataFrame:
    w = F.col("w")
    once = F.row_number().over(Window.partitionBy(*KEY, "good", w["source"], w["source_url"]).orderBy("place")) == 1
    return rows.withColumn("corroborates", F.col("good") & once).drop("good")


def corroboration(rows: DataFrame) -> DataFrame:
    """Candidates (with whole records) with best (record) and corroborates: alike, each URL once."""
    return _each_url_once(_alike(rows, "w"))


def corroborated(refs: DataFrame, works: DataFrame, use_scholarly: bool = False, skip_search: bool = False) -> DataFrame:
    """The best and the corroborating candidates of references with whole records, as ``merged`` reads them."""
    records = _catalogue(works, use_scholarly)
    with last_stays():
        rows = _alike(scored(refs, _found(refs, records, skip_search))).where((F.col("place") == 1) | F.col("good"))
        rows = kept(rows.select(*KEY, "w.number", "place", "score", "title_score", "names_agree", "likeness", "good"), "alike")
    return _each_url_once(whole(rows, records).repartition(*KEY)).where((F.col("place") == 1) | F.col("corroborates"))


def linked(refs: DataFrame, works: DataFrame, use_scholarly: bool = False, skip_search: bool = False) -> DataFrame:
    """``merged`` for the candidates of references."""
    return merged(corroborated(refs, works, use_scholarly, skip_search))


def merged(rows: DataFrame) -> DataFrame:
    """One row for each reference: canonical (the best record with gaps filled from corroborators, in order),
    merged_from, score, title_score, sources_agreeing and corroborating (records by place)."""
    order = F.when(F.col("corroborates"), F.col("place"))
    aggs = [F.max_by("w", -F.col("place")).alias("b"), *(F.max(F.when(F.col("place") == 1, F.col(c))).alias(c) for c in ("score", "title_score"))]
    for field in FILLED:
        value = F.col(f"w.{field}")
        useful = value.isNotNull() if field == "year" else ~t.missing(value) & (t.real_doi(value) if field == "doi" else F.lit(True))
        aggs.append(F.min_by(F.struct(value.alias("v"), F.col("w.source").alias("s")), F.when(useful, order)).alias(f"f_{field}"))
    aggs.append(F.min_by(F.struct(F.col("w.authors").alias("v"), F.col("w.source").alias("s")), F.when(F.size(F.col("w.authors")) > 0, order)).alias("f_authors"))
    aggs.append(F.transform(F.array_sort(F.collect_list(F.when(F.col("corroborates"), F.struct("place", "w")))), lambda x: x["w"]).alias("corroborating"))
    agrees = (F.col("place") == 1) | (F.col("corroborates") & (F.col("likeness") >= AGREEING_TITLE) & F.col("names_agree"))
    aggs.append(F.size(F.collect_set(F.when(agrees, F.col("w.source")))).alias("sources_agreeing"))
    rows = rows.groupBy(*KEY).agg(*aggs)
    values, origins = {}, []
    for field in [*FILLED, "authors"]:
        own = F.col(f"b.{field}")
        if field == "doi":
            own = F.when(t.real_doi(own), own)
        empty = own.isNull() if field == "year" else F.coalesce(F.size(own) <= 0, F.lit(True)) if field == "authors" else t.missing(own)
        values[field] = F.when(empty, F.coalesce(F.col(f"f_{field}.v"), own)).otherwise(own)
        origins.append(F.when(empty & F.col(f"f_{field}").isNotNull(), F.struct(F.lit(field).alias("key"), F.col(f"f_{field}.s").alias("value"))))
    canonical = F.struct(*(values.get(c, F.col(f"b.{c}")).alias(c) for c in WORK_FIELDS))
    return rows.select(*KEY, "score", "title_score", canonical.alias("canonical"), F.map_from_entries(F.filter(F.array(*origins), lambda x: x.isNotNull())).alias("merged_from"), "sources_agreeing", "corroborating")
