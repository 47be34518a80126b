"""Title search over posting lists that are cut into ranges of records: the best few records of each source, exactly.

The index. Records are sorted by source, year and id and cut into ranges of at most ``RANGE``. A range is one row: its
years, and for each title term and each surname the delta-coded places of the records that hold it. A term that occurs in
at most ``RARE`` ranges of a source is rare there, and its ranges are listed; others are taken to be in all.

The search. A record shares with a title at most the title's common terms and those rare ones that its range holds. A
range is also no nearer in time than its years are. So each range has an upper bound of the order that records
are ranked by: terms shared, surnames shared, nearness in years.

1. Every title visits, in each source, the ``FIRST`` ranges with most of its rare terms.
2. With what was found there, all ranges whose bound cannot beat the last of a source's best are skipped; others
   are visited. Where the common terms alone are too few, only ranges with rare terms are ever named.

A visit adds up posting lists, the shortest first, and stops where a record in none of them shares too few of the other
terms. Lists of frequent words are bits of the range's records: they are looked up for what was met, and what was not is
counted for all records at once, a level of shared words at a time, until the last of the best is known. Titles travel to
ranges, in salted shares of at most ``VISITS``, and only a range's best come back: no row is made for a pair of title and
record that share a frequent word. Ranges are large, so that a title makes few visits: what is written grows with titles
times ranges. Titles of the same words and year come to the same share, where their terms are added up once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..tables import dealt, kept, last_stays, measured

KEY = ["doc_id", "ref_idx"]
RANGE, RARE, FIRST, VISITS = 1 << 20, 64, 4, 500_000
#: Shares that all visits are dealt to at least, of so many visits or more.
SHARES, LEAST_VISITS = 24, 20_000
#: Postings that a visit adds up before it looks whether more can matter.
STEP = 1024
#: A word that more than one in so many records of a range hold has its list as bits.
DENSE = 256
#: Ranges (of some 60 bytes) whose years are sent to all tasks; beyond these, titles that may need ranges without a rare
#: term meet them by source.
SPANS = 2_000_000
#: Years apart where a year is not known.
UNDATED = 99

INDEX = "range long, source string, low int, high int, undated boolean, ids array<string>, years array<int>, phrases array<string>, terms array<string>, term_starts array<int>, term_steps array<int>, names array<string>, name_starts array<int>, name_steps array<int>"
INDEX_NAMES = [part.split(" ", 1)[0] for part in INDEX.split(", ")]
_TEXTS, _NUMBERS = pa.list_(pa.string()), pa.list_(pa.int32())
INDEX_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), _TEXTS, _NUMBERS, _TEXTS, _TEXTS, _NUMBERS, _NUMBERS, _TEXTS, _NUMBERS, _NUMBERS]


def _lists(held: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, where their lists start, and the steps from record to record in them."""
    words = held.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    places = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
    places = places[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))]).astype(np.int64)
    steps = np.diff(places, prepend=0)
    steps[starts[:-1]] = places[starts[:-1]]
    return words.dictionary, starts, steps


def build_index(works: DataFrame) -> DataFrame:
    """One row for each range of records (``INDEX``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal made, size
            source, years, ids, terms, names, phrases = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
            low, high = pc.min_max(years).as_py().values()
            row = [(part << 32) + made, source[0].as_py(), low, high, years.null_count > 0, ids, years, phrases, *_lists(terms), *_lists(names)]
            held.clear()
            made, size = made + 1, 0
            one = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind.value_type)) if pa.types.is_list(kind) else pa.array([v], kind)
            return pa.RecordBatch.from_arrays([one(v, kind) for v, kind in zip(row, INDEX_TYPES)], names=INDEX_NAMES)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                source = batch.column(0)[at]
                if held and (size == RANGE or held[0].column(0)[0] != source):
                    yield close()
                same = pc.index(pc.not_equal(batch.column(0).slice(at), source), True).as_py()
                n = min(batch.num_rows - at if same < 0 else same, RANGE - size)
                held.append(batch.slice(at, n))
                at, size = at + n, size + n
        if held:
            yield close()

    phrase = F.when(F.col("source") == "arxiv", t.normalize_title(F.col("title")))
    rows = works.where("source IS NOT NULL AND source_id IS NOT NULL")
    with last_stays():
        rows = kept(rows.select("source", F.col("year").cast("int").alias("year"), "source_id", F.array_distinct(t.title_tokens(F.col("title"))).alias("terms"), t.surnames(F.col("authors")).alias("names"), phrase.alias("phrase")), "title-records")
        order = ["source", "year", "source_id"]
        tasks = max(1, -(-rows.count() * 5 // (RANGE * 4)))  # sampled bounds: few tasks have more than one range of a source
        return kept(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, INDEX), "title-index")


def term_ranges(index: DataFrame) -> DataFrame:
    """term, source, ranges: those of a rare term, null for others."""
    rows = index.select("source", "range", F.explode("terms").alias("term"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("term", "source")))
    return rows.groupBy("term", "source").agg(F.when(F.max("n") <= RARE, F.collect_list(F.when(F.col("n") <= RARE, F.col("range")))).alias("ranges"))


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The records of some lists, in order, and how many of the lists hold each."""
    if len(lists) == 1:
        return lists[0], np.ones(len(lists[0]), np.int64)
    places = np.concatenate(lists)
    places.sort()
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1])[: len(places)])
    return places[first], np.diff(first, append=len(places))


class Range:
    """One row of the index in a task: columns of a batch at a place."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        column = lambda name: batch.column(name)[at].values
        self.ids, years = column("ids"), column("years")
        self.size, self.undated = len(self.ids), years.null_count  # records without a year come first
        self.years = pc.fill_null(years, -(1 << 31)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.place = pc.rank(self.ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        self.repeated = self.size > 0 and self.place.max() < self.size
        self.phrases = column("phrases").to_pylist() if batch.column("source")[at].as_py() == "arxiv" else []
        self.lists, self.masks = [], {}
        self.known = None, None, None  # the terms that were added up last, and what was found
        for words, name in (("index_terms", "term"), ("index_names", "name")):
            starts, steps = (column(f"{name}_{x}").to_numpy(zero_copy_only=False).astype(np.int64) for x in ("starts", "steps"))
            sums = np.cumsum(steps)
            places = sums - np.repeat(sums[starts[:-1]] - steps[starts[:-1]], np.diff(starts))
            self.lists.append((dict(zip(column(words).to_pylist(), range(len(starts)))), starts.tolist(), places.astype(np.int32)))

    def posting(self, which: int, word: str) -> np.ndarray | None:
        known, starts, places = self.lists[which]
        i = known.get(word)
        return None if i is None else places[starts[i] : starts[i + 1]]

    def bits(self, which: int, word: str) -> np.ndarray | None:
        """Which records hold the word, a bit each, made once; None where it is not frequent."""
        posting = self.posting(which, word)
        if posting is None or DENSE * len(posting) <= self.size:
            return None
        if (which, word) not in self.masks:
            mask = np.zeros(-(-self.size // 64) * 64, bool)
            mask[posting] = True
            self.masks[which, word] = np.packbits(mask, bitorder="little").view(np.uint64)
        return self.masks[which, word]

    def holds(self, which: int, word: str, at: np.ndarray) -> np.ndarray:
        """Which of the records hold the word."""
        posting = self.posting(which, word)
        if posting is None or not len(posting):
            return np.zeros(len(at), bool)
        if (bits := self.bits(which, word)) is not None:
            return (bits.view(np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return posting[np.minimum(np.searchsorted(posting, at), len(posting) - 1)] == at

    def friends(self, names: list[str], at: np.ndarray) -> np.ndarray:
        return sum((self.holds(1, name, at).astype(np.int64) for name in names), np.zeros(len(at), np.int64))

    def last(self, at: np.ndarray, shared: np.ndarray, limit: int) -> int:
        """Terms that the last of the best shares, each id once; 0 where they are fewer than ``limit``."""
        if self.repeated:
            order = np.lexsort((-shared, self.place[at]))
            ids = self.place[at[order]]
            shared = shared[order][np.append(True, ids[1:] != ids[:-1])[: len(ids)]]
        if len(shared) < limit:
            return 0
        as_many = np.cumsum(np.bincount(shared)[::-1])  # share the most terms, one less, and so on
        return len(as_many) - 1 - int(np.searchsorted(as_many, limit))

    def levels(self, rows: list[np.ndarray], least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, records that exactly n of the rows of bits hold), from the most rows down to ``least``."""
        some = [np.zeros(0, np.uint64)] * (len(rows) + 1)  # some[j]: j of the rows so far, or more
        for i, row in enumerate(rows):
            # what can still become least with the rows to come
            for j in range(i + 1, max(1, least - (len(rows) - 1 - i)) - 1, -1):
                new = row if j == 1 else some[j - 1] & row
                some[j] = new if j == i + 1 else some[j] | new
        above = None
        for n in range(len(rows), least - 1, -1):
            only = some[n] if above is None else some[n] & ~above
            above, words = some[n], np.flatnonzero(only)
            place = np.flatnonzero(np.unpackbits(only[words].view(np.uint8), bitorder="little"))
            yield n, ((words[place >> 6] << 6) + (place & 63)).astype(np.int32)

    def _met(self, found: list[tuple[np.ndarray, str]], least: int, limit: int, fitting: Callable, cut: bool) -> tuple[np.ndarray, np.ndarray]:
        """Records that fit and share ``least`` terms, and how many; all that share as many as the last of the best."""
        sums, most = np.cumsum([len(p) for p, _ in found]), STEP
        frequent = 0 if cut else sum(DENSE * len(p) > self.size for p, _ in found)  # the last ones
        while True:
            n = min(max(1, int(np.searchsorted(sums, most, "right"))), len(found) - least + 1)
            if frequent:
                n = min(n, len(found) - frequent)
            at, shared = _merged([p for p, _ in found[:n]]) if n else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            for _, word in found[n:]:
                shared = shared + self.holds(0, word, at)
            met, rest = at, found[n:]
            at, shared = fitting(at, shared)
            last = self.last(at, shared, limit)
            # a record that was not met shares the rest at most
            if len(rest) < max(least, last):
                return at, shared
            if last == len(rest) > frequent:  # ties with the last: only records that hold all of the rest
                more = rest[0][0]
                for _, word in rest[1:]:
                    more = more[self.holds(0, word, more)]
                more = np.setdiff1d(more, met, assume_unique=True)
                more, all_ = fitting(more, np.full(len(more), len(rest)))
                return np.concatenate([at, more]), np.concatenate([shared, all_])
            if len(rest) == frequent:
                break
            most = max(4 * most, int(sums[n]))
        for level, more in self.levels([self.bits(0, word) for _, word in rest], max(least, last)):
            if len(met) and len(more):
                more = more[met[np.minimum(np.searchsorted(met, more), len(met) - 1)] != more]
            more, all_ = fitting(more, np.full(len(more), level))
            if len(more):
                at, shared = np.concatenate([at, more]), np.concatenate([shared, all_])
                last = self.last(at, shared, limit)
            if last >= level:
                break
        return at, shared

    def best(self, source: str, year: int | None, names: list[str] | None, wanted: str | None, terms: list[str], limit: int, least: int) -> list[tuple]:
        """(source_id, shared, friends, apart) of the best records that share ``least`` terms at least, each id once."""
        least, names = max(least, 1), names or []
        dated = source in ("openalex", "pubmed") and year is not None
        # what no year or name decides about is the same for titles of the same words
        known = None if dated or source in ("pubmed", "arxiv") else (*terms, limit, least)
        if known is None or known != self.known[0]:
            found = [(p, w) for p, w in ((self.posting(0, w), w) for w in terms) if p is not None]
            if dated:
                own = np.searchsorted(self.years, (year, year + 1))
                cuts = [(p, w, np.searchsorted(p, own)) for p, w in found]
                found = [(p[a:b], w) for p, w, (a, b) in cuts if a < b]
            if len(found) < least:
                return []
            found.sort(key=lambda x: len(x[0]))

            def fitting(at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                fits = shared >= least
                if source == "pubmed" and names:
                    fits &= self.holds(1, names[0], at)
                if source == "arxiv":
                    fits &= self.friends(names[:2], at) == len(names[:2])
                    fits[fits] = [wanted in (self.phrases[i] or "") for i in at[fits]]
                return at[fits], shared[fits]

            at, shared = self._met(found, least, limit, fitting, dated)
            few = shared >= self.last(at, shared, limit)
            at, shared = at[few], shared[few]
            self.known = known, at, shared
        else:
            _, at, shared = self.known
        if not len(at):
            return []
        friends = self.friends(names, at) if source == "crossref" else np.zeros(len(at), np.int64)
        apart = np.full(len(at), UNDATED) if year is None else np.where(at < self.undated, UNDATED, np.abs(self.years[at] - year))
        if len(at) > 8 * limit and not self.repeated:  # only those that are no worse than the last of the best are put in order
            worse = (-shared << 40) - (friends << 36) + apart
            last = np.partition(worse, limit - 1)[limit - 1]
            near = np.flatnonzero(worse <= last)
            if len(near) > 8 * limit:  # of ties with the last, those of the least ids
                ties = near[worse[near] == last]
                ties = ties[np.argpartition(self.place[at[ties]], limit - 1)[:limit]]
                near = np.concatenate([near[worse[near] < last], ties])
            at, shared, friends, apart = at[near], shared[near], friends[near], apart[near]
        out: dict[int, tuple] = {}
        for i in np.lexsort((self.place[at], apart, -friends, -shared)):
            place = int(self.place[at[i]])
            if place not in out:
                out[place] = (self.ids[int(at[i])].as_py(), int(shared[i]), int(friends[i]), int(apart[i]))
                if len(out) == limit:
                    break
        return [*out.values()]


ASKED = ["source", "year", "names", "wanted", "terms", "limit", "least"]
HITS = "doc_id long, ref_idx int, source string, source_id string, shared int, friends int, apart int"


def _visited(visits: DataFrame, index: DataFrame) -> DataFrame:
    """The best of each visit (doc_id, ref_idx, range and ``ASKED``) to a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, names, at = None, HITS_NAMES, None
        for batch in batches:
            found = []
            places = batch.column("deal").to_pylist()
            is_index = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            titles = [*zip(*(batch.column(c).filter(pa.array(~is_index)).to_pylist() for c in (*KEY, *ASKED)))]
            for k, row in zip(np.cumsum(~is_index) - 1, range(batch.num_rows)):
                if is_index[row]:
                    here, at = Range(batch, row), places[row]
                    continue
                if here is None or at != places[row]:
                    raise ValueError("a title came to a range without its index")
                doc_id, ref_idx, *asked = titles[k]
                found += [(doc_id, ref_idx, asked[0], *hit) for hit in here.best(*asked)]
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, HITS_TYPES)], names=names)

    visits = kept(visits, "title-visits")
    share = min(VISITS, max(LEAST_VISITS, -(-visits.count() // SHARES)))
    counts = visits.groupBy("range").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    before = F.sum("salts").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    salts = measured(kept(counts.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")), "title-salts"))
    deals = salts.agg(F.max(F.col("first") + F.col("salts"))).first()[0] or 1
    asks = visits.join(salts, "range").withColumn("deal", (F.col("first") + F.pmod(F.xxhash64("terms", "year"), "salts")).cast("int")).select(*KEY, *ASKED, "deal")
    held = index.withColumnRenamed("terms", "index_terms").withColumnRenamed("names", "index_names").join(salts, "range")
    held = held.withColumn("deal", F.explode(F.sequence("first", F.col("first") + F.col("salts") - 1))).drop("range", "first", "salts")
    rows = held.unionByName(asks, allowMissingColumns=True)
    rows = rows.repartitionById(deals, "deal").sortWithinPartitions("deal", F.col("ids").isNull(), F.xxhash64("terms"))
    return rows.mapInArrow(run, HITS)


HITS_NAMES = [part.split(" ", 1)[0] for part in HITS.split(", ")]
HITS_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]


def _placed(hits: DataFrame) -> DataFrame:
    """The best of each title in each source, with their place; an id that was met more than once counts once."""
    order = [F.desc("shared"), F.desc("friends"), "apart", "source_id"]
    once = F.row_number().over(Window.partitionBy(*KEY, "source", "source_id").orderBy(*order[:3])) == 1
    place = F.row_number().over(Window.partitionBy(*KEY, "source").orderBy(*order))
    return hits.withColumn("once", once).where("once").drop("once").withColumn("place", place)


def asked_titles(refs: DataFrame, ranges: DataFrame, per_source: int) -> DataFrame:
    """One row for each title and source that knows a term of it: ``ASKED``, common (how many terms are common) and
    rare (array of (range, n): ranges with so many of its rare terms)."""
    refs = refs.where(~t.missing(F.col("title")))
    terms = F.array_distinct(t.title_tokens(F.col("title")))
    refs = refs.select(*KEY, F.col("year").cast("int").alias("year"), F.slice(t.surnames(F.col("authors")), 1, 3).alias("names"), t.normalize_title(F.col("title")).alias("wanted"), t.missing(F.col("arxiv_id")).alias("no_arxiv"), terms.alias("terms"))
    with last_stays():
        refs = kept(refs, "titles")
        met = refs.select(*KEY, F.explode("terms").alias("term")).join(ranges, "term")
        met = met.groupBy(*KEY, "source").agg(F.sum(F.col("ranges").isNull().cast("int")).cast("int").alias("common"), F.flatten(F.collect_list("ranges")).alias("ranges"))
        times = lambda r: F.size(F.filter("ranges", lambda x: x == r))
        rare = F.transform(F.array_distinct("ranges"), lambda r: F.struct(r.alias("range"), times(r).alias("n")))
        rows = met.withColumn("rare", rare).drop("ranges").join(dealt(refs), KEY)
        # a phrase that holds the title has all of its words as terms but for the first and the last
        words = F.split("wanted", " ")
        inner = F.size(F.array_intersect("terms", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))))
        rows = rows.where((F.col("source") != "arxiv") | F.col("no_arxiv"))
        limit = F.when(F.col("source") == "scholarly", F.least(F.lit(3), F.lit(per_source))).otherwise(per_source)
        least = F.greatest(F.when(F.col("source") == "arxiv", inner).otherwise(1), F.lit(1))
        # only what a source asks for travels
        used = {"names": F.when(F.col("source").isin("crossref", "pubmed", "arxiv"), F.col("names")), "wanted": F.when(F.col("source") == "arxiv", F.col("wanted"))}
        rows = rows.withColumns(used | {"limit": limit.cast("int"), "least": least.cast("int")})
        return kept(rows.drop("no_arxiv"), "asked")


def _reaches(bound: Column, friends: Column, apart: Column) -> Column:
    """Could a record so bounded take the place of the last of the best (all that tie in full may, by their ids)?"""
    last = F.struct("last.shared", "last.friends", (-F.col("last.apart")).alias("near"))
    return (bound >= F.col("least")) & (F.col("last").isNull() | (F.struct(bound.alias("shared"), friends.alias("friends"), (-apart).alias("near")) >= last))


def search(refs: DataFrame, works: DataFrame, per_source: int = 5) -> DataFrame:
    """doc_id, ref_idx, source, source_id, shared, friends, apart, place: up to ``per_source`` records of each source for each
    title (doc_id, ref_idx, title, authors, year, arxiv_id), by terms shared, then common surnames (CrossRef), years
    apart and id, under the source's own conditions. Titles without a known term, null ids and empty tables have no rows."""
    index = build_index(works)
    asked = asked_titles(refs, term_ranges(index), per_source)
    spans = measured(kept(index.select("source", "range", "low", "high"), "title-ranges"), SPANS)
    near = F.when(F.col("year").between(F.col("low"), F.col("high")), 0).otherwise(F.least(F.abs(F.col("year") - F.col("low")), F.abs(F.col("year") - F.col("high"))))
    apart = F.least(F.coalesce(near, F.lit(UNDATED)), F.lit(UNDATED)).cast("int")
    friends = F.when(F.col("source") == "crossref", F.size("names")).otherwise(0)
    dated = F.col("source").isin("openalex", "pubmed") & F.col("year").isNotNull()
    allowed = ~dated | F.coalesce(F.col("year").between(F.col("low"), F.col("high")), F.lit(False))

    by_range = asked.select(*KEY, "source", "year", "common", "least", F.explode("rare").alias("r")).select("*", "r.range", "r.n").drop("r")
    by_range = by_range.join(spans, ["source", "range"]).where(allowed & (F.col("common") + F.col("n") >= F.col("least")))
    nth = F.row_number().over(Window.partitionBy(*KEY, "source").orderBy(F.desc("n"), apart, "range"))
    named = kept(by_range.withColumn("nth", nth).select(*KEY, "source", "range", "n", "nth"), "title-named")
    details = dealt(asked.select(*KEY, *ASKED))
    with last_stays():
        hits = kept(_visited(named.where(F.col("nth") <= FIRST).select(*KEY, "source", "range").join(details, [*KEY, "source"]), index), "title-hits")

    # where each source has few ranges, all that hold a term were visited
    if (spans.groupBy("source").count().agg(F.max("count")).first()[0] or 0) > min(FIRST, RARE):
        last = _placed(hits).join(dealt(asked.select(*KEY, "source", "limit")), [*KEY, "source"]).where(F.col("place") == F.col("limit"))
        last = last.select(*KEY, "source", F.struct("shared", "friends", "apart").alias("last"))
        open_ = kept(asked.join(dealt(last), [*KEY, "source"], "left"), "title-open")
        bounds = [*KEY, "source", "year", "names", "common", "least", "last"]
        more = named.where(F.col("nth") > FIRST).join(dealt(open_.select(*bounds)), [*KEY, "source"]).join(spans, ["source", "range"])
        more = more.where(_reaches(F.col("common") + F.col("n"), friends, apart)).select(*KEY, "source", "range")
        # ranges without rare terms: only for titles whose common terms could do alone
        alone = open_.select(*bounds).where(_reaches(F.col("common"), friends, F.lit(0))).join(spans, "source")
        alone = alone.where(allowed & _reaches(F.col("common"), friends, apart)).select(*KEY, "source", "range")
        more = more.unionByName(alone.join(named.select(*KEY, "range"), [*KEY, "range"], "left_anti"))
        raised = open_.select(*KEY, *(c for c in ASKED if c != "least"), F.greatest("least", F.coalesce("last.shared", F.lit(1))).alias("least"))
        with last_stays():
            hits = hits.unionByName(kept(_visited(more.join(dealt(raised), [*KEY, "source"]), index), "title-hits"))
    found = _placed(hits).join(dealt(asked.select(*KEY, "source", "limit")), [*KEY, "source"])
    return found.where(F.col("place") <= F.col("limit")).drop("limit")
