"""Tables that the audit writes on the way are gone once what was made from them is written."""

import os
import re

from citeloom import tables
from citeloom.operators import linkage, verify
from test_slim_candidates import catalogue


def left(spark) -> set[str]:
    return set(os.listdir(tables.workspace(spark).removeprefix("file:")))


def test_an_audit_leaves_its_merged_records_only(spark):
    refs, works = catalogue(spark)
    before = left(spark)
    none = spark.createDataFrame([], "doi string"), spark.createDataFrame([], "url string, resolves boolean")
    results = verify.audit(refs, works, *none)
    assert [re.sub(r"-[0-9a-f]{32}$", "", x) for x in left(spark) - before] == ["merged"]
    assert sorted(map(str, results.collect())) == sorted(map(str, results.collect())) and results.count() == 40


def test_a_search_leaves_what_it_found(spark):
    refs, works = catalogue(spark)
    before = left(spark)
    found = linkage.title_search(refs, works)
    assert [re.sub(r"-[0-9a-f]{32}$", "", x) for x in left(spark) - before] == ["title-found"]
    assert found.count() > 20


def test_tables_that_are_held_or_lasting_stay(spark):
    before = left(spark)
    with tables.last_stays():
        with tables.last_stays():
            held = tables.kept(spark.range(3), "held")
            tables.kept(spark.range(4), "gone")
            inner = tables.kept(spark.range(5), "inner")
        view = tables.kept(spark.range(6), "view", lasting=True)
        del inner
        last = tables.kept(spark.range(7), "last")
    assert sorted(x.split("-")[0] for x in left(spark) - before) == ["held", "last", "view"]
    assert (held.count(), view.count(), last.count()) == (3, 6, 7)
    del held
    assert sorted(x.split("-")[0] for x in left(spark) - before) == ["last", "view"]
