"""What linking writes and sends: candidates without their records, exchanges that go with the write that made them."""

import random

from pyspark.sql import functions as F

from citeloom import tables
from citeloom.operators import linkage, verify
from test_engine import refs_of, works_of


def catalogue(spark):
    r = random.Random(11)
    some = ["alpha", "beta", "gamma", "delta", "alphas", "betas", "gama"]
    title = lambda: " ".join(r.choice(some) for _ in range(r.randint(0, 4)))
    people = lambda: [(r.choice(["Ash", "Van Bee", "Cole", "李"]), "A", "") for _ in range(r.randint(0, 2))]
    record = lambda i: {"source": r.choice(["crossref", "openalex", "pubmed"]), "source_id": f"x{i}", "source_url": r.choice(["u", "v", f"w{i}"]), "title": title(), "year": r.choice([None, 2000, 2001, 2005]), "doi": r.choice(["", "10.1234/a", "10.1234/b", "10.65215/c"]), "volume": r.choice(["", "1", "2"]), "authors": people()}
    works = works_of(spark, *(record(i) for i in range(60)))
    return refs_of(spark, *({"ref_idx": i, "title": title(), "year": r.choice([None, 2000, 2002]), "doi": r.choice(["", "10.1234/a"]), "authors": people()} for i in range(40))), works


def test_linking_by_numbers_is_linking_with_whole_records(spark):
    refs, works = catalogue(spark)
    ranked = linkage.ranked(refs, works)
    assert ranked.schema["w"].dataType.names == ["number", *linkage.SLIM]
    whole = linkage.scored(refs, linkage.candidates(refs, works))
    places = ["doc_id", "ref_idx", "w.source", "w.source_id", "title_score", "score", "place"]
    assert sorted(map(tuple, ranked.select(*places).collect())) == sorted(map(tuple, whole.select(*places).collect()))
    by_key = lambda rows: sorted(map(str, rows.orderBy("doc_id", "ref_idx").collect()))
    expected = by_key(linkage.merged(linkage.corroboration(whole)))
    assert by_key(linkage.linked(refs, works)) == expected and len(expected) > 20
    assert any("corroborating=[Row" in x for x in expected)


def test_no_written_table_of_candidates_holds_records(spark, monkeypatch):
    refs, works = catalogue(spark)
    made, kept = {}, tables.kept
    for module in (linkage, verify):
        monkeypatch.setattr(module, "kept", lambda df, name: made.setdefault(name, kept(df, name)))
    verify.audit(refs, works, spark.createDataFrame([], "doi string"), spark.createDataFrame([], "url string, resolves boolean")).collect()
    fields = {name: df.schema.simpleString() for name, df in made.items()}
    assert "authors" in fields["merged"] and "authors" in fields["records"]
    assert not [name for name, x in fields.items() if "authors" in x and name not in ("merged", "records")]


def test_exchanges_go_with_the_write(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before, setting = files(), spark.conf.get(tables.CLEANUP, None)
    rows = tables.kept(spark.range(1000, numPartitions=3).repartition(4, F.col("id") % 7), "rows")
    assert not files() - before
    assert rows.count() == 1000 and spark.conf.get(tables.CLEANUP, None) == setting
