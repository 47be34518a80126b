"""What the lengths of titles save: likeness to the best record only where it can decide."""

import random

from pyspark.sql import functions as F

from citeloom.functions import similarity as sim
from citeloom.operators import linkage
from test_engine import refs_of, works_of


def test_ratio_where_asked_and_able(spark):
    r = random.Random(8)
    words = ["alpha", "alpah", "beta", "bet", "gamma", "a", "delta epsilon", "é"]
    side = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 5))).split()
    df = spark.createDataFrame([(i, side(), side()) for i in range(400)], "i int, a array<string>, b array<string>")
    rows = sim.with_ratio(df, "ratio", F.col("a"), F.col("b"))
    rows = sim.with_ratio(rows, "some", F.col("a"), F.col("b"), F.when(F.col("i") % 4 < 2, F.col("i") % 4 == 0), 60.0).collect()
    assert all(x.some == x.ratio for x in rows if x.i % 4 == 0 and (x.some is not None or x.ratio >= 60))
    assert all(x.some is None for x in rows if x.i % 4)
    left_out = [x for x in rows if x.i % 4 == 0 and x.some is None]
    assert left_out and all(x.ratio < 60 for x in left_out)
    assert any(x.some is not None and x.some < 60 for x in rows)


def test_corroborators_as_if_every_title_were_compared(spark):
    r = random.Random(5)
    some = ["alpha", "beta", "gamma", "delta", "alphas", "betas", "gama"]
    title = lambda: " ".join(r.choice(some) for _ in range(r.randint(0, 4)))
    people = lambda: [(r.choice(["Ash", "Bee", "Cole"]), "A", "") for _ in range(r.randint(0, 2))]
    record = lambda i: {"source": r.choice(["crossref", "openalex", "pubmed"]), "source_id": f"x{i}", "source_url": r.choice(["u", "v", f"w{i}"]), "title": title(), "year": r.choice([None, 2000, 2001, 2005]), "doi": r.choice(["", "10.1234/a", "10.1234/b"]), "authors": people()}
    works = works_of(spark, *(record(i) for i in range(60)))
    refs = refs_of(spark, *({"ref_idx": i, "title": title(), "year": r.choice([None, 2000, 2002]), "doi": r.choice(["", "10.1234/a"]), "authors": people()} for i in range(40)))
    # 60 records are candidates of 40 references, as few of them are pairs that a search would bring together
    ranked = linkage.scored(refs, refs.select("doc_id", "ref_idx").crossJoin(linkage._work(works)))
    rows = sim.with_title_ratio(linkage.corroboration(ranked), "full", F.col("best.title"), F.col("w.title"))
    rows = rows.withColumn("common", sim.surname_overlap(F.col("best.authors"), F.col("w.authors"))).collect()
    expected = {}
    for x in sorted(rows, key=lambda x: x.place):
        near = x.best.year is None or x.w.year is None or abs(x.best.year - x.w.year) <= 1
        same = (x.best.doi and x.best.doi == x.w.doi) or x.common >= 0.5 or not x.best.authors or not x.w.authors
        if x.place > 1 and x.w.title and near and same and x.full >= 88:
            expected.setdefault((x.ref_idx, x.w.source, x.w.source_url), x.w.source_id)
    got = {(x.ref_idx, x.w.source, x.w.source_url): x.w.source_id for x in rows if x.corroborates}
    assert got == expected and len(got) == sum(x.corroborates for x in rows) > 50
    assert any(x.likeness is None for x in rows)
