"""What the title search writes and sends: visits by range, and no table of nested rows through the driver."""

import random

from citeloom.operators import linkage, titles
from test_engine import refs_of, works_of


def test_a_title_visits_a_source_of_thousands_once(spark, monkeypatch):
    made, kept = [], titles.kept
    monkeypatch.setattr(titles, "kept", lambda df, name: made.append((name, kept(df, name))) or made[-1][1])
    works = [{"source": "crossref", "title": f"common plain own{i}", "year": 1990 + i % 30} for i in range(3000)]
    refs = [{"title": f"common plain own{7 * i}", "year": 2000, "ref_idx": i + 1} for i in range(40)]
    found = linkage.title_search(refs_of(spark, *refs), works_of(spark, *works))
    assert found.count() == 200
    assert sum(df.count() for name, df in made if name == "title-visits") == 40
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_stopping_early_changes_nothing(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    people = [("Chen", "A", None), ("Novak", "B", None), ("Ibsen", "C", None)]
    title = lambda: " ".join(words[int(40 * r.random() ** 3)] for _ in range(r.randint(1, 8)))
    works = [{"source": r.choice(["crossref", "openalex", "pubmed", "arxiv", "scholarly"]), "title": title(), "year": r.choice([None, 1999, 2000, 2001]), "authors": r.sample(people, r.randint(0, 3))} for _ in range(600)]
    works += [w | {"source_id": "same"} for w in works[:40]]
    refs = [{"title": title(), "year": r.choice([None, 2000, 2001]), "authors": r.sample(people, r.randint(0, 3)), "ref_idx": i + 1} for i in range(60)]
    tables = refs_of(spark, *refs), works_of(spark, *works)
    whole = sorted(map(tuple, titles.search(*tables).collect()))
    monkeypatch.setattr(titles, "STEP", 1)
    assert sorted(map(tuple, titles.search(*tables).collect())) == whole and len(whole) > 500
