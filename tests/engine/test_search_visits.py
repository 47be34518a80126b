"""Visits of the title search: bits of frequent words, words that are added up once, and no second round without need."""

import random

import numpy as np
import pytest

from citeloom.operators import linkage, titles
from test_engine import brute_search, refs_of, works_of


def made_tables(seed: int):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    title = lambda: " ".join(words[int(30 * r.random() ** 2)] for _ in range(r.randint(1, 9)))
    works = [{"source": r.choice(["crossref", "openalex", "semantic_scholar"]), "title": title(), "year": r.randint(1998, 2003), "authors": []} for _ in range(500)]
    refs = [{"title": title(), "year": r.choice([None, 2000, 2001]), "authors": [], "ref_idx": i + 1} for i in range(50)]
    return refs, works


@pytest.mark.parametrize("dense,step", [(1, 1), (6, 1), (6, 200), (10**9, 1)])
def test_frequent_words_as_bits_change_nothing(spark, monkeypatch, dense, step):
    for name, value in (("DENSE", dense), ("STEP", step), ("LEAST_VISITS", 3)):
        monkeypatch.setattr(titles, name, value)
    refs, works = made_tables(dense)
    made, kept = [], titles.kept
    monkeypatch.setattr(titles, "kept", lambda df, name: made.append(name) or kept(df, name))
    got = linkage.title_search(refs_of(spark, *refs), works_of(spark, *works)).select("ref_idx", "w.source", "w.source_id", "shared")
    assert {tuple(x) for x in got.collect()} == brute_search(refs, works)
    assert "title-open" not in made  # each source is one range


def test_levels_count_the_rows_that_hold_a_record():
    r = np.random.default_rng(4)
    held = r.random((5, 200)) < 0.4
    rows = [np.packbits(np.append(x, np.zeros(56, bool)), bitorder="little").view(np.uint64) for x in held]
    for least in range(1, 6):
        got = {n: at.tolist() for n, at in titles.Range.levels(None, rows, least)}
        assert got == {n: np.flatnonzero(held.sum(0) == n).tolist() for n in range(least, 6)}


def test_titles_of_the_same_words_are_added_up_once(spark, monkeypatch):
    works = works_of(spark, *({"source": "crossref", "title": f"plain thing own{i}", "year": 1990 + i % 9, "authors": []} for i in range(99)))
    (batch,) = titles.build_index(works).withColumnsRenamed({"terms": "index_terms", "names": "index_names"}).toArrow().to_batches()
    here, added = titles.Range(batch, 0), []
    met = here._met
    monkeypatch.setattr(here, "_met", lambda *a: added.append(a) or met(*a))
    best = [here.best("crossref", year, [], None, ["plain", "thing"], 5, 1) for year in (1990, 1998, None, 1990)]
    assert len(added) == 1 and best[0] == best[3] and {x[3] for x in best[0]} == {0} and {x[3] for x in best[2]} == {titles.UNDATED}
    here.best("crossref", 1990, [], None, ["thing", "own3"], 5, 1)
    assert len(added) == 2


def test_of_many_ties_only_the_last_places_are_put_in_order(spark, monkeypatch):
    works = works_of(spark, *({"source": "crossref", "title": "that" if i % 3 else "that own", "year": 2000, "authors": []} for i in range(400)))
    (batch,) = titles.build_index(works).withColumnsRenamed({"terms": "index_terms", "names": "index_names"}).toArrow().to_batches()
    here, sorted_, lexsort = titles.Range(batch, 0), [], np.lexsort
    monkeypatch.setattr(titles.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    ids = sorted((-(i % 3 == 0), f"crossref-{i}") for i in range(400))
    assert [(x[0], x[1]) for x in here.best("crossref", None, [], None, ["that", "own"], 5, 1)] == [(i, 2) for _, i in ids[:5]]
    assert [x[0] for x in here.best("crossref", None, [], None, ["that"], 5, 1)] == sorted(i for _, i in ids)[:5]
    assert max(sorted_) <= 10
