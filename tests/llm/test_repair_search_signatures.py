"""Conversation repair, ranked search and MinHash near-dedup against brute force on small inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from citeloom.llm import conversation_repair as repair
from citeloom.llm import jaccard_join, minhash_hamming, queries, wavelet_search

SPACE = " \t\n\x0b\x0c\r"


def compared(query, sql, tables):
    """Rows of the Spark result and of the SQL over the same frames."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.execute(sql).df()
    got = query.toPandas()[list(want.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, (float, np.integer)) else v
    rows = lambda df: Counter(tuple(plain(v) for v in r) for r in df.astype(object).values.tolist())
    return rows(got), rows(want)


# ---- 11
def cheapest_edits(turns):
    """Least (cost, audit) over all edit sequences with at most two inserts in a row."""
    best = None

    def go(i, cost, audit, state, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and state in "^a" and (best is None or (cost, audit) < best):
            best = (cost, audit)
        follows = "us" if state == "^" else "u" if state in "sa" else "a"
        if inserted < 2:
            go(i, cost + 2, audit + "I", "u" if "u" in follows else "a", inserted + 1)
        if i < len(turns):
            initial, fault = turns[i]
            go(i + 1, cost + 3, audit + "D", state, 0)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                cut = fault == repair.TRUNCATED
                if initial and initial in follows:
                    go(i + 1, cost + cut, audit + "K", initial, 0)
                go(i + 1, cost + 2 + cut, audit + "R", "u" if "u" in follows else "a", 0)

    go(0, 0, "", "^", 0)
    return best


def test_matrices_against_all_edit_sequences():
    r = random.Random(1)
    for _ in range(400):
        turns = [(r.choice(["s", "u", "a", "u", "x", " ", ""]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(1, 5))]
        whole = repair.reduce_tree([repair.turn_matrix(*t) for t in turns])
        assert repair.cheapest(whole) == cheapest_edits(turns)


def test_products_in_any_grouping():
    r = random.Random(2)
    for _ in range(100):
        m = [repair.turn_matrix(r.choice("sua"), r.choice([0, 1, 3])) for _ in range(5)]
        left = m[0]
        for x in m[1:]:
            left = repair.product(left, x)
        assert left == repair.reduce_tree(m) == repair.product(repair.product(m[0], m[1]), repair.product(m[2], repair.product(m[3], m[4])))


def made_up_turns(r, n, convs, texts):
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "usr"]
    rows = [(r.choice(convs), r.choice([None, *range(12)]), r.choice(roles), r.choice(texts)) for _ in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("chunk,fan", [(1024, 32), (3, 2)])
def test_repair_against_sql(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "FAN", fan)
    r = random.Random(3)
    texts = [None, "", " \t", "Hi.", "x", "Ok! \n", "yes?", "ü", "a.b", *(f"t {k}." for k in range(40))]
    turns = made_up_turns(r, 300, [None, *range(60)], texts) + made_up_turns(r, 150, [900, 901], texts)
    frame = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, rows string")
    got, want = compared(repair.repair_damaged(rows.repartition(5)), queries.OP11_SQL, {"conversations": frame})
    assert got == want


def test_repair_of_a_long_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 50)
    monkeypatch.setattr(repair, "FAN", 3)
    r = random.Random(4)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), f"{r.randint(0, 1500)}" + r.choice([".", ""])) for t in range(3000) if r.random() < 0.9]
    conversations, turns = repair.repair(spark.createDataFrame(r.sample(rows, len(rows)), "conv_id long, turn long, role string, text string"))
    assert turns.count() > 40
    seen, edits = set(), []
    for _, _, role, text in rows:
        edits.append((role[0], repair.DUPLICATE if (role, text) in seen else repair.NONE if text[-1] == "." else repair.TRUNCATED))
        seen.add((role, text))
    (row,) = conversations.collect()
    cost, audit = repair.cheapest(repair.reduce_tree([repair.turn_matrix(*e) for e in edits]))
    assert (row.cost, row.audit) == (cost, audit)
    left = [f"{a}:{b}" for a, b in zip(*repair.replay(audit, repair.START, [x[2] for x in rows], [x[3] for x in rows]))]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left))
    assert repair.digests(turns).first().sha256 == hashlib.sha256("\n".join(left).encode()).hexdigest()


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair_damaged(spark.createDataFrame([], schema)).collect() == []
    dropped = next(t for t in itertools.count() if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = repair.repair_damaged(spark.createDataFrame([(1, dropped, "user", "Hi.")], schema)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---- 12
def ranked(docs, items, k):
    """item -> (score, doc) in order, by scoring every document."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    N, L = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(words(text))
    out = {}
    for item, terms in asked.items():
        scored = []
        for i, bag in bags:
            m = 75 + (25 * bag.total() * N) // L
            scored.append((-sum(c * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, c in terms.items() if t in bag), i))
        out[item] = [(-s, i) for s, i in sorted(scored) if s < 0][:k]
    return out


@pytest.mark.parametrize("docs_a_shard,opened,block", [(2048, 512, 8 << 20), (17, 3, 40)])
def test_search_is_exact(spark, monkeypatch, docs_a_shard, opened, block):
    for name, value in (("SHARD_DOCS", docs_a_shard), ("OPENED", opened), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(wavelet_search, name, value)
    r = random.Random(6)
    words = ["a", "the", "ÜB", "Zx", "9", "é", "x1", "q", "w", "e", "r", "tt"]
    texts = [None, "", " ..!\x01", "\x01a\x01b", "a " * 3000] + [" ".join(r.choices(words, k=r.choice([1, 3, 20, 60]))) for _ in range(150)]
    docs = list(enumerate(texts * 2)) + [(3, "the the x1")] * 3
    items = [(i, r.choice([None, "", "..", "zzz", *(" ".join(r.choices(words, k=5)) for _ in range(9))])) for i in range(30)] + [(0, "tt the"), (None, "a")]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, rank string, score string").repartition(3)
    found = wavelet_search.rank_documents(rows, spark.createDataFrame(items, "item_id long, text string"), 7).collect()
    want = ranked(docs, [x for x in items if x[0] is not None], 7)
    got = defaultdict(list)
    for row in sorted(found, key=lambda x: (x.item_id, x.rank)):
        got[row.item_id].append((row.score, row.doc_id))
        assert row.rank == len(got[row.item_id])
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_search_of_empty_tables_and_null_ids(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    some = spark.createDataFrame([(None, "b a"), (4, "b a"), (5, "c"), (6, "d")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "A")], "item_id long, text string")
    assert wavelet_search.rank_documents(docs, asked).collect() == wavelet_search.rank_documents(some, items).collect() == []
    assert [(x.rank, x.doc_id) for x in sorted(wavelet_search.rank_documents(some, asked).collect())] == [(1, None), (2, 4)]


def test_best_first_opens_few_nodes():
    """With skewed impacts a search meets a part of the tree only, and its bounds never fall short of a score below."""
    r = np.random.default_rng(1)
    n, terms = 2000, 4
    number = np.concatenate([np.sort(r.choice(n, 1500, replace=False)) for _ in range(terms)])
    term, impact = np.repeat(np.arange(terms), 1500), (1e6 / r.zipf(1.6, 1500 * terms)).astype(np.int64) + 1
    shard = wavelet_search.Shard.unpack(*wavelet_search.Shard.pack(np.arange(n) * 3, number, term, impact, [b"%d" % k for k in range(terms)]))
    weights = np.array([5, 1, 900, 40])
    scores, docs = shard.best(shard.starts[:-1], shard.starts[1:], weights, 20)
    dense = np.zeros(n, np.int64)
    np.add.at(dense, number, impact * weights[term])
    order = np.lexsort((np.arange(n), -dense))[:20]
    assert sorted(zip(-scores, docs)) == sorted(zip(-dense[order], order * 3))


def test_impacts_beyond_64_bits():
    tf, n = np.array([3]), np.array([10**9])
    assert wavelet_search.impacts(tf, n, 10**12, 10**15)[0] == 3_000_000_000 // (3000 + 12 * (75 + 25 * 10**9 * 10**12 // 10**15))


# ---- 13
def test_every_pair_within_the_distance_shares_keys():
    """Whatever symbols differ, signatures within the radius share keys of all chunks but half the radius."""
    r = np.random.default_rng(2)
    for percent in (80, 85, 95, 50):
        layout = minhash_hamming.Layout(percent)
        assert layout.chunks - layout.radius // 2 - layout.slack == minhash_hamming.NEED
        for spread in (layout.radius, layout.radius // 2, 3):
            x = r.integers(0, 1 << 16, (1, minhash_hamming.SYMBOLS)).astype(np.uint16)
            y = x.copy()
            y[0, r.choice(minhash_hamming.SYMBOLS, spread, replace=False)] += 1
            a, b = ({*minhash_hamming.chunk_keys(z, layout)[0].tolist()} for z in (x, y))
            assert len({k % 256 for k in a & b}) >= layout.chunks - spread // 2
            # the worst case: two errors in each chunk that has any
            z = x.copy()
            z[0, [c * layout.size + k for c in range(min(spread // 2, layout.chunks)) for k in (0, 1)]] += 1
            shared = a & {*minhash_hamming.chunk_keys(z, layout)[0].tolist()}
            assert len({k % 256 for k in shared}) == layout.chunks - min(spread // 2, layout.chunks)


def test_distance_is_binomial():
    r = np.random.default_rng(3)
    far = []
    for _ in range(1500):
        x = r.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = (np.frombuffer(minhash_hamming.Signature.of(v), np.uint16) for v in (x[:90], np.concatenate([x[:80], x[90:]])))
        far.append((a != b).sum())
    n = minhash_hamming.SYMBOLS
    assert abs(np.mean(far) - 0.2 * n) < 0.5 and abs(np.std(far) - (0.16 * n) ** 0.5) < 0.4 and max(far) <= minhash_hamming.Layout(80).radius


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").strip(SPACE)
        words = re.split(f"[{SPACE}]+", words) if words else []
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[x] = y
    least = {}
    for k_, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k_)] = min(i, least.get(root(k_), i))
    return Counter((i, len(s), None if i is None else least[root(k_)] if s else i) for k_, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("words,percent,bucket,hub", [(4, 80, 32, 4096), (5, 80, 3, 4), (1, 60, 8, 4096)])
def test_minhash_against_all_pairs(spark, monkeypatch, words, percent, bucket, hub):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "HUB", hub)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "Two\x0bwords")]
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 30, 120]))]
        for edits in (0, 0, 1, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(r.choice([3, 8, 30]))])) for k in range(25)]
    rows += [rows[20], rows[21], (20, "another text under an id that is there already")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, kept string, cls string").repartition(4)
    out = minhash_hamming.near_copies(df, words=words, percent=percent).collect()
    assert Counter((x.id, x.n_shingles, x.component_id) for x in out) == brute(rows, words, percent)
    assert all(x.kept == (x.id == x.component_id) for x in out)


def test_minhash_of_an_empty_table_and_low_similarity(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_hamming.near_copies(df).collect() == []
    with pytest.raises(ValueError):
        minhash_hamming.near_copies(df, percent=20)
