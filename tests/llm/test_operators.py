"""The operators against brute force on small inputs: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import cross_polytope, crf_pii, cube_mix, fm_quality, hist_pack, jaccard_join, kd_shards, line_dedup, queries, syncmers, warc_index

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, size string, shard string, spans string, copies string, key string, id string, cls string, part string"
CLASH = ("x",) * 10


def word(r):
    return "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    shared = [" ".join(word(r) for _ in range(6)) for _ in range(4)]
    base = [" ".join(word(r) for _ in range(80)) for _ in range(6)]
    out = []
    for i in range(60):
        lines = [" ".join(word(r) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))]
        lines += r.sample(shared, r.randint(0, 3))
        r.shuffle(lines)
        out.append("\n".join(lines))
    for b in base:  # near copies: some words changed
        for k in (0, 1, 1, 2, 3, 6):
            words = b.split()
            for _ in range(k):
                words[r.randrange(len(words))] = word(r)
            out.append(" ".join(words))
    out += [None, None, "", "", " \t", "one", "one", "ONE two three", "A b c d", "a B c d", "\n\n", "x" * 70_000, " ".join(["w"] * 30_000), out[0], out[0], out[0], "éßİ     d \x1c e f g h i j"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["s1", "s2", "s10", None, "é"]
    rows = [(i, t, "en" if i % 3 else None, sources[i % 5] if i % 2 else "s1", len(t) if t else None, *CLASH) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a line of more than twenty characters", None, None, None, *CLASH)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- 1
def brute_lines(rows, min_docs=3, min_chars=20):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: (k if len(k := re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))) >= min_chars else None)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held[k].append(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        own = -(1 << 63) if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) >= min_docs and own != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_line_dedup(docs, empty, limit):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = line_dedup.dedup_lines(docs, broadcast_bytes=limit)
    assert "n_dropped" in out.columns and out.columns.count("n_lines") == 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty, broadcast_bytes=limit).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (5000, 2))
    arrays = line_dedup.LineArrays.load(line_dedup.LineArrays.build(keys, np.arange(5000) + 2, np.arange(5000)).dump())
    assert sorted(arrays.hash.index(keys).tolist()) == list(range(5000))
    counts, keepers = arrays.probe(keys)
    assert (counts == np.arange(5000) + 2).all() and (keepers == np.arange(5000)).all()
    assert (arrays.probe(keys + 1)[0] == 0).all()


# ---- 2
def test_cross_polytope_recall(spark, empty):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 48))
    x[100:400] = x[100] + 0.01 * r.normal(size=(300, 48))  # a crowded bucket
    x[500:520] = x[500]  # ties
    rows = [(i, [float(v) for v in v_]) for i, v_ in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 48), (5100, [float("nan")] * 48), (5150, [None] * 48), (5200, [1.0] * 3), (None, [1.0] * 48)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    for block in (1 << 26, 40_000):
        got = defaultdict(list)
        for q in cross_polytope.nearest(df, F.col("vec_id") % 50 == 0, block_bytes=block).orderBy("query_id", "rank").collect():
            got[q.query_id].append((q.rank, q.vec_id, q.score))
        n, hit = np.sqrt((x * x).sum(1)), 0
        for q in range(0, 3000, 50):
            s = (x * x[q]).sum(1) / (n * n[q])
            s[q] = -9
            best = np.lexsort((np.arange(len(x)), -s))[:5]
            assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5]
            assert np.allclose([v for _, _, v in got[q]], s[[i for _, i, _ in got[q]]], atol=1e-12)
            hit += len({*best} & {i for _, i, _ in got[q]})
        assert set(got) == set(range(0, 3000, 50)) and hit >= 0.9 * 300
        assert [i for _, i, _ in got[500]] == [501, 502, 503, 504, 505]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cross_polytope.nearest(none, F.col("vec_id") % 50 == 0).count() == 0


def test_cross_polytope_other_lengths_scales_and_columns(spark):
    """Each length by itself; huge and tiny components; an id that repeats; clashing columns; probes in order of their sums."""
    r = np.random.default_rng(3)
    rows = [(i, [float(v) * 10.0 ** (200 * (i % 3) - 200) for v in r.normal(size=8 if i % 2 else 5)]) for i in range(40)]
    rows += [(2, rows[4][1]), (40, [1e-310, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "'x' AS v", "'x' AS query", "'x' AS key", "1 AS dim")
    got = defaultdict(list)
    for q in cross_polytope.nearest(df, F.col("vec_id") < 6).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    own = {i: min(v for j, v in rows if j == i) for i in range(6)}
    for i, v in own.items():
        unit = lambda x: np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max())
        best = sorted({(-round(float(unit(v) @ unit(w)), 9), j) for j, w in rows if j != i and len(w) == len(v)})[:5]
        assert [j for j, _ in got[i]] == [j for _, j in best] and np.allclose([s for _, s in got[i]], [-s for s, _ in best])
    hashes, x = cross_polytope.Hashes(6, 2, 1), r.normal(size=(4, 6))
    both = [np.stack([y, -y], 2).reshape(4, -1) for y in hashes.turned(x, 0)]
    keys = hashes.probes(x, 20)[:, 0]
    for row in range(4):
        total = both[0][row][:, None] + both[1][row][None]
        best = np.argsort(-total, axis=None, kind="stable")[:20]
        assert set(keys[row]) == set(hashes.key(0, [best // 16, best % 16]))
    assert (hashes.cells(x)[:, 0] == keys[:, 0]).all()


def test_cross_polytope_ranks_a_tenth(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = table.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked, n = vectors.where("id % 10 = 0"), vectors.count()
    pairs = cross_polytope.candidates(vectors, asked, {64: cross_polytope.plan_for(n, 64)}, cross_polytope.TABLES)
    assert pairs.count() <= 0.1 * n * asked.count()
    x = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in vectors.collect()}
    hit = 0
    for r in cross_polytope.nearest(table, F.col("vec_id") % 10 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        best = sorted((-float(x[r.query_id] @ v), i) for i, v in x.items() if i != r.query_id)[:5]
        hit += len({i for _, i in best} & set(r.ids))
    assert hit >= 0.9 * 5 * asked.count()


@pytest.mark.parametrize("dim", [64, 300])
def test_cross_polytope_fills_up_small_tables(spark, dim):
    r = np.random.default_rng(2)
    for n in (1, 4, 6, 8, 30):
        rows = [(i, r.normal(size=dim).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows + [rows[n - 1]] * 9, "vec_id long, embedding array<double>").coalesce(1)
        got = defaultdict(list)
        for q in cross_polytope.nearest(df, F.col("vec_id") < 4).collect():
            got[q.query_id].append(q.vec_id)
        assert all(len(got[i]) == len(set(got[i])) == min(5, n - 1) for i in range(min(4, n)))


# ---- 3
@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_packing_round_trip(docs, empty, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    pieces = [r.asDict() for r in hist_pack.pack(docs, queries.TOKENIZER, seq_len=256, broadcast_bytes=limit).collect()]
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    parts = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] <= 4 * 256
        parts[(p["doc_id"], p["start"])].append(bytes(p["ids"]))
    got = Counter()
    for (i, ids), n in want.items():
        assert all(ids[4 * s : 4 * s + 1024] in parts[(i, s)] for s in range(0, len(ids) // 4, 256))
        got[(i, ids)] = n
    assert got == want and sum(p["length"] for p in pieces) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    where = defaultdict(list)
    for p in pieces:
        where[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in where.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(where) == list(range(len(where)))
    assert hist_pack.pack(empty, queries.TOKENIZER).count() == 0


def test_packing_pads_little_and_joins_sequences(docs):
    pieces = hist_pack.pack(docs, queries.TOKENIZER, seq_len=256)
    rows = hist_pack.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    r = random.Random(2)
    histogram = Counter(min(2048, 1 + int(r.expovariate(1 / 500))) for _ in range(20_000))
    patterns = hist_pack.shortest_pack_first(histogram, 2048)
    used = Counter()
    for count, parts in patterns:
        assert sum(a * b for a, b in parts) <= 2048
        for length, times in parts:
            used[length] += count * times
    total = sum(k * v for k, v in histogram.items())
    assert used == histogram and total / (2048 * sum(c for c, _ in patterns)) > 0.98


def test_word_rule_is_bound_to_the_file():
    import json

    from tokenizers import Tokenizer

    rules = json.loads(Tokenizer.from_file(queries.TOKENIZER).to_str())
    assert hist_pack.splits_by_word(rules)
    rules["normalizer"] = None
    assert not hist_pack.splits_by_word(rules)


# ---- 4
def test_kd_shards(docs, empty, spark):
    out = kd_shards.shard_documents(docs, 4, columns=("doc_id", "text", "key")).collect()
    assert len(out) == docs.count()
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in out:
        data = (r.text or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        by_text[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards.shard_documents(empty, 4).count() == 0
    real = kd_shards.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"), 8, columns=("doc_id",))
    sizes = [r.s for r in real.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    largest = real.agg(F.max("size")).first()[0]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 3 * largest
    plan = kd_shards.shard_documents(docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_kd(points, n_shards):
    """{group: shard} of (group, bytes, coordinates): halves at the weighted median of the widest coordinate."""
    out = {}

    def split(own, lo, hi):
        if hi - lo == 1 or not own:
            out.update((g, lo) for g, _, _ in own)
            return
        widths = [max(c[i] for _, _, c in own) - min(c[i] for _, _, c in own) for i in range(len(own[0][2]))]
        axis = widths.index(max(widths))
        own = sorted(own, key=lambda p: p[2][axis])
        half = (hi - lo) // 2
        goal, done, at = sum(b for _, b, _ in own) * half / (hi - lo), 0, 0
        while at < len(own) - 1 and done + own[at][1] < goal:
            done += own[at][1]
            at += 1
        at += done + own[at][1] - goal <= goal - done
        split(own[:at], lo, lo + half)
        split(own[at:], lo + half, hi)

    split(points, 0, n_shards)
    return out


def test_kd_tree_against_brute_force(docs, spark):
    r = random.Random(8)
    rows = [(i, r.randint(1, 5000), 1, float(r.randint(0, 3)), r.random() * 100) for i in range(400)]
    groups = spark.createDataFrame(rows, "group_id long, bytes long, rows long, d0 double, d1 double")
    points = [(x.group_id, x.bytes, (x.c0, x.c1)) for x in kd_shards._spread(groups, ["d0", "d1"]).collect()]
    for n in (1, 3, 8):
        assert {x.group_id: x.shard for x in kd_shards.kd_tree(groups, ["d0", "d1"], n).collect()} == brute_kd(points, n)


def test_kd_shards_by_target_bytes(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    total, largest = table.agg(F.sum(F.octet_length("text") + 1), F.max(F.octet_length("text") + 1)).first()
    out = kd_shards.shard_documents(table, target_bytes=total // 50, columns=("doc_id",))
    sizes = [x.s for x in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) in (50, 51) and max(sizes) <= total / len(sizes) + 4 * largest
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    wide = kd_shards.shard_documents(many, target_bytes=20_000 * 65 // 200, columns=("doc_id",)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(wide) == 200 and max(x.s for x in wide) <= 1.05 * 20_000 * 65 / 200


# ---- 5
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and crf_pii.luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_base_spans():
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("a1.@-_+ (5)4é ") for _ in range(r.randint(0, 40)))
        assert crf_pii.base_spans(text) == brute_pii(text)
    assert crf_pii.base_spans("1" * 50_000 + "@" * 50_000 + "a." * 50_000) is not None
    assert not crf_pii.luhn("4425414259157785") and crf_pii.luhn("4425414259157784")


#: Lines that the field has not seen.
HELD_OUT = """
please mail {{email|nora at webhost dot net}} before noon
my new address is {{email|paul.b (at) library (dot) org}} now
{{email|sven [at] verein [dot] de}} schreibt dir
send the form to {{email|office at school dot example dot org}} soon
contact {{email|tina (at) studio.com}} today
reach me: {{email|omar [at] clinic.org}} please
write to {{email|luis at correo.es}} now
ask {{email|k.hahn at uni dot de}} about it
call {{phone|(408) 555-1834}} today
phone {{phone|702-555-9911}} at night
ring {{phone|303.555.4477}} or visit
tel. {{phone|(030) 5550 1234}} bitte
both {{phone|202-555-0101}} and {{phone|(617) 555-8822}} work
we met at the station at 9 and left at 11
chapter 7, pages 101-134 and table 5
it cost 2,450.50 euros in 2021
release 3.4.5 build 9001 of the tool
the dot on the screen is red at night
between 2001-2005 and on 2020-06-01
read more at example.org tomorrow
room 14 and room 208 at noon
see figure (2) and equation (17)
""".strip().split("\n")


def test_pii_field_held_out():
    field, found, wanted, right = crf_pii.train(), 0, 0, 0
    for text, spans in map(crf_pii.parse_labelled, HELD_OUT):
        base = crf_pii.base_spans(text)
        got = set(base) | set(crf_pii.added_spans([text], [base], field)[0])
        found, wanted, right = found + len(got), wanted + len(spans), right + len(got & set(spans))
    assert right >= 0.9 * wanted and right >= 0.9 * found, (right, wanted, found)


def test_pii_viterbi_against_enumeration():
    import itertools

    field, r = crf_pii.train(), np.random.default_rng(3)
    field.STEPS = 2  # windows that are carried on
    chains = [r.integers(1, len(field.codes) + 1, n).astype(np.int32) for n in (1, 2, 3, 4, 4)]
    move = np.where(field.allowed, field.move, -1e9)
    for chain, path in zip(chains, field.decode(chains)):
        emit = field.emit[field.features(np.pad(chain, 2)[None])[0]].sum(1)
        assert np.allclose(emit, field.scores(np.pad(chain, 2)[None])[0])

        def score(y, emit=emit):
            return field.first[y[0]] + (0 if field.start[y[0]] else -1e9) + sum(emit[i, v] for i, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))

        assert np.isclose(score(list(path)), max(score(y) for y in itertools.product(range(len(field.labels)), repeat=len(chain))))


def test_pii_scan_equals_token_by_token():
    field, r = crf_pii.train(), random.Random(5)
    parts = ["at ", "DOT", "dot", "a", "é", "É", "\u01c5", "²", "½", "1", "12", "\u0663", " ", "\n", "\x1c", ".", "(", "@", "—", "ß", "point", "Tel", "call", "0301", "😀", "_"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        at = crf_pii.tokens(text)
        codes, starts, ends = field.scan(text)
        assert list(zip(starts, ends)) == at
        assert list(codes) == [field.codes.get(x, 1) for x in crf_pii.shapes(text, at, field.cues)]


def test_pii_closed_places_are_outside():
    """Paths over the open places alone are those over all places, for fields with any weights."""
    r = np.random.default_rng(11)
    field = crf_pii.train()
    for scale in (0.3, 1.0, 3.0):
        field.emit, field.move, field.first = (r.normal(0, scale, x.shape) for x in (field.emit, field.move, field.first))
        field.emit[-1] = 0
        field.emit[:, 0] += 2 * scale
        chains = [r.integers(1, len(field.codes) + 1, n).astype(np.int32) for n in r.integers(1, 60, 60)]
        cut = field.decode(chains)
        field.open = lambda codes, token: token
        whole = field.decode(chains)
        del field.open
        assert all((a == b).all() for a, b in zip(cut, whole)) and sum((a == 0).sum() for a in cut) > 0


#: Forms without digits, "at" or "dot" near, and numbers without a plus sign or brackets.
HELD_OUT_FORMS = """
call {{phone|0171 5552671}}
tel {{phone|03012345678}}
{{email|rita at mailbox point net}}
{{email|Jane.Doe (a) example.org}}
mail {{email|hugo at werk punkt de}} bitte
you can write to {{email|nina at press point org}} if you like
ask {{email|Tom.Hill (a) sample.net}} about it
please call {{phone|0152 7788990}} today
phone {{phone|02079460000}} at night
the town was old and the river ran by it for years
el libro de la mesa es de la casa de al lado. Es todo
les enfants de la rue sont de retour. De rien
THE END OF IT ALL!! IT WAS DE FACTO OVER
one one one one one one one. two. two. two.
the point of the talk was clear to all at once
order 7781 of 2014 and part 33-1
""".strip().split("\n")


def test_pii_forms_without_a_trigger_in_whole_texts():
    field, found, wanted, right = crf_pii.train(), 0, 0, 0
    lines = [crf_pii.parse_labelled(x) for x in HELD_OUT_FORMS]
    got = crf_pii.added_spans([x for x, _ in lines], [crf_pii.base_spans(x) for x, _ in lines], field)
    for (text, spans), own in zip(lines, got):
        assert own == crf_pii.added_spans([text], [crf_pii.base_spans(text)], field)[0]
        found, wanted, right = found + len(own), wanted + len(spans), right + len(set(own) & set(spans))
    assert right >= 0.9 * wanted and right >= 0.9 * found, (right, wanted, found)
    # far from anything that looks like an address, and after parts that are scanned one by one
    text = "the river ran on and on, " * 200_000 + "call 0171 5552671"
    assert crf_pii.added_spans([text], [[]], field) == [[("phone", len(text) - 12, len(text))]]


def test_pii_long_runs(spark):
    zeros = "0" * 5_000 + "1.2.3.4"
    assert crf_pii.base_spans(zeros) == [("ip", 0, len(zeros))]
    texts = [zeros, "0123456789" * 1_000_000, "1 2-" * 20_000, "a." * 100_000 + "@" + "b." * 100_000, "1.1.1.1." * 5_000]
    out = crf_pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert out[0].base_spans == f"ip:0:{len(zeros)}" and out[1].spans == "" and out[2].base_spans == ""
    assert out[3].base_spans == f"email:0:{len(texts[3]) - 1}"


def test_pii_field_without_digits_or_dots_spelled():
    field = crf_pii.train()
    seen = lambda x: [(k, x[a:b]) for k, a, b in crf_pii.added_spans([x], [crf_pii.base_spans(x)], field)[0]]
    for own in ("kim [at] house.org", "olga (at) sample.com", "paul at market.net"):
        assert seen(f"please write to {own} today") == [("email", own)]
        assert seen(f"mail {own} for the keys") == [("email", own)]
    assert seen("the cat sat at the door. it slept") == [] and seen("we met (at) the door") == []


def test_pii_field_adds_spans(docs, empty, spark):
    field = crf_pii.train()
    seen = lambda x: [(k, x[a:b]) for k, a, b in crf_pii.added_spans([x], [crf_pii.base_spans(x)], field)[0]]
    assert seen("write me at bob at acme dot com please") == [("email", "bob at acme dot com")]
    assert seen("call (415) 555-0000 or 212-555-7777 now") == [("phone", "(415) 555-0000"), ("phone", "212-555-7777")]
    assert seen("Apache License, Version 2.0 of 2004") == [] and seen("the cat sat at the door") == []
    right = total = 0
    for line in crf_pii.LABELLED:
        text, spans = crf_pii.parse_labelled(line)
        at = crf_pii.tokens(text)
        path = field.decode([field.scan(text)[0]])[0]
        gold = ["O"] * len(at)
        for kind, a, b in spans:
            own = [i for i, (s, e) in enumerate(at) if s >= a and e <= b]
            for i in own:
                gold[i] = ("B-" if i == own[0] else "I-") + kind
        right += sum(field.labels[p] == g for p, g in zip(path, gold))
        total += len(at)
    assert right > 0.97 * total
    out = {r.doc_id: r for r in crf_pii.find_pii(docs, field=field).collect()}
    assert len(out) == docs.select("doc_id").distinct().count() and crf_pii.find_pii(empty, field=field).count() == 0
    text = "mail a.b@c.de or +1 (319) 555-5132"
    row = crf_pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), field=field).first()
    assert row.base_spans == "email:5:13,phone:17:34" and crf_pii.redact(text, row.spans) == "mail [email] or [phone]"


# ---- 6
def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, set() if not w else {tuple(w)} if len(w) < k else {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for j, (i, _) in enumerate(sets):
        if i is not None:
            least[root(j)].append(i)
    return Counter((i, len(s), None if i is None else min(least[root(j)]) if s else i) for j, (i, s) in enumerate(sets))


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 70)])
def test_jaccard_join(docs, empty, words, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = jaccard_join.near_duplicates(docs, words=words, percent=percent)
    assert Counter((r.id, r.n_shingles, r.component_id) for r in out.collect()) == brute_components(rows, words, percent)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_in_large_buckets(spark, monkeypatch):
    """A crowd of near copies of which only some are linked, with small buckets and blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    r = random.Random(9)
    base = [word(r) for _ in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            words[r.randrange(150)] = word(r)
        rows.append((i, " ".join(words[: r.randint(120, 150)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.near_duplicates(df)
    assert Counter((x.id, x.n_shingles, x.component_id) for x in out.collect()) == brute_components(rows, 4, 85)


def test_sketch_never_exceeds_the_difference():
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 900))
        k = int(r.integers(0, n + 1))
        base = r.integers(0, 1 << 63, n + k + 5, dtype=np.uint64)
        x, y = np.unique(base[:n]), np.unique(np.concatenate([base[k:n], base[n : n + int(r.integers(1, k + 6))]]))
        a, b = jaccard_join.Sketch.of(x), jaccard_join.Sketch.of(y)
        cells = min(len(a), len(b)) // 2
        assert jaccard_join.Sketch.bound(jaccard_join.Sketch.cells(a, cells), jaccard_join.Sketch.cells(b, cells)) <= len(np.setxor1d(x, y))


# ---- 7
def test_warc_round_trip(spark, tmp_path):
    long_ = "é" * 600
    rows = [(1, "http://www.a.org/x?y#z", long_), (2, "https://a.org:8080/", long_), (9, None, long_), (3, "not a url", None), (4, "", ""), (5, "http://b.org", "short"), (6, "http://b.org", "short"), (7, "http://b.org\t/\n", "x" * 3_000_000), (None, "http://c.org/", long_), (8, "http://b.org", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc_index.round_trip(pages, payloads=True).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = 9 if html == long_ and i != 9 else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (len(data), hashlib.sha1(data).hexdigest(), keeper, "revisit" if keeper else "response")
        assert r.payload is None if keeper else bytes(r.payload) == data
    assert warc_index.url_key("http://www.A.org/b?c#d") == "org,a)/b?c"
    table = warc_index.write_archives(pages)
    index = warc_index.build_index(table.where("data IS NULL"), lines_per_block=2)
    asked = spark.createDataFrame([("org,b)/", 6), ("org,zzz)/", 6)], "url_key string, page_id long")
    assert [r.page_id for r in warc_index.read_ranges(table.where("data IS NOT NULL").select("archive", "data"), warc_index.locate(asked, index)).collect()] == [6]
    assert warc_index.export_archives(table, str(tmp_path)) == len([*tmp_path.iterdir()]) > 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_index.round_trip(none).count() == 0


def test_warc_many_keepers_lookups_and_clashing_columns(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", "z" * 2_000 if i % 2 else f"{i}" * 600) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'x' AS keeper", "'x' AS payload", "1 AS salt", "'x' AS archive")
    want = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc_index.round_trip(pages).collect()}
    assert want[199][0] == "response" and want[197][:2] == ("revisit", 199) and len(want) == 200
    for name, value in (("KEEPER_BYTES", 1 << 40), ("LOOKUPS_PER_TASK", 3), ("LINES_PER_PART", 20)):
        monkeypatch.setattr(warc_index, name, value)
    assert {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc_index.round_trip(pages).collect()} == want


# ---- 8
@pytest.mark.parametrize("parts", [1, 4, None])
def test_syncmers_with_next(docs, empty, parts):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]), reverse=True)
    want = Counter()
    for (i, own), (_, more) in zip(rows, rows[1:] + rows[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + more[:half]
        a, b, c = (syncmers.fingerprint(x) for x in (own, edited, more))
        want[(i, len(own), hashlib.sha256(edited.encode()).hexdigest(), syncmers.written(a), syncmers.written(b), syncmers.likeness(a, b), syncmers.likeness(a, c))] += 1
    assert Counter(tuple(r) for r in syncmers.compare_with_next(docs, parts=parts).collect()) == want
    assert syncmers.compare_with_next(empty, parts=parts).count() == 0
    assert syncmers.fingerprint_documents(docs).columns.count("fingerprint") == 1


def test_syncmers_are_context_free():
    r = random.Random(4)
    a, b, c = (" ".join(word(r) for _ in range(300)) for _ in range(3))
    ha, hb = set(syncmers.anchors(a)[0].tolist()), set(syncmers.anchors(c + " " + a + b)[0].tolist())
    assert len(ha - hb) == 0
    hashes, at = syncmers.anchors(a)
    brute = []
    for i in range(len(a) - syncmers.K + 1):
        s, _ = syncmers.anchors(a[i : i + syncmers.K])
        brute += [i] if len(s) else []
    assert brute == at.tolist() and 0.02 < len(at) / len(a) < 0.3
    x, y = syncmers.fingerprint(a), syncmers.fingerprint("zz " + a)
    assert syncmers.likeness(x, y) > 0.9 and syncmers.aligned(x, y)[0] == 3
    assert syncmers.read(syncmers.written(x))[0].tolist() == x[0].tolist()


def test_syncmers_find_a_short_passage_in_long_texts():
    r = random.Random(8)
    passage = " ".join(word(r) for _ in range(60))
    for n in (5_000, 20_000):
        for _ in range(5):
            a, b = ([word(r) + word(r) for _ in range(n)] for _ in range(2))
            i, j = r.randrange(n), r.randrange(n)
            x, y = (syncmers.fingerprint(" ".join([*t[:k], passage, *t[k:]])) for t, k in ((a, i), (b, j)))
            shift = len(" ".join(b[:j])) + bool(j) - len(" ".join(a[:i])) - bool(i)
            got, votes = syncmers.aligned(x, y)
            assert got == shift and votes >= 10 and syncmers.likeness(x, y) > 0
            assert all((p == q).all() for p, q in zip(syncmers.read(syncmers.written(x)), x))


def test_every_text_has_an_anchor():
    """Of lengths 1 to 60: different texts are never alike by having no anchor, equal ones always are."""
    r = random.Random(12)
    for n in range(1, 61):
        some = {"".join(r.choice("abcdefgh ") for _ in range(n)) for _ in range(40)}
        prints = {x: syncmers.fingerprint(x) for x in some}
        assert all(len(p[0]) for p in prints.values())
        for x in some:
            assert syncmers.likeness(prints[x], syncmers.fingerprint(x)) == 1
            assert n < 3 or sum(syncmers.likeness(prints[x], prints[y]) == 1 for y in some) == 1


def test_closed_syncmer_rule():
    """By the definition: an s-mer hash depends on its s code points alone; a k-mer is chosen if the least of its
    k - s + 1 is at an edge; an anchor's hash depends on its k-mer alone."""
    r = random.Random(4)
    text = "".join(r.choice("abc dé漢\U0001F600") for _ in range(900))
    text = text + text[100:400] + "aaaa" * 30
    k, s = syncmers.K, syncmers.S
    one = lambda x: int(syncmers.smer_hashes(np.array([ord(c) for c in x], np.uint32))[0])
    hashes = [one(text[i : i + s]) for i in range(len(text) - s + 1)]
    own, at = syncmers.anchors(text)
    windows = [hashes[i : i + k - s + 1] for i in range(len(text) - k + 1)]
    assert at.tolist() == [i for i, w in enumerate(windows) if min(w) in (w[0], w[-1])]
    seen = {}
    for h, i in zip(own.tolist(), at.tolist()):
        assert seen.setdefault(text[i : i + k], h) == h
        assert syncmers.anchors(text[i : i + k])[0].tolist() == [h]
    assert len(set(seen.values())) == len(seen)


def brute_matched(a, b):
    """Anchors of a that match one of b at the same shift as an anchor next to them does."""
    links = lambda p: {(p[0][i], p[0][i + 1], p[1][i + 1] - p[1][i]) for i in range(len(p[0]) - 1)}
    known = links(b)
    hit = [(a[0][i], a[0][i + 1], a[1][i + 1] - a[1][i]) in known for i in range(len(a[0]) - 1)]
    return sum(any(hit[max(i - 1, 0) : i + 1]) for i in range(len(a[0])))


def test_syncmers_likeness(texts):
    prints = [syncmers.fingerprint(t) for t in texts if len(t or "") < 5_000]
    for a in prints:
        assert syncmers.likeness(a, a) == 1
        for b in prints[::7]:
            if len(a[0]) > 1 and len(b[0]) > 1:
                n, m = brute_matched(a, b), brute_matched(b, a)
                assert syncmers.likeness(a, b) == (n + m) / 2 / (len(a[0]) + len(b[0]) - (n + m) / 2)
    assert syncmers.likeness(syncmers.fingerprint("one"), syncmers.fingerprint("two")) == 0


# ---- 9
def test_quality_held_out(spark, docs, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    machine = fm_quality.train(table, labels)
    out = fm_quality.score(table, machine).join(labels, "doc_id").where(fm_quality.held_out(F.col("doc_id")))
    n, right, clean, kept = out.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.sum("quality"), F.sum((F.col("predicted") * F.col("quality")))).first()
    assert right >= 0.97 * n and kept >= 0.99 * clean
    again = fm_quality.train(table, labels)
    assert np.array_equal(machine.factors, again.factors)
    own = fm_quality.score(docs, machine)
    assert own.columns.count("score") == 1 and own.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert fm_quality.score(empty, machine).count() == 0
    none = fm_quality.train(docs, labels.where("false"))
    assert {r.score for r in fm_quality.score(docs, none).collect()} == {0.5}


def test_quality_pairs_earn_over_linear(spark):
    """Labels by an interaction: linear weights alone cannot learn it."""
    r = np.random.default_rng(1)
    x = np.concatenate([np.ones((3000, 1)), r.integers(0, 2, (3000, 6))], axis=1).astype(np.float32)
    y = (x[:, 1] == x[:, 2]).astype(np.float64)
    right = [((fm_quality.fit(x[:2000], y[:2000], rank=n).score(x[2000:]) >= 0.5) == y[2000:]).mean() for n in (0, fm_quality.RANK)]
    assert right[0] < 0.65 and right[1] > 0.95


def test_quality_metadata(spark, docs):
    rows = [(i, "same words here", float(10 ** (5 * (i % 2)))) for i in range(60)] + [(60, "x", None), (61, None, float("nan"))]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    machine = fm_quality.train(table, labels, metadata=("n_chars",))
    out = {r.doc_id: r for r in fm_quality.score(table, machine).collect()}
    assert all(out[i].predicted == i % 2 for i in range(60)) and 0 <= out[60].score <= 1 and 0 <= out[61].score <= 1
    assert fm_quality.score(table, machine).columns == [*table.columns, "score", "predicted"]


def test_factorisation_machine_identity():
    r = np.random.default_rng(0)
    m = fm_quality.Machine(0.3, r.normal(size=7), r.normal(size=(7, 3)))
    x = r.normal(size=7)
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(7) for j in range(i))
    assert np.isclose(m.margin(x[None])[0], 0.3 + m.linear @ x + pairs)


# ---- 10
def test_targets():
    assert cube_mix.targets([("a", 100), ("b", 100)], [1, 3], 3) == [50, 150]
    assert np.allclose(cube_mix.targets([("a", 90), ("b", 10)], [1, 2], 3), [70, 30])
    assert cube_mix.targets([("a", 0), ("b", 0)], [1, 2], 3) == [0, 0]


def test_mix(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r.asDict() for r in cube_mix.mix_sources(table).collect()]
    assert len(out) == table.count()
    by = defaultdict(list)
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        by[r["source"]].append(r)
    names = sorted(by)
    want = cube_mix.targets([(s, sum(r["size"] for r in by[s])) for s in names], [1 + i % 3 for i in range(len(names))], 3)
    for s, goal in zip(names, want):
        assert np.isclose(by[s][0]["target"], goal) and abs(sum(r["taken"] for r in by[s]) - goal) <= 0.02 * goal
        ratio = goal / by[s][0]["source_size"]
        assert abs(sum(r["copies"] for r in by[s]) - ratio * len(by[s])) <= 3
    again = {r.doc_id: r.copies for r in cube_mix.mix_sources(table.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}
    own = cube_mix.mix_sources(docs)
    assert own.count() == docs.count() and own.columns.count("copies") == 1
    assert cube_mix.mix_sources(empty).count() == 0


# ---- pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    before, quality, lines, near, mixed, packed = frames
    assert all(f.columns == docs.columns for f in frames[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.collect()}
    assert all(i in kept for i in labels if labels[i] == 1) and sum(i in kept for i in labels if labels[i] == 0) <= 0.1 * sum(v == 0 for v in labels.values())
    want = brute_lines([(r.doc_id, r.text) for r in quality.collect()])
    assert {(r.doc_id, r.text) for r in lines.collect()} == {(i, t) for i, _, _, t in want}
    groups = brute_components([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {c for _, _, c in groups}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in near.collect()} and max(times.values()) <= 3
    assert packed.count() > 0 and packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, statement in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        columns = sorted(got.columns)
        want = con.sql(f"select {', '.join(columns)} from ({statement})").fetchall()
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want), name
