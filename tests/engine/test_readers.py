"""Readers of bibliographies of any size, broken input, and compatibility folding over all code points."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from citeloom import cli
from citeloom.functions import edits as edits_of
from citeloom.functions import text as t
from citeloom.sources import bibliography, files, sinks

BIB = """%% head {
@string{n = "Nature"}
@String(long = n # " Methods")
@comment{ignored {x}}
@preamble{"x"}
@article{a1, title = DEEP, journal = n # " Methods", month = jan, year = 2001, pages={1--3}, author={Bee, Ann and C. Dee}}
@book{a2, title = "Quoted {"} here", journal = long, year=2002} @misc{a3, title={Same line}, year = 2003 }
@article{bad, title = {never closed, year = 1
@article{a4, title={After the bad}, note = unknownmacro, }
  @article{a5, title={indented}}
@article{worse, title {no equals}}
@misc(a6, title={round}, year={2006}, title={twice})
@string{n = {Nurture}}
@article{a7, journal = n, title={x @ y
z}}
""".replace("DEEP", "{" * 20 + "Deep" + "}" * 20)


def entries_of(df):
    return sorted((r.ref_idx, r.kind, r.raw_text, tuple(sorted(r.fields.items()))) for r in df.collect())


def test_bibtex_by_depth_with_macros(spark):
    docs = spark.createDataFrame([(1, BIB), (2, None), (3, ""), (4, "no entry { here @"), (5, "@string{n = 1}\n@misc{z, title = n # n}")], "doc_id long, text string")
    found, broken = bibliography.bibtex_in_texts(docs)
    rows = {(r.owner, r.ref_idx): r for r in found.collect()}
    assert sorted(rows) == [("1", i) for i in range(1, 8)] + [("5", 1)]
    one = {i: rows["1", i].fields for i in range(1, 8)}
    assert one[1]["title"] == "{" * 19 + "Deep" + "}" * 19 and one[1]["journal"] == one[2]["journal"] == "Nature Methods" and one[1]["month"] == "January"
    assert one[2]["title"] == 'Quoted {"} here' and one[4]["note"] == "unknownmacro" and one[6] == {"title": "twice", "year": "2006"}
    assert one[7] == {"journal": "Nurture", "title": "x @ y z"} and rows["5", 1].fields["title"] == "11"
    told = sorted((r.place, r.error) for r in broken.collect())
    assert [BIB[p:].split(",")[0] for p, _ in told] == ["@article{bad", "@article{worse"] and "never closed" in told[0][1] and "'='" in told[1][1]
    refs = files.from_bibtex(docs.where("doc_id = 1")).orderBy("ref_idx").collect()
    assert [r.ref_idx for r in refs] == list(range(1, 8)) and refs[0].title == "Deep" and refs[0].pages == "1-3" and [a.family for a in refs[0].authors] == ["Bee", "Dee"]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_give_what_whole_files_give(spark, tmp_path, small_splits):
    r = random.Random(2)
    more = "".join(f"@misc{{m{i}, title = {{T {i} {'x' * r.randint(0, 200)}}}, journal = n}}{r.choice(['', chr(10), ' '])}\n" for i in range(60))
    ris = "".join(f"TY  - JOUR\nTI  - Title {i} {'y' * r.randint(0, 150)}\nAU  - Roe, J.\nPY  - {1990 + i}\nER  - {r.choice(['', 'left over'])}\n{r.choice(['', chr(10)])}" for i in range(60))
    for name, text in (("a.bib", BIB + more), ("b.bib", more.lstrip("@")), ("c.bib", ""), ("d.ris", ris), ("e.ris", "\n" + ris)):
        (tmp_path / name).write_text(text)
    split, broken = bibliography.bibtex_in_files(spark, str(tmp_path), "*.bib")
    assert bibliography._pieces(spark, str(tmp_path), "\n@", "*.bib").rdd.getNumPartitions() > 50
    whole, _ = bibliography.bibtex_in_texts(spark.createDataFrame([(1, BIB + more), (2, more.lstrip("@"))], "doc_id long, text string"))
    for name, owner in (("a.bib", "1"), ("b.bib", "2")):
        assert entries_of(split.where(F.col("owner").endswith(name))) == entries_of(whole.where(F.col("owner") == owner))
    assert broken.count() == 2 and entries_of(split.where("owner LIKE '%b.bib'"))[0][0] == 1
    one = lambda df: sorted((x.ref_idx, x.title, x.year) for x in df.collect())
    want = one(files.from_ris(spark.createDataFrame([(1, ris)], "doc_id long, text string")))
    for name in ("d.ris", "e.ris"):
        assert one(files.read_ris(spark, str(tmp_path / name))) == want
    assert len(want) == 60 and [i for i, _, _ in want] == list(range(1, 61))


def test_unreadable_files_and_entries_are_told(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.PDF").write_bytes(b"not a pdf")
    (tmp_path / "in" / "a.bib").write_text("@article{bad, title = {never closed")
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in files.unreadable(spark, f"{tmp_path}/in").collect()}
    assert set(got) == {"d.PDF", "a.bib"} and "never closed" in got["a.bib"]
    (tmp_path / "c.json").write_text("{}\n")
    assert cli.main(["audit", f"{tmp_path}/in/d.PDF", "--catalog", f"crossref={tmp_path}/c.json"]) == 4
    assert cli.main(["suggest", f"{tmp_path}/in/d.PDF", "--catalog", f"crossref={tmp_path}/c.json", "--out", f"{tmp_path}/o"]) == 4
    assert "d.PDF" in capsys.readouterr().err


def test_tei_names_one_by_one(spark):
    tei = '<biblStruct><analytic><title level="a">T</title><author><persName><forename>Ann</forename><forename>M</forename><surname>Bee &amp; Co</surname></persName></author><author><persName><surname>Cee</surname></persName></author><author><persName><forename>X</forename></persName></author></analytic><ptr target="http://x.org/1"/></biblStruct>'
    rows = spark.createDataFrame([(1, 1, tei), (1, 2, "<biblStruct><note>nothing</note></biblStruct>"), (1, 3, None)], "doc_id long, ref_idx int, value string")
    (r,) = files.from_tei(rows).collect()
    assert [(a.family, a.given) for a in r.authors] == [("Bee & Co", "Ann"), ("Cee", "")] and r.url == "http://x.org/1" and r.raw_text == tei


def test_parser_records_and_options_reach_the_audit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("It holds (Smith, 2015).\nReferences\nSmith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.\n")
    doc = files.read_texts(spark, f"{tmp_path}/a.txt").first().doc_id
    (tmp_path / "p.json").write_text(json.dumps({"doc_id": doc, "ref_idx": 1, "value": '{"title":["By the parser"]}'}) + "\n")
    (tmp_path / "c.json").write_text('{"DOI":"10.1/x","title":["By the parser"],"author":[{"family":"Smith","given":"J."}],"issued":{"date-parts":[[2015]]}}\n')
    common = [f"{tmp_path}/a.txt", "--catalog", f"crossref={tmp_path}/c.json", "--parser-records", f"anystyle={tmp_path}/p.json", "--format", "ris", "bibtex", "--relaxed"]
    for parser, title in (("auto", "By the parser"), ("regex", "A study of things that matter")):
        assert cli.main(["audit", *common, "--parser", parser, "--out", f"{tmp_path}/{parser}"]) == 0
        assert spark.read.parquet(f"{tmp_path}/{parser}/results").first().parsed.title == title


def test_suggestions_leave_scholarly_records_out(spark):
    from test_engine import works_of

    works = works_of(spark, {"source": "scholarly", "title": "things that matter"}, {"source": "crossref", "title": "things that matter more"})
    claims = spark.createDataFrame([(1, 0, "Studies show things that matter.")], "doc_id long, pos int, claim string")
    sources = lambda **o: {x["source"] for x in json.loads(sinks.suggestions(claims, works, **o).first().candidates)}
    assert sources() == {"crossref"} and sources(use_scholarly=True) == {"crossref", "scholarly"}


def test_folding_of_every_code_point(spark):
    def folded(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()

    def title(x):
        x = re.sub(r"[^a-z0-9 ]+", " ", re.sub(r"<[^>]+>", " ", folded(x)))
        return " ".join(w for w in x.split() if w not in t.STOP_WORDS)

    code = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    rows = spark.range(0x110000).where("id < 55296 OR id > 57343").select(F.concat(F.lit("x"), code, F.lit("y z")).alias("x"))
    rows = rows.select("x", t.normalize_title(F.col("x")).alias("title"), t.normalize_surname(F.col("x")).alias("surname")).toPandas()
    assert len(rows) == 0x110000 - 2048
    assert all(map(str.__eq__, rows.title, map(title, rows.x)))
    assert all(map(str.__eq__, rows.surname, (re.sub("[^a-z]+", "", folded(x)) for x in rows.x)))
    some = spark.createDataFrame([("CO₂ capture in H₂O",), ("２０２０ review",), ("x²",), ("𝐀lpha ﬁne",), (None,)], "x string")
    assert [r[0] for r in some.select(t.normalize_title(F.col("x"))).collect()] == ["co2 capture h2o", "2020 review", "x2", "alpha fine", ""]


def test_layouts_hold_the_same_texts(spark, tmp_path):
    from test_engine import CITED, GREY, refs_of, works_of

    from citeloom.operators import verify

    none = spark.createDataFrame([("10.1234/test",)], "doi string"), spark.createDataFrame([], "url string, resolves boolean")
    results = verify.audit(refs_of(spark, CITED, GREY), works_of(spark, {"source": "crossref"}), *none)
    folders = sinks.write_all(results, "apa", f"{tmp_path}/f", ["ris"])
    table = sinks.write_all(results, "apa", f"{tmp_path}/t", ["ris"], layout="table")
    rows = [r.value for r in spark.read.parquet(table["ris"]).orderBy("doc_id", "ref_idx").collect()]
    assert "\n".join(rows).split() == " ".join(r.value for r in spark.read.text(folders["ris"], wholetext=True).collect()).split() and len(rows) == 2
    with pytest.raises(ValueError):
        sinks.write_all(results, "apa", f"{tmp_path}/x", layout="odd")


def test_edit_scripts_give_both_texts():
    from citeloom.functions.edits import script

    r = random.Random(4)
    word = lambda: r.choice(["a", "bb", "c,", "d.", "é", " ", "  ", "(2)", "J"])

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(word() for _ in range(r.randint(0, 14))) for _ in range(2))
        got = script(a, b)
        assert "".join(x for op, x in got if op != "insert") == a and "".join(x for op, x in got if op != "delete") == b
        assert all(x for _, x in got) and all(p[0] != q[0] for p, q in zip(got, got[1:]))
        tokens = edits_of.TOKEN.findall
        assert sum(len(tokens(x)) for op, x in got if op == "keep") >= common(tokens(a), tokens(b)) - 2
    assert script("Smith, J. (2014). A study.", "Smith, J. (2015). A study.") == [("keep", "Smith, J. ("), ("delete", "2014"), ("insert", "2015"), ("keep", "). A study.")]


def test_tracked_changes_by_token(spark):
    import io
    import zipfile
    from xml.etree import ElementTree

    from test_engine import CITED, refs_of, works_of

    from citeloom.operators import verify

    refs = refs_of(spark, CITED | {"year": 2011, "raw_text": "Smith, J. (2011). A Test Paper."}, CITED | {"raw_text": "Smith J, A Test Paper <b> 2020."}, {"raw_text": "Ghost", "title": "None such"})
    none = spark.createDataFrame([("10.1234/test",)], "doi string"), spark.createDataFrame([], "url string, resolves boolean")
    results = verify.audit(refs, works_of(spark, {"source": "crossref"}, {"source": "openalex"}), *none).cache()
    whole = {r.ref_idx: r for r in sinks.tracked_changes(results, "apa").collect()}
    rows = sorted(sinks.token_changes(results, "apa").collect())
    assert [r.ref_idx for r in rows] == sorted(whole) == [1, 2]
    at = 1000
    for r in rows:
        assert "".join(e.text for e in r.edits if e.op != "insert") == whole[r.ref_idx].original and "".join(e.text for e in r.edits if e.op != "delete") == whole[r.ref_idx].corrected
        assert r.rev_id == at and any(e.op == "keep" for e in r.edits)
        at += sum(e.op != "keep" for e in r.edits)
    content = sinks.docx_reports(results, "apa", by_token=True).first().content
    document = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()
    ids = [int(x) for x in re.findall(r'w:id="(\d+)"', document)]
    assert ids == list(range(1000, at))
    shown = ["".join(x.text or "" for x in p.iter() if x.tag.endswith("}t")) for p in ElementTree.fromstring(document).iter() if p.tag.endswith("}p")]
    assert shown == [whole[1].corrected, whole[2].corrected, "Ghost"]
