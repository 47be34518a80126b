"""The citation engine: hand-made cases, readers and sinks, and the registered queries against their SQL."""

import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom import cli
from citeloom.functions import similarity as sim
from citeloom.functions import styles
from citeloom.functions import text as t
from citeloom.operators import entries, intext, linkage, verify
from citeloom.operators import titles as titles_of
from citeloom.plans import registry
from citeloom.schema import REFS, WORKS
from citeloom.sources import access, catalog, files, sinks

SF = "/root/testdata/sf0.001"
EMPTY_REF = dict.fromkeys(["raw_text", "title", "container_title", "volume", "issue", "pages", "publisher", "doi", "url", "arxiv_id", "pmid", "isbn"], "") | {"authors": [], "year": None, "type": "unknown"}
PAPER = {"authors": [("Smith", "John", None)], "title": "A Test Paper", "year": 2020, "container_title": "Journal of Testing", "volume": "1", "issue": "2", "pages": "3-4", "publisher": "", "doi": "10.1234/test", "arxiv_id": "", "pmid": "", "type": "journal-article"}


def refs_of(spark, *cases):
    names = [x.strip().split(" ")[0] for x in REFS.replace("struct<family:string,given:string,orcid:string>", "s").split(",")]
    return spark.createDataFrame([tuple(({"doc_id": 1, "ref_idx": i + 1} | EMPTY_REF | c)[n] for n in names) for i, c in enumerate(cases)], REFS)


def works_of(spark, *records):
    names = [x.strip().split(" ")[0] for x in WORKS.replace("struct<family:string,given:string,orcid:string>", "s").split(",")]
    return spark.createDataFrame([tuple(({"source_id": f"{r['source']}-{i}", "source_url": f"https://x/{i}"} | PAPER | r)[n] for n in names) for i, r in enumerate(records)], WORKS)


def audited(spark, refs, works, dois=("10.1234/test",), urls=(), **options):
    d = spark.createDataFrame([(x,) for x in dois], "doi string")
    u = spark.createDataFrame(list(urls), "url string, resolves boolean")
    return {r.ref_idx: r for r in verify.audit(refs, works, d, u, **options).collect()}


CITED = {k: v for k, v in PAPER.items() if k not in ("type",)} | {"raw_text": "Smith, J. (2020). A Test Paper."}
GREY = {"raw_text": "raw", "title": "A report of the institute", "year": 2019, "authors": [("Bureau of Justice Statistics", "", None)], "url": "https://bjs.gov/r", "publisher": "BJS"}


def test_tiers(spark):
    seven = [(f"Name{c}", "A", None) for c in "abcdefg"]
    refs = refs_of(
        spark, CITED, CITED | {"pages": "3–4"}, CITED | {"year": 2014}, {"title": "Nothing like that exists", "year": 2019, "authors": [("Ghost", "A", None)], "raw_text": "Ghost"}, GREY,
        CITED | {"doi": "10.9999/fake"}, CITED | {"pages": "PMC1234567"}, CITED | {"pages": "9-3"}, CITED | {"authors": [seven[0]], "title": "Seven Names Wrote This", "doi": "10.1/seven", "raw_text": "Namea et al. (2020)"},
    )
    works = works_of(spark, {"source": "crossref"}, {"source": "openalex"}, {"source": "crossref", "authors": seven, "title": "Seven Names Wrote This", "doi": "10.1/seven"}, {"source": "openalex", "authors": seven, "title": "Seven Names Wrote This", "doi": "10.1/seven"})
    dois = ("10.1234/test", "10.1/seven")
    got = audited(spark, refs, works, dois, [("https://bjs.gov/r", True)])
    tiers = {i: r.confidence for i, r in got.items()}
    assert tiers == {1: "verified_with_style_edits", 2: "verified", 3: "partial", 4: "hallucinated", 5: "verified_via_url", 6: "partial", 7: "partial", 8: "partial", 9: "verified_with_style_edits"}
    fields = {i: [d.field for d in r.discrepancies] for i, r in got.items()}
    assert fields[3] == ["year"] and got[3].discrepancies[0].severity == "major"
    assert "doi (does not resolve)" in fields[6] and "pages (PMC ID in pages slot)" in fields[7] and "pages (backwards)" in fields[8] and "author count" not in fields[9]
    assert [e.corrected for e in got[1].style_edits] == ["3–4"] and got[1].sources_agreeing == 2
    assert all(r.notes for i, r in got.items() if i != 2) and not got[2].notes
    assert audited(spark, refs, works, dois, [("https://bjs.gov/r", True)], strictness="strict")[5].confidence == "hallucinated"
    assert audited(spark, refs, works, dois, [("https://bjs.gov/r", False)], strictness="relaxed")[5].confidence == "verified"
    with pytest.raises(ValueError):
        audited(spark, refs, works, strictness="odd")


def test_linkage(spark):
    refs = refs_of(spark, CITED | {"doi": "10.1234/TEST"}, CITED | {"doi": "", "arxiv_id": "1706.03762v7"}, CITED | {"doi": "", "pmid": "77"}, CITED | {"doi": ""})
    works = works_of(
        spark, {"source": "crossref", "doi": "10.65215/test"}, {"source": "openalex", "container_title": "", "authors": []}, {"source": "crossref", "volume": ""}, {"source": "arxiv", "arxiv_id": "1706.03762", "doi": ""}, {"source": "pubmed", "pmid": "77", "doi": ""}, {"source": "scholarly"},
    )
    found = {(r.ref_idx, r.w.source) for r in linkage.by_id(refs, works).collect()}
    assert found == {(1, "crossref"), (1, "openalex"), (2, "arxiv"), (3, "pubmed")}
    assert [r.ref_idx for r in linkage.decisive(refs, linkage.by_id(refs, works)).collect()] == [1]
    every = linkage.candidates(refs, works).where("ref_idx = 4")
    assert {r.w.source for r in every.collect()} == {"crossref", "openalex", "arxiv", "pubmed"}
    assert linkage.candidates(refs, works, use_scholarly=True).where("ref_idx = 4 and w.source = 'scholarly'").count() == 1
    ranked = linkage.scored(refs, linkage.candidates(refs, works))
    assert {r.ref_idx: r.w.doi for r in linkage.best(ranked).collect()}[4] != "10.65215/test"
    merged = {r.ref_idx: r for r in linkage.merged(linkage.corroboration(ranked)).collect()}
    assert merged[1].canonical.volume == "1" and "volume" in merged[1].merged_from and merged[1].sources_agreeing == 2


def brute_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    s, p, q = (" ".join(sorted(v)) for v in (x & y, x - y, y - x))
    if s and (not p or not q):
        return 100.0
    left, right = " ".join(filter(None, (s, p))), " ".join(filter(None, (s, q)))

    def lcs(m, n):
        row = [0] * (len(n) + 1)
        for c in m:
            new = [0]
            for j, d in enumerate(n):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    out = 200 * ((len(left) - len(p)) + lcs(p, q)) / (len(left) + len(right))
    if s:
        out = max(out, 200 * len(s) / (len(s) + len(left)), 200 * len(s) / (len(s) + len(right)))
    return out


def test_token_set_ratio(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    rows = [tuple(" ".join(word() for _ in range(r.randint(0, 5))) for _ in range(2)) for _ in range(1500)] + [(None, "a"), ("a", None), ("a b", "b a"), ("a", "a b")]
    df = spark.createDataFrame(rows, "a string, b string")
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    for x in sim.with_ratio(df, "ratio", split(F.col("a")), split(F.col("b"))).collect():
        assert abs(x.ratio - round(brute_ratio(x.a or "", x.b or ""), 6)) < 1e-9, x


def test_token_set_ratio_leaves_decided_pairs_to_built_ins(spark):
    df = spark.createDataFrame([("a b", "b a")] * 50, "a string, b string")
    assert sim.with_ratio(df, "ratio", F.split("a", " "), F.split("b", " ")).where("ratio = 100").count() == 50
    given = df.select(F.when(F.lit(False), F.col("a")).alias("p"))
    assert given.select(sim._token_set_ratio()("p", "p", "p").alias("r")).where("r IS NOT NULL").count() == 0


def values(spark, data, make):
    df = spark.createDataFrame([(x,) for x in data], "x string")
    return [r.y for r in df.select(make(F.col("x")).alias("y")).collect()]


def test_text_functions(spark):
    assert values(spark, ["Müller-Lyer", "O'Brien", None, "ﬁnn"], t.normalize_surname) == ["mullerlyer", "obrien", "", "finn"]
    assert values(spark, ["The <i>Café</i> of  Art & Life", "", None], t.normalize_title) == ["i cafe i art life".replace("i ", "", 1).replace(" i ", " "), "", ""]
    assert values(spark, ["J. Am. Med. Inform. Assoc.", "Proc. Natl. Acad."], t.normalize_journal) == ["journal american med inform assoc", "proceedings national acad"]
    assert values(spark, ["see 10.1000/ABC.9). x", "no"], t.doi_of) == ["10.1000/abc.9", ""]
    assert values(spark, ["arXiv:1706.03762v7", "cond-mat arXiv: cond-mat/9801001", "id 1706.03762 x"], t.arxiv_of) == ["1706.03762v7", "cond-mat/9801001", "1706.03762"]
    assert values(spark, ["p. 1999 (2015)", "x 2001;3", "in 1850", "none", "1599"], t.year_of) == [2015, 2001, 1850, None, None]
    assert values(spark, ["Bureau of Justice Statistics", "Smith, J.", "Smith J", "World Health Organization", "John Smith", ""], t.is_institution) == [True, False, False, True, False, False]
    assert values(spark, ["https://www.cdc.gov/x", "http://fun.org", "http://x.com", "bad url %%", None], t.reputable) == [True, True, False, False, False]
    assert values(spark, ["Smith, J. M.", "Doudna JA", "Ashish Vaswani", "Plato", ""], lambda c: F.concat_ws("|", t.author_of(c)["family"], t.author_of(c)["given"])) == ["Smith|J. M.", "Doudna|JA", "Vaswani|Ashish", "Plato|", "|"]
    assert values(spark, ["Jane Mary", "Jean-Paul", "Aidan N.", ""], t.initials) == ["J. M.", "J.-P.", "A. N.", ""]
    assert values(spark, ["the DNA of a cell is in the"], t.title_case) == ["The DNA of a Cell is in The"]
    assert values(spark, ["Dual-RNA-Guided Work On MRI/CT"], t.sentence_case) == ["Dual-RNA-guided work on MRI/CT"]
    assert values(spark, ["J. Am. Med. Inform. Assoc."], lambda c: t.abbreviates(c, F.lit("Journal of the American Medical Informatics Association"))) == [True]
    assert values(spark, ["Nature"], lambda c: t.abbreviates(c, F.lit("Science"))) == [False]
    assert values(spark, ["2", "02", "S1", "2a"], lambda c: t.same_number(c, F.lit("2"))) == [True, True, False, False]


def test_entries(spark):
    text = "Intro\nReferences\nSmith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20. https://doi.org/10.1000/x.\nWade G, Roe B. On other things entirely. J Oth Things. 2001;4(1):5-9.\nC. Appendix of more\ntail"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "word " * 5000), (5, "...\x00\n\n()")], "doc_id long, text string")
    rows = entries.parse_entries(entries.entries(docs)).where("doc_id = 1").orderBy("ref_idx").collect()
    assert [(r.title, r.year, r.volume, r.issue, r.pages, r.doi) for r in rows] == [("A study of things that matter", 2015, "3", "2", "10-20", "10.1000/x"), ("On other things entirely", 2001, "4", "1", "5-9", "")]
    assert [[a.family for a in r.authors] for r in rows] == [["Smith"], ["Wade", "Roe"]] and rows[0].container_title == "Journal of Things" and {r.type for r in rows} == {"journal-article"}
    assert entries.parse_entries(entries.entries(docs)).count() >= 3
    assert docs.select(entries.body_text(F.col("text")).alias("b")).where("doc_id = 1").first().b == "Intro"
    raw = spark.createDataFrame([("Bureau of Justice Statistics. (2020). Prisoners in our times. Washington, DC: Justice Press; 2020.",), ('Kim, S. "A quoted title here," Proceedings of X, vol. 3, pp. 4-9, 2001.',)], "raw_text string")
    got = entries.parse_entries(raw).collect()
    assert got[0].authors[0].family == "Bureau of Justice Statistics" and got[0].publisher == "Justice Press" and got[1].title == "A quoted title here" and got[1].type == "proceedings-article" and got[1].pages == "4-9"


def test_intext_and_cross_check(spark):
    body = "As (Smith et al., 2020; World Health Organization, 2019) and Patel and Sharma (2022) say [1-3], [2, 4]; (Nobody, 1999). [9-7]"
    cited = intext.intext(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, body string"), body="body")
    rows = {r.raw: r for r in cited.collect()}
    assert rows["(Smith et al., 2020)"].surnames == ["smith"] and rows["(World Health Organization, 2019)"].institutional == "worldhealthorganization"
    assert rows["Patel and Sharma (2022)"].surnames == ["patel", "sharma"] and rows["[1-3]"].indices == [1, 2, 3] and rows["[2, 4]"].indices == [2, 4]
    refs = refs_of(spark, CITED, {"title": "x", "year": 2019, "authors": [("Global World Health Organization", "", None)]}, {"title": "y", "year": 2022, "authors": [("Sharma", "B", None)]}, {"title": "z", "year": 2000, "authors": [("Zed", "Z", None)]}, {"title": "u"})
    assert {(r.raw, tuple(r.ref_idxs)) for r in intext.matched(cited, refs).collect()} == {("(Smith et al., 2020)", (1,)), ("(World Health Organization, 2019)", (2,)), ("Patel and Sharma (2022)", (3,)), ("[1-3]", (1, 2, 3)), ("[2, 4]", (2, 4))}
    assert {r.raw for r in intext.orphans(cited, refs).collect()} == {"(Nobody, 1999)", "[9-7]"}
    assert [r.ref_idx for r in intext.unused(cited, refs).collect()] == [5]
    assert [r.claim for r in intext.claims(spark.createDataFrame([(1, "One. Studies show that x is y. Two.")], "doc_id long, text string")).collect()] == ["Studies show that x is y."]


def test_styles(spark):
    record = {"source": "crossref", "authors": [("Smith", "Jane Mary", None), ("Doe", "John", None)], "title": "a study of DNA", "volume": "12", "issue": "3", "pages": "45-67", "doi": "10.1/x"}
    w = works_of(spark, record)
    c = {x: F.col(x) for x in w.columns}
    got = w.select(*(styles.format_reference(c, s, F.lit(4)).alias(s) for s in styles.SUPPORTED_STYLES), styles.bibtex(c).alias("bib"), styles.ris(c).alias("ris"), styles.format_intext(c, "apa", page=F.lit("7")).alias("cited")).first()
    assert got.apa == "Smith, J. M., & Doe, J. (2020). A study of DNA. *Journal of Testing*, 12(3), 45–67. https://doi.org/10.1/x"
    assert got.mla == 'Smith, Jane Mary, and John Doe. "A Study of DNA." *Journal of Testing* vol. 12, no. 3, 2020, pp. 45–67. doi:10.1/x.'
    assert got.ama == "4. Smith JM, Doe J. A study of DNA. *Journal of Testing*. 2020;12(3):45–67. doi:10.1/x"
    assert got.ieee == '[4] J. M. Smith and J. Doe, "A study of DNA," *Journal of Testing*, vol. 12, no. 3, pp. 45–67, 2020. doi: 10.1/x.'
    assert got.harvard == "Smith, J. M. and Doe, J. (2020) 'A study of DNA', *Journal of Testing*, 12(3), pp. 45–67. doi: 10.1/x."
    assert got.cited == "(Smith & Doe, 2020, p. 7)" and got.bib.startswith("@article{smith2020,\n  author = {Jane Mary Smith and John Doe},") and "SP  - 45\nEP  - 67" in got.ris
    many = works_of(spark, {"source": "crossref", "authors": [(f"N{i:02d}", "A", None) for i in range(22)]})
    got = many.select(*(styles.format_reference(c, s).alias(s) for s in styles.SUPPORTED_STYLES)).first()
    assert "N17, A., N18, A. N21, A. (2020)" in got.apa and "N02 A, et al" in got.ama and got.ieee.startswith("A. N00 et al.") and got.harvard.startswith("N00, A. et al.")
    with pytest.raises(ValueError):
        styles.format_reference(c, "odd")


def test_duplicates(spark):
    refs = refs_of(spark, CITED, CITED | {"title": "A test paper"}, {"title": "Never heard of it at all", "year": 2001}, {"title": "Never heard of it, at all", "year": 2001}, {"title": "Other", "year": 2001})
    results = verify.audit(refs, works_of(spark, {"source": "crossref"}, {"source": "openalex"}), spark.createDataFrame([], "doi string"), spark.createDataFrame([], "url string, resolves boolean"))
    assert {(r.idx1, r.idx2, r.reason) for r in verify.duplicates(results).collect()} == {(1, 2, "shared DOI: 10.1234/test"), (3, 4, "duplicate parsed title and year")}
    counts = {r.confidence: r.n for r in verify.tier_counts(results).collect()}
    assert sum(counts.values()) == 5 and len(counts) == 5


def docx(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda s, up: f'<w:r>{"<w:rPr><w:vertAlign w:val=\"superscript\"/></w:rPr>" if up else ""}<w:t>{s}</w:t></w:r>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join('<w:p>' + ''.join(run(*r) for r in p) + '</w:p>' for p in paragraphs)}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@article{k1,\n title = {{A {Nested} Title}},\n author = {Smith, Jane and John Doe},\n journal="J. Test", year = 2010, volume={3}, number = {4}, pages = {5--9}, doi = {10.1/ABC}\n}\n@comment{x}\n@phdthesis{k2, title={Thesis}, year={2001}}\n')
    bib = files.read(spark, str(tmp_path / "a.bib"))[0].orderBy("ref_idx").collect()
    assert [(r.title, r.year, r.pages, r.doi, r.type) for r in bib] == [("A {Nested} Title", 2010, "5-9", "10.1/abc", "journal-article"), ("Thesis", 2001, "", "", "thesis")]
    assert [(a.family, a.given) for a in bib[0].authors] == [("Smith", "Jane"), ("Doe", "John")] and bib[0].issue == "4" and bib[0].container_title == "J. Test"
    (tmp_path / "a.ris").write_text("TY  - JOUR\nAU  - Smith, Jane\nAU  - Doe, J.\nTI  - Title one\nPY  - 2012\nJO  - Nature\nSP  - 1\nEP  - 4\nDO  - 10.2/X\nER  - \n\nTY  - BOOK\nTI  - Two\nER  - \n")
    ris = files.read(spark, str(tmp_path / "a.ris"))[0].orderBy("ref_idx").collect()
    assert [(r.title, r.year, r.pages, r.doi, r.type) for r in ris] == [("Title one", 2012, "1-4", "10.2/x", "journal-article"), ("Two", None, "", "", "book")]
    (tmp_path / "a.docx").write_bytes(docx([[("Known", False), ("1,2", True), (" and [3]", False)], [("References", False)], [("Smith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.", False)]]))
    refs, cited = files.read(spark, str(tmp_path / "a.docx"))
    assert refs.first().title == "A study of things that matter" and [r.raw for r in cited.orderBy("pos").collect()] == ["[3]", "[1,2]"]
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert files.read(spark, str(tmp_path / "bad.docx"))[0].count() == 0
    (tmp_path / "a.txt").write_text("Body (Smith, 2015).\nReferences\nSmith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.\n")
    refs, cited = files.read(spark, str(tmp_path / "a.txt"))
    assert refs.count() == 1 and cited.first().raw == "(Smith, 2015)"
    rec = spark.createDataFrame([(1, 1, '{"author":[{"family":"Roe","given":"R"}],"title":["T one"],"date":"2004-05","journal":["J"],"doi":["doi:10.3000/Y."],"type":"article-journal"}'), (1, 2, "{}")], "doc_id long, ref_idx int, value string")
    got = files.from_parser_records(rec).orderBy("ref_idx")
    assert (got.first().title, got.first().year, got.first().doi, got.first().type) == ("T one", 2004, "10.3000/y", "journal-article")
    raw = spark.createDataFrame([(1, 1, "x"), (1, 2, "Smith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.")], "doc_id long, ref_idx int, raw_text string")
    assert [r.title for r in files.backfill(got, raw).orderBy("ref_idx").collect()] == ["T one", "A study of things that matter"]
    tei = '<biblStruct xmlns="http://www.tei-c.org/ns/1.0"><analytic><title level="a">T two</title><author><persName><forename>A</forename><surname>Bee</surname></persName></author></analytic><monogr><title level="j">J X</title><imprint><biblScope unit="volume">7</biblScope><biblScope unit="page" from="1" to="9"/><date type="published" when="1999-01"/></imprint></monogr><idno type="DOI">10.4/Z</idno></biblStruct>'
    r = files.from_tei(spark.createDataFrame([(1, 1, tei)], "doc_id long, ref_idx int, value string")).first()
    assert (r.title, r.year, r.volume, r.pages, r.doi, r.container_title, r.authors[0].family, r.authors[0].given) == ("T two", 1999, "7", "1-9", "10.4/z", "J X", "Bee", "A")


def test_catalog(spark):
    one = lambda f, s: f(spark.createDataFrame([(s,)], "value string")).first()
    c = one(catalog.crossref, '{"DOI":"10.1/A","title":["T"],"container-title":["J"],"author":[{"family":"F","given":"G"}],"issued":{"date-parts":[[2001,2]]},"page":"1-2","type":"book"}')
    assert (c.doi, c.source_id, c.title, c.year, c.type, c.source_url) == ("10.1/a", "10.1/A", "T", 2001, "book", "https://doi.org/10.1/A")
    o = one(catalog.openalex, '{"id":"https://openalex.org/W1","title":"T","publication_year":2002,"doi":"https://doi.org/10.2/B","type":"odd","authorships":[{"author":{"display_name":"Jane Roe"}}],"primary_location":{"source":{"display_name":"J","type":"journal"}},"biblio":{"first_page":"3"}}')
    assert (o.source_id, o.doi, o.pages, o.type, o.authors[0].family) == ("W1", "10.2/b", "3", "journal-article", "Roe")
    p = one(catalog.pubmed, '{"uid":"9","title":"T.","pubdate":"2003 Jan","source":"J","authors":[{"name":"Roe J"}],"articleids":[{"idtype":"doi","value":"10.3/C"}],"pubtype":["Book"]}')
    assert (p.title, p.year, p.doi, p.pmid, p.type, p.authors[0].given) == ("T", 2003, "10.3/c", "9", "book", "J")
    s = one(catalog.semantic_scholar, '{"paperId":"p","title":"T","year":2004,"externalIds":{"ArXiv":"1234.5678","DOI":"10.4/D"}}')
    assert (s.arxiv_id, s.doi, s.year, s.type) == ("1234.5678", "10.4/d", 2004, "journal-article")
    a = one(catalog.arxiv, "<entry><id>http://arxiv.org/abs/1706.03762v7</id><title>T\n x</title><published>2017-06-12T00:00:00Z</published><author><name>Ash Vas</name></author><author><name>Bo Cee</name></author><arxiv:doi>10.5/E</arxiv:doi></entry>")
    assert (a.arxiv_id, a.title, a.year, a.doi, a.container_title, [x.family for x in a.authors]) == ("1706.03762v7", "T x", 2017, "10.5/e", "arXiv", ["Vas", "Cee"])
    assert one(catalog.crossref, "not json").title == ""


def test_sinks_and_access(spark, tmp_path):
    refs = refs_of(spark, CITED, {"title": "Ghost | title", "year": 2019, "authors": [("Ghost", "A", None)], "raw_text": "Ghost <b>"}, GREY, CITED | {"year": 2011})
    results = verify.audit(refs, works_of(spark, {"source": "crossref"}, {"source": "openalex"}), spark.createDataFrame([("10.1234/test",)], "doi string"), spark.createDataFrame([("https://bjs.gov/r", True)], "url string, resolves boolean"))
    md = {r.ref_idx: r for r in sinks.markdown_entries(results, "apa").collect()}
    assert md[2].severity == 1 and md[4].severity == 2 and "| year | 2011 | 2020 | major |" in md[4].markdown and "Cross-verified by:** " in md[1].markdown
    html = {r.ref_idx: r.html for r in sinks.html_entries(results, "apa").collect()}
    assert "Ghost &lt;b&gt;" in html[2] and html[2].startswith('<details class="entry hallucinated">')
    clean = {r.ref_idx: r.entry for r in sinks.clean_bibliography(results, "apa").collect()}
    assert clean[2].startswith("[REMOVED") and clean[3] == "raw" and clean[1].startswith("Smith, J. (2020). A test paper.")
    bib = {r.ref_idx: r.entry for r in sinks.bibtex_entries(results).collect()}
    assert bib[2].startswith("% HALLUCINATED") and "Grey literature" in bib[3] and bib[1].startswith("@article{smith2020")
    assert "UR  - https://bjs.gov/r" in {r.ref_idx: r.entry for r in sinks.ris_entries(results).collect()}[3]
    assert [r.rev_id for r in sinks.tracked_changes(results, "apa").orderBy("ref_idx").collect()] == [1000, 1002]
    written = sinks.write_all(results, "apa", str(tmp_path / "out"), ["markdown", "json", "bibtex", "odd"])
    assert "odd_error" in written and spark.read.text(written["json"]).count() == 4
    assert sinks.formats_for("a.bib") == ["bibtex"] and sinks.formats_for("a.bib", "all") == sinks.FORMATS and sinks.formats_for("x", "json,odd") == ["json"]
    calls = spark.createDataFrame([("arxiv", True, 1), ("arxiv", True, 2), ("arxiv", True, 3), ("crossref", True, 1), ("crossref", False, 2)], "api string, failed boolean, seq int")
    assert {(r.api, r.seq) for r in access.circuit_breaker(calls).where("open").collect()} == {("arxiv", 3)}
    now = F.to_timestamp(F.lit("2024-01-10"))
    cache = spark.sql("select timestamp'2024-01-09' as fetched_at union all select timestamp'2024-01-01'")
    assert access.fresh(cache, now).count() == 1
    gone = spark.sql("select 'semantic_scholar' as api, timestamp'2024-01-09 23:58:00' as given_up_at union all select 'arxiv', timestamp'2024-01-09 23:59:00'")
    assert [r.api for r in access.cooling(gone, now).collect()] == ["semantic_scholar"]


def test_reports_whole(spark, tmp_path):
    refs = refs_of(spark, CITED, {"title": "Ghost | title", "year": 2019, "authors": [("Ghost", "A", None)], "raw_text": "Ghost <b>"}, GREY, CITED | {"year": 2011})
    results = verify.audit(refs, works_of(spark, {"source": "crossref"}, {"source": "openalex"}), spark.createDataFrame([("10.1234/test",)], "doi string"), spark.createDataFrame([("https://bjs.gov/r", True)], "url string, resolves boolean"))
    orphans = spark.createDataFrame([(1, 0, "(Nobody & <b>, 1900)")], "doc_id bigint, pos int, raw string")
    unused = spark.createDataFrame([(1, 3)], "doc_id bigint, ref_idx int")
    twice = verify.duplicates(results)
    n = sinks.counts(results, orphans, unused, twice).first()
    assert (n.n_references, n.n_orphans, n.n_unused, n.n_duplicates) == (4, 1, 1, 1)
    out = sinks.write_all(results, "apa", str(tmp_path / "w"), ["markdown", "html", "docx", "ris"], orphans, unused, twice)
    text = "\n".join(r.value for r in spark.read.text(out["markdown"]).collect())
    assert "| HALLUCINATED (no canonical match) | 1 |" in text and "### Citations without an entry (1)" in text and "- Entry #3" in text and "- #1 and #4: shared DOI" in text and "## Clean bibliography (APA)" in text
    assert text.index("## 2. HALLUCINATED") < text.index("## 4. PARTIAL") < text.index("## 3. VERIFIED")
    page = "\n".join(r.value for r in spark.read.text(out["html"]).collect())
    assert 'id="show-partial"' in page and "(Nobody &amp; &lt;b&gt;, 1900)" in page and page.rstrip().endswith("</html>")
    row = spark.read.parquet(out["docx"]).first()
    runs = files.docx_runs(bytes(row.content))
    assert any(x == "Ghost <b>" for _, x, _ in runs)
    import io
    import zipfile

    document = zipfile.ZipFile(io.BytesIO(row.content)).read("word/document.xml").decode()
    assert document.count("<w:del ") == document.count("<w:ins ") == 2 and 'w:id="1000"' in document and 'w:id="1003"' in document
    plain = sinks.markdown_reports(results, "apa").first().markdown
    assert "Citations in the text" not in plain and "Entries of the same work" not in plain


def test_readers_by_file_and_parser_choice(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text("@article{x, title={One {T}itle}, author={Roe, Jane}, year={2001}}")
    (tmp_path / "in" / "b.ris").write_text("TY  - JOUR\nTI  - Two title\nPY  - 2002\nER  - \n")
    (tmp_path / "in" / "c.txt").write_text("It holds (Smith, 2015).\nReferences\nSmith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.\n")
    (tmp_path / "in" / "d.pdf").write_bytes(b"not a pdf")
    refs, cited = files.read(spark, f"{tmp_path}/in/*")
    assert {r.title for r in refs.collect()} == {"One {T}itle", "Two title", "A study of things that matter"} and [r.raw for r in cited.collect()] == ["(Smith, 2015)"]
    broken = files.read_pdf(spark, f"{tmp_path}/in/d.pdf").first()
    assert broken.text == "" and broken.error
    raw = spark.createDataFrame([(1, 1, "Smith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.")], "doc_id long, ref_idx int, raw_text string")
    made = lambda title: files.from_parser_records(spark.createDataFrame([(1, 1, '{"title":["%s"]}' % title)], "doc_id long, ref_idx int, value string"))
    backends = {"grobid": made("by grobid"), "anystyle": made("by anystyle")}
    chosen = lambda choice, have=backends: files.parse(raw, have, choice).first().title
    assert chosen("auto") == "by anystyle" and chosen("grobid") == "by grobid" and chosen("regex") == chosen("auto", {}) == "A study of things that matter"
    assert chosen("auto", {"grobid": backends["grobid"]}) == "by grobid"
    monkeypatch.setenv(files.PARSER_VARIABLE, "regex")
    assert chosen("grobid") == "A study of things that matter"


def test_scholarly_records_and_breaker(spark):
    row = catalog.scholarly(spark.createDataFrame([('{"pub_url":"http://x","bib":{"title":"T","author":["Jane Roe","K Lee"],"pub_year":2011,"venue":"V"}}',)], "value string")).first()
    assert (row.source, row.source_id, row.title, row.year, row.container_title, [a.family for a in row.authors]) == ("scholarly", "http://x", "T", 2011, "V", ["Roe", "Lee"])
    r = random.Random(6)
    calls = [(r.choice("ab"), r.random() < 0.3, i) for i in range(400)]
    seen, want = Counter(), {}
    for api, failed, i in calls:
        want[i] = seen[api] >= {"a": 3}.get(api, 5)
        seen[api] += failed
    df = spark.createDataFrame(calls, "api string, failed boolean, seq int")
    assert {x.seq: x.open for x in access.circuit_breaker(df, {"a": 3}, 5).collect()} == want


def test_stream_and_cli(spark, tmp_path, capsys):
    from citeloom.streaming.audit import audit_stream

    refs_of(spark, CITED, GREY).write.parquet(str(tmp_path / "refs"))
    works = works_of(spark, {"source": "crossref"}, {"source": "openalex"})
    none = spark.createDataFrame([("10.1234/test",)], "doi string"), spark.createDataFrame([], "url string, resolves boolean")
    stream = spark.readStream.schema(REFS).parquet(str(tmp_path / "refs"))
    q = audit_stream(stream, works, *none, lambda df, n: df.select("doc_id", "ref_idx", "confidence").write.mode("overwrite").parquet(str(tmp_path / f"out-{n}")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert Counter(r.confidence for r in spark.read.parquet(str(tmp_path / "out-0")).collect()) == {"verified_with_style_edits": 1, "verified_via_url": 1}
    (tmp_path / "c.json").write_text('{"DOI":"10.1/x","title":["A study of things that matter"],"container-title":["Journal of Things"],"author":[{"family":"Smith","given":"J."}],"issued":{"date-parts":[[2015]]},"volume":"3","issue":"2","page":"10-20"}\n')
    (tmp_path / "a.txt").write_text("Studies show that things that matter matter.\nReferences\nSmith, J. (2015). A study of things that matter. Journal of Things, 3(2), 10-20.\n")
    source = f"crossref={tmp_path}/c.json"
    assert cli.main(["audit", f"{tmp_path}/a.txt", "--catalog", source, "--formats", "markdown", "--out", f"{tmp_path}/o"]) == 0
    assert cli.main(["suggest", f"{tmp_path}/a.txt", "--catalog", source, "--out", f"{tmp_path}/s"]) == 0
    assert "A study of things that matter" in spark.read.json(f"{tmp_path}/s").first().candidates
    assert cli.main(["audit", f"{tmp_path}/none.txt", "--catalog", source]) == 2
    (tmp_path / "e.txt").write_text("")
    assert cli.main(["audit", f"{tmp_path}/e.txt", "--catalog", source]) == 3


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "events"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    queries = registry.queries()
    for name, statement in registry.oracle_sql().items():
        if name.endswith("_by_id") or name in ("audit_strict", "audit_relaxed", "record_scores", "corroborators", "audit_tier_counts", "title_ratio", "best_record"):
            continue  # the same plans as their neighbours
        got = queries[name](spark, SF)
        columns = sorted(got.columns)
        want = con.sql(f"select {', '.join(columns)} from ({statement})").fetchall()
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want), name


def test_registered_search_finds_records_of_wrong_dois(spark):
    queries = registry.queries()
    by_id, whole = ({(r.doc_id, r.ref_idx) for r in queries[n](spark, SF).select("doc_id", "ref_idx").collect()} for n in ("best_record_by_id", "best_record"))
    # class 3: a DOI that nobody has; those without other identifiers
    wrong = {(i - i % 10, i % 10 + 1) for i in range(200) if i % 12 == 3 and i % 10 not in (4, 9) and i % 40 != 21}
    assert not wrong & by_id and wrong <= whole and by_id <= whole


def brute_search(refs, works, limit=5):
    tokens = lambda x: set(x.split())
    out = set()
    for r in refs:
        for source in {w["source"] for w in works}:
            found = []
            for i, w in enumerate(works):
                n = len(tokens(r["title"]) & tokens(w["title"]))
                fits = {"openalex": r["year"] in (None, w["year"]), "arxiv": r["title"] in w["title"]}.get(source, True)
                if w["source"] == source and n and fits:
                    found.append((-n, abs(r["year"] - w["year"]) if r["year"] else 99, f"{source}-{i}"))
            out |= {(r["ref_idx"], source, i, -n) for n, _, i in sorted(found)[:limit]}
    return out


@pytest.mark.parametrize("span,rare,first,visits", [(1024, 64, 4, 20_000), (7, 2, 1, 3), (7, 0, 1, 5)])
def test_title_search_counts_all_terms(spark, monkeypatch, span, rare, first, visits):
    for name, value in (("RANGE", span), ("RARE", rare), ("FIRST", first), ("VISITS", visits)):
        monkeypatch.setattr(titles_of, name, value)
    r = random.Random(3)
    some = [f"word{c}" for c in "abcdefghijklmnop"]
    works = [{"source": r.choice(["crossref", "openalex", "semantic_scholar", "arxiv"]), "title": " ".join(r.choice(some[: r.choice([5, 16])]) for _ in range(r.randint(1, 9))), "year": r.randint(2000, 2003), "authors": []} for _ in range(300)]
    titles = [" ".join(r.sample(some, r.randint(1, 12))) for _ in range(25)] + [" ".join(r.choice(works)["title"].split()[:4]) for _ in range(15)]
    # shares most of its words with a record, but none of its four rarest
    works += [{"source": "crossref", "title": " ".join(some[:8]), "year": 2001, "authors": []}] + [{"source": "crossref", "title": "raree rareb rarec rared", "year": 2001, "authors": []}]
    titles.append(" ".join([*some[:8], "raree", "rareb", "rarec", "rared"]))
    refs = [{"title": x, "year": r.choice([None, 2000, 2001, 2002]), "ref_idx": i + 1, "authors": []} for i, x in enumerate(titles)]
    got = linkage.title_search(refs_of(spark, *refs), works_of(spark, *works))
    got = {(x.ref_idx, x.source, x.source_id, x.shared) for x in got.select("ref_idx", "w.source", "w.source_id", "shared").collect()}
    assert got == brute_search(refs, works)
    assert (len(titles), "crossref", "crossref-300", 8) in got


def test_title_search_with_a_word_in_every_title(spark, monkeypatch):
    """No pair of title and record is made by the common word: a visit returns a range's best only, and is split over tasks."""
    for name, value in (("RANGE", 50), ("RARE", 4), ("VISITS", 20)):
        monkeypatch.setattr(titles_of, name, value)
    made = []
    kept = titles_of.kept
    monkeypatch.setattr(titles_of, "kept", lambda df, name: made.append((name, kept(df, name))) or made[-1][1])
    works = [{"source": "crossref", "title": f"common own{i}", "year": 1990 + i % 30, "authors": []} for i in range(1000)]
    refs = [{"title": f"common own{7 * i}", "year": 2000, "ref_idx": i + 1, "authors": []} for i in range(120)]
    got = linkage.title_search(refs_of(spark, *refs), works_of(spark, *works)).select("ref_idx", "w.title", "w.year", "shared").collect()
    assert len(got) == 600 and {(x.ref_idx, x.title) for x in got if x.shared == 2} == {(x["ref_idx"], x["title"]) for x in refs}
    assert all(x.year == 2000 for x in got if x.shared == 1)
    rows = {name: [df.count() for n, df in made if n == name] for name in ("title-visits", "title-hits")}
    assert sum(rows["title-visits"]) < 120 * 20 and all(h <= 5 * v for h, v in zip(rows["title-hits"], rows["title-visits"]))


def test_title_search_of_repeated_ids_nulls_and_empty_tables(spark):
    works = [{"source": "crossref", "source_id": "same", "title": "alpha beta gamma", "year": 2000, "authors": []}] * 9 + [{"source": "crossref", "source_id": f"x{i}", "title": "alpha beta", "year": None, "authors": []} for i in range(3)]
    refs = refs_of(spark, {"title": "alpha beta gamma", "year": None, "ref_idx": 1, "authors": []}, {"title": None, "year": 2000, "ref_idx": 2, "authors": None}, {"title": "", "year": 2000, "ref_idx": 3, "authors": []})
    found = titles_of.search(refs, works_of(spark, *works))
    assert sorted((x.ref_idx, x.source_id, x.shared, x.place) for x in found.collect()) == [(1, "same", 3, 1), (1, "x0", 2, 2), (1, "x1", 2, 3), (1, "x2", 2, 4)]
    assert titles_of.search(refs, works_of(spark).limit(0)).count() == titles_of.search(refs.limit(0), works_of(spark, *works)).count() == 0
