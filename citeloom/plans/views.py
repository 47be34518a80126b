"""Citation tables made from ``documents``: the inputs of the registered queries.

The driver's texts hold no citations, so references, a catalogue, raw entries and bodies are made
from ids and words of the texts, by SQL that Spark and the oracle's engine both run. Twelve classes
of references (``doc_id % 12``) differ from the catalogue in known ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..tables import kept

FAMILIES = "Smith,Müller,García,O'Brien,Van Dyk,Lindström,Chen,Novak,Garcia-Lopez,Ibsen,Costa"
GIVENS = "John,Anna Maria,Jean-Paul,K,Wei,José,Mary Ann,Ludwig,E. T.,Olga,Per"
JOURNALS = "Journal of Testing,Annals of the Applied Sciences,Proceedings of the National Academy,International Review of Physics,Nature Methods,American Journal of Botany,European Heart Journal,Transactions on Databases"
SHORT_JOURNALS = "J. Testing,Ann. Appl. Sci.,Proc. Natl. Acad.,Int. Rev. Phys.,Nat. Methods,Am. J. Bot.,Eur. Heart J.,Trans. Databases"
INSTITUTIONS = "Bureau of Justice Statistics;World Health Organization;Centers for Disease Control and Prevention;National Institute of Standards"
ACCENTS, PLAIN = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöüß", "ACEEEINOOUaceeeinoous"


def _pick(names: str, key: str, sep: str = ",") -> str:
    quoted = names.replace("'", "''")
    return f"split_part('{quoted}', '{sep}', CAST(1 + ({key}) % {names.count(sep) + 1} AS INT))"


def _author(shift: int) -> str:
    return f"concat({_pick(FAMILIES, f'doc_id * 3 + {shift}')}, '|', {_pick(GIVENS, f'doc_id + {shift * 5}')})"


_WORDS = ", ".join(f"split_part(w, ' ', {k})" for k in range(6, 14))

CTES = f"""
flat AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS w FROM documents),
titled AS (SELECT doc_id, translate(trim(concat_ws(' ', {_WORDS})), '{ACCENTS}', '{PLAIN}') AS words FROM flat),
base AS (
  SELECT doc_id, CASE WHEN length(words) < 6 THEN concat('Untitled work ', CAST(doc_id AS STRING)) ELSE words END AS title,
    CAST(1980 + doc_id % 45 AS INT) AS year, {_pick(JOURNALS, 'doc_id')} AS journal, {_pick(SHORT_JOURNALS, 'doc_id')} AS short_journal,
    CAST(1 + doc_id % 300 AS STRING) AS volume, CAST(1 + doc_id % 12 AS STRING) AS issue,
    CAST(1 + doc_id % 800 AS STRING) AS first_page, CAST(10 + doc_id % 800 AS STRING) AS last_page,
    concat('10.', CAST(1000 + doc_id % 9000 AS STRING), '/d', CAST(doc_id AS STRING)) AS doi,
    concat_ws(';', {_author(0)}, CASE WHEN doc_id % 4 >= 1 THEN {_author(1)} END, CASE WHEN doc_id % 4 >= 2 THEN {_author(2)} END, CASE WHEN doc_id % 4 >= 3 THEN {_author(3)} END) AS authors
  FROM titled
),
sources AS (SELECT * FROM (VALUES (0, 'crossref'), (1, 'openalex'), (2, 'pubmed'), (3, 'semantic_scholar'), (4, 'arxiv')) AS v(k, source)),
works_v AS (
  SELECT source, concat(substring(source, 1, 2), CAST(doc_id AS STRING)) AS source_id, concat('https://', source, '.example.org/', CAST(doc_id AS STRING)) AS source_url,
    CASE WHEN k = 3 AND doc_id % 5 = 0 THEN '' ELSE authors END AS authors, CASE WHEN k = 3 AND doc_id % 7 = 0 THEN concat(title, ' revisited') ELSE title END AS title,
    CASE WHEN k = 4 AND doc_id % 6 = 0 THEN CAST(NULL AS INT) ELSE year + CAST(CASE WHEN k = 1 AND doc_id % 9 = 0 THEN 1 ELSE 0 END AS INT) END AS year,
    CASE WHEN k = 0 AND doc_id % 3 = 0 THEN '' ELSE journal END AS container_title, CASE WHEN k = 1 THEN '' ELSE volume END AS volume, CASE WHEN k = 2 THEN '' ELSE issue END AS issue,
    CASE WHEN k = 0 AND doc_id % 4 = 0 THEN '' ELSE concat(first_page, '-', last_page) END AS pages, CASE WHEN doc_id % 10 = 3 THEN 'North Press' ELSE '' END AS publisher,
    CASE WHEN k = 3 THEN '' WHEN k = 1 AND doc_id % 97 = 0 THEN concat('10.65215/d', CAST(doc_id AS STRING)) ELSE doi END AS doi,
    CASE WHEN k = 4 THEN concat(CAST(1000 + doc_id % 9000 AS STRING), '.', CAST(10000 + doc_id % 90000 AS STRING)) ELSE '' END AS arxiv_id,
    CASE WHEN k = 2 THEN CAST(100000 + doc_id AS STRING) ELSE '' END AS pmid,
    CASE WHEN doc_id % 10 = 3 THEN 'book' WHEN doc_id % 10 = 5 THEN 'proceedings-article' WHEN doc_id % 10 = 7 THEN 'unknown' ELSE 'journal-article' END AS type
  FROM base CROSS JOIN sources WHERE (doc_id * 7 + k * 3) % 5 <> 0 AND doc_id % 12 < 10
),
refs_v AS (
  SELECT CAST(doc_id - doc_id % 10 AS BIGINT) AS doc_id, CAST(doc_id % 10 + 1 AS INT) AS ref_idx, concat('entry ', CAST(doc_id AS STRING), CASE WHEN doc_id % 12 = 5 THEN ' et al.' ELSE '' END) AS raw_text,
    CASE WHEN doc_id % 12 IN (5, 6) THEN split_part(authors, ';', 1) WHEN doc_id % 12 = 11 THEN concat({_pick(INSTITUTIONS, 'doc_id', ';')}, '|') WHEN doc_id % 12 = 10 THEN 'Nobody|A' ELSE authors END AS authors,
    CASE WHEN doc_id % 12 IN (10, 11) THEN concat('Invented title number ', CAST(doc_id - doc_id % 12 AS STRING)) WHEN doc_id % 12 = 2 THEN concat(substring(title, 1, 3), 'x', substring(title, 5)) ELSE title END AS title,
    year + CAST(CASE WHEN doc_id % 12 = 1 THEN 2 WHEN doc_id % 12 = 2 THEN 1 WHEN doc_id % 12 = 11 THEN -1 ELSE 0 END AS INT) AS year,
    CASE WHEN doc_id % 12 = 4 THEN short_journal WHEN doc_id % 12 >= 10 THEN '' ELSE journal END AS container_title,
    CASE WHEN doc_id % 12 = 7 THEN concat('0', volume) WHEN doc_id % 12 >= 10 THEN '' ELSE volume END AS volume, CASE WHEN doc_id % 12 >= 10 THEN '' ELSE issue END AS issue,
    CASE WHEN doc_id % 12 = 8 THEN concat(last_page, '–', first_page) WHEN doc_id % 12 = 9 THEN 'PMC1234567' WHEN doc_id % 12 >= 10 THEN '' WHEN doc_id % 24 = 0 THEN concat(first_page, '-', last_page) ELSE concat(first_page, '–', last_page) END AS pages,
    CASE WHEN doc_id % 12 = 11 THEN 'Agency Press' ELSE '' END AS publisher,
    CASE WHEN doc_id % 40 = 21 THEN concat('10.', CAST(1000 + (doc_id - 1) % 9000 AS STRING), '/d', CAST(doc_id - 1 AS STRING)) WHEN doc_id % 12 = 3 THEN concat('10.9999/x', CAST(doc_id AS STRING)) WHEN doc_id % 12 >= 10 OR doc_id % 5 = 4 THEN '' ELSE doi END AS doi,
    CASE WHEN doc_id % 12 = 11 THEN concat('https://www.agency', CAST(doc_id AS STRING), '.gov/report') ELSE '' END AS url,
    CASE WHEN doc_id % 10 = 4 THEN concat(CAST(1000 + doc_id % 9000 AS STRING), '.', CAST(10000 + doc_id % 90000 AS STRING), 'v2') ELSE '' END AS arxiv_id,
    CASE WHEN doc_id % 10 = 9 THEN CAST(100000 + doc_id AS STRING) ELSE '' END AS pmid, '' AS isbn, 'journal-article' AS type
  FROM base
),
raw_v AS (
  SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN concat({_pick(FAMILIES, 'doc_id')}, ', J. M., & Lee, K. (', CAST(year AS STRING), '). ', title, '. ', journal, ', ', volume, '(', issue, '), ', first_page, '-', last_page, '. https://doi.org/', doi, '.')
    WHEN 1 THEN concat('Brown AB, Wu C. ', title, '. ', short_journal, ' ', CAST(year AS STRING), ';', volume, '(', issue, '):', first_page, '-', last_page, '. PMID: ', CAST(100000 + doc_id AS STRING))
    WHEN 2 THEN concat({_pick(INSTITUTIONS, 'doc_id', ';')}, '. (', CAST(year AS STRING), '). ', title, '. https://www.agency.gov/r', CAST(doc_id AS STRING), '.')
    WHEN 3 THEN concat('Kim, S., Diaz, R. and Roe, T. "', title, '," Proceedings of the Testing Conference, vol. ', volume, ', pp. ', first_page, '-', last_page, ', ', CAST(year AS STRING), '.')
    ELSE concat('Ng P et al. ', title, '. arXiv:', CAST(1000 + doc_id % 9000 AS STRING), '.', CAST(10000 + doc_id % 90000 AS STRING), 'v1 (', CAST(year AS STRING), ').') END AS raw
  FROM base
),
body_v AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, concat(
    'Early work (', {_pick(FAMILIES, 'doc_id * 3')}, ', ', CAST(year AS STRING), ') began it. Others (Chen et al., ', CAST(1980 + (doc_id + 1) % 45 AS STRING), '; Novak & Costa, ', CAST(1980 + (doc_id + 2) % 45 AS STRING), ') went on [1-3] and [2, ',
    CAST(1 + doc_id % 12 AS STRING), ']. Ibsen and Chen (', CAST(year + 1 AS STRING), ') agree. According to (World Health Organization, ', CAST(year AS STRING), ') this holds.',
    CASE WHEN doc_id % 7 = 0 THEN ' Unknownperson (1901) differs.' ELSE '' END, ' Studies show that ', split_part(title, ' ', 1), ' matters.') AS body
  FROM base
),
paper_v AS (
  SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN concat('Intro line', chr(10), 'more', chr(10), 'References', chr(10), 'Alpha, A. (2001). First of all titles here. Journal One, 1(2), 3-4.', chr(10), title, chr(10), 'Beta, B. (2002). Second of all titles here. Journal Two, 2(3), 5-6.', chr(10), 'Gamma, C. (2003). Third title. Journal Three, 3(4), 7-8.', chr(10), 'Appendix A', chr(10), 'tail')
    WHEN 1 THEN concat('Body of ', title, chr(10), 'Bibliography:', chr(10), 'one entry ', volume, chr(10), chr(10), 'another entry', chr(10), 'continued', chr(10), chr(10), 'third', chr(10), 'B. Background', chr(10), 'not here')
    ELSE concat('plain ', title, chr(10), chr(10), 'second paragraph ', volume) END AS text
  FROM base
),
doi_v AS (SELECT DISTINCT doi FROM base WHERE doc_id % 11 <> 0),
url_v AS (SELECT concat('https://www.agency', CAST(doc_id AS STRING), '.gov/report') AS url, doc_id % 2 = 1 AS resolves FROM base WHERE doc_id % 12 = 11)
"""


NAMES = ("base", "works_v", "refs_v", "raw_v", "body_v", "paper_v", "doi_v", "url_v")


def prefix() -> str:
    return "WITH " + CTES.strip()


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = spark.sql(f"WITH documents AS (SELECT * FROM {{docs}}), {CTES.strip()} SELECT * FROM {name}", docs=docs)
    if "authors" in df.columns:
        one = lambda x: t.author(F.split_part(x, F.lit("|"), F.lit(1)), F.split_part(x, F.lit("|"), F.lit(2)))
        df = df.withColumn("authors", F.transform(F.filter(F.split("authors", ";"), lambda x: x != ""), one))
    return df


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables above over ``sf_dir``, written once an application; string authors become arrays of records."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = kept(_made(spark, sf_dir, name), name, lasting=True)
    return _WRITTEN[key]
