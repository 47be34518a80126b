"""Record schemas (Spark DDL) of the engine."""

AUTHORS = "array<struct<family:string,given:string,orcid:string>>"
REFS = f"""doc_id bigint, ref_idx int, raw_text string, authors {AUTHORS}, title string, year int, container_title string,
volume string, issue string, pages string, publisher string, doi string, url string, arxiv_id string, pmid string, isbn string, type string"""
WORKS = f"""source string, source_id string, source_url string, authors {AUTHORS}, title string, year int, container_title string,
volume string, issue string, pages string, publisher string, doi string, arxiv_id string, pmid string, type string"""
INTEXT = "doc_id bigint, pos int, raw string, surnames array<string>, year int, indices array<int>, institutional string"

#: Order among sources where scores are equal.
SOURCES = ["crossref", "openalex", "pubmed", "semantic_scholar", "arxiv", "scholarly"]
TIERS = ["hallucinated", "partial", "verified_with_style_edits", "verified_via_url", "verified"]  # by severity
