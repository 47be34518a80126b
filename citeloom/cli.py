"""``python -m citeloom.cli audit|suggest``: exit codes 0, 2 (no input), 3 (nothing found), 4 (not readable)."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from .functions.styles import SUPPORTED_STYLES
from .operators import intext, verify
from .sources import catalog, files, sinks


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="citeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    audit, suggest = commands.add_parser("audit"), commands.add_parser("suggest")
    for p in (audit, suggest):
        p.add_argument("input")
        p.add_argument("--catalog", action="append", default=[], metavar="SOURCE=PATH", help="records of one source, JSON lines")
        p.add_argument("--style", choices=SUPPORTED_STYLES, default="apa")
        p.add_argument("--out", default="audit-out")
        p.add_argument("--use-scholarly", action="store_true")
    audit.add_argument("--format", "--formats", dest="formats", nargs="+", metavar="FORMAT", help="one or more, or all")
    audit.add_argument("--parser", choices=["auto", "regex", *files.PARSERS], default="auto")
    audit.add_argument("--parser-records", action="append", default=[], metavar="PARSER=PATH", help="answers of an outside parser, JSON lines (doc_id, ref_idx, value)")
    audit.add_argument("--strictness", choices=verify.STRICTNESS, default="default")
    for name in ("strict", "relaxed"):
        audit.add_argument(f"--{name}", dest="strictness", action="store_const", const=name)
    audit.add_argument("--layout", choices=sinks.LAYOUTS, default="folders")
    audit.add_argument("--this-year", type=int, default=2026)
    audit.add_argument("--dois", help="table of DOIs that resolve (doi)")
    audit.add_argument("--urls", help="table of URLs (url, resolves)")
    suggest.add_argument("--claim", action="append", default=[])
    return parser.parse_args(argv)


def _told(unread: DataFrame, shown: int = 20) -> bool:
    """Says on the error stream what could not be read, the first few by name; whether there is any."""
    first = unread.limit(shown).collect()
    for row in first:
        print("not read:", *row, file=sys.stderr)
    return bool(first)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = SparkSession.builder.appName("citeloom").getOrCreate()
    table = lambda path, ddl: spark.read.schema(ddl).parquet(path) if path else spark.createDataFrame([], ddl)
    try:
        works = catalog.read_catalog(spark, dict(x.split("=", 1) for x in args.catalog))
        if args.command == "suggest":
            if not args.claim:
                docs = files.read_documents(spark, args.input)
                claims = intext.claims(docs)
                if claims.isEmpty() and _told(docs.where("error IS NOT NULL").select("path", "error")):
                    return 4
            else:
                claims = spark.createDataFrame([(0, i, c) for i, c in enumerate(args.claim)], "doc_id bigint, pos int, claim string")
            if claims.isEmpty():
                return 3
            sinks.suggestions(claims, works, args.style, use_scholarly=args.use_scholarly).write.mode("overwrite").json(args.out)
            return 0
        readers = {"anystyle": files.from_parser_records, "grobid": files.from_tei}
        records = {k: readers[k](spark.read.schema("doc_id long, ref_idx int, value string").json(v)) for k, v in (x.split("=", 1) for x in args.parser_records)}
        refs, cited = files.read(spark, args.input, records, args.parser)
        unread = _told(files.unreadable(spark, args.input))
        if refs.isEmpty():
            return 4 if unread else 3
        results = verify.audit(refs, works, table(args.dois, "doi string"), table(args.urls, "url string, resolves boolean"), args.strictness, args.this_year, args.use_scholarly)
        checks = {"duplicates": verify.duplicates(results)}
        if not cited.isEmpty():
            checks |= {"orphans": intext.orphans(cited, refs), "unused": intext.unused(cited, refs)}
        print(sinks.write_all(results, args.style, args.out, sinks.formats_for(args.input, ",".join(args.formats) if args.formats else None), layout=args.layout, **checks))
        done = spark.read.parquet(f"{args.out}/results")
        verify.tier_counts(done).show(truncate=False)
        none = done.select("doc_id").limit(0)
        sinks.counts(done, checks.get("orphans", none), checks.get("unused", none), checks["duplicates"]).show(truncate=False)
        return 0
    except AnalysisException as e:
        print(e, file=sys.stderr)
        return 2
    except PySparkException as e:
        print(e, file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(main())
