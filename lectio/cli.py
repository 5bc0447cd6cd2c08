"""Command line: python -m lectio.cli list | run NAME FOLDER [--to PATH] [--format parquet] [--explain] | document FOLDER DOC_ID"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.operators import layout
from lectio.plans import catalogue
from lectio.plans.registry import Tables
from lectio.session import importable, session, sweep
from lectio.sources.papers import papers


def document(spark: SparkSession, folder: str, doc_id: int) -> str:
    """The metadata of one document as a line of JSON: title, authors and abstract."""
    docs = Tables(spark, folder)("documents", "doc_id", "text", "source", "lang").where(F.col("doc_id") == doc_id)
    labelled = layout.label_rounds(papers(docs))
    found = layout.parse_titles(labelled).join(layout.extract_abstract(labelled), "doc_id", "left").select(F.to_json(F.struct("doc_id", "title", "authors", "abstract")).alias("line")).collect()
    return found[0].line if found else json.dumps({"doc_id": doc_id, "error": "no such document"})


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectio", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of the queries")
    run = verbs.add_parser("run", help="runs a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalogue.QUERIES), metavar="NAME")
    run.add_argument("folder")
    run.add_argument("--to", help="where the result is written; without it its first twenty rows are shown")
    run.add_argument("--format", default="parquet")
    run.add_argument("--explain", action="store_true", help="shows the plan instead")
    one = verbs.add_parser("document", help="metadata of one document")
    one.add_argument("folder")
    one.add_argument("doc_id", type=int)
    args = parser.parse_args(words)
    if args.verb == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = spark or session()
    importable(spark)
    if args.verb == "document":
        print(document(spark, args.folder, args.doc_id))
        return 0
    found: DataFrame = catalogue.QUERIES[args.name](spark, args.folder)
    if args.explain:
        found.explain("formatted")
    elif args.to:
        found.write.format(args.format).mode("errorifexists").save(args.to)
    else:
        found.show(truncate=80)
    sweep(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
