"""``python -m quarry.cli search QUERY``: the best documents of an index."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from quarry import logs
from quarry.operators.collectors import TopScore
from quarry.sources.index import Index


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="search an index")
    search.add_argument("query")
    search.add_argument("-l", "--limit", type=int, default=10)
    search.add_argument("-p", "--path", default=".")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args = arguments().parse_args(argv)
    logs.configure()
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    reader = Index.open(spark, args.path).reader()
    began = time.perf_counter()
    for doc_id, score in reader.search(args.query, TopScore(args.limit)):
        print(f"{doc_id}\t{score:.6f}", file=out or sys.stdout)
    print(f"{time.perf_counter() - began:.3f} s", file=out or sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
