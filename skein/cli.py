"""Command line: build an index of a directory, or query one."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .functions.analysis import Analyzer
from .operators.boolean import QueryError
from .plans.engine import Engine
from .sources.ingest import from_directory

SHOWN = 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m skein.cli", description=__doc__)
    sub = p.add_subparsers(dest="action", required=True)
    for name in ("build", "load"):
        one = sub.add_parser(name)
        one.add_argument("path", help="directory of text files")
        one.add_argument("--index", help="where the index lies; default: .index below path")
        one.add_argument("--no-stem", action="store_true")
        if name == "build":
            one.add_argument("--max-p", type=float, default=1.0, help="drop terms in more than this part of the documents")
            one.add_argument("--min-f", type=int, default=0, help="drop terms in this many documents or fewer")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, lines=None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    base, analyzer, docs = a.index or f"{a.path.rstrip('/')}/.index", Analyzer(stem=not a.no_stem), from_directory(spark, a.path)
    if a.action == "build":
        start = time.perf_counter()
        engine = Engine.build(docs, base, analyzer, a.max_p, a.min_f)
        took, n = time.perf_counter() - start, engine.index.stats.first().n
        print(f"Index of {n} documents built in {took:.1f} s, {n / max(took, 1e-9):.1f} documents a second")
    else:
        engine = Engine.load(spark, base, docs, analyzer)
    for line in lines if lines is not None else sys.stdin:
        if not (query := line.strip()):
            continue
        try:
            answer = engine.search(query)
        except QueryError as e:
            print(f"? {e}")
            continue
        print(f"{' '.join(answer.query)}: {len(answer.documents)} documents in {answer.time_ms} ms")
        for d in answer.documents[:SHOWN]:
            print(f"{d.score:.6f}\t{d.doc_id}\t{d.path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
