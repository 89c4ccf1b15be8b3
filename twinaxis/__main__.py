"""python -m twinaxis: runs statements from arguments, a file or standard input."""

from __future__ import annotations

import argparse
import itertools
import sys
import time

from pyspark.sql import SparkSession

from .plans.session import Session
from .sources.scripts import transcript


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="twinaxis", description="Runs statements against a leaf store.")
    p.add_argument("statements", nargs="*", help="statements, run in order")
    p.add_argument("--file", help="a file of statements, one a line")
    p.add_argument("--dir", help="keep facts in this folder; without it they are gone at the end")
    p.add_argument("--tenant", type=int, default=7)
    p.add_argument("--clock", type=int, help="start the clock here and advance it by one a reading")
    p.add_argument("--rows", type=int, default=1000, help="rows of a statement that are printed")
    args = p.parse_args(argv)
    lines: list[str] = list(args.statements)
    if args.file:
        with open(args.file, encoding="utf-8") as f:
            lines += f
    if not lines and not sys.stdin.isatty():
        lines += sys.stdin
    if not lines:
        p.error("no statements: give some, a --file, or pipe them in")
    own = spark is None
    spark = spark or SparkSession.builder.appName("twinaxis").getOrCreate()
    try:
        now = time.time_ns if args.clock is None else itertools.count(args.clock).__next__
        session = Session(spark, args.dir, now=now, tenant=args.tenant)
        for line in transcript(session, lines, args.rows):
            print(line)
        session.close()
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
