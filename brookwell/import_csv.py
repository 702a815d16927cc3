"""python -m brookwell.import_csv FILE --root DIR [--table NAME]: a CSV file or folder into a table of text columns."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .session import Engine
from .sources.csv import skipped


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("file")
    p.add_argument("--root", required=True, help="folder of the tables")
    p.add_argument("--table", default="transactions")
    p.add_argument("--delimiter", default=",")
    args = p.parse_args(argv)
    # how many tasks read at once is the session's (spark-submit) to say
    spark = SparkSession.builder.appName("import_csv").getOrCreate()
    began = time.time()
    n = Engine(spark, args.root).import_csv(args.file, args.table, args.delimiter)
    seconds = time.time() - began
    print(f"{n} rows in {seconds:.1f} s, {n / max(seconds, 1e-9):.0f} a second; {skipped(spark, args.file, args.delimiter)} left out")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
