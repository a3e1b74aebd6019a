"""Command line: prints the report of a repository, or writes its functions as rows."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .plans.analyze import analyze


def main() -> None:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--sort")
    p.add_argument("--limit", type=int)
    p.add_argument("--include-authors", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--rows", metavar="FOLDER", help="write a JSON line for each function there instead of printing the report")
    a = p.parse_args()
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("plumbline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        found = analyze(spark, a.path, a.sort, a.limit, a.include_authors, rows=bool(a.rows))
        if a.rows:
            found.write.json(a.rows)
        else:
            print(found.first().report)
    except KeyboardInterrupt:  # the state's pointer moves only after a whole run
        logging.getLogger("plumbline").warning("interrupted; the state is as it was")
        spark.sparkContext.cancelAllJobs()
        sys.exit(130)


if __name__ == "__main__":
    main()
