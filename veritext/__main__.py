"""Command line: list the queries, run one over a folder of tables, parse citations."""

from __future__ import annotations

import argparse
import json


def main() -> None:
    top = argparse.ArgumentParser(prog="veritext")
    sub = top.add_subparsers(dest="what", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="write the result there as Parquet; else print its first rows")
    cite = sub.add_parser("cite", help="parse the citations of a text")
    cite.add_argument("text")
    a = top.parse_args()
    if a.what == "cite":
        from veritext.functions.citations import extract

        for c in extract(a.text):
            print(json.dumps(c))
        return
    from veritext.plans import catalogue

    if a.what == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    from pyspark.sql import SparkSession

    df = catalogue.QUERIES[a.name](SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.folder)
    if a.out:
        df.write.parquet(a.out)
    else:
        df.show(50, truncate=80)


if __name__ == "__main__":
    main()
