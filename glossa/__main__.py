"""Command line: ``python -m glossa list`` and ``python -m glossa run QUERY --data DIR [--out DIR]``."""

from __future__ import annotations

import argparse

from glossa.plans import catalogue
from glossa.runtime import session


def main() -> None:
    parser = argparse.ArgumentParser(prog="glossa", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(catalogue.QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="folder for the result as parquet; shown if left out")
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    df = catalogue.QUERIES[args.query](session(), args.data)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(truncate=80)


if __name__ == "__main__":
    main()
