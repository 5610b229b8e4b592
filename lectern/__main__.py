"""Command line: `python -m lectern list` and `python -m lectern run NAME --tables FOLDER [--limit N] [--out FOLDER]`."""

from __future__ import annotations

import argparse

from . import registry


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="one query, as JSON lines on the console or in a folder")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("--tables", required=True, help="folder of the Parquet tables")
    run.add_argument("--limit", type=int, default=20, help="rows on the console")
    run.add_argument("--out", help="folder for the whole result")
    args = parser.parse_args(argv)
    if args.command == "list":
        print(*sorted(registry.queries()), sep="\n")
        return
    from pyspark.sql import SparkSession

    from .sources.files import write_report

    result = registry.queries()[args.name](SparkSession.builder.getOrCreate(), args.tables)
    if args.out:
        write_report(result, args.out)
    else:
        print(*result.limit(args.limit).toJSON().collect(), sep="\n")


if __name__ == "__main__":
    main()
