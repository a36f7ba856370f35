"""Command line: python -m quern.cli --data DIR [-i FILE | SQL] [--format console|csv|null] [--explain] [--timing]"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame

from quern.engine import Engine
from quern.plans.tokens import statements, text_of
from quern.session import local_session
from quern.sources import sinks


def show(df: DataFrame, fmt: str, separator: str, out) -> None:
    if fmt == "console":
        sinks.console(df, out)
    elif fmt.endswith("csv"):
        sinks.csv_stream(df, out, separator, escape=fmt != "plaincsv")
    else:
        sinks.null(df)


def run(engine: Engine, text: str, fmt: str = "console", separator: str = ",", explain: bool = False, timing: bool = False, out=sys.stdout) -> None:
    if text.strip().startswith("\\d"):
        for column, kind in engine.catalog.describe(text.split()[1]):
            out.write(f"{column} {kind}\n")
        return
    if text.lstrip().startswith("("):
        show(engine.sexpr(text), fmt, separator, out)
        return
    for tokens in statements(text):
        started = time.time()
        said = text_of(tokens)
        if explain and not tokens[0].is_("CREATE", "EXPLAIN"):
            out.write(engine.explain(said) + "\n")
        elif tokens[0].is_("EXPLAIN"):
            out.write(engine.explain(text_of(tokens[1:])) + "\n")
        else:
            for df in engine.run(said):
                show(df, fmt, separator, out)
        if timing:
            out.write(f"Time: {1000 * (time.time() - started):.0f} ms\n")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("sql", nargs="?", help="SQL text; without it and -i, statements are read from standard input")
    parser.add_argument("--data", default=".", help="folder of <table>.parquet")
    parser.add_argument("-i", "--input", help="file of SQL text")
    parser.add_argument("--format", default="console", choices=("console", "csv", "plaincsv", "null"))
    parser.add_argument("--separator", default=",")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--timing", action="store_true")
    parser.add_argument("--cores", default="*")
    args = parser.parse_args(argv)
    if args.input:
        with open(args.input, encoding="utf-8") as file:
            text = file.read()
    else:
        text = args.sql or sys.stdin.read()
    run(Engine(local_session(args.cores), args.data), text, args.format, args.separator, args.explain, args.timing)


if __name__ == "__main__":
    main()
