"""Where results go: an aligned console table, CSV (to a stream or by Spark), or nowhere."""

from __future__ import annotations

import csv
from typing import TextIO

from pyspark.sql import DataFrame


def shown(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "t" if value else "f"
    return str(value)


def console(df: DataFrame, out: TextIO, page: int = 1000) -> int:
    """Prints an aligned table, ``page`` rows at a time; returns the number of rows."""
    names = df.columns
    right = [not kind.startswith(("string", "date", "timestamp", "bool", "array", "struct", "map")) for _, kind in df.dtypes]
    total, rows = 0, []

    def flush() -> None:
        widths = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
        if total <= page:
            out.write(" " + " | ".join(n.center(w) for n, w in zip(names, widths, strict=True)).rstrip() + "\n")
            out.write("-" + "-+-".join("-" * w for w in widths) + "-\n")
        for r in rows:
            cells = [c.rjust(w) if up else c.ljust(w) for c, w, up in zip(r, widths, right, strict=True)]
            out.write(" " + " | ".join(cells).rstrip() + "\n")
        rows.clear()

    for row in df.toLocalIterator():
        rows.append([shown(v) for v in row])
        total += 1
        if len(rows) == page:
            flush()
    if rows or not total:
        flush()
    out.write(f"({total} row{'s' if total != 1 else ''})\n")
    return total


def csv_stream(df: DataFrame, out: TextIO, separator: str = ",", escape: bool = True, header: bool = True) -> int:
    """Writes rows as they come; without ``escape`` values are written as they are."""
    total = 0
    writer = csv.writer(out, delimiter=separator, lineterminator="\n")
    put = writer.writerow if escape else (lambda r: out.write(separator.join(r) + "\n"))
    if header:
        put(df.columns)
    for row in df.toLocalIterator():
        put([shown(v) for v in row])
        total += 1
    return total


def csv_files(df: DataFrame, path: str, separator: str = ",") -> None:
    """CSV written by the executors, for results of any size."""
    df.write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def null(df: DataFrame) -> None:
    """Computes all rows and keeps none."""
    df.write.format("noop").mode("overwrite").save()
