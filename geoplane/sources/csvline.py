"""Quoted-field split of one CSV line (ING-7), used for the header line only.

Data rows go through Spark's CSV source with the same rules (quote ``"``,
doubled quote as escape, separator inside quotes kept); the header line goes
through the standard library's reader, and columns of lines through ``from_csv``.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_line(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep, quotechar='"', doublequote=True), [""])


def split_fields(line: Column, sep: str, n: int) -> Column:
    """The first ``n`` fields of a column of lines as an array of texts (empty and missing fields: empty)."""
    schema = ", ".join(f"f{i} string" for i in range(n))
    row = F.from_csv(line, schema, {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0000",
                                    "emptyValue": ""})
    return F.array(*[F.coalesce(row[f"f{i}"], F.lit("")) for i in range(n)])
