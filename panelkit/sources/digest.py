"""A table's digest that depends on its rows alone: not on files, partitions or the order they are read in.

Rows are written as text with every value's length before it, hashed, and numbered in the order of all columns by a
prefix scan. Runs of so many row digests in a row are hashed into one, these runs again, until one digest is left: each
step is a grouping whose groups are of one bounded size, so no task sees more than a run.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.lineage import settled
from panelkit.operators.scan import Scan

RUN = 1000


def encoded(df: DataFrame) -> Column:
    """A row as text, columns by name: each value with its length, missing ones as ``-``. Types count by what they write."""
    cells = [F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)]
    return F.concat_ws(",", *cells)


def table_digest(df: DataFrame, run: int = RUN) -> str:
    """SHA-256 (hex) of the rows, repeated ones included, and of the columns' names."""
    rows = df.select(F.sha2(encoded(df), 256).alias("h"))
    level = Scan(rows, [], ["h"]).number("n").result().select("h", (F.col("n") - 1).alias("n"))
    while True:
        level = settled(level.groupBy(F.floor(F.col("n") / run).cast("long").alias("n")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ""), 256).alias("h")))
        top = level.agg(F.max("n").alias("n"), F.max("h").alias("h")).first()
        if not top["n"]:
            names = ",".join(sorted(df.columns))
            return hashlib.sha256(f"{names}\n{top['h'] or ''}".encode()).hexdigest()
