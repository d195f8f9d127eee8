"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.plans.sizing import settle

__all__ = ["WORD", "cut", "free_names", "packed", "settle", "words", "n_bytes", "order_key", "row_digest", "running_totals"]

WORD = r"[^\x20\x09-\x0D]+"   # a word: anything but ASCII white space


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, changed where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def packed(docs: DataFrame, *also: str) -> DataFrame:
    """Each row whole in one column __doc, and some of its columns: nothing that is added can clash with its names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *also)


def cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small batches, where rows are large: what a Python task makes of a batch grows with ``rows`` only."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def words(text: str) -> Column:
    """The words of a text column; none for null."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def n_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def row_digest(*columns: str) -> Column:
    """Hexadecimal digest of a row's columns; nulls and the empty string count as one."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def order_key(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest as a long from 0."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def running_totals(rows: DataFrame, key: str, order: str, ties: list[Column], values: dict[str, str], n: int) -> DataFrame:
    """Exclusive running sums within ``key`` in the order of (``order``, ``ties``), one column ``out`` per ``out: value``.

    ``order`` is an evenly spread long from 0 below 2**60.  The order is cut into about sqrt(n) ranges (n: rows in all):
    sums per range are carried forward in one window of sqrt(n) rows per key, and rows are sorted inside their range,
    so a key with any share of all rows is spread over sqrt(n) small groups.  ``key`` must not be null.
    """
    parts = max(64, math.isqrt(max(n, 1)) + 1)
    cut = rows.withColumn("__range", F.shiftright(F.shiftright(F.col(order), 30) * F.lit(parts).cast("long"), 30))
    sums = cut.groupBy(key, "__range").agg(*[F.sum(v).alias(f"__{o}") for o, v in values.items()])
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, "__range", *[F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in values])
    inside = Window.partitionBy(key, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(carried, [key, "__range"])
    return out.select(*rows.columns, *[(F.col(f"__{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).cast("long").alias(o)
                                       for o, v in values.items()])
