"""Shards along a Hilbert curve over several metadata dimensions, for file pruning.

Each dimension is quantised to ``bits`` bits; a row's cell gets its index on the Hilbert curve; rows are ordered by
(index, digest of the row) and the order is cut into runs.  Neighbours on the curve are close in every dimension, so a
run covers few values of each and a filter on any of them skips most files.

Law ``rows``: run lengths differ by one at most.  Law ``bytes``: runs are cut where their sizes come out nearest equal.

Defined results: a null text has size 1 and checksum 0; null metadata are a value of their own (cell 0); equal rows
are placed next to each other in either order; an empty table gives no rows; a table of fewer rows than shards leaves
some shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import n_bytes, order_key, row_digest, running_totals, settle

SHARDS = 16
BITS = 4


def name_level(column: str, bits: int = BITS) -> Column:
    """A name as a level: its checksum modulo the number of levels."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def size_level(size: Column, bits: int = BITS) -> Column:
    """A positive number as a level: its power of two, clipped."""
    return F.coalesce(F.least(F.floor(F.log2(size)), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def hilbert_index(axes: list[str], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of integer axes below 2**bits (Skilling's transform, JVM side)."""
    n = len(axes)
    steps = ",".join(f"named_struct('q', {1 << b}, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    undone = f"""aggregate(array({steps}), array({','.join(axes)}), (x, s) -> transform(x, (v, j) ->
        CASE WHEN (x[s.i] & s.q) <> 0 THEN if(j = 0, v ^ (s.q - 1), v)
             WHEN j = 0 OR j = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) ELSE v END))"""
    gray = f"aggregate(sequence(1, {n - 1}), {undone}, (x, i) -> transform(x, (v, j) -> if(j = i, v ^ x[i - 1], v)))" if n > 1 else undone
    flips = ",".join(str(1 << b) for b in range(bits - 1, 0, -1))
    turned = f"""transform(array({gray}), g -> transform(g, v -> v ^ aggregate(array({flips}), 0, (t, q) ->
        if((g[{n - 1}] & q) <> 0, t ^ (q - 1), t))))[0]"""
    places = ",".join(f"named_struct('b', {b}, 'i', {i})" for b in range(bits - 1, -1, -1) for i in range(n))
    return F.expr(f"""aggregate(array({places}), named_struct('x', {turned}, 'h', 0L), (a, s) ->
        named_struct('x', a.x, 'h', a.h * 2 + ((shiftright(a.x[s.i], s.b) & 1))), a -> a.h)""")


def place(rows: DataFrame, axes: dict[str, Column], size: str, order: str, ties: list[Column], shards: int = SHARDS,
          law: str = "rows", bits: int = BITS) -> DataFrame:
    """``rows`` with shard and slot.  ``order`` is an evenly spread long below 2**60 that orders the rows of a cell."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    names = [f"__axis{i}" for i in range(len(axes))]
    cell = sum((F.col(a) * F.lit(1 << (bits * i)) for i, a in enumerate(names)), F.lit(0))
    rows = settle(rows.withColumns(dict(zip(names, axes.values()))).withColumn("__cell", cell))
    # at most 2**(bits * axes) cells: the windows below run over them, not over rows
    cells = rows.groupBy("__cell", *names).agg(F.count(F.lit(1)).alias("__rows"), F.sum(size).alias("__bytes"))
    cells = cells.withColumn("__h", hilbert_index(names, bits))
    along = Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cells = cells.select("__cell", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}_before") for c in ("__rows", "__bytes")],
                         *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("__rows", "__bytes")])
    placed = running_totals(rows.withColumn("__one", F.lit(1)), "__cell", order, ties,
                            {"__rank": "__one", "__sum": size}, rows.count()).join(cells, "__cell")
    rank = F.col("__rank") + F.col("__rows_before")
    if law == "rows":
        shard = F.expr(f"({shards} * (__rank + __rows_before)) div __rows_all")
        slot = rank - F.expr(f"((({shards} * (__rank + __rows_before)) div __rows_all) * __rows_all + {shards - 1}) div {shards}")
        return placed.select(*[c for c in rows.columns if not c.startswith("__axis") and c != "__cell"],
                             shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    middle = F.expr(f"((__sum + __bytes_before) * 2 + {size}) * {shards} div (2 * __bytes_all)")
    placed = settle(placed.select(*[c for c in rows.columns if not c.startswith("__axis") and c != "__cell"],
                                  F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"), rank.alias("__rank")))
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))
    return placed.join(first, "shard").withColumn("slot", F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard.

    Dimensions: source, language and size.
    """
    rows = docs.select(
        "doc_id", (n_bytes("text") + 1).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("source").alias("__source"), F.col("lang").alias("__lang"), order_key(row_digest("text", "doc_id")).alias("__order"))
    axes = {"source": name_level("__source"), "lang": name_level("__lang"), "size": size_level(F.col("size"))}
    out = place(rows, axes, "size", "__order", [F.col("text_crc32"), F.col("doc_id")], shards, law)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard; rows in slot order inside."""
    (rows.repartition(F.col(shard)).sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path))
