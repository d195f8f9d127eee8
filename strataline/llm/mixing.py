"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, passed through up to ``most`` times.  A document's virtual
finish time is the number of words its queue has sent by its end, divided by the source's weight.  Sorted globally by
finish time, the queues advance in proportion to their weights; a queue that has made all its passes falls out and
leaves its share to the others.  The stream is cut at the virtual time at which the budget (``share`` times all words)
is spent; a document that is being sent then contributes the words sent by that time.

Defined results: a null text has no words; a null source is a source of its own, sorted last; documents without words
are never taken; equal rows are separate documents in either order; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import WORD, order_key, packed, row_digest, running_totals

WEIGHTS = (5, 2, 1)   # dealt to the sources in code point order, repeating
SHARE = 1.5           # words of the mix per word of the input
MOST = 2              # passes through a source at most


def queue_rows(docs: DataFrame, keep: list[str], seed: str = "mix") -> DataFrame:
    """``keep`` plus the queue columns __source, __id, __size (words) and __order (the shuffle)."""
    return docs.withColumn("__seed", F.lit(seed)).select(
        *keep, F.col("source").alias("__source"), F.col("doc_id").alias("__id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        order_key(row_digest("__seed", "doc_id", "text")).alias("__order"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: __key, __source, source_size, weight and target, the words it gives to the mix.

    The windows below run over this table of sources, not over documents.
    """
    s = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    s = s.withColumn("__key", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__key") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("__cap") / F.col("weight"), "__key")
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("__cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("__level", left / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("__open", F.col("__cap") > F.col("weight") * F.col("__level"))
    # the first source that its cap does not stop sets the virtual time of the cut
    first_open = F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("weight"), "__key", "__level"))).over(everything)["__level"]
    cap = F.col("__cap").cast("double")
    return s.select("__key", "__source", "source_size", "weight",
                    F.coalesce(F.least(cap, F.col("weight") * first_open), cap).alias("target"))


def schedule(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of :func:`queue_rows` with source_size, weight, target, and per pass the words sent (``sent``) and the
    virtual finish time (``finish``)."""
    aim = targets(rows, weights, share, most)
    keyed = rows.join(aim, rows["__source"].eqNullSafe(aim["__source"])).drop(aim["__source"])
    run = running_totals(keyed, "__key", "__order", [F.col("__id"), F.col("__size")], {"__before": "__size"}, rows.count())
    whole = F.floor("target")
    start = [F.lit(p) * F.col("source_size") + F.col("__before") for p in range(most)]
    return run.select(
        *rows.columns, "source_size", "weight", "target",
        F.array(*[F.greatest(F.lit(0), F.least(F.col("__size"), whole - a)).cast("long") for a in start]).alias("sent"),
        F.array(*[(a + F.col("__size")) / F.col("weight") for a in start]).alias("finish"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", partitions: int | None = None) -> DataFrame:
    """The mixed stream: the columns of ``docs``, one row per document and pass, globally sorted by virtual finish time.

    Only whole documents are given out here: the one in service at the cut counts if at least half of it was sent.
    """
    rows = queue_rows(packed(docs, "source", "doc_id", "text"), ["__doc"], seed)
    taken = schedule(rows, weights, share, most).withColumn("__pass", F.explode(F.arrays_zip("sent", "finish")))
    taken = taken.where((F.col("__pass.sent") > 0) & (F.col("__pass.sent") * 2 >= F.col("__size")))
    taken = taken.select("__doc", F.col("__pass.finish").alias("__finish"), "__order")
    by = [F.col("__finish"), F.col("__order")]
    ranged = taken.repartitionByRange(partitions, *by) if partitions else taken.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).select("__doc.*")
