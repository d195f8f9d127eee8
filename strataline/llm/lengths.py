"""Token counts as an exact histogram of encoded lengths.

Documents are encoded where they lie; each batch sends only (length, documents) pairs.  Suffix sums over the histogram
then answer, for every context limit at once, how many documents reach it, their tokens, and the tokens left if every
document is truncated to it.

Defined results: a null or empty text has length 0; equal rows count each; special-token strings are ordinary text;
an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import settle

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 256   # lengths per block of the suffix sums

_loaded: dict[str, object] = {}


def encoder(folder: str, vocabulary: str):
    """The byte-level BPE encoder of a rank file, loaded once per Python worker."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = os.path.join(folder, vocabulary)
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def histogram(docs: DataFrame, text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """length, n_docs: how many documents encode to each number of tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            found = np.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], dtype=np.int64)
            length, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["length", "n"])

    pairs = docs.select(F.col(text).cast("string")).mapInArrow(count, "length long, n long")
    return pairs.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per occurring length L: docs_ge and tokens_ge (documents of L tokens or more, and their tokens), truncated
    (tokens left when every text is cut to L), cumulative (share of documents of at most L tokens), total (all tokens).

    Blocks of lengths are summed first, so no window runs over more rows than there are blocks.
    """
    hist = settle(hist)   # texts are encoded once
    h = hist.withColumn("__block", F.floor(F.col("length") / BLOCK)).withColumn("__tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    after = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    tail = blocks.select("__block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("__d", "__t")],
                         *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("__d", "__t")])
    inside = Window.partitionBy("__block").orderBy(F.desc("length"))
    s = h.join(tail, "__block").withColumns({"docs_ge": F.col("__d_after") + F.sum("n_docs").over(inside),
                                             "tokens_ge": F.col("__t_after") + F.sum("__tokens").over(inside)})
    return s.select("length", "n_docs", "docs_ge", "tokens_ge", (F.col("__t_all") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated"),
                    ((F.col("__d_all") - F.col("docs_ge") + F.col("n_docs")) / F.col("__d_all")).alias("cumulative"), F.col("__t_all").alias("total"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """truncated totals and documents cut for any context limits, occurring as a length or not: limit, n_cut, truncated."""
    asked = sums.select(F.explode(F.array(*[F.lit(int(v)) for v in limits])).alias("limit"), "length", "docs_ge", "tokens_ge", "n_docs", "total")
    over = F.when(F.col("length") > F.col("limit"), F.struct(F.col("length"), "docs_ge", "tokens_ge"))
    first = asked.groupBy("limit").agg(F.min(over).alias("__f"), F.max("total").alias("total"))
    n = F.coalesce(F.col("__f.docs_ge"), F.lit(0))
    return first.select("limit", n.alias("n_cut"), (F.col("total") - F.coalesce(F.col("__f.tokens_ge"), F.lit(0)) + F.col("limit") * n).alias("truncated"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that a share of all documents does not exceed: share, length."""
    asked = sums.select(F.explode(F.array(*[F.lit(float(v)) for v in shares])).alias("share"), "length", "cumulative")
    return asked.where(F.col("cumulative") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
