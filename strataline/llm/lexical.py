"""Ranked lexical search: exact maximum inner products over sparse ball trees.

A document's score for an item is an inner product: the item's term counts times the document's vector, which holds
weight * saturated frequency for each term.  Only terms of the items can add to it, so vectors are cut to these.

1. ``vectors``: one scan counts each document's terms and its frequencies of the items' terms (found by 64-bit hashes).
2. ``distinct_vectors``: documents of equal vectors have equal scores; of each such group the k smallest doc_ids can
   be in a result and are kept, by a limit before the shuffle, so a large group of copies is one vector.
3. ``search``: vectors are range-sorted by their two strongest terms, so that those of a batch are alike; each batch becomes
   a ball tree (centroid, radius; split between two far vectors).  For an item, no vector of a ball scores more than
   q·centroid + |q| * radius; subtrees are taken best-first, and left out once this bound, rounded up by more than its
   floating-point error, is below the k-th best score.  Leaves are scored in 64-bit integers.
4. The batches' k best are ranked item by item, again with a limit before the shuffle.

Items are a stated query set: they are searched in blocks of about BLOCK bytes of text, each block against all documents.
A block's terms and weights are what is sent to all tasks.

Defined results: texts of no term, empty and null texts are in no result and do not count in N and L; an item without
terms, or whose terms stand nowhere, has no rows; rows that are equal are ranked one by one, each with a rank of its
own; null doc_ids come last among equal scores; null item_ids are kept; only the id and text columns are read; empty
tables give no rows.  Texts are read whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import n_bytes, settle
from strataline.llm.tokens import chunks, raw, word_hashes

K = 10
BLOCK = 4 << 20       # bytes of items' text searched at once
TREE = 4096           # vectors of a tree
LEAF = 32             # vectors of a leaf

_gaps = np.ones(256, bool)   # all ASCII but letters and digits parts terms
_gaps[128:] = False
_gaps[[c for c in range(128) if chr(c).isalnum()]] = False


@dataclass
class Terms:
    """The terms of a block of items: sorted hashes, and per item its id, term numbers and counts."""

    hashes: np.ndarray
    items: list[tuple[object, np.ndarray, np.ndarray]]


def block_terms(rows: list[tuple]) -> Terms:
    """Terms of the rows (item_id, text)."""
    hashed = [_hashes(text) for _, text in rows]
    every = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
    items = []
    for (i, _), h in zip(rows, hashed):
        at, counts = np.unique(np.searchsorted(every, h), return_counts=True)
        items.append((i, at, counts))
    return Terms(every, items)


def _hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), _gaps)[0]


def vectors(docs: DataFrame, doc_id: str, terms: Terms) -> DataFrame:
    """doc_id, n (terms with repeats), at (numbers of the block's terms that it holds) and tf, of all documents with a term."""
    kind = docs.schema[doc_id].dataType.simpleString()
    known = terms.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for a, b in chunks(offsets):
                h, row, _, _ = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], _gaps)
                n = np.bincount(row, minlength=b - a)
                where = np.searchsorted(known, h)
                hit = np.flatnonzero(known[np.minimum(where, len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                cells, tf = np.unique(row[hit] * np.int64(len(known)) + where[hit], return_counts=True)
                doc, at = np.divmod(cells, max(len(known), 1))
                cuts = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                out = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                       pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "at", "tf"]).filter(pa.array(n > 0))

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, at array<int>, tf array<int>")


def distinct_vectors(found: DataFrame, k: int) -> DataFrame:
    """n, at, tf, ids (the k smallest doc_ids, null last) of each different vector of at least one term."""
    keyed = found.where("size(at) > 0").withColumn("v", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.array_join(F.col("at").cast("array<string>"), " "),
                                                                           F.array_join(F.col("tf").cast("array<string>"), " ")), 256))
    order = Window.partitionBy("v").orderBy(F.col("doc_id").asc_nulls_last())
    least = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return least.groupBy("v").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("tf").alias("tf"),
                                  F.array_sort(F.collect_list(F.struct("r", "doc_id"))).alias("ids"))


class Vectors:
    """Sparse rows: indptr, at, x (float64), exact (int64)."""

    def __init__(self, indptr, at, exact, width):
        self.indptr, self.at, self.exact, self.width = indptr, at, exact, width
        self.x = exact.astype(np.float64)
        self.square = self._sums(self.x * self.x, np.arange(len(indptr) - 1))

    def _cells(self, rows):
        n = self.indptr[rows + 1] - self.indptr[rows]
        start = np.cumsum(n) - n
        return np.arange(n.sum()) - np.repeat(start - self.indptr[rows], n), start

    def _sums(self, values, rows):
        return np.add.reduceat(values, self._cells(rows)[1])   # every row holds a term

    def products(self, rows, dense):
        """The rows' inner products with a dense vector (integers stay integers)."""
        cells, start = self._cells(rows)
        values = self.exact if dense.dtype == np.int64 else self.x
        return np.add.reduceat(values[cells] * dense[self.at[cells]], start)

    def one(self, row):
        out = np.zeros(self.width)
        s = slice(self.indptr[row], self.indptr[row + 1])
        out[self.at[s]] = self.x[s]
        return out

    def centroid(self, rows):
        cells, _ = self._cells(rows)
        return np.bincount(self.at[cells], self.x[cells], self.width) / len(rows)

    def distances(self, rows, point):
        return np.sqrt(np.maximum(self.square[rows] + point @ point - 2 * self.products(rows, point), 0.0))


def ball_tree(v: Vectors, leaf: int = LEAF) -> list[tuple]:
    """Nodes (terms and values of the centroid, radius, children or None, rows), the root first.

    The radius is the largest distance and what the subtraction of squares can lose."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(v.indptr) - 1), -1)]
    while todo:
        rows, parent = todo.pop()
        c = v.centroid(rows)
        far = v.distances(rows, c)
        scale = v.square[rows].max() + c @ c
        at = np.flatnonzero(c)
        me = len(nodes)
        # a square of a distance loses less than this part of the squares that it is made from
        lost = 1e-15 * (len(at) + 8) * scale
        nodes.append([at, c[at], math.sqrt(far.max() ** 2 + lost), [], rows])
        if parent >= 0:
            nodes[parent][3].append(me)
        if len(rows) > leaf and far.max() > 0:
            a = v.one(rows[far.argmax()])
            from_a = v.distances(rows, a)
            b = v.one(rows[from_a.argmax()])
            near = from_a <= v.distances(rows, b)
            if near.all() or not near.any():
                near = np.arange(len(rows)) < len(rows) // 2
            todo += [(rows[near], me), (rows[~near], me)]
    return nodes


def search_tree(v: Vectors, nodes: list[tuple], at: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and exact scores that can be among the item's k best: all of the k-th best score and above, if over 0."""
    q = np.zeros(v.width, np.int64)
    q[at] = counts
    norm = float(np.sqrt(np.square(counts.astype(float)).sum()))

    def bound(node):
        # dot and norms lose less than 1e-9 of the sum of their parts, all of which are positive
        return (float(node[1] @ q[node[0]]) + norm * node[2]) * (1 + 1e-9) + 1.0
    heap, floor = [(-bound(nodes[0]), 0)], 1
    best = np.zeros(0, np.int64)
    rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while heap and -heap[0][0] >= floor:
        node = nodes[heapq.heappop(heap)[1]]
        if node[3]:
            for child in node[3]:
                b = bound(nodes[child])
                if b >= floor:
                    heapq.heappush(heap, (-b, child))
            continue
        s = v.products(node[4], q)
        rows.append(node[4])
        scores.append(s)
        best = np.sort(np.concatenate([best, s]))[-k:]
        if len(best) == k:
            floor = max(1, int(best[0]))
    row, score = np.concatenate(rows), np.concatenate(scores)
    good = score >= floor
    return row[good], score[good]


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 8 m), m = 25 + (75 n n_docs) div n_terms."""
    top = 75 * n_docs * int(n.max(initial=0))
    m = 25 + (75 * n_docs * n // n_terms if top < 1 << 63 else np.array([75 * n_docs * int(x) // n_terms for x in n], np.int64))
    return 10 ** 9 * tf // (1000 * tf + 8 * m)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)


def _search_block(docs: DataFrame, doc_id: str, rows: list[tuple], k: int, tree: int) -> DataFrame:
    """item (its number in rows), doc_id, score: what the trees find."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    terms = block_terms(rows)
    found = settle(vectors(docs, doc_id, terms))
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms.hashes), np.int64)
    for at, count in found.select(F.explode("at").alias("at")).groupBy("at").count().collect():   # at most the block's terms
        df[at] = count
    w = weights(df, n_docs)
    sent = spark.sparkContext.broadcast((w, [(at, counts) for _, at, counts in terms.items]))

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The two strongest terms of each vector."""
        weight = sent.value[0]
        for batch in batches:
            v, _ = _loaded(batch, weight, n_docs, n_terms)
            size = np.diff(v.indptr)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((-v.exact, row))
            one = v.at[order[v.indptr[:-1]]]
            two = v.at[order[np.minimum(v.indptr[:-1] + 1, v.indptr[1:] - 1)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32))],
                                             [*batch.schema.names, "one", "two"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items = sent.value
        for batch in _regrouped(batches, tree):
            v, ids = _loaded(batch, weight, n_docs, n_terms)
            nodes = ball_tree(v)
            found = [search_tree(v, nodes, at, counts, k) for at, counts in items]
            item = np.repeat(np.arange(len(items)), [len(r) for r, _ in found])
            row = np.concatenate([r for r, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(row)), pa.array(np.concatenate([s for _, s in found]))], ["item", "ids", "score"])

    ids = f"ids array<struct<r:int,doc_id:{kind}>>"
    fields = f"v string, n long, at array<int>, tf array<int>, {ids}"
    parts = distinct_vectors(found, k).mapInArrow(strongest, f"{fields}, one int, two int")
    alike = settle(parts).repartitionByRange("one", "two", "v").sortWithinPartitions("one", "two", "v").drop("one", "two")
    hits = alike.mapInArrow(run, f"item long, {ids}, score long")
    return hits.select("item", "score", F.inline("ids")).select("item", "doc_id", "score")


def _loaded(batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_terms: int) -> tuple[Vectors, pa.Array]:
    cols = {name: batch.column(name) for name in ("n", "at", "tf", "ids")}
    size = np.diff(cols["at"].offsets.to_numpy())
    indptr = np.concatenate(([0], np.cumsum(size)))
    at = cols["at"].flatten().to_numpy().astype(np.int64)
    tf = cols["tf"].flatten().to_numpy().astype(np.int64)
    n = np.repeat(cols["n"].to_numpy(), size)
    return Vectors(indptr, at, weight[at] * saturated(tf, n, n_docs, n_terms), len(weight)), cols["ids"]


def _regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of ``size``, or fewer at its end."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", k: int = K,
           block: int = BLOCK, tree: int = TREE) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each row of ``items``."""
    total = items.agg(F.sum(n_bytes("text"))).first()[0] or 0
    n_blocks = math.ceil(total / block) or 1
    dealt = settle(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col("text").cast("string").alias("text"),
                                F.pmod(F.xxhash64(F.col(f"`{item_id}`"), F.col("text")), F.lit(n_blocks)).alias("block")))
    out = None
    for b in range(n_blocks):
        rows = [(r.item_id, r.text) for r in dealt.where(F.col("block") == b).select("item_id", "text").collect()]
        hits = _search_block(docs, doc_id, rows, k, tree)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], f"item long, item_id {items.schema[item_id].dataType.simpleString()}")
        found = ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    return out
