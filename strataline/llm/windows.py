"""Substring dedup by Rabin-Karp hashes of every fixed-length token window.

Words are kept as they are written.  A word's two values are polynomials of its bytes modulo 2**64, a window's two hashes
polynomials of its words' values, all from prefix sums, so a window costs the same for any length.

Texts are hashed in chunks of up to CHUNK bytes.  Of a window that stands several times in a chunk only the first place
under the smallest doc_id goes on: under larger ones it is already known to repeat, and a window that repeats inside
its document is asked for once and looked up again when the document is cut.  So a passage that a third of all
documents hold, however often, sends one place per chunk.  The windows of a chunk are dealt to shards by the first hash and packed: the second hash, a byte of the first and a byte or two of
place.  A shard, of about SHARD bytes of text, is one bounded group.  72 bits tell its windows apart, so of the 1.5e13
windows of 100 TB of text 0.01 would be taken for an equal of another.  It sorts hashes and returns the places whose window also starts
in a document with a smaller doc_id.  Places meet again by document (packed
by buckets of documents), where covered words merge into maximal intervals.

Defined results: null and empty texts, and texts of fewer words than a window, lose nothing; several rows with one
doc_id are not smaller than each other, so repeated rows stay whole; null doc_ids count as larger than all others; other
columns, whatever their names, only pass through; an empty table gives no rows; a text longer than CHUNK is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import free_names, n_bytes, packed
from strataline.llm.tokens import chunks, mix, raw

LENGTH = 13            # words of a window
CHUNK = 8 << 20        # bytes of text whose windows are compared before they are sent
SHARD = 32 << 20       # bytes of text per shard of hashes

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_codes = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) | np.uint64(1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_bases = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lane's base to the power of i and -i modulo 2**64, i < n."""
    if lane not in _cache or len(_cache[lane][0]) < n:
        both = []
        for base in (_bases[lane], pow(_bases[lane], -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _cache[lane] = tuple(both)
    up, down = _cache[lane]
    return up[:n], down[:n]


def _polynomials(values: np.ndarray, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each run values[start:end]: the sum of values[i] * base**(i - start)."""
    up, down = _powers(lane, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[end] - total[start]) * down[start]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each row (one more for the end)."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return start, end, np.searchsorted(start, offsets)


def window_hashes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of some rows, the number of its first word, and the first word of each row."""
    start, end, first = word_bounds(data, offsets)
    n = len(start)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(n) + length <= first[1:][row]) if n else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at, first
    h = []
    for lane in (0, 1):
        words = mix(_polynomials(_codes[lane][data], lane, start, end) + (end - start).astype(np.uint64))
        h.append(mix(_polynomials(words, lane, at, at + length)))
    return h[0], h[1], at, first


def _order(h: np.ndarray, g: np.ndarray, rank: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows whose first hash repeats: their indexes, sorted by both hashes, rank and tag; whether each is the first
    of these four; and the smallest rank of its window."""
    by = np.argsort(h, kind="stable")
    s = h[by]
    same = s[1:] == s[:-1]
    twin = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(s) else np.zeros(0, bool)
    by = by[twin]
    by = by[np.lexsort((tag[by], rank[by], g[by], h[by]))]

    def first(*keys):
        new = np.ones(len(by), bool)
        new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
        return new
    window = first(h, g)
    return by, first(h, g, rank, tag), rank[by][np.maximum.accumulate(np.where(window, np.arange(len(by)), 0))]


def _ranks(ids: pa.Array) -> np.ndarray:
    """Equal numbers for equal ids, in their order, null last."""
    if not len(ids):
        return np.zeros(0, np.int64)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _steps(at: np.ndarray) -> bytes:
    """Ascending places as one byte for each step, with 255 for a part of a wider one; or, if shorter, as four bytes each (the
    first byte tells)."""
    d = np.diff(at, prepend=0)
    if not len(d) or int((d // 255).sum()) > 3 * len(d):
        return b"\4" + at.astype("<u4").tobytes()
    out = np.full(int((d // 255).sum()) + len(d), 255, np.uint8)
    out[np.cumsum(d // 255 + 1) - 1] = d % 255
    return b"\1" + out.tobytes()


def _places(b: bytes) -> np.ndarray:
    if b[:1] == b"\4":
        return np.frombuffer(b, "<u4", offset=1).astype(np.int64)
    x = np.frombuffer(b, np.uint8, offset=1)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def _windows(docs: DataFrame, doc_id: str, length: int, shards: int, chunk: int) -> DataFrame:
    """Packed windows: shard, ids, tags and first words of the documents they are from, h and g (the second hash and a byte of the first), at (places), and
    known (places whose window stands in the same chunk under a smaller doc_id)."""
    kind = docs.schema[doc_id].dataType

    def hashed(data, offsets):
        """window_hashes of any number of rows, about a megabyte at a time."""
        parts, words, firsts = [], 0, [np.zeros(1, np.int64)]
        for a, b in chunks(offsets):
            h, g, at, first = window_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], length)
            parts.append((h, g, at + words))
            firsts.append(first[1:] + words)
            words += int(first[-1])
        return *(np.concatenate(x) for x in zip(*parts)), np.concatenate(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            for a, b in chunks(offsets, chunk):
                h, g, at, first = hashed(data, offsets[a:b + 1])
                if not len(at):
                    continue
                ids, tags = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                doc = np.searchsorted(first, at, "right") - 1
                rank = _ranks(ids)[doc]
                by, new, low = _order(g, h, rank, tags.to_numpy(zero_copy_only=False)[doc])
                goes, knows = np.ones(len(at), bool), np.zeros(len(at), bool)
                goes[by] = new & (rank[by] == low)         # texts of one doc_id all have to ask
                knows[by] = rank[by] > low
                yield deal(h, g, at, first, doc, goes, knows, ids, tags)

    def deal(h, g, at, first, doc, goes, knows, ids, tags):
        """A row for each shard that gets something."""
        shard = np.where(goes, (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), doc.astype(np.uint64) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        order = order[(goes | knows)[order]]
        shard, doc, at, out = shard[order], doc[order], at[order], goes[order]
        start = np.flatnonzero(np.diff(shard, prepend=-1))
        own = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))     # documents of each shard
        cuts = pa.array(np.append(np.searchsorted(own, start), len(own)).astype(np.int32))
        pick = pa.array(doc[own])
        hs, gs, steps, known = [], [], [], []
        for part, goes_, at_ in zip(np.split(order, start[1:]), np.split(out, start[1:]), np.split(at, start[1:])):
            hs.append(g[part[goes_]].tobytes())
            gs.append(h[part[goes_]].astype(np.uint8).tobytes())
            steps.append(_steps(at_[goes_]))
            known.append(_steps(at_[~goes_]))
        lists = [pa.ListArray.from_arrays(cuts, x) for x in (ids.take(pick), tags.take(pick), pa.array(first[doc[own]].astype(np.int32)))]
        return pa.RecordBatch.from_arrays([pa.array(shard[start]), *lists, *[pa.array(x, pa.binary()) for x in (hs, gs, steps, known)]],
                                          ["shard", "ids", "tags", "first", "h", "g", "at", "known"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{doc_id}`"), "text").alias("tag"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, f"shard long, ids array<{kind.simpleString()}>, tags array<long>, first array<int>, h binary, g binary, at binary, known binary")


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", length: int = LENGTH, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """id, tag (digest of id and text) and places (packed numbers of first words) of the windows that also start under a smaller id."""
    total = docs.agg(F.sum(n_bytes("text"))).first()[0] or 0
    shards = math.ceil(total / shard) + 1
    kind = docs.schema[doc_id].dataType.simpleString()

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        id_, tag, first = (table.column(name).combine_chunks().flatten() for name in ("ids", "tags", "first"))
        first, base, parts = first.to_numpy(), 0, []
        for lists, at, known in zip(table.column("ids").combine_chunks().value_lengths().to_pylist(), table.column("at"), table.column("known")):
            own = first[base:base + lists]
            for b in (at, known):
                x = _places(b.as_buffer().to_pybytes())
                doc = np.searchsorted(own, x, "right") - 1
                parts.append(((doc + base).astype(np.int32), (x - own[doc]).astype(np.int32)))
            base += lists
        doc, at = (np.concatenate(x) for x in zip(*parts[::2]))
        h = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("h")])
        g = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("g")])
        rank = _ranks(id_).astype(np.int32)[doc]
        by, _, low = _order(h, g, rank, doc)
        hit = by[rank[by] > low]
        known = [np.concatenate(x) for x in zip(*parts[1::2])]
        doc, at = np.concatenate([doc[hit], known[0]]), np.concatenate([at[hit], known[1]])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        own, start = np.unique(doc, return_index=True)
        steps = [_steps(x) for x in np.split(at, start[1:])] if len(own) else []
        tags = tag.to_numpy(zero_copy_only=False)[own]
        bucket = (tags.view(np.uint64) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(cuts, len(own)).astype(np.int32)), x)
                 for x in (id_.take(pa.array(own[order])), pa.array(tags[order]), pa.array([steps[i] for i in order], pa.binary()))]
        return pa.table([pa.array(bucket[order][cuts]), *lists], ["bucket", "ids", "tags", "places"])

    def gather(table: pa.Table) -> pa.Table:
        flat = pa.table({name: table.column(to).combine_chunks().flatten() for name, to in (("id", "ids"), ("tag", "tags"), ("places", "places"))})
        return flat.group_by(["id", "tag"]).aggregate([("places", "list")]).rename_columns(["id", "tag", "places"])

    # a shard answers with one row for each bucket of documents; a bucket holds the answers to its documents
    found = _windows(docs, doc_id, length, shards, chunk).groupBy("shard").applyInArrow(
        find, f"bucket long, ids array<{kind}>, tags array<long>, places array<binary>")
    return found.groupBy("bucket").applyInArrow(gather, f"id {kind}, tag long, places array<binary>")


def _removed(text: bytes, places: list[bytes], n: int, length: int) -> np.ndarray:
    """Which of n words lie in a window that stands at one of the places, or is equal to one that does."""
    h, _, at, _ = window_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), length)   # at: 0, 1, 2, …
    hit = at[np.isin(h, h[np.concatenate([_places(p) for p in places])])]
    edge = np.zeros(n + 1, np.int64)
    edge[hit] += 1
    edge[hit + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(docs: DataFrame, make, schema: str, doc_id: str, length: int, keep: list[str], sizes: dict[str, int]) -> DataFrame:
    """make(text, lists of places, length) of each document, beside the columns ``keep`` in __doc."""
    found = repeated_places(docs, doc_id, length, **sizes)
    rows = packed(docs, F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{doc_id}`"), "text").alias("tag"))
    both = rows.join(found, rows["id"].eqNullSafe(found["id"]) & (rows["tag"] == found["tag"]), "left")
    both = both.select(F.struct(*[F.col(f"__doc.`{c}`") for c in keep]).alias("__doc"), F.col("__doc.text").cast("string").alias("text"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [make(t.encode() if t is not None else b"", p or [], length) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([c[k] for c in cells], f.type) for k, f in enumerate(fields)]],
                                             ["__doc", *[f.name for f in fields]])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    return both.mapInArrow(run, f"__doc {both.schema['__doc'].dataType.simpleString()}, {schema}")


def _spans(text: bytes, places: list[bytes], length: int) -> tuple:
    """Number of words, maximal removed intervals (first word, end), kept words joined by one space."""
    words = text.split()
    if not places:
        return len(words), [], b" ".join(words).decode()
    gone = _removed(text, places, len(words), length)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return len(words), [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)], b" ".join(compress(words, ~gone)).decode()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", length: int = LENGTH, **sizes: int) -> DataFrame:
    """The documents with three more columns (renamed where taken): n_words, removed (intervals of words), kept_text."""
    names = free_names(docs, "n_words", "removed", "kept_text")
    out = _cut(docs, _spans, "n_words long, removed array<struct<start:long,end:long>>, kept_text string", doc_id, length, docs.columns, sizes)
    return out.select("__doc.*", *[F.col(c).alias(name) for c, name in zip(("n_words", "removed", "kept_text"), names)])


def _digest(text: bytes, places: list[bytes], length: int) -> tuple:
    words = text.split()
    gone = _removed(text, places, len(words), length) if places else np.zeros(0, bool)
    kept = b" ".join(compress(words, ~gone) if places else words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def report(docs: DataFrame, doc_id: str = "doc_id", length: int = LENGTH, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per document."""
    out = _cut(docs.select(doc_id, "text"), _digest, "n_words long, n_removed long, kept_sha256 string", doc_id, length, [doc_id], sizes)
    return out.select(F.col(f"__doc.`{doc_id}`").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
