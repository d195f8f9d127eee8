"""Near-duplicate detection by one-permutation MinHash.

A document's set holds its distinct shingles of five words (A-Z lower-cased); a shorter document is one shingle.  All
shingles are hashed once and dealt into bins by their leading bits; a bin keeps its smallest hash, and an empty bin
borrows from a bin picked by a hash of (bin, attempt), the same for every document (optimal densification).  Bands of
bins give bucket keys.  Inside a bucket the candidates form a star around one hub, the document of largest total bucket
size, so a bucket of n documents gives n - 1 pairs; pairs are confirmed on full sets.  In a bucket that is still in
several components, pairs that share a rare shingle (one of at most RARE open documents) are tested if they can reach the
threshold at all.  Then stars go on: each turn another member of a bucket's largest component is the hub of all that
are not in it, so a turn makes at most one pair per member and bucket, as long as turns find links.  What is still apart
then is mostly apart for good: a pair of two components is tested if its bounds allow a link, from the numbers of
shingles and of frequent ones, counted in PARTS parts of all hashes.  So no pair of a bucket that could join two
components is left untested, and few of those that cannot are tested.

Equal sets are one node, so copies cost nothing.  Defined results: documents without words have an empty set and
are linked with nothing; equal doc_ids are one identity (smallest doc_id of a component); null doc_ids are ignored when
the smallest is sought; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import packed, row_digest, settle
from strataline.llm.tokens import chunks, mix, raw, word_hashes

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4    # a pair at the threshold is missed with probability (1 - 0.75**4)**32, 5 in a million
BINS = BANDS * ROWS
RARE = 5               # documents up to which a shingle counts as rare
LITTLE = 100           # stars end with a turn that finds fewer links than this part of the open bucket entries
PARTS = 32             # parts of all hashes in which frequent shingles are counted

_weights = mix(np.arange(1, WORDS + 2, dtype=np.uint64))
_bounds = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = raw(texts)
    for a, b in chunks(offsets):
        off = offsets[a:b + 1] - offsets[a]
        h, row, _, _ = word_hashes(data[offsets[a]:offsets[b]], off)
        first = np.searchsorted(row, np.arange(b - a + 1))
        if len(h) >= WORDS:
            g = sum((h[i:len(h) - WORDS + 1 + i] * _weights[i] for i in range(WORDS)), np.uint64(0))
            g = mix(g)
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            if e - s >= WORDS:
                u = np.sort(g[s:e - WORDS + 1])
                yield u[np.concatenate(([True], u[1:] != u[:-1]))]
            elif e > s:   # the whole sequence as one shingle
                yield mix((h[s:e] * _weights[:e - s]).sum(dtype=np.uint64, keepdims=True) + _weights[WORDS:] * np.array([e - s], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One value per bin and set, densified; all sets hold something."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, u in enumerate(sets):
        at = np.searchsorted(u, _bounds)
        full[i] = np.diff(at, append=len(u)) > 0
        sig[i, full[i]] = u[at[full[i]]]
    row, bin_ = np.nonzero(~full)
    own, have, attempt = sig.copy(), full, 0
    while len(row):
        attempt += 1
        pick = (mix(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt << 20)) % np.uint64(BINS)).astype(np.int64)[bin_]
        good = have[row, pick]
        sig[row[good], bin_[good]] = own[row[good], pick[good]]
        row, bin_ = row[~good], bin_[~good]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _weights[0]
    for r in range(ROWS):
        h = mix(h + rows[:, :, r] * _weights[1])
    return h.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, __row (digest of doc_id and text), n_shingles, node (digest of the set) and bands of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(2)))
            n = np.array([len(u) for u in sets], np.int64)
            filled = np.flatnonzero(n)
            keys = band_keys(signatures([sets[i] for i in filled])) if len(filled) else np.zeros((0, BANDS), np.int64)
            size = np.where(n > 0, BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(keys.ravel()))
            nodes = pa.array([hashlib.md5(u.tobytes()).digest() for u in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), nodes, bands],
                                             ["doc_id", "__row", "n_shingles", "node", "bands"])

    rows = docs.select("doc_id", F.unhex(row_digest("doc_id", "text")).alias("__row"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, __row binary, n_shingles long, node binary, bands array<long>")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, z (the packed text) of the wanted (__row, node): a packed text is a third of its shingle hashes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, offsets = raw(batch.column(1))
            buf = memoryview(x)
            z = [zlib.compress(buf[a:b], 4) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["__row", "z"])

    rows = docs.select(F.unhex(row_digest("doc_id", "text")).alias("__row"), F.col("text").cast("string")).mapInArrow(pack, "__row binary, z binary")
    once = rows.groupBy("__row").agg(F.first("z").alias("z"))   # repeated rows meet map-side
    return once.join(wanted, "__row").select("node", "z")


def _unpacked(z: pa.Array) -> Iterator[np.ndarray]:
    """The shingle sets of packed texts; a run of the same text is worked on once."""
    last, held = None, None
    for v in z:
        b = v.as_buffer().to_pybytes()
        if b != last:
            last, held = b, next(shingle_sets(pa.array([zlib.decompress(b).decode()])))
        yield held


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(_unpacked(batch.column(2)), _unpacked(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield kept

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("x")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("z").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b): alternating large and small stars until all edges are stars."""
    def unfinished(e):
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child + root > 1").isEmpty()

    e = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while unfinished(e):   # a node has two parents, or is a parent and has one
        both = e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = settle(small.union(least.toDF("a", "b")).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()


def node_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, h: the shingles of the nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, u in enumerate(_unpacked(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(u), i))), pa.array(u.view(np.int64))], ["node", "h"])

    return texts.join(nodes, "node", "left_semi").mapInArrow(run, "node binary, h long")


def rare_shingles(members: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the members' nodes: node, n, shared (how many of its shingles stand in more than RARE of the nodes) and parts (these,
    counted in PARTS parts of all hashes); and the pairs (a, b) that share rarer shingles and could reach the threshold.

    Two sets share at most their common rare shingles and, part by part, the smaller of their numbers of others.
    """
    nodes = settle(members.select("node", "n").distinct())
    shingles = node_shingles(nodes.select("node"), texts)
    few = settle(shingles.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE))
    part = F.pmod("h", F.lit(PARTS))
    marked = shingles.join(few, "h", "left")
    counts = marked.groupBy("node").agg(*[F.count(F.when(F.col("k").isNull() & (part == i), 1)).cast("int").alias(f"p{i}") for i in range(PARTS)])
    sizes = settle(nodes.join(counts, "node").select("node", "n", F.array(*[f"p{i}" for i in range(PARTS)]).alias("parts"),
                                                     sum((F.col(f"p{i}") for i in range(1, PARTS)), F.col("p0")).alias("shared")))
    # at most RARE nodes a list
    lists = shingles.join(few.where("k > 1"), "h").groupBy("h").agg(F.array_sort(F.collect_list("node")).alias("x"))
    pairs = lists.select(F.posexplode("x").alias("i", "b"), "x").select("b", F.explode(F.slice("x", F.lit(1), F.col("i"))).alias("a"))
    pairs = pairs.groupBy("b", "a").agg(F.count(F.lit(1)).alias("common"))
    side = lambda c: sizes.select(F.col("node").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "shared", "parts")])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(could_link("a", "b", percent, F.col("common")))
    return sizes, near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def could_link(a: str, b: str, percent: int, common: Column | int = 0) -> Column:
    """Whether two sets (columns n, shared and parts with these suffixes) can reach the threshold with ``common`` rare shingles."""
    def reached(most):
        return 100 * most >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}") - most)
    by_part = sum((F.least(F.get(f"parts_{a}", F.lit(i)), F.get(f"parts_{b}", F.lit(i))) for i in range(PARTS)), F.lit(0))
    common = F.lit(common) if isinstance(common, int) else common
    return reached(common + F.least(f"shared_{a}", f"shared_{b}")) & reached(common + by_part)


def still_open(members: DataFrame, percent: int) -> DataFrame:
    """The members that may still join two components: a set with too few frequent shingles (``shared``) cannot be linked
    by these in its bucket, and a bucket of one component has nothing left to join.

    Two sets have at most min(shared) frequent shingles in common, and none is smaller than the smallest of the bucket.
    """
    least = members.groupBy("key").agg(F.min("n").alias("least"))
    members = members.join(least, "key").where(F.expr(f"100 * shared >= {percent} * (n + greatest(least, shared) - shared)")).drop("least")
    return _mixed(members)


def group_roots(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, root of every node that is linked with another."""
    nodes = settle(sketches.where("n_shingles > 0").groupBy("node").agg(
        F.first("bands").alias("bands"), F.min("__row").alias("__row"), F.first("n_shingles").alias("n")))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))   # a join can then split a large key
    members = settle(keyed.join(shared, "key"))
    rank = members.groupBy("node").agg(F.sum("size").alias("score")).join(nodes.select("node", "__row", "n"), "node")
    rank = settle(rank)
    texts = settle(packed_texts(docs, rank.select("node", "__row")))
    # every member is in a component of its own at first, and one hub is found by partial maxima
    members = members.select("key", "node").join(rank.select("node", "score", "n"), "node")
    hubs = members.groupBy("key").agg(F.max(F.struct("score", "node")).alias("top")).select("key", F.col("top.node").alias("hub"))
    members = settle(members.join(settle(hubs), "key").where("node != hub"))
    tested = settle(members.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())
    stars = components(confirm(tested, texts, percent))
    # on with the buckets whose other members are in more than one component
    members = settle(_mixed(_labelled(members.select("key", "node", "n"), stars)))
    if members.isEmpty():
        return stars
    # pairs with rare shingles in common are tested one by one; stars and bounds are for those that only share frequent ones
    sizes, rare = rare_shingles(members, texts, percent)
    members = members.select("key", "node").join(sizes, "node")
    turn, star, late = 0, True, None
    while True:
        members = settle(still_open(_labelled(members, stars), percent))
        open_ = members.count()
        if not open_ and turn:
            return stars
        one = members.toDF(*[f"{c}_a" if c != "key" else c for c in members.columns])
        turn += 1
        if star:
            # a star around another member of each bucket's largest component, for all who are not in it
            labels = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct(
                F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "n", "shared", "parts")).alias("top"))
            hubs = settle(labels.groupBy("key").agg(F.max(F.struct("k", "label", "top")).alias("h")).select(
                "key", F.col("h.label").alias("label_b"), *[F.col(f"h.top.{c}").alias(f"{c}_b") for c in ("node", "n", "shared", "parts")]))
            near = one.join(hubs, "key").where(F.col("label_a") != F.col("label_b"))
        else:
            # stars find little more: every pair of two components whose bounds allow a link is tested, which ends the search
            other = members.toDF(*[f"{c}_b" if c != "key" else c for c in members.columns])
            near = one.join(other, "key").where(F.col("label_a") < F.col("label_b"))
        pairs = near.where(could_link("a", "b", percent)).select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
        pairs = pairs.union(rare) if turn == 1 else pairs
        fresh = settle(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        found = settle(confirm(fresh, texts, percent))
        tested = tested.union(fresh)
        links = found.count()
        found = found if late is None else found.union(late)
        if star and links * LITTLE < open_:
            star, late = False, found     # its few links are joined with those of the last step
            members = members.drop("label")
            continue
        if links or late is not None:
            stars = components(found.union(stars.toDF("a", "b")))
        if not star:
            return stars
        members = members.drop("label")


def _labelled(members: DataFrame, stars: DataFrame) -> DataFrame:
    return members.join(stars, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return members.join(mixed, "key", "left_semi")


def groups(docs: DataFrame, percent: int = PERCENT, sketches: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, __row, n_shingles, node, root (its group's node) and component_id (the smallest doc_id of the group)."""
    sketches = sketches if sketches is not None else settle(sketch(docs))
    roots = group_roots(docs, sketches, percent)
    nodes = sketches.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left")
    nodes = nodes.select("node", F.coalesce("root", "node").alias("root"), "low")
    least = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.select("node", "root").join(least, "root")
    rows = sketches.select("doc_id", "__row", "n_shingles", "node").join(named, "node", "left")
    return rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group (that of the smallest doc_id) and all documents without words, in the columns of ``docs``."""
    found = groups(docs, percent)
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "__row")).alias("w"))
    wanted = first.select(F.col("w.__row").alias("__row"), F.lit(True).alias("__one")).union(
        found.where("n_shingles = 0").select("__row", F.lit(False)).distinct())
    rows = packed(docs, F.unhex(row_digest("doc_id", "text")).alias("__row")).join(wanted, "__row")
    once = rows.where("__one").dropDuplicates(["__row"])
    return once.union(rows.where("not __one")).select("__doc.*")
