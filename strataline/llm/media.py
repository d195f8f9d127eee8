"""Copies of images, cropped or edited, by local descriptors.

An image column holds binary PGM (P5) or PPM (P6) files.  Corners are found on several scales (Harris response,
strongest of their neighbourhood); each gets an orientation from its intensity centroid and BITS binary comparisons of
smoothed pixels, turned by that orientation.  A descriptor is cut into TABLES substrings, and a query's are also looked up
with each one of their bits turned, so an equality join per table finds all substrings that differ in one bit at most.
Near copies share most of their substrings, so images that have 64 bits of a descriptor in common are put into blocks, and
a block is met once for each of its substrings, not once for each of its images (see ``placed``).
Images with two such corners, whose whole descriptors differ in FAR bits at most, are compared corner by corner, and are
copies if at least NEEDED matches agree on one rotation, scale and shift.

Two corners are sure to meet if they differ in fewer than 2 * TABLES bits; of those that differ in d of BITS bits, spread
evenly, 99.7 % meet at d = 13, 73 % at 26, 36 % at 35 and 8 % at FAR.  A copy is lost only if fewer than two of its
corners meet.
The number of corners grows with a picture's area, so that a part of it has as many as a picture of the part's size.

Identical images are one class from the start, so copies cost nothing.  Defined results: null, empty, unreadable and
very small images have no corners and match nothing; equal rows match alike; ties in response go to the first pixel;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import cut, settle

SCALES = (1.0, 0.75, 0.5)
CORNERS = (14, 10, 6)    # per scale, in a picture of AREA pixels or fewer
AREA = 96 * 96
BITS, TABLES = 256, 8
REACH = 11               # pixels of the comparisons around a corner
TURNS = 32               # steps of orientation
FAR = 48                 # bits in which two matching descriptors may differ
NEEDED = 5               # matches that must agree
SLACK = 4.0              # pixels by which an agreeing match may be off
BLOCK = 2000             # corners looked at together
KEYED = 500              # corners whose substrings are given out together
STEP = 256               # images, or pairs of them, in a batch
TOGETHER = 64            # near copies in a block, one bit of a long for each
LEADING = 8              # corners that say which images are near copies

_pairs = np.random.default_rng(7).normal(0, REACH / 2, (BITS, 2, 2))
_pairs *= np.minimum(1, (REACH - 0.5) / np.hypot(_pairs[..., 0], _pairs[..., 1]))[..., None]   # within the disc, so turns stay inside
_turned = np.stack([np.round(_pairs @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])).astype(int)
                    for a in np.arange(TURNS) * 2 * np.pi / TURNS])   # turn, bit, point, (row, column)
_disc = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if y * y + x * x <= 49])
_KP = "descriptors binary, places binary"


# ------------------------------------------------------------------ images

def read_image(data: bytes | None) -> np.ndarray | None:
    """The grey values of a binary PGM or PPM file of one byte per sample; None if it is something else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        if data[at:at + 1].isspace():
            at += 1
        elif data[at:at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        else:
            end = at
            while end < len(data) and not data[end:end + 1].isspace():
                end += 1
            if not data[at:end].isdigit():
                return None
            fields.append(int(data[at:end]))
            at = end
    depth = 1 if data[:2] == b"P5" else 3
    if len(fields) < 3 or fields[2] > 255 or len(data) - at - 1 < fields[0] * fields[1] * depth:
        return None
    x = np.frombuffer(data, np.uint8, fields[0] * fields[1] * depth, at + 1).astype(np.float32)
    return x.reshape(fields[1], fields[0], depth).mean(axis=2)


def write_image(x: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + np.clip(np.round(x), 0, 255).astype(np.uint8).tobytes()


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear reduction about the origin."""
    if scale == 1.0:
        return x
    h, w = int(x.shape[0] * scale), int(x.shape[1] * scale)
    y, c = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, c0 = np.clip(y.astype(int), 0, x.shape[0] - 2), np.clip(c.astype(int), 0, x.shape[1] - 2)
    fy, fc = np.clip(y - y0, 0, 1)[:, None].astype(np.float32), np.clip(c - c0, 0, 1)[None, :].astype(np.float32)
    top = x[y0][:, c0] * (1 - fc) + x[y0][:, c0 + 1] * fc
    return top * (1 - fy) + (x[y0 + 1][:, c0] * (1 - fc) + x[y0 + 1][:, c0 + 1] * fc) * fy


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, edges repeated."""
    for _ in range(2):   # down the columns, turn, again
        t = np.cumsum(np.pad(x, ((r + 1, r), (0, 0)), mode="edge"), axis=0, dtype=np.float64)
        x = ((t[2 * r + 1:] - t[:-2 * r - 1]) / (2 * r + 1)).astype(np.float32).T
    return x


def peaks(x: np.ndarray, r: int) -> np.ndarray:
    """Maximum over squares of side 2r + 1; the result is smaller by r on every side."""
    for _ in range(2):
        m = x[:-2 * r or None]
        for k in range(1, 2 * r + 1):
            m = np.maximum(m, x[k:len(x) - 2 * r + k])
        x = m.T
    return x


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (corner, BITS/8 bytes) and places (row, column, log2 of the scale, turn) of an image."""
    found, places = [], []
    for scale, most in zip(SCALES, CORNERS):
        most = round(most * max(1, x.size / AREA))
        s = resized(x, scale)
        if min(s.shape) < 2 * REACH + 6:
            continue
        smooth = box(box(s, 1), 1)
        gy, gx = np.gradient(smooth)
        a, b, c = box(gy * gy, 2), box(gx * gx, 2), box(gy * gx, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        m = REACH + 1
        inner = r[m:-m, m:-m]
        around = peaks(r[m - 3:r.shape[0] - m + 3, m - 3:r.shape[1] - m + 3], 3)
        at = np.flatnonzero((inner >= around) & (inner > 1e-3))
        at = at[np.argsort(-inner.ravel()[at], kind="stable")[:most]]
        if not len(at):
            continue
        y, c0 = at // inner.shape[1] + m, at % inner.shape[1] + m
        patch = smooth[y[:, None] + _disc[:, 0], c0[:, None] + _disc[:, 1]]
        angle = np.arctan2((patch * _disc[:, 0]).sum(1), (patch * _disc[:, 1]).sum(1))
        turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        p = _turned[turn]
        v = smooth[y[:, None, None] + p[..., 0], c0[:, None, None] + p[..., 1]]
        found.append(np.packbits(v[..., 0] < v[..., 1], axis=1))
        places.append(np.column_stack([(y + 0.5) / scale, (c0 + 0.5) / scale, np.full(len(y), np.log2(scale)), turn]).astype(np.float32))
    if not found:
        return np.zeros((0, BITS // 8), np.uint8), np.zeros((0, 4), np.float32)
    return np.concatenate(found), np.concatenate(places)


# ------------------------------------------------------------------ tables

def digests(images: DataFrame, make: Callable | None = None) -> DataFrame:
    """The id and the digest of every row; ``images`` and ``make`` as in :func:`describe`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(cut(batches, STEP)) if make else cut(batches, STEP):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(v.as_py() or b"").digest() for v in batch.column(1)], pa.binary())],
                                             [key, "digest"])

    key = images.columns[0]
    return images.mapInArrow(run, f"`{key}` {images.schema[key].dataType.simpleString()}, digest binary")


def describe(images: DataFrame, make: Callable | None = None) -> DataFrame:
    """Per distinct image: image_class (its smallest image_id), digest, descriptors and places.

    ``images`` has two columns, an id and the image, or something of which ``make`` (batches of id and source to batches of id
    and image) makes the image in the same task: with a worker for each step, a core would need the memory of three.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(cut(batches, STEP)) if make else cut(batches, STEP):
            h, d, p = [], [], []
            for data in batch.column(1):
                data = data.as_py()
                x = read_image(data)
                a, b = corners(x) if x is not None else (np.zeros(0, np.uint8),) * 2
                h.append(hashlib.md5(data or b"").digest())
                d.append(a.tobytes())
                p.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.binary()) for v in (h, d, p))], ["image_id", "digest", "descriptors", "places"])

    key, image = images.columns
    found = images.select(F.col(key).cast("long"), image).mapInArrow(run, f"image_id long, digest binary, {_KP}")
    return found.groupBy("digest").agg(F.min("image_id").alias("image_class"), F.count(F.lit(1)).alias("copies"),
                                       F.first("descriptors").alias("descriptors"), F.first("places").alias("places"))


def placed(index: DataFrame) -> DataFrame:
    """The block (a long) and the bit in it of each described image; near copies share a block, about TOGETHER of them.

    An image's leader is the smallest hash among the images that share 64 aligned bits of one of the LEADING first descriptors with
    it, and the images of a leader are dealt over as many blocks as they need.  Blocks only say what is looked up together: whatever they hold,
    all pairs with corners that meet are found, and where images have the same bit, ``meeting`` tells them apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [v.as_py()[:LEADING * BITS // 8] for v in batch.column(1)]
            row = np.repeat(np.arange(len(d)), [len(v) // 8 for v in d])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.frombuffer(b"".join(d), "<i8"))], ["own", "part"])

    own = F.xxhash64("digest")
    parts = index.select(own.alias("own"), "descriptors").mapInArrow(run, "own long, part long")
    shared = parts.groupBy("part").agg(F.min("own").alias("leader"), F.max("own").alias("last")).where("leader < last").select("part", "leader")
    led = index.select("digest", own.alias("own")).join(parts.join(shared, "part").groupBy("own").agg(F.min("leader").alias("leader")), "own", "left")
    led = led.select("digest", "own", F.coalesce("leader", "own").alias("leader"))
    sizes = led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("blocks"))
    return led.join(sizes, "leader").select("digest", F.xxhash64("leader", F.pmod("own", "blocks")).alias("block"),
                                            F.expr(f"shiftleft(1L, cast(pmod(xxhash64(digest, 1), {TOGETHER}) as int))").alias("bit"))


def substrings(described: DataFrame, id_: str | list[str], side: str, near: bool = False) -> DataFrame:
    """One row per (corner, table) of an image: its id (or several columns), key and whole descriptor (four longs, named by
    ``side``); with ``near``, the keys one bit away as well."""
    turned = np.concatenate(([0], 1 << np.arange(BITS // TABLES))) if near else np.zeros(1, np.int64)
    ids = [id_] if isinstance(id_, str) else id_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [v.as_py() for v in batch.column(len(ids))]
            whole = np.frombuffer(b"".join(d), "<i8").reshape(-1, BITS // 64)
            parts = whole.view("<u4").astype(np.int64)
            row = np.repeat(np.arange(len(d)), [len(v) // (BITS // 8) for v in d])
            for k in range(0, len(row), KEYED):
                key = (np.arange(TABLES) << BITS // TABLES)[:, None] | parts[k:k + KEYED, :, None] ^ turned
                at = np.repeat(np.arange(k, k + len(key)), key[0].size)
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(ids))), pa.array(key.ravel()), *(pa.array(v) for v in whole[at].T)],
                                                 [*ids, "key", *names])

    names = [f"{side}{i}" for i in range(BITS // 64)]
    typed = [f"{c} {described.schema[c].dataType.simpleString()}" for c in ids]
    return described.select(*ids, "descriptors").mapInArrow(run, f"{', '.join(typed)}, key long, {', '.join(f'{c} long' for c in names)}")


def candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (q, digest) of described images with two or more corners of q that meet one of the other's, and a few more."""
    where = settle(placed(index.where(F.length("descriptors") > 0)))
    longs = range(BITS // 64)
    left = substrings(asked.select(F.col("digest").alias("q"), "descriptors"), "q", "a", near=True)
    # a substring of a block: the images that have it, and the bits that all or any of their descriptors have
    right = (substrings(where.join(index.select("digest", "descriptors"), "digest"), ["block", "bit"], "b").repartition("key").groupBy("key", "block")
             .agg(F.bit_or("bit").alias("who"), *[f(f"b{i}").alias(f"{n}{i}") for n, f in (("all", F.bit_and), ("any", F.bit_or)) for i in longs]))
    # bits in which the corner differs from each of them: no more than from the nearest
    far = sum((F.bit_count(F.expr(f"(a{i} & ~any{i}) | (~a{i} & all{i})")) for i in longs), F.lit(0))
    corner = F.xxhash64(*[f"a{i}" for i in longs])
    # two matching corners are enough for a pair to be compared
    found = (left.join(right, "key").where(far <= FAR).groupBy("q", "block").agg(F.min(corner).alias("low"), F.max(corner).alias("high"), F.bit_or("who").alias("who"))
             .where("low < high"))
    return found.join(where, "block").where("who & bit != 0").select("q", "digest")


def meeting(da: np.ndarray, db: np.ndarray) -> int:
    """How many different corners of the first image meet one of the second: a substring differs in one bit at most, the whole
    in FAR."""
    a, b = da.view("<u8"), db.view("<u8")
    step = max(1, BLOCK * BLOCK // max(1, len(b)))
    met = [np.zeros(0, bool)]
    for k in range(0, len(a) if len(b) else 0, step):
        x = np.bitwise_count((a[k:k + step, None, :] ^ b[None, :, :]).view("<u4"))
        met.append(((x.min(axis=2) <= 1) & (x.sum(axis=2) <= FAR)).any(axis=1))
    met = np.concatenate(met)
    return len(np.unique(a[met], axis=0)) if met.any() else 0


def agreeing(da: np.ndarray, pa_: np.ndarray, db: np.ndarray, pb: np.ndarray) -> int:
    """The most matches of two images' corners that agree on one similarity transform."""
    if not len(da) or not len(db):
        return 0
    step = max(1, BLOCK * BLOCK // len(db))
    each = [np.bitwise_count(da[k:k + step, None, :] ^ db[None, :, :]).sum(axis=2) for k in range(0, len(da), step)]
    j = np.concatenate([f.argmin(axis=1) for f in each])
    i = np.flatnonzero(np.concatenate([f.min(axis=1) for f in each]) <= FAR)
    j = j[i]
    if len(i) < NEEDED:
        return 0
    turn = (pb[j, 3] - pa_[i, 3]) * 2 * np.pi / TURNS
    grow = 2.0 ** (pa_[i, 2] - pb[j, 2])
    xa, xb = pa_[i, :2], pb[j, :2]
    best = 0
    for k in range(len(i)):
        c, s = np.cos(turn[k]) * grow[k], np.sin(turn[k]) * grow[k]
        d = xa - xa[k]
        moved = np.column_stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1]]) + xb[k]
        near = (np.abs(moved - xb).max(axis=1) <= SLACK + 0.1 * np.abs(d).max(axis=1)) & (np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi) < 0.5)
        best = max(best, len(np.unique(j[near])))
    return best


def find_copies(queries: DataFrame, images: DataFrame, make_query: Callable | None = None, make_image: Callable | None = None) -> DataFrame:
    """Copies of the queries' images (query_id, image) among ``images`` (image_id, image), all of them: query_id, image_class
    (the smallest id of a class of identical images), copies (images in the class) and agreeing (matches).  With ``make_query``
    or ``make_image`` the two columns are an id and what these make the images of, as in :func:`describe`."""
    queries = queries if make_query else queries.select("query_id", "image")
    images = images if make_image else images.select("image_id", "image")
    index = settle(describe(images, make_image))
    asked = settle(describe(queries, make_query))
    pairs = (candidates(asked, index)
             .join(asked.select(F.col("digest").alias("q"), F.col("descriptors").alias("da"), F.col("places").alias("pa")), "q")
             .join(index.select("digest", F.col("descriptors").alias("db"), F.col("places").alias("pb")), "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, STEP):
            cols = [batch.column(i).to_pylist() for i in range(2, 6)]
            n = []
            for a, p, b, q in zip(*cols):
                a, b = (np.frombuffer(v, np.uint8).reshape(-1, BITS // 8) for v in (a, b))
                n.append(agreeing(a, np.frombuffer(p, np.float32).reshape(-1, 4), b, np.frombuffer(q, np.float32).reshape(-1, 4)) if meeting(a, b) > 1 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["q", "digest", "agreeing"])

    hits = pairs.select("q", "digest", "da", "pa", "db", "pb").mapInArrow(run, "q binary, digest binary, agreeing long").where(F.col("agreeing") >= NEEDED)
    ids = digests(queries, make_query).toDF("query_id", "q")
    return ids.join(hits, "q").join(index.select("digest", "image_class", "copies"), "digest").select("query_id", "image_class", "copies", "agreeing")


# ------------------------------------------------------------------ images of vectors

SIDE = 96


def textures(k: int) -> np.ndarray:
    """Fixed smooth textures, one per vector component."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(k):
        t = box(rng.normal(0, 1, (SIDE, SIDE)).astype(np.float32), 1 + i % 3)
        out.append(t / t.std())
    return np.stack(out).reshape(k, -1)


def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """image_id, image of ids and vectors: each vector as a grey picture, a mix of fixed textures with its components as weights."""
    base: dict[int, np.ndarray] = {}
    for batch in cut(batches, STEP):
        out = []
        for v in batch.column(1):
            v = np.array([w or 0.0 for w in v.as_py() or []], np.float32)
            if not len(v) or not np.abs(v).max() > 0:
                out.append(None)
                continue
            if len(v) not in base:
                base[len(v)] = textures(len(v))
            x = v @ base[len(v)]
            out.append(write_image((128 + 40 * x / x.std()).reshape(SIDE, SIDE)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "image"])


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, image of ids and images: each image cropped, turned by a quarter or changed in brightness and contrast, by its id."""
    for batch in cut(batches, STEP):
        out = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = read_image(data.as_py())
            if x is None or i is None:
                out.append(None)
                continue
            kind = i // 20 % 3
            if kind == 0:
                y, c = i // 60 % 16, i // 7 % 16
                x = x[y:y + 80, c:c + 78]
            else:
                x = np.rot90(x) if kind == 1 else 0.7 * (x - 128) + 150
            out.append(write_image(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["query_id", "image"])


def drawn_and_edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return edited(drawn(batches))
