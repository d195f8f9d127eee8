"""Exact removal of repeated substrings with suffix arrays.

Every byte inside a LENGTH-byte string that also starts anywhere else, in any document or the same one, goes.

1. Cut.  The smallest hash of the GRAM-byte strings inside a window of LENGTH bytes is the window's key.  Windows with
   one leftmost occurrence of their key form a run (about LENGTH/2 windows).  Equal windows have equal keys, so only
   runs whose key occurs twice or more can hold repeats, and a key whose runs are all the same bytes is repeated as a
   whole.  Only the runs of the other repeated keys are looked into.
2. Shards.  The bytes of these runs are brought together by key, so that equal windows meet in one shard of bounded
   size.  A shard gets its suffix array by Larsson-Sadakane refinement and its common prefixes by Kasai's rule, both in
   NumPy; windows whose neighbours share LENGTH bytes are repeated.
3. Merge.  A key with more than KEY_RUNS runs is dealt to several shards.  These send the fingerprints of their distinct
   windows in sorted order, in as many ranges as the key has shards, and a range is merged pair by pair by binary search.
4. Documents.  Spans are united per distinct text, and removed from all documents with this text.

Defined results: null and empty texts have no bytes and lose none; texts under LENGTH bytes lose none; equal texts of
LENGTH bytes or more lose everything; a cut through a character drops its remaining bytes from the text (not from the
checksum, which is over bytes); an empty table gives no rows.  Memory grows with the longest document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import cut, free_names, settle
from strataline.llm.tokens import BASE, CHUNK, _byte, chunks, mix, powers, raw

LENGTH = 200
GRAM = 32
KEY_RUNS = 4096      # runs of one key in one shard
SHARD_BYTES = 1 << 20
STEP = 1000           # texts of which a task holds what it makes of them
_EMPTY = np.zeros(0, np.int64)


# ------------------------------------------------------------------ keys of windows

def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every position."""
    h, k = _byte[x], 1
    while k < GRAM:
        h = h[:-k] * np.uint64(pow(int(BASE), k, 1 << 64)) + h[k:]
        k *= 2
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (width - have)], v[width - have:]) if have < width else v


def window_runs(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, first window and end window (exclusive) of every run; offsets start at 0 of x, which holds whole rows."""
    n, size = len(x), np.diff(offsets)
    long = np.flatnonzero(size >= LENGTH)
    if not len(long):
        return _EMPTY, _EMPTY.view(np.uint64), _EMPTY, _EMPTY
    g = gram_hashes(x)
    m = sliding_min(g, LENGTH - GRAM + 1)
    step = np.zeros(n + 1, np.int8)
    step[offsets[long]] += 1
    step[offsets[long] + size[long] - LENGTH + 1] -= 1
    valid = np.cumsum(step[:len(m)], dtype=np.int8).astype(bool)
    new = np.ones(len(m), bool)
    # a run ends where the smallest hash changes or its leftmost occurrence leaves the window
    new[1:] = (m[1:] != m[:-1]) | (g[:len(m) - 1] == m[:-1]) | ~valid[:-1]
    new[offsets[long]] = True
    new &= valid
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.empty_like(start)
    end[:-1] = start[1:]
    end[-1] = n
    return row, m[start], start - offsets[row], np.minimum(end, offsets[row + 1] - LENGTH + 1) - offsets[row]


def text_runs(x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key, first window and end window of the runs of each row."""
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 2 * CHUNK:
            row, key, s, e = window_runs(x[lo:hi], offsets[a:b + 1] - lo)
            cut = np.searchsorted(row, np.arange(b - a + 1))
            for i in range(b - a):
                yield key[cut[i]:cut[i + 1]], s[cut[i]:cut[i + 1]], e[cut[i]:cut[i + 1]]
        else:   # one long text, in overlapping pieces; a piece border may split a run
            parts = []
            for p in range(lo, hi - LENGTH + 1, CHUNK):
                q = min(p + CHUNK + LENGTH - 1, hi)
                _, key, s, e = window_runs(x[p:q], np.array([0, q - p]))
                parts.append((key, s + p - lo, e + p - lo))
            yield tuple(np.concatenate(c) for c in zip(*parts))


def run_keys(docs: DataFrame, prints: bool) -> DataFrame:
    """digest, key (and print, a hash of the run's bytes) of every run of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, STEP):
            x, offsets = raw(batch.column(1))
            keys, n, marks = [_EMPTY], [], [_EMPTY]
            for i, (k, s, e) in enumerate(text_runs(x, offsets)):
                keys.append(k.view(np.int64))
                n.append(len(k))
                if prints:
                    marks.append(run_prints(x[offsets[i]:offsets[i + 1]], s, e))
            digest = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            cols = [digest, pa.array(np.concatenate(keys))] + ([pa.array(np.concatenate(marks))] if prints else [])
            yield pa.RecordBatch.from_arrays(cols, ["digest", "key", "print"][:len(cols)])

    rows = docs.where(F.octet_length("text") >= LENGTH).select(text_digest().alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "digest binary, key long" + (", print long" if prints else ""))


def run_prints(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run of one text."""
    import xxhash

    buf = memoryview(np.ascontiguousarray(x))
    return np.array([xxhash.xxh3_64_intdigest(buf[p:q]) for p, q in zip(s.tolist(), (e + LENGTH - 1).tolist())], np.uint64).view(np.int64)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest, copies and z (the packed text) of every distinct text of LENGTH bytes or more; copies meet map-side first."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, STEP):
            x, offsets = raw(batch.column(1))
            buf = memoryview(x)
            z = [zlib.compress(buf[a:b], 4) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["digest", "z"])

    rows = docs.where(F.octet_length("text") >= LENGTH).select(text_digest().alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(pack, "digest binary, z binary").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("z").alias("z"))


def unpacked(rows: Iterator[dict], wanted=lambda r: True) -> Iterator[tuple]:
    """Each row, its text's bytes, and key, first window, end window and print of its runs (of none, where not ``wanted``).

    Texts are hashed a megabyte at a time: one by one, most of the time would go into the start of each NumPy call.
    """
    held, size = [], 0
    for r in rows:
        held.append((r, zlib.decompress(r["z"].as_buffer())))
        size += len(held[-1][1])
        if size >= CHUNK:
            yield from _with_runs(held, wanted)
            held, size = [], 0
    yield from _with_runs(held, wanted)


def _with_runs(held: list[tuple], wanted) -> Iterator[tuple]:
    need = [wanted(r) for r, _ in held]
    texts = [z for (_, z), w in zip(held, need) if w]
    x, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    runs = enumerate(text_runs(x, offsets))
    for (r, z), w in zip(held, need):
        if not w:
            yield r, np.frombuffer(z, np.uint8), _EMPTY, _EMPTY, _EMPTY, _EMPTY
            continue
        i, (key, s, e) = next(runs)
        text = x[offsets[i]:offsets[i + 1]]
        yield r, text, key.view(np.int64), s, e, run_prints(text, s, e)


def text_digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def repeated_keys(docs: DataFrame) -> DataFrame:
    """digest, marks: the repeated keys of each text, with their number of runs, or 0 if these are all the same bytes."""
    keys = run_keys(docs, True).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("lo"), F.max("print").alias("hi")).where("n > 1")
    # settled, so that the join can split a key that many documents share
    keys = settle(keys.select("key", F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.col("n")).alias("mixed")))
    hits = run_keys(docs, False).join(keys, "key")
    return hits.groupBy("digest").agg(F.collect_set(F.struct("key", "mixed")).alias("marks"))


def marked(keys: np.ndarray, prints: np.ndarray, marks: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's runs: repeated as a whole; to be looked into (one of those equal inside the text)."""
    n = np.array([marks.get(k, -1) for k in keys.tolist()], np.int64)
    whole, inner = n == 0, n > 0
    at = np.flatnonzero(inner)
    if len(at) > 1:
        _, first, back, count = np.unique(np.stack([keys[at], prints[at]]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        whole[at[count[back.ravel()] > 1]] = True
        inner[:] = False
        inner[at[first]] = True
    return whole, inner


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        yield {name: c[i] for name, c in cols.items()}


def _marks(v) -> dict[int, int]:
    s = v.values
    return dict(zip(s.field("key").to_pylist(), s.field("mixed").to_pylist()))


def pieces(texts: DataFrame, marks: DataFrame, key_runs: int = KEY_RUNS) -> DataFrame:
    """The runs to be looked into: key, salt, split (whether the key goes to several shards), digest, start and bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, STEP):
            out = [[] for _ in range(6)]
            for r, x, keys, s, e, prints in unpacked(_rows(batch)):
                found = _marks(r["marks"])
                _, inner = marked(keys, prints, found)
                digest, text = r["digest"].as_py(), x.tobytes()
                spread = int.from_bytes(digest[:4], "little")
                for i in np.flatnonzero(inner).tolist():
                    salts = (found[keys[i]] - 1) // key_runs + 1
                    for c, v in zip(out, (int(keys[i]), (spread + i * 40503) % salts, salts, digest, int(s[i]), text[s[i]:e[i] + LENGTH - 1])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PIECE)], _PIECE_NAMES)

    todo = texts.join(marks.where(F.exists("marks", lambda m: m["mixed"] > 0)), "digest")
    return todo.select("digest", "z", "marks").mapInArrow(
        run, "key long, salt int, salts int, digest binary, start int, bytes binary")


_PIECE = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
_PIECE_NAMES = ["key", "salt", "salts", "digest", "start", "bytes"]


# ------------------------------------------------------------------ suffix arrays

def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of all suffixes: sorted by 8 bytes, then the groups that are still unsorted are refined by the rank of
    what follows, at doubled distance each time (Larsson and Sadakane)."""
    n = len(x)
    k, width = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64), 1
    while width < 8:
        k = (k[:-width] << np.uint64(8 * width)) | k[width:]
        width *= 2
    k = k[:n]
    sa = np.argsort(k, kind="stable")
    rank = np.full(n + 1, -1, np.int64)   # what lies behind the end comes first
    active, key, h = np.arange(n), k[sa], 0
    while True:
        head = np.ones(len(active), bool)
        head[1:] = key[1:] != key[:-1]
        rank[sa[active]] = active[np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))]
        lone = head.copy()
        lone[:-1] &= head[1:]
        active = active[~lone]
        if not len(active):
            return sa
        h = 2 * h if h else 8
        at = sa[active]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[active], key = at[order], key[order]


def common_prefixes(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Bytes that each suffix, in sorted order, shares with the one before.

    Kasai's rule: where a suffix and its predecessor in order are preceded by the same byte, one less is shared than one
    position earlier.  So bytes are only compared at the other positions, eight at a time.
    """
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    later = np.flatnonzero(before > 0)
    later = later[later > 0]
    fresh[later] = x[later - 1] != x[before[later] - 1]
    k, width = np.concatenate([x, np.zeros(16, np.uint8)]).astype(np.uint64), 1
    while width < 8:
        k = (k[:-width] << np.uint64(8 * width)) | k[width:]
        width *= 2
    shared = np.zeros(n, np.int64)
    i = np.flatnonzero(fresh & (before >= 0))
    j, done = before[i], 0
    while len(i):
        a, b = i + done, j + done
        differ, left = k[a] ^ k[b], n - np.maximum(a, b)   # the bytes behind the end are padding, never shared
        go = (differ == 0) & (left >= 8)
        end = ~go
        odd = differ[end].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        shared[i[end]] = done + np.minimum(np.where(odd.any(axis=1), odd.argmax(axis=1), 8), left[end])
        i, j, done = i[go], j[go], done + 8
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    plcp = np.maximum(shared[last] - (np.arange(n) - last), 0)
    return plcp[sa]


def repeated_windows(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each window of the rows (-1 where none starts), and whether another window is in it."""
    n = len(x)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, offsets[:-1], 1)
    np.add.at(valid, offsets[1:] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    sa = suffix_array(x)
    group = np.cumsum(common_prefixes(x, sa) < LENGTH) - 1
    count = np.bincount(group, weights=valid[sa], minlength=group[-1] + 1)
    cls = np.full(n, -1, np.int64)
    cls[sa] = group
    cls[~valid] = -1
    return cls, valid & (count[cls] > 1)


def to_spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def fingerprints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of the LENGTH bytes at each position."""
    up, down = powers(len(x) + 1)
    out = []
    for table in (_byte, mix(_byte)):
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(table[x] * up[:len(x)], out=total[1:])
        out.append(mix((total[LENGTH:] - total[:-LENGTH]) * down[:len(x) - LENGTH + 1]))
    return out[0], out[1]


_SPAN = "digest binary, start int, stop int"
_SHARD = f"{_SPAN}, key long, range int, prints binary, checks binary, refs binary, places binary, digests binary"
_SHARD_TYPES = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 5


def search_shards(found: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per shard: spans (digest, start, stop) of repeated windows, and, with a null digest, sorted fingerprint lists of the
    windows of split keys, with the windows (refs, places) that are to be flagged if another shard has them too."""
    def shard(rows: list[tuple]) -> Iterator[tuple]:
        x = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r[5]) for r in rows])))
        cls, flag = repeated_windows(x, offsets)
        a, b = to_spans(flag)
        row = np.searchsorted(offsets, a, "right") - 1
        for i, p, q in zip(row.tolist(), (a - offsets[row]).tolist(), (b - offsets[row]).tolist()):
            yield (rows[i][3], rows[i][4] + p, rows[i][4] + q) + (None,) * 7
        split = np.array([r[2] > 1 for r in rows])
        if not split.any():
            return
        hi, lo = fingerprints(x)
        keys = np.array([r[0] for r in rows], np.int64)
        at = np.flatnonzero(cls >= 0)
        row = np.searchsorted(offsets, at, "right") - 1
        at, row = at[split[row]], row[split[row]]
        for key in np.unique(keys[row]).tolist():
            p, r = at[keys[row] == key], row[keys[row] == key]
            _, first = np.unique(cls[p], return_index=True)   # one window of each class
            p, r = p[first], r[first]
            salts = rows[r[0]][2]
            part = (hi[p] % np.uint64(salts)).astype(np.int64)
            for t in np.unique(part).tolist():
                q, s = p[part == t], r[part == t]
                order = np.argsort(hi[q], kind="stable")
                q, s = q[order], s[order]
                used, ref = np.unique(s, return_inverse=True)
                ref = np.where(flag[q], -1, ref).astype(np.int32)
                place = np.array([rows[i][4] for i in s.tolist()], np.int64) + q - offsets[s]
                yield (None, None, None, key, t, hi[q].tobytes(), lo[q].tobytes(), ref.tobytes(), place.astype(np.int32).tobytes(),
                       b"".join(rows[i][3] for i in used.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            ready = []
            for r in zip(*cols):
                if size >= shard_bytes and r[:2] != last:
                    ready += shard(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
                last = r[:2]
            if ready:
                yield _batch(ready)
        if held:
            yield _batch(list(shard(held)))

    return found.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, _SHARD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_SHARD_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SHARD_TYPES)], [c.split()[0] for c in _SHARD.split(", ")])


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Sorted runs (print, check, id) merged pair by pair by binary search; the last result lists the ids met twice."""
    met = []
    while len(runs) > 1:
        merged = []
        for (p, c, i), (q, d, j) in zip(runs[::2], runs[1::2]):
            at = np.minimum(np.searchsorted(p, q), len(p) - 1)
            same = (p[at] == q) & (c[at] == d)
            met += [i[at[same]], j[same]]
            where = np.searchsorted(p, q[~same])
            merged.append((np.insert(p, where, q[~same]), np.insert(c, where, d[~same]), np.insert(i, where, j[~same])))
        runs = merged + ([runs[-1]] if len(runs) % 2 else [])
    return (*runs[0], met)


def merge_shards(lists: DataFrame) -> DataFrame:
    """Spans of the windows of split keys that stand in two or more shards."""
    def merge(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("prints", "checks", "refs", "places", "digests")}
        runs, base, refs, places, texts, n_texts = [], 0, [], [], [], 0
        for p, c, r, s, d in zip(*cols.values()):
            p, c, r, s = np.frombuffer(p, np.uint64), np.frombuffer(c, np.uint64), np.frombuffer(r, np.int32), np.frombuffer(s, np.int32)
            runs.append((p, c, np.arange(base, base + len(p))))
            refs.append(np.where(r >= 0, r + n_texts, -1))
            places.append(s)
            texts += [d[i:i + 16] for i in range(0, len(d), 16)]
            base, n_texts = base + len(p), n_texts + len(d) // 16
        # a window met in a third shard is the one that stands for the first two, so ids may repeat
        hit = np.unique(np.concatenate(merge_runs(runs)[3] or [_EMPTY]))
        ref, place = np.concatenate(refs)[hit], np.concatenate(places)[hit]
        ref, place = ref[ref >= 0], place[ref >= 0]
        return pa.table({"digest": pa.array([texts[i] for i in ref.tolist()], pa.binary()), "start": pa.array(place, pa.int32()),
                         "stop": pa.array(place + 1, pa.int32())})

    return lists.select("key", "range", "prints", "checks", "refs", "places", "digests").groupBy("key", "range").applyInArrow(merge, _SPAN)


# ------------------------------------------------------------------ results

def kept_texts(texts: DataFrame, marks: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """digest, n_removed, n_spans, kept_sha256 (and the kept text) of the texts that lose bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, STEP):
            out = [[], [], [], [], []]
            inside = lambda r: r["marks"].is_valid and r["copies"].as_py() == 1     # copies go as a whole
            for r, x, keys, s, e, prints in unpacked(_rows(batch), inside):
                gone = np.zeros(len(x) + 1, np.int64)
                if r["copies"].as_py() > 1:
                    gone[[0, len(x)]] = 1, -1
                if inside(r):
                    whole, _ = marked(keys, prints, _marks(r["marks"]))
                    np.add.at(gone, s[whole], 1)
                    np.add.at(gone, e[whole] + LENGTH - 1, -1)
                if r["spans"].is_valid:
                    found = r["spans"].values
                    np.add.at(gone, found.field("start").to_numpy(), 1)
                    np.add.at(gone, found.field("stop").to_numpy() + LENGTH - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                if gone.any():
                    kept = x[~gone].tobytes()
                    for c, v in zip(out, (r["digest"].as_py(), int(gone.sum()), len(to_spans(gone)[0]), hashlib.sha256(kept).hexdigest(),
                                          kept.decode("utf-8", "ignore") if with_text else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             ["digest", "n_removed", "n_spans", "kept_sha256", "kept"])

    by_text = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    todo = texts.join(marks, "digest", "left").join(by_text, "digest", "left").where("copies > 1 or marks is not null")
    return todo.mapInArrow(run, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept string")


def changed_texts(docs: DataFrame, with_text: bool = False, key_runs: int = KEY_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """:func:`kept_texts` of a table of documents."""
    texts = distinct_texts(docs)   # packed and dealt anew for either use: less to keep than a table of all texts
    marks = settle(repeated_keys(docs))
    shards = settle(search_shards(pieces(texts, marks, key_runs), shard_bytes))
    spans = shards.where("digest is not null").select("digest", "start", "stop").union(merge_shards(shards.where("digest is null")))
    return kept_texts(texts, marks, spans, with_text)


def report(docs: DataFrame, **sizes: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select("doc_id", text_digest().alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("__sha"))
    out = rows.join(changed_texts(docs, **sizes).drop("kept"), "digest", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("kept_sha256", "__sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings, in the columns of ``docs``; n_chars, if any, is recounted."""
    key, kept = free_names(docs, "digest", "kept")
    changed = changed_texts(docs, True).select(F.col("digest").alias(key), F.col("kept").alias(kept))
    out = docs.withColumn(key, text_digest()).join(changed, key, "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
