"""SentencePiece encoding and decoding by batched Viterbi in NumPy.

A text is cut where no piece can cross (before a space mark, and around characters that only stand alone); the distinct
units of a batch are grouped by length, and all units of one length advance together: from every position the
substrings of growing length are hashed and probed in the sorted hashes of piece prefixes, and where a substring is a
piece, the better total score and its backpointer are stored.  Characters without a piece become byte pieces.

The best segmentation is the one of SentencePiece's unigram model with the same pieces and scores.  Models of the BPE
kind have merge ranks for scores; these are turned into log-probabilities by Zipf's law, -ln(rank + 2), so their ids
differ from BPE merges where several segmentations exist.

Defined results: null and empty texts have no ids; equal rows get equal ids; the space mark itself decodes to a space;
ids outside the vocabulary and control pieces decode to nothing; an empty table gives no rows.  Memory grows with the
longest text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = np.float32(10.0)   # below the lowest score, as in SentencePiece
BATCH_CHARS = 1 << 20                # characters segmented at once
HELD_UNITS = 100_000                 # units whose ids a worker remembers before it starts anew; workers outlive their tasks

_base = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[str, Pieces] = {}


def _char_hash(c: np.ndarray) -> np.ndarray:
    h = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class Pieces:
    """The pieces of a model, and the ids of the units met so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        text = [model.id_to_piece(i) for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)], np.float32)
        byte = np.array([model.is_byte(i) for i in range(n)])
        plain = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
        if np.array_equal(score[plain], np.round(score[plain])) and score[plain].min() < -1000:   # merge ranks
            score = (-np.log(2.0 - score.astype(np.float64).clip(max=0))).astype(np.float32)
        self.byte_id = np.full(256, self.unknown, np.int32)
        self.raw = [b""] * n
        for i in np.flatnonzero(byte).tolist():
            self.byte_id[int(text[i][3:5], 16)] = i
            self.raw[i] = bytes([int(text[i][3:5], 16)])
        self.bytes_known = bool(byte.any())
        self._prefixes([(text[i], float(score[i]), i) for i in np.flatnonzero(plain).tolist()])
        self.unknown_score = np.float32(score[plain].min()) - UNKNOWN_PENALTY
        for i in np.flatnonzero(plain).tolist():
            self.raw[i] = text[i].replace(MARK, " ").encode()
        size = np.array([len(b) for b in self.raw])
        self.raw_at = np.concatenate(([0], np.cumsum(size)))
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self._units([text[i] for i in np.flatnonzero(plain).tolist()])
        self._forget()

    def _prefixes(self, pieces: list[tuple[str, float, int]]) -> None:
        """Sorted hashes of all prefixes of pieces, with score and id where the prefix is a piece."""
        table: dict[str, tuple[float, int]] = {}
        for text, score, i in pieces:
            for k in range(1, len(text)):
                table.setdefault(text[:k], (-np.inf, -1))
            table[text] = (score, i)
        keys = np.zeros(len(table), np.uint64)
        for at, text in enumerate(table):
            h = np.uint64(0)
            for c in _char_hash(np.frombuffer(text.encode("utf-32-le"), np.uint32)):
                h = np.uint64((int(h) * int(_base) + int(c)) & 0xFFFFFFFFFFFFFFFF)
            keys[at] = h
        order = np.argsort(keys)
        self.keys = keys[order]
        values = list(table.values())
        self.score = np.array([v[0] for v in values], np.float32)[order]
        self.id = np.array([v[1] for v in values], np.int32)[order]
        self.longest = max(map(len, table))

    def _units(self, pieces: list[str]) -> None:
        """The pattern of the parts of a text that no piece crosses."""
        joins = sorted({c for p in pieces if len(p) > 1 for c in p} - {MARK})
        if any(MARK in p.lstrip(MARK) for p in pieces):
            self.pattern = re.compile(r"(?s).+")
        else:
            inside = "".join(map(re.escape, joins))
            self.pattern = re.compile(f"(?s){MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.fresh: list[np.ndarray] = []
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _store(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all known units in a row, and where each unit's begin."""
        if self.fresh:
            self.flat = np.concatenate([self.flat, *self.fresh])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(f) for f in self.fresh])])
            self.fresh = []
        return self.flat, self.at

    def segment(self, units: list[str]) -> list[np.ndarray]:
        """The ids of units that all have the same length."""
        n, size = len(units), len(units[0])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(n, size)
        hashed = _char_hash(chars)
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        start = np.full((n, size + 1), -1, np.int32)
        piece = np.full((n, size + 1), -1, np.int32)
        for b in range(size):
            rows, h, single = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, bool)
            for e in range(b + 1, min(b + self.longest, size) + 1):
                h = h * _base + hashed[rows, e - 1]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                rows, h, at = rows[hit], h[hit], at[hit]
                if not len(rows):
                    break
                whole = self.id[at] >= 0
                r, total = rows[whole], best[rows[whole], b] + self.score[at[whole]]
                if e == b + 1:
                    single[r] = True
                up = total > best[r, e]   # at equal totals the earlier start stays
                r = r[up]
                best[r, e], start[r, e], piece[r, e] = total[up], b, self.id[at[whole]][up]
            r = np.flatnonzero(~single)
            total = best[r, b] + self.unknown_score
            up = total > best[r, b + 1]
            r = r[up]
            best[r, b + 1], start[r, b + 1], piece[r, b + 1] = total[up], b, self.unknown
        back, rows, at = [], np.arange(n), np.full(n, size)
        while len(rows):
            back.append((rows, start[rows, at], piece[rows, at]))
            at = start[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        row, first, ids = (np.concatenate(c) for c in zip(*back))
        order = np.lexsort((first, row))
        row, first, ids = row[order], first[order], ids[order]
        cut = np.searchsorted(row, np.arange(n + 1))
        odd = set(row[ids == self.unknown].tolist()) if self.bytes_known else ()
        out = []
        for i in range(n):
            own = ids[cut[i]:cut[i + 1]]
            if i in odd:   # characters without a piece, as bytes
                spelt = []
                for p, k in zip(first[cut[i]:cut[i + 1]].tolist(), own.tolist()):
                    spelt += self.byte_id[list(units[i][p].encode("utf-8", "surrogatepass"))].tolist() if k == self.unknown else [k]
                own = np.array(spelt, np.int32)
            out.append(own)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        if len(self.known) > HELD_UNITS:
            self._forget()
        parts = [self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = {u for p in parts for u in p if u not in self.known}
        for _, same in _by_length(fresh):
            for a in range(0, len(same), max(1, BATCH_CHARS // len(same[0]))):
                some = same[a:a + max(1, BATCH_CHARS // len(same[0]))]
                for u, ids in zip(some, self.segment(some)):
                    self.known[u] = len(self.known)
                    self.fresh.append(ids)
        flat, at = self._store()
        code = np.fromiter((self.known[u] for p in parts for u in p), np.int64)
        size = at[code + 1] - at[code]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = flat[np.arange(total) - np.repeat(end - size - at[code], size)]
        units = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, np.concatenate(([0], end))[units]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ok = (ids >= 0) & (ids < len(self.raw))
        safe = np.where(ok, ids, 0)
        size = np.where(ok, self.raw_at[safe + 1] - self.raw_at[safe], 0)
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        data = self.raw_bytes[np.arange(total) - np.repeat(end - size - self.raw_at[safe], size)].tobytes()
        at = np.concatenate(([0], end))[cuts].tolist()
        out = []
        for a, b in zip(at[:-1], at[1:]):
            t = data[a:b].decode("utf-8", "replace")
            out.append(t[1:] if t.startswith(" ") else t)   # the mark put before every text
        return out


def _by_length(units: set[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for u in units:
        groups.setdefault(len(u), []).append(u)
    yield from sorted(groups.items())


def pieces(folder: str = FOLDER, model: str = MODEL) -> Pieces:
    """The model, loaded once per Python worker."""
    path = os.path.join(folder, model)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _groups(batch: pa.RecordBatch, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (the first column) have about ``limit`` characters: only these become Python strings at once."""
    end = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = min(int(np.searchsorted(end, (end[a - 1] if a else 0) + limit)) + 1, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def encode(docs: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    """``keep`` plus ids, the piece ids of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(folder, model)
        for batch in batches:
            for part in _groups(batch):
                ids, cuts = p.encode([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))],
                                                 [*keep, "ids"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(text).cast("string"), *keep).mapInArrow(run, f"{kinds}ids array<int>")


def decode(coded: DataFrame, keep: list[str], ids: str = "ids", folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    """``keep`` plus text, decoded from the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(folder, model)
        for batch in batches:
            lists = batch.column(0).fill_null([]) if batch.column(0).null_count else batch.column(0)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(np.array([len(x) for x in lists], np.int64)))) if len(lists) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p.decode(flat, cuts), pa.string())], [*keep, "text"])

    kinds = "".join(f"`{c}` {coded.schema[c].dataType.simpleString()}, " for c in keep)
    return coded.select(F.col(ids).cast("array<int>"), *keep).mapInArrow(run, f"{kinds}text string")


def report(docs: DataFrame, folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_tokens, n_bytes (byte pieces among them), ids_md5 (of the ids as little-endian 32-bit
    numbers) and round_trip (whether decoding gives the text back)."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(folder, model)
        spelt = np.zeros(len(p.raw), bool)
        spelt[p.byte_id] = True
        for batch in batches:
            for part in _groups(batch):
                texts = [t or "" for t in part.column(0).to_pylist()]
                ids, cuts = p.encode(texts)
                back = p.decode(ids, cuts)
                n_bytes = np.concatenate(([0], np.cumsum(spelt[ids])))[cuts]
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(np.diff(cuts)), pa.array(np.diff(n_bytes).astype(np.int64)),
                     pa.array([hashlib.md5(ids[s:e].tobytes()).hexdigest() for s, e in spans]),
                     pa.array([x == y for x, y in zip(texts, back)])],
                    ["doc_id", "n_tokens", "n_bytes", "ids_md5", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("text").cast("string"), "doc_id").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_bytes long, ids_md5 string, round_trip boolean")
