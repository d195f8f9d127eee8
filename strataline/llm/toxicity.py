"""Toxicity by maximum-scoring segments.

Every token has a score, its log-odds between toxic and clean documents (counted once per document) under a Dirichlet
prior in proportion to the token's overall frequency.  A word that is not significant by itself takes the log-odds of its longest significant
beginning (compounds and inflected forms are too rare to learn one by one); what is not significant at all counts as
nothing, and a small drift is taken off, so that a clean text scores downhill.  A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.  By
extreme-value theory the best segment of a clean text of n tokens has lambda * score - ln(K n) distributed by Gumbel's
law; lambda comes from the clean token distribution, K from clean documents.  A segment's normalised score is its
significance; a document's are the best one and the sum over its significant segments, from which a logistic curve,
fitted on labelled rows that took no part in the token scores, gives its score.

The fit uses a sample of at most SAMPLE labelled rows, the ones with the smallest digests of their doc_id.  Tokens are
hashed into TABLE cells, so the broadcast table has one size whatever the input.

Defined results: null, empty and token-free texts have no segment and get the score of a text without evidence; null
doc_ids are not held out and never learnt from; equal rows score alike; without labels of both kinds every score is
the share of toxic labels seen (0 if none); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import settle
from strataline.llm.tokens import PUNCTUATION, chunks, raw, word_hashes

SAMPLE = 20_000    # labelled rows that the fit uses at most
TABLE = 1 << 20    # cells of the token table
LEAST_SEEN = 5     # documents behind a score at least
BEGINNINGS = (6, 5, 4)   # bytes of the word beginnings that back a word up, longest first
PRIOR = 1000.0     # tokens that the prior is worth
CHANCE = 10        # tokens that may pass as significant by chance, however many there are
DRIFT = 0.05
NEAR = 40          # tokens within which a word that stood before does not score again
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


@dataclass
class Model:
    """Token scores, the extreme-value constants and the logistic curve."""

    table: np.ndarray
    rate: float
    log_k: float
    curve: tuple[float, float, float]

    def normalised(self, score, n):
        return self.rate * score - self.log_k - np.log(np.maximum(n, 1))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def token_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (of the word and its beginnings), first byte and end of the tokens of each text."""
    x, offsets = raw(texts)
    for a, b in chunks(offsets):
        h, row, start, end, *begun = word_hashes(x[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], PUNCTUATION, BEGINNINGS)
        cut = np.searchsorted(row, np.arange(b - a + 1))
        cell = np.stack([(g % np.uint64(TABLE)).astype(np.int64) for g in (h, *begun)])
        for i in range(b - a):
            s = slice(cut[i], cut[i + 1])
            base = offsets[a + i] - offsets[a]
            yield cell[:, s], start[s] - base, end[s] - base


def word_scores(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The scores of words: their own, or else that of the longest beginning that has one.  A word that stood
    within the last NEAR tokens cannot score, so that one word over and over is not a passage; further back does not count."""
    score = table[cell[0]]
    for c in cell[1:]:
        score = np.where(score == 0, table[c], score)
    order = np.argsort(cell[0], kind="stable")
    again = np.zeros(len(score), bool)
    again[order[1:]] = (np.diff(cell[0][order]) == 0) & (np.diff(order) <= NEAR)
    return np.where(again, np.minimum(score, 0), score) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in one pass over the scores."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[list] = []          # first, end, sum before it, sum at its end
    back: list[int] = []           # for each held segment, the last earlier one with a smaller sum before it
    for i in up.tolist():
        cur, left, right = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = back[j]
            if j < 0 or held[j][3] >= right:
                held.append([cur, i + 1, left, right])
                back.append(j)
                break
            cur, left = held[j][0], held[j][2]
            del held[j:], back[j:]
    return [(a, b, r - q) for a, b, q, r in held]


def measure(model_table: np.ndarray, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Number of tokens and maximal segments (first byte, end, score) of each text."""
    for cell, start, end in token_rows(texts):
        found = segments(word_scores(model_table, cell))
        yield cell.shape[1], [(int(start[a]), int(end[b - 1]), s) for a, b, s in found]


def summary(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The best normalised score and the sum of the significant ones."""
    if not found:
        return float(model.normalised(0.0, n)), 0.0
    each = model.normalised(np.array([s for _, _, s in found]), n)
    return float(each.max()), float(each[each > 0].sum())


# ------------------------------------------------------------------ fitting

def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic, tune of the sampled labelled rows outside the held-out fold; tune rows fit the curve."""
    digest = F.md5(F.col("doc_id").cast("string"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("__d", digest).orderBy("__d", "doc_id").limit(sample)
    known = known.select("doc_id", "toxic", (F.conv(F.substring("__d", 29, 4), 16, 10).cast("int") % 3 == 0).alias("tune"))
    # at most ``sample`` small rows: a bound that does not grow with the input
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def token_scores(rows: DataFrame) -> np.ndarray:
    """The table of significant log-odds, from labelled rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, TABLE), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for toxic, (cell, _, _) in zip(batch.column(1).to_pylist(), token_rows(batch.column(0))):
                # once per document: a word repeated in one toxic document says nothing about others
                n[int(toxic > 0)] += len(np.unique(cell[0]))
                both[int(toxic > 0), np.unique(cell)] += 1
        at = np.flatnonzero(both.sum(0))
        cols = [np.append(at, -1), np.append(both[0, at], n[0]), np.append(both[1, at], n[1])]   # cell -1: all words
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["cell", "clean", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(count, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = got.where((F.col("clean") + F.col("toxic") >= LEAST_SEEN) | (F.col("cell") < 0)).toArrow()   # TABLE rows at most
    cell, c, t = (got.column(i).to_numpy().astype(np.float64) for i in range(3))
    if not (cell < 0).any():
        return np.zeros(TABLE, np.float32)
    n_clean, n_toxic = c[cell < 0][0], t[cell < 0][0]
    cell, c, t = (v[cell >= 0] for v in (cell, c, t))
    prior = PRIOR * (c + t) / max(n_clean + n_toxic, 1)
    t, c = t + prior, c + prior
    odds = np.log(t / np.maximum(n_toxic + PRIOR - t, 1e-9)) - np.log(c / np.maximum(n_clean + PRIOR - c, 1e-9))
    table = np.zeros(TABLE, np.float32)
    least_z = NormalDist().inv_cdf(1 - min(0.5, CHANCE / max(len(cell), 1)))
    table[cell.astype(np.int64)] = np.where(np.abs(odds / np.sqrt(1 / t + 1 / c)) >= least_z, odds, 0.0)
    return table


def clean_scores(rows: DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word scores of clean rows, in steps of 0.01, and their shares."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_scores(table, cell) for cell, _, _ in token_rows(batch.column(0))]
            step, n = np.unique(np.round(np.concatenate(found or [np.zeros(0)]) * 100).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n.astype(np.int64))], ["step", "n"])

    got = rows.where("toxic = 0").select("text").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    step, n = got.column(0).to_numpy() / 100, got.column(1).to_numpy().astype(float)
    return step, n / max(n.sum(), 1)


def solve_rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1; 1 where no score is positive."""
    if not (score > 0).any():
        return 1.0

    def above(rate):
        return (share * np.exp(np.minimum(rate * score, 500))).sum() >= 1
    lo, hi = 0.0, 1.0
    while not above(hi):
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if above(mid) else (mid, hi)
    return hi


def fit_curve(features: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(y)), features])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def squeeze(best, rest):
    """The two features of the curve; their logarithms keep very long toxic texts in range."""
    return np.arcsinh(best), np.log1p(rest)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = settle(sample_rows(docs, labels, sample))
    learn, tune = rows.where("not tune"), rows.where("tune")
    table = token_scores(learn)
    model = Model(table, solve_rate(*clean_scores(tune, table)), 0.0, (0.0, 0.0, 0.0))
    # a sampled id may stand on several rows: one value per id keeps what is collected below the sample's size
    got = features(tune.select("doc_id", "text", "toxic"), model, ["doc_id", "toxic"]).groupBy("doc_id").agg(
        F.max("toxic"), F.max("best"), F.max("rest"), F.max("n")).collect()
    if not got:
        return Model(table, model.rate, 0.0, (-30.0, 0.0, 0.0))
    _, y, best, rest, n = (np.array(c, float) for c in zip(*[(0, *r[1:]) for r in got]))
    if len(set(y)) < 2:
        share_toxic = float(np.clip(y.mean(), 1e-9, 1 - 1e-9))
        return Model(table, model.rate, 0.0, (float(np.log(share_toxic / (1 - share_toxic))), 0.0, 0.0))
    # Gumbel's mean is ln K plus Euler's constant
    log_k = float(best[(y == 0) & (n > 0)].mean() - 0.5772156649) if ((y == 0) & (n > 0)).any() else 0.0
    model = Model(table, model.rate, log_k, model.curve)
    got = features(tune.select("doc_id", "text", "toxic"), model, ["doc_id", "toxic"]).groupBy("doc_id").agg(
        F.max("toxic"), F.max("best"), F.max("rest")).collect()
    _, y, best, rest = (np.array(c, float) for c in zip(*[(0, *r[1:]) for r in got]))
    return Model(table, model.rate, log_k, fit_curve(np.column_stack(squeeze(best, rest)), y))


# ------------------------------------------------------------------ scoring

def features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` plus best, rest (see :func:`summary`), n (tokens) and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # TABLE cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [(n, *summary(m, n, found)) for n, found in measure(m.table, batch.column(0))]
            n, best, rest = (np.array(c, float) for c in zip(*rows)) if rows else (np.zeros(0),) * 3
            a, b = squeeze(best, rest)
            w = m.curve
            score = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * a + w[2] * b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best), pa.array(rest), pa.array(n.astype(np.int64)), pa.array(score)],
                                             [*keep, "best", "rest", "n", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").cast("string"), *keep).mapInArrow(run, f"{kinds}, best double, rest double, n long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = features(docs, fit(docs, labels, sample), ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Model, expected: float = 0.01) -> DataFrame:
    """Every significant passage: doc_id, start, stop (bytes of the UTF-8 text), significance (normalised score) and
    e_value, the number of such passages to expect in a clean text of this length (at most ``expected``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for i, (n, found) in enumerate(measure(m.table, batch.column(1))):
                for a, b, s in found:
                    v = float(m.normalised(s, n))
                    if np.exp(-v) <= expected:
                        out.append((i, a, b, v, float(np.exp(-v))))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64())], ["doc_id", "start", "stop", "significance", "e_value"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, start long, stop long, significance double, e_value double")
