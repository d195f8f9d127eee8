"""The Merkle manifest, window dedup and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import lexical, merkle, windows
from tests.llm import brute

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


# ------------------------------------------------------------------ 11 Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        i >>= 1
    return out


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for i, source, lang, n, text in rows:
        bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        leaf, start = (sha(*map(field, (i, source, lang, m, text))) for m in (n, n + 1 if bad else n))
        trees[lang].append(((i is not None, i or 0, leaf), i, leaf, start))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([r[2] for r in sorted(trees[x])]) for x in names}
    top = levels([built[x][-1][0] for x in names])
    out = []
    for a, x in enumerate(names):
        for b, (_, i, leaf, h) in enumerate(sorted(trees[x])):
            path = siblings(built[x], b) + siblings(top, a)
            for s, left in path:
                h = sha(h) if s is None else sha(s, h) if left else sha(h, s)
            out.append((i, leaf, built[x][-1][0], top[-1][0], sha(*[s for s, _ in path if s]), h, h == top[-1][0]))
    return out


def fields(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


def test_manifest(docs, empty):
    assert Counter(map(tuple, merkle.report(docs).collect())) == Counter(manifest(fields(docs)))
    assert merkle.report(empty).collect() == []


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_in_other_storeys(docs, height):
    done = merkle.climb(merkle.build(docs, height)).select("doc_id", F.lower(F.hex("leaf")), F.lower(F.hex("proof_sha256")), F.lower(F.hex("folded")))
    assert Counter(map(tuple, done.collect())) == Counter((r[0], r[1], r[4], r[5]) for r in manifest(fields(docs)))


def test_manifest_of_many_repeated_rows_and_one_leaf(spark):
    rows = [(7, "t" * 50000, "en", "s", 1, 0, "", "", 0)] * 700 + [(i, f"t{i}", "=a/8/1", None, None, 0, "", "", 0) for i in range(300)]
    table = brute.frame(spark, rows)
    assert Counter(map(tuple, merkle.report(table).collect())) == Counter(manifest(fields(table)))
    lone = brute.frame(spark, [(3, None, None, None, 9223372036854775807, 0, "", "", 0)])
    assert [tuple(r) for r in merkle.report(lone).collect()] == manifest(fields(lone))


def test_row_limit_of_recursive_queries_is_put_back(docs):
    spark = docs.sparkSession
    before = spark.conf.get(merkle.ROW_LIMIT)
    merkle.report(docs)
    assert spark.conf.get(merkle.ROW_LIMIT) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("merkle_")]


# ------------------------------------------------------------------ 12 window dedup

def without_repeats(rows, length):
    """(doc_id, words, removed, kept text) of rows (doc_id, text)."""
    words = [WORD.findall(t or "") for _, t in rows]
    low = defaultdict(lambda: math.inf)
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - length + 1):
            low[tuple(w[k:k + length])] = min(low[tuple(w[k:k + length])], math.inf if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if low[tuple(w[k:k + length])] < (math.inf if i is None else i):
                gone[k:k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("length, sizes", [(13, {}), (13, {"chunk": 700, "shard": 2000}), (1, {"chunk": 1}), (4, {"shard": 500})])
def test_windows(docs, length, sizes):
    want = without_repeats([(r.doc_id, r.text) for r in docs.collect()], length)
    got = windows.report(docs, length=length, **sizes).collect()
    assert Counter(map(tuple, got)) == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in want)
    kept = windows.remove_repeats(docs, length=length, **sizes)
    assert kept.columns == [*docs.columns, "n_words", "removed", "kept_text"]
    rows = kept.collect()
    assert Counter((r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), r.kept_text) for r in rows) == Counter(want)
    for r in rows:   # intervals are maximal
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_windows_of_a_passage_in_every_document_and_of_long_texts(spark):
    rnd = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{' '.join(rnd.choice('abcdefgh') for _ in range(20))} {passage} {i} {passage} end{i % 3}") for i in range(300)]
    rows += [(1000 + i, "x " * 200_000 + f"tail{i}") for i in range(2)] + [(None, passage), (None, passage + " more")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for sizes in ({}, {"chunk": 5000, "shard": 50_000}):
        got = windows.report(table, **sizes).collect()
        assert Counter(map(tuple, got)) == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in without_repeats(rows, 13))


def test_windows_with_clashing_names(spark, empty):
    text = " ".join(map(str, range(20)))
    table = spark.createDataFrame([("b", text, 1, 2, 3), ("a", text, 4, 5, 6)], "name string, text string, n_words int, id int, tag int")
    got = {r.name: r for r in windows.remove_repeats(table, "name").collect()}
    assert got["a"].kept_text == text and got["b"].kept_text == "" and (got["b"].n_words, got["b"].n_words_) == (1, 20)
    assert windows.report(empty).collect() == [] and windows.remove_repeats(empty).collect() == []


def test_steps():
    for at in ([], [0], [254, 255, 256, 511, 100_000], [7, 10 ** 7, 10 ** 9], list(range(0, 5000, 3))):
        assert windows._places(windows._steps(np.array(at, np.int64))).tolist() == at


# ------------------------------------------------------------------ 13 lexical search

def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def ranked(docs, items, k=10):
    """(item_id, rank, score) and the (doc_id, score) of every document, per item."""
    counts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    sized = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(sized), sum(n for *_, n in sized)
    df = Counter(t for _, c, _ in sized for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in sized:
            m = 25 + 75 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in Counter(TERM.findall(lowered(text))).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return out


ITEMS = "item_id long, text string, doc_id string, score string"


@pytest.mark.parametrize("sizes", [{}, {"tree": 7, "block": 300}, {"k": 3, "tree": 40}])
def test_search(docs, sizes):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(k, t, "x", "y") for k, (_, t) in enumerate(rows[:25])] + [(None, "lorem TAIL", None, None), (100, None, None, None), (101, "nowhere!", None, None), (102, "", None, None)]
    got = lexical.search(docs, docs.sparkSession.createDataFrame(items, ITEMS), **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(ranked(rows, [i[:2] for i in items], sizes.get("k", 10)))


def test_search_in_copies_and_ties(spark):
    rows = [(i, "same words here") for i in range(400)] + [(500 + i, f"same words {'here ' * (i % 4)}") for i in range(80)] + [(900, "w" * 300_000), (None, "same words here")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(1, "here same"), (1, "words words"), (2, "w" * 300_000)]
    got = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), tree=16)
    assert Counter(map(tuple, got.collect())) == Counter(ranked(rows, items))


def test_search_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(docs, none).collect() == [] and lexical.search(empty, none).collect() == []
    assert lexical.search(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_trees_leave_out_what_cannot_win():
    """Vectors in groups of near copies: the search looks at few leaves, and finds what a full scan finds."""
    rnd = np.random.default_rng(5)
    n, per, width = 2000, 6, 400
    base = [np.sort(rnd.choice(20, per, replace=False) + 20 * g) for g in range(20)]
    at = np.concatenate([base[i % 20] for i in range(n)])
    v = lexical.Vectors(np.arange(0, n * per + 1, per), at, rnd.integers(95_000_000, 105_000_000, n * per), width)
    nodes = lexical.ball_tree(v, 16)
    assert sorted(np.concatenate([x[4] for x in nodes if not x[3]])) == list(range(n))
    looked = 0
    products = v.products

    def counted(rows, dense):
        nonlocal looked
        looked += len(rows)
        return products(rows, dense)
    v.products = counted
    for k in range(30):
        terms = np.sort(rnd.choice(base[k % 20], 4, replace=False))
        q = np.zeros(width, np.int64)
        q[terms] = 1
        full = products(np.arange(n), q)
        floor = np.sort(full)[-10]
        rows, scores = lexical.search_tree(v, nodes, terms, np.ones(4, np.int64), 10)
        assert set(rows[scores >= floor]) == set(np.flatnonzero(full >= floor)) and (full[rows] == scores).all()
    assert looked < 30 * n / 4
