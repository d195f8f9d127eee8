"""The training-data operators against brute force, round trips and SQL, on small tables with every odd case."""

import math
import random
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline.llm import lengths, licences, media, minhash, mixing, pieces, quality, queries, sharding, substrings, toxicity
from tests.llm import brute

FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def taken(rows):
    return sorted((tuple(r) for r in rows), key=str)


def in_duckdb(sql, rows):
    con = duckdb.connect()
    names = [c.split()[0].strip("`") for c in brute.SCHEMA.split(", ")]
    con.register("documents", pa.table({n: list(c) for n, c in zip(names, zip(*rows))}, schema=pa.schema(
        [(n, pa.string() if n in ("text", "lang", "source", "weight", "digest") else pa.int64()) for n in names])))
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


# ------------------------------------------------------------------ 1 mixing

def test_schedule_is_the_sql(docs):
    names, want = in_duckdb(queries.MIX_SQL, brute.rows())
    got = mixing.schedule(mixing.queue_rows(docs, [])).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", F.expr("aggregate(sent, 0L, (a, x) -> a + x)").alias("taken"))
    assert taken(got.select(*names).collect()) == taken(want)


def test_schedule_meets_targets(docs):
    rows = mixing.schedule(mixing.queue_rows(docs, [])).collect()
    sent, target = Counter(), {}
    for r in rows:
        assert 0 <= sum(r["sent"]) <= 2 * r["__size"]
        sent[r["__source"]] += sum(r["sent"])
        target[r["__source"]] = r["target"]
    for s, t in target.items():
        assert t - 1 < sent[s] <= t
    assert math.isclose(sum(target.values()), 1.5 * sum(brute.n_words(r[1]) for r in brute.rows()))


def test_finish_times_share_the_stream(spark):
    data = [(i, "w " * 50, "en", f"s{i % 3}", 0, 0, "", "", 0) for i in range(600)]
    rows = mixing.schedule(mixing.queue_rows(brute.frame(spark, data), []), share=0.5).collect()
    early = [r for r in rows if r["finish"][0] <= 500]
    n = Counter(r["__source"] for r in early)
    assert n["s0"] == 50 and n["s1"] == 20 and n["s2"] == 10


def test_mix_keeps_columns(docs, empty):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert max(Counter(tuple(r) for r in out.collect()).values()) <= 6   # two passes over three equal rows
    assert mixing.mix(empty).collect() == []


# ------------------------------------------------------------------ 2 media

def pictures(n, seed=3):
    base = media.textures(32)
    rng = np.random.default_rng(seed)
    return [(128 + 40 * x / x.std()).reshape(media.SIDE, media.SIDE) for x in rng.normal(size=(n, 32)).astype(np.float32) @ base]


def test_copies_are_found(spark):
    ims = pictures(40)
    index = [(i, bytearray(media.write_image(x))) for i, x in enumerate(ims)] + [(100, bytearray(media.write_image(ims[0]))), (101, None), (102, bytearray(b"P5 no image"))]
    asked = []
    for i in range(0, 40, 2):
        x = ims[i]
        asked.append((i, bytearray(media.write_image([x[6:90, 4:84], np.rot90(x), 0.7 * x + 30][i // 2 % 3]))))
    asked += [(200, None), (201, bytearray(media.write_image(pictures(1, 9)[0]))), (202, bytearray(b""))]
    got = media.find_copies(spark.createDataFrame(asked, "query_id long, image binary"), spark.createDataFrame(index, "image_id long, image binary")).collect()
    assert {(r.query_id, r.image_class) for r in got} == {(i, i) for i in range(0, 40, 2)}
    assert {r.copies for r in got if r.image_class == 0} == {2}
    none = spark.createDataFrame([], "query_id long, image binary")
    assert media.find_copies(none, spark.createDataFrame(index, "image_id long, image binary")).collect() == []


def agreeing_pairs(asked, index):
    """Brute force: the pairs of images that the verifier confirms."""
    a, b = ([media.corners(media.read_image(bytes(x))) for _, x in rows] for rows in (asked, index))
    return {(q, k) for (q, _), (da, p) in zip(asked, a) for (k, _), (db, r) in zip(index, b) if media.agreeing(da, p, db, r) >= media.NEEDED}


def test_altered_copies_are_found_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    ims = pictures(24, 4)
    index = [(i, bytearray(media.write_image(x))) for i, x in enumerate(ims)]
    asked = []
    for i, x in enumerate(ims):
        altered = [x + rng.normal(0, 14, x.shape), x + rng.normal(0, 25, x.shape), media.resized(x.astype(np.float32), 0.85), x[20:76, 16:72]]
        asked += [(100 * k + i, bytearray(media.write_image(y))) for k, y in enumerate(altered)]
    want = agreeing_pairs(asked, index)
    got = media.find_copies(spark.createDataFrame(asked, "query_id long, image binary"), spark.createDataFrame(index, "image_id long, image binary")).collect()
    found = {(r.query_id, r.image_class) for r in got}
    assert len(want) > 48 and found <= want and len(found) >= 0.97 * len(want)


def test_every_copy_of_a_query_is_returned(spark):
    ims = pictures(3, 6)
    index = [(i, bytearray(media.write_image(x))) for i, x in enumerate([ims[0], 0.7 * ims[0] + 30, np.rot90(ims[0]), ims[1], ims[2], ims[0]])]
    asked = [(i, bytearray(media.write_image(0.9 * ims[0] + 10))) for i in range(2)]
    got = media.find_copies(spark.createDataFrame(asked, "query_id long, image binary"), spark.createDataFrame(index, "image_id long, image binary")).collect()
    assert sorted((r.query_id, r.image_class, r.copies) for r in got) == [(q, c, n) for q in range(2) for c, n in ((0, 2), (1, 1), (2, 1))]
    assert all(r.agreeing >= media.NEEDED for r in got)


def test_small_part_of_a_large_picture_is_found(spark):
    large = np.block([pictures(5, s) for s in range(5)])
    asked = [(i, bytearray(media.write_image(large[y:y + 80, x:x + 80]))) for i, (y, x) in enumerate([(8, 8), (200, 104), (392, 296)])]
    got = media.find_copies(spark.createDataFrame(asked, "query_id long, image binary"), spark.createDataFrame([(7, bytearray(media.write_image(large)))], "image_id long, image binary")).collect()
    assert {(r.query_id, r.image_class) for r in got} == {(0, 7), (1, 7), (2, 7)}


def test_image_files():
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (media.read_image(media.write_image(x)) == x).all()
    assert (media.read_image(b"P6 # comment\n2 1\n255\n" + bytes([0, 3, 6, 1, 1, 1])) == [[3, 1]]).all()
    for bad in (None, b"", b"P5", b"P5\n9 9\n255\nxx", b"P5\n-1 2\n255\n", b"\x89PNG"):
        assert media.read_image(bad) is None
    assert len(media.corners(x)[0]) == 0 and len(media.corners(np.zeros((96, 96), np.float32))[0]) == 0


# ------------------------------------------------------------------ 3 substrings

@pytest.mark.parametrize("sizes", [{}, {"key_runs": 3, "shard_bytes": 2000}], ids=["whole keys", "split keys"])
def test_repeats_are_brute_force(docs, sizes):
    data = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *w[:4]) for r, w in zip(data, brute.repeats([r.text for r in data]))]
    assert taken(substrings.report(docs, **sizes).collect()) == taken(want)


def test_repeats_of_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    data = table.select("doc_id", "text").collect()
    want = [(r.doc_id, *w[:4]) for r, w in zip(data, brute.repeats([r.text for r in data]))]
    assert taken(substrings.report(table).collect()) == taken(want)


def test_long_text_in_pieces(monkeypatch):
    rnd = random.Random(1)
    t = np.frombuffer("".join(rnd.choice("ab cd") for _ in range(9000)).encode(), np.uint8)
    at = np.array([0, len(t)])
    key, s, e = next(substrings.text_runs(t, at))
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    monkeypatch.setattr(substrings, "chunks", lambda offsets: [(0, 1)])
    cut_key, cut_s, cut_e = next(substrings.text_runs(t, at))
    assert (np.repeat(key, e - s) == np.repeat(cut_key, cut_e - cut_s)).all() and cut_e[-1] == e[-1] == len(t) - 199


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    for alphabet, n in (("ab", 300), ("a", 100), ("abcdefgh", 500), ("ab\x00", 400), ("x", 1)):
        t = "".join(rnd.choice(alphabet) for _ in range(n)).encode()
        x = np.frombuffer(t, np.uint8)
        sa = substrings.suffix_array(x)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])

        def shared(a, b):
            k = 0
            while max(a, b) + k < n and t[a + k] == t[b + k]:
                k += 1
            return k
        assert substrings.common_prefixes(x, sa).tolist() == [0] + [shared(a, b) for a, b in zip(sa[:-1].tolist(), sa[1:].tolist())]


def test_merge_by_binary_search():
    rng = np.random.default_rng(4)
    runs, base = [], 0
    for _ in range(7):
        p = np.unique(rng.integers(0, 400, 60).astype(np.uint64))
        runs.append((p, p * np.uint64(3), np.arange(base, base + len(p))))
        base += len(p)
    ids = np.concatenate([r[2] for r in runs])
    values = np.concatenate([r[0] for r in runs])
    n = Counter(values.tolist())
    met = set(np.concatenate(substrings.merge_runs(runs)[3]).tolist())
    assert met == {i for i, v in zip(ids.tolist(), values.tolist()) if n[v] > 1}


def test_remove_repeats_keeps_columns(docs, empty):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    data = docs.collect()
    want = Counter((r.doc_id, w[4].decode("utf-8", "ignore")) for r, w in zip(data, brute.repeats([r.text for r in data])))
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want
    assert substrings.remove_repeats(empty).collect() == [] and substrings.report(empty).collect() == []


# ------------------------------------------------------------------ 4 MinHash

def test_groups_are_brute_force(docs):
    want = brute.near_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert taken(minhash.groups(docs).select("doc_id", "n_shingles", "component_id").collect()) == taken(want)


def test_groups_of_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.near_groups([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert taken(minhash.groups(table).select("doc_id", "n_shingles", "component_id").collect()) == taken(want)


def test_large_group_of_near_copies(spark):
    """Copies that differ from each other more than from their original, with outliers in their buckets."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(150):
        t = list(base)
        for _ in range(3 if i % 5 else 9):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10 ** 6)}"
        data.append((i, " ".join(t if i else base), "en", "s", 0, 0, "", "", 0))
    want = brute.near_groups([(r[0], r[1]) for r in data])
    assert taken(minhash.groups(brute.frame(spark, data)).select("doc_id", "n_shingles", "component_id").collect()) == taken(want)


def test_large_group_in_which_no_member_is_linked_with_most(spark):
    """Copies that differ in a choice of ten words, linked where at most three differ; outliers that share all but few
    shingles with them and are linked with none; and texts of the group with words of their own."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(420):
        t = list(base)
        for k in range(10):
            if rnd.random() < 0.5:
                t[7 + 11 * k] = f"x{k}"
        for k in range(0 if i % 3 else 5 if i % 2 else 1):
            t[2 + 22 * k] = f"own{i}"
        data.append((i, " ".join(t), "en", "s", 0, 0, "", "", 0))
    want = brute.near_groups([(r[0], r[1]) for r in data])
    assert 2 < len({c for *_, c in want}) < 200
    assert taken(minhash.groups(brute.frame(spark, data)).select("doc_id", "n_shingles", "component_id").collect()) == taken(want)


def test_components_of_chains(spark):
    edges = [(bytearray([a // 256, a % 256]), bytearray([(a + 1) // 256, (a + 1) % 256])) for a in range(0, 300) if a % 100 != 99]
    got = minhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    size = Counter(bytes(r.root) for r in got)
    assert sorted(size.values()) == [100, 100, 100] and len({bytes(r.node) for r in got}) == 300


def test_keep_one(docs, empty):
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    groups = defaultdict(set)
    for i, n, low in brute.near_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]):
        groups[low if n else ("none", i)].add(i)
    assert sum(ids.values()) == len(groups)
    assert minhash.keep_one(empty).collect() == []


# ------------------------------------------------------------------ 5 toxicity

def maximal(s):
    """All maximal-scoring segments, by their definition: the best segment, then left and right of it."""
    if not len(s) or max(s) <= 0:
        return []
    t = np.concatenate(([0.0], np.cumsum(s)))
    a, b = max(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda p: (t[p[1]] - t[p[0]], -(p[1] - p[0])))
    return maximal(s[:a]) + [(a, b)] + [(b + i, b + j) for i, j in maximal(s[b:])]


def test_segments_are_maximal():
    rnd = random.Random(6)
    for _ in range(300):
        s = np.array([rnd.gauss(-0.2, 1) for _ in range(rnd.randint(0, 25))])
        found = toxicity.segments(s)
        assert sorted((a, b) for a, b, _ in found) == sorted(maximal(s))
        assert all(math.isclose(v, s[a:b].sum(), abs_tol=1e-9) for a, b, v in found)


def test_passages_of_words_that_stood_before():
    bad = [f"bad{i}" for i in range(12)]
    table = np.zeros(toxicity.TABLE, np.float32)
    for cell, _, _ in toxicity.token_rows(pa.array(bad)):
        table[cell[0]] = 2.0
    model = toxicity.Model(table, 1.0, 0.0, (0.0, 0.0, 0.0))
    filler = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(16)]
    scattered = " ".join(f"{f} {b}" for f, b in zip(filler, bad)) + " " + filler[12]
    text = f"{scattered} {' '.join(bad)} {' '.join(filler)} {' '.join(bad)} {filler[15]}"
    (n, found), (m, again) = toxicity.measure(table, pa.array([text, "bad0 " * 200]))
    spans = [text[a:b] for a, b, s in found if model.normalised(s, n) > 5]
    assert spans == [" ".join(bad)] * 2
    assert toxicity.summary(model, m, again)[0] < 0


def test_toxicity_on_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(table, labels).join(labels, "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r for r in got if r.toxic == y] for y in (1, 0))
    assert np.mean([r.predicted for r in toxic]) > 0.7 and np.mean([r.predicted for r in clean]) < 0.04
    score = np.array([r.score for r in toxic + clean])
    rank = score.argsort().argsort() + 1
    auc = (rank[:len(toxic)].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.93 and score.min() >= 0 and score.max() <= 1


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert taken(toxicity.score_documents(empty, none).collect()) == []
    some = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    for labels in (none, some, some.where("toxic = 1")):
        got = toxicity.score_documents(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    model = toxicity.fit(docs, some)
    n_bytes = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    assert all(0 <= r.start < r.stop <= n_bytes[r.doc_id] and r.e_value <= 0.01 for r in toxicity.passages(docs, model).collect())


# ------------------------------------------------------------------ 6 sharding

def test_hilbert_curve_is_one(spark):
    for n, bits in ((2, 3), (3, 2)):
        cells = spark.range(1 << (n * bits)).select(*[((F.col("id") / (1 << (bits * i))).cast("int") % (1 << bits)).alias(f"a{i}") for i in range(n)])
        got = sorted((r.h, *r[:n]) for r in cells.withColumn("h", sharding.hilbert_index([f"a{i}" for i in range(n)], bits)).collect())
        assert [r[0] for r in got] == list(range(1 << (n * bits)))
        assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(got, got[1:]))


def test_shards(docs, empty):
    import zlib

    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard is None and r.law == "rows"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_documents(empty).collect() == []


def test_shards_by_bytes(spark):
    data = [(i, "x" * (i * 37 % 91), "en", f"s{i % 4}", 0, 0, "", "", 0) for i in range(800)]
    size, slots = Counter(), defaultdict(list)
    for r in sharding.shard_documents(brute.frame(spark, data), law="bytes").collect():
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 16
    assert all(abs(v - mean) <= 91 for v in size.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_write_shards(docs, spark, tmp_path):
    sharding.write_shards(sharding.shard_documents(docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# ------------------------------------------------------------------ 7 quality

def quality_rows():
    """Documents of one host that share ten lines; three hold little else."""
    rnd = random.Random(3)
    shared = [" ".join(f"{w}{k}" for w in ("All", "rights", "reserved", "by", "page", "of", "the", "host")) + " 1 of 9" for k in "abcdefghij"]
    out = []
    for i in range(60):
        own = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(40)) + "z" for _ in range(15)) for _ in range(10)]
        out.append((i, "\n".join(own + [x.replace("1 of", f" {i}  of") for x in shared] if i < 50 else own), "en", "s1" if i < 55 else None, 0, 0, "", "", 0))
    out += [(70 + i, "\n".join(shared) + f"\nalone{i}", "en", "s1", 0, 0, "", "", 0) for i in range(3)]
    return brute.rows() + out


def test_quality_is_the_sql(spark):
    names, want = in_duckdb(queries.QUALITY_SQL.replace("0.03", "0.2"), quality_rows())
    got = quality.verdicts(quality.text_features(brute.frame(spark, quality_rows()), ["doc_id"]), share=0.2)
    assert taken(got.select(*names).collect()) == taken(want)
    assert any(not r[names.index("kept")] and not r[names.index("base_failed")] for r in want)


def test_repeated_words_by_brute_force(spark):
    rnd = random.Random(12)
    data = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))), "en", "s", 0, 0, "", "", 0) for i in range(200)]
    for r in quality.text_features(brute.frame(spark, data), ["doc_id"]).collect():
        w = data[r.doc_id][1].split()
        n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        assert r.n_repeat_words == len({i + k for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for k in range(3)})


def test_keep_documents(spark, empty):
    table = brute.frame(spark, quality_rows())
    out = quality.keep_documents(table, share=0.2)
    assert out.columns == table.columns
    kept = {r.doc_id for r in out.collect() if r.weight == ""}
    mine = [r for r in out.collect() if r.doc_id in (1, 70, 71, 72) and "z" in r.text and r.weight == ""]
    assert [r.doc_id for r in mine] == [1] and "reserved" not in mine[0].text and mine[0].n_chars == len(mine[0].text) and 2 in kept
    assert quality.keep_documents(empty).collect() == []


def test_repeats_in_a_very_long_text_are_exact(spark):
    """Three million different words with one window twice: six words lie in repeated windows."""
    words = [f"{i:x}" for i in range(3_000_000)]
    words[2_000_000:2_000_003] = words[5:8]
    rows = [(1, " ".join(words), "en", "s", 0, 0, "", "", 0), (2, " ".join([*words[:40_000], *words[5:9]]), "en", "s", 0, 0, "", "", 0)]
    got = quality.text_features(spark.createDataFrame(rows, brute.SCHEMA), ["doc_id"]).select("doc_id", "n_words", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == [(1, 3_000_000, 6), (2, 40_004, 8)]


# ------------------------------------------------------------------ 8 lengths

def test_length_histogram(docs, empty):
    enc = lengths.encoder(FOLDER, lengths.VOCABULARY)
    n = sorted(len(enc.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
    sums = lengths.suffix_sums(lengths.histogram(docs)).cache()
    for r in sums.collect():
        assert (r.n_docs, r.docs_ge, r.tokens_ge) == (n.count(r.length), sum(v >= r.length for v in n), sum(v for v in n if v >= r.length))
        assert r.truncated == sum(min(v, r.length) for v in n) and r.total == sum(n)
        assert math.isclose(r.cumulative, sum(v <= r.length for v in n) / len(n))
    for r in lengths.at_limits(sums, [0, 1, 7, 100, 10 ** 6]).collect():
        assert (r.n_cut, r.truncated) == (sum(v > r.limit for v in n), sum(min(v, r.limit) for v in n))
    for r in lengths.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.length == next(v for v in n if sum(w <= v for w in n) / len(n) >= r.share)
    assert lengths.suffix_sums(lengths.histogram(empty)).collect() == []


# ------------------------------------------------------------------ 9 licences

def test_licence_digests(spark, docs, empty):
    mit = dict(licences.KNOWN)["MIT"]
    isc = dict(licences.KNOWN)["ISC"]
    data = [(0, mit, "MIT"), (1, "  RELEASED under   the MIT licence!!\n", "MIT"), (2, "Copyright (c) 2020 A. Person\n\n" + isc.replace(", ", ",\n"), "ISC"),
            (3, mit + " And more.", None), (4, None, None), (5, "Copyright 2020 by nobody", None), (6, "Words.\n" + mit + "\nWords.\n(c) 1999 x\n" + mit, None)]
    table = spark.createDataFrame([(i, t, "en", "s", 0, 0, "", "", 0) for i, t, _ in data], brute.SCHEMA)
    known = licences.known_table(spark)
    got = {r.doc_id: r for r in licences.scan(table, known).collect()}
    assert {i: got[i].licence for i in got} == {i: w for i, _, w in data}
    assert got[6].n_notices == 2 and got[6].notices == "MIT" and got[4].digest is None and got[5].digest is None
    assert licences.scan(docs, known).count() == docs.count() and licences.scan(empty, known).collect() == []


def test_licences_wrapped_anywhere(spark):
    import textwrap

    notices = ["Copyright (c) 2020 A. Person", "Copyright 2001-2020 A. Person", "Copyright by A. Person", "© A. Person", "(C) 1999 A. Person", "Copyright [yyyy] [name of copyright owner]"]
    rows, want = [], {}
    for name, text in licences.KNOWN:
        for width in range(24, 101, 4):
            want[len(rows)] = name
            rows.append((len(rows), notices[len(rows) % len(notices)] + "\n\n" + textwrap.fill(text, width), "en", "s", 0, 0, "", "", 0))
    got = licences.scan(spark.createDataFrame(rows, brute.SCHEMA), licences.known_table(spark)).collect()
    assert {r.doc_id: r.licence for r in got} == want


def test_whole_licences_are_known(spark):
    def text(name):
        return (licences.TEXTS / f"{name}.txt").read_text(encoding="utf-8")

    head = "Copyright (c) 2020 A. Person"
    cases = [(name, text(name)) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")]
    cases += [(name, f"{title}\n\n{head}\n{rights}\n{text(name)}") for name, title, rights in (
        ("MIT", "The MIT License (MIT)", ""), ("MIT", "", ""), ("BSD-2-Clause", "", "All rights reserved.\n"),
        ("BSD-3-Clause", "BSD 3-Clause License", ""), ("ISC", "ISC License", ""))]
    cases += [("Apache-2.0", text("Apache-2.0").split("APPENDIX:")[0]), (None, text("MIT") + "\nAnd more."), (None, text("GPL-3.0")[:20000])]
    rows = [(i, t, "en", "s", 0, 0, "", "", 0) for i, (_, t) in enumerate(cases)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, brute.SCHEMA), licences.known_table(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


# ------------------------------------------------------------------ 10 pieces

def unigram(p):
    """The library's own unigram model over the pieces and scores that the operator uses."""
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{pieces.MODEL}")

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(tag, kind, value):
        return number(tag << 3 | kind) + (number(len(value)) + value if kind == 2 else value)
    body = b""
    for i in range(source.get_piece_size()):
        kind = 2 if source.is_unknown(i) else 3 if source.is_control(i) else 6 if source.is_byte(i) else 1
        score = struct.pack("<f", np.float32(-np.log(2.0 - min(source.get_score(i), 0))))
        body += field(1, 2, field(1, 2, source.id_to_piece(i).encode()) + field(2, 5, score) + field(3, 0, number(kind)))
    trainer = field(3, 0, number(1)) + field(35, 0, number(1))
    normal = field(1, 2, b"identity") + field(3, 0, number(1)) + field(4, 0, number(0)) + field(5, 0, number(1))
    return sentencepiece.SentencePieceProcessor(model_proto=body + field(2, 2, trainer) + field(3, 2, normal))


def test_pieces_are_the_librarys_viterbi(spark, sf):
    p = pieces.pieces(FOLDER)
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect() for w in r.text.split()})
    words += ["naïve", "日本語", "🙂🙂", "a" * 50, "x\ny", "  two  spaces "]
    ids, cuts = p.encode(words)
    score = {int(i): float(s) for i, s in zip(p.id, p.score)}
    same = 0
    for k, (w, want) in enumerate(zip(words, unigram(p).encode(words))):
        got = ids[cuts[k]:cuts[k + 1]].tolist()
        same += got == want
        # float sums of equal segmentations may order ties either way
        assert got == want or math.isclose(sum(score.get(i, 0) for i in got), sum(score.get(i, 0) for i in want), rel_tol=1e-5), w
    assert same >= 0.99 * len(words)


def test_pieces_round_trip(docs, empty):
    coded = pieces.encode(docs, ["doc_id", "weight"])
    back = pieces.decode(coded, ["doc_id"])
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    for r in pieces.report(docs).collect():
        assert r.round_trip
    assert pieces.encode(empty, ["doc_id"]).collect() == [] and pieces.report(empty).collect() == []
    assert pieces.pieces(FOLDER).decode(np.array([-1, 10 ** 6, 0]), np.array([0, 3])) == [""]


def test_pieces_do_not_depend_on_batches(spark, sf):
    p = pieces.Pieces(f"{FOLDER}/{pieces.MODEL}")
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(20).collect()]
    ids, cuts = p.encode(texts)
    for k, t in enumerate(texts):
        assert p.encode([t])[0].tolist() == ids[cuts[k]:cuts[k + 1]].tolist()


def test_texts_are_hashed_together(monkeypatch):
    """The runs of many small texts take few passes, and are those of each text alone; texts that go as a whole take none."""
    import zlib

    import numpy as np
    import pyarrow as pa

    from strataline.llm import substrings as SU

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (200, 450, 3000, 201, 900)]
    rows = [{"z": pa.scalar(zlib.compress(t)), "i": i} for i, t in enumerate(texts)]
    passes, runs = [], SU.window_runs
    monkeypatch.setattr(SU, "window_runs", lambda *a: (passes.append(1), runs(*a))[1])
    got = list(SU.unpacked(rows, lambda r: r["i"] != 3))
    assert len(passes) == 1 and [r["i"] for r, *_ in got] == [0, 1, 2, 3, 4]
    for t, (r, x, key, s, e, prints) in zip(texts, got):
        assert x.tobytes() == t
        _, k, a, b = runs(x, np.array([0, len(x)]))
        if r["i"] == 3:
            assert not len(key) and not len(s)
        else:
            assert (key.view(np.uint64) == k).all() and (s == a).all() and (e == b).all() and (prints == SU.run_prints(x, s, e)).all()
