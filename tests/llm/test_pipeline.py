"""Every stage of the pipeline against what it is to do with its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = after = docs.collect()
        if name == "quality rules":
            n = {r.doc_id: brute.n_words(r.text) for r in before}
            assert {r.doc_id for r in after} <= {d for d, k in n.items() if k >= 50} and len(after) > 0.7 * len(before)
        elif name == "near-duplicates":
            low = {d: c for d, _, c in brute.near_groups([(r.doc_id, r.text) for r in before])}
            assert Counter(r.doc_id for r in after) == Counter(set(low.values()))
        elif name == "repeated strings":
            want = {r.doc_id: w[4].decode("utf-8", "ignore") for r, w in zip(before, brute.repeats([r.text for r in before]))}
            assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
        elif name == "source mix":
            size, got = defaultdict(int), defaultdict(int)
            for r in before:
                size[r.source] += brute.n_words(r.text)
            longest = max(brute.n_words(r.text) for r in before)
            for r in after:
                got[r.source] += brute.n_words(r.text)
            assert max(Counter(r.doc_id for r in after).values()) == 2
            assert abs(sum(got.values()) - 1.5 * sum(size.values())) < longest * len(size)
        else:
            assert len(after) == len(before) and all(r.n_tokens == len(r.ids) > 0 for r in after if r.ids)


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and out.count() > 100


def test_stages_on_odd_rows_and_on_none(spark, sf, tmp_path):
    """Nulls in every column, empty and repeated rows, copies, other columns with clashing names; and no rows at all."""
    for name, docs in (("odd", brute.frame(spark)), ("none", spark.createDataFrame([], brute.SCHEMA))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            out = stage(spark, docs, sf)
            out.write.parquet(str(tmp_path / name / str(i)))
            docs = spark.read.parquet(str(tmp_path / name / str(i)))
            if i < 4:
                assert out.columns == before.columns and out.dtypes == before.dtypes
            if name == "none":
                assert docs.count() == 0
            elif i == 0:
                kept = docs.collect()
                assert 0 < len(kept) < before.count() and all(brute.n_words(r.text) for r in kept)
            elif i == 1:
                low = {c for _, n, c in brute.near_groups([(r.doc_id, r.text) for r in before.collect()])}
                assert {r.doc_id for r in docs.collect()} == low
            elif i == 2:
                assert docs.count() == before.count()
            elif i == 3:
                assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 2
            else:
                assert docs.count() == before.count()
