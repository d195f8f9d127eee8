"""Texts become Python strings a run of rows at a time."""

import pyarrow as pa

from strataline.llm import pieces, substrings


def test_runs_of_rows():
    texts = ["ab", None, "ü" * 5, "", "c" * 9, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], ["text", "i"])
    parts = list(pieces._groups(batch, 7))
    assert [p.column(1).to_pylist() for p in parts] == [[0, 1, 2], [3, 4], [5]]
    assert list(pieces._groups(batch.slice(0, 0))) == []
    assert pieces.HELD_UNITS <= 100_000 and substrings.SHARD_BYTES <= 1 << 20
