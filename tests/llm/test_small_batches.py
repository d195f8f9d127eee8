"""What a Python worker holds grows with small batches, not with those it is given."""

import numpy as np
import pyarrow as pa

from strataline.llm import media


def test_pictures_come_in_small_batches():
    rng = np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(0, 12000, 20)), pa.array(list(rng.normal(size=(600, 4))))], ["vec_id", "embedding"])
    out = list(media.drawn_and_edited(iter([batch])))
    assert [b.num_rows for b in out] == [256, 256, 88]
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(0, 12000, 20))
    whole = next(media.drawn(iter([batch.slice(300, 1)]))).column(1)[0]
    assert next(media.edited(iter([pa.RecordBatch.from_arrays([pa.array([6000]), pa.array([whole.as_py()])], ["i", "x"])]))).column(1)[0] == out[1].column(1)[44]
