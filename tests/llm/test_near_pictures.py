"""Many near copies of one picture: a query meets them block by block, not one by one for each substring."""

import numpy as np

from strataline.llm import media


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        yield kind, plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def test_near_copies_meet_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.random.default_rng(3).normal(size=32).astype(np.float32) @ media.textures(32)
    near = [(128 + 40 * x / x.std()).reshape(media.SIDE, media.SIDE) + rng.normal(0, 4, (media.SIDE, media.SIDE)) for _ in range(120)]
    index = [(i, bytearray(media.write_image(y))) for i, y in enumerate(near)]
    asked = [(i, bytearray(media.write_image(y[6:90, 4:84]))) for i, y in enumerate(near[:12])]
    df = media.find_copies(spark.createDataFrame(asked, "query_id long, image binary"), spark.createDataFrame(index, "image_id long, image binary"))
    got = {(r.query_id, r.image_class) for r in df.collect()}
    a, b = ([media.corners(media.read_image(bytes(v))) for _, v in rows] for rows in (asked, index))
    assert got == {(q, i) for q, (d, p) in enumerate(a) for i, (e, r) in enumerate(b) if media.meeting(d, e) > 1 and media.agreeing(d, p, e, r) >= media.NEEDED}
    assert len(got) > 1000
    made = [p.metrics().apply("numOutputRows").value() for kind, p in nodes(df._jdf.queryExecution().executedPlan())
            if "Join" in kind and p.metrics().contains("numOutputRows")]
    assert made and max(made) < 25 * len(got)


def test_meeting_counts_different_corners():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (6, media.BITS // 8), np.uint8)
    b = a.copy()
    b[2] ^= 0b10                       # a bit of each byte: too far in every substring
    b[3, 5] ^= 0b100                   # one bit in all
    b[4, 4:] = ~b[4, 4:]               # the same first substring, too far as a whole
    assert media.meeting(a, b) == 4 and media.meeting(a[[0, 0, 0]], b) == 1
    assert media.meeting(a[:0], b) == media.meeting(a, b[:0]) == 0
