"""The whole prepare job on hand-made cases."""

import numpy as np
import plain
from test_operators import SCHEMA, sub

from attnmaps.functions import dense
from attnmaps.plans import jobs


def test_own_sizes_classes_participants_and_masks(spark):
    rows = [sub(100 * k + i, 4, image=key, user=i, clicks=[((3 * i + j) % 24, (i + 5 * j) % 12) for j in range(4)]) for k, key in enumerate(["a/wide.png", "a/plain.png", "b/out.png", "a/full.png", "a/nomask.png"]) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = spark.createDataFrame([("a",)], "category string")
    verdicts = spark.createDataFrame([(r[0], int(r[0] % 3 != 0)) for r in rows], "sub_id long, good int")
    dims = spark.createDataFrame([("a/wide.png", 24, 12), ("a/full.png", 16, 16)], "image_key string, width int, height int")
    spots = [("a/wide", 0, 23), ("a/plain", 0, 15)] + [("a/full", y, x) for y in range(16) for x in range(16)]
    masks = spark.createDataFrame(spots, "mask_key string, y int, x int")
    p = jobs.Prepare(image_shape=(16, 16), blur_size=3, min_subjects=2)
    heat, counts = jobs.prepare(df, p, classes, verdicts, dims, masks, 0.02)
    found = {r.image_key: r for r in heat.collect()}
    assert sorted(found) == ["a/plain.png", "a/wide.png"] and {r.image_key: r.maps for r in counts.collect()} == {"a/plain.png": 5, "a/wide.png": 6}
    for key, h, w, size in (("a/wide.png", 12, 24, 3), ("a/plain.png", 16, 16, 3)):
        own = [r for r in rows if r[3] == key and r[0] % 3]
        stack = plain.stack_of([[c[0] for c in r[8]] for r in own], [[c[1] for c in r[8]] for r in own], h, w)
        stack = stack[stack.sum((1, 2)) > 0]  # a submission beyond the canvas has no map
        r = found[key]
        assert (r.h, r.w) == (h, w) and np.allclose(np.array(r.data).reshape(h, w), dense.blur(stack.mean(0), size), atol=1e-6)


def test_no_rows_and_no_filters(spark):
    p = jobs.Prepare(image_shape=(8, 8), blur_size=3)
    heat, counts = jobs.prepare(spark.createDataFrame([], SCHEMA), p)
    assert heat.count() == counts.count() == 0
    many = [sub(1, 600, clicks=[(1, 1)] * 600), sub(2, 2, user=2, clicks=[(2, 2), (9, 9)])]
    found = jobs.mean_maps(jobs.clean(spark.createDataFrame(many, SCHEMA), p), p, 8, 8).collect()
    assert {(r.y, r.x): r.v for r in found} == {(1, 1): 127.5, (2, 2): 0.5}
