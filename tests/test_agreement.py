"""Agreement jobs, nearest references and heatmaps on hand-made cases, and their plans."""

import struct
import zlib
from dataclasses import replace

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, sub

from attnmaps.functions import dense, metrics
from attnmaps.operators import agreement, joins, raster, sinks
from attnmaps.plans import jobs
from attnmaps.sources import readers

P = agreement.Agreement(h=16, w=16, kernel=3, iterations=3)


@pytest.fixture
def images(spark):
    def make(*keys, n=8):
        rows = [sub(100 * k + i, 4, image=key, user=i, clicks=[((i * j + k) % 16, (i + j * k) % 16) for j in range(5)]) for k, key in enumerate(keys) for i in range(n)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_with_odd_characters(images, spark):
    keys = ["a#b/c#1.png", "a/b|2.png", "q#_00000.png", "q#_00001.png", "q#_00002.png"]
    swept = agreement.subject_sweep(images(*keys), [4, 6], P).collect()
    assert {(r.image_key, r.cap, r.kind) for r in swept} == {(k, c, x) for k in keys for c in (4, 6) for x in ("ceiling", "floor")} and len(swept) == 5 * 2 * 2 * 3
    frames = spark.createDataFrame([(k,) for k in keys[2:]], "frame_key string")
    scales = frames.select(F.col("frame_key").alias("key"), F.lit(1.0).alias("scale"))
    found = agreement.scale_constancy(images(*keys[2:]), joins.frame_pairs(frames, "scale")[0], scales, P).collect()
    assert {(r.image_key, r.kind) for r in found} == {(k, x) for k in keys[2:] for x in ("ceiling", "floor")}


def test_weights_make_halves_of_the_stated_sizes(images):
    rows = agreement.half_weights(agreement.members(agreement.stacks(images("a/b.png", "a/c.png", n=7), P), P), P).collect()
    for key in ("a/b.png", "a/c.png"):
        own = [r for r in rows if r.image_key == key and r.iteration == 1]
        test, ref = ([r for r in own if r.half == x] for x in ("test", "ref"))
        assert sum(r.weight for r in test) == 6 == test[0]["size"] and sum(r.weight for r in ref) == 7 == ref[0]["size"]
        assert len({r.sub_id for r in own}) == 7 and not {r.sub_id for r in test} & {r.sub_id for r in ref}


def test_scores_against_dense_stacks(images):
    """Weights times dense maps, blurred and scored by the plain definition."""
    subs = images("a/b.png", "a/c.png")
    stack = {(r.image_key, r.sub_id): plain.stack_of([[c.x for c in r.clicks]], [[c.y for c in r.clicks]], 16, 16)[0] for r in subs.collect()}
    means = {}
    for r in agreement.half_weights(agreement.members(agreement.stacks(subs, P), P), P).collect():
        means[r.image_key, r.iteration, r.half] = means.get((r.image_key, r.iteration, r.half), 0) + r.weight / r["size"] * stack[r.image_key, r.sub_id].astype(float)
    for r in agreement.split_half(subs, P).collect():
        a, b = (np.round(dense.blur(means[r.image_key, r.iteration, x], 3), 10) for x in ("test", "ref"))
        assert r.score == pytest.approx(metrics.spearman(a, b))


def test_each_image_has_its_own_blur(images, spark):
    subs = images("a/b.png", "a/c.png")
    dims = spark.createDataFrame([("a/b.png", 48, 48)], "image_key string, width int, height int")
    plain, own = ({(r.image_key, r.iteration): r.score for r in agreement.split_half(x, P).collect()} for x in (subs, jobs.with_kernel(subs, dims, 3, (16, 16))))
    assert all(plain["a/c.png", i] == own["a/c.png", i] and plain["a/b.png", i] != own["a/b.png", i] for i in range(3))


def test_depth_does_not_travel_with_clicks(images, spark):
    frames = spark.createDataFrame([(f"q_{k:05d}.png",) for k in range(3)], "frame_key string")
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(4)]) for i in range(4)])
    cameras = frames.select(F.col("frame_key").alias("key"), eye.alias("w2c"), eye.alias("k"), F.array_repeat(F.lit(1.0), 256).alias("depth"))
    pairs = spark.createDataFrame([("q_00000.png", 1, "q_00001.png")], "key string, diff int, target_key string")
    found = agreement.rotation_constancy(images("q_00000.png", "q_00001.png"), pairs, cameras, P)
    left = plan_of(found).split("FlatMapCoGroupsInPandas", 1)[1]
    assert not any("depth" in line and ("totals" in line or "cells" in line) for line in left.splitlines())


def test_pixels_travel_once_whatever_the_iterations(images):
    clicked, counts = agreement.stacks(images("a/b.png", "a/c.png"), P), []
    for iterations in (10, 100):
        df = agreement.half_maps(clicked, replace(P, iterations=iterations), kinds=("ceiling", "floor"))
        plan = df._jdf.queryExecution().executedPlan()
        shuffles = [line for line in plan.toString().splitlines() if " Exchange hashpartitioning(" in line]
        counts.append(len(shuffles))
        # from the union up: one exchange, by image and lot; the draws' branch has no cells of its own
        top, _, below = plan.toString().partition("Union")
        assert top.count("Exchange hashpartitioning(image_key") == 1
        branches = [b for b in below.split("\n") if "transform(filter(clicks" in b]
        assert len(branches) == 1
    assert counts[0] == counts[1]


@pytest.mark.parametrize("levels, metric", [(1, "spearman"), (4, "auc")])
def test_lots_and_gathering_change_nothing(images, monkeypatch, levels, metric):
    subs, p = images("a/b.png", "a/c.png", "a/d.png", n=9), replace(P, iterations=13, levels=levels, metric=metric)
    run = lambda: {tuple(r)[:-1]: round(r.score, 9) for r in agreement.ceiling_floor(subs, p).collect()}
    whole = run()
    assert len(whole) == 2 * 3 * 13 * len({k[1] for k in whole})
    monkeypatch.setattr(agreement, "LOT", 2)
    assert run() == whole


def test_sums_of_many_clicks():
    rng = np.random.default_rng(0)
    own, plain = agreement._Sums(6), np.zeros((50, 6), dtype=int)
    for k in range(300):
        cells, weights = rng.integers(0, 50, 400 if k % 50 == 0 else 90), rng.integers(0, 3, 6)
        cells = np.where(cells < 40, 7, cells) if k % 50 == 0 else cells
        own.add(cells, weights)
        plain += np.minimum(np.bincount(cells, minlength=50), 255)[:, None] * weights
    own.gather()
    assert (own.totals == plain[own.cells]).all() and plain.sum() == own.totals.sum()


def test_nothing_behind_the_camera_is_painted():
    turned = np.diag([-1.0, 1, -1, 1])
    k = [[20.0, 0, 16], [0, 20, 16], [0, 0, 1]]
    assert not dense.reproject(np.ones((32, 32)), np.full((32, 32), 10.0), np.full((32, 32), 10.0), np.eye(4), turned, k, k).any()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_nearest_of_many_near_equal_references(spark, tmp_path, scale):
    rng = np.random.default_rng(0)
    known = np.repeat(rng.normal(size=(1, 8)), 40, axis=0) * scale
    known[20:] += rng.normal(size=(20, 8)) * 1e-9 * scale
    asked = known[25:30] + 1e-10 * scale
    refs = spark.createDataFrame([(int(100 - k), v.tolist()) for k, v in enumerate(known)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "id long, embedding array<double>")
    found = {r.id: (r.ref_id, r.distance) for r in joins.nearest_reference(queries, refs, f"file://{tmp_path}/refs").collect()}
    for k, v in enumerate(asked):
        distance, ref = min((float(np.sqrt(((v - w) ** 2).sum())), 100 - j) for j, w in enumerate(known))
        assert found[k] == (ref, distance)
    assert joins.nearest_reference(queries, refs.limit(0), f"file://{tmp_path}/none").count() == 0


def test_clusters_far_off_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 50
    known, asked = (np.concatenate([c + rng.normal(size=(n, 16)) for c in centres]) for n in (60, 12))
    known[5] = known[17]  # a tie
    make = lambda m: spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(m)], "id long, embedding array<double>")
    counter = spark.sparkContext.accumulator(0)
    found = {r.id: (r.ref_id, r.distance) for r in joins.nearest_reference(make(asked).repartition(3), make(known), f"file://{tmp_path}/refs", counter=counter).collect()}
    for k, v in enumerate(asked):
        distances = np.sqrt(((known - v) ** 2).sum(1))
        assert found[k] == (int(distances.argmin()), float(distances.min()))
    assert len(found) == 480 and 0 < counter.value < 4 * joins.PIVOTS


def test_subjects_are_counted_without_sets(images):
    rows = raster.keep_valid(raster.rasterise(images("a/b.png"), 16, 16), 1, 3)
    assert "collect_set" not in plan_of(rows) and rows.select("sub_id").distinct().count() == 8
    assert raster.keep_valid(raster.rasterise(images("a/b.png"), 16, 16), 1, 9).count() == 0


def test_heatmaps_of_all_levels(images):
    subs, p = images("a/b.png", "a/c.png"), jobs.Prepare(image_shape=(16, 16), blur_size=3, levels=4)
    maps = raster.cumulative_maps(subs, raster.image_bins(subs, 4), 16, 16, 1).collect()
    for r in jobs.heatmaps(subs, p).collect():
        m = np.zeros((16, 16))
        for x in (x for x in maps if (x.image_key, x.level) == (r.image_key, r.level)):
            m[x.y, x.x] = x.v
        assert np.allclose(np.array(r.data).reshape(16, 16), dense.blur(m, 3), atol=1e-6)
    assert {r.level for r in jobs.heatmaps(subs, p).collect()} == {x.level for x in maps} and len({x.level for x in maps}) > 1


def test_merged_heatmaps_replace_older_ones(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "image_key string, level int, v int")
    new = spark.createDataFrame([("b", 0, 2), ("c", 0, 2)], "image_key string, level int, v int")
    assert sorted(tuple(r) for r in sinks.merge_heatmaps(old, new).collect()) == [("a", 0, 1), ("b", 0, 2), ("c", 0, 2)]


def png(path, w, h):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + b"\x80" * w) * h)) + part(b"IEND", b""))


def test_dimensions_of_image_files(spark, tmp_path):
    png(tmp_path / "c1/a.png", 7, 5)
    png(tmp_path / "c2/b.png", 3, 4)
    (tmp_path / "c1/broken.png").write_bytes(b"no image")
    paths = spark.createDataFrame([(f"dump/{x}",) for x in ("c1/a.png", "c1/a.png", "c2/b.png", "c1/broken.png", "c1/missing.png")], "image_path string")
    found = readers.image_dimensions(spark, paths, "dump/", "dump/", str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("c1/a.png", 7, 5), ("c2/b.png", 3, 4)]


def test_transport_cost_against_plain_sinkhorn():
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 6)), rng.random((5, 6))

    def mass(m):
        z = np.maximum((m - m.mean()) / (m.std() + 1e-8), 0) + 1e-12
        return (z / z.sum()).ravel()

    ys, xs = np.meshgrid(np.linspace(0, 1, 5), np.linspace(0, 1, 6), indexing="ij")
    at = np.stack([ys.ravel(), xs.ravel()], 1)
    cost = ((at[:, None] - at[None]) ** 2).sum(2)
    kernel, p, q, v = np.exp(-cost / 0.2), mass(a), mass(b), np.ones(30)
    for _ in range(10):
        u = p / (kernel @ v)
        v = q / (kernel.T @ u)
    assert metrics.emd(a, b) == pytest.approx(float((u[:, None] * kernel * v * cost).sum()))
