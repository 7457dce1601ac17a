"""Near-duplicate maps, runs of the disk, contained keys, file order, headers, stores and draws."""

import random
import struct

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, sub

from attnmaps.functions import dense
from attnmaps.operators import filters, raster, sinks, stats
from attnmaps.sources import readers


def drawn(seed, n, side, clicks, images=("a/b.png", "a/c.png")):
    rng = random.Random(seed)
    rows = []
    for k, key in enumerate(images):
        for i in range(n):
            own = [(rng.randrange(-1, side + 1), rng.randrange(-1, side + 1)) for _ in range(rng.randint(0, clicks))]
            rows.append(sub(1000 * k + i, len(own), image=key, user=i, clicks=own))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("thresh, side, clicks", [(0.0, 3, 3), (1.0, 4, 4), (1.5, 4, 5), (2.5, 6, 9), (9.0, 5, 60), (4.0, 40, 3)])
def test_greedy_removal(spark, thresh, side, clicks):
    rows = drawn(1, 60, side, clicks)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in raster.near_duplicate_maps(df, thresh, side, side).collect()}
    expected = set()
    for key in ("a/b.png", "a/c.png"):
        own = sorted((r for r in df.collect() if r.image_path.endswith(key)), key=lambda r: (r.ord, r.sub_id))
        stack = plain.stack_of([[c.x for c in r.clicks] for r in own], [[c.y for c in r.clicks] for r in own], side, side)
        expected |= {(key, own[k].sub_id) for k in plain.greedy_distinct(stack, thresh)}
    assert found == expected


def test_a_hot_image_has_no_group_of_its_own(spark):
    rows = drawn(2, 400, 12, 6, ("a/b.png",))
    plan = raster.near_maps(raster.distinct_maps(spark.createDataFrame(rows, SCHEMA), 12, 12), 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "NestedLoop" not in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(image_key" in line and line.count("#") < 2]


@pytest.mark.parametrize("size", [1, 3, 5, 21])
def test_runs_of_the_disk(spark, size):
    rng = np.random.default_rng(size)
    m = np.zeros((14, 17))
    m[rng.integers(0, 14, 12), rng.integers(0, 17, 12)] = rng.random(12)
    rows = [("a", int(y), int(x), float(m[y, x])) for y, x in zip(*np.nonzero(m))]
    found = np.zeros_like(m)
    for r in raster.blur_sparse(spark.createDataFrame(rows, "image_key string, y int, x int, v double"), size, 14, 17).collect():
        found[r.y, r.x] += r.v
    assert np.allclose(found, dense.blur(m, size))


def test_keys_anywhere_in_paths(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab/.") for _ in range(n))
    paths = ["/data/" + word(rng.randint(0, 14)) for _ in range(40)] + ["", None]
    keys = [word(n) for n in range(1, 12) for _ in range(12)] + ["", None, "zzzzzzzzz"] + [p[3:11] for p in paths if p]
    df = spark.createDataFrame([(k,) for k in keys], "image_key string")
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    found = sorted(r.image_key for r in filters.restrict_to_listing(df, listing, theta=True).collect())
    assert found == sorted(k for k in keys if k is not None and any(k in p for p in paths if p is not None))
    plan = filters.restrict_to_listing(df, listing, theta=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert filters.restrict_to_listing(df, listing.limit(0), theta=True).count() == 0


def test_file_order_is_not_the_order_of_sizes(spark, tmp_path):
    for name, users in (("a.csv", [7]), ("b.csv", [7, *range(200)]), ("c.csv", range(150))):
        (tmp_path / name).write_text("image_path,user_id,clicks\n" + "".join(f'dump/x/i.png,{u},"[({k % 9}, {len(name) + k}), (1, 1)]"\n' for k, u in enumerate(users)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.read_submissions_csv(spark, str(tmp_path)).withColumn("image_key", F.lit("x/i.png"))
            order = rows.orderBy("ord").select(F.col("ord.file").alias("f"), "user_id").collect()
            assert [(r.f[-5:], r.user_id) for r in order] == [("a.csv", 7), *[("b.csv", u) for u in [7, *range(200)]], *[("c.csv", u) for u in range(150)]]
            first = {r.user_id: r.ord.file[-5:] for r in filters.dedupe_first(rows).collect()}
            assert first == {u: "a.csv" if u == 7 else "b.csv" for u in range(200)}
            assert raster.near_duplicate_maps(rows.withColumn("sub_id", F.col("ord.row")), 1.5, 300, 300).count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers(tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 70_000, 3)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xff\xe1" + struct.pack(">H", 60_000) + b"y" * 59_998 + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 5, 900)
    for k, (data, size) in enumerate([(png, (70_000, 3)), (jpeg, (900, 5)), (png[:23], None), (jpeg[:-3], None), (b"", None), (b"\xff\xd8", None), (b"\xff\xd8ab", None), (b"GIF89a", None)]):
        (tmp_path / f"{k} %20.x").write_bytes(data)
        assert readers.header_size(f"file:{tmp_path}/{k} %20.x") == size
    assert readers.header_size(f"file://{tmp_path}/none") is None


def test_store_keeps_generations_and_touches_few_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda v, keys: spark.createDataFrame([(k, 0, v) for k in keys], "image_key string, level int, v int")
    keys = [f"c/{k}.png" for k in range(60)]
    assert sinks.read_heatmaps(spark, path) is None
    assert [sinks.replace_heatmaps(make(1, keys), path), sinks.replace_heatmaps(make(2, keys[:1] + ["c/new.png"]), path)] == [1, 2]
    read = lambda g=None: {r.image_key: r.v for r in sinks.read_heatmaps(spark, path, g).collect()}
    assert read(1) == dict.fromkeys(keys, 1) and read() == read(2) == {**dict.fromkeys(keys, 1), keys[0]: 2, "c/new.png": 2}
    folders = sorted((tmp_path / "store/data").iterdir())
    assert sorted(len([x for x in f.iterdir() if x.name.startswith("bucket")]) for f in folders)[0] <= 2
    assert sinks.replace_heatmaps(make(1, []), path) == 2 and read() == read(2)


def test_exactly_n_draws(spark):
    rows = [(k, int(k % 10 == 0), "x") for k in range(1000)] + [(3, 0, "x")]
    df = spark.createDataFrame(rows, "sub_id long, label int, extra string")
    found = stats.balanced_resample(df, "sub_id", 5, 4000).collect()
    again = stats.balanced_resample(df.repartition(7), "sub_id", 5, 4000).collect()
    assert len(found) == 4000 and sorted((r.draw, r.sub_id) for r in found) == sorted((r.draw, r.sub_id) for r in again) and {r.draw for r in found} == set(range(4000))
    good = [r.sub_id for r in found if r.label == 1]
    assert 1850 < len(good) < 2150 and len(set(good)) == 100 and stats.balanced_resample(df, "sub_id", 5).count() == 1001
    assert stats.balanced_resample(df.limit(0), "sub_id", 5).count() == 0
